"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's terms are of two kinds.  Shapes: trigrams of byte classes (letters, digits, spaces, line ends, each kind of
mark) and some counts of repeated words, weighted by inverse document frequency and brought to unit length.  Words:
runs of letters, by hash; those that by themselves tell the label in the sample (chi-squared of ``least_chi2`` or more,
log odds changed by ``least_odds`` or more) count with ``word_weight`` times that change.

From a sample of about ``sample`` labelled rows (those of low id hash, the same on every run, in order of their ids) one
task fits weights and a truncated singular value decomposition, on blocks of rows of a sparse matrix.  The
sample's latent vectors and labels, ``sample`` x ``rank`` floats, are broadcast with the projection (a row of ``rank``
floats for each shape in use, at most ``SHAPES``, and for each word that matters, at most ``max_words``, those of the largest
chi-squared); every document of every size is projected and held, in blocks, against all of them by exact cosine,
and the ``neighbours`` nearest, with all that are as near as the last of them, vote with weight cosine ** ``power``.

Defined results: null, empty and other texts without any known term get the sample's share of label 1; so does every
text where that share is 0 or 1 or no labelled row may be used (then 0.5).  Rows whose label is null do not teach; of
repeated labels of an id the smallest counts; copies of a document each teach.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ended, spread_sample
from .textblock import Words, blocks, utf8

CLASSES, EXTRA = 32, 8
SHAPES = CLASSES**3 + EXTRA
_CLASS = np.zeros(256, dtype=np.int32)
for _i, _members in enumerate(
    ["", "\n", " \t\r\x0b\x0c", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".", ",", "!", "?", ":;", "'\"`", "()[]{}", "<>", "#", "*", "%", "$", "&", "|", "-", "_", "=+", "/\\", "@", "^~"]
):
    _CLASS[list(_members.encode())] = _i
_CLASS[128:192], _CLASS[192:] = 26, 27
#: Bytes that stand between runs of letters.
_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False
_ROWS = 256


def shapes(texts: list[bytes]) -> np.ndarray:
    """Relative frequencies of shapes, square-rooted, one row per text."""
    out = np.zeros((len(texts), SHAPES), dtype=np.float32)
    raw = _CLASS[np.frombuffer(b"".join(b"\n\n" + t + b"\n" for t in texts), dtype=np.uint8)]
    code = (raw[:-2] * CLASSES + raw[1:-1]) * CLASSES + raw[2:]
    words, at = Words(texts), 0
    for i, t in enumerate(texts):
        if not t:
            at += 3
            continue
        out[i, : CLASSES**3] = np.bincount(code[at : at + len(t) + 1], minlength=CLASSES**3) / (len(t) + 1)
        at += len(t) + 3
        h = words.hashes[words.ptr[i] : words.ptr[i + 1]]
        n = max(len(h), 1)
        for lag in (1, 2, 3, 4):
            out[i, CLASSES**3 + lag - 1] = (h[lag:] == h[:-lag]).sum() / n
        out[i, CLASSES**3 + 4] = 1 - len(np.unique(h)) / n
    return np.sqrt(out, out=out)


def vocabulary(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, word hash) of the distinct words of each text, in order of texts."""
    words = Words(texts, _NO_LETTER)
    text = np.repeat(np.arange(len(texts)), np.diff(words.ptr))
    order = np.lexsort((words.hashes, text))
    text, h = text[order], words.hashes[order]
    first = np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    return text[first], h[first]


def _lists(at: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32)), values)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ended(batches):
        texts = utf8(batch.column(0))
        for a, b in blocks(texts, (len(t) + 20_000 for t in texts)):
            counts = shapes(texts[a:b])
            row, term = np.nonzero(counts)
            text, word = vocabulary(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(a, b - a), _lists(row, pa.array(term.astype(np.int32)), b - a), _lists(row, pa.array(counts[row, term]), b - a),
                    _lists(text, pa.array(word.view(np.int64)), b - a), batch.column(2).slice(a, b - a),
                ],
                ["id", "term", "value", "word", "label"],
            )


class Model(NamedTuple):
    """Shapes in use with their weights, words that matter (hashes, sorted) with theirs, the projection of both, and the
    sample's latent vectors (of unit length) and labels."""

    used: np.ndarray
    idf: np.ndarray
    words: np.ndarray
    weight: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def rows(self, counts: np.ndarray, text: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The weighted term vectors of a block of texts, dense."""
        out = np.zeros((len(counts), len(self.used) + len(self.words)), dtype=np.float32)
        own = counts[:, self.used] * self.idf
        out[:, : len(self.used)] = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            held = self.words[at] == word
            out[text[held], len(self.used) + at[held]] = self.weight[at[held]]
        return out


def latent_space(parts, columns: int, rows: int, rank: int) -> np.ndarray:
    """Right singular vectors, columns x rank, of the matrix whose blocks of rows ``parts()`` yields, by randomised
    subspace iteration."""
    q = np.random.default_rng(0).standard_normal((columns, min(rank + 8, columns, rows))).astype(np.float32)
    for _ in range(4):
        y = np.zeros_like(q)
        for a in parts():
            y += a.T @ (a @ q)
        q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(np.concatenate([a @ q for a in parts()]), full_matrices=False)
    return (q @ vt.T)[:, :rank]


def _matter(words: list[np.ndarray], labels: np.ndarray, least_df: int, least_chi2: float, least_odds: float, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that tell the label, and by how much they change its log odds."""
    n, positive = len(words), float(labels.sum())
    every = np.concatenate([np.zeros(0, np.uint64), *words])
    word, at = np.unique(every, return_inverse=True)
    df = np.bincount(at, minlength=len(word))
    both = np.bincount(at, weights=np.repeat(labels, [len(w) for w in words]), minlength=len(word))
    spread = df * (n - df) * positive * (n - positive)
    chi2 = n * (n * both - df * positive) ** 2 / np.maximum(spread, 1e-9)
    odds = np.abs(np.log((both + 0.5) / (df - both + 0.5)) - np.log((positive + 0.5) / (n - positive + 0.5)))
    held = np.flatnonzero((df >= least_df) & (spread > 0) & (chi2 >= least_chi2) & (odds >= least_odds))
    held = np.sort(held[np.argsort(-chi2[held], kind="stable")[:max_words]])
    return word[held], odds[held]


def _fit(rank: int, least_df: int, word_weight: float, least_chi2: float, least_odds: float, max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in ended(batches) if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        rows = rows.take(pa.array(np.argsort(np.array(rows.column("id").to_pylist()), kind="stable"))).combine_chunks()
        each = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in rows.column(c)]
        n, labels, terms, values = rows.num_rows, rows.column("label").to_numpy().astype(np.float32), each("term"), each("value")
        least = min(least_df, max(n // 4, 1))
        df = np.zeros(SHAPES, dtype=np.int64)
        for t in terms:
            df[t] += 1
        used = np.flatnonzero(df >= least)
        idf = (np.log((1 + n) / (1 + df[used])) + 1).astype(np.float32)
        words = [w.view(np.uint64) for w in each("word")]
        matter, odds = _matter(words, labels, least, least_chi2, least_odds, max_words)
        if not len(used) and not len(matter):
            return
        none = np.zeros((0, rank), np.float32)
        model = Model(used, idf, matter, (word_weight * odds).astype(np.float32), none, none, labels)

        def parts() -> Iterator[np.ndarray]:
            for a in range(0, n, _ROWS):
                counts = np.zeros((min(_ROWS, n - a), SHAPES), dtype=np.float32)
                for i, (t, v) in enumerate(zip(terms[a : a + _ROWS], values[a : a + _ROWS])):
                    counts[i, t] = v
                own = words[a : a + _ROWS]
                yield model.rows(counts, np.repeat(np.arange(len(own)), [len(w) for w in own]), np.concatenate(own))

        space = latent_space(parts, len(used) + len(matter), n, rank)
        vectors = np.concatenate([a @ space for a in parts()])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        names = list(Model._fields)
        parts_of = (used.astype(np.int32), idf, matter, model.weight, space.astype(np.float32), vectors.astype(np.float32), labels)
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in parts_of], names)

    return run


def votes(x: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int, power: float) -> np.ndarray:
    """Per row of x (latent vectors) the neighbours' weighted share of label 1; NaN where nothing is near."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.round((x / np.maximum(norm, 1e-12)) @ vectors.T, 5)
    least = np.partition(cosine, len(labels) - neighbours, axis=1)[:, len(labels) - neighbours]
    weight = np.where(cosine >= least[:, None], np.maximum(cosine, 0.0), 0.0).astype(np.float64) ** power
    total = weight.sum(axis=1)
    found = (norm[:, 0] > 1e-9) & (total > 0)
    return np.where(found, (weight @ labels / np.where(found, total, 1.0)).clip(0, 1), np.nan)


def _vote(broadcast, neighbours: int, power: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        prior = float(model.labels.mean()) if len(model.labels) else 0.5
        k = min(neighbours, max(3, len(model.labels) // 20), len(model.labels))
        for batch in ended(batches):
            texts, out = utf8(batch.column(0)), []
            for a, b in blocks(texts, (len(t) + 20_000 for t in texts)):
                if k:
                    score = votes(model.rows(shapes(texts[a:b]), *vocabulary(texts[a:b])) @ model.space, model.vectors, model.labels, k, power)
                    out.append(np.where(np.isnan(score), prior, score))
                else:
                    out.append(np.full(b - a, prior))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0), *out])), *batch.columns[1:]], ["__score", *batch.schema.names[1:]])

    return run


def quality_scores(
    docs: DataFrame, labels: DataFrame, teach: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", score_col: str = "score",
    sample: int = 8000, rank: int = 64, neighbours: int = 24, power: float = 16.0, least_df: int = 5, word_weight: float = 0.5, least_chi2: float = 30.0, least_odds: float = 3.0, max_words: int = 20_000,
) -> DataFrame:
    """``docs`` with ``score_col``: how likely label 1 is.  Only rows of ``labels`` where ``teach`` holds (a condition
    on its ``id_col``) are learnt from."""
    spark = docs.sparkSession
    chosen = labels.filter(teach & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(F.col(label_col).cast("float")).alias("label"))
    chosen = spread_sample(chosen, "__id", sample)
    texts = docs.select(F.col(id_col).alias("__id2"), F.col(text_col).cast("string").alias("text"))
    taught = texts.join(F.broadcast(chosen), F.col("__id2") == F.col("__id")).select("text", F.col("__id").cast("string").alias("id"), "label")  # about ``sample`` rows broadcast
    fitted = taught.mapInArrow(_features, "id string, term array<int>, value array<float>, word array<long>, label float").repartition(1)
    names = Model._fields
    fitted = fitted.mapInArrow(_fit(rank, least_df, word_weight, least_chi2, least_odds, max_words), ", ".join(f"{c} binary" for c in names)).first()
    kinds = dict(zip(names, (np.int32, np.float32, np.uint64, np.float32, np.float32, np.float32, np.float32)))
    model = Model(**{c: np.frombuffer(fitted[c] if fitted else b"", kinds[c]) for c in names})
    if fitted:
        model = model._replace(space=model.space.reshape(len(model.used) + len(model.words), -1), vectors=model.vectors.reshape(len(model.labels), -1))
    rest = [c for c in docs.columns if c != score_col]
    text = F.col(text_col).cast("string").alias("__text")
    schema = ", ".join(["__score double", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)])
    out = docs.select(text, *rest).mapInArrow(_vote(spark.sparkContext.broadcast(model), neighbours, power), schema)
    return out.select(*rest, F.col("__score").alias(score_col))
