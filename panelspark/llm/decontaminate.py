"""Benchmark decontamination by latent semantic retrieval and sequence alignment.

1. The terms are the words of the benchmark items.  One pass counts, over all documents, how many hold each term.
   Terms in over ``max_share`` of the documents are dropped, but every item keeps its ``least_terms`` rarest words.
2. One pass sketches the TF-IDF matrix A of all passages (``stride``-word steps) for a single-pass randomised
   singular value decomposition: tasks add up A^T (A Omega), at most ``slice_items`` items' terms times ``rank`` + 8
   numbers, they are summed by group of terms, and one task takes the Nystroem form's singular vectors.
3. One pass projects overlapping passages and holds them against the items by cosine.  Items are dealt in classes of
   length, and a class's passages are ``SLACK`` to twice ``SLACK`` times as long as its items and overlap by three quarters, so
   a passage that holds the share f of an item's weight has a cosine of about f / sqrt(length ratio), whatever the item's
   length; ``cosine`` is below that for f = ``weak``.  It must also have ``HELD`` of the item's vector, which passages of one or
   two terms have not.  Only the class's own terms count.  Candidates
   are confirmed on whole words around the passage: the longest common subsequence must cover ``strong`` of the
   item, or ``weak`` of it and ``strong`` of its answer (its last sentence).

Benchmarks of more than ``slice_items`` items are worked off slice by slice, so what is broadcast is bounded.

Defined results: null and empty texts and texts without benchmark terms are clean; items without words match
nothing; items with equal texts are reported each; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ended, unused
from .textblock import Words, blocks, encoded, utf8


#: Terms whose sketch rows travel together.
GROUP = 256
#: Passages are at least so much longer than items, and have so many words.
SLACK, SHORTEST = 1.25, 16
#: A passage's component along an item's vector is this part of that vector at least.
HELD = 0.3


class Items:
    """Benchmark items as word hashes, with their vocabulary."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, dtype=np.int64)
        raw = encoded(texts)
        words, answers = Words(raw), Words([encoded([_answer(t or "")])[0] for t in texts])
        self.words = [words.hashes[a:b] for a, b in zip(words.ptr[:-1], words.ptr[1:])]
        self.answers = [answers.hashes[a:b] for a, b in zip(answers.ptr[:-1], answers.ptr[1:])]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that hold a vocabulary word, and which."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(self.vocabulary):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        held = self.vocabulary[term] == hashes[at]
        return at[held], term[held]


def _answer(text: str) -> str:
    """The last sentence."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if p.strip()]
    return parts[-1] if parts else ""


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    bits: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        bits[x] = bits.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        m = bits.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _document_frequency(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        df, docs = np.zeros(len(own.vocabulary), dtype=np.int64), 0
        for batch in batches:
            texts = utf8(batch.column(0))
            docs += len(texts)
            for a, b in blocks(texts, map(len, texts)):
                words = Words(texts[a:b])
                at, term = own.terms(words.hashes)
                doc = np.searchsorted(words.ptr, at, side="right") - 1
                df += np.bincount(np.unique(doc * len(df) + term) % max(len(df), 1), minlength=len(df))[: len(df)]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], docs))], ["term", "n"])

    return run


def _weights(items: Items, df: np.ndarray, docs: int, max_share: float, least_terms: int) -> np.ndarray:
    """Inverse document frequency of the terms in use, 0 for the others."""
    used = df <= max_share * docs
    for words in items.words:
        terms = np.unique(items.terms(words)[1])
        used[terms[np.argsort(df[terms], kind="stable")[:least_terms]]] = True
    return np.where(used, np.log((1.0 + docs) / (1.0 + df)) + 0.1, 0.0)


def _sums(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by group: the distinct groups in order, and one row each."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[begin], np.add.reduceat(rows[order], begin, axis=0)


def _omega(n: int, width: int) -> np.ndarray:
    return np.random.default_rng(0).standard_normal((n, width))


def _sketch(model, width: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf = model.value
        omega = _omega(len(idf), width) * idf[:, None]
        y = np.zeros((len(idf), width))

        def add(texts: list[bytes]) -> None:
            words = Words(texts)
            at, term = items.terms(words.hashes)
            at, term = at[idf[term] > 0], term[idf[term] > 0]
            if not len(at):
                return
            doc = np.searchsorted(words.ptr, at, side="right") - 1
            passage = doc * (len(words.hashes) + 1) + (at - words.ptr[doc]) // stride
            names, z = _sums(omega[term], passage)
            t, sums = _sums(z[np.searchsorted(names, passage)] * idf[term][:, None], term)
            y[t] += sums

        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in blocks(texts, map(len, texts)):
                add(texts[a:b])
        parts = [(k, y[k * GROUP : (k + 1) * GROUP]) for k in range(-(-len(y) // GROUP))]
        yield _parts([(k, part) for k, part in parts if part.any()])

    return run


def _parts(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([y.tobytes() for _, y in parts], pa.binary())], ["part", "y"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(y)
            sums[k] = sums[k] + own if k in sums else own
    yield _parts(list(sums.items()))


def _nystroem(model, width: int, rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf = model.value
        y = np.zeros((len(idf), width))

        def fitted(u: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u.astype(np.float32).tobytes()], pa.binary()), pa.array([u.shape[1]], pa.int32())], ["u", "rank"])

        for batch in ended(batches):
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y[k * GROUP : (k + 1) * GROUP] += np.frombuffer(part).reshape(-1, width)
        for words in items.words:  # the items are passages too
            t = items.terms(words)[1]
            a = np.bincount(t, minlength=len(idf)) * idf
            y += np.outer(a, a @ _omega(len(idf), width)) if len(idf) else 0.0
        core = _omega(len(idf), width).T @ y
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        held = values > max(values.max(initial=0.0), 0.0) * 1e-10
        if not y.size or not held.any():
            yield fitted(np.zeros((len(idf), 1)))
            return
        u, _, _ = np.linalg.svd(y @ (vectors[:, held] / np.sqrt(values[held])), full_matrices=False)
        yield fitted(u[:, :rank])

    return run


class _Class:
    """Items of like length: the passages that are held against them, their vectors, and which terms they have."""

    def __init__(self, window: int, own: list[int], items: Items, idf: np.ndarray, space: np.ndarray):
        self.window, self.stride = window, window // 4
        self.own = np.array(own)
        self.vectors = np.zeros((len(own), space.shape[1]), dtype=np.float32)
        self.used = np.zeros(len(idf), dtype=bool)
        for i, item in enumerate(own):
            terms = items.terms(items.words[item])[1]
            self.used[terms[idf[terms] > 0]] = True
            self.vectors[i] = space[terms].sum(axis=0)
        self.norms = np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-9)
        self.vectors /= self.norms

    def candidates(self, words: Words, at: np.ndarray, term: np.ndarray, space: np.ndarray, cosine: float):
        """(text, item, first word) of passages near an item: of that cosine, and holding ``HELD`` of the item's own vector."""
        at, term = at[self.used[term]], term[self.used[term]]
        if not len(at):
            return
        spread = 4
        doc = np.searchsorted(words.ptr, at, side="right") - 1
        step = (at - words.ptr[doc]) // self.stride
        steps = len(words.hashes) // self.stride + 2
        first = (doc[:, None] * steps + np.maximum(step[:, None] - np.arange(spread), 0)).ravel()
        once = np.ones((len(at), spread), dtype=bool)
        once[:, 1:] = step[:, None] >= np.arange(1, spread)
        once = once.ravel()
        names, sums = _sums(space[np.repeat(term, spread)[once]], first[once])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        for i in range(0, len(names), 4096):
            along = sums[i : i + 4096] @ self.vectors.T
            for p, item in zip(*np.nonzero((along >= cosine * size[i : i + 4096]) & (along >= HELD * self.norms.T))):
                yield int(names[i + p] // steps), int(self.own[item]), int(names[i + p] % steps) * self.stride


def classes(items: Items, idf: np.ndarray, space: np.ndarray) -> list[_Class]:
    by_window: dict[int, list[int]] = {}
    for i, words in enumerate(items.words):
        if len(words):
            window = SHORTEST
            while window < SLACK * len(words):
                window *= 2
            by_window.setdefault(window, []).append(i)
    return [_Class(w, own, items, idf, space) for w, own in sorted(by_window.items())]


def matched(items: Items, h: np.ndarray, places: dict[int, set], weak: float, strong: float) -> dict[int, float]:
    """Of the items that may stand in a document at some places (first word, passage length), those that do: the largest
    share of each that is held in order."""
    best: dict[int, float] = {}
    for item, at in sorted(places.items()):
        words, answer = items.words[item], items.answers[item]
        listed = words.tolist()
        for start, window in sorted(at):
            region = h[max(0, start - len(words)) : start + window + len(words)]
            seen = set(region.tolist())
            if sum(w in seen for w in listed) < weak * len(words):  # no subsequence is longer
                continue
            share = lcs_length(words, region) / len(words)
            if share >= strong or share >= weak and answer.size and lcs_length(answer, region) >= strong * len(answer):
                best[item] = max(best.get(item, 0.0), share)
                if share >= 1.0:
                    break
    return best


def _search(model, cosine: float, weak: float, strong: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, space = model.value
        by_length = classes(items, idf, space)
        for batch in ended(batches):
            texts = utf8(batch.column(0))
            ids, shares = [[] for _ in texts], [0.0] * len(texts)
            for a, b in blocks(texts, map(len, texts)):
                words = Words(texts[a:b])
                at, term = items.terms(words.hashes)
                found: dict[int, dict[int, set]] = {}
                for c in by_length:
                    for doc, item, start in c.candidates(words, at, term, space, cosine):
                        found.setdefault(doc, {}).setdefault(item, set()).add((start, c.window))
                for doc, places in found.items():
                    best = matched(items, words.hashes[words.ptr[doc] : words.ptr[doc + 1]], places, weak, strong)
                    ids[a + doc] = sorted(int(items.ids[i]) for i in best)
                    shares[a + doc] = max(best.values(), default=0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.float64()), *batch.columns[1:]], ["__items", "__share", *batch.schema.names[1:]])

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    stride: int = 16, rank: int = 64, cosine: float = 0.35, weak: float = 0.6, strong: float = 0.8,
    max_share: float = 0.02, least_terms: int = 8, slice_items: int = 20_000,
) -> DataFrame:
    """``docs`` with ``contaminated``, ``item_ids`` (matched benchmark items, ascending) and ``item_share`` (the largest
    share of a matched item that the document holds in order; 0 if none)."""
    spark = docs.sparkSession
    width = rank + 8
    flag, listed, share = (unused(docs.columns, c) for c in ("contaminated", "item_ids", "item_share"))
    text = F.col(text_col).cast("string").alias("__text")
    out = docs.withColumn(listed, F.array().cast("array<bigint>")).withColumn(share, F.lit(0.0))
    source = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    slices = max(1, -(-source.count() // slice_items))
    for k in range(slices):
        rows = source.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == k).distinct().orderBy("id", "text").toArrow()
        items = Items(rows.column(0).to_pylist(), rows.column(1).to_pylist())
        counts = docs.select(text).mapInArrow(_document_frequency(spark.sparkContext.broadcast(items)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df, total = np.zeros(len(items.vocabulary), dtype=np.int64), 0
        for t, n in zip(counts.column(0).to_pylist(), counts.column(1).to_pylist()):
            if t < 0:
                total = n
            else:
                df[t] = n
        idf = _weights(items, df, total, max_share, least_terms)
        model = spark.sparkContext.broadcast((items, idf))
        parts = docs.select(text).mapInArrow(_sketch(model, width, stride), "part int, y binary")
        sums = parts.repartition("part").mapInArrow(_add, "part int, y binary")
        fitted = sums.repartition(1).mapInArrow(_nystroem(model, width, rank), "u binary, rank int").first()
        vectors = np.frombuffer(fitted.u, dtype=np.float32).reshape(len(idf), fitted.rank) if fitted else np.zeros((len(idf), 1), np.float32)
        space = vectors * idf[:, None].astype(np.float32)
        final = spark.sparkContext.broadcast((items, idf, space))
        schema = ", ".join(["__items array<bigint>", "__share double", *(f"`{c}` {t.simpleString()}" for c, t in ((f.name, f.dataType) for f in out.schema.fields))])
        out = out.select(text, *out.columns).mapInArrow(_search(final, cosine, weak, strong), schema)
        out = out.withColumn(listed, F.array_sort(F.array_union(listed, "__items"))).withColumn(share, F.greatest(share, "__share")).drop("__items", "__share")
    return out.withColumn(flag, F.size(listed) > 0)
