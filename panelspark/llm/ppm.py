"""Language-model scores by prediction by partial matching over bytes, and a smoothed word-unigram score.

Training counts come from every training document: byte strings of ``depth`` + 1 bytes, that is a context and its
symbol (``depth`` start marks and one end mark a text, byte FF, which UTF-8 never has), and word counts by 64-bit word
hash.  Tasks pre-aggregate, Spark sums.  Keys of byte strings are the bytes themselves, so counts are exact.

The trie has all contexts of ``depth`` bytes and less that training holds; it grows with the corpus.  Escapes are
estimated by method D (a symbol seen c times in n gets (c - 1/2) / n, the escape q / 2n for q distinct symbols) with full
symbol exclusion (what a longer context has seen is no longer expected after its escape).  The probability of a symbol
is a function of its byte string, so it is worked out once for each distinct string that the documents hold: strings
seen in training need their context's counts only; the others are joined with the nodes of their contexts of three bytes
and more, and below these take the counts of two, one and no bytes, which are bounded (2^24 strings) and broadcast.

Neither word nor byte-string tables have a bound: the most frequent entries, at most ``top_words`` and ``top_strings`` (16
bytes each), found by a histogram of counts, are broadcast; the remaining occurrences join their table and are
summed per document.

Defined results: null is the empty text, whose only token is the end; equal rows are scored alike and each counts
in training; with no training rows every word is unknown and bytes are uniform.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ended, keep
from .textblock import Words, blocks, mix, utf8

_MARK = b"\xff"
#: Bytes of text worked on at once: codes take eight times as much.
_BLOCK = 1 << 19
_MODELS: dict = {}
#: Probabilities that a worker remembers.
KNOWN = 100_000


def _codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each byte and end mark with the ``depth`` bytes before it, and where each text's codes begin."""
    raw = np.frombuffer(b"".join(_MARK * depth + t + _MARK for t in texts), dtype=np.uint8).astype(np.int64)
    codes = np.zeros(len(raw) - depth, dtype=np.int64)
    for k in range(depth + 1):
        codes = (codes << 8) | raw[k : len(raw) - depth + k]
    sizes = np.fromiter((len(t) + depth + 1 for t in texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(sizes) - sizes
    held = np.ones(len(codes), dtype=bool)
    for k in range(1, depth + 1):
        held[begin[1:] - k] = False
    return codes[held], begin - depth * np.arange(len(texts))


def _add_up(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, n) parts with their summed n."""
    keys, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _gather(depth: int, held: int = 1 << 20):
    """(kind, key, n): byte strings are kind 0 (n counts training only and may be 0), words 1, documents 2."""

    def out(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs = [], 0
        for batch in ended(batches):
            all_texts, train = utf8(batch.column(0)), np.array(batch.column(1).to_pylist(), dtype=bool)
            for own in (True, False):
                texts = [all_texts[i] for i in np.flatnonzero(train == own)]
                docs += own * len(texts)
                for a, b in blocks(texts, map(len, texts), _BLOCK):
                    code, n = np.unique(_codes(texts[a:b], depth)[0], return_counts=True)
                    parts.append((code, n * own))
                    if sum(len(k) for k, _ in parts) > held:
                        parts = [_add_up(parts)]
                        if len(parts[0][0]) > held // 2:
                            yield out(0, *parts.pop())
                    if own:
                        words, n = np.unique(Words(texts[a:b]).hashes, return_counts=True)
                        yield out(1, words.view(np.int64), n)
        yield out(0, *_add_up(parts))
        yield out(2, np.zeros(1, np.int64), np.array([docs]))

    return run


class Low:
    """Counts of contexts of two, one and no bytes, from those of strings of three."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.counts = {2: (code, n)}
        for k in (1, 0):
            self.counts[k] = _add_up([(self.counts[k + 1][0] & ((1 << 8 * (k + 1)) - 1), self.counts[k + 1][1])])
        self.known: dict[int, float] = {}

    def log10(self, last: int, gone: set | None) -> float:
        """log10 probability of the last of three bytes after the two before it, without the symbols that are gone."""
        if gone is None and (p := self.known.get(last)) is not None:
            return p
        symbol, p, out = last & 255, 0.0, set(gone or ())
        for k in (2, 1, 0):
            context = (last >> 8 & ((1 << 8 * k) - 1)) << 8
            code, n = self.counts[k]
            a, b = np.searchsorted(code, (context, context + 256))
            symbols = (code[a:b] & 255).tolist()
            left = {s: c for s, c in zip(symbols, n[a:b].tolist()) if s not in out}
            total = sum(left.values())
            if symbol in left:
                p += np.log10((left[symbol] - 0.5) / total)
                break
            p += np.log10(len(left) / 2 / total) if total else 0.0
            out |= set(symbols)
        else:
            p -= np.log10(256 - len(out))
        if gone is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[last] = p
        return p


def _low(broadcast) -> Low:
    """The low orders, made once in a worker."""
    key = broadcast.value[0]
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Low(*broadcast.value[1:3])
    return _MODELS[key]


def _unseen(model):
    """(key, p) of byte strings that training lacks, from the nodes of their contexts, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = _low(model)
        for batch in ended(batches, _MODELS.clear):
            keys, nodes, out = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[1:]], []
            for i, key in enumerate(keys):
                symbol, p, gone = key & 255, 0.0, None
                for node in (column[i] for column in nodes):
                    if node is None:
                        continue
                    counts = {e["symbol"]: e["n"] for e in node if gone is None or e["symbol"] not in gone}
                    total = sum(counts.values())
                    if symbol in counts:
                        p += np.log10((counts[symbol] - 0.5) / total)
                        break
                    p += np.log10(len(counts) / 2 / total) if total else 0.0
                    gone = {e["symbol"] for e in node}
                else:
                    p += low.log10(key & 0xFFFFFF, gone)
                out.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["key", "p"])

    return run


class Slots:
    """Values by key: one slot a key hash, and a sorted list of the keys that lost their slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, 1 + int(len(keys)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.values = np.zeros(len(self.keys))
        at = self._at(keys)
        self.keys[at] = keys
        own = self.keys[at] == keys
        self.values[at[own]] = values[own]
        lost = np.flatnonzero(~own)
        lost = lost[np.argsort(keys[lost])]
        self.lost, self.lost_values = keys[lost], values[lost]

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys (0 where there is none) and which were found."""
        at = self._at(keys)
        held, out = self.keys[at] == keys, self.values[at]
        out[~held] = 0.0
        if len(self.lost):
            left = np.flatnonzero(~held)
            where = np.minimum(np.searchsorted(self.lost, keys[left]), len(self.lost) - 1)
            same = self.lost[where] == keys[left]
            held[left[same]], out[left[same]] = True, self.lost_values[where[same]]
        return out, held


def _strings(broadcast) -> Slots:
    key = ("slots", broadcast.value[0])
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Slots(*broadcast.value[1:3])
    return _MODELS[key]


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Lists that end at these places of ``flat``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))


def _score(model, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _strings(model)
        top, log_count = model.value[3:5]
        for batch in ended(batches, _MODELS.clear):
            texts = utf8(batch.column(1))
            for a, b in blocks(texts, map(len, texts), _BLOCK):
                codes, begin = _codes(texts[a:b], depth)
                p, found = strings.find(codes)
                lost = np.add.reduceat((~found).astype(np.int64), begin)
                words = Words(texts[a:b])
                at = np.minimum(np.searchsorted(top, words.hashes), max(len(top) - 1, 0))
                hit = top[at] == words.hashes if len(top) else np.zeros(len(words.hashes), bool)
                sums = np.concatenate([[0.0], np.cumsum(np.where(hit, log_count[at], 0.0) if len(top) else hit * 0.0)])
                hits = np.concatenate([[0], np.cumsum(hit)])
                lo, hi = words.ptr[:-1], words.ptr[1:]
                missed = words.hashes.view(np.int64)[~hit]
                columns = [hi - lo + 1, hits[hi] - hits[lo], sums[hi] - sums[lo], np.add.reduceat(p, begin)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *map(pa.array, columns), _lists(missed, hi - hits[hi]), _lists(codes[~found], np.cumsum(lost))],
                    ["doc", "tokens", "known", "base", "score", "rare", "deep"],
                )

    return run


def _most(rows: DataFrame, most: int) -> DataFrame:
    """At most so many of the rows, those with the largest n, by a histogram of n."""
    size = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in sorted(rows.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):  # some hundred rows
        total += r["count"]
        if total > most:
            break
        least = r["size"]
    return rows.filter(size >= least) if least is not None else rows.limit(0)


def score_texts(
    docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", top_words: int = 1 << 18, depth: int = 5, top_strings: int = 1 << 20
) -> DataFrame:
    """A row per document row: doc_id, n_tokens, n_known, train_tokens, base_score, score; models learn from the
    rows where ``train`` holds.  ``depth`` is the longest context in bytes, 2 to 6."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    counts = docs.select(text, F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(_gather(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = keep(counts)
    words = counts.filter("kind = 1")
    sums = {r.kind: r for r in counts.groupBy("kind").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()}
    documents = sums[2].n if 2 in sums else 0
    total = (sums[1].n if 1 in sums else 0) + documents
    distinct = (sums[1].kinds if 1 in sums else 0) + (documents > 0)

    def low(bits: int) -> Column:
        return F.col("key").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    own = counts.filter("kind = 0 and n > 0").select("key", "n")
    orders = {depth: own}
    for k in range(depth - 1, 1, -1):  # shorter contexts' counts are sums of the longer ones'
        orders[k] = orders[k + 1].groupBy(low(8 * (k + 1)).alias("key")).agg(F.sum("n").alias("n"))
        orders[k] = keep(orders[k]) if k > 2 else orders[k]
    trigrams = orders[2].toArrow().sort_by("key")
    code, n = trigrams.column(0).to_numpy(), trigrams.column(1).to_numpy()
    name = uuid.uuid4().hex
    model = spark.sparkContext.broadcast((name, code, n))
    context = F.shiftright("key", 8)
    seen = own.withColumn("p", F.log10((F.col("n") - 0.5) / F.sum("n").over(Window.partitionBy(context))))
    lacking = counts.filter("kind = 0 and n = 0").select("key")
    for k in range(depth, 2, -1):
        nodes = orders[k].groupBy(context.alias("of")).agg(F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(255).cast("long")).cast("int").alias("symbol"), "n")).alias(f"node{k}"))
        lacking = lacking.join(nodes, F.shiftright(low(8 * (k + 1)), 8) == F.col("of"), "left").drop("of")
    unseen = lacking.mapInArrow(_unseen(model), "key long, p double")
    strings = keep(seen.unionByName(unseen.withColumn("n", F.lit(0).cast("long"))))

    top = _most(words, top_words).select("key", "n").toArrow()
    top_hash, top_n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(top_hash)
    often = _most(strings.filter("n > 0"), top_strings).select("key", "p").toArrow()
    lists = spark.sparkContext.broadcast((name, often.column(0).to_numpy(), often.column(1).to_numpy(), top_hash[order], np.log10(top_n[order] + 1.0)))
    scored = docs.select(F.col(id_col).cast("long").alias("doc"), text)
    scored = scored.mapInArrow(_score(lists, depth), "doc long, tokens long, known long, base double, score double, rare array<long>, deep array<long>")
    scored = keep(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("key")).join(words.select("key", "n"), "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    deep = scored.select("row", F.explode("deep").alias("key")).join(strings.select("key", "p"), "key").groupBy("row").agg(F.sum("p").alias("deeper"))
    end = float(np.log10(documents + 1.0))
    every = float(np.log10(total + distinct + 1.0))
    out = scored.drop("rare", "deep").join(rare, "row", "left").join(deep, "row", "left")
    return out.select(
        F.col("doc").alias("doc_id"), F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(documents > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) + F.lit(end) - F.col("tokens") * F.lit(every)).alias("base_score"),
        (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"),
    )
