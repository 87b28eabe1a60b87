"""Packing of tokenised documents into fixed-length sequences by column generation.

1. One pass tokenises every text and cuts it into full pieces and one remainder; a piece's length and checksum
   are known then, so tokens are never kept.
2. Piece lengths, rounded up to classes of ``width`` tokens, give a histogram of ``seq_len / width`` bins, the only
   thing the driver sees.  A cutting-stock linear program over packing patterns is solved by the revised simplex
   method; columns are priced by an unbounded-knapsack dynamic program.  Pattern counts are rounded down, and
   what is left (some pieces a class at most) is filled by first fit.
3. A full piece is a sequence by itself.  The others are ranked within their class (in slices,
   with a table of slice offsets), ranks are assigned to pattern instances by a broadcast
   interval table (some entries a class), and offsets are running sums of true lengths.

Defined results: null or empty texts are the end id alone; equal rows are packed as separate documents.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ended, keep, small
from .textblock import Words, blocks, utf8

_TOKENIZERS: dict = {}
_CACHE_WORDS, _CACHE_PARTS = 400_000, 50_000
#: Bytes of text worked on at once.
_TEXT_BLOCK = 2 << 20
_PROBE = "The QUICK don't, we'LL b\u00e9b\u00e9! a1b22  x\n\u00df\u4e2d\u6587 \u00c9t\u00e9s-- $9.50 <|endoftext|> it's\t(ok)"
_PLAIN = re.compile("[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
#: The byte-level spelling of bytes that are no printable Latin-1 character: the code points from 256 on, in turn.
_SPELLED = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit integers; ids of recent words are remembered.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those of its
    words in turn.  Words are found and told apart by hash, a block at a time.  A word of ASCII and Latin-1
    letters is split as the tokenizer's own pattern does and its parts go straight to its BPE model; all other words, and
    those in which contractions or special tokens could occur, go through the whole tokenizer.

    A tokenizer of another make is noticed by a probe text and then given whole texts.  What is remembered is some
    40 bytes a word in sorted arrays, and is dropped when a task ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = True
        self.forget()
        try:
            ids, _ = self.block([_PROBE.encode()])
            self.by_word = ids.tolist() == self._whole(_PROBE)
        except Exception:  # the model refuses words spelled in this way
            self.by_word = False
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, bytes] = {}
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) > _CACHE_PARTS:
                self.parts.clear()
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(_SPELLED)
            ids = self.parts[part] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        rest, texts = [], [w.decode("utf-8", "surrogatepass") for w in words]
        for i, word in enumerate(texts):
            if len(word) < 200 and _PLAIN(word):
                out[i] = b"".join(map(self._part, _PARTS(word.lower())))
            else:
                rest.append(i)
        for a in range(0, len(rest), 512):
            own = rest[a : a + 512]
            for i, e in zip(own, self.tokenizer.encode_batch_fast([texts[i] for i in own], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def _remember(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        begin = np.cumsum(size) - size + len(self.ids)
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.begin, self.size = np.insert(self.keys, at, hashes), np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), dtype="<u4")])

    def _lacking(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(hashes))
        return np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)] != hashes)

    def block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's end."""
        if not self.by_word:
            each = [np.array(self._whole(t.decode("utf-8", "surrogatepass")), dtype="<u4") for t in texts]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([len(x) for x in each])
        words = Words(texts)
        unique, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        lacking = self._lacking(unique)
        if len(self.keys) + len(lacking) > _CACHE_WORDS or len(self.ids) > 8 * _CACHE_WORDS:
            self.forget()
            lacking = np.arange(len(unique))
        self._remember(unique[lacking], self._encode([words.word(first[i]) for i in lacking]))
        at = np.searchsorted(self.keys, unique)
        begin, each = self.begin[at][inverse], self.size[at][inverse]
        ends = np.cumsum(each)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + each, each)]
        return ids, np.concatenate([[0], ends])[words.ptr[1:]]


def _word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def _pieces(path: str, end_id: int, seq_len: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(path)
        for batch in ended(batches, ids_of.forget):
            rows: list[tuple] = []
            docs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for a, b in blocks(texts, map(len, texts), _TEXT_BLOCK):
                block, ends = ids_of.block(texts[a:b])
                block, begin = memoryview(block.astype("<u4", copy=False).tobytes()), 0
                for doc, stop in zip(docs[a:b], ends.tolist()):
                    n = stop - begin + 1
                    for s in range(0, n, seq_len):
                        last = min(seq_len, n - s)
                        at = begin + s
                        own = block[4 * at : 4 * (at + last - (s + last == n))]
                        crc = zlib.crc32(end, zlib.crc32(own)) if s + last == n else zlib.crc32(own)
                        rows.append((doc, s, last, crc, n))
                    begin = stop
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names)

    return run


def _best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack over sizes 1..capacity with these values (value[0] is of size 1)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        gains = best[c - 1 :: -1][:c] + value[:c]
        k = int(gains.argmax())
        best[c], last[c] = (gains[k], k + 1) if gains[k] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(capacity, dtype=np.int64), capacity
    while c > 0:
        if last[c]:
            pattern[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def _first_basis(sizes: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible start: the largest sizes first, each pattern used until it exhausts a size (a triangular basis)."""
    open_, columns, uses = np.ones(len(sizes), dtype=bool), [], []
    while open_.any():
        pattern, room = np.zeros(len(sizes)), capacity
        for k in np.flatnonzero(open_)[::-1]:
            pattern[k] = min(room // sizes[k], max(1, int(left[k])))
            room -= pattern[k] * sizes[k]
        held = np.flatnonzero(pattern)
        ratio = left[held] / pattern[held]
        gone = held[ratio.argmin()]
        left = np.maximum(left - ratio.min() * pattern, 0.0)
        left[gone], open_[gone] = 0.0, False
        columns.append(pattern)
        uses.append(ratio.min())
    return np.array(columns).T.copy(), np.array(uses)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination in plain loops: a threaded BLAS is not safe in a driver that has forked."""
    n = len(a)
    w = np.hstack([a, np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(w[k:, k]).argmax())
        w[[k, p]] = w[[p, k]]
        w[k] /= w[k, k]
        factor = w[:, k].copy()
        factor[k] = 0.0
        w -= np.outer(factor, w[k])
    return w[:, n:].copy()


def cutting_stock(demand: np.ndarray, capacity: int, rounds: int = 4000, tolerance: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size 1..capacity) and how often each is used; together exactly ``demand``."""
    active = np.flatnonzero(demand)
    if not len(active):
        return []
    basis, uses = _first_basis(active + 1, demand[active].astype(float), capacity)
    inverse = _inverse(basis)
    for _ in range(rounds):
        value = np.zeros(capacity)
        value[active] = np.maximum(inverse.sum(axis=0), 0.0)
        gain, pattern = _best_pattern(value, capacity)
        if gain <= 1 + tolerance:
            break
        column = pattern[active].astype(float)
        direction = np.einsum("ij,j->i", inverse, column)
        ratio = np.where(direction > 1e-9, uses / np.where(direction > 1e-9, direction, 1.0), np.inf)
        leave = int(ratio.argmin())
        theta = ratio[leave]
        if not np.isfinite(theta):
            break
        uses = np.maximum(uses - theta * direction, 0.0)
        uses[leave] = theta
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
    left = demand.astype(np.int64).copy()
    plan: dict[bytes, int] = {}

    def use(pattern: np.ndarray, times: int) -> None:
        if times > 0:
            left[:] -= pattern * times
            plan[pattern.tobytes()] = plan.get(pattern.tobytes(), 0) + times

    for k in np.argsort(-uses):
        pattern = np.zeros(capacity, dtype=np.int64)
        pattern[active] = np.rint(basis[:, k]).astype(np.int64)
        held = pattern > 0
        use(pattern, min(int(uses[k] + 1e-6), int((left[held] // pattern[held]).min())) if held.any() else 0)
    while left.any():  # a few pieces of each size: largest first into the fullest place that holds them
        pattern, room = np.zeros(capacity, dtype=np.int64), capacity
        for s in np.flatnonzero(left)[::-1] + 1:
            n = min(room // s, int(left[s - 1]))
            pattern[s - 1] = n
            room -= n * s
        held = pattern > 0
        use(pattern, max(1, int((left[held] // pattern[held]).min())))
    return [(np.frombuffer(p, dtype=np.int64), n) for p, n in plan.items()]


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048,
    end_id: int = 1, width: int = 8,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    capacity = -(-seq_len // width)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = keep(texts.mapInArrow(_pieces(tokenizer_path, end_id, seq_len), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    parts = pieces.filter(F.col("length") < seq_len).withColumn("__class", F.ceil(F.col("length") / width).cast("int"))
    classes = parts.groupBy("__class").count().collect()  # at most ``capacity`` rows
    demand = np.zeros(capacity, dtype=np.int64)
    for r in classes:
        demand[r["__class"] - 1] = r["count"]
    intervals, given, base = [], np.zeros(capacity, dtype=np.int64), 0
    for pattern, times in cutting_stock(demand, capacity):
        for s in np.flatnonzero(pattern):
            n = int(pattern[s])
            intervals.append((int(s) + 1, int(given[s]), int(given[s]) + n * times, n, base))
            given[s] += n * times
        base += times
    intervals = F.broadcast(spark.createDataFrame(intervals, "__c int, __from long, __to long, __each long, __base long"))
    slices = 1 + math.isqrt(int(demand.sum())) // 8  # so that both slices and rows of a slice grow with the root
    parts = parts.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("__class").orderBy("__slice")) - F.col("n")
    offsets = parts.groupBy("__class", "__slice").agg(F.count("*").alias("n")).select("__class", "__slice", before.alias("__before"))
    order = Window.partitionBy("__class", "__slice").orderBy("doc_id", "start", "ids_crc32", "length")
    ranked = parts.withColumn("__rank", F.row_number().over(order).cast("long")).join(small(keep(offsets)), ["__class", "__slice"])
    ranked = ranked.withColumn("__rank", F.col("__rank") - 1 + F.col("__before"))
    placed = ranked.join(intervals, (F.col("__class") == F.col("__c")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    placed = placed.withColumn("sequence_id", F.col("__base") + F.floor((F.col("__rank") - F.col("__from")) / F.col("__each")).cast("long"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("__class"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    placed = placed.select(*columns, F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))

    # A full piece is a sequence by itself: numbered by where it stands in its written partition, without a shuffle.
    full = pieces.filter(F.col("length") == seq_len).withColumn("__at", F.monotonically_increasing_id())
    held = full.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row a partition
    starts, total = [], base
    for r in held:
        starts.append((r["__part"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))
    full = full.join(starts, F.shiftright("__at", 33) == F.col("__part"))
    full = full.withColumn("sequence_id", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.unionByName(full.select(*columns, F.lit(0).cast("long").alias("offset")))
