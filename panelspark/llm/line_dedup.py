"""Removal of lines that many documents share.

A line's key is the line without white space (``\\x20``, ``\\x09-\\x0D``) at both ends and with A-Z lower-cased.
Keys are handled by a digest of two 64-bit hashes, worked out for a block of texts at once.

1. Two Bloom filters: a key seen once enters the first, one that is already there enters the second.  As filters are sent
   about, they are compressed ones: one probe into ``SPREAD`` places a line, of which few are taken, cost less to send
   than many probes into a dense bitmap, and make fewer false suspects.  A task gives out the places of its own keys, sorted
   and packed (Elias-Fano: about 2 + log2(``SPREAD`` * tasks) bits a key, where a digest has 128), in slices of the filter.
   Where slices are merged, a place that two of them hold is in the twice-seen filter.
2. The twice-seen filter is broadcast.  Keys whose place it holds are suspected; only they shuffle, pre-aggregated, and are
   counted exactly.  A filter of over ``max_bits`` is broadcast in up to ``MAX_PASSES`` ranges of slices, and the documents are
   read once for each; beyond that every line is a suspect.  Neither changes the rows that result.
3. Confirmed keys are broadcast if at most ``max_broadcast`` (32 bytes each), else joined to the documents that hold suspects;
   lines with those keys go, all of them or all but the first (smallest doc_id, then line).

Defined results: null and empty texts are one empty line; empty keys are never dropped while ``min_chars`` >= 1;
each row is a document, equal rows included; a null id is smaller than any other; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ended, keep, unused
from .textblock import SPACE, blocks, mix, utf8

#: Places of the filters for each line, and for each slice of them (of a million lines).
SPREAD, SLICE_BITS = 128, 27
#: Places that a task gathers before it gives them out, slices that a task merges, and passes with a part of the filter each.
PART, MERGED, MAX_PASSES = 1 << 21, 16, 8
_BLOCK, _LONG_LINE = 2 << 20, 4096
_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
NO_ID = -(1 << 63)


class Lines:
    """The lines of a block of texts: ``start``/``end`` in ``buffer`` (not lower-cased: ``texts`` joined by line ends),
    ``ptr[i]:ptr[i+1]`` those of text i, ``chars`` and ``words`` of their keys, and the digest ``one``, ``two``."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts) + b"\n" + b"\0" * 8
        low = self.buffer.lower()
        raw = np.frombuffer(low, dtype=np.uint8)[:-8]
        self.end = np.flatnonzero(raw == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1])
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.ptr = np.searchsorted(self.start, base)
        solid = ~SPACE[raw]
        at = np.flatnonzero(solid)
        a, b = np.searchsorted(at, self.start), np.searchsorted(at, self.end)
        full = b > a
        begin, stop = self.start.copy(), self.start.copy()
        begin[full], stop[full] = at[a[full]], at[b[full] - 1] + 1
        count = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        chars = count((raw & 0xC0) != 0x80)
        self.chars = chars[stop] - chars[begin]
        starts = count(solid & ~np.concatenate([[False], solid[:-1]]))
        self.words = starts[stop] - starts[begin]
        self._digest(low, begin, stop - begin)

    def _digest(self, low: bytes, begin: np.ndarray, size: np.ndarray) -> None:
        windows = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
        self.one, self.two = mix(size.astype(np.uint64) + _K1), mix(size.astype(np.uint64) ^ _K2)
        left, at = np.flatnonzero((size > 0) & (size <= _LONG_LINE)), 0
        while len(left):
            part = windows[begin[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]
            self.one[left] = mix(self.one[left] ^ part)
            self.two[left] = mix((self.two[left] + part * _K1) ^ _K2)
            at += 8
            left = left[size[left] > at]
        for i in np.flatnonzero(size > _LONG_LINE):
            own = hashlib.blake2b(low[begin[i] : begin[i] + size[i]], digest_size=16).digest()
            self.one[i], self.two[i] = np.frombuffer(own, dtype="<u8")

    def text_of(self) -> np.ndarray:
        """The text that each line is of."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def first_of_each(self, wanted: np.ndarray) -> np.ndarray:
        """Of the wanted lines, the first with its key in each text."""
        own, text = np.flatnonzero(wanted), self.text_of()
        order = own[np.lexsort((own, self.two[own], self.one[own], text[own]))]
        if not len(order):
            return order
        same = (self.one[order][1:] == self.one[order][:-1]) & (self.two[order][1:] == self.two[order][:-1]) & (text[order][1:] == text[order][:-1])
        return order[np.concatenate([[True], ~same])]


def packed(values: np.ndarray, bits: int) -> bytes:
    """Distinct ascending integers of ``bits`` bits: low bits as they are, the others as the gaps between ones."""
    n = len(values)
    low = bits - max(n - 1, 0).bit_length()
    high = np.zeros((1 << bits - low) + n, np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    lows = (values[:, None] >> np.arange(low) & 1).astype(np.uint8)
    return n.to_bytes(4, "little") + np.packbits(high).tobytes() + np.packbits(lows).tobytes()


def unpacked(data: bytes, bits: int) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    low = bits - max(n - 1, 0).bit_length()
    size = ((1 << bits - low) + n + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 4))) - np.arange(n)
    lows = np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + size), count=n * low).reshape(n, low)
    return (high << low) + lows @ (1 << np.arange(low))


def _slices(places: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """The slices of sorted places: their number and the places within."""
    number = places >> bits
    for own in np.split(np.arange(len(places)), np.flatnonzero(number[1:] != number[:-1]) + 1) if len(places) else ():
        yield int(number[own[0]]), places[own] - (number[own[0]] << bits)


def _repeated(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places, and those that are there more than once."""
    at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *places]), return_counts=True)
    return at, at[n > 1]


class _Size:
    """The number of places (2 ** ``bits``) for so many lines, and that of a slice (2 ** ``slice``)."""

    def __init__(self, n_lines: int):
        self.bits = max((SPREAD * n_lines - 1).bit_length(), 12)
        self.slice = min(SLICE_BITS, self.bits)
        self.slices = 1 << self.bits - self.slice

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)


def _filters(size: _Size, min_chars: int):
    """The once-seen and twice-seen filters of a part of a task's lines, in slices that hold anything."""

    def rows(places: list[np.ndarray]) -> pa.RecordBatch:
        once, twice = _repeated(places)
        twice = dict(_slices(twice, size.slice))
        out = [(k, packed(own, size.slice), packed(twice.get(k, own[:0]), size.slice)) for k, own in _slices(once, size.slice)]
        columns = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["slice", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in ended(batches):
            texts = utf8(batch.column(0))
            for a, b in blocks(texts, map(len, texts), _BLOCK):
                lines = Lines(texts[a:b])
                held.append(size.place(lines.one[lines.first_of_each(lines.chars >= min_chars)]))
                if sum(map(len, held)) > PART:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    return run


def _merge(size: _Size):
    """The twice-seen filter of each slice, from rows in the order of slices."""

    def row(k: int, once: list[np.ndarray], twice: list[np.ndarray]) -> pa.RecordBatch:
        both = np.union1d(_repeated(once)[1], np.concatenate(twice))
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(both)], pa.int64()), pa.array([packed(both, size.slice)], pa.binary())], ["slice", "n", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, once, twice = -1, [], []
        for batch in ended(batches):
            for k, o, t in zip(*(column.to_pylist() for column in batch.columns)):
                if k != last and once:
                    yield row(last, once, twice)
                    once, twice = [], []
                last = k
                once.append(unpacked(o, size.slice))
                twice.append(unpacked(t, size.slice))
        if once:
            yield row(last, once, twice)

    return run


def twice_seen(docs: DataFrame, text_col: str, min_chars: int, size: _Size) -> DataFrame:
    """The twice-seen filter over all documents: slice, number of places taken, packed places."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_filters(size, min_chars), "slice int, once binary, twice binary")
    rows = rows.repartition(-(-size.slices // MERGED), "slice").sortWithinPartitions("slice")
    return keep(rows.mapInArrow(_merge(size), "slice int, n long, twice binary"))


def _ranges(filters: DataFrame, most: int) -> list[tuple[int, int]]:
    """First and last slice of ranges that have ``most`` places taken, or a single slice."""
    out, held = [], 0
    for k, n in sorted(map(tuple, filters.select("slice", "n").collect())):
        if out and held + n <= most:
            out[-1], held = (out[-1][0], k), held + n
        else:
            out.append((k, k))
            held = n
    return out or [(0, 0)]


def _places(filters: DataFrame, size: _Size, first: int, last: int) -> np.ndarray:
    """The places taken in a range of slices, sorted."""
    rows = filters.filter(F.col("slice").between(first, last)).select("slice", "twice").toArrow().sort_by("slice")
    return np.concatenate([np.zeros(0, np.int64), *((k << size.slice) + unpacked(own, size.slice) for k, own in zip(*(c.to_pylist() for c in rows.columns)))])


_SUSPECTS = "one long, two long, doc long, line int, long boolean, row long"


def _suspects(filters, size: _Size, min_chars: int, long_words: int | None):
    """Lines whose place the broadcast filter holds (all without one), the first of each key in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if filters is None else filters.value
        for batch in ended(batches):
            texts, docs, rows = utf8(batch.column(0)), batch.column(1).fill_null(NO_ID).to_numpy(), batch.column(2).to_numpy()
            for a, b in blocks(texts, map(len, texts), _BLOCK):
                lines = Lines(texts[a:b])
                own = lines.first_of_each(lines.chars >= min_chars)
                if held is not None:
                    place = size.place(lines.one[own])
                    at = np.searchsorted(held, place)
                    own = own[held[np.minimum(at, len(held) - 1)] == place] if len(held) else own[:0]
                text = lines.text_of()[own]
                long = lines.words[own] >= long_words if long_words else np.zeros(len(own), bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.one[own].view(np.int64)), pa.array(lines.two[own].view(np.int64)), pa.array(docs[a + text]), pa.array((own - lines.ptr[text]).astype(np.int32)), pa.array(long), pa.array(rows[a + text])],
                    ["one", "two", "doc", "line", "long", "row"],
                )

    return run


class _Gone:
    """Confirmed keys, sorted, with their first occurrences."""

    def __init__(self, one, two, doc, line):
        one = one.view(np.uint64)
        order = np.lexsort((two, one))
        self.one, self.two, self.doc, self.line = one[order], two.view(np.uint64)[order], doc[order], line[order]

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Where each key is, or -1."""
        at = np.searchsorted(self.one, one)
        out, open_ = np.full(len(one), -1), np.flatnonzero(at < len(self.one))
        while len(open_):  # further rounds only where keys agree in their first half
            open_ = open_[self.one[at[open_]] == one[open_]]
            hit = self.two[at[open_]] == two[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.one)]
        return out


def _apply(gone_from, keep_first: bool, min_chars: int, fields: list[str]):
    """Rewrites texts; ``gone_from(column)`` gives the repeated keys from the rows' lists of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ended(batches):
            texts, docs, gone = utf8(batch.column(0)), batch.column(1).fill_null(NO_ID).to_numpy(), gone_from(batch.column(2))
            kept, n_lines, n_gone = [], [], []
            for a, b in blocks(texts, map(len, texts), _BLOCK):
                lines = Lines(texts[a:b])
                at = gone.find(lines.one, lines.two)
                drop = (at >= 0) & (lines.chars >= min_chars)
                if keep_first and drop.any():
                    text, hit = lines.text_of(), np.flatnonzero(drop)
                    first = (gone.doc[at[hit]] == docs[a + text[hit]]) & (gone.line[at[hit]] == hit - lines.ptr[text[hit]])
                    drop[hit[first]] = False
                n_lines.append(np.diff(lines.ptr))
                n_gone.append(np.add.reduceat(drop.astype(np.int64), lines.ptr[:-1]))
                for i, n in enumerate(n_gone[-1].tolist()):
                    if n:
                        own = np.flatnonzero(~drop[lines.ptr[i] : lines.ptr[i + 1]]) + lines.ptr[i]
                        kept.append(b"\n".join(lines.buffer[lines.start[k] : lines.end[k]] for k in own.tolist()))
                    else:
                        kept.append(texts[a + i])
            counts = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (n_lines, n_gone)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), *counts, *batch.columns[3:]], fields)

    return run


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
    long_words: int | None = None, long_docs: int = 2, max_bits: int = 1 << 29, max_broadcast: int = 1 << 20,
) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, plus ``n_lines`` and ``n_dropped``.

    A key counts as repeated if at least ``min_docs`` documents hold it, or ``long_docs`` where it has ``long_words``
    words or more.  With ``keep_first`` the line with the smallest (doc_id, line number) stays."""
    if min_docs < 2 or long_docs < 2:
        raise ValueError("min_docs and long_docs must be 2 or more")
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    n_lines = docs.agg(F.coalesce(F.sum(F.coalesce(ends, F.lit(0)) + 1), F.lit(0))).first()[0]
    size = _Size(n_lines)
    filters = twice_seen(docs, text_col, min_chars, size)
    ranges = _ranges(filters, max_bits // 64)
    held = [spark.sparkContext.broadcast(_places(filters, size, *r)) for r in ranges] if len(ranges) <= MAX_PASSES else [None]
    doc = F.col(id_col).cast("long")
    pairs = docs.select(text.alias("text"), doc.alias("doc"), F.xxhash64(doc, text).alias("row"))
    suspects = reduce(DataFrame.unionAll, [pairs.mapInArrow(_suspects(h, size, min_chars, long_words), _SUSPECTS) for h in held])
    repeated = (F.col("n") >= min_docs) | F.col("long") & (F.col("n") >= long_docs)
    counts = suspects.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("doc", "line")).alias("first"), F.max("long").alias("long"))
    confirmed = keep(counts.filter(repeated).select("one", "two", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line")))
    others = [c for c in docs.columns if c != text_col]
    lines_col, dropped_col = unused(docs.columns, "n_lines"), unused(docs.columns, "n_dropped")
    fields = [text_col, lines_col, dropped_col, *others]
    schema = T.StructType(
        [T.StructField(text_col, T.StringType()), T.StructField(lines_col, T.LongType()), T.StructField(dropped_col, T.LongType()), *(docs.schema[c] for c in others)]
    )
    rest = [F.col(c) for c in others]
    own = docs.select(text.alias("__text"), F.col(id_col).cast("long").alias("__doc"), *rest)
    if confirmed.count() <= max_broadcast:
        table = confirmed.toArrow()
        found = spark.sparkContext.broadcast(_Gone(*(c.to_numpy() for c in table.columns)))
        rows = own.select("__text", "__doc", F.lit(None).cast("int").alias("__gone"), *rest)
        out = rows.mapInArrow(_apply(lambda _: found.value, keep_first, min_chars, fields), schema)
    else:
        lists = suspects.join(confirmed, ["one", "two"]).groupBy("row").agg(F.collect_set(F.struct("one", "two", "first_doc", "first_line")).alias("__gone"))
        rows = own.join(lists, F.xxhash64("__doc", "__text") == F.col("row"), "left").select("__text", "__doc", "__gone", *rest)

        def listed(column) -> _Gone:  # a key that one document lists is repeated in all
            flat = column.flatten()
            return _Gone(*(flat.field(k).to_numpy(zero_copy_only=False) for k in ("one", "two", "first_doc", "first_line")))

        out = rows.mapInArrow(_apply(listed, keep_first, min_chars, fields), schema)
    return out.select(*docs.columns, lines_col, dropped_col)
