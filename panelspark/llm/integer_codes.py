"""Vectors coded by the nearest entries of small codebooks, in whole numbers only.

Components become integers, vectors are cut into equal parts, and each part position has a codebook that is refined
by rounds of assignment and averaging.  Nearest entries are found with the integer Walsh-Hadamard transform: a part
and an entry, padded with zeros to a power of two m, keep their squared distance times m under it, and most of that
distance lies in the coefficients of low sequency.  Squared differences are added up in sequency order, and an entry
leaves as soon as its sum is above the whole distance of one that is known; what is left is compared exactly.

Each pass reads the vectors once, in tasks; what leaves a task is one row of sums for each entry that it has met (no
more than parts x entries), which Spark adds up.  Only codebooks (parts x entries x length integers) pass the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ended, keep, small

#: Vectors of a block whose distances are held at a time.
BLOCK = 1024
#: Coefficients added between two eliminations.
STRIDE = 4
#: Components below this size are added up in 64 bits, and have exact distances there if they are below ``FAR`` / m;
#: larger ones are worked off with Python's integers, which are as exact and slow.
WIDE, FAR = 1 << 50, 1 << 30


def floors(components: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers; Python's where 64 bits are too few."""
    x = components.astype(np.float64)
    if not x.size or np.abs(x).max() < WIDE / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def sequency_rows(m: int) -> np.ndarray:
    """Row numbers of the m x m Walsh-Hadamard matrix by their number of sign changes."""
    h = walsh(np.eye(m, dtype=np.int64))
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")


def walsh(x: np.ndarray) -> np.ndarray:
    """The unscaled Walsh-Hadamard transform of every row (their length is a power of two), by sums and differences."""
    n, m = x.shape
    half = 1
    while half < m:
        pairs = x.reshape(n, m // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, m)
        half *= 2
    return x


def transformed(parts: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two, transformed, in sequency order."""
    m = 1
    while m < parts.shape[1]:
        m *= 2
    padded = np.zeros((len(parts), m), dtype=parts.dtype)
    padded[:, : parts.shape[1]] = parts
    return walsh(padded)[:, sequency_rows(m)]


def assign(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the nearest row of ``entries`` (ties to the lower one) and the squared distance."""
    largest = max(max(map(abs, (a.max(), a.min()))) for a in (parts, entries))
    wide = np.int64 if largest * 2 * parts.shape[1] < FAR else object
    x, c = transformed(parts.astype(wide)), transformed(entries.astype(wide))
    n, m = x.shape
    stride = min(STRIDE, m)
    total = np.zeros((n, len(c)), dtype=wide)
    for k in range(stride):
        d = x[:, k, None] - c[None, :, k]
        total += d * d
    guess = total.argmin(axis=1)
    d = x - c[guess]
    bound = (d * d).sum(axis=1)
    row, entry = np.nonzero(total <= bound[:, None])  # in order of rows, then entries
    total = total[row, entry]
    for k in range(stride, m, stride):
        d = x[row, k : k + stride] - c[entry, k : k + stride]
        total = total + (d * d).sum(axis=1)
        stays = total <= bound[row]
        row, entry, total = row[stays], entry[stays], total[stays]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.minimum.reduceat(total, first)
    hit = np.flatnonzero(total == np.repeat(least, np.diff(np.concatenate([first, [len(row)]]))))
    _, at = np.unique(row[hit], return_index=True)  # the first hit of a row is its lowest entry
    return entry[hit[at]], least // m


def cut(vectors: pa.Array, parts: int, scale: int) -> np.ndarray:
    """(rows, parts, length) whole numbers of vectors of one length, zeros at the end if parts do not divide it."""
    flat = floors(vectors.flatten().to_numpy(zero_copy_only=False), scale).reshape(len(vectors), -1)
    length = -(-flat.shape[1] // parts)
    if flat.shape[1] < parts * length:
        flat = np.concatenate([flat, np.zeros((len(flat), parts * length - flat.shape[1]), dtype=flat.dtype)], axis=1)
    return flat.reshape(len(flat), parts, length)


def _sums(books: list[np.ndarray], column: int, parts: int, scale: int):
    """What the rows of a task add to each entry; decimal texts, since sums can pass 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, dtype=object) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                block = cut(batch.column(column).slice(begin, BLOCK), parts, scale)
                for p, book in enumerate(books):
                    index, _ = assign(block[:, p], book)
                    part = np.zeros(book.shape, dtype=block.dtype)
                    np.add.at(part, index, block[:, p])
                    total[p] = total[p] + part
                    count[p] += np.bincount(index, minlength=len(book))
        rows = [(p, e, int(count[p][e]), [str(v) for v in total[p][e]]) for p in range(parts) for e in np.flatnonzero(count[p])]
        if rows:
            p, e, n, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(np.array(e), pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return lambda batches: ended(run(batches))


def _added(table: pa.Table) -> pa.Table:
    """All tasks' sums of one entry (a row a task) as its new components, rounded down."""
    n = sum(table.column("n").to_pylist())
    total = [sum(map(int, own)) // n for own in zip(*table.column("sums").to_pylist())]
    return pa.table({"part": table.column("part")[:1], "entry": table.column("entry")[:1], "mean": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})


def _codes(books: list[np.ndarray], column: int, parts: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for begin in range(0, batch.num_rows, BLOCK):
                block = cut(batch.column(column).slice(begin, BLOCK), parts, scale)
                found = [assign(block[:, p], book) for p, book in enumerate(books)]
                codes += ["".join(f"{e:02x}" for e in own) for own in zip(*(index for index, _ in found))]
                errors += [str(sum(map(int, own))) for own in zip(*(far for _, far in found))]
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != column]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(codes, pa.string()), pa.array(errors, pa.string())], names=[*(n for i, n in enumerate(batch.schema.names) if i != column), "code", "error"])

    return lambda batches: ended(run(batches))


def fit_codebooks(vectors: DataFrame, vector_col: str, *, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """One array (entries, length) for each part position, from the rows of smallest ``id`` refined ``rounds`` times."""
    start = vectors.filter("id is not null").orderBy("id", vector_col).limit(entries).select(vector_col).toArrow()
    first = start.column(0).combine_chunks()
    if not len(first):
        return []
    block = cut(first, parts, scale)
    books = [block[:, p] for p in range(parts)]
    for _ in range(rounds):
        sums = vectors.select(vector_col).mapInArrow(_sums(books, 0, parts, scale), "part int, entry int, n long, sums array<string>")
        books = [b.astype(object) for b in books]
        means = sums.groupBy("part", "entry").applyInArrow(_added, "part int, entry int, mean array<string>")
        for r in means.toLocalIterator():  # parts x entries rows at most
            books[r["part"]][r["entry"]] = [int(v) for v in r["mean"]]
        books = [b.astype(np.int64) if max(map(abs, b.ravel())) < WIDE else b for b in books]
    return books


def code_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Per kept row: the id, the label, ``code`` (two hexadecimal digits for each part), ``error`` (squared distance),
    ``label_error`` (the errors of equal labels added up, nulls together) and ``codebooks_sha256`` (the final entries'
    components in decimal, by part, entry and position, joined by commas).

    Defined results: rows whose vector is null, empty or holds null, NaN or an infinity take no part.  All vectors have
    to be of one length, that of the kept row of smallest id (ties: the smallest vector); others take no part either.
    Fewer rows than ``entries`` make smaller codebooks.  Rows that repeat an id are rows of their own; among them the
    smaller vectors come first when the codebooks start.  Rows without an id are coded but start no entry; if no row
    has an id, nothing is returned.  A length that ``parts`` does not divide is filled up with zeros.  An ``error``
    that 64 bits cannot hold is null, as is its label's sum.  Other columns of ``rows`` are not returned."""
    if not 0 < entries <= 256:
        raise ValueError("two hexadecimal digits tell 256 entries apart")
    x = F.col(f"`{vector_col}`")
    plain = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = rows.filter(plain).select(F.col(f"`{id_col}`").alias("id"), x.alias("vector"), F.col(f"`{label_col}`").alias("label"))
    first = kept.filter("id is not null").orderBy("id", "vector").limit(1).select(F.size("vector").alias("n")).first()
    kept = kept.filter(F.size("vector") == (first["n"] if first else -1))
    books = fit_codebooks(kept, "vector", parts=parts, entries=entries, rounds=rounds, scale=scale)
    text = ",".join(str(int(v)) for b in books for v in b.ravel())
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"id {types['id']}, label {types['label']}, code string, error string"
    coded = kept.select("id", "label", "vector").mapInArrow(_codes(books, 2, parts, scale), schema) if books else kept.filter("false").select("id", "label", F.lit("").alias("code"), F.lit("0").alias("error"))
    coded = keep(coded.withColumn("error", F.expr("try_cast(error as bigint)")))
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint"))
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(small(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
