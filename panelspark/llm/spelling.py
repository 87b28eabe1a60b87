"""Spelling variants: words one edit apart, found through PartEnum signatures of their letters.

A word's letters, taken as a multiset, are a binary vector with one dimension for each letter and occurrence (the
second ``e`` is not the first).  One inserted, deleted or replaced letter changes at most two of its bits.  So the
dimensions are dealt into ``PARTS`` parts; of two vectors at Hamming distance two at most, all parts but two agree,
and a vector's signatures are its projections on every choice of ``PARTS - 2`` parts.  Near vectors share one of them:

1. the corpus is counted to words, and words to distinct vectors, which are several times fewer (a vector's anagrams
   are never one edit apart and are not compared with each other);
2. vectors are equi-joined on signatures, and pairs that are too far apart go;
3. pairs of vectors are spelt out again in words, and each pair of words is verified by its edit distance.

No bucket of signatures is collected: all three steps are joins, which Spark splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep, small
from .textblock import mix

#: Parts that the dimensions are dealt to; any two of them may differ.
PARTS = 6
#: A run of letters, with the Latin-1 letters.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typos(doc_id: Column, run: Column, every: int) -> Column:
    """The run, without one code point where ``every`` divides crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, *, min_chars: int = 5, min_count: int = 3, every: int | None = 97) -> DataFrame:
    """(word, n) of the whole texts' runs of letters, A-Z lower-cased."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    word = F.col("run") if every is None else typos(F.col("doc_id"), F.col("run"), every)
    return runs.select(word.alias("word")).filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def vector_of(word: Column) -> Column:
    """The word's multiset of letters, written as its sorted letters."""
    return F.array_join(F.array_sort(F.array_remove(F.split(word, ""), "")), "")


def signatures(vectors: list[str]) -> np.ndarray:
    """(vectors, choices of parts) 64-bit signatures: hashes of what a vector has in the chosen parts."""
    letters = np.frombuffer("".join(vectors).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])[:-1]
    fresh = np.ones(len(letters), dtype=bool)
    fresh[1:] = letters[1:] != letters[:-1]
    fresh[begins] = True
    runs = np.flatnonzero(fresh)
    occurrence = np.arange(len(letters)) - runs[np.cumsum(fresh) - 1]
    bits = mix(letters << np.uint64(32) | occurrence.astype(np.uint64))
    part = mix(bits) % np.uint64(PARTS)
    own = [np.add.reduceat(np.where(part == np.uint64(p), bits, np.uint64(0)), begins) for p in range(PARTS)]
    return np.stack([mix(np.sum([own[p] for p in chosen], axis=0, dtype=np.uint64) + np.uint64(k)) for k, chosen in enumerate(combinations(range(PARTS), PARTS - 2))], axis=1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(0)
        found = signatures(vectors.to_pylist())
        rows = np.repeat(np.arange(len(vectors)), found.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), vectors.take(pa.array(rows))], names=["signature", "vector"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(a, b), each pair once: vectors that share a signature and may be one or two bits apart."""
    signed = vectors.mapInArrow(_signed, "signature long, vector string")
    a, b = signed.select("signature", F.col("vector").alias("a")), signed.select("signature", F.col("vector").alias("b"))
    # sorted letters one or two bits apart differ by one letter out and one in, or by one of these
    close = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 2) >= 1)
    return a.join(b, (a["signature"] == b["signature"]) & (F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each pair both ways round: words that differ by one inserted, deleted or replaced letter."""
    spelt = words.select("word", "n", vector_of(F.col("word")).alias("vector"))
    pairs = near_vectors(spelt.select("vector").distinct())
    a = spelt.select(F.col("vector").alias("a"), F.col("word").alias("x"), F.col("n").alias("x_n"))
    b = spelt.select(F.col("vector").alias("b"), F.col("word").alias("y"), F.col("n").alias("y_n"))
    found = pairs.join(a, "a").join(b, "b").filter(F.levenshtein("x", "y", 1) == 1)
    ways = F.array(F.struct(F.col("x").alias("word"), F.col("x_n").alias("n"), F.col("y").alias("other"), F.col("y_n").alias("other_n")), F.struct(F.col("y").alias("word"), F.col("y_n").alias("n"), F.col("x").alias("other"), F.col("x_n").alias("other_n")))
    return found.select(F.inline(ways))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): links (word, form) followed to the end.  Every round doubles the steps taken, so a chain of k links takes log2 k rounds."""
    at = keep(links.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        step = keep(at.join(small(onward), F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def spelling_groups(docs: DataFrame, *, min_chars: int = 5, min_count: int = 3, ratio: int = 2, every: int | None = 97) -> DataFrame:
    """Per word of at least ``min_chars`` code points and ``min_count`` occurrences (``n``): the number of near words
    (``n_near``, 0 if none), ``form``, its near word of largest n (ties: the smallest in code-point order) if that n,
    ``form_n``, is at least ``ratio`` x its own (else both null), and ``root``, where following forms ends.

    ``docs`` has ``doc_id`` and ``text``; ``every`` plants a missing letter in one of so many (document, word) pairs
    (None: nowhere).

    Defined results: null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count as
    often as they stand; an empty table gives no rows; other columns are not read.  A form has twice the count at
    least, so forms never run in circles."""
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms could run in circles")
    words = keep(word_counts(docs, min_chars=min_chars, min_count=min_count, every=every))
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("other")))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = -F.col("best.rank") >= ratio * F.col("n")
    near = keep(near.select("word", "n_near", F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.rank")).alias("form_n")))
    ends = roots(near.filter("form is not null").select("word", "form"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
