"""A corpus made ready for training: each stage works on all that the one before it kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents`` (doc_id, text, n_chars and whatever else
``docs`` has, in its order).

Defined results, for every stage: an empty table gives an empty table with the same columns; null in lang, source or
n_chars changes nothing; rows that repeat a doc_id are documents of their own, except that near dedup takes them for one
document with that id; columns whose names an operator uses itself pass through.  What null and empty texts give is
said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.decontaminate import find_contamination
from panelspark.llm.line_dedup import dedup_lines
from panelspark.llm.near_dup import near_duplicates
from panelspark.llm.packing import pack
from panelspark.llm.quality import quality_scores
from panelspark.llm.queries import tokenizer_path
from panelspark.llm.shared import checkpoint_dir, keep, small, table, unused

#: A line counts as repeated if this many documents hold it and its key has this many characters.
LINE_DOCS, LINE_CHARS = 10, 30
#: A line of this many words is a passage, and counts as repeated in this many documents.
LONG_WORDS, LONG_DOCS = 50, 2
#: Near copies share this part of their shingles of so many words, as training corpora are commonly deduplicated;
#: the query op2 takes four words, which its contract fixes.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half go: what resembles rows labelled as of low quality, or as toxic.

    Null and empty texts have the score of the labels' share of good rows and stay if that is half or more."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")).alias("good"))
    score = unused(docs.columns, "score")
    scored = quality_scores(docs, labels, F.lit(True), label_col="good", score_col=score)
    return scored.filter(F.col(score) >= 0.5).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a repeated line the first occurrence (smallest doc_id, then line) stays; documents that lose lines and have
    nothing but white space left go.  ``n_chars`` follows the text.

    Null texts become empty ones; empty and blank texts that lose no line stay."""
    dropped = unused(docs.columns, "n_dropped")
    out = dedup_lines(docs, min_docs=LINE_DOCS, min_chars=LINE_CHARS, keep_first=True, long_words=LONG_WORDS, long_docs=LONG_DOCS)
    out = out.filter((F.col(dropped) == 0) | F.col("text").rlike(r"[^ \t\n\x0b\f\r]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Null, empty and blank texts are copies of nothing and stay, so do rows without a doc_id."""
    gone = keep(near_duplicates(docs, words=SHINGLE_WORDS, percent=SIMILARITY).filter("not kept").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay."""
    flag = unused(docs.columns, "contaminated")
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).filter(~F.col(flag)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left in exactly one sequence; null and empty texts are their end id alone."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", packing),
]

#: The classifier and the packing plan have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what lies between them is written to the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
