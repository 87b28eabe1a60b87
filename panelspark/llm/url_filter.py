"""URL filters: rules on hosts and paths, found by short prefixes of digests and confirmed by whole ones.

A rule is (host, path, verdict).  It fits the urls of its host and of all subdomains whose path starts with its path.
Every url is expanded into expressions: each suffix of its host at a label's boundary, joined with each prefix of its
path that is empty or ends in ``/``.  A rule stands under one such expression, its host with its path up to the last
``/``.  Expressions and rules are equi-joined on the first 32 bits of the expression's SHA-256; the whole rule, whose
path may go on within a segment, is then confirmed by the full digest of the url's own host suffix and path prefix of
the rule's length.  Of the rules that fit a url the longest (code points of host and path) wins; of equally long ones
that with the longer host, then ``block`` before ``allow``.

Only column functions run.  What a url is expanded to is bounded by the rules: no more labels and no deeper prefixes
than the deepest rule has, since longer expressions cannot fit.  Few rules (a count shows it) are broadcast; more are
dealt out with the url's row number as a salt, so that an expression like ``com/``, which most urls have, is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS

#: Hexadecimal digits of a digest that are joined on.
PREFIX = 8
#: Parts that a key's urls are dealt to when the rules are too many for a broadcast.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, and the path up to ``?``
    or ``#``; both empty for null and for urls without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Host suffixes of up to ``labels`` labels with path prefixes of up to ``depth`` slashes: structs (host, text)."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    steps = F.split(path, "/")
    ends = F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(depth)))
    paths = F.transform(ends, lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/"))))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("host"), F.concat(h, p).alias("text")))))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` with four more columns: ``host``, ``path``, ``rule`` (the winning rule's host and path, else null) and
    ``verdict`` (the rule's, else ``default``).

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``); hosts are compared with A-Z lower-cased.

    Defined results: urls that are null, empty or without ``://`` have an empty host and path and the default verdict
    (a rule without a host would fit them); rows that repeat stay rows of their own; no rules or none that fits gives
    the default; rules with a null in host, path or verdict are left out and repeated ones count once; columns of
    ``pages`` whose names are among the four new ones are replaced, others of any name pass through."""
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in new]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("held"), host.alias("host"), path.alias("path"))

    own = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    slashes = lambda c: F.size(F.split(c, "/")) - 1
    stands = F.concat("rule_host", F.regexp_extract("rule_path", r"^(?:.*/)?", 0))
    own = own.select(
        "rule_host", F.length("rule_path").alias("rule_length"), F.concat("rule_host", "rule_path").alias("rule"), "verdict",
        digest(F.concat("rule_host", "rule_path")).alias("whole"), F.substring(digest(stands), 1, PREFIX).alias("key"), slashes(F.col("rule_path")).alias("slashes"),
    )
    size = own.agg(F.count("*").alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max("slashes").alias("depth")).first()
    found = expressions(F.col("host"), F.col("path"), size["labels"] or 1, size["depth"] or 0)
    asked = urls.select("*", F.explode(found).alias("e")).select("*", F.substring(digest(F.col("e.text")), 1, PREFIX).alias("key"))
    if size["n"] <= broadcast_rows:
        near = asked.join(F.broadcast(own), "key", "left")
    else:
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    fits = (F.col("e.host") == F.col("rule_host")) & (F.length("path") >= F.col("rule_length")) & (digest(F.concat(F.col("e.host"), F.expr("substring(path, 1, rule_length)"))) == F.col("whole"))
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"), (F.col("verdict") == "block").alias("c"), "rule", "verdict")))
    out = near.groupBy("row").agg(F.first("held").alias("held"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    fields = [F.col("held")[c].alias(c) for c in kept]
    return out.select(*fields, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
