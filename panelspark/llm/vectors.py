"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

1. One pass brings vectors to float64, drops those that take no part and reduces bit-equal ones to classes that keep
   the ``k`` + 1 smallest ids (salted, then merged): no other of them can ever be among a query's k nearest.
2. The tree is fitted by one task on a bounded sample: about ``sample`` rows of low id hash, by default 20,000 or, if
   that is more, four times the root of the number of classes, so leaves and their sizes both grow with the root.
   K-means with ``branch`` centres a level goes on until a node holds at most ``leaf`` of the sample.  Every class of
   the whole table is then assigned to its leaf; nothing is left out of the index.
3. A query walks the tree with a priority queue of unopened branches, best centre first.  How many leaves it opens is
   calibrated: the visits are widened until at most ``calibrate`` stated queries, broadcast and held against all rows
   in the tasks that hold these, find ``recall`` of their true neighbours.
4. Each leaf's members, dealt in blocks of bounded size, meet the queries that visit the leaf.  Queries of up to
   ``QUERY_BYTES`` are broadcast, more of them are dealt in blocks too and joined on leaf and block, so a hot leaf is many
   rows.  Tasks keep each query's best, and the best k of those remain.  Scores are cosines of the original vectors
   in double precision.

Defined results: vectors that are null or zero or hold null, NaN or infinite components take no part, nor do those of
another length than most (of equally many, the shorter); ties go to the smaller id; with fewer than k candidates all
are returned; repeated rows count as candidates of equal id once; of a query id's vectors one that sorts first asks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ended, keep, spread_sample

BLOCK = 1024
#: Stated queries of so many bytes at most are broadcast; more of them meet the leaves' members by a join.
QUERY_BYTES = 32 << 20
#: Found rows that a task holds before it reduces them to each query's best.
HELD = 1 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means; centres, fewer than k if some stay empty."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centres)) > 0
        centres = _unit(sums[held])
    return centres


class Tree:
    """Nodes as arrays: ``children[i]`` are node numbers (none for a leaf), ``centre[i]`` its unit centre."""

    def __init__(self, x: np.ndarray, branch: int, leaf: int):
        self.centre, self.children = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[]]
        open_ = [(0, x)]
        while open_:
            node, own = open_.pop()
            if len(own) <= leaf:
                continue
            centres = kmeans(own, branch, seed=node)
            if len(centres) < 2:
                continue
            near = (own @ centres.T).argmax(axis=1)
            for c in range(len(centres)):
                self.children[node].append(len(self.centre))
                open_.append((len(self.centre), own[near == c]))
                self.centre.append(centres[c])
                self.children.append([])
        self.centre = np.array(self.centre)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every level."""
        at = np.zeros(len(x), dtype=np.int64)
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            at[rows] = node
            if self.children[node] and len(rows):
                kids = np.array(self.children[node])
                near = (x[rows] @ self.centre[kids].T).argmax(axis=1)
                open_ += [(int(kid), rows[near == c]) for c, kid in enumerate(kids)]
        return at

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first leaves that best-bin-first traversal opens."""
        score = self.centre @ q
        queue, out = [(0.0, 0)], []
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = sorted(self.children[node], key=lambda c: -score[c])
                for c in kids[1:]:
                    heapq.heappush(queue, (-score[c], c))
                node = kids[0]
            out.append(node)
        return out


def _fit(branch: int, leaf: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        rows = [(i, v) for f in frames for i, v in zip(f["id"], f["v"])]
        if rows:
            x = np.array([v for _, v in sorted(rows, key=lambda r: (r[0], r[1].tolist()))], dtype=np.float64)
            yield pd.DataFrame({"tree": [pickle.dumps(Tree(_unit(x), branch, leaf))]})

    return run


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Equally long lists of numbers as float64 rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _assign(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ended(batches):
            leaf = tree.value.assign(_unit(_matrix(batch.column(0)))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return run


def _visits(tree, leaves: int):
    """(q, leaf) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ended(batches):
            ids, units = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1))) if batch.num_rows else ()
            for at in range(0, len(ids), 128):
                found = [tree.value.visit(v, leaves) for v in units[at : at + 128]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 128], [len(x) for x in found])), pa.array(np.concatenate(found).astype(np.int64))], ["q", "leaf"])

    return run


class Best:
    """Each query's best members so far: parallel arrays of query, score and a row of ``ids``."""

    def __init__(self, k: int):
        self.k, self.rows = k, 0
        self.parts: list[tuple] = []

    def meet(self, q: np.ndarray, x: np.ndarray, ids: pa.ListArray, members: np.ndarray, leaf: pa.Array | None = None) -> None:
        """Holds queries (ids and vectors) against members (lists of ids and vectors)."""
        norm, xnorm = np.sqrt((members * members).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
        n = min(self.k + 1, len(members))
        for a in range(0, len(q), 256):
            every = x[a : a + 256] @ members.T / (xnorm[a : a + 256, None] * norm[None, :])
            least = np.partition(every, len(members) - n, axis=1)[:, len(members) - n] - 1e-9  # ties, whatever the rounding
            row, near = np.nonzero(every >= least[:, None])
            for c in range(0, len(row), 1 << 16):
                r, m = row[c : c + (1 << 16)], near[c : c + (1 << 16)]
                exact = (members[m] * x[a + r]).sum(axis=1) / (norm[m] * xnorm[a + r])
                self.parts.append((q[a + r], exact, ids.take(pa.array(m)), None if leaf is None else leaf.take(pa.array(m))))
                self.rows += len(r)
        if self.rows > HELD:
            self._reduce()

    def _reduce(self) -> None:
        if not self.parts:
            return
        q, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        leaf = None if self.parts[0][3] is None else pa.concat_arrays([p[3] for p in self.parts])
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        order = np.lexsort((first, -score, q))
        begin = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - begin <= self.k]  # one more than k: the query itself may be among them
        self.parts = [(q[order], score[order], ids.take(pa.array(order)), None if leaf is None else leaf.take(pa.array(order)))]
        self.rows = len(order)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self._reduce()
        for q, score, ids, leaf in self.parts:
            for a in range(0, len(q), 10_000):
                more = [] if leaf is None else [leaf.slice(a, 10_000)]
                yield pa.RecordBatch.from_arrays([pa.array(q[a : a + 10_000]), pa.array(score[a : a + 10_000]), ids.slice(a, 10_000), *more], ["q", "score", "ids", *(["leaf"] if more else [])])


def _scan(asked, k: int):
    """All members of a task against all broadcast queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, x = asked.value
        best = Best(k)
        for batch in ended(batches):
            for a in range(0, batch.num_rows, BLOCK):
                own = batch.slice(a, BLOCK)
                best.meet(q, x, own.column(1), _matrix(own.column(0)), own.column(2))
        yield from best.batches()

    return run


def _search_blocks(asked, k: int):
    """Blocks of a leaf's members against the broadcast queries that visit the leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, x, begin, visitors = asked.value  # visitors[begin[leaf] : begin[leaf + 1]] are the rows of a leaf's queries
        best = Best(k)
        for batch in ended(batches):
            for row in range(batch.num_rows):
                leaf, members = batch.column(0)[row].as_py(), batch.column(1)[row].values
                who = visitors[begin[leaf] : begin[leaf + 1]]
                if len(who):
                    best.meet(q[who], x[who], members.field("ids"), _matrix(members.field("v")))
        yield from best.batches()

    return run


def _search_pairs(k: int):
    """Blocks of queries against blocks of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in ended(batches):
            for row in range(batch.num_rows):
                queries, members = batch.column(0)[row].values, batch.column(1)[row].values
                best.meet(queries.field("q").to_numpy(), _matrix(queries.field("qv")), members.field("ids"), _matrix(members.field("v")))
        yield from best.batches()

    return run


_FOUND = "q long, score double, ids array<long>"


def _blocks(members: DataFrame) -> DataFrame:
    """(leaf, block, members): a leaf's members in blocks of about ``BLOCK``."""
    m = members.join(F.broadcast(members.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nm"))), "leaf")  # a row a leaf
    return m.groupBy("leaf", "nm", F.pmod(F.xxhash64("id"), F.col("nm")).cast("int").alias("block")).agg(F.collect_list(F.struct("ids", "v")).alias("members"))


def _joined(queries: DataFrame, visited: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """What queries of any number find."""
    q = visited.join(queries.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    q = q.join(F.broadcast(visited.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq"))), "leaf")
    q = q.groupBy("leaf", F.pmod(F.xxhash64("q"), F.col("nq")).alias("qb")).agg(F.collect_list(F.struct("q", "qv")).alias("queries"))
    q = q.join(F.broadcast(blocks.select("leaf", "nm").distinct()), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)))
    return q.hint("merge").join(blocks.select("leaf", "block", "members"), ["leaf", "block"]).select("queries", "members").mapInArrow(_search_pairs(k), _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """(q, rank, id, score): the best k others of each query."""
    each = found.withColumn("id", F.explode("ids")).filter("id <> q").dropDuplicates(["q", "id"])
    near = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)


def _leaves_needed(tree: Tree, asked: tuple, truth: list, recall: float) -> int:
    """How many leaves a query must open for this share of the true neighbours: (q, leaf) of each."""
    q, x = asked
    turn = {i: {leaf: t for t, leaf in enumerate(tree.visit(v, len(tree.leaves)))} for i, v in zip(q.tolist(), _unit(x))}
    turns = sorted(turn[r["q"]][r["leaf"]] for r in truth)
    return turns[min(math.ceil(recall * len(turns)), len(turns)) - 1] + 1 if turns else 1


def _collected(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = queries.select("id", "v").toArrow()
    return rows.column(0).to_numpy(), _matrix(rows.column(1).combine_chunks())


def nearest(
    vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = 0.95,
    sample: int | None = None, branch: int = 8, leaf: int = 160, calibrate: int = 256, query_bytes: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id satisfies ``is_query`` (a function of the id column)."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(good)
    none = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return none
    rows = rows.filter(F.size("v") == length["n"])
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(F.flatten(ids))), 1, k + 1)
    order = Window.partitionBy("v", "salt").orderBy("id")
    classes = salted.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.collect_list(F.array("id")).alias("ids"))
    classes = keep(classes.select("v", least("ids").alias("ids")).withColumn("id", F.col("ids")[0]))
    size = sample if sample is not None else max(20_000, 4 * math.isqrt(classes.count()))
    fitted = spread_sample(classes, "id", size).select("id", "v").repartition(1).mapInPandas(_fit(branch, leaf), "tree binary").first()
    import pickle

    tree = pickle.loads(fitted.tree)
    shared = spark.sparkContext.broadcast(tree)
    members = keep(classes.mapInArrow(_assign(shared), f"v {kind}, ids array<long>, id long, leaf long"))
    queries = keep(rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")))
    n_queries = queries.count()
    if not n_queries:
        return none

    stated = _collected(spread_sample(queries, "id", calibrate))
    truth = members.select("v", "ids", "leaf").mapInArrow(_scan(spark.sparkContext.broadcast(stated), k), f"{_FOUND}, leaf long")
    leaves = _leaves_needed(tree, stated, _top(truth, k).select("q", "leaf").collect(), recall)  # k rows a stated query
    visited = queries.repartition(max(1, n_queries // 64)).mapInArrow(_visits(shared, leaves), "q long, leaf long")
    blocks = _blocks(members)
    if n_queries * 8 * (length["n"] + leaves) <= (QUERY_BYTES if query_bytes is None else query_bytes):
        q, x = _collected(queries)
        seen = visited.toArrow()
        row, own = np.argsort(q)[np.searchsorted(np.sort(q), seen.column(0).to_numpy())], seen.column(1).to_numpy()
        begin = np.searchsorted(np.sort(own), np.arange(len(tree.centre) + 1))
        asked = spark.sparkContext.broadcast((q, x, begin, row[np.argsort(own, kind="stable")]))
        found = blocks.select("leaf", "members").mapInArrow(_search_blocks(asked, k), _FOUND)
    else:
        found = _joined(queries, keep(visited), keep(blocks), k)
    return _top(found, k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
