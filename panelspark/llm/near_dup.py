"""Near-duplicate documents by HyperMinHash, exact in what it confirms.

A document is the set of its distinct n-word shingles (64-bit hashes of word hashes); documents are linked if
100 * intersection >= percent * union.

1. One pass gives each document its set size, a 128-bit fingerprint of the set, and ``REGISTERS`` HyperMinHash
   registers: each bucket has a hash permutation of its own and stores its minimum as a leading-zero count and
   ``MANTISSA`` mantissa bits (16 bits in all).  Equal sets collapse to one representative; the list of sets held twice
   or more is broadcast where a count shows it to be short.
2. ``BANDS`` bands of ``ROWS`` registers give bucket keys (a pair with similarity 0.8 shares none with probability
   3e-6).  No bucket is expanded into pairs: every member is held against two leaders of its bucket, first by the
   collision-corrected estimate, then exactly; confirmed links are closed to components.
3. Buckets that still hold several components are dealt in blocks of bounded size; members outside the leader's
   component are held against the members of other components, again by estimate and then exactly, so no link
   found by banding is lost.  A pair is looked at in the first band that it shares only.

Only members of buckets of two or more are looked at again: those of up to ``SMALL`` shingles then carry their set
itself and are confirmed in place; larger ones carry their registers and are confirmed on sets recomputed from their
whole texts, in groups of bounded size.  Lists of buckets and members are broadcast if a count shows them to be
short, and joined by shuffling otherwise.  Two kinds of link can be missed: pairs that share no band (see 2), and pairs whose
estimate is over 4.5 standard errors too low (3e-6 of the pairs at the threshold).

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text of fewer than n
words is one shingle, its whole word sequence; rows that repeat a doc_id are one document with the links of all their
texts, and each row has its own set size; a row without a doc_id is linked with nothing, its component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, small
from .textblock import Words, blocks, mix, shingle_sets, utf8

BANDS, ROWS, REGISTERS, MANTISSA, SMALL = 24, 4, 256, 10, 256
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 400_000
#: Members of a bucket that are held against its lead in one group.
LEAD_MEMBERS = 4096
#: Bytes of text worked on at once.
TEXT_BLOCK = 2 << 20
_A = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)[:, None]


def registers(shingles: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """The HyperMinHash registers of a set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    low = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (_A[:count] * x[None, i : i + 512]).min(axis=1), out=low)
    fraction, exponent = np.frexp(low.astype(np.float64) + 0.5)
    return ((32 - exponent).astype(np.uint16) << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Bucket keys of register rows, one column per band."""
    packed = np.ascontiguousarray(regs[:, : BANDS * ROWS]).view("<u8")
    return mix(packed ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers in which disjoint sets of these sizes agree because registers are compressed."""
    a = 2.0 ** -np.arange(1, 33)
    n, m = np.asarray(n, float)[..., None], np.asarray(m, float)[..., None]
    mass = np.exp(-(n + m) * a) - np.exp(-2 * (n + m) * a)
    return (n * m / np.maximum(n + m, 1) * mass * a / (1 << MANTISSA)).sum(axis=-1)


def estimate(matches: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance matches."""
    chance = chance_matches(n, m)
    return (matches - chance) / (1 - chance)


def _least(percent: int) -> float:
    """Pairs whose estimate is below this are over 4.5 standard errors away from the threshold."""
    j = percent / 100
    return j - 4.5 * (j * (1 - j) / REGISTERS) ** 0.5


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(words: int):
    """Set size, fingerprint and bucket keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            size, one, two, keys = [], [], [], []
            for a, b in blocks(texts, map(len, texts), TEXT_BLOCK):
                for s in shingle_sets(Words(texts[a:b]), words):
                    size.append(len(s))
                    one.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0)
                    two.append(int(mix(s).sum().view(np.int64)) if len(s) else 0)
                    keys.append(band_keys(registers(s, BANDS * ROWS)[None, :])[0].view(np.int64) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                ["doc", "n", "fp1", "fp2", "keys"],
            )

    return run


def _contents(words: int):
    """Set size and body of each text: its set where that is small, else its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            size, body = [], []
            for a, b in blocks(texts, map(len, texts), TEXT_BLOCK):
                for s in shingle_sets(Words(texts[a:b]), words):
                    size.append(len(s))
                    body.append(registers(s).tobytes() if len(s) > SMALL else s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(body, pa.binary())], ["doc", "n", "body"])

    return run


class _Bodies:
    """Rows with sets or registers, as the first pass wrote them."""

    def __init__(self, n: list[int], bodies: list[bytes]):
        self.n = np.array(n, dtype=np.int64)
        self.sets = [np.frombuffer(b, dtype=np.uint64) if k <= SMALL else None for k, b in zip(n, bodies)]
        self.regs = np.zeros((len(n), REGISTERS), dtype=np.uint16)
        for i, (s, b) in enumerate(zip(self.sets, bodies)):
            self.regs[i] = np.frombuffer(b, dtype=np.uint16) if s is None else registers(s)


def _near(n: np.ndarray, m: np.ndarray, matches: np.ndarray, percent: int) -> np.ndarray:
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    fits[fits] = estimate(matches[fits], n[fits], m[fits]) >= _least(percent)
    return fits


def _judge_star(percent: int):
    """Rows (doc, lead, both bodies): 'linked' for pairs confirmed here, 'open' for those that need whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, lead, n, body, m, other = (batch.column(i).to_pylist() for i in range(6))
            out: list[tuple] = []
            size, size2 = np.array(n, dtype=np.int64), np.array(m, dtype=np.int64)
            fits = np.flatnonzero(100 * np.minimum(size, size2) >= percent * np.maximum(size, size2)) if n else []
            for i in fits:
                if n[i] <= SMALL and m[i] <= SMALL:
                    if _linked(np.frombuffer(body[i], np.uint64), np.frombuffer(other[i], np.uint64), percent):
                        out.append((doc[i], lead[i], n[i], True))
                else:
                    pair = _Bodies([n[i], m[i]], [body[i], other[i]])
                    matches = np.array([(pair.regs[0] == pair.regs[1]).mean()])
                    if _near(size[i : i + 1], size2[i : i + 1], matches, percent)[0]:
                        out.append((doc[i], lead[i], n[i], False))
            yield _table(out, [("doc", pa.int64()), ("lead", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_())])

    return run


def _table(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [f for f, _ in fields])


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _bounded(pairs: list[tuple], size: dict[int, int]) -> Iterator[list[tuple]]:
    """The pairs in groups whose texts have about ``BLOCK_SHINGLES`` shingles together."""
    held, docs = [], set()
    for p in pairs:
        if held and sum(size[d] for d in docs | set(p)) > BLOCK_SHINGLES:
            yield held
            held, docs = [], set()
        held.append(p)
        docs |= set(p)
    if held:
        yield held


def _judge_blocks(percent: int):
    """Rows (key, a, b, members): links confirmed here, and pairs that need whole texts as two parallel lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, a, b, members in zip(*(batch.column(i).to_pylist() for i in range(4))):
                bodies = _Bodies([x["n"] for x in members], [x["body"] for x in members])
                docs, left = np.array([x["doc"] for x in members]), np.array([x["left"] for x in members])
                comps = np.array([x["comp"] for x in members])
                keys, mark = band_keys(bodies.regs), np.uint64(key & 0xFFFFFFFFFFFFFFFF)
                known, linked, unsure = _Union(), [], []
                for y in np.flatnonzero(left):
                    if docs[y] in (a, b):
                        continue
                    others = np.flatnonzero((comps != comps[y]) & (~left | (docs < docs[y])) & (docs != a) & (docs != b))
                    if not len(others):
                        continue
                    near = _near(bodies.n[others], np.full(len(others), bodies.n[y]), (bodies.regs[others] == bodies.regs[y]).mean(axis=1), percent)
                    others = others[near]
                    equal = keys[others] == keys[y]
                    others = others[keys[y][equal.argmax(axis=1)] == mark] if len(others) else others
                    for x in others:
                        if known.find(int(comps[x])) == known.find(int(comps[y])):
                            continue
                        if bodies.sets[x] is None or bodies.sets[y] is None:
                            unsure.append((int(docs[y]), int(docs[x])))
                        elif _linked(bodies.sets[x], bodies.sets[y], percent):
                            known.join(int(comps[x]), int(comps[y]))
                            linked.append((int(docs[y]), int(docs[x])))
                if linked:
                    out.append((key, [p[0] for p in linked], [p[1] for p in linked], True))
                size = dict(zip(docs.tolist(), bodies.n.tolist()))
                for pairs in _bounded(unsure, size):
                    out.append((key, [p[0] for p in pairs], [p[1] for p in pairs], False))
            yield _table(out, [("key", pa.int64()), ("us", pa.list_(pa.int64())), ("vs", pa.list_(pa.int64())), ("linked", pa.bool_())])

    return run


def _confirm(words: int, percent: int):
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        docs, first = np.unique(texts.column("doc").to_numpy(), return_index=True)
        raw = utf8(texts.column("text").take(pa.array(first)).combine_chunks())
        sets: dict[int, np.ndarray] = {}
        for a, b in blocks(raw, map(len, raw), TEXT_BLOCK):
            sets |= dict(zip(docs[a:b].tolist(), shingle_sets(Words(raw[a:b]), words)))
        known, out = _Union(), []
        for us, vs in zip(pairs.column("us").to_pylist(), pairs.column("vs").to_pylist()):
            for u, v in zip(us, vs):
                if u in sets and v in sets and known.find(u) != known.find(v) and _linked(sets[u], sets[v], percent):
                    known.join(u, v)
                    out.append((u, v))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return run


def _confirmed(jobs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among ``jobs`` (gid, us, vs), confirmed on sets made from whole texts."""
    members = jobs.select(F.col("gid").alias("job"), F.explode(F.array_union("us", "vs")).alias("doc"))
    held = texts.join(small(members), "doc").select("job", "doc", "text")
    return jobs.groupBy("gid").cogroup(held.groupBy("job")).applyInArrow(_confirm(words, percent), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(doc, comp): every linked node but the roots, with the smallest node of its component.

    Alternating large-star and small-star steps; each is one aggregation and one join, without groups in memory."""
    edges = keep(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = keep(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))


def _classes(texts: DataFrame, sigs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc, n, comp) of texts with ids of their own and their signatures."""
    copies = sigs.filter("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("held"))
    copies = small(keep(copies.filter("held > 1").drop("held")))  # sets of one row only stand for themselves
    sets = sigs.join(copies, ["fp1", "fp2", "n"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc")))
    heads = sets.filter("rep = doc").select("doc", "keys")
    rows = heads.select(F.explode("keys").alias("key"), "doc")
    buckets = keep(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("doc").alias("a"), F.min_by("doc", F.xxhash64("doc")).alias("b")).filter("size > 1").drop("size"))
    members = keep(rows.join(small(buckets), "key"))
    candidates = texts.join(small(keep(members.select("doc").distinct())), "doc", "left_semi")
    bodies = keep(candidates.mapInArrow(_contents(words), "doc long, n long, body binary"))

    star = members.select("doc", F.col("a").alias("lead")).union(members.select("doc", F.col("b").alias("lead"))).filter("doc <> lead").distinct()
    # the members of a large bucket share a lead: they are dealt to parts, and each part gets the lead's body
    parts = small(keep(star.groupBy("lead").agg(F.ceil(F.count("*") / LEAD_MEMBERS).cast("int").alias("np"))))
    star = star.join(parts, "lead").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("np")).cast("int")).drop("np")
    leads = bodies.withColumnRenamed("doc", "lead").join(parts, "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("part"), F.col("n").alias("m"), F.col("body").alias("other"))
    judged = star.join(bodies, "doc").join(leads, ["lead", "part"]).select("doc", "lead", "n", "body", "m", "other")
    judged = keep(judged.mapInArrow(_judge_star(percent), "doc long, lead long, n long, linked boolean"))
    unsure = judged.filter("not linked")
    sizes = unsure.groupBy("lead").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("nb"))
    jobs = unsure.join(sizes, "lead").groupBy("lead", F.pmod(F.xxhash64("doc"), F.col("nb")).alias("blk")).agg(F.collect_list("doc").alias("us"))
    jobs = keep(jobs.select(F.xxhash64("lead", "blk").alias("gid"), "us", F.expr("array_repeat(lead, size(us))").alias("vs")))
    links = judged.filter("linked").select(F.col("doc").alias("u"), F.col("lead").alias("v"))
    links = keep(links.union(_confirmed(jobs, texts, words, percent)))
    comps = components(links)

    labelled = members.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("doc") == F.col("a"), F.col("comp"))).alias("main"), F.count("*").alias("total"))
    mixed = mixed.filter("lo <> hi and total > 2")
    inside = labelled.join(mixed.select("key", "main", "total"), "key").withColumn("left", F.col("comp") != F.col("main"))
    lefts = inside.filter("left").groupBy("key").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("nl"))
    inside = inside.join(lefts, "key").withColumn("na", F.ceil(F.col("total") / BLOCK_MEMBERS).cast("int"))
    h = F.xxhash64("doc")
    all_rows = inside.withColumn("li", F.explode(F.sequence(F.lit(0), F.col("nl") - 1))).withColumn("j", F.pmod(h, F.col("na")).cast("int")).withColumn("left", F.col("left") & (F.col("na") == 1))
    left_rows = inside.filter("left and na > 1").withColumn("li", F.pmod(F.xxhash64("doc", F.lit(7)), F.col("nl")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    columns = ["key", "a", "b", "li", "j", "doc", "comp", "left"]
    packed = all_rows.select(columns).union(left_rows.select(columns)).join(bodies, "doc")
    packed = packed.groupBy("key", "a", "b", "li", "j").agg(F.collect_list(F.struct("doc", "comp", "left", "n", "body")).alias("members"))
    found = keep(packed.select("key", "a", "b", "members").mapInArrow(_judge_blocks(percent), "key long, us array<long>, vs array<long>, linked boolean"))
    if not found.isEmpty():
        late = found.filter("linked").select(F.explode(F.arrays_zip("us", "vs")).alias("p")).select(F.col("p.us").alias("u"), F.col("p.vs").alias("v"))
        open_jobs = found.filter("not linked").select(F.xxhash64("key", "us", "vs").alias("gid"), "us", "vs")
        comps = components(links.union(late).union(_confirmed(open_jobs, texts, words, percent)))

    out = sets.select("doc", "n", "rep").join(small(keep(comps.withColumnRenamed("doc", "rep"))), "rep", "left")
    return out.select("doc", "n", F.coalesce("comp", "rep", "doc").alias("comp"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """A row per document row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest doc_id reachable by links)
    and ``kept`` (whether the document is its component's smallest).

    Rows that repeat a doc_id are one document that has the links of all their texts.  Rows without a doc_id are linked
    with nothing: ``component_id`` null, ``kept`` true."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    signed = lambda rows: keep(rows.mapInArrow(_signatures(words), "doc long, n long, fp1 long, fp2 long, keys array<long>"))
    sigs = signed(texts)
    texts, own = texts.filter("doc is not null"), sigs.filter("doc is not null")
    if own.groupBy("doc").count().filter("count > 1").isEmpty():
        out = _classes(texts, own, words, percent)
    else:
        rows = keep(texts.withColumn("row", F.monotonically_increasing_id()))
        texts = rows.select(F.col("row").alias("doc"), "text")
        found = keep(_classes(texts, signed(texts), words, percent).withColumnRenamed("doc", "row").join(rows.select("row", "doc"), "row"))
        heads = found.groupBy("comp").agg(F.min("doc").alias("head"), F.count("*").alias("held")).filter("held > 1").drop("held")
        ids = found.join(small(keep(heads)), "comp").select(F.col("doc").alias("u"), F.col("head").alias("v")).filter("u <> v").distinct()
        comps = components(keep(ids))
        out = found.select("doc", "n").join(small(keep(comps.withColumnRenamed("doc", "of"))), F.col("doc") == F.col("of"), "left").select("doc", "n", F.coalesce("comp", "doc").alias("comp"))
    out = out.unionByName(sigs.filter("doc is null").select("doc", "n", F.lit(None).cast("long").alias("comp")))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc") == F.col("comp"), F.lit(True)).alias("kept"))
