"""Word-based operators on small fixtures, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import near_dup as nd
from panelspark.llm import shared
from panelspark.llm.decontaminate import find_contamination, lcs_length
from panelspark.llm.line_dedup import Lines, dedup_lines
from panelspark.llm.packing import WordIds, cutting_stock, pack
from panelspark.llm.ppm import Low, score_texts
from panelspark.llm.quality import quality_scores
from panelspark.llm.shared import in_fold
from panelspark.llm.textblock import Words, encoded, shingle_sets

SCHEMA = "doc_id long, text string"
ODD = [(901, None), (902, ""), (903, " \n\t "), (904, "one"), (905, "é" * 5000), (906, "x" * 70_000), (907, "w " * 30_000), (908, "\x00 \x0b\x1c z")]


def words_of(text):
    return (text or "").encode().lower().split()


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 120)))) for i in range(n)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles():
    texts = ["Ab c\td e AB", "", None, "long" * 9 + " q", "C"]
    w = Words(encoded(texts))
    for i, t in enumerate(texts):
        assert [w.word(k) for k in range(w.ptr[i], w.ptr[i + 1])] == words_of(t)
    assert w.hashes[0] == w.hashes[3]
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    for t, s in zip(texts, shingle_sets(Words(encoded(texts)), 3)):
        x = words_of(t)
        assert len(s) == len({tuple(x[i : i + 3]) for i in range(len(x) - 2)} if len(x) >= 3 else {tuple(x)} if x else set())


def brute_components(rows, n, percent):
    sets = {i: ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()) for i, w in ((i, words_of(t)) for i, t in rows)}
    up = {i: i for i in sets}
    def find(x):
        return x if up[x] == x else find(up[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng, rows = random.Random(5), corpus(2)
    long = " ".join(f"u{rng.randint(0, 900)}" for _ in range(900))
    for k, (_, text) in enumerate(rows[:20] + [(0, long)] * 3):
        for m in range(rng.randint(1, 6)):
            w = text.split()
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((1000 + 10 * k + m, " ".join(w)))
    base = [f"b{i}" for i in range(60)]
    rows += [(3000 + i, " ".join(base[: 30 + i % 30])) for i in range(60)]  # a chain of borderline pairs
    rows += [(4000 + i, rows[0][1].upper()) for i in range(5)] + ODD
    want = brute_components(rows, 4, 80)
    for members in (2048, 8):  # whole buckets, and buckets dealt in blocks
        monkeypatch.setattr(nd, "BLOCK_MEMBERS", members)
        monkeypatch.setattr(nd, "LEAD_MEMBERS", members // 2)
        monkeypatch.setattr(shared, "BROADCAST_ROWS", members - 8)  # lists broadcast, and lists joined
        got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash")), words=4).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert nd.near_duplicates(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)], SCHEMA)
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in nd.near_duplicates(twice).collect()) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    ids = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f")], SCHEMA)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in nd.near_duplicates(ids).collect()) == [(-1, 2, -1, True)] * 2 + [(5, 2, 5, True), (7, 2, 5, False)]
    other = spark.createDataFrame([(5, "z z z z z y y"), (5, "a b c d e f"), (2, "a b c d e f"), (9, "z z z z z y y")], SCHEMA)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(other).collect()) == [(2, 2, 2), (5, 2, 2), (5, 3, 2), (9, 3, 2)]


def test_repeated_ids_have_the_links_of_all_their_texts(spark):
    rng = random.Random(12)
    texts = [t for _, t in corpus(3, 30)]
    rows = [(rng.randint(0, 40), rng.choice(texts) + rng.choice(["", "", " tail"])) for _ in range(90)] + [(41, None), (41, ""), (41, texts[0])]
    by_row = brute_components(list(enumerate(t for _, t in rows)), 5, 80)
    up = {("id", i): ("id", i) for i, _ in rows} | {("c", c): ("c", c) for _, c in by_row.values()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, _) in enumerate(rows):
        up[find(("id", i))] = find(("c", by_row[k][1]))
    smallest = {}
    for i in sorted({i for i, _ in rows}):
        smallest.setdefault(find(("id", i)), i)
    want = Counter((i, by_row[k][0], smallest[find(("id", i))]) for k, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == want




def test_hyperminhash_estimate():
    rng = np.random.default_rng(0)
    universe = rng.integers(0, 2**63, 5000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        both = int(4000 * share)
        a, b = universe[:4000], np.concatenate([universe[:both], rng.integers(0, 2**63, 4000 - both).astype(np.uint64)])
        found = nd.estimate(np.array([(nd.registers(a) == nd.registers(b)).mean()]), np.array([4000]), np.array([4000]))[0]
        assert abs(found - both / (8000 - both)) < 0.12
    disjoint = nd.chance_matches(np.array([4000]), np.array([4000]))[0]
    assert 0 < disjoint < 0.01


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "u long, v long")
    got = {r.doc: r.comp for r in nd.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert nd.components(links.limit(0)).count() == 0


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def test_lines_and_their_digests():
    rng = random.Random(4)
    texts = ["\n".join("".join(rng.choice(" \tABabÄ\x1c") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 9))) for _ in range(200)] + ["", "\n\n", "x" * 5000 + "\n " + "X" * 5000, "q" * 4096]
    lines, keys, seen = Lines(encoded(texts)), [], {}
    for i, t in enumerate(texts):
        own = t.split("\n")
        assert lines.ptr[i + 1] - lines.ptr[i] == len(own)
        keys += map(line_key, own)
    assert lines.chars.tolist() == [len(k) for k in keys] and lines.words.tolist() == [len(words_of(k)) for k in keys]
    for k, a, b in zip(keys, lines.one.tolist(), lines.two.tolist()):
        assert seen.setdefault(k, (a, b)) == (a, b)
    assert len(set(seen.values())) == len(seen) and len({a for a, _ in seen.values()}) == len(seen)


def brute_lines(rows, least, chars, keep_first=False):
    held, first = Counter(), {}
    for i, t in rows:
        keys = [line_key(x) for x in (t or "").split("\n")]
        for k in set(keys):
            held[k] += 1
        for n, k in enumerate(keys):
            first[k] = min(first.get(k, (i, n)), (i, n))
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for n, x in enumerate(lines) for k in [line_key(x)] if not (len(k) >= chars and held[k] >= least) or keep_first and first[k] == (i, n)]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("bound", [1 << 20, 0])
@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup_against_brute_force(spark, bound, keep_first):
    rng = random.Random(3)
    lines = [f"Line {i}" for i in range(30)] + ["", "  ", "ÄB c", "same\r"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(50)] + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_lines", F.lit("clash"))
    got = dedup_lines(df, min_docs=8, keep_first=keep_first, max_broadcast=bound, max_bits=1 << 14)
    assert got.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"]
    assert {r.doc_id: (r.n_lines_, r.n_dropped, r.text) for r in got.collect()} == brute_lines(rows, 8, 1, keep_first)


def test_line_dedup_edges(spark):
    assert dedup_lines(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], SCHEMA)
    assert [r.text for r in dedup_lines(df, min_docs=3).collect()] == [""] * 3
    tiny = spark.createDataFrame([(i, f"k{i}\nshared") for i in range(300)], SCHEMA)
    assert {r.text for r in dedup_lines(tiny, min_docs=2, max_bits=1 << 9).collect()} == {f"k{i}" for i in range(300)}  # full filters cost work, not rows


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_long_lines_have_a_limit_of_their_own(spark, bound):
    passage, short = " ".join(f"w{i}" for i in range(55)), "a short line of words"
    rows = [(i, f"own {i}\n{short}\n" + (f"  {passage.upper()} " if i in (4, 2) else "") + f"\n{passage} {i}") for i in range(6)] + [(None, short)]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA), min_docs=8, keep_first=True, long_words=50, max_broadcast=bound).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {None: 0, **{i: int(i == 4) for i in range(6)}}
    assert next(r.text for r in got if r.doc_id == 4) == f"own 4\n{short}\n{passage} 4"


@pytest.mark.parametrize("passes, bound", [(1, 1 << 20), (1000, 1 << 20), (1000, 0)])
def test_filters_of_many_tasks_are_merged(spark, monkeypatch, passes, bound):
    from panelspark.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SLICE_BITS", 12)
    monkeypatch.setattr(line_dedup, "MAX_PASSES", 8 if passes == 1 else passes)
    rows = [(i, f"k{i}\nk{(i + 37) % 200}\nonly {i}") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    most = 64 * 20 if passes > 1 else 1 << 29
    got = dedup_lines(df, min_docs=2, max_bits=most, max_broadcast=bound).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == brute_lines(rows, 2, 1)
    size = line_dedup._Size(600)
    filters = line_dedup.twice_seen(df, "text", 1, size)
    assert size.slices > 4 and 195 <= filters.agg(F.sum("n")).first()[0] <= 215  # lines of one document hardly ever get in
    assert len(line_dedup._ranges(filters, most // 64)) == 1 if passes == 1 else len(line_dedup._ranges(filters, most // 64)) > 8
    monkeypatch.setattr(line_dedup, "PART", 5)  # a task's filters may come in parts
    again = line_dedup.twice_seen(df, "text", 1, size)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, filters.collect()))


@given(st.sets(st.integers(0, (1 << 14) - 1)), st.integers(14, 40))
def test_packed_places_come_back(values, bits):
    from panelspark.llm.line_dedup import packed, unpacked

    values = np.array(sorted(values), dtype=np.int64) << (bits - 14)
    data = packed(values, bits)
    assert unpacked(data, bits).tolist() == values.tolist()
    n = len(values)
    assert len(data) <= 6 + (n * (3 + max(bits - max(n - 1, 0).bit_length(), 0)) + 7) // 8 + 1


def test_lines_of_rows_without_ids_stay_apart(spark):
    """In the joined form a row's list holds the keys of its own text, whatever its id."""
    rows = [(None, f"a{i % 9}\nb{i}\nc{i % 3}") for i in range(60)] + [(7, f"a{i % 9}\nd{i}") for i in range(20)]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA), min_docs=4, max_broadcast=0).collect()
    assert sorted(r.text for r in got) == sorted([f"b{i}" for i in range(60)] + [f"d{i}" for i in range(20)])


def tokenizer_file():
    tok = pytest.importorskip("public_tokenizers")
    return tok.path("word_bpe_49k.json")


def test_word_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    path = tokenizer_file()
    own, whole = WordIds(path), Tokenizer.from_file(path)
    texts = [t or "" for _, t in ODD] + ["don't I'LL 's <|endoftext|>a<|startoftext|> ÀÉß×÷ naïve ΑΣ İ 漢字 🙂 1234 a1b2 --__ %%$$", "á ṩ"]
    ids, ends = own.block(encoded(texts))
    assert own.by_word
    for text, got in zip(texts, np.split(ids, ends[:-1])):
        assert whole.encode(text, add_special_tokens=False).ids == got.tolist()


@pytest.mark.parametrize("limit", [3, 400_000])
def test_remembered_words_do_not_change_ids(monkeypatch, limit):
    from panelspark.llm import packing

    monkeypatch.setattr(packing, "_CACHE_WORDS", limit)
    monkeypatch.setattr(packing, "_CACHE_PARTS", limit)
    own = WordIds(tokenizer_file())
    for _, text in corpus(9, 12) * 2:
        ids, _ = own.block(encoded([text, "", text.upper() + "!"]))
        assert ids.tolist() == own._whole(text) + own._whole(text.upper() + "!")


def test_other_tokenizers_get_whole_texts():
    tok = pytest.importorskip("public_tokenizers")
    import glob
    import os

    for path in glob.glob(os.path.join(os.path.dirname(tok.path("word_bpe_49k.json")), "*.json")):
        own = WordIds(path)
        texts = ["Two words, and\n\n a THIRD  1234.", "", "naïve 漢字"]
        ids, ends = own.block(encoded(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [own._whole(t) for t in texts]


def test_packing_covers_every_token(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file()
    rows = corpus(4, 120) + ODD + [(5, "a repeated id")]
    whole = Tokenizer.from_file(path)
    out = pack(spark.createDataFrame(rows, SCHEMA).withColumn("offset", F.lit("clash")), path, seq_len=256).collect()
    pieces = Counter()
    for i, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for s in range(0, len(ids), 256):
            pieces[i, s, min(256, len(ids) - s), zlib.crc32(ids[s : s + 256].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == pieces
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in out)
    assert len(sequences) <= math.ceil(total / 256 * 1.03) + 1 and set(sequences) == set(range(len(sequences)))
    assert pack(empty(spark), path).count() == 0


def test_cutting_stock():
    rng = np.random.default_rng(1)
    for high in (1, 30, 5000):
        demand = rng.integers(0, high + 1, 128)
        plan = cutting_stock(demand, 128)
        assert (sum((p * n for p, n in plan), np.zeros(128, np.int64)) == demand).all()
        assert all((p * np.arange(1, 129)).sum() <= 128 and n > 0 for p, n in plan)
        bound = max((demand * np.arange(1, 129)).sum() / 128, demand[64:].sum())
        assert sum(n for _, n in plan) <= bound * 1.03 + 8
    assert cutting_stock(np.zeros(5, np.int64), 5) == []


def test_scores_against_definition(spark):
    rows = corpus(6, 80) + ODD
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, SCHEMA), ~in_fold(F.col("doc_id"), 7, 2), top_words=50).collect()}
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for _, t in train for w in words_of(t))
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    for i, t in rows:
        w, r = words_of(t), got[i]
        base = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((len(train) + 1) / (total + kinds + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in counts for x in w) + 1, total)
        assert r.base_score == pytest.approx(base) and r.score < 0 and math.isfinite(r.score)
    assert score_texts(empty(spark), F.lit(True)).count() == 0
    none = score_texts(spark.createDataFrame([(1, "ab")], SCHEMA), F.lit(False)).first()
    assert (none.n_known, none.train_tokens) == (0, 0) and none.score == pytest.approx(3 * math.log10(1 / 256))


def test_low_orders_are_a_distribution():
    rng = np.random.default_rng(2)
    code, n = np.unique(rng.integers(97, 101, 300) * 65536 + rng.integers(97, 101, 300) * 256 + rng.integers(97, 103, 300), return_counts=True)
    low = Low(code, n)
    for a, b in ((97, 98), (97, 200), (200, 97), (200, 201)):
        assert sum(10 ** low.log10(a << 16 | b << 8 | c, None) for c in range(256)) == pytest.approx(1)
        gone = {97, 98}
        assert sum(10 ** low.log10(a << 16 | b << 8 | c, gone) for c in range(256) if c not in gone) == pytest.approx(1)


def junk_corpus(n=240):
    rows, labels = corpus(8, n), []
    for k, (i, t) in enumerate(rows):
        bad = k % 3 == 0
        rows[k] = (i, " ".join(f"{w.upper()}!!" for w in t.split()) if bad else t.capitalize() + ".")
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_quality_on_held_out_labels(spark):
    rows, labels = junk_corpus()
    docs, held = spark.createDataFrame(rows + ODD, SCHEMA), in_fold(F.col("doc_id"), 3, 1)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in quality_scores(docs, marks, ~held, rank=8, neighbours=5, least_df=2).collect()}
    assert len(out) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in out.values())
    right = [(out[i] >= 0.5) == bool(q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(right) / len(right) > 0.95
    assert out[901] == out[902]
    nothing = quality_scores(docs, marks.limit(0), F.lit(True)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert quality_scores(empty(spark), marks, F.lit(True)).count() == 0


def test_votes_against_brute_force():
    from panelspark.llm.quality import votes

    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((60, 5))
    vectors[20:30] = vectors[3]  # copies tie
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels, x = (rng.random(60) < 0.6).astype(np.float32), rng.standard_normal((40, 5))
    x[7], x[8] = 0.0, vectors[3] * 4
    got = votes(x, vectors, labels, 6, 4.0)
    for row, v in zip(x, got):
        norm = math.sqrt(sum(a * a for a in row))
        cosine = [round(float(row @ w) / norm, 5) if norm else 0.0 for w in vectors]
        least = sorted(cosine)[-6]
        held = [(max(c, 0.0) ** 4, y) for c, y in zip(cosine, labels) if c >= least]
        want = sum(w * y for w, y in held) / sum(w for w, _ in held) if norm and sum(w for w, _ in held) else float("nan")
        assert v == pytest.approx(want, abs=1e-3, nan_ok=True)
    order = rng.permutation(60)
    assert votes(x, vectors[order], labels[order], 6, 4.0) == pytest.approx(got, nan_ok=True)


def test_words_that_tell_the_label(spark):
    """Shapes alike, one word tells: held-out texts go with it."""
    rows, labels = corpus(12, 300), []
    for k, (i, t) in enumerate(rows):
        bad = k % 4 == 0
        w = t.split()
        rows[k] = (i, " ".join(w[:3] + ["gfadbe" if bad else "cbbhaf"] + w[3:]))
        labels.append((i, int(not bad), 0))
    held = in_fold(F.col("doc_id"), 3, 1)
    out = {r.doc_id: r.score for r in quality_scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ~held, rank=16, neighbours=5).collect()}
    right = [(out[i] >= 0.5) == bool(q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(right) / len(right) > 0.95


def test_quality_keeps_other_columns(spark):
    rows, labels = junk_corpus(60)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    out = quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True), score_col="p", rank=4, least_df=2)
    assert out.columns == ["doc_id", "text", "score", "p"] and {r.score for r in out.collect()} == {"x"}


def test_contamination_against_alignment(spark):
    rng, rows = random.Random(7), corpus(10, 40)
    items = [(i, " ".join(f"q{i}w{rng.randint(0, 30)}" for _ in range(rng.randint(15, 60))) + ". final answer " + f"z{i} y{i}.") for i in range(12)]
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, items[0][1])], "item_id long, text string")
    planted = {}
    for k, (i, text) in enumerate(items):
        w, host = text.split(), rows[k][1].split()
        if k % 3 == 1:  # a paraphrase: every ninth word is another
            w = [x if j % 9 else "other" for j, x in enumerate(w)]
        at = rng.randrange(len(host))
        rows[k] = (rows[k][0], " ".join(host[:at] + w + host[at:]))
        planted[rows[k][0]] = {i} | ({52} if i == 0 else set())
    half = items[3][1].split()
    rows.append((700, " ".join(half[: len(half) // 3])))  # a third of an item is none
    out = find_contamination(spark.createDataFrame(rows + ODD, SCHEMA).withColumn("contaminated", F.lit(1)), bench)
    got = out.collect()
    assert {r.doc_id: set(r.item_ids) for r in got if r.item_ids} == planted
    assert all(r.contaminated_ == bool(r.item_ids) for r in got)
    sliced = find_contamination(spark.createDataFrame(rows, SCHEMA), bench, slice_items=5).collect()
    assert {r.doc_id: set(r.item_ids) for r in sliced if r.item_ids} == planted
    assert find_contamination(empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in find_contamination(spark.createDataFrame(rows, SCHEMA), bench.limit(0)).collect())


def test_many_items_of_all_lengths_are_found(spark):
    """Thousands of items over one vocabulary, each planted once, whole or with words replaced; against alignment with every item."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(1500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([6, 9, 14, 22, 40, 70, 130])))) for i in range(2000)]
    rows, planted = [], {}
    for k in range(80):
        host = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        i = rng.randrange(2000)
        w = [x if rng.random() > (0.1 if k % 2 else 0) else "else" for x in items[i][1].split()]
        at = rng.randrange(len(host))
        rows.append((k, " ".join(host[:at] + w + host[at:])))
        planted[k] = i
    rows += [(100 + k, " ".join(rng.choice(vocabulary) for _ in range(200))) for k in range(20)]
    got = {r.doc_id: set(r.item_ids) for r in find_contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    texts = dict(rows)

    def held(i, t):  # an item is held if a stretch of four times its length holds 0.8 of it in order
        w, x = (np.array([hash(v) for v in y.split()]) for y in (items[i][1], t))
        return any(lcs_length(w, x[a : a + 4 * len(w)]) >= 0.8 * len(w) for a in range(0, max(1, len(x) - len(w)), max(1, len(w) // 2)))

    sure = {k for k, i in planted.items() if held(i, texts[k])}
    assert len(sure) > 70 and all(planted[k] in got[k] for k in sure)
    for k, found in got.items():
        assert all(held(i, texts[k]) or len(items[i][1].split()) < 12 for i in found)


def test_lcs():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert lcs_length(np.array(a), np.array(b)) == row[-1]


def test_digest_of_an_emptied_document():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def brute_ppm(train, text, depth):
    """log10 of a text's probability by method D with full exclusion, straight from the definition."""
    counts = {}
    for t in train:
        raw = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(raw)):
            for k in range(depth + 1):
                counts.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
    raw, total = b"\xff" * depth + text + b"\xff", 0.0
    for i in range(depth, len(raw)):
        gone, p = set(), 1.0
        for k in range(depth, -1, -1):
            node = counts.get(raw[i - k : i], {})
            left = {s: n for s, n in node.items() if s not in gone}
            size = sum(left.values())
            if raw[i] in left:
                p *= (left[raw[i]] - 0.5) / size
                break
            p *= len(left) / 2 / size if size else 1.0
            gone |= set(node)
        else:
            p /= 256 - len(gone)
        total += math.log10(p)
    return total


@pytest.mark.parametrize("top", [1 << 21, 60])
def test_deep_contexts_against_definition(spark, top):
    rows = corpus(6, 40) + [(400, "the longer repeat"), (401, "zq"), (402, None), (403, "é the longer repeal")]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, SCHEMA), ~in_fold(F.col("doc_id"), 3, 1), top_strings=top).collect()}
    train = [(t or "").encode() for i, t in rows if not held(i)]
    assert any(held(i) for i, _ in rows)
    for i, t in rows:
        assert got[i] == pytest.approx(brute_ppm(train, (t or "").encode(), 5), rel=1e-4)
