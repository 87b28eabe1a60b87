"""Spelling variants, vector codes and url filters against brute force, with odd rows of every kind."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelspark.llm.integer_codes import assign, code_vectors, sequency_rows, transformed
from panelspark.llm.spelling import near_words, spelling_groups
from panelspark.llm.url_filter import judge_urls


def edits_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def runs_of(text):
    out, run = [], ""
    for ch in (text or "") + " ":
        if "a" <= ch <= "z" or "A" <= ch <= "Z" or "À" <= ch <= "ÿ":
            run += ch.lower() if ch < "\u0080" else ch
        elif run:
            out.append(run)
            run = ""
    return out


def groups(rows, every=97, ratio=2):
    n = Counter()
    for doc_id, text in rows:
        for run in runs_of(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [o for o in n if edits_one(w, o)] for w in n}
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda o: (-n[o], o))] >= ratio * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_spelling_groups(spark):
    rng = random.Random(5)
    letters = "abcdeÉéß÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(60)]
    words = []
    for w in base:
        times = rng.choice([3, 6, 20, 60])
        words += [w] * times
        for _ in range(4):  # chains of variants, anagrams among them
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], "".join(rng.sample(w, len(w)))])
            times = max(3, times // 2)
            words += [w] * times
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40]).replace("a", rng.choice("aA"))) for i in range(len(words) // 40 + 1)]
    rows += [(900, None), (901, ""), (None, "aaaaab aaaaab aaaaab"), (902, "x" * 3000 + " " + "x" * 3000), (902, "x" * 3000), (903, "12 ; ××××× " * 3), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    got = [tuple(r) for r in spelling_groups(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == groups(rows) and sum(r[1] is not None for r in got) > 20
    assert any(r[2] not in (r[0], r[1]) for r in got)  # chains
    every = [tuple(r) for r in spelling_groups(docs, every=None, ratio=3).collect()]
    assert set(every) == groups(rows, None, 3)
    assert spelling_groups(docs.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"] and spelling_groups(docs.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        spelling_groups(docs, ratio=1)


def test_near_words_lose_no_pair(spark):
    """All words of three letters over few of them: every pair at distance one, and no other."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 6))) for _ in range(1500)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = Counter((r.word, r.other) for r in near_words(df).collect())
    want = {(a, b) for a in words for b in words if edits_one(a, b)}
    assert set(got) == want and max(got.values()) == 1


def codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    size = -(-len(kept[0][2]) // parts)
    cut = [[(r[2] + [0] * size)[p * size : (p + 1) * size] for p in range(parts)] for r in kept]
    start = [c for c, r in zip(cut, kept) if r[0] is not None][:entries]
    books = [[list(c[p]) for c in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, y), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[near(c[p], books[p])[1]].append(c[p])
            for e, own in held.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    last = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in own) for own in last]
    by = defaultdict(int)
    for r, e in zip(kept, error):
        by[r[1]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for y in b for v in y).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{e:02x}" for _, e in own), e, by[r[1]], sha) for r, own, e in zip(kept, last, error))


@pytest.mark.parametrize("width, entries", [(8, 16), (12, 256), (6, 5)])
def test_vector_codes(spark, width, entries):
    rng = random.Random(width)
    rows = [(i * 3, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(7, None, 1), (8, [], 1), (9, [None] * width, 1), (10, [math.nan] * width, 2), (11, [math.inf] + [0.0] * (width - 1), 2), (12, [1.0], 1)]
    rows += [rows[0], (3, rows[5][1], 2), (None, rows[7][1], None)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string")
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in code_vectors(df, entries=entries).collect())
    assert got == codes(rows, entries=entries)
    assert code_vectors(df.limit(0)).isEmpty() and code_vectors(df.filter("vec_id in (7, 8)")).isEmpty() and code_vectors(df.filter("vec_id is null")).isEmpty()


def test_vector_codes_of_huge_components(spark):
    rows = [(i, [10.0 ** (i % 30), -(3.0**i), 0.1 * i, 1e300 if i == 8 else 2.0], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = [(i, c, e if e < 2**63 else None, s) for i, c, e, _, s in codes(rows, entries=4)]
    got = code_vectors(df, entries=4).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.codebooks_sha256) for r in got) == want
    with pytest.raises(ValueError):
        code_vectors(df, entries=257)


def test_elimination_is_exact():
    rng = np.random.default_rng(3)
    for width in (1, 3, 16, 20):
        x, c = rng.integers(-50, 50, (300, width)), rng.integers(-50, 50, (40, width))
        c[7] = c[3]
        x[:40] = c
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        index, far = assign(x, c)
        assert (index == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    h = transformed(np.eye(8, dtype=np.int64)).T
    assert sorted(sequency_rows(8).tolist()) == list(range(8)) and [(r[1:] != r[:-1]).sum() for r in h] == list(range(8))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr", "block"), ("org", "", "block"), ("a.org", "/x/y", "allow"), ("a.org", "/x/y", "block"), (None, "/", "block"), ("com", "/", "allow")]


def judged(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h.lower() + p, v) for h, p, v in RULES if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_url_filters(spark, broadcast_rows):
    rng = random.Random(2)
    hosts = ["com", "example.com", "www.example.com", "m.www.EXAMPLE.com", "wwwexample.com", "xexample.com", "a.net", "net", "orgx", "a.org", "b.a.org", "A.ORG:80", "u@a.org", ".com", "com.", "", "É.com", "." * 50 + "com"]
    paths = ["", "/", "/en/", "/en/7", "/en", "/es/1", "/fr", "/french", "/x/y", "/x/yz/1", "/x/", "//", "/" + "a/" * 2000, "/en/?q=/fr/", "?q=://b.com/", "#://x"]
    urls = [f"{rng.choice(['http', 'HTTP', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no url", "http:/x.com/", "a\nb://com/en/\nx", "://", "x" * 100_000 + "://net/es/"]
    rows = [(i, u, "own", 7) for i, u in enumerate(urls)] + [(0, urls[0], "own", 7), (None, urls[1], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, `Rule` string, row int")
    rules = spark.createDataFrame([(*r, "more") for r in RULES], "host string, path string, verdict string, key string")
    out = judge_urls(pages, rules, broadcast_rows=broadcast_rows)
    assert out.columns == ["page_id", "url", "row", "host", "path", "rule", "verdict"]
    got = sorted(map(repr, (tuple(r) for r in out.collect())))
    assert got == sorted(repr((i, u, k, *judged(u))) for i, u, _, k in rows)
    assert judge_urls(pages.limit(0), rules).isEmpty()
    assert {tuple(r) for r in judge_urls(pages, rules.limit(0), default="block").select("rule", "verdict").distinct().collect()} == {(None, "block")}


def test_url_filters_run_without_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = judge_urls(pages.select("page_id", "url"), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
