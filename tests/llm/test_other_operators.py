"""Personal data, vectors, archives and pages on small fixtures, against brute force; the registry and the pipeline."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import queries as Q
from panelspark.llm.html_text import Wrapper, extract_text, induce, main_text, matching, named, parse
from panelspark.llm.pii import find_pii, joined
from panelspark.llm.vectors import Tree, nearest
from panelspark.llm.warc import archive_name, read_warc, write_warc

#: The base patterns, as stated.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


TEXTS = [
    "a@b.c+x@d.e é1.2.3.4.5.6.7.8 x@y z@@q.r a..@-.-", "1.2.3.4567 001.002.003.255 256.1.1.1 4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 411111111111111111111",
    "+1 (017) 555-7713 +1 5 +49.12345678) +123456789012345678 +1+1234567890", "9" * 20_000 + "@" + "a" * 20_000, "a" * 40_000, "1 2 " * 9000,
    "🙂 me@x.io 4111111111111111+14155550100\n a@b.co", "x.y@z.w@q.r 1.1.1.1.1 0.0.0.0", None, "", "plain text",
    "+1234567890@a.com 10.0.0.1@x.org 4111111111111111@ex.com 0000000000000000.1.1.1",  # kinds that start together
]


def test_pii_spans_against_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "a@b.cd"), (3, "twice a@b.cd")], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = find_pii(df).select("doc_id", joined(F.col("base")).alias("b"), "clean").collect()
    assert len(out) == len(TEXTS) + 2
    want = Counter([(i, base_spans(t)) for i, t in enumerate(TEXTS)] + [(None, base_spans("a@b.cd")), (3, base_spans("twice a@b.cd"))])
    assert Counter((r.doc_id, r.b) for r in out) == want
    assert "[EMAIL]" in next(r.clean for r in out if r.doc_id is None)
    assert find_pii(df.limit(0)).count() == 0


def test_pii_terms_by_information(spark):
    rows = [(i, f"w{i} Zorba me@secret.org v{i}\nother zorba the {i}") for i in range(4)] + [(10 + i, f"the common words {i} of others") for i in range(60)] + [(90, "copy rare a@b.cd"), (91, "copy rare a@b.cd"), (92, "copy rare a@b.cd")]
    out = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):  # the word in the entity's line goes; elsewhere, and copies of one text, prove nothing
        assert [(s["kind"], s["start"], s["end"]) for s in out[i].spans] == [("term", 3, 8), ("email", 9, 22)]
        assert out[i].clean == f"w{i} [TERM] [EMAIL] v{i}\nother zorba the {i}"
    assert [s["kind"] for s in out[90].spans] == ["email"] and not out[10].spans
    forced = {r.doc_id: joined_py(r.spans) for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), max_broadcast=0).collect()}
    assert forced == {i: joined_py(r.spans) for i, r in out.items()}


def test_pii_terms_of_rarely_held_values(spark):
    kinds = [lambda i: f"name{i}@secret.org", lambda i: f"10.7.{i}.1"]  # each value stands in one text only
    rows = [(10 * k + i, f"w{k}x{i} Zorba{k} {value(i)}\nother zorba{k} the {i}") for k, value in enumerate(kinds) for i in range(6)]
    rows += [(90 + i, "one Copied b0@other.net") for i in range(5)] + [(100 + i, f"the common words {i} of others") for i in range(60)]
    for bound in (100_000, 0):
        out = {r.doc_id: [s["kind"] for s in r.spans] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), max_broadcast=bound).collect()}
        assert all(out[i] == ["term", "email"] and out[10 + i] == ["term", "ip"] for i in range(6))
        assert all(out[90 + i] == ["email"] for i in range(5)) and not any(out[100 + i] for i in range(60))


def test_secrets_and_what_names_them(spark):
    rng = np.random.default_rng(3)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f'some words {i} here token = "{key()}" and more{i}') for i in range(5)]
    rows += [(10, "a/long/path-of-2024/05/with-many-words and Donaudampfschifffahrtsgesellschaft1 " + "7" * 30), (11, "aaaa1111aaaa1111aaaa1111"), (12, "me@" + key() + ".org")]
    rows += [(100 + i, f"some words of others {i} here and more") for i in range(60)]
    for bound in (100_000, 0):
        out = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), max_broadcast=bound).collect()}
        for i in range(5):
            assert [s["kind"] for s in out[i].spans] == ["term", "secret"] and out[i].clean == f'some words {i} here [TERM] = "[SECRET]" and more{i}' and out[i].base == []
        assert [s["kind"] for s in out[12].spans] == ["email"] and not any(out[i].spans for i in (10, 11, *range(100, 160)))


def brute_terms(rows, alpha=0.9, support=3):
    """Spans of kind term, straight from the definition; entities are e-mail addresses, with their domain and kind."""
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    held = {i: {m[0] for m in BASE["email"].finditer(t)} for i, t in rows}
    groups = lambda v: ["=" + v, "email:" + v.lower().split("@")[-1], "email"]
    pairs, copies, n_c, n_t = {}, {}, Counter(), Counter()
    for i, t in rows:
        for w in set(words(t)):
            n_t[w] += 1
        for g in {g for v in held[i] for g in groups(v)}:
            n_c[g] += 1
        for key in {(g, w) for v in held[i] for line in t.split("\n") if v in line for w in words(line.replace(v, " ")) if len(w) > 1 and not w.isdigit() for g in groups(v)}:
            pairs[key] = pairs.get(key, 0) + 1
            copies.setdefault(key, set()).add(t)
    telling = set()
    for (g, w), n in pairs.items():
        pmi = math.log2(len(rows) * n / (n_c[g] * (n_t[w] + (not g.startswith("=")))))
        if len(copies[g, w]) >= support and pmi > 0 and pmi >= alpha * math.log2(len(rows) / n_c[g]):
            telling.add((g, w))
    out = {}
    for i, t in rows:
        spans = []
        for m in re.finditer(r"\w+", t):
            line = t[: m.start()].split("\n")[-1] + t[m.start() :].split("\n")[0]
            clear = all(m.end() <= b.start() or b.end() <= m.start() for b in BASE["email"].finditer(t))
            if clear and any(v in line and (g, m[0].lower()) in telling and m[0].lower() in words(line.replace(v, " ")) for v in held[i] for g in groups(v)):
                spans.append((m.start(), m.end()))
        out[i] = spans
    return out


def test_pii_terms_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary, names = [f"word{'abcdefghij'[k % 10]}{'klmnopq'[k % 7]}x" for k in range(70)], ["alice", "bob", "carol"]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(rng.integers(1, 4)):
            line = list(rng.choice(vocabulary, rng.integers(2, 8)))
            if rng.random() < 0.2:
                who = int(rng.integers(0, 3))
                line += [names[who].title()] * int(rng.random() < 0.9) + [f"{'abc'[who]}{i % 5}@d{'xyz'[who]}.org"]
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    want = brute_terms(rows)
    assert sum(map(len, want.values())) > 20
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [(s["start"], s["end"]) for s in r.spans if s["kind"] == "term"] for r in got} == want


def joined_py(spans):
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def test_pii_is_native(spark):
    plan = find_pii(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 12))
    x[100:400] = x[7]  # a third of all rows is one vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    bad = [(1000, None), (1050, [0.0] * 12), (1100, [float("nan")] + [1.0] * 11), (1150, [float("inf")] + [1.0] * 11), (1200, [])]
    return rows, bad


@pytest.mark.parametrize("query_bytes", [None, 0])
def test_nearest_against_brute_force(spark, vectors, query_bytes):
    rows, bad = vectors
    rows = rows + rows[:3]  # repeated rows
    bad = bad + [(1250, [1.0, 2.0]), (1251, [3.0] * 13)]  # of other lengths
    df = spark.createDataFrame(rows + bad + [(None, rows[0][1])], "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    found = nearest(df, lambda i: i % 50 == 0, k=5, sample=300, leaf=40, branch=4, recall=0.98, query_bytes=query_bytes).collect()
    x, hits, total = dict(rows), 0, 0
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in x if i % 50 == 0}
    for q, held in got.items():
        a = np.array(x[q])
        score = {i: float(a @ np.array(v)) / math.sqrt(float(a @ a) * float(np.array(v) @ np.array(v))) for i, v in x.items() if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        assert [k for k, *_ in sorted(held)] == [1, 2, 3, 4, 5]
        assert all(abs(score[i] - s) < 1e-12 for _, i, s in held)
        hits, total = hits + len({i for _, i, _ in held} & set(best)), total + 5
    assert hits / total >= 0.9
    assert [i for _, i, _ in sorted(got[100])] == [7, 101, 102, 103, 104]  # ties: the smallest ids


def test_nearest_edges(spark, vectors):
    df = spark.createDataFrame(vectors[0][:3], "vec_id long, embedding array<double>")
    assert {(r.query_id, r["rank"]) for r in nearest(df, lambda i: i % 50 == 0).collect()} == {(0, 1), (0, 2)}
    assert nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert nearest(spark.createDataFrame(vectors[1], df.schema), lambda i: i % 50 == 0).count() == 0


def test_nearest_ties_go_to_smaller_ids(spark):
    rows = [(i, [float(2 ** (i % 3)), 0.0]) for i in range(40)] + [(100 + i, [1.0, float(i + 1)]) for i in range(5)]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, k=7).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 3, 4, 5, 6, 7] and all(abs(r.score - 1) < 1e-15 for r in found)


def test_best_bin_first_reaches_every_leaf():
    x = np.random.default_rng(1).standard_normal((500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = Tree(x, 4, 30)
    assert set(tree.assign(x)) <= set(tree.leaves) and len(tree.leaves) > 10
    every = tree.visit(x[3], len(tree.leaves))
    assert sorted(every) == sorted(tree.leaves) and tree.visit(x[3], 4) == every[:4] and every[0] == tree.assign(x[3:4])[0]


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7} é</p>") for i in range(40)] + [(50, None, None), (51, "u\r\nX: y", ""), (52, "v", "a\r\n\r\nWARC/1.1\r\nb\n"), (None, "w", "null id"), (3, "http://h/3", "<p>3 é</p>"), (60, "long", "z" * 300_000)]
    path = archive_name(str(tmp_path))
    write_warc(spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")), path, records_per_file=10)
    got = read_warc(spark, path, split_bytes=1000).collect()
    first: dict = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault((h or "").encode(), i)
    want = Counter()
    for i, u, h in rows:
        p = (h or "").encode()
        own = first[p] == i
        want[i, u and re.sub("[\r\n]", "", u), "response" if own else "revisit", len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), None if own else first[p], p if own else None] += 1
    assert Counter((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    some = read_warc(spark, path, "page_id long, record_type string").filter("record_type = 'revisit' and page_id in (8, 9, 60)")
    assert "record_type" not in some._jdf.queryExecution().executedPlan().toString().split("Filter")[-1].split("BatchScan")[0]  # pushed down
    assert sorted(r.page_id for r in some.collect()) == [8, 9]
    assert {r.page_id for r in read_warc(spark, path).filter("payload is null and url is not null").collect()} == {r[0] for r in rows if r[0] is not None and first[(r[2] or "").encode()] != r[0] and r[1]}
    large = archive_name(str(tmp_path))
    write_warc(spark.createDataFrame(rows, PAGES), large, min_bytes=1000)
    assert read_warc(spark, large, "record_type string").filter("record_type = 'revisit'").count() == 0
    none = archive_name(str(tmp_path))
    write_warc(spark.createDataFrame([], PAGES), none)
    assert read_warc(spark, none).count() == 0


def test_pushed_conditions_equal_sparks_own(spark, tmp_path):
    rows = [(1, "u1", "a"), (2, None, "a"), (None, "u3", "b"), (4, "u1", "b"), (5, "", "c")]
    path = archive_name(str(tmp_path))
    write_warc(spark.createDataFrame(rows, PAGES), path)
    columns = "page_id long, url string, record_type string, refers_to long, payload_bytes long"
    plain = spark.createDataFrame(read_warc(spark, path, columns).collect(), columns)
    for condition in (
        "refers_to in (1, null)", "url in ('u1', null)", "page_id in (null)", "refers_to = 1", "refers_to = null", "refers_to <=> null", "refers_to <=> 1", "not (refers_to <=> 1)", "url is null", "url is not null",
        "refers_to is not null and url = 'u1'", "url not in ('u1', 'u3')", "record_type in ('response') and page_id is null", "page_id = 1 or refers_to = 1", "payload_bytes in (1, 2) and url is not null", "refers_to is null and refers_to = 1",
    ):
        key = lambda df: sorted(map(repr, (tuple(r) for r in df.filter(condition).collect())))
        assert key(read_warc(spark, path, columns)) == key(plain), condition


def test_archives_of_gzip_members(spark, tmp_path):
    import gzip

    path = archive_name(str(tmp_path))
    rows = [(i, f"http://h/{i}", f"<p>{i % 4} é</p>") for i in range(20)]
    write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    plain = b"".join(open(os.path.join(path, n), "rb").read() for n in sorted(os.listdir(path)) if n.startswith("part"))
    records = [b"WARC/1.1\r\n" + r for r in plain.split(b"WARC/1.1\r\n") if r]
    os.makedirs(tmp_path / "gz")
    for name, data in (("a.warc.gz", b"".join(map(gzip.compress, records[:9]))), ("b.warc.gz", gzip.compress(b"".join(records[9:])))):
        (tmp_path / "gz" / name).write_bytes(data)
    assert len(records) == 20 and sorted(map(tuple, read_warc(spark, str(tmp_path / "gz")).collect()), key=str) == sorted(map(tuple, read_warc(spark, path).collect()), key=str)
    assert read_warc(spark, str(tmp_path / "gz"), "page_id long, record_type string").filter("record_type = 'revisit'").count() == 16


def test_damaged_archive(spark, tmp_path):
    path = archive_name(str(tmp_path))
    write_warc(spark.createDataFrame([(1, "u", "payload")], PAGES).coalesce(1), path)
    for name in os.listdir(path):
        if name.startswith("part"):
            full = os.path.join(path, name)
            data = open(full, "rb").read()
            open(full, "wb").write(data.replace(b"payload\r\n", b"paYload\r\n"))
            if os.path.exists(crc := os.path.join(path, f".{name}.crc")):
                os.remove(crc)
    with pytest.raises(Exception, match="damaged"):
        read_warc(spark, path).collect()
    assert read_warc(spark, path, "page_id long", verify=False).count() == 1


def page(k, body, nav="Home"):
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t='</p>'</script></head><body class=site><nav><a href=/>{nav} {k}</a></nav>"
        f"<div class='ad x'>Buy {k}</div><div id=cookie-notice>We use cookies</div><article><h1>Head {k}</h1>{body}<p>Share this story</p></article>"
        f"<section class=comments><p>Nice {k}</p></section><aside>Side</aside><form><p>Name</p></form><footer>&copy; {k}</footer></body></html>"
    )


def test_main_text_of_a_host(spark):
    rows = [(k, f"http://h.example/{k}", page(k, f"<p>One {k} &amp; <b>bold<br>x</b>\n two<p>Un&eacute;&nbsp;closed {k}<ul><li>i{k}<li>j{k}</ul>")) for k in range(30)]
    rows += [(100, "http://other.example/a", "<main><p>Only</p></main>"), (101, None, None), (102, "http://h.example/", ""), (103, "nonsense", "no markup & text"), (104, "http://deep.example", "<div>" * 5000 + "deep" + "</div>" * 5000)]
    df = spark.createDataFrame(rows + [rows[0]], PAGES).withColumn("host", F.lit("clash"))
    out = extract_text(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) + 1 and all(r.host == "clash" for r in out)
    for k in range(30):  # the constant line of the article is template
        assert got[k] == f"Head {k}\n\nOne {k} & bold x two\n\nUné closed {k}\n\ni{k}\n\nj{k}"
    assert (got[100], got[101], got[102], got[103], got[104]) == ("Only", "", "", "no markup & text", "deep")
    assert extract_text(df.limit(0)).count() == 0


def own_text(html):
    return main_text(parse(html), Wrapper(None))


def test_names_are_whole_and_evidence_only(spark):
    for name in ("content no-sidebar", "promo-free", "share-price", "entry-header", "has-sidebar layout", "nonad", "ad1ress"):
        assert own_text(f"<body><div class='{name}'><p>all</p></div></body>") == "all", name
    body = "<nav>menu</nav><div class='{}'>gone</div><article><h1>T</h1><p>kept</p></article>"
    for name in ("ad", "big ad", "ad-banner", "cookie-notice", "site-header", "page-header", "sidebar-left", "related"):
        assert own_text(body.format(name)) == "T\n\nkept", name
    assert own_text("<article><h1 class='page-header'>T</h1><div class='article-header'>A</div><header>H</header><p>x</p></article>") == "T\n\nA\n\nH\n\nx"
    assert own_text("<div class='sidebar'><article><p>the article</p></article></div>") == "the article"
    assert own_text("<article><p>one</p></article><section class=related><article>teaser</article></section>") == "one"
    assert own_text("<main><p>post</p><section id=comments><article class=comment>hi</article></section></main>") == "post"
    assert own_text("<div class=widget><p>most of the page is in a widget</p></div><p>x</p>") == "most of the page is in a widget\n\nx"
    assert named("ads", {"ads"}) and not named("loads", {"ads"})


def test_nothing_of_the_content_is_lost():
    assert own_text("<p>" + "İ" * 10 + "<SCRIPT>x('</p>')</script ><p>hello world") == "İ" * 10 + "\n\nhello world"
    assert own_text("<form id=aspnetForm><div><h1>T</h1><p>in a form</p></div><input></form>") == "T\n\nin a form"
    assert own_text("<form><article>in a form</article><button>send</button></form>") == "in a form"
    assert own_text("<article><p>x</p><form>search</form></article>") == "x"
    assert own_text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<nav>" * 3000 + "menu") == "deep"
    items = [f"item {k}" for k in range(1000)]
    assert own_text("<article><ul>" + "".join(f"<li>{x}" for x in items) + "</ul></article>") == "\n\n".join(items)
    assert own_text('<p title="a>b">x</p><p class="open>y</p>') == "x\n\ny"


def test_long_and_deep_trees_are_matched_exactly():
    row = "<p>a</p><div><b>x</b></div>"
    left, right = parse("<ul>" + row * 300 + "</ul>"), parse("<ul>" + row * 150 + "<h2>new</h2>" * 60 + row * 150 + "<p>z</p></ul>")
    assert len(matching(left.root, right.root)) == left.root.size
    deep = [parse("<div>" * 4000 + x + "</div>" * 4000) for x in ("<p>a</p>", "<h1>t</h1><p>b</p>")]
    assert len(matching(deep[0].root, deep[1].root)) == 4002


def brute_matching(a, b):
    if a.label != b.label:
        return 0
    best = [0] * (len(b.children) + 1)
    for x in a.children:
        row = [0]
        for j, y in enumerate(b.children):
            w = brute_matching(x, y)
            row.append(max(best[j + 1], row[j], best[j] + w if w else 0))
        best = row
    return 1 + best[-1]


def test_tree_matching_against_brute_force():
    rng = np.random.default_rng(4)

    def tree(depth):
        tag = rng.choice(["div", "section", "b"])
        return f"<{tag}>" + ("".join(tree(depth - 1) for _ in range(rng.integers(0, 5))) if depth else "") + f"</{tag}>"

    for _ in range(40):
        a, b = parse(tree(3)).root, parse(tree(3)).root
        pairs = matching(a, b)
        assert len(pairs) == brute_matching(a, b) and all(x.label == y.label for x, y in pairs)
        up = {id(c): n for t in (a, b) for n in walk(t) for c in n.children}
        assert all((id(up[id(x)]), id(up[id(y)])) in {(id(p), id(q)) for p, q in pairs} for x, y in pairs if x is not a)


def walk(node):
    yield node
    for c in node.children:
        yield from walk(c)


def test_template_grows_with_other_layouts():
    pages = [parse("<body><div class=top>Site</div><p>1</p><p>2</p></body>"), parse("<body><p>1</p><div class=forum><h2>q</h2></div></body>"), parse("<body><p>1</p><p>2</p><p>3</p></body>")]
    template = induce(pages)
    assert [n.label for n in template.nodes] == ["#", "body", "div.top", "p", "div.forum", "h2", "p"]
    again = Wrapper(template.dump()).template
    assert [(n.label, n.place) for n in again.nodes] == [(n.label, n.place) for n in template.nodes]


def test_wrappers_of_hosts_with_several_layouts(spark):
    story = "<body><div>Our site</div><div class=story><p>text {k} that is long enough to be a story</p><p>more {k}</p></div><div>All rights reserved</div></body>"
    forum = "<body><div>Our site</div><div class=thread><ul><li>question {k} of some length<li>answer {k}</ul><p>Log in to answer</p></div></body>"
    copy = "<body><div>Our site</div><p>the same page again and again</p></body>"
    rows = [(k, f"http://a.example/{k}", story.format(k=k)) for k in range(40)] + [(100 + k, f"http://a.example/f{k}", forum.format(k=k)) for k in range(20)]
    rows += [(200 + k, f"http://copies.example/{k}", copy) for k in range(6)] + [(300, "http://lone.example/", story.format(k=3)), (301, "http://wide.example/", "<div class=widget><p>x</p></div>")]
    rows += [(400 + k, f"http://w.example/{k}", f"<div class=widget><p>the text of page {k}</p></div><p>foot {k}</p>") for k in range(4)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(40):  # what all pages say is template
        assert got[k] == f"text {k} that is long enough to be a story\n\nmore {k}"
    for k in range(20):
        assert got[100 + k] == f"question {k} of some length\n\nanswer {k}"
    assert got[200] == "Our site\n\nthe same page again and again"  # copies are no template of each other
    assert got[300] == "Our site\n\ntext 3 that is long enough to be a story\n\nmore 3\n\nAll rights reserved"
    assert got[402] == "the text of page 2\n\nfoot 2"


def test_registry():
    import corpus_pipeline

    assert {re.match(r"op\d+", k)[0] for k in Q.queries() if k != "pipeline"} == {f"op{n}" for n in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "packing"]


def clean_lines(texts, docs=10, chars=30, words=50):
    """Line dedup of {doc_id: text}, as the pipeline has it."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\r\x0b\x0c"))
    held = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")})
    seen, out = set(), {}
    for i in sorted(texts):
        stay, whole = [], texts[i].split("\n")
        for x in whole:
            k = key(x)
            if len(k) >= chars and (held[k] >= docs or len(k.split()) >= words and held[k] >= 2):
                if k in seen:
                    continue
                seen.add(k)
            stay.append(x)
        if len(stay) == len(whole) or "\n".join(stay).strip(" \t\n\r\x0b\x0c"):
            out[i] = "\n".join(stay)
    return out


def near_copies(texts, n=5):
    """Ids that are not the smallest of their group of near copies, by an inverted index of shingles."""
    sets, index = {}, {}
    for i in sorted(texts):
        w = texts[i].encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j, both in Counter(j for s in sets[i] for j in index[s] if j < i).items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) != i}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs = kept = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, kept, sf).collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        kept = spark.createDataFrame(rows, docs.schema)
        texts.append({r.doc_id: r.text for r in rows})
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    bad, toxic = {r.doc_id for r in labels if r.quality == 0}, {r.doc_id for r in labels if r.toxic == 1}
    clean = {r.doc_id for r in labels} - bad - toxic
    assert all(t == texts[0][i] for i, t in texts[1].items())
    assert len(bad & set(texts[1])) <= 0.05 * len(bad) and len(clean - set(texts[1])) <= 0.02 * len(clean) and len(toxic & set(texts[1])) < 0.6 * len(toxic)
    assert texts[2] == clean_lines(texts[1])
    assert set(texts[3]) == set(texts[2]) - near_copies(texts[2]) and all(texts[2][i] == t for i, t in texts[3].items())
    bench = [(r.text or "").lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {i: " ".join(t.lower().split()) for i, t in texts[3].items()}
    leaks = {i for i, t in whole.items() if any(b and " ".join(b) in t for b in bench)}
    assert leaks and not leaks & set(texts[4]) and len(texts[4]) >= len(texts[3]) - 2 * len(leaks)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(texts[4])
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(None, 1, None), (31, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "which words are asked for in this item of the test here"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    long = " ".join(f"w{k}" for k in range(60))
    text = lambda i: f"A text number {i} that has some words {i * 7}." if i % 3 else f"BAD!! {i} ### $$$"
    rows = [(i, text(i), "en", "s", len(text(i)), 1.0, "x") for i in range(30)]
    odd = [(40, None), (41, ""), (42, " \n\t"), (43, long), (44, "\n" + long + "\n\t"), (45, long + "\nown words are here too, quite many of them for this"), (None, "no id"), (40, "a repeated id")]
    rows += [(i, t, None, None, None, None, None) for i, t in odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_dropped string").withColumn("contaminated", F.lit(1)).withColumn("kept", F.lit("k"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)
        got = stage(spark, docs, sf).collect()
        ids = Counter(r.doc_id for r in got)
        if name == "line dedup":
            assert 44 not in ids and {r.doc_id: r.text for r in got}[45] == odd[5][1].split("\n")[1] and ids[43] == 1 and ids[40] == 2 and ids[None] == 1
        if name == "near dedup":
            assert ids[43] == 1 and 44 not in ids and ids[41] == ids[42] == ids[None] == 1
        if name == "decontamination":
            assert sum(ids.values()) == len(rows)
        if name == "packing":
            assert sum(r.length for r in got) > len(rows)
        else:
            assert all(r.kept == "k" and r.contaminated == 1 for r in got)


def test_folds_use_the_ids_text(spark):
    from panelspark.llm.shared import in_fold

    rows = spark.range(20).select("id", in_fold(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
