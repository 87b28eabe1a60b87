"""The registered corpus queries on the smallest tables, against brute force or their contracts; pages made with known text."""

import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pytest

from panelspark.llm import queries as Q
from panelspark.llm.html_text import extract_text

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op2_near_dedup": "doc_id n_shingles component_id kept",
    "op3_nearest": "query_id rank vec_id score",
    "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op5_quality": "doc_id held_out score predicted",
    "op6_ppm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op9_main_text": "page_id url text n_chars",
    "op10_decontamination": "doc_id contaminated item_ids item_share",
    "op11_spelling": "word form root n n_near form_n",
    "op12_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op13_url_filter": "page_id host path rule verdict",
}


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    return {n: read(n) for n in ("documents", "embeddings", "pages", "labels", "benchmark")}


@pytest.fixture(scope="module")
def found(spark, tables):
    return lambda name: Q.queries()[name](spark, SF)


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract_columns_and_rows(found, tables, name):
    df = found(name)
    assert df.columns[: len(CONTRACTS[name].split())] == CONTRACTS[name].split() or set(CONTRACTS[name].split()) <= set(df.columns)
    rows = df.collect()
    if name in ("op4_warc", "op9_main_text", "op13_url_filter"):
        assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in tables["pages"])
    elif name == "op12_vector_codes":
        assert sorted(r.vec_id for r in rows) == sorted(r.vec_id for r in tables["embeddings"])
    elif name not in ("op3_nearest", "op7_packing", "op11_spelling"):
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in tables["documents"])
    texts = {r.doc_id: r.text or "" for r in tables["documents"]}
    if name == "op1_pii":
        from test_other_operators import base_spans

        for r in rows:
            base = base_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(rf"{k}:", base)) for k in ("email", "ip", "card", "phone")]
            assert (r.clean_sha256 is None) == (r.n_spans == 0)
    if name == "op3_nearest":
        x = {r.vec_id: np.array(r.embedding, dtype=float) for r in tables["embeddings"]}
        hits, total = 0, 0
        for q in (i for i in x if i % 50 == 0):
            score = {i: float(x[q] @ v / np.sqrt((x[q] @ x[q]) * (v @ v))) for i, v in x.items() if i != q}
            own = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == q)
            assert [k for k, *_ in own] == [1, 2, 3, 4, 5] and all(abs(score[i] - s) < 1e-12 for _, i, s in own)
            hits, total = hits + len({i for _, i, _ in own} & set(sorted(score, key=lambda i: (-score[i], i))[:5])), total + 5
        assert hits >= 0.9 * total
    if name == "op5_quality":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    if name == "op6_ppm_score":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.n_tokens == len(texts[r.doc_id].encode().split()) + 1 for r in rows)
    if name == "op7_packing":
        ends, held = {}, {}
        for r in rows:
            ends.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in (*ends.values(), *held.values()):
            at = 0
            for begin, n, *_ in sorted(pieces):
                assert begin == at
                at += n
        assert set(ends) == set(texts) and all(sum(n for _, n, _ in p) == p[0][2] for p in ends.values()) and all(sum(n for _, n in p) <= 2048 for p in held.values())
    if name == "op9_main_text":
        assert all(r.n_chars == len(r.text) for r in rows) and sum(r.n_chars > 0 for r in rows) > 0.9 * len(rows)
    if name == "op10_decontamination":
        bench = {r.item_id: " ".join((r.text or "").lower().split()) for r in tables["benchmark"]}
        for r in rows:
            whole = " ".join(texts[r.doc_id].lower().split())
            assert {i for i, b in bench.items() if b and f" {b} " in f" {whole} "} <= set(r.item_ids) and r.contaminated == bool(r.item_ids)


def test_pages_of_known_text(spark):
    """Pages of four hosts, made of an article whose blocks are known and of everything that is none."""
    rng = random.Random(31)
    words = lambda n: " ".join(rng.choice("ab & cé <b> ß d-e İ f.".replace("<b>", "x<y").split(" ")) + str(rng.randint(0, 99)) for _ in range(n))

    def inline(text):
        w = [html.escape(x) for x in text.split()]
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k] = rng.choice(["<b>{}</b>", "<a href='/x?a=1>2'>{}</a>", "<em class=\"share-price\">{}</em>"]).format(w[k])
        return rng.choice([" ", "\n ", "<!-- c --> "]).join(w)

    def article():
        blocks, out = [words(3)], ""
        out += f"<h1>{inline(blocks[0])}</h1>"
        for _ in range(rng.randint(3, 9)):
            kind = rng.randint(0, 3)
            if kind == 2:
                items = [words(2) for _ in range(rng.randint(1, 4))]
                blocks += items
                out += "<ul>" + "".join(f"<li>{inline(x)}" for x in items) + "</ul>"
                continue
            text = words(rng.randint(4, 20))
            blocks.append(text)
            out += {0: "<p>{}", 1: "<div class='promo-free section-{k}'><p>{}</p></div>", 3: "<blockquote><p>{}</p></blockquote>"}[kind].replace("{k}", str(rng.randint(0, 9))).format(inline(text))
        return "\n\n".join(blocks), out

    apart = [
        "<nav><ul><li><a>{}</a></li></ul></nav>", "<div class='ad'>{}</div>", "<aside>{}</aside>", "<form><p>{}</p><button>go</button></form>", "<script>if (a < b) '</p>{}'</script>",
        "<section id=comments><article class=comment><p>{}</p></article></section>", "<div class='cookie-notice'>{}</div>", "<style>.x{{}} {}</style>", "<div class='social sharing'>{}</div>",
    ]
    rows, want = [], {}
    for k in range(80):
        text, main = article()
        noise = lambda: "".join(rng.choice(apart).format(html.escape(words(rng.randint(1, 8)))) for _ in range(rng.randint(0, 4)))
        shell = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<div class='layout has-sidebar'><main>{}</main></div>", "<form id=page><article>{}</article></form>"])
        rows.append((k, f"http://h{k % 4}.example/{k}", f"<html><head><title>t</title></head><body>{noise()}{shell.format(main)}{noise()}<footer>&copy; {k}</footer></body></html>"))
        want[k] = text
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("name", [n for n in Q.oracle_sql()])
def test_same_rows_as_sql(found, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, df = con.sql(Q.oracle_sql()[name]), found(name)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(w[i] for i in order)) for w in want.fetchall())


def test_every_query_has_a_contract():
    assert set(Q.queries()) == {*CONTRACTS, "pipeline"} and set(Q.oracle_sql()) <= set(Q.queries())
