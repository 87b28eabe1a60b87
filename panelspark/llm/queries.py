"""The registered corpus queries: each applies one operator, as used in production, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_contamination
from .html_text import extract_text
from .integer_codes import code_vectors
from .line_dedup import dedup_lines
from .near_dup import near_duplicates
from .packing import pack
from .pii import counts, find_pii, joined
from .ppm import score_texts
from .quality import quality_scores
from .shared import checkpoint_dir, in_fold, table
from .spelling import spelling_groups
from .url_filter import judge_urls
from .vectors import nearest
from .warc import archive_name, read_warc, write_warc

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    spans, changed = F.col("spans"), F.size("spans") > 0
    return out.select(
        "doc_id", *counts(F.col("base")), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(spans).alias("spans"),
        *counts(spans, ("secret", "term")), F.size(spans).cast("long").alias("n_spans"), F.when(changed, F.sha2("clean", 256)).alias("clean_sha256"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4
           THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.c)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = doc_id
"""


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive_name(checkpoint_dir(spark))
    write_warc(table(spark, sf_dir, "pages"), path, min_bytes=0)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    found = read_warc(spark, path, columns).filter("record_type = 'response'")  # payloads are read and digested again
    return found.unionByName(read_warc(spark, path, columns, verify=False).filter("record_type = 'revisit'"))  # headers only


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x,
                  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(x, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> (35 - 5 * CAST(i % 8 AS INT))) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to
FROM p
"""


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 3, 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_scores(docs, table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 7, 2)
    out = score_texts(docs, ~held_out)
    return out.withColumn("held_out", in_fold(F.col("doc_id"), 7, 2))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids", "item_share")


OP8_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)),
bad AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.doc_id, l.i, l.line, b.k IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.k = b.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: crc32 runs over a text's bits, lowest of each byte first; near words share what is left when a letter is taken out
#: of both at one place, or are what is left of each other.
OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) GROUP BY ALL),
steps AS (SELECT list(s ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS s
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
hexed AS (SELECT doc_id, run, times, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS x FROM runs),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM hexed, steps),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (SELECT word, n, i, CASE WHEN i = 1 THEN '' ELSE word[1:i - 1] END || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS w, a.n AS w_n, b.word AS o, b.n AS o_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
near AS (SELECT w, w_n, count(*) AS n_near, min({'k': -o_n, 'o': o}) AS best FROM pairs GROUP BY w, w_n),
formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.k >= 2 * n THEN best.o END AS form, CASE WHEN -best.k >= 2 * n THEN -best.k END AS form_n
           FROM words LEFT JOIN near ON w = words.word),
walk(word, root, step) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word) USING (word)
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = code_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op12_sql(rounds: int = 4) -> str:
    far = "list_sum(list_transform(list_zip(v.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = "SELECT r, p, best.e AS e, best.d AS d FROM (SELECT r, p, min({{'d': {far}, 'e': e}}) AS best FROM v JOIN c{k} c USING (p) GROUP BY r, p)"
    steps = ""
    for k in range(rounds):
        steps += f"""
a{k} AS MATERIALIZED ({nearest.format(far=far, k=k)}),
c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.y, c.y) AS y FROM c{k} c LEFT JOIN (
    SELECT p, e, list(f ORDER BY i) AS y FROM (
      SELECT p, e, i, CAST(sum(q) - (((sum(q) % count(*)) + count(*)) % count(*)) AS BIGINT) // count(*) AS f
      FROM (SELECT a.p, a.e, unnest(v.x) AS q, unnest(range(len(v.x))) AS i FROM a{k} a JOIN v USING (r, p)) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e)),"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // 4) + 1:(p + 1) * (len(x) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM v WHERE r <= 256),{steps}
last AS MATERIALIZED ({nearest.format(far=far, k=rounds)}),
coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), book
"""


#: Fixed values of the contract: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM rest),
urls AS (SELECT row_number() OVER () AS r, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts),
hits AS (SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
         FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN hits USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_near_dedup": op2_near_dedup,
        "op3_nearest": op3_nearest,
        "op4_warc": op4_warc,
        "op5_quality": op5_quality,
        "op6_ppm_score": op6_ppm_score,
        "op7_packing": op7_packing,
        "op8_line_dedup": op8_line_dedup,
        "op9_main_text": op9_main_text,
        "op10_decontamination": op10_decontamination,
        "op11_spelling": op11_spelling,
        "op12_vector_codes": op12_vector_codes,
        "op13_url_filter": op13_url_filter,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op8_line_dedup": OP8_SQL, "op11_spelling": OP11_SQL,
        "op12_vector_codes": _op12_sql(), "op13_url_filter": OP13_SQL,
    }
