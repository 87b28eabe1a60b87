"""Personal data in text: patterned identifiers, and terms that disclose them, by information content.

Only column functions are used.

1. Base spans are the leftmost non-overlapping matches of four patterns, kept if they pass their test.  A text is
   split by a pattern and the matches are taken out of it; running lengths of pieces and matches give positions.
   The patterns are written without backtracking over repeats, so long texts neither overflow nor turn quadratic.
2. Every identifier value c is a protected entity, and so are secrets: words of 20 characters and more whose
   characters carry ``SECRET_BITS`` of information each and mix letters with digits (keys, tokens, password hashes).  So
   that values held by one or two texts count too, every group of values is an entity as well: its kind, and within the
   kind the mail domain, network (two numbers), card issuer (six digits), phone prefix (three digits) or secret's prefix.  Terms t are the words of the lines that hold c, or a value of the group c.  Over the
   whole corpus, n(c), n(t) and n(c, t) count documents; t discloses c if
   PMI(c; t) = log2(N n(c, t) / n(c) n(t)) >= alpha * IC(c),  IC(c) = log2(N / n(c)),
   and at least ``min_support`` different texts hold the pair (copies of one text prove nothing).  For groups n(t) is
   one more (smoothing: one document with t and without the group).  Words of one letter and numbers are no terms.
3. In documents that hold a value of c, such terms in its lines are spans of kind ``term``, secrets spans of kind
   ``secret``.  ``clean`` has base spans and secrets generalised to their kind, and terms to a mark, or removed.

What is gathered in one row is bounded by the document itself (its entities and the words of their lines); pairs of an
entity and a term are counted with partial sums, so a kind that a third of all rows hold is no hot key.

Defined results: null and empty texts have no spans; equal rows are separate documents; a term span that touches a
base span or secret is dropped, so is a secret that touches a base span, base spans always stay; spans are ordered by
start, then by kind as listed; positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep, small, unused

#: kind: (pattern, what a text must contain for it to match at all)
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[ -]?[0-9]){11,}+", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"  # sorts by start, then kind
#: Words that may be secrets, and what tells them from long words, paths and numbers.
SECRET, SECRET_BITS, SECRET_DIGITS, SECRET_TURNS = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", 3.0, 3, 4
_WORD = r"[\p{L}\p{N}]"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: _passes(kind, s["value"])


def _of(kind: str):
    return lambda s: s["kind"] == kind


def spans_of(text: Column, pattern: Column, kind: str, rank: int) -> Column:
    """All matches of a pattern as spans."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("skip"), m.alias("value")))
    found = F.filter(pieces, lambda x: x["value"].isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["skip"]
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

    return F.aggregate(found, empty, step, lambda s: s["spans"])


def base_spans(text: Column) -> dict[str, Column]:
    out = {}
    for rank, (kind, (pattern, needs)) in enumerate(PATTERNS.items()):
        might = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9](?:[ -]?[0-9]){11}")
        out[kind] = F.when(might, F.filter(spans_of(text, F.lit(pattern), kind, rank), _test(kind))).otherwise(F.array().cast(_SPAN))
    return out


def _bits(value: Column) -> Column:
    """Shannon information per character."""
    letters = F.split(value, "")
    n = F.size(letters)

    def add(total: Column, c: Column) -> Column:
        p = F.size(F.filter(letters, lambda x: x == c)) / n
        return total - p * F.log2(p)

    return F.aggregate(F.array_distinct(letters), F.lit(0.0), add)


def _is_secret(s: Column) -> Column:
    value = s["value"]
    turns = F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))
    return (F.regexp_count(value, F.lit("[0-9]")) >= SECRET_DIGITS) & (turns >= SECRET_TURNS) & (_bits(F.substring(value, 1, 512)) >= SECRET_BITS)


def _clear_of(other: Column):
    return lambda s: ~F.exists(other, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def secret_spans(text: Column) -> Column:
    return F.when(text.rlike(SECRET[:-1]), F.filter(spans_of(text, F.lit(SECRET), "secret", len(PATTERNS)), _is_secret)).otherwise(F.array().cast(_SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), rf"[^\p{{L}}\p{{N}}]+"), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))


def _groups(kind: Column, value: Column) -> Column:
    """The entities that a value belongs to: itself, its domain or prefix, its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    near = (
        F.when(kind == "email", F.lower(F.substring_index(value, "@", -1))).when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(digits, 1, 6)).when(kind == "phone", F.substring(digits, 1, 3)).otherwise(F.substring(value, 1, 4))
    )
    return F.array(F.concat(F.lit("="), value), F.concat(kind, F.lit(":"), near), kind)


def find_pii(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.9, min_support: int = 3, max_broadcast: int = 100_000,
    remove: bool = False, with_text: bool = True,
) -> DataFrame:
    """A row per document row: ``id_col``, ``base`` and ``spans`` (arrays of start, rank, end, kind, value, by start and
    kind), and ``clean``, the sanitised text.  Without ``with_text`` only texts with spans are kept for that, and ``clean`` is
    null for the others, which it would leave as they are."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kinds = base_spans(F.col("text"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*kinds.values()))).withColumn("secrets", secret_spans(F.col("text")))
    rows = rows.withColumn("own", F.concat("base", F.filter("secrets", _clear_of(F.col("base"))))).drop("secrets")
    held = F.size("own") > 0
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "base", "own",
        F.when(held | F.lit(with_text), F.col("text")).alias("text"),
    )
    rows = keep(rows)
    n_docs = rows.count()

    values = F.array_distinct(F.transform("own", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    entities = rows.filter(held).select("row", "text", F.xxhash64("text").alias("copy"), F.explode(values).alias("held"))
    entities = entities.select("row", "text", "copy", F.col("held.value").alias("entity"), _groups(F.col("held.kind"), F.col("held.value")).alias("groups"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.col("entity")))
    context = F.array_distinct(F.flatten(F.transform(lines, lambda x: _words(F.replace(x, F.col("entity"), F.lit(" "))))))
    beside = entities.select("row", "copy", "entity", "groups", F.explode(context).alias("term"))
    pairs = beside.select("row", "copy", F.explode("groups").alias("of"), "term").distinct()  # a document may hold several values of a group
    together = pairs.groupBy("of", "term", "copy").agg(F.count("*").alias("n")).groupBy("of", "term").agg(F.sum("n").alias("n_ct"), F.count("*").alias("texts"))
    together = keep(together.filter(F.col("texts") >= min_support).select("of", "term", "n_ct"))
    terms = together.select("term").distinct()
    few_terms = terms.limit(max_broadcast + 1).count() <= max_broadcast
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text), rf"[^\p{{L}}\p{{N}}]+"))).alias("term"))
    if few_terms:
        frequency = words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        frequency = words.groupBy("term").agg(F.count("*").alias("n_t"))
    by_entity = entities.select("row", F.explode("groups").alias("of")).distinct().groupBy("of").agg(F.count("*").alias("n_c"))
    by_entity = small(keep(by_entity.filter(F.col("n_c") >= min_support)), max_broadcast)  # others have no pair with enough support
    scored = together.join(frequency, "term").join(by_entity, "of")
    n_t = F.col("n_t") + F.when(F.startswith("of", F.lit("=")), 0).otherwise(1)
    pmi = F.log2(F.lit(float(max(n_docs, 1))) * F.col("n_ct") / (F.col("n_c") * n_t))
    content = F.log2(F.lit(float(max(n_docs, 1))) / F.col("n_c"))
    telling = keep(scored.filter((pmi > 0) & (pmi >= alpha * content)).select("of", "term"))
    some = telling.limit(max_broadcast + 1).count() <= max_broadcast
    found = beside.select("row", "entity", F.explode("groups").alias("of"), "term").join(F.broadcast(telling) if some else telling, ["of", "term"], "left_semi")
    per_entity = found.groupBy("row", "entity").agg(F.collect_set("term").alias("terms"))
    exposed = keep(per_entity.groupBy("row").agg(F.collect_list(F.struct("entity", "terms")).alias("exposed")))
    few = exposed.limit(max_broadcast + 1).count() <= max_broadcast
    out = rows.join(F.broadcast(exposed) if few else exposed, "row", "left")

    any_term = F.concat(F.lit(rf"(?iu)(?<!{_WORD})(?:"), F.array_join(F.array_distinct(F.flatten(F.transform("exposed", lambda e: e["terms"]))), "|"), F.lit(rf")(?!{_WORD})"))
    marked = F.when(F.col("exposed").isNotNull(), spans_of(F.col("text"), any_term, "term", len(PATTERNS) + 1)).otherwise(F.array().cast(_SPAN))
    out = out.withColumn("__marked", marked)

    def in_its_line(s: Column) -> Column:
        line = F.concat(F.substring_index(F.substring(F.col("text"), F.lit(1), s["start"]), "\n", -1), F.substring_index(F.substring(F.col("text"), s["start"] + 1, F.length("text")), "\n", 1))
        return F.exists("exposed", lambda e: F.contains(line, e["entity"]) & F.array_contains(e["terms"], F.lower(s["value"])))

    terms_held = F.filter("__marked", lambda s: _clear_of(F.col("own"))(s) & in_its_line(s))
    out = out.withColumn("spans", F.array_sort(F.concat("own", terms_held)))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(s["kind"] == "term", F.lit("" if remove else "[TERM]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], before, F.when(s["start"] >= state["at"], mark).otherwise(F.lit(""))).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return out.select(F.col("id").alias(id_col), "base", "spans", clean.alias(unused([id_col], "clean")))


def counts(spans: Column, kinds=tuple(PATTERNS)) -> list[Column]:
    """Number of spans of each kind."""
    return [F.size(F.filter(spans, _of(k))).cast("long").alias(f"n_{k}") for k in kinds]

