"""Main text of web pages by wrapper induction.

1. For each host a template is grown from ``sample`` pages (those of the smallest id hashes, found by salted ranking):
   simple tree matching aligns the DOM tree of a page with the template, and elements of kinds that the template
   lacks are added where they stand.
2. Every page of the host is aligned with the template.  Over all pages Spark counts, per aligned place (elements
   without a counterpart are placed by their path of labels), the texts of its blocks, with partial sums, so a hot
   host is no hot key.  A text found on ``share`` of the pages that have the place, three at least, is template; all other text
   varies, so its places are slots.
3. Templates with their constant texts and slot sizes are joined to the pages (broadcast where a count shows them few;
   else Spark splits a hot host) and applied page by page.  Constant blocks go, but for headings within article and
   main elements.  Of what varies, that in article and main elements is the content, or that
   outside of them if it is longer.  A page all of whose blocks are constant is a copy of others and keeps them.

Scripts, menus, footers, sidebars, buttons and comments go by their element or name.  Forms, page headers and elements
whose whole class name, id or role says notice, advert, sharing and the like go as well, but a name is evidence only:
an element stays if it holds the page's main article, or, on pages without one, most of the host's slot text (for
elements without a counterpart, of the page's text).

Trees of any depth and child lists of any length are matched exactly (equal ends of two lists pair off, the rest takes
rows of the classic recurrence).

Defined results: null and empty html and pages without main text give ""; null urls form one host; copies of a row are
pages of their own; character references are decoded, white space inside a block becomes one space, blocks are joined
by two line ends.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ended, keep, small

#: Comments, tags and declarations.  A quote opens a value only behind ``=``; what the page's end cuts off ends there, so
#: every match is final and a page is read in one pass.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements by what they mean for reading.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW_TEXT = set("script style noscript template svg math iframe object textarea title select audio video canvas".split())
_RAW = _RAW_TEXT | {"head"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HARD = set("nav footer aside button menu dialog".split())
#: Words of class, id and role values that name something other than the article.
_ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share "
    "sharing sidebar social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo".split()
)
_COMMENT_NAMES = set("comment comments commentlist commentform commentarea commentsection disqus replies reply respond".split())
#: Words for the article itself; its header is part of it.
_OWN = set("article entry post story".split())
#: Words that only say where such a thing stands or what it is made of.
_FILLER = set(
    "area bar block body bottom box button buttons container content form global inner item items left links list main outer page panel "
    "posts primary reader readers right secondary section signup site slot text title top unit user users widget wrap wrapper".split()
) | _OWN
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_LIMITS = {"ul", "ol", "table", "dl", "div", "section", "article", "body", "html", "main", "nav", "aside", "header", "footer", "td", "th", "blockquote", "form"}
#: Open elements that a start tag ends.
_CLOSING = {t: _CLOSES.get(t, set()) | ({"p"} if t in _ENDS_P else set()) for t in _ENDS_P | set(_CLOSES)}
_NO_TEXT = _RAW | _HARD
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in _RAW_TEXT}
#: Wrappers of at most so many hosts (some kilobytes each) are broadcast.
HOSTS = 20_000
#: Pages on which a text must be found, at least, to be template.
LEAST_PAGES = 3


def named(name: str, words: set[str]) -> bool:
    """Whether a whole class name, id or role is one of the words, or a compound of them and of words that say where."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    if "header" in parts and not _OWN.isdisjoint(parts):
        return False
    return name in words or any(p in words for p in parts) and all(p in words or p in _FILLER or p in _ASIDE_NAMES for p in parts)


_KINDS: dict[tuple[str, str], tuple] = {}


def _kind(tag: str, attributes: str) -> tuple:
    """Names, label and what the names say of an element; remembered, as pages repeat few."""
    if (found := _KINDS.get((tag, attributes))) is None:
        names = tuple(v for n in _NAMES.finditer(attributes) for v in (n[1] or n[2] or n[3] or "").lower().split())
        comment = any(named(n, _COMMENT_NAMES) for n in names)
        aside = any(named(n, _ASIDE_NAMES) for n in names)
        if len(_KINDS) > 20_000:
            _KINDS.clear()
        found = _KINDS[tag, attributes] = (names, ".".join((tag, *(re.sub("[0-9]+", "#", n) for n in names))), comment, aside)
    return found


class Node:
    __slots__ = ("tag", "names", "parts", "children", "label", "shape", "size", "chars", "main", "clear", "comment", "aside", "place")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts, self.children, self.place = tag, [], [], -1
        self.names, self.label, self.comment, self.aside = _kind(tag, attributes)


class Page:
    """A parsed page: ``nodes`` in document order, the root first; ``chars`` of text below each, ``main`` of them in
    articles, ``clear`` of them in articles that no aside holds."""

    def __init__(self, root: Node, nodes: list[Node]):
        self.root, self.nodes = root, nodes
        for n in reversed(nodes):
            shape, size, chars, main, clear = [n.label], 1, 0, 0, 0
            for c in n.children:
                shape.append(c.shape)
                size += c.size
                main += c.main
                clear += c.clear
                if c.tag not in _NO_TEXT:
                    chars += c.chars
            for p in n.parts:
                if type(p) is str:
                    chars += len(p.strip())
            if n.tag == "article" or n.tag == "main":
                main, clear = (main, 0) if n.comment else (chars, chars)
            elif n.comment or (n.aside or n.tag in _HARD) and n.tag != "html" and n.tag != "body":
                clear = 0
            n.shape, n.size, n.chars, n.main, n.clear = hash(tuple(shape)), size, chars, main, clear


def parse(text: str) -> Page:
    root = Node("#")
    nodes, stack, at, held = [root], [root], 0, dict.fromkeys(_CLOSES, 0)
    held["p"] = 0

    def close(upto: int) -> None:
        for n in stack[upto:]:
            held[n.tag] -= 1
        del stack[upto:]

    for m in iter(lambda: _TAG.search(text, at), None):
        begin = m.start()
        if begin > at:
            stack[-1].parts.append(text[at:begin])
        at = m.end()
        end_tag, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if end_tag:
            if not held.get(tag):
                continue
            if stack[-1].tag == tag:
                held[tag] -= 1
                stack.pop()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in _LIMITS and tag not in _LIMITS:
                    break
            continue
        node = Node(tag, attributes if "=" in attributes else "")
        closing = _CLOSING.get(tag)
        if closing and any([held[t] for t in closing]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closing:
                    close(i)
                    break
                if stack[i].tag in _LIMITS:
                    break
        above = stack[-1]
        above.parts.append(node)
        above.children.append(node)
        nodes.append(node)
        alone = attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\r\f\"'")  # else the end of a value
        if tag in _RAW_TEXT and not (alone and tag in ("svg", "math")):
            end = _RAW_ENDS[tag].search(text, at)
            at = end.end() if end else len(text)
        elif tag not in _VOID and not (alone and tag not in _BLOCK):
            stack.append(node)
            held[tag] = held.get(tag, 0) + 1
    if at < len(text):
        stack[-1].parts.append(text[at:])
    return Page(root, nodes)


class Matcher:
    """Simple tree matching: the largest order-keeping set of node pairs with equal labels, children under matched parents."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def weight(self, a: Node, b: Node) -> int:
        """How many pairs two trees have."""
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        key = (a.shape, b.shape)
        if (n := self.known.get(key)) is None:
            n = self.known[key] = 1 + sum(self.weight(x, y) for x, y in self.align(a.children, b.children))
        return n

    def align(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        """The pairs of children that make the largest matching."""
        begin, end = 0, 0
        short = min(len(left), len(right))
        while begin < short and left[begin].shape == right[begin].shape:
            begin += 1
        while end < short - begin and left[-1 - end].shape == right[-1 - end].shape:
            end += 1
        ends = list(zip(left[:begin], right[:begin])) + (list(zip(left[-end:], right[-end:])) if end else [])
        left, right = left[begin : len(left) - end], right[begin : len(right) - end]
        if not left or not right:
            return ends
        shapes = {y.shape: y for y in right}
        number = {s: i for i, s in enumerate(shapes)}
        column = np.array([number[y.shape] for y in right])
        rows: dict[int, np.ndarray] = {}
        best, taken, above = np.zeros(len(right) + 1, dtype=np.int64), [], []
        for x in left:
            if x.shape not in rows:
                rows[x.shape] = np.array([self.weight(x, y) for y in shapes.values()])
            w = rows[x.shape][column]
            both = np.where(w > 0, best[:-1] + w, 0)
            new = np.concatenate([[0], np.maximum.accumulate(np.maximum(best[1:], both))])
            taken.append(np.packbits((both == new[1:]) & (w > 0)))
            above.append(np.packbits(best[1:] == new[1:]))
            best = new
        pairs, i, j = [], len(left), len(right)
        bit = lambda rows, i, j: rows[i - 1][(j - 1) >> 3] >> (7 - ((j - 1) & 7)) & 1
        while i and j:
            if bit(above, i, j):
                i -= 1
            elif bit(taken, i, j):
                pairs.append((left[i - 1], right[j - 1]))
                i, j = i - 1, j - 1
            else:
                j -= 1
        return ends + pairs

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
        if len(self.known) > 200_000:
            self.known.clear()
        open_ = [(a, b)]
        while open_:
            x, y = open_.pop()
            yield x, y
            open_ += zip(x.children, y.children) if x.shape == y.shape else self.align(x.children, y.children)


def matching(a: Node, b: Node) -> list[tuple[Node, Node]]:
    return list(Matcher().pairs(a, b)) if a.label == b.label else []


def _like(tag: str, names) -> Node:
    """An element with these names and no content."""
    quoted = " ".join(names).replace('"', "")
    return Node(tag, f'class="{quoted}"' if names else "")


class Template:
    """The grown tree of a host: only labels; ``nodes`` in document order give the places their numbers."""

    def __init__(self, root: Node):
        self.root = root
        self._number()

    def _number(self) -> None:
        nodes, open_ = [], [self.root]
        while open_:
            n = open_.pop()
            n.place = len(nodes)
            nodes.append(n)
            open_ += reversed(n.children)
        self.nodes = Page(self.root, nodes).nodes

    @staticmethod
    def _copy(node: Node) -> Node:
        top = _like(node.tag, node.names)
        open_ = [(node, top)]
        while open_:
            old, new = open_.pop()
            for c in old.children:
                new.children.append(_like(c.tag, c.names))
                open_.append((c, new.children[-1]))
        return top

    @classmethod
    def of(cls, page: Page) -> Template:
        return cls(cls._copy(page.root))

    def grow(self, page: Page) -> None:
        """Adds elements whose label their place lacks, after what stands before them on the page."""
        twin = {id(b): a for a, b in Matcher().pairs(self.root, page.root)}
        for node in page.nodes:
            if (mine := twin.get(id(node))) is None:
                continue
            labels, at = {c.label for c in mine.children}, 0
            for c in node.children:
                if id(c) in twin:
                    at = next(i for i, x in enumerate(mine.children) if x is twin[id(c)]) + 1
                elif c.label not in labels:
                    mine.children.insert(at, self._copy(c))
                    labels.add(c.label)
                    at += 1
        self._number()

    def dump(self) -> str:
        up = {id(c): n.place for n in self.nodes for c in n.children}
        return json.dumps([[up.get(id(n), -1), n.tag, *n.names] for n in self.nodes])

    @classmethod
    def load(cls, text: str) -> Template:
        nodes: list[Node] = []
        for up, tag, *names in json.loads(text):
            nodes.append(_like(tag, names))
            if up >= 0:
                nodes[up].children.append(nodes[-1])
        return cls(nodes[0])


def induce(pages: list[Page]) -> Template:
    """The template of pages of one host."""
    template = Template.of(pages[0])
    for page in pages[1:]:
        template.grow(page)
    return template


class Wrapper:
    """A template with what the counts say: constant texts by place, and which places hold most slot text."""

    def __init__(self, template: str | None, constants=(), slots=()):
        self.template = Template.load(template) if template else None
        self.constants = {(c["place"], c["text"]) for c in constants}
        self.rich: set[int] = set()
        self.matcher = Matcher()
        if self.template and slots:
            own = {s["place"]: s["chars"] for s in slots}
            under = [own.get(n.place, 0) for n in self.template.nodes]
            for n in reversed(self.template.nodes):
                under[n.place] += sum(under[c.place] for c in n.children)
            self.rich = {i for i, chars in enumerate(under) if 2 * chars > under[0]}

    def align(self, page: Page) -> None:
        if self.template:
            for a, b in self.matcher.pairs(self.template.root, page.root):
                b.place = a.place


def _place(node: Node, path: int) -> int:
    """The number of the aligned place, or a negative one that stands for the path of labels."""
    return node.place if node.place >= 0 else -2 - path


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Elements whose text in an article is the author's, even where pages share it ("Summary").
_READING = set("h1 h2 h3 h4 h5 h6".split())


def pieces(page: Page, is_aside) -> list[tuple[int, str, bool, bool]]:
    """The blocks of a page in order: place, text, whether it is in an article or main element, and whether there it is
    of a kind that is read."""
    out: list[tuple[int, str, bool, bool]] = []
    held: list[str] = []

    def flush(place: int, inside: bool, reading: bool) -> None:
        text = " ".join(_html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((place, text, inside, inside and reading))

    open_ = [(page.root, iter(page.root.parts), 0, -1, False, False)]  # node, what is left of it, path, place of its block, inside, reading
    while open_:
        node, left, path, place, inside, reading = open_[-1]
        for part in left:
            if isinstance(part, str):
                held.append(part)
            elif part.tag == "br":
                held.append(" ")
            elif not is_aside(part, inside):
                own = zlib.crc32(part.label.encode(), path)
                block = part.tag in _BLOCK
                if block:
                    flush(place, inside, reading)
                open_.append((part, iter(part.parts), own, _place(part, own) if block else place, inside or part.tag in ("article", "main"), reading or part.tag in _READING))
                break
        else:
            open_.pop()
            if node.tag in _BLOCK:
                flush(place, inside, reading)
    flush(-1, False, False)
    return out


def by_element(node: Node, inside: bool) -> bool:
    return node.tag in _RAW or node.tag in _HARD and not node.main


def asides(page: Page, rich: set[int]):
    """What is no part of the article: a function of a node and whether it is within one."""
    main, clear, chars = page.root.main, page.root.clear, page.root.chars

    def is_aside(node: Node, inside: bool) -> bool:
        if node.tag in _RAW or node.comment and node.tag not in ("html", "body", "main"):
            return True
        if node.tag in ("html", "body", "article", "main"):
            return False
        hard = node.tag in _HARD
        if node.tag == "header" and any(not _OWN.isdisjoint(re.split("[^a-z]+", n)) for n in node.names):
            return False
        header = inside and (node.tag == "header" or all(not named(n, _ASIDE_NAMES) or "header" in re.split("[^a-z]+", n) for n in node.names))
        if not (hard or node.tag in ("form", "header") and not (inside and node.tag == "header") or node.aside and not header):
            return False
        if 2 * node.clear > clear or node.main > 4 * clear:  # it holds the article
            return False
        if hard or inside or main:
            return True
        return not (node.place in rich if node.place >= 0 else 2 * node.chars > chars)

    return is_aside


def main_text(page: Page, wrapper: Wrapper) -> str:
    """Slot text of the article and main elements or of all else, whichever holds more of it (teasers beside a main text
    are articles too); a page that has no slot text at all is a copy of others and gives its shared text."""
    wrapper.align(page)
    found = pieces(page, asides(page, wrapper.rich))
    slots = [p for p in found if p[3] or (p[0], text_hash(p[1])) not in wrapper.constants]
    kept = slots or found
    within = sum(len(text) for _, text, inside, _ in kept if inside)
    inside_wins = 2 * within >= sum(len(text) for _, text, *_ in kept) and within
    return "\n\n".join(text for _, text, inside, _ in kept if inside == bool(inside_wins))


def _induce(frame: pd.DataFrame) -> pd.DataFrame:
    pages = [parse(h or "") for h in frame.sort_values("page")["html"].drop_duplicates()]
    return pd.DataFrame({"host": frame["host"].iloc[:1], "template": [induce(pages).dump()]})


class _Wrappers:
    """The wrappers that a task has met lately."""

    def __init__(self):
        self.known: dict = {}

    def get(self, host, template, constants=(), slots=()) -> Wrapper:
        if host not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            self.known[host] = Wrapper(template, constants or (), slots or ())
        return self.known[host]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, place, text, n, chars) of pages: how many have a text at a place, and with text -1 how many have the place."""
    wrappers = _Wrappers()
    for batch in ended(batches, wrappers.known.clear):
        seen, chars = Counter(), Counter()
        for host, template, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            page = parse(html or "")
            wrappers.get(host, template).align(page)
            found = {(place, text_hash(text)): len(text) for place, text, *_ in pieces(page, by_element)}
            for (place, text), n in found.items():
                seen[host, place, text] += 1
                chars[host, place, text] += n
            for place in {place for place, _ in found}:
                seen[host, place, None] += 1
        hosts, places, texts = zip(*seen) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.int64()), pa.array(seen.values(), pa.int64()), pa.array([chars[k] for k in seen], pa.int64())],
            ["host", "place", "text", "n", "chars"],
        )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers = _Wrappers()
    for batch in ended(batches, wrappers.known.clear):
        rows = zip(*(batch.column(i).to_pylist() for i in range(5)))
        out = [main_text(parse(html or ""), wrappers.get(host, template, constants, slots)) for html, host, template, constants, slots in rows]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[5:]], ["__main", *batch.schema.names[5:]])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def extract_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", sample: int = 12, share: float = 0.8
) -> DataFrame:
    """``pages`` with ``text_col``: the main text of ``html_col``."""
    keyed = pages.select(host_of(F.col(url_col)).alias("host"), F.col(id_col).alias("page"), F.col(html_col).cast("string").alias("html"))
    order = [F.xxhash64("page"), F.col("page")]
    ranks = keyed.select("host", "page").withColumn("salt", F.pmod(F.xxhash64("page", F.lit(1)), F.lit(32)))
    for keys in (["host", "salt"], ["host"]):
        ranks = ranks.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= sample)
    chosen = keep(ranks.select(F.col("host").alias("__of"), F.col("page").alias("__page")))
    sampled = keyed.join(small(chosen), (F.col("page") == F.col("__page")) & (F.col("host") == F.col("__of")), "left_semi")
    templates = keep(sampled.groupBy("host").applyInPandas(_induce, "host string, template string"))

    counts = keyed.select("host", "html").join(small(templates, HOSTS), "host", "left").select("host", "template", "html")
    counts = counts.mapInArrow(_count, "host string, place long, text long, n long, chars long")
    texts = counts.groupBy("host", "place", "text").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    with_page = F.sum(F.when(F.col("text").isNull(), F.col("n")))
    most = F.when(F.col("text").isNotNull(), F.col("n"))
    places = texts.groupBy("host", "place").agg(with_page.alias("pages"), F.max(most).alias("n"), F.max_by("text", most).alias("text"), F.sum("chars").alias("chars"), F.max_by("chars", most).alias("constant"))
    is_constant = (F.col("n") >= F.greatest(F.lit(share) * F.col("pages"), F.lit(LEAST_PAGES)))
    slots = F.col("chars") - F.when(is_constant, F.col("constant")).otherwise(0)
    # A row per place of the template, and per constant: as many as the template and its pages' shared blocks.
    learnt = places.filter(is_constant | (F.col("place") >= 0)).groupBy("host").agg(
        F.collect_list(F.when(is_constant, F.struct("place", "text"))).alias("constants"),
        F.collect_list(F.when(F.col("place") >= 0, F.struct("place", slots.alias("chars")))).alias("slots"),
    )
    wrappers = keep(templates.join(learnt, "host", "left").withColumnRenamed("host", "__of"))
    rest = [c for c in pages.columns if c != text_col]
    rows = pages.withColumn("__host", host_of(F.col(url_col))).join(small(wrappers, HOSTS), F.col("__host") == F.col("__of"), "left")
    rows = rows.select(F.col(html_col).cast("string").alias("__html"), "__host", F.col("template").alias("__template"), F.col("constants").alias("__constants"), F.col("slots").alias("__slots"), *rest)
    schema = ", ".join(["__main string", *(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)])
    return rows.mapInArrow(_apply, schema).select(*rest, F.col("__main").alias(text_col))
