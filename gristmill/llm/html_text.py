"""HTML extraction by site template removal (operator 12).

A page becomes a tree of elements; each element that could be part of a site's template gets a
hash of its subtree.  Spark counts, per host, on how many pages of different content a hash
stands; those on many are the host's templates, and every page loses the subtrees that are one.
What then is left of boilerplate (parts that no other page of the host has, hosts of few pages)
goes by what its elements say of themselves: tag, role, class and id.

Recurrence alone can't tell an article from a menu: articles share whole paragraphs and come in
copies, while menus differ from page to page.  So
- pages count once for each main content (copies of one article are one page);
- inside the main element (article, main) only boxes are hashed, never its paragraphs and headings;
- boxes outside it are hashed by their shape, that is without their texts; everything else with them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._spark import Work, batches, tidy
from gristmill.llm.url_filter import split_url

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())  # their content is no markup
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOXES = frozenset("address article aside center details dialog div dl fieldset figure footer form header hgroup main menu nav ol search section table ul".split())
BLOCKS = BOXES | HEADINGS | frozenset("blockquote body br caption col colgroup dd dt figcaption head hr html legend li optgroup option p pre summary tbody td tfoot th thead tr".split())
ENDS_P = BOXES | HEADINGS | frozenset("blockquote hr p pre".split())
#: Elements that end an open one of the second kind, up to one of the third.
ENDS = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset(["ul", "ol", "menu"]))), **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))), "tr": (frozenset(["tr"]), frozenset(["table"])),
    **dict.fromkeys(["thead", "tbody", "tfoot"], (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"]))), **dict.fromkeys(["option", "optgroup"], (frozenset(["option"]), frozenset(["select"]))),
}
CELLS = frozenset("table td th caption".split())  # an end tag of something around them doesn't close them

# What marks boilerplate.
BOILER_TAGS = frozenset("aside audio button canvas datalist dialog footer form header math menu nav object search select svg template video".split())
OUTSIDE = frozenset("aside dialog footer form header menu nav template".split())  # a main element doesn't stand in them, unless it is the page's largest
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination paywall popup promo promotion recommendations recommended related replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT_END, _END = re.compile("--!?>"), re.compile(">")
_TELLING = re.compile(r"class|id|role|hidden|itemprop|style", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


@lru_cache(1 << 14)
def _marks(attributes: str) -> tuple[str, bool, bool, bool]:
    """Of a tag's attributes: class and id, whether they or others mark boilerplate, the main content, a header."""
    found: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), unescape(v[1:-1] if v[:1] in ("'", '"') else v))
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    words = {x.lower() for x in _NAME.findall(names)}
    return names, hidden or role in ROLES or not words.isdisjoint(WORDS), role == "main" or found.get("itemprop") == "articleBody", "header" in words


def _number(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "big", signed=True)


class Tree:
    """The elements of a page in page order; element 0 is the page itself."""

    def __init__(self, page: str):
        self.tag, self.up, self.attributes = ["html"], [-1], [""]
        self.inner: list[list[int | str]] = [[]]  # texts and child elements, in order
        self.events: list[tuple[int, str | None]] = []  # texts, and None where a block begins or ends
        self._open, self._names = [0], Counter(["html"])
        self._read(page)

    def _text(self, text: str) -> None:
        if text:
            at = self._open[-1]
            if not text.isspace():
                self.inner[at].append(text)
            self.events.append((at, text))

    def _pop(self) -> str:
        tag = self.tag[self._open.pop()]
        self._names[tag] -= 1
        return tag

    def _close(self, tag: str) -> None:
        if tag == "html" or not self._names[tag]:
            return
        if tag not in BLOCKS:  # ended before with a block around it
            for at in reversed(self._open):
                if self.tag[at] == tag:
                    break
                if self.tag[at] in BLOCKS:
                    return
        elif tag not in CELLS and any(self._names[c] for c in CELLS):
            for at in reversed(self._open):
                if self.tag[at] == tag:
                    break
                if self.tag[at] in CELLS and tag not in ("tr", "thead", "tbody", "tfoot"):
                    return
        while self._pop() != tag:
            pass

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P and self._names["p"]:
            k = len(self._open) - 1
            while self.tag[self._open[k]] not in BLOCKS:
                k -= 1
            if self.tag[self._open[k]] == "p":
                while self._pop() != "p":
                    pass
        if tag in ENDS:
            ended, around = ENDS[tag]
            k = len(self._open) - 1
            while k and self.tag[self._open[k]] not in ended and self.tag[self._open[k]] not in around and self.tag[self._open[k]] not in BOXES:
                k -= 1
            if k and self.tag[self._open[k]] in ended:
                while len(self._open) > k:
                    self._pop()
        if tag in VOID or tag == "html":
            return
        at = len(self.tag)
        self.inner[self._open[-1]].append(at)
        self.tag.append(tag)
        self.up.append(self._open[-1])
        self.attributes.append(attributes if _TELLING.search(attributes) else "")
        self.inner.append([])
        self._open.append(at)
        self._names[tag] += 1

    def _read(self, page: str) -> None:
        at, last, tag = 0, page.rfind(">"), _TAG
        while True:
            lt = page.find("<", at)
            if lt < 0 or lt > last and not page.startswith("<!--", lt):
                return self._text(page[at:])
            nxt = page[lt + 1 : lt + 2]
            letter = page[lt + 2 : lt + 3] if nxt == "/" else nxt
            if nxt in ("!", "?") or nxt == "/" and not (letter.isascii() and letter.isalpha()):  # no element
                self._text(page[at:lt])
                m = (_COMMENT_END if page.startswith("<!--", lt) else _END).search(page, lt + 2)
                if not m:
                    return None
                at = m.end()
                continue
            m = tag.match(page, lt)
            if not m and letter.isascii() and letter.isalpha():
                tag = _PLAIN_TAG  # a quote without an end: from here on a tag ends at its first >
                m = tag.match(page, lt)
            if not m:  # no tag: a plain <
                self._text(page[at : lt + 1])
                at = lt + 1
                continue
            self._text(page[at:lt])
            at = m.end()
            end, name = m[1], m[2].lower()
            if name in BLOCKS:
                self.events.append((self._open[-1], None))
            if end:
                self._close(name)
            elif name in SKIPPED:
                if not m[3].endswith("/"):
                    close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                    if not close:
                        return None
                    at = page.find(">", close.end()) + 1 or len(page)
            else:
                self._start(name, m[3])
            if name in BLOCKS:
                self.events.append((self._open[-1], None))


def parse(page: str, site: str) -> tuple[list[int], list[int], list[bool], list[tuple[str, int]], int]:
    """(hashes, parents, rule marks) of the elements that may go, the page's texts as (text, index of the nearest such element or -1), and a digest of its content.

    A hash of 0 is that of an element which only a rule removes.
    """
    tree = Tree(page)
    tag, up, n = tree.tag, tree.up, len(tree.tag)
    marks = [_marks(a) if a else ("", False, False, False) for a in tree.attributes]
    header = [tag[i] == "header" or marks[i][3] for i in range(n)]
    size, exact, shape = [0] * n, [b""] * n, [b""] * n
    for i in range(n - 1, -1, -1):  # children come after their parent
        name = f"{tag[i]} {marks[i][0]}"
        whole, form = [name.encode("utf-8", "replace")], [_DIGITS.sub("0", name).encode("utf-8", "replace")]
        for x in tree.inner[i]:
            if isinstance(x, str):
                size[i] += len(x)
                whole.append(" ".join(x.split()).encode("utf-8", "replace"))
                part = b"t"
            else:
                size[i] += size[x]
                whole.append(exact[x])
                part = shape[x]
            if form[-1] != part:  # a row of alike children is as one
                form.append(part)
        exact[i], shape[i] = blake2b(b"\0".join(whole), digest_size=8).digest(), blake2b(b"\0".join(form), digest_size=8).digest()
    # the main elements: the one with the most text, and others in no boilerplate
    boiler = [i > 0 and tag[i] != "body" and (tag[i] in BOILER_TAGS or header[i] or marks[i][1]) for i in range(n)]
    outside, ruled = [False] * n, [False] * n
    for i in range(1, n):
        outside[i] = outside[up[i]] or tag[i] in OUTSIDE
        ruled[i] = ruled[up[i]] or boiler[i]
    wanted = [i for i in range(1, n) if size[i] and (tag[i] in ("article", "main") or marks[i][2]) and not boiler[i]]
    largest = max((i for i in wanted if not outside[i]), key=lambda i: size[i], default=max(wanted, key=lambda i: size[i], default=0))
    if largest:
        if 2 * size[largest] < size[0] and all(outside[i] for i in wanted):
            largest = 0  # teasers in a sidebar
    main = {i for i in wanted if i == largest or not ruled[i]} if largest else set()
    holds = set()  # elements around a main one
    for i in main:
        while (i := up[i]) >= 0 and i not in holds:
            holds.add(i)
    keys, parents, by_rule, place, in_main, titled = [], [], [], [-1] * n, [False] * n, [False] * n
    salt = site.encode("utf-8", "replace")
    for i in range(1, n):
        place[i], in_main[i] = place[up[i]], in_main[up[i]] or i in main
        titled[i] = in_main[i] and (header[i] or titled[up[i]] and not marks[i][1])
        if i in holds or i in main or not size[i] or tag[i] == "body":
            continue
        rule = boiler[i]
        if rule and not main and 2 * size[i] > size[0] and tag[i] not in ("nav", "footer", "aside"):
            rule = False  # a form or a box of an unlucky name around the whole page
        kind = None
        if tag[i] in BOXES:
            kind = b"shape" if main and not in_main[i] else b"exact"
        elif tag[i] in BLOCKS and not in_main[i]:
            kind = b"exact"
        if titled[i] and tag[i] in HEADINGS:  # an article's header goes, but not the title in it
            place[i] = -1
            continue
        if kind or rule:
            keys.append(_number(salt, kind, shape[i] if kind == b"shape" else exact[i]) or 1 if kind and site else 0)
            parents.append(place[i])
            by_rule.append(rule)
            place[i] = len(keys) - 1
    parts: list[tuple[str, int]] = []
    dead = []
    for p, r in zip(parents, by_rule, strict=True):
        dead.append(r or p >= 0 and dead[p])
    body, at, said, block = [], None, [], [[]]
    for i, text in tree.events:
        here = place[i]
        gone = here >= 0 and dead[here]
        if text is None:
            block.append([])
        elif main and in_main[i]:
            said.append(text)
        elif not gone:
            block[-1].append(text)
        if here != at and body:
            parts.append(("".join(body), at))
            body = []
        at = here
        body.append(" " if text is None or gone else unescape(text) if "&" in text else text)  # what goes still parts its neighbours
    if body:
        parts.append(("".join(body), at))
    content = " ".join("".join(said).split()) if main else max((" ".join("".join(x).split()) for x in block), key=len)
    return keys, parents, by_rule, parts, _number(content.encode("utf-8", "replace"))


_PART = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32())]))


def _parse_batches(at: int, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages, sites = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            got = [parse(p or "", s or "") for p, s in zip(pages, sites, strict=True)]
            new = [
                pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.bool_())),
                pa.array([[{"text": t.encode("utf-8", "replace").decode(), "node": n} for t, n in g[3]] for g in got], _PART), pa.array([g[4] for g in got], pa.int64()),
            ]
            cols = [*(c for i, c in enumerate(b.columns) if i != at), *new]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _write_batches(known, kept: int, schema: pa.Schema):
    """known: a broadcast sorted array of templates, or None where the last column lists each page's own."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, parents, by_rule, parts = (b.column(kept + k).to_pylist() for k in range(4))
            own = [np.array(x or (), np.int64) for x in b.column(kept + 4).to_pylist()] if known is None else [known.value] * len(keys)
            texts, n_template, n_rule = [], [], []
            for k, up, rule, ps, table in zip(keys, parents, by_rule, parts, own, strict=True):
                k = np.array(k, np.int64)
                at = np.searchsorted(table, k)
                hit = (table[np.minimum(at, len(table) - 1)] == k) & (k != 0) if len(table) else np.zeros(len(k), bool)
                gone, counts = [], [0, 0]
                for i, p in enumerate(up):
                    if not (p >= 0 and gone[p]):
                        counts[0] += bool(hit[i])
                        counts[1] += rule[i] and not hit[i]
                    gone.append((p >= 0 and gone[p]) or bool(hit[i]) or rule[i])
                texts.append(" ".join("".join(x["text"] if x["node"] < 0 or not gone[x["node"]] else " " for x in ps).split()))
                n_template.append(counts[0])
                n_rule.append(counts[1])
            cols = [*b.columns[:kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_template, pa.int64()), pa.array(n_rule, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def templates(parsed: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """The hashes (key) on at least `min_pages` pages of different content, and `min_share` of all such pages, of their host. parsed: (site, digest, keys)."""
    pages = parsed.where("site is not null").select("site", "digest", "keys")
    seen = pages.select("site", "digest", F.explode(F.array_distinct("keys")).alias("key")).where("key <> 0").distinct()
    often = seen.groupBy("site", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.select("site", "digest").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("all"))
    return often.join(totals, "site").where(F.col("pages") >= F.col("all") * min_share).select("key")


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_share: float = 0.1, max_broadcast: int = 1 << 20) -> DataFrame:
    """pages without their html, with text (the main text), n_chars (its code points), n_template and n_rule (subtrees removed as templates, and by what they say of themselves).

    Blocks are joined by one space, white space of any kind inside one is one space.  Character references are decoded once.  Null and
    empty pages, and pages without text, have an empty text; broken markup is read as far as it goes, an unclosed comment or script to the end.
    Pages are taken whole, however long.  Without a host no subtree is a template.  Copies of one main content
    count as one page of their host; repeated rows have the same text.  Input columns of the new names are replaced, all others stay,
    whatever their names.  An empty table gives an empty table.

    The templates (8 bytes each) are broadcast up to `max_broadcast`, beyond that each page's own are joined to it, to the same result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    batches(spark)
    new = [T.StructField("text", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("n_chars", "n_template", "n_rule"))]
    pages = pages.drop(*(f.name for f in new))
    kept = [f for f in pages.schema.fields if f.name != html_col]
    rows = pages.toDF(*(f"d{i}" for i in range(len(pages.columns))))  # whatever the names
    host, _ = split_url(F.coalesce(F.col(f"d{pages.columns.index(url_col)}"), F.lit("")))
    rows = rows.withColumn("site", F.nullif(host, F.lit("")))
    inner = T.StructType([
        *(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)), T.StructField("site", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("up", T.ArrayType(T.IntegerType())),
        T.StructField("by_rule", T.ArrayType(T.BooleanType())), T.StructField("parts", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("node", T.IntegerType())]))), T.StructField("digest", T.LongType()),
    ])
    parsed = rows.mapInArrow(_parse_batches(pages.columns.index(html_col), to_arrow_schema(inner)), inner).withColumn("row", F.monotonically_increasing_id())
    work = Work(spark, "html_text")
    parsed = work.table(parsed, "parsed")
    found = work.table(templates(parsed, min_pages, min_share), "templates")
    out = T.StructType([*kept, *new])
    used = [*(f"c{i}" for i in range(len(kept))), "keys", "up", "by_rule", "parts"]
    if found.count() <= max_broadcast:
        known = spark.sparkContext.broadcast(np.sort(found.toArrow().column("key").to_numpy()))
        return parsed.select(*used).mapInArrow(_write_batches(known, len(kept), to_arrow_schema(out)), out)
    own = parsed.select("row", F.explode(F.array_distinct("keys")).alias("key")).join(found, "key").groupBy("row").agg(F.sort_array(F.collect_set("key")).alias("own"))  # a page's own hashes at most
    joined = parsed.join(own, "row", "left").select(*used, "own")
    return joined.mapInArrow(_write_batches(None, len(kept), to_arrow_schema(out)), out)
