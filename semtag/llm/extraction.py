"""Main-text extraction by equivalence classes of template tokens.

The pages of a host are made by few templates; pages of one layout (the set of places near the root) share one.
A page is a sequence of tokens: elements at their place in the element tree, classes included, and whole text
blocks there. Tokens with the same occurrence vector over a layout's pages (how often each has them) form an
equivalence class; a vector is held as a sum of hashes of page and count, so that a host of any size is
grouped by plain aggregation. A class is valid if it is large and enough pages have it, and a token of it counts only if
it mostly follows the same once-a-page element: then the once-a-page tokens of a class come in one order, and a repeated
class nests in one slot between two of them. Pages are cut at the tokens of their template. What remains
between them are the slots; tags and attributes only label a slot, as main content, furniture or neither.
The main text is all text of the slots in main content, also what many pages share; a page without any gives
its unlabelled slots, less texts that are template tokens themselves.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, table, utf8

#: HTML elements by what they mean for the text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp"}
BOILERPLATE = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "audio", "video", "object"} | RAW
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
MAIN = {"article", "main"}
SIBLINGS = {"li", "dt", "dd", "tr", "td", "th", "option"}
#: Words of a class, id or role that mark an element as boilerplate: as a whole token, and those of STRONG also as a part of one.
MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "recommended", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"}
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "disqus", "nav", "navbar", "newsletter", "pagination", "popup", "promo", "sharing", "sidebar", "sponsor", "sponsored", "subscribe", "subscription"}
#: Parts that make a class name a state of its element, not its content.
STATES = {"has", "with", "without", "no", "none", "hide", "is"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_OPENS = re.compile(r"</?[A-Za-z]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Characters of a place or text above which a token holds its digest; tokens of all templates above which they are not broadcast.
LONG, BROADCAST_TOKENS = 48, 500_000
#: Characters of a tag above which its judgement is not remembered.
REMEMBERED = 256
#: Tags of a place that its page's layout takes in; a token that every page has once.
SHALLOW, EVERY_PAGE = 3, "\n"
SEEN = pa.list_(pa.struct([("token", pa.string()), ("text", pa.bool_()), ("times", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
#: Labels of slots.
FURNITURE, MAIN_CONTENT, OPEN = "furniture", "main", "open"


def attributes(source: str) -> dict[str, str]:
    """A tag's attributes by lower-case name; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for a in _ATTRIBUTE.finditer(source):
        out.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
    return out


def marked_by(words: Iterable[str]) -> bool:
    """Whether class, id or role words mark an element: a mark as a whole, or a strong one as a part, but not of a state (``has-sidebar``)."""
    for word in words:
        parts = set(_PARTS.split(word))
        if word in MARKS or not parts.isdisjoint(STRONG) and parts.isdisjoint(STATES):
            return True
    return False


def judge(tag: str, source: str) -> tuple[str, bool, bool, bool]:
    """(tag with classes, in boilerplate, opens main content, marked) of a tag and its attributes by themselves."""
    has = attributes(source) if source else {}
    words = {k: has.get(k, "").lower().split() for k in ("class", "id", "role")}
    bad = tag in BOILERPLATE or "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(has.get("style", "")))
    marked = tag not in ("html", "body") and marked_by({w for own in words.values() for w in own})
    return ".".join([tag, *sorted(set(words["class"]))]), bad, tag in MAIN or "main" in words["role"], marked


#: Few tags are distinct, so those met are remembered.
remembered = lru_cache(maxsize=4096)(judge)


def blocks(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """What events gives of a page's text blocks."""
    return (e for e in events(page) if e[1] is not None)


def events(page: str) -> list[tuple[str, str | None, bool, bool]]:
    """(place, text, in main content, in boilerplate) of a page's elements (text None) and text blocks, in page order; place is the path of tags, with classes.

    Tags and hiding make boilerplate anywhere. Marks do so outside main content for what holds no main
    content, and inside it for the marked part; the main element itself is not judged by them.
    """
    out: list[tuple[str, str | None, bool, bool]] = []
    at = ("", False, False)
    stack = [("", False, False, False, at)]  # tag, in main content, in boilerplate by tag or hidden, by mark, (place, in main content, in boilerplate)
    words: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append((at[0], text, at[1], at[2]))

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.match(page, pos)
        if m.lastindex == 4 and m[4] == "<" and _OPENS.match(page, pos):
            m = _LOOSE.match(page, pos)  # a tag with a stray quote
            if m is None:  # a tag that never ends
                break
        pos = m.end()
        if m.lastindex == 4:  # text
            now = stack[-1][4]
            if now is not at and now != at:
                if words:
                    flush()
                at = now
            words.append(m[4])
            continue
        if m.lastindex is None:  # a comment or declaration
            continue
        closing, tag, source = m.group(1, 2, 3)
        tag = tag.lower()
        if tag == "br" or tag == "wbr" or tag == "img":
            words.append(" " if tag == "br" else "")
            continue
        inline = tag in INLINE
        if not inline and words:
            flush()
        if closing:
            if stack[-1][0] == tag:
                stack.pop()
            elif any(t == tag for t, *_ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in CLOSES_P:
            opened = len(stack) - 1
            while stack[opened][0] in INLINE:
                opened -= 1
            if stack[opened][0] == "p":
                del stack[opened:]
        if tag in SIBLINGS and stack[-1][0] == tag:
            stack.pop()
        if tag in VOID or tag in ("svg", "path") and source.rstrip().endswith("/"):
            continue
        _, main, bad, marked, (path, _, _) = stack[-1]
        name, own_bad, opens, own_mark = (remembered if len(tag) + len(source) <= REMEMBERED else judge)(tag, source)
        bad, marked, main = bad or own_bad, (main or not opens) and (marked or own_mark), main or opens
        if not inline:
            path = f"{path}/{name}" if path else name
        here = (path, main, bad or marked)
        stack.append((tag, main, bad, marked, here))
        if not inline:
            at = here
            out.append((path, None, main, here[2]))
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, pos)
            pos = end.end() if end else n
            stack.pop()
    if words:
        flush()
    return out


def short(part: str) -> str:
    """A place or text, or if it is long its start and digest."""
    return part if len(part) <= LONG else part[:8] + blake2b(part.encode("utf-8", "replace"), digest_size=12).hexdigest()


def layout(places: Iterable[str]) -> int:
    """A number for the set of places near the root."""
    near = sorted({"/".join(p.split("/", SHALLOW)[:SHALLOW]) for p in places})
    return int.from_bytes(blake2b("\n".join(near).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few ``rows``."""
    return F.broadcast(df) if rows <= BROADCAST_TOKENS else df


@lru_cache(maxsize=4096)
def digest(token: str) -> int:
    return int.from_bytes(blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def page_tokens(page: str) -> tuple[int, list[tuple[str, str | None, bool, bool]]]:
    """A page's layout and its tokens: (name, text, in main content, in boilerplate); a name is a place, or a text at a place, in short."""
    found = events(page)
    names = {place: short(place) for place in {place for place, *_ in found}}
    return layout(names), [(names[place] if text is None else f"{names[place]}\n{short(text)}", text, main, bad) for place, text, main, bad in found]


def occurrences(tokens: list[tuple[str, str | None, bool, bool]]) -> list[dict]:
    """Of each token: whether it is a text, how often it occurs, and the least and greatest digest of the once-a-page element that each occurrence follows."""
    keys = [(name, text is not None) for name, text, *_ in tokens]
    times = Counter(keys)
    out: dict[tuple[str, bool], dict] = {}
    follows = 0
    for key in keys:
        seen = out.get(key)
        if seen is None:
            out[key] = {"token": key[0], "text": key[1], "times": times[key], "first": follows, "last": follows}
        elif follows < seen["first"]:
            seen["first"] = follows
        elif follows > seen["last"]:
            seen["last"] = follows
        if not key[1] and times[key] == 1:
            follows = digest(key[0])
    return list(out.values())


def deduce_templates(pages: DataFrame, support: float = 0.5, least_pages: int = 4, least_tokens: int = 2) -> DataFrame:
    """(host, layout, token, text, once, follows) of the tokens of each layout's template, from pages (host, html).

    A class (tokens with one occurrence vector over the pages of a layout) is valid if at least ``least_pages`` of these
    and a ``support`` share have it and it has ``least_tokens`` tokens of which each, on that share of its pages, only
    follows one once-a-page element (``follows``, its digest; 0: none). ``text``: a text, not an element; ``once``: exactly once on every page, so that it
    belongs to the outermost class; the tokens of other classes nest in the slot after ``follows``. Equal pages of a host count once.
    """
    prepare(pages.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, layouts = [], []
            for source in utf8(batch, "html"):
                number, tokens = page_tokens((source or b"").decode())
                seen.append([{"token": EVERY_PAGE, "text": False, "times": 1, "first": 0, "last": 0}, *occurrences(tokens)])
                layouts.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(layouts, pa.int64()), pa.array(seen, SEEN)], names=["host", "page", "layout", "seen"])

    keyed = pages.select("host", F.xxhash64("html").alias("page"), "html")
    one = keyed.mapInArrow(cut, "host string, page long, layout long, seen array<struct<token string, text boolean, times int, first long, last long>>").dropDuplicates(["host", "page"])
    seen = one.select("host", "page", "layout", F.inline("seen"))
    vector = F.sum(F.xxhash64("page", "times").cast("decimal(38,0)"))
    alike = seen.groupBy("host", "layout", "token", "text", "first", "last").agg(vector.alias("vector"), F.count("*").alias("pages"))
    usual = F.max(F.when(F.col("first") == F.col("last"), F.struct("pages", F.col("first").alias("follows")))).alias("usual")
    counted = alike.groupBy("host", "layout", "token", "text").agg(F.sum("vector").alias("vector"), F.sum("pages").alias("pages"), usual)
    counted = counted.where(F.col("pages") >= least_pages).where(F.col("usual.pages") >= support * F.col("pages")).checkpoint()
    of_group = F.col("token") == EVERY_PAGE
    groups = counted.where(of_group).select(F.col("host").alias("__h"), F.col("layout").alias("__l"), F.col("pages").alias("all_pages"), F.col("vector").alias("every"))
    tokens = counted.where(~of_group).join(bounded(groups, groups.count()), (F.col("host") == F.col("__h")) & (F.col("layout") == F.col("__l")))
    tokens = tokens.where(F.col("pages") >= support * F.col("all_pages"))
    classes = tokens.groupBy("host", F.col("layout").alias("__l"), "vector", "pages").agg(F.collect_list(F.struct("token", "text", (F.col("vector") == F.col("every")).alias("once"), F.col("usual.follows").alias("follows"))).alias("members"))
    return classes.where(F.size("members") >= least_tokens).select("host", F.col("__l").alias("layout"), F.inline("members"))


def lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    """Lists of tuples as an array of lists of structs, made field by field: one object for each struct would cost more than parsing."""
    flat = [t for own in rows for t in own]
    columns = [pa.array([t[i] for t in flat], kind.field(i).type) for i in range(kind.num_fields)]
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(kind)))


def items(column: pa.ListArray) -> Iterator[list[tuple]]:
    """Each list of structs (null: empty) as a list of tuples, read field by field; NumPy makes the objects many times faster than to_pylist."""
    flat = list(zip(*(field.to_numpy(zero_copy_only=False).tolist() for field in column.flatten().flatten()), strict=True))
    at = 0
    for n in pc.list_value_length(column).to_pylist():
        yield flat[at : at + (n or 0)]
        at += n or 0


def page_slots(tokens: list[tuple[str, str | None, bool, bool]], template: dict[tuple[str, bool], bool]) -> list[tuple[str, bool, str, list[str]]]:
    """(template element that opens the slot, whether that is once a page, label, texts) of a page's slots, in order; template: once by (token, is text).

    A slot ends at the next template element, and where its label changes. Template texts are no slot's content, unless in main content.
    """
    out: list[tuple[str, bool, str, list[str]]] = []
    after, once = "", True
    for name, text, main, bad in tokens:
        if text is None:
            if (name, False) in template:
                after, once = name, template[name, False]
                out.append((after, once, FURNITURE if bad else MAIN_CONTENT if main else OPEN, []))
            continue
        label = FURNITURE if bad else MAIN_CONTENT if main else OPEN
        if label == OPEN and (name, True) in template:
            continue
        if not out or out[-1][2] != label:
            out.append((after, once, label, []))
        out[-1][3].append(text)
    return out


def cut_slots(pages: DataFrame) -> DataFrame:
    """page_id, url, slots (after, once, label, text) of every row's whole html (null: empty), cut at its template, which all pages of its host and layout tell.

    Null urls share a host; repeated rows are kept, as a page stays one row all the way.
    """
    prepare(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    keyed = pages.select("page_id", "url", "html", host.alias("host"))
    parsed = pa.struct([("name", pa.string()), ("text", pa.string()), ("main", pa.bool_()), ("bad", pa.bool_())])
    slot = pa.struct([("after", pa.string()), ("once", pa.bool_()), ("label", pa.string()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_tokens((source or b"").decode()) for source in utf8(batch, "html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), pa.array([n for n, _ in found], pa.int64()), lists([own for _, own in found], parsed)], names=["page_id", "url", "host", "layout", "tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            first = {key: i for i, key in reversed(list(enumerate(keys)))}
            told = items(batch.column(5).take(pa.array(list(first.values()), pa.int64())))
            templates = {key: {(name, text): once for name, text, once in own} for key, own in zip(first, told, strict=True)}
            cuts = (page_slots(tokens, templates[key]) for key, tokens in zip(keys, items(batch.column(4)), strict=True))
            out = [[(after, once, label, "\n".join(texts)) for after, once, label, texts in slots] for slots in cuts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(out, slot)], names=["page_id", "url", "slots"])

    template = deduce_templates(keyed).groupBy("host", "layout").agg(F.collect_list(F.struct("token", "text", "once")).alias("template")).checkpoint()
    size = template.select(F.sum(F.size("template"))).first()[0] or 0
    ids = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string"
    rows = keyed.mapInArrow(read, f"{ids}, host string, layout long, tokens array<struct<name string, text string, main boolean, bad boolean>>")
    told = rows.join(bounded(template, size), ["host", "layout"], "left").select("page_id", "url", "host", "layout", "tokens", "template")
    return told.mapInArrow(cut, f"{ids}, slots array<struct<after string, once boolean, label string, text string>>")


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row's whole html (null: empty); text is empty if there is none.

    Blocks in page order, one line each, white space inside a block as one space: those of the page's slots (see
    cut_slots) in main content, or, on a page without, of its slots that nothing labels.
    """
    texts = lambda label: F.transform(F.filter("slots", lambda s: (s["label"] == label) & (s["text"] != "")), lambda s: s["text"])
    main = texts(MAIN_CONTENT)
    text = F.array_join(F.when(F.size(main) > 0, main).otherwise(texts(OPEN)), "\n")
    return cut_slots(pages).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_extract(spark, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))
