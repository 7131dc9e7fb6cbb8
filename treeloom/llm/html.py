"""Main text of web pages by wrappers that are inferred from the pages of each host.

A page becomes a stream of block tags and text slots, nested as the tags are. The streams of one host are aligned,
element by element, into a wrapper: a union-free regular expression in which neighbours of one shape are a repeated
group, what some pages lack is optional, and elements that come in changing order are a repeated group of optional ones.
Each shape stands once in its parent, so that an alignment merges two sequences in linear time.

A slot of the wrapper keeps on how many pages it occurs, how much text and link text it has, and its most frequent texts.
Each page is matched against its host's wrapper, and the slots that its text falls into decide: a text that stands in its
slot on most pages is the template's, a slot of links is a menu, and the rest weighs what the host's pages have there on
average. The article is what article and main elements hold, or the innermost element that holds nearly all of that
weight, without the template's texts. Elements and class names that say "not the article" (nav, footer, comments, ...)
are left out, names only as long as the weight is elsewhere.

Wrappers are inferred in each task, then by host in two steps; what moves is one small wrapper a host and task, however
many pages a host has. Every page goes into its host's wrapper.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import batches, lean, small, small_batches, written

#: Elements by how they are treated.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object audio video canvas select option button".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a start tag closes if they are the innermost block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that are never the article's, and those that an article or its parts are made of and that are not searched for a narrower one.
OTHER_TAGS = set("nav header footer aside form menu dialog head".split())
WHOLE = set("p li ul ol dl dt dd tr blockquote pre h1 h2 h3 h4 h5 h6 figure".split())
#: Words of class and id of what isn't the article: sure ones, and others that count while a quarter of the weight is elsewhere.
SURE = set(
    "nav navbar navigation menu menubar footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr"
    " comment comments respond replies reply discussion disqus related recommended recommendations breadcrumb breadcrumbs pagination newsletter hidden".split()
)
LIKELY = set("topbar header masthead side rail banner promotion promoted notice notices notification alert popup modal overlay subscribe subscription signup share sharing social widget toolbar login search copyright skip paywall pager".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")

#: Deepest element that counts as one; what is deeper belongs to its ancestor of that depth.
DEEPEST = 60
#: Shapes that an element of a wrapper tells apart by class and content; further ones are told apart by element.
SHAPES = 200
#: Pages with a slot from which a text counts as the template's, and on which part of them it must be the same.
TEMPLATE_PAGES, TEMPLATE_SHARE = 4, 0.7
#: Texts that a slot remembers while a wrapper is inferred: the most frequent ones.
TEXTS = 64
#: Part of the weight that one child must hold so that the article is looked for in it.
NEARLY_ALL = 0.8


class Run:
    """A stretch of text in an element, between block tags."""

    __slots__ = ("chars", "links", "pieces")

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.chars = self.links = 0

    @property
    def key(self) -> str:
        return "#a" if 2 * self.links > self.chars else "#"

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.pieces)).split())

    def hash(self) -> str:
        return f"{zlib.crc32(self.text().encode('utf-8', 'surrogatepass')):x}"


class Element:
    """An element and what it holds, in page order."""

    __slots__ = ("chars", "key", "kids", "links", "sign", "tag", "words")

    def __init__(self, tag: str, words: tuple[str, ...]) -> None:
        self.tag, self.words = tag, frozenset(words)
        self.sign = f"{tag}.{'.'.join(words)}" if words else tag
        self.kids: list[Element | Run] = []
        self.chars = self.links = 0
        self.key = self.sign

    def end(self) -> None:
        """Sum up, and name the shape: elements without class are told apart by what they hold."""
        marks = set()
        for kid in self.kids:
            self.chars += kid.chars
            self.links += kid.links
            marks.add(kid.key if isinstance(kid, Run) else f"{kid.sign}:a" if kid.chars and 2 * kid.links > kid.chars else kid.sign)
        if not self.words and self.tag not in ("html", "body", "main", "article"):
            self.key = f"{self.sign}{{{','.join(sorted(marks)[:8])}}}"


def _words_of(rest: str) -> tuple[str, ...]:
    """The words of class, id and role; digits don't count."""
    words: list[str] = []
    if rest.strip():
        for m in _NAMED.finditer(rest):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                words.append("hidden")
            elif key in ("class", "id", "role"):
                words += _WORDS.findall(value)
    return tuple(dict.fromkeys(words))


def parse(source: str | None) -> Element:
    """The stream of a page, nested; tolerant of unclosed and stray tags."""
    root = Element("", ())
    stack, links, at, deeper = [root], 0, 0, 0
    text, n = source or "", len(source or "")
    run: Run | None = None

    def add(piece: str) -> None:
        nonlocal run
        size = 0 if piece.isspace() else len(piece)
        if run is None:
            if not size:
                return
            run = Run()
            stack[-1].kids.append(run)
        run.pieces.append(piece)
        run.chars += size
        run.links += size if links else 0

    def leave(k: int) -> None:
        while len(stack) > k:
            stack.pop().end()

    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            add(text[at:])
            break
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            if m["cdata"]:
                add(m["cdata"].replace("&", "&amp;"))
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, closing, rest = name.lower(), bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        if name in RAW:
            if not closing and not rest.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
                at = close.end() if close else n
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else 1
            continue
        if name in VOID:
            if name == "br":
                add(" ")
            elif name == "hr":
                run = None
            continue
        links, run = 0, None
        if closing:
            if deeper and name != stack[-1].tag:
                deeper -= 1
                continue
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            if k:
                leave(k)
                deeper = 0
            continue
        if stack[-1].tag == "p":
            leave(len(stack) - 1)
        while stack[-1].tag in CLOSES.get(name, ()):
            leave(len(stack) - 1)
        if len(stack) > DEEPEST:
            deeper += 1
            continue
        element = Element(name, _words_of(rest))
        stack[-1].kids.append(element)
        stack.append(element)
    leave(0)
    return root


# A wrapper's element is {"n": pages with it, "k": {key: {"r": 1 if repeated, ...}}, "o": 1 if its order changes}; a slot is
# {"n": pages, "c": characters, "l": those in links, "t": {hash of a text: pages with it}}.


def _known(kids: dict, key: str) -> str:
    """The key under which a shape is kept."""
    return key if key in kids or len(kids) < SHAPES or key[0] == "#" else f"{re.split('[.{]', key, maxsplit=1)[0]}*"


def expression(element: Element) -> dict:
    """The wrapper of one page."""
    kids: dict[str, dict] = {}
    out = {"n": 1, "k": kids}
    last = None
    for kid in element.kids:
        key = _known(kids, kid.key)
        if isinstance(kid, Run):
            own = {"n": 1, "c": kid.chars, "l": kid.links, "t": {kid.hash(): 1}}
        else:
            own = expression(kid)
        if key not in kids:
            kids[key] = own
        else:
            kids[key] = _together(kids[key], own)
            kids[key]["r"] = 1
            if last != key:
                out["o"] = 1
        last = key
    return out


def _together(a: dict, b: dict) -> dict:
    """Two neighbours of one shape on one page as one repeated group."""
    if "t" in a:
        a["t"].update(b["t"])
        return {"n": 1, "c": a["c"] + b["c"], "l": a["l"] + b["l"], "t": a["t"]}
    return _merged(a, b, _together, {"n": 1})


def _merged(a: dict, b: dict, inner, out: dict) -> dict:  # noqa: ANN001
    """a with b's shapes in their places: common ones aligned by inner, new ones after what they follow in b."""
    kids, order = dict(a["k"]), list(a["k"])
    place = {key: k for k, key in enumerate(order)}
    changed = a.get("o") or b.get("o")
    new: dict[str | None, list[str]] = {}
    last, highest = None, -1
    for raw, other in b["k"].items():
        key = _known(kids, raw)
        if key in kids:
            own = inner(kids[key], other)
            if kids[key].get("r") or other.get("r"):
                own["r"] = 1
            kids[key] = own
            if key in place:
                if place[key] < highest:
                    changed = 1
                highest = max(highest, place[key])
                last = key
        else:
            kids[key] = other
            new.setdefault(last, []).append(key)
    if new:
        order = [*new.get(None, ()), *(key for old in order for key in (old, *new.get(old, ())))]
        kids = {key: kids[key] for key in order}
    out["k"] = kids
    if changed:
        out["o"] = 1
    return out


def aligned(a: dict, b: dict) -> dict:
    """The wrapper that matches what either matches."""
    if "t" in a:
        counts = dict(a["t"])
        for text, n in b["t"].items():
            counts[text] = counts.get(text, 0) + n
        if len(counts) > TEXTS:
            counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TEXTS])
        return {"n": a["n"] + b["n"], "c": a["c"] + b["c"], "l": a["l"] + b["l"], "t": counts}
    return _merged(a, b, aligned, {"n": a["n"] + b["n"]})


def finished(wrapper: dict) -> dict:
    """The wrapper with the template's texts only: those that stand in their slot on most pages."""
    if "t" in wrapper:
        n = wrapper["n"]
        return wrapper | {"t": {t: k for t, k in wrapper["t"].items() if n >= TEMPLATE_PAGES and k >= TEMPLATE_SHARE * n}}
    return wrapper | {"k": {key: finished(kid) for key, kid in wrapper["k"].items()}}


def shown(wrapper: dict) -> str:
    """The wrapper as a regular expression: (...)+ for repeated, (...)? for optional."""
    parts = []
    for key, kid in wrapper["k"].items():
        part = key if "t" in kid else f"{key}({shown(kid)})"
        part = f"({part})+" if kid.get("r") else part
        parts.append(f"({part})?" if kid["n"] < wrapper["n"] else part)
    return f"({' '.join(parts)})+" if wrapper.get("o") else " ".join(parts)


class _Match:
    """A run of a page and what its slot says."""

    __slots__ = ("likely", "linked", "listed", "run", "sure", "tagged", "template", "weight")


def _matched(element: Element, wrapper: dict | None, tagged: bool, sure: bool, likely: bool, listed: bool, out: list, slots: dict) -> None:
    kids = wrapper["k"] if wrapper else {}
    for kid in element.kids:
        slot = kids.get(kid.key) or kids.get(_known(kids, kid.key)) if kids else None
        if isinstance(kid, Run):
            m = _Match()
            m.run, m.tagged, m.sure, m.likely, m.listed = kid, tagged, sure, likely, listed
            n, chars, links = (slot["n"], slot["c"], slot["l"]) if slot else (1, kid.chars, kid.links)
            m.linked = 2 * links > chars
            m.template = bool(slot) and bool(slot["t"]) and kid.hash() in slot["t"]
            m.weight = 0.0 if m.linked else (chars - links) / n
            slots.setdefault(id(slot) if slot else id(m), []).append(m)
            out.append(m)
        else:
            # what stands around the main element says nothing by its names, and around an article only sure ones do
            own = kid.words
            around = kid.tag in ("html", "body") or bool(own) and next(_outermost(kid, "main"), None) is not None
            is_sure = not around and not SURE.isdisjoint(own)
            is_likely = not around and not LIKELY.isdisjoint(own) and next(_outermost(kid, "article"), None) is None
            _matched(kid, slot, tagged or kid.tag in OTHER_TAGS or "hidden" in own, sure or is_sure, likely or is_likely, listed or kid.tag in ("ul", "ol", "menu"), out, slots)


def text_of(page: Element, wrapper: dict) -> str:
    """The blocks of the page's article: references decoded, white space as one space, joined by line ends."""
    found: list[_Match] = []
    slots: dict[int, list[_Match]] = {}
    _matched(page, wrapper, False, False, False, False, found, slots)
    for same in slots.values():  # a slot's weight is shared by what the page has there
        for m in same:
            m.weight /= len(same)
    left = [m for m in found if not m.tagged]
    for name, least in (("sure", 0.05), ("likely", 0.25)):
        rest = [m for m in left if not getattr(m, name)]
        if rest and sum(m.weight for m in rest) >= least * sum(m.weight for m in left):
            left = rest
    # on a host of copies the article's texts are on most pages as well
    own = sum(m.weight for m in left if not m.template)
    varied = own > 0 and own >= 0.3 * sum(m.weight for m in left)
    weight = {id(m.run): m.weight for m in left if not (varied and m.template)}
    sums: dict[int, float] = {}
    total = _summed(page, weight, sums)
    chosen, labelled = _article(page, sums, total) if total else ([page], False)
    inside = {id(run) for element in chosen for run in _runs(element)}
    blocks = [m.run.text() for m in left if id(m.run) in inside and (labelled or not (varied and m.template)) and not (m.linked and (m.listed or not labelled))]
    return "\n".join(block for block in blocks if block)


def _runs(element: Element) -> Iterator[Run]:
    for kid in element.kids:
        if isinstance(kid, Run):
            yield kid
        else:
            yield from _runs(kid)


def _summed(element: Element, weight: dict[int, float], sums: dict[int, float]) -> float:
    sums[id(element)] = sum(weight.get(id(kid), 0.0) if isinstance(kid, Run) else _summed(kid, weight, sums) for kid in element.kids)
    return sums[id(element)]


def _outermost(element: Element, tag: str) -> Iterator[Element]:
    for kid in element.kids:
        if isinstance(kid, Element):
            if kid.tag == tag:
                yield kid
            else:
                yield from _outermost(kid, tag)


def _article(page: Element, sums: dict[int, float], total: float) -> tuple[list[Element], bool]:
    """The elements that hold the article, and whether article or main elements say so."""
    mains = [e for e in _outermost(page, "main") if sums[id(e)]]
    articles = [e for e in _outermost(page, "article") if sums[id(e)]]
    held = lambda elements: sum(sums[id(e)] for e in elements)
    if held(articles) >= 0.25 * total and 2 * held(articles) >= held(mains):
        return articles, True
    if held(mains) >= 0.25 * total:
        return mains, True
    element = page
    while True:
        kids = [kid for kid in element.kids if isinstance(kid, Element)]
        best = max(kids, key=lambda kid: sums[id(kid)], default=None)
        if best is None or best.tag in WHOLE or sums[id(best)] < NEARLY_ALL * sums[id(element)]:
            return [element], False
        if any(kid is not best and sums[id(kid)] and (kid.key == best.key or kid.tag == "h1") for kid in kids):
            return [element], False
        element = best


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without user and port; '' for null."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper, as JSON, of all pages (url, html) of each host."""
    salted = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])

    def fold(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % 16
        held: dict[str, dict] = {}
        for batch in source:
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, own = host_of(url), expression(parse(html))
                held[host] = aligned(held[host], own) if host in held else own
                if len(held) > 20_000:
                    yield from ((h, salt, json.dumps(w)) for h, w in held.items())
                    held.clear()
        yield from ((h, salt, json.dumps(w)) for h, w in held.items())

    def whole(table: pa.Table) -> dict:
        texts = sorted(table.column("wrapper").to_pylist())
        return reduce(aligned, map(json.loads, texts))

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"host": [table.column("host")[0].as_py()], "wrapper": [json.dumps(whole(table))]})

    def last(table: pa.Table) -> pa.Table:
        return pa.table({"host": [table.column("host")[0].as_py()], "wrapper": [json.dumps(finished(whole(table)))]})

    each = pages.select("url", "html").mapInArrow(lean(lambda source: batches(fold(source), salted, 500)), "host string, salt int, wrapper string")
    return each.groupBy("host", "salt").applyInArrow(merged, "host string, wrapper string").groupBy("host").applyInArrow(last, "host string, wrapper string")


@lru_cache(256)
def _loaded(wrapper: str) -> dict:
    return json.loads(wrapper)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages (page_id, url, html).

    text is the main text of the whole page, '' if there is none (null or empty html as well); n_chars counts its code
    points. Pages with a null URL are a host of their own. Repeated rows give repeated results; other columns are not
    looked at.
    """
    small_batches(pages.sparkSession)
    found = written(wrappers(pages), "wrappers")

    @F.pandas_udf("string")
    def host(column):  # noqa: ANN001, ANN202
        return column.map(host_of)

    joined = pages.select("page_id", "url", "html", host("url").alias("host")).join(small(found), "host", "left").select("page_id", "url", "html", "wrapper")

    @F.pandas_udf("string")
    def text(html, wrapper):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([text_of(parse(h), _loaded(w)) for h, w in zip(html, wrapper, strict=True)], dtype=object)

    return joined.withColumn("text", text("html", "wrapper")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
