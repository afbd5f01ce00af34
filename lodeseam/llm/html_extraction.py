"""HTML extraction by equivalence-class template deduction.

Tokens are elements, by their path of tags and classes, and runs of words, by the path and the text of their block. Tokens with the same occurrence vector over the pages of a host
(how often in each page) form an equivalence class. A class is valid if ``LEAST_SUPPORT`` of the pages have it and it has ``LEAST_SIZE`` tokens, an element among them; runs of words that
``TEXT_SUPPORT`` of the pages have need no second token. Classes nest: the largest class that occurs once in a page is the root, others lie in the slots of its elements.
The template of a host is what its valid classes hold: runs of words of the template are template wherever they stand, and leave the text; what is left varies and fills the
slots. The main text is in the articles (or main elements) of the template, else in the deepest root element that encloses all text which varies and is neither of links nor outside an
article. From these slots the blocks are extracted.

Elements that HTML itself sets apart (``OUTSIDE``) and hidden ones are dropped everywhere. The lists of class words only label: on a host with a template they drop elements of the
template with such a class, id or role (what varies there, as reader comments do, no vector tells from an article), and no others; where a host has no template (column ``templated``) they
drop what they match. A paragraph, heading, item or cell is matched by its whole name only.

A page of which the template would leave less than ``LEAST_VARYING`` of its main text is a copy of other pages rather than a template with content, and keeps its words.

Scale: an occurrence vector is never gathered: it is a hash over (page, count) added up per (host, token), combined before the shuffle, so that a host
with a third of all pages is no hot key. A host keeps only tokens that half its pages have. Templates go to their pages broadcast if their measured
number and size are at most ``BROADCAST_HOSTS`` and ``BROADCAST_PARTS``, else by an equi-join that splits hot hosts.

Cases: a null or blank page gives an empty text; a page without a host forms a host of its own kind; a host with fewer than ``LEAST_PAGES`` pages has no
template and the page's own structure decides; broken markup, unclosed elements and cut pages are read as far as they go; repeated rows count as pages;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import durable, table

LEAST_PAGES = 3
LEAST_SUPPORT, TEXT_SUPPORT = 0.5, 0.8
LEAST_SIZE = 2
LEAST_VARYING = 0.2
BROADCAST_HOSTS, BROADCAST_PARTS = 20_000, 500_000
#: Deeper elements count as their parent.
DEPTH = 40

# fixed values: elements of HTML by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg select option datalist object canvas audio video".split())
OUTSIDE = frozenset("nav footer aside form button dialog menu head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of a class, id or role that mark what is no part of an article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored sidebar comment comments disqus cookie cookies consent gdpr newsletter related recommended breadcrumb breadcrumbs nav navbar navigation footer masthead".split())
#: Words that do so unless a word of KEEPS stands beside them.
WEAK = frozenset("banner promo promotion aside respond reply replies notice notices alert popup modal overlay subscribe subscription signup share sharing social pagination pager menu toolbar widget login search copyright skip".split())
KEEPS = frozenset("article main content post entry story text".split())
#: Elements that hold text of their own: only a whole class, id or role marks them.
OWN_TEXT = frozenset("article blockquote dd dt figcaption figure h1 h2 h3 h4 h5 h6 li p pre td th".split())

#: What makes a form the frame of a page instead of a part of it, and where a form ends.
_ARTICLE, _FORM_END = re.compile(r"<(?:article|main|h1)\b", re.I), re.compile(r"</form\s*>", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


@dataclass
class Element:
    tag: str
    path: str
    depth: int
    marked: bool = False
    outside: bool = False
    article: bool = False
    raw: bool = False


@dataclass
class Stat:
    """Of a token in one page: times, characters of text, in elements that are no part of an article, and else in links; whether a mark stands on it."""

    times: int = 0
    text: int = 0
    links: int = 0
    outside: int = 0
    marked: bool = False


@dataclass(frozen=True)
class Template:
    """Of a host: the paths of the slots with the main text, those of marked elements, and the runs of words (``run_hash``)."""

    slots: tuple[str, ...] = ()
    marked: frozenset[str] = frozenset()
    runs: frozenset[int] = frozenset()


def run_hash(path: str, text: str) -> int:
    """The token of a run of words at a path, as a signed long."""
    import xxhash

    h = xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _attributes(tag: str, text: str) -> tuple[tuple[str, ...], bool, bool, bool]:
    """Class names, whether a mark stands among the words of class, id or role, whether the element is hidden, and whether it is called a header."""
    classes: tuple[str, ...] = ()
    words: set[str] = set()
    hidden = False
    for name, *values in _ATTRIBUTE.findall(text):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif value:
            if name == "class":
                classes = tuple(sorted(value.split()))
            words.update(value.lower().split() if tag in OWN_TEXT else (w.lower() for w in _WORD.findall(value)))
    return classes, bool(words & MARKS or words & WEAK and not words & KEEPS), hidden, bool(words & {"header"})


def parse(page: str, labels: Collection[str] | None = None) -> Iterator[tuple[str, Element, str]]:
    """Events ``(kind, element, text)``: ``open``, ``close`` and ``text`` with the element that it stands in. Marks count at the paths ``labels`` (None: everywhere)."""
    top = Element("", "", 0)
    stack = [top]
    at, end = 0, len(page)
    articles: list[int] | None = None  # places in the page, once there is a form
    form_ends: list[int] = []

    def close(down_to: int) -> Iterator[tuple[str, Element, str]]:
        while len(stack) > down_to:
            yield "close", stack.pop(), ""

    for m in _TOKEN.finditer(page):
        if m.start() < at:  # inside a raw element
            continue
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if where:
                yield from close(where)
            continue
        attributes = m[3] or m[6] or ""
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    yield from close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "body", "main", "td"):
                    break
        up = stack[-1]
        classes, marked, hidden, header = _attributes(tag, attributes) if attributes and attributes != "/" else ((), False, False, False)
        deep = up.depth >= DEPTH
        path = up.path if deep else f"{up.path}/{tag}" + "".join(f".{c}" for c in classes)
        article = up.article or tag in ("article", "main")
        marked = marked and tag not in ("html", "body", "main")
        outer = tag in OUTSIDE
        if tag == "form" and not up.outside:  # one that is wrapped around an article is no part of the page to leave out
            if articles is None:
                articles, form_ends = ([m.start() for m in p.finditer(page)] for p in (_ARTICLE, _FORM_END))
            inner, ended = bisect.bisect(articles, at), bisect.bisect(form_ends, at)
            outer = not (inner < len(articles) and articles[inner] < (form_ends[ended] if ended < len(form_ends) else end))
        outside = up.outside or outer or hidden or (tag == "header" or header) and not article or marked and (labels is None or path in labels)
        element = Element(tag, path, up.depth + (not deep), marked, outside, article, tag in RAW)
        yield "open", element, ""
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            yield "close", element, ""
        elif element.raw:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            yield "close", element, ""
        else:
            stack.append(element)
    if at < end:
        yield "text", stack[-1], page[at:]
    yield from close(1)


def _squeezed(run: list[str]) -> str:
    whole = "".join(run)
    return " ".join((html.unescape(whole) if "&" in whole else whole).split())


def token_stats(page: str) -> dict[tuple[str, int], Stat]:
    """The tokens of a page: elements (path, 0) with the text that each encloses, and runs of words (path of the block, ``run_hash``)."""
    stats: dict[tuple[str, int], Stat] = {}
    open_paths: list[str] = []
    links = 0
    run: list[str] = []
    linked = outside = 0

    def flush() -> None:
        nonlocal linked, outside
        text, path = _squeezed(run) if run else "", open_paths[-1] if open_paths else ""
        run.clear()
        if text:
            s = stats.setdefault((path, run_hash(path, text)), Stat())
            s.times, s.text, s.links = s.times + 1, s.text + len(text), s.links + min(linked, len(text))
        if text or outside:
            for p in set(open_paths[-DEPTH:]):
                e = stats[p, 0]
                e.text, e.links, e.outside = e.text + len(text) + outside, e.links + min(linked, len(text)), e.outside + outside
        linked = outside = 0

    for kind, element, text in parse(page):
        if kind == "text":
            if element.outside:
                outside += len(text.strip())
            else:
                run.append(text)
                linked += len(text.strip()) if links else 0
            continue
        if element.tag == "br":
            run.append(" ")
        if element.tag not in BLOCKS:
            links = max(0, links + (element.tag == "a") * (1 if kind == "open" else -1))
            continue
        flush()
        if kind == "open":
            s = stats.setdefault((element.path, 0), Stat())
            s.times, s.marked = s.times + 1, s.marked or element.marked
            if not element.raw and element.tag not in VOID:
                open_paths.append(element.path)
        elif open_paths and open_paths[-1] == element.path:
            open_paths.pop()
    flush()
    return stats


def outermost(paths: list[str]) -> list[str]:
    """``paths`` without those below another one, each once."""
    return [p for p in dict.fromkeys(paths) if not any(p.startswith(f"{q}/") for q in paths)]


def main_blocks(page: str | None, template: Template | None = None) -> list[str]:
    """The blocks of the main text: of the template's slots as far as the page has them, else of its articles, main or body; without the template's words."""
    page = page or ""
    events = list(parse(page, None if template is None else template.marked))
    opened = {e.path: e for kind, e, _ in events if kind == "open"}
    slots = [s for s in (template.slots if template else ()) if s in opened and not opened[s].outside]
    for tag in ("article", "main"):
        slots = slots or outermost([e.path for e in opened.values() if e.tag == tag and not e.outside])
    blocks: list[tuple[str, str]] = []
    open_paths: list[str] = [""]
    run: list[str] = []

    def flush() -> None:
        if run:
            text = _squeezed(run)
            run.clear()
            if text:
                blocks.append((open_paths[-1], text))

    inside = 0
    for kind, element, text in events:
        if kind == "text":
            if (inside or not slots) and not element.outside:
                run.append(text)
            continue
        if element.tag == "br":
            run.append(" ")
        elif element.tag in BLOCKS:
            flush()
            if kind == "open" and not element.raw and element.tag not in VOID:
                open_paths.append(element.path)
            elif kind == "close" and open_paths[-1] == element.path:
                open_paths.pop()
        if element.path in slots and not element.raw:
            inside = max(0, inside + (1 if kind == "open" else -1))
    flush()
    texts = [text for _, text in blocks]
    if template is None or not template.runs:
        return texts
    own = [text for path, text in blocks if run_hash(path, text) not in template.runs]
    return own if sum(map(len, own)) >= LEAST_VARYING * sum(map(len, texts)) else texts


def templates(pages: DataFrame) -> DataFrame:
    """``(host, slots, marked, runs, root, nested)`` per host from ``pages`` (columns ``host``, ``page``, ``html``): a ``Template``, the paths of the root class, and the
    number of tokens of the classes nested in it."""
    names = ["host", "page", "path", "words", "times", "text", "links", "outside", "marked", "place"]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = []
                for host, page, text in zip(*(b.column(c).slice(at, 500).to_pylist() for c in ("host", "page", "html")), strict=True):
                    rows += [(host, page, path, words, s.times, s.text, s.links, s.outside, s.marked, i) for i, ((path, words), s) in enumerate(token_stats(text or "").items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names)

    tokens = pages.mapInArrow(run, "host string, page long, path string, words long, times int, text long, links long, outside long, marked boolean, place int")
    vectors = tokens.groupBy("host", "path", "words").agg(
        F.count(F.lit(1)).alias("support"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.max("times").alias("most"),
        F.sum("text").alias("text"), F.sum("links").alias("links"), F.sum("outside").alias("outside"), F.min("place").alias("place"), F.max("marked").alias("marked"),
    ).where(F.col("support") >= LEAST_PAGES)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    frequent = vectors.join(totals, "host").where(F.col("support") >= F.col("pages") * LEAST_SUPPORT)
    token = F.struct("place", "path", "words", "text", "links", "outside", "marked", "most", (F.col("support") >= F.col("pages") * TEXT_SUPPORT).alias("common"))
    classes = frequent.groupBy("host", "vector", "support").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    per_host = classes.groupBy("host").agg(F.collect_list(F.struct("support", "tokens")).alias("classes"))
    return _nested(per_host)


def _nested(per_host: DataFrame) -> DataFrame:
    names = ["host", "slots", "marked", "runs", "root", "nested"]
    kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                elements = [[t for t in c["tokens"] if not t["words"]] for c in r["classes"]]
                valid = [len(c["tokens"]) >= LEAST_SIZE and bool(own) for c, own in zip(r["classes"], elements, strict=True)]
                once = [i for i, own in enumerate(elements) if valid[i] and own[0]["most"] == 1]
                root = max(once, key=lambda i: (len(elements[i]), r["classes"][i]["support"]), default=None)
                if root is None:
                    continue
                paths = [t["path"] for t in elements[root]]
                # of other classes, what lies within an element of the root
                within = [t for i, c in enumerate(r["classes"]) for t in c["tokens"] if i == root or any(f"{t['path']}/".startswith(f"{p}/") for p in paths)]
                in_class = {(t["path"], t["words"]) for c, ok in zip(r["classes"], valid, strict=True) if ok for t in c["tokens"]}
                runs = [t for t in within if t["words"] and (t["common"] or (t["path"], t["words"]) in in_class)]
                marked = [t["path"] for own in elements for t in own if t["marked"]]
                rows.append((r["host"], choose_slots(elements[root], runs), marked, [t["words"] for t in runs], paths, len(within) - len(r["classes"][root]["tokens"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names)

    return per_host.mapInArrow(run, "host string, slots array<string>, marked array<string>, runs array<long>, root array<string>, nested int")


def choose_slots(elements: list[dict], runs: list[dict] = ()) -> list[str]:
    """The root elements that enclose the main text: all articles or main elements with text that varies (neither of links, nor outside an article, nor in ``runs``), else
    the deepest element with all such text."""
    plain = lambda t: t["text"] - t["links"] - t["outside"]
    own = lambda t: plain(t) - sum(max(0, plain(x)) for x in runs if f"{x['path']}/".startswith(f"{t['path']}/"))
    count = own if any(own(t) > 0 for t in elements) else plain  # pages that are all the same
    most = max((count(t) for t in elements), default=0)
    best: list[str] = []
    for t in sorted(elements, key=lambda t: t["path"].count("/")):
        if count(t) == most > 0:
            best = [t["path"]]
    named = outermost([t["path"] for t in elements if t["path"].rsplit("/", 1)[-1].split(".")[0] in ("article", "main") and plain(t) > 0])
    return named or best


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``(key, url, text, n_chars, templated)`` of every page."""
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(markup).alias("html"), F.coalesce(F.lower(F.regexp_extract(url, r"^[^/]*//([^/?#]*)", 1)), F.lit("")).alias("host"))
    known = durable(templates(own.select("host", F.coalesce(F.xxhash64("key", "url"), F.lit(0)).alias("page"), "html")).select("host", "slots", "marked", "runs"))
    hosts = known.select(F.col("host").alias("_ls_host"), "slots", "marked", "runs")
    size = known.agg(F.count(F.lit(1)), F.sum(F.size("slots") + F.size("marked") + F.size("runs"))).first()
    if size[0] <= BROADCAST_HOSTS and (size[1] or 0) <= BROADCAST_PARTS:  # a part is a path of at most DEPTH steps or a hash
        hosts = F.broadcast(hosts)
    joined = own.join(hosts, F.col("host") == F.col("_ls_host"), "left").select("key", "url", "html", "_ls_host", "slots", "marked", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[str, Template] = {}  # of the batch's hosts

        def template(host: str | None, *parts: list | None) -> Template | None:
            if host is None:
                return None
            if host not in built:
                built[host] = Template(tuple(parts[0]), frozenset(parts[1]), frozenset(parts[2]))
            return built[host]

        for b in batches:
            built.clear()
            texts = []
            for at in range(b.num_rows):
                h, host = b.column("html")[at].as_py(), b.column("_ls_host")[at].as_py()
                found = built.get(host) or template(host, *(b.column(c)[at].as_py() for c in ("slots", "marked", "runs")))
                texts.append("\n\n".join(main_blocks(h, found)))
            templated = pa.array([x is not None for x in b.column("_ls_host").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), templated], ["key", "url", "text", "n_chars", "templated"])

    out = joined.mapInArrow(run, f"key {own.schema['key'].dataType.simpleString()}, url string, text string, n_chars long, templated boolean")
    return out.withColumnRenamed("key", key)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
