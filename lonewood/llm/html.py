"""Main text of web pages by removal of the site's template.

1. Every page is parsed into elements.  Each element has a hash of its subtree (tags,
   classes and text).
2. Spark counts on how many different pages of a host each hash occurs (equal html is one
   page).  A subtree that recurs on many pages of its host is template and goes.  In the
   article that holds for containers only, and only if they hold less than half of its text: a
   paragraph is content even if other pages have it too.
3. Elements that are never main text by their tag or class (menus, headers, footers,
   sidebars, notices, adverts, forms, reader comments) go on any site, also one of a single
   page, with all that is in them, articles too.  But if every ``article`` and ``main`` of the page lies in such
   elements, they are wrappers: the largest article stays with all around it.  A form that
   holds a page's structure is a wrapper, and a menu or sidebar without an end tag ends
   where an article begins.  Headings and paragraphs of the article go as adverts only.
4. The blocks that stay, those in the articles if the page has one, are the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, spread_join, staged, tidy

MIN_PAGES = 5
MIN_SHARE = 0.3

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title"  # to the end of the page if unclosed, as in HTML
#: Without main text from their start to their end tag; an unclosed one is no element.
SKIPPED = "noscript|template|iframe|svg|math|select|object|canvas|audio|video"
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
NEVER = frozenset("nav footer aside form menu dialog button fieldset datalist".split())
MAIN = frozenset(("article", "main"))
FORMS = frozenset(("form", "fieldset"))
#: Without an end tag they end where an article begins.
OPEN_ENDED = frozenset("nav aside button menu dialog footer header form fieldset".split())
#: Text blocks: content wherever the article has them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead pre blockquote figcaption caption b i em strong a span br q code summary".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Paragraphs and headings: never dropped by their class in the article.
LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Classes, ids and roles that mark what is never main text; also several of them joined, or
#: with words of ``PLACES``.
MARKS = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation
    breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe subscription signup login share sharing
    social related recommended comment comments commentlist disqus replies pagination pager toolbar widget widgets contentinfo complementary search""".split())
#: Marks that go for headings, paragraphs and words of the article as well.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored".split())
#: Marks that name a part of the article if they are in one.
HEADS = frozenset("header masthead banner".split())
#: Marks that may be joined with words of ``POSTS`` ("related-posts", "post-comments").
AROUND = MARKS - HEADS
POSTS = frozenset("post posts article articles story stories entry entries news".split())
#: What makes a form a wrapper of the page.
STRUCTURE = frozenset("nav header footer main article h1".split())
#: Words that a mark may be joined with ("sidebar-left", "site-footer", "widget-area").
PLACES = frozenset("site page main global primary secondary top bottom area list box bar wrap wrapper container block section slot inner item items link links".split())
#: Sides: only after a mark; before it they name a layout ("left-sidebar").
SIDES = frozenset(("left", "right"))

_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z) | <(?P<raw>{RAW})(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)> | <[!?/][^>]*> | </?[a-zA-Z][^>]*>""", re.S | re.I | re.X)
_SKIPPED = re.compile(rf"""<!--.*?(?:-->|\Z) | <(?P<raw>{RAW})(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))
    | <(?P<end>/?)(?P<tag>{SKIPPED})(?=[\s/>])(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S | re.I | re.X)
_SKIPPED_TAGS = frozenset(SKIPPED.split("|"))
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "key", "parts", "up", "first", "last", "main", "article", "never", "marked", "closed", "structure", "entry")

    def __init__(self, tag: str, key: str, up: Element | None, first: int, article: bool = False, never: bool = False, marked: bool = False):
        self.tag, self.key, self.up, self.first, self.last = tag, key, up, first, first
        self.article, self.never, self.marked = article, never, marked  # never: by its tag; marked: by its class
        self.main = article or (up is not None and up.main)  # is or lies in an article
        self.closed = self.structure = False  # has its end tag; holds elements of a page's structure
        self.entry: int | None = None  # first block of the first article in it
        self.parts: list[bytes] = []


def is_mark(token: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether a class, id or role is a mark, alone or with other words."""
    words = _WORD.findall(token)
    if marks.isdisjoint(words):
        return False
    joined = PLACES | POSTS if not AROUND.isdisjoint(words) else PLACES
    return all(w in MARKS or w in joined or (i and w in SIDES) for i, w in enumerate(words))


def dropped(elements: list[Element], lengths: list[int]) -> tuple[set[int], set[int]]:
    """(blocks of dropped elements, blocks of articles).  ``elements``: those that are articles
    or may go, in the order of their ends; ``lengths``: of the blocks."""
    for e in elements:
        if e.never and e.tag in FORMS and e.structure:
            e.never = False

    def inside(e: Element) -> bool:
        """In an element that goes."""
        x = e.up
        while x is not None:
            if x.marked or (x.never and (x.closed or x.tag not in OPEN_ENDED)):
                return True
            x = x.up
        return False

    articles = [e for e in elements if e.article]
    free = [e for e in articles if not e.marked and not inside(e)]
    shielded: set[int] = set()
    if articles and not free:
        free = [max(articles, key=lambda e: (sum(lengths[e.first:e.last]), -e.first))]
    for e in free:
        x: Element | None = e
        while x is not None and id(x) not in shielded:
            shielded.add(id(x))
            x = x.up
    gone: set[int] = set()
    for e in elements:
        if (e.never or e.marked) and (id(e) not in shielded or not e.closed):
            end = e.last if id(e) not in shielded else e.entry if e.never and e.tag in OPEN_ENDED and e.entry is not None else e.first
            gone.update(range(e.first, end))
    return gone, {i for e in free for i in range(e.first, e.last)}


def skipped(page: str) -> dict[int, int]:
    """Where the ``SKIPPED`` elements of a page end, by where they start: each end tag closes
    the last open element of its name."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _SKIPPED.finditer(page):
        if m["tag"] is None:
            continue
        starts = opened.setdefault(m["tag"].lower(), [])
        if not m["end"] and m["attrs"].endswith("/"):
            ends[m.start()] = m.end()
        elif not m["end"]:
            starts.append(m.start())
        elif starts:
            ends[starts.pop()] = m.end()
    return ends


def parse(page: str, templates: frozenset[int] = frozenset()) -> tuple[list[tuple[str, bool]], set[int]]:
    """(blocks, hashes) of a page: blocks of text, each with whether it lies in the article,
    without those in ``templates`` and in dropped elements; and the hashes of all elements that
    may be template."""
    blocks: list[str] = []
    hashes: set[int] = set()
    cuts: list[tuple[int, int]] = []  # blocks of template elements
    seen: list[Element] = []  # articles and elements that may go
    stack = [Element("", "", None, 0)]
    text: list[str] = []
    muted: Element | None = None  # marked element inside a block
    kept = 0  # pieces of ``text`` before it

    def flush() -> None:
        nonlocal kept
        line = _SPACE.sub(" ", "".join(text if muted is None else text[:kept])).strip()
        text.clear()
        kept = 0
        if line:
            blocks.append(line)

    def close(by_tag: bool = False) -> None:
        nonlocal muted
        e = stack.pop()
        e.last, e.closed = len(blocks), by_tag
        if e is muted:
            del text[kept:]
            muted = None
        if e.article or e.never or (e.marked and e.tag in BLOCKS):
            seen.append(e)
        up = stack[-1]
        up.structure |= e.structure or e.tag in STRUCTURE
        if e.article and up.entry is None:
            up.entry = e.first
        elif e.entry is not None and up.entry is None:
            up.entry = e.entry
        subtree = xxhash.xxh64_intdigest(f"{e.tag}\t{e.key}\t".encode("utf-8", "surrogatepass") + b"\0".join(e.parts)) >> 1
        up.parts.append(subtree.to_bytes(8, "little"))
        if e.tag in ("html", "body") or e.tag in MAIN or (e.main and e.tag in PROSE):
            return
        hashes.add(subtree)
        if subtree in templates and e.first < len(blocks):
            cuts.append((e.first, len(blocks)))

    def leave(index: int, by_tag: bool = False) -> None:
        flush()
        while len(stack) > index:
            close(by_tag and len(stack) == index + 1)

    at = 0
    ends: dict[int, int] | None = None
    tokens = _TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        if m.start() > at:
            piece = entities.unescape(page[at:m.start()])
            text.append(piece)
            if not piece.isspace():
                stack[-1].parts.append(piece.strip().encode("utf-8", "surrogatepass"))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "head":
            continue  # no element: its end tag may be missing, and what it holds has no text
        if tag in _SKIPPED_TAGS:
            ends = skipped(page) if ends is None else ends
            if not m["end"] and m.start() in ends:
                at = ends[m.start()]
                tokens = _TOKEN.finditer(page, at)
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in BLOCKS:
                        leave(i, True)
                    elif all(e.tag not in BLOCKS for e in stack[i:]):
                        while len(stack) > i:
                            close(len(stack) == i + 1)
                    break
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" and tag not in ("html", "body"):
                    leave(i)
                    break
                if stack[i].tag in MAIN or stack[i].tag in ("td", "th", "body", "button"):
                    break
            if tag in CLOSED_BY_SAME:
                same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in same:
                        leave(i)
                        break
                    if stack[i].tag in CLOSED_BY_SAME[tag]:
                        break
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                text.append("" if tag == "wbr" else " ")
            continue
        marks = {a[0].lower(): a[1].strip("\"'").lower() for a in _ATTR.findall(m["attrs"])} if m["attrs"] else {}
        up = stack[-1]
        article = tag in MAIN or marks.get("role") == "main"
        never = not article and (tag in NEVER or (tag == "header" and not up.main))
        own = ADVERTS if up.main and (tag in LINES or tag not in BLOCKS) else AROUND if up.main else MARKS
        mark = tag not in ("html", "body") and any(is_mark(w, own) for v in marks.values() for w in v.split())
        if tag in BLOCKS or not m["attrs"].endswith("/"):
            e = Element(tag, marks.get("class", ""), up, len(blocks), article, never, mark)
            stack.append(e)
            if article:
                muted = None
            elif mark and tag not in BLOCKS and muted is None:
                muted, kept = e, len(text)
    if at < len(page):
        text.append(entities.unescape(page[at:]))
    leave(1)
    flush()
    lengths = [len(b) for b in blocks]
    off, inside = dropped(seen, lengths)
    gone = _covered(cuts, len(blocks)) - off
    own = gone & inside
    if 2 * sum(lengths[i] for i in own) > sum(lengths[i] for i in inside - off):
        gone -= own  # pages that share their article have no template there
    gone |= off
    return [(line, i in inside) for i, line in enumerate(blocks) if i not in gone], hashes


def _covered(cuts: list[tuple[int, int]], at: int) -> set[int]:
    """Blocks in ``cuts``: of elements in the order of their ends, so one lies in or before
    those after it."""
    out: set[int] = set()
    for first, last in reversed(cuts):
        out.update(range(first, min(last, at)))
        at = min(at, first)
    return out


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    blocks, _ = parse(page or "", templates)
    inside = any(main for _, main in blocks)
    return "\n".join(line for line, main in blocks if main or not inside)


def host_of(url: Column) -> Column:
    """Host name of a URL; "" if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


def site_templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, templates): hashes of subtrees on at least ``min_pages`` different pages of the
    host and ``min_share`` of them; pages of equal html are one.  As many hashes a host as one page has elements, divided by the
    share, at most."""
    ready(pages.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, found = [], []
            for page in b.column(1).to_pylist():
                digests.append(xxhash.xxh3_128_digest(page.encode("utf-8", "surrogatepass")))
                found.append(sorted(parse(page)[1] | {-1}))  # -1 counts the pages themselves
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["host", "digest", "hashes"])

    seen = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html")).mapInArrow(tidy(run), "host string, digest binary, hashes array<long>")
    # copies go in their own task first; a row has only the numbers of a page
    seen = seen.distinct().select("host", F.explode("hashes").alias("hash"))
    counts = staged(seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(f"n >= {int(min_pages)} or hash = -1"), "html")
    total = counts.where("hash = -1").select("host", F.col("n").alias("pages"))
    shares = spread_join(counts.where("hash <> -1"), total, "host", "hash").where(F.col("n") >= min_share * F.col("pages"))
    return shares.groupBy("host").agg(F.collect_list("hash").alias("templates"))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The columns ``keep`` of ``pages`` (default: all but the html and columns named text or
    n_chars), text and n_chars.

    Null and empty html has the text "".  Pages without a host are one host "".  Repeated rows
    have a text each, but are one page of their host's template.  An empty table gives an empty result."""
    clash = {"text", "n_chars"}
    keep = [c for c in pages.columns if c != html and c not in clash] if keep is None else keep
    if clash & set(keep):
        raise ValueError("the input has a column named text or n_chars")
    found = staged(site_templates(pages, url, html, min_pages, min_share), "html")

    @F.arrow_udf("string")
    def text_of(page: pa.Array, templates: pa.Array) -> pa.Array:
        return pa.array([main_text(p, frozenset(t or ())) for p, t in zip(page.to_pylist(), templates.to_pylist(), strict=True)], pa.string())

    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    p = pages.select(row.alias("row"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    # a host that very many pages have is dealt out; rows of one url, too
    hosts = p.groupBy("host").agg(F.count("*").alias("n"))
    out = spread_join(p, found, "host", F.monotonically_increasing_id(), how="left", counts=hosts).select("row", text_of("html", "templates").alias("text"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "text", F.length("text").cast("long").alias("n_chars"))
