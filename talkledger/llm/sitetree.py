"""Main text by site style trees (operator 4).

Pages of a host are merged into one tree: an element node is a path of elements with their
classes, a content node a block's own text under such a path. Over the host's M different
pages, a content on c of them has importance 1 - log c / log M, and an element the greater of
the entropy of its presentations (the kinds of its children) and the mean importance of its
contents. What looks and reads the same on every page is near 0, what stands on one page
only is 1. A text goes if weight times importance is below `ELEMENT` for its element, or below
`CONTENT` for itself; it weighs more in an article (`WEIGHTS`), so there only what nearly all pages
share goes. As a branch is noise if everything in it is, removing a branch's texts one by one
removes the branch.

The names of elements, their roles and classes are a prior beside the tree: menus, adverts,
comments and the like weigh nothing, and of what is left the article (else main, else an
element named like one, else the body) is the text. `names=False` leaves this prior out.

Only counts go through a shuffle, summed on the tasks' side, so a host that holds a third
of all pages is spread like the others. What comes back are contents on M ** (1 - CONTENT) pages
or more, and elements on the square root of M or more (a smaller sample tells little of an element):
of R nodes a page, at most R * M ** 0.5 for each host, 1000 R for a million pages.

Defined cases: a null html, or one without text, gives an empty text; a null url is a host
of its own; broken markup is closed where HTML implies it; a tag that never ends is ended at its
first `>`, or is text where none follows; copies of a page count once and get the same text; a
host of fewer than `least_pages` different pages has no tree, only the prior; an empty table
gives an empty result; other columns are ignored. Time is linear in a page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

LEAST_PAGES = 5
ELEMENT = 0.75  # importance below which all texts of an element go
CONTENT = 0.2  # importance below which a text goes
WEIGHTS = {"article": 4.0, "body": 2.0, "": 1.0}  # in an article, in a main or an element named like one, elsewhere
BROADCAST_ROWS = 500_000  # 32 bytes each

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that show no text of the page, whatever they are named.
HIDDEN = frozenset("script style head title noscript iframe template svg canvas math object embed audio video select option datalist textarea input noembed noframes xmp map".split())
#: Elements that by their kind are no part of an article.
NAMED = frozenset("form button label nav footer aside dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes if it is open in the same scope.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = frozenset("ul ol dl table select article section div body html main td th blockquote".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar header cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus replies reply respond pagination pager search toolbar skip legal copyright disclaimer tagcloud outbrain taboola paywall".split()
)
#: Words that may stand beside those in a compound name, which say where or what kind of box it is and nothing of its contents.
BESIDE = frozenset("area article bar block blog body bottom box btn button buttons col column container content cta entry feed form global group holder icon icons inner item items js left link links list local main mobile module outer page panel post posts primary right row secondary section site slot social sticky story top unit user wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
_START = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
#: A tag's attributes up to its end; possessive, so a tag is read once.
_REST = re.compile(r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+>")
#: Names of the element that holds the text, where a page has neither article nor main.
BODIES = frozenset("content main article post story entry main-content page-content article-body article-content article-text post-body post-content entry-content story-body".split())
_NEGATED = re.compile(r"(?:no|not|has|with|without|is)[-_]", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Dom:
    """Elements numbered in page order, and what happens in that order: (0, element) opens, (1, element) closes, (2, text)."""

    tags: list[str] = field(default_factory=list)
    attrs: list[dict[str, str]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    events: list[tuple[int, int | str]] = field(default_factory=list)


def parse(source: str) -> Dom:
    dom = Dom()
    stack: list[int] = []
    at_depth: dict[str, list[int]] = {}  # where on the stack the open elements of a kind are
    scopes: list[int] = []

    def push(tag: str, attrs: dict[str, str]) -> None:
        n = len(dom.tags)
        dom.tags.append(tag)
        dom.attrs.append(attrs)
        dom.parents.append(stack[-1] if stack else -1)
        dom.events.append((0, n))
        at_depth.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(n)

    def cut(depth: int) -> None:
        while len(stack) > depth:
            n = stack.pop()
            at_depth[dom.tags[n]].pop()
            if dom.tags[n] in SCOPE:
                scopes.pop()
            dom.events.append((1, n))

    push("html", {})
    at, size, last, whole = 0, len(source), source.rfind(">"), True
    while at < size:
        m = _START.search(source, at)
        if m and m[2] and m.start() > last:
            m = None  # no tag ends from here on
        text = source[at : m.start() if m else size]
        if text:
            dom.events.append((2, entities.unescape(text)))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        end = _REST.match(source, at) if whole else None
        if end:
            rest, at = source[at : end.end() - 1], end.end()
        else:  # a quote swallows the rest: from now on tags end at the first >
            whole = False
            stop = source.find(">", at)
            rest, at = source[at:stop], stop + 1
        tag = m[2].lower()
        held = at_depth.get(tag)
        if m[1]:
            if held and held[-1] > 0 and (tag != "p" or held[-1] >= scopes[-1]):
                cut(held[-1])
            continue
        attrs = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(rest)} if rest.strip(" \t\r\n/") else {}
        if tag in ("html", "body") and held:
            n = stack[held[0]]
            dom.attrs[n] = attrs | dom.attrs[n]
            continue
        closes = CLOSES.get(tag, ("p",) if tag in BLOCK else ())
        depth = max((at_depth[c][-1] for c in closes if at_depth.get(c)), default=-1)
        if depth > 0 and depth >= scopes[-1]:
            cut(depth)
        if tag == "body":
            cut(1)
        push(tag, attrs)
        if tag in VOID or rest.endswith("/") and tag in ("svg", "path"):
            cut(len(stack) - 1)
        elif tag in RAW:
            at = re.compile(rf"</{tag}\s*>|</{tag}\Z|\Z", re.I).search(source, at).end()
            cut(len(stack) - 1)
    cut(0)
    return dom


def _names(attrs: dict[str, str]) -> list[str]:
    return f"{attrs.get('class', '')} {attrs.get('id', '')}".split()


def _noise_words(tag: str, attrs: dict[str, str]) -> set[str]:
    """The words of its class and id that mark noise. A compound name counts if all its words do, or say where a box is: `menu-recipes`
    is an article's as likely as not. Of an article only whole names count: it may have comments without being one."""
    if tag in ("article", "main"):
        return {n.lower() for n in _names(attrs)} & NOISE
    found: set[str] = set()
    for n in _names(attrs):
        words = {w.lower() for w in _WORD.findall(n)}
        if words <= NOISE | BESIDE and not _NEGATED.match(n):
            found |= words & NOISE
    return found


def _is_noise(tag: str, attrs: dict[str, str]) -> bool:
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES or attrs.get("aria-hidden") == "true" or "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    return bool(_noise_words(tag, attrs))


def _is_header(tag: str, attrs: dict[str, str]) -> bool:
    return tag == "header" or tag in ("div", "section", "hgroup") and _noise_words(tag, attrs) == {"header"}


def _zones(dom: Dom, noise: list[bool]) -> tuple[set[int], set[int], str]:
    """The elements that hold an article or main; the outermost articles, else mains, else elements named like one,
    else the whole; and which of these they are."""
    tags, attrs, parents = dom.tags, dom.attrs, dom.parents
    n = len(tags)
    closed, in_body = [False] * n, [False] * n
    articles, mains, bodies = [], [], []
    for i in range(n):
        up = parents[i]
        tag = tags[i]
        if up >= 0 and closed[up] or noise[i] and tag not in ("div", "section", "html"):
            closed[i] = True
            continue
        in_body[i] = up >= 0 and in_body[up]
        if tag == "article" and not noise[i]:
            articles.append(i)
            closed[i] = True
        elif tag == "main" or attrs[i].get("role") == "main":
            mains.append(i)
        elif not noise[i] and not in_body[i] and tag in ("div", "section", "td") and any(x.lower() in BODIES for x in _names(attrs[i])):
            bodies.append(i)
            in_body[i] = True
    holds: set[int] = set()
    for i in [*articles, *mains] or bodies:
        up = parents[i]
        while up >= 0 and up not in holds:
            holds.add(up)
            up = parents[up]
    return holds, set(articles or mains or bodies or [0]), "article" if articles else "body" if mains or bodies else ""


def texts_of(dom: Dom, names: bool = True) -> tuple[list[tuple[int, str, float]], set[tuple[int, int]]]:
    """The page's texts in order, as (path of the block they stand in, text, weight), and its presentations (path, kinds of children).

    A text is what stands between two ends of blocks. What the names call no part of an article weighs 0."""
    tags, attrs, parents = dom.tags, dom.attrs, dom.parents
    n = len(tags)
    hidden = [t in HIDDEN for t in tags]
    noise = [hidden[i] or names and (tags[i] in NAMED or _is_noise(tags[i], attrs[i])) and tags[i] != "body" for i in range(n)]
    holds, zones, kind = _zones(dom, noise) if names else (set(), {0}, "")
    path, inside, headings, out = [0] * n, [False] * n, [False] * n, [False] * n
    kinds: list[dict[str, None]] = [{} for _ in range(n)]
    texts: list[tuple[int, str, float]] = []
    shown: set[tuple[int, int]] = set()
    kept, cut, blocks, at = [], [], [0], 0

    def flush() -> None:
        for part, weight in ((kept, WEIGHTS[kind]), (cut, 0.0)):
            if part and (text := " ".join("".join(part).split())):
                texts.append((path[blocks[-1]], text, weight))
            part.clear()

    stack: list[int] = []
    for what, x in dom.events:
        if what == 2:
            at = stack[-1]
            if not x.isspace():
                kinds[at]["#"] = None
            (kept if inside[at] and not headings[at] and not out[at] else cut).append(x) if not hidden[at] else None
        elif what == 0:
            up, tag = parents[x], tags[x]
            above = up >= 0
            path[x] = xxhash.xxh64_intdigest(f"{tag}.{attrs[x].get('class', '')}", path[up] if above else 0)
            if above:
                kinds[up][tag] = None
                inside[x], out[x], hidden[x] = inside[up], out[up], hidden[up] or hidden[x]
                headings[x] = headings[up] and tags[up] not in HEADINGS
            if x not in zones and x not in holds and tag not in ("html", "body"):
                if names and _is_header(tag, attrs[x]):
                    out[x] = out[x] or not inside[x]
                    headings[x] = True
                elif noise[x]:
                    out[x] = True
            inside[x] = inside[x] or x in zones
            if tag in HEADINGS:
                headings[x] = False
            if tag in BLOCK:
                flush()
                blocks.append(x)
            elif tag == "br":
                kept.append(" ")
                cut.append(" ")
            stack.append(x)
        else:
            if tags[x] in BLOCK:
                flush()
                blocks.pop()
            if not hidden[x]:
                shown.add((path[x], xxhash.xxh64_intdigest(" ".join(kinds[x]))))
            stack.pop()
    flush()
    return texts, shown


def style_rows(dom: Dom, names: bool = True) -> set[tuple[int, int, int]]:
    """(path, kind, key) of a page: kind 0 the node, 1 a presentation of it, 2 a content."""
    texts, shown = texts_of(dom, names)
    return {(p, 0, 0) for p, _ in shown} | {(p, 1, k) for p, k in shown} | {(p, 2, _content(t)) for p, t, _ in texts}


def _content(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def main_text(dom: Dom, low: dict[tuple[int, int | None], float] | None = None, names: bool = True) -> str:
    """low: importance of the nodes that have little, by (path, content), content None for the element."""
    low = low or {}
    found = []
    for path, text, weight in texts_of(dom, names)[0]:
        if weight * low.get((path, None), 1.0) >= ELEMENT and (not low or weight * low.get((path, _content(text)), 1.0) >= CONTENT):
            found.append(text)
    return "\n".join(found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _raw(pages: DataFrame) -> DataFrame:
    bound_batches(pages.sparkSession)
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def style_tree(pages: DataFrame, least_pages: int = LEAST_PAGES, names: bool = True) -> DataFrame:
    """host, path, content, importance of the nodes below the thresholds: elements (content null) and contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, path, kind, key, share = [], [], [], [], []
            for h, source, part in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):  # noqa: B905
                for p, k, x in style_rows(parse(source.as_py()), names):
                    host.append(h)
                    share.append(part)
                    path.append(_signed(p))
                    kind.append(k)
                    key.append(_signed(x))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(path, pa.int64()), pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(share, pa.float64())], names=["host", "path", "kind", "key", "share"])

    raw = _raw(pages)
    raw = raw.withColumn("page", F.xxhash64("html"))
    seen = materialize(raw.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")), "style-pages")
    per_host = seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    # A row counts for its share among the copies of its page, so that all sums are over different pages.
    copies = seen.filter("copies > 1")
    raw = raw.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, ["host", "page"], "left").withColumn("share", 1 / F.coalesce("copies", F.lit(1)))
    counts = raw.select("host", "html", "share").mapInArrow(run, "host long, path long, kind int, key long, share double").groupBy("host", "path", "kind", "key").agg(F.greatest(F.round(F.sum("share")), F.lit(1)).cast("long").alias("c"))
    counts = counts.join(per_host, "host").withColumn("imp", 1 - F.log(F.col("c").cast("double")) / F.log(F.col("pages").cast("double")))
    counts = materialize(counts, "style-counts")
    of = lambda k: F.col("kind") == k
    shown, s = F.when(of(1), F.col("c")).cast("double"), F.col("s")
    nodes = counts.groupBy("host", "path").agg(F.sum(shown).alias("s"), F.sum(shown * F.log(shown)).alias("l"), F.avg(F.when(of(2), F.col("imp"))).alias("contents"), F.max(F.when(of(0), F.col("c"))).alias("on"), F.max("pages").alias("pages"))
    entropy = F.when(s > 1, (F.log(s) - F.col("l") / s) / F.log(s)).otherwise(1.0)
    nodes = nodes.filter("contents is not null and on >= sqrt(pages)").select("host", "path", F.lit(None).cast("long").alias("content"), F.greatest(F.coalesce(entropy, F.lit(0.0)), F.col("contents")).alias("importance"))
    contents = counts.filter(of(2) & (F.col("imp") < CONTENT)).select("host", "path", F.col("key").alias("content"), F.col("imp").alias("importance"))
    return nodes.filter(F.col("importance") < ELEMENT).unionByName(contents)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    noise = materialize(style_tree(pages, least_pages, names), "style-noise")
    n = noise.count()
    key = lambda path, content: (path % (1 << 64), content if content is None else content % (1 << 64))
    raw, trees = _raw(pages), None
    if n <= BROADCAST_ROWS:  # counted: every task gets the trees once
        small: dict[int, dict] = {}
        for r in noise.collect():
            small.setdefault(r["host"], {})[key(r["path"], r["content"])] = r["importance"]
        trees = pages.sparkSession.sparkContext.broadcast(small)
        raw = raw.select("host", "page_id", "url", "html")
    else:
        by_host = noise.groupBy("host").agg(F.collect_list(F.struct("path", "content", "importance")).alias("noise"))  # bounded for each host, see above
        raw = raw.join(by_host, "host", "left").select("host", "page_id", "url", "html", "noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {} if trees is None else trees.value  # the trees of the hosts in hand
        for b in batches:
            texts = []
            for n, (host, source) in enumerate(zip(b.column(0).to_pylist(), b.column(3), strict=True)):
                if trees is None and host not in held:
                    if len(held) >= 256:
                        held.clear()
                    held[host] = {key(x["path"], x["content"]): x["importance"] for x in b.column(4)[n].as_py() or []}
                texts.append(main_text(parse(source.as_py()), held.get(host), names))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return raw.mapInArrow(run, "page_id long, url string, text string, n_chars long")
