"""Main text by site style trees.

Pages of a site (the registrable domain: the last two labels of a host) are merged into one
tree of element paths; tags carry their classes, ids and roles in a path. Every element of a
page has a presentation (the elements directly below it) and content features: the phrases of
its own text (runs of words between marks), its link targets and its image sources. Over the
m pages of the site that have an element, entropies are taken to the base m:

- presentation importance is the entropy of the element's presentations: 0 where all pages look
  alike, 1 where each page is built differently;
- a feature's entropy is that of its occurrences over the pages: 0 for what stands on a single
  page, 1 for what stands on all alike; a leaf's content importance is 1 less the mean entropy
  of its features, and a text that returns page after page makes it low;
- an inner element with l presentations has (1 - GAMMA^l) of its own presentation importance and
  GAMMA^l of the mean importance of what is below;
- outside an article element importance falls by the share of an element's text that is links.

Elements with an importance below IMPORTANCE are removed with all below them, unless they hold
more than half of the site's text. Where a site has too few pages to repeat anything, all is important, and the page's own declarations decide
(navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are dropped; pages with an article element, or a main one, keep what is inside it).
Declarations can be switched off (`declarations=False`), which leaves the tree alone.

Defined results: null or empty html gives an empty text; unclosed and stray tags are closed as
browsers do; a null url's pages share the site ""; repeated rows are separate pages, but a page
counts once in the tree however many copies it has; very long pages are read whole; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep, read
from .url_rules import host

#: About 100 bytes each.
BROADCAST_PATHS = 50_000
#: Elements whose importance is below this are template.
IMPORTANCE = 0.8
#: How much of an element's importance comes from below it, by the count of its presentations.
GAMMA = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav header footer aside form button dialog menu label input".split()) | RAW
#: Opening one of these closes an open one of the same row, up to the row's limits.
CLOSES = {
    "p": (frozenset({"p"}), frozenset("article section div li td th blockquote main body".split())),
    "li": (frozenset({"li", "p"}), frozenset("ul ol menu".split())),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Words of class, id or role that name what is not the article, as whole words.
NOT_ARTICLE = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related replies reply respond share sharing sidebar sitemap social sponsor sponsored subscribe toolbar widget widgets".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_SPACE = re.compile(r"\s+")
_PHRASE = re.compile(r"[^\w\s'-]+")


def attribute(attributes: str, name: str) -> str:
    return next((value.strip("\"'") for key, value in _ATTRIBUTE.findall(attributes) if key.lower() == name), "")


def marks(attributes: str) -> str:
    """The class, role and id of an element as it looks in paths: template, not content."""
    if "=" not in attributes:
        return ""
    held = {name.lower(): value.strip("\"'") for name, value in _ATTRIBUTE.findall(attributes)}
    words = [*held.get("class", "").lower().split(), *held.get("role", "").lower().split(), *held.get("id", "").lower().split()]
    return ".".join(re.sub(r"\d+", "0", w) for w in words).replace("/", "_")


def declared(mark: str) -> bool:
    """Whether class, role or id say that an element is not the article."""
    return bool(mark) and any(word in NOT_ARTICLE for word in re.split(r"[^a-z]+", mark))


def blocks(page: str) -> tuple[list[tuple[str, str, bool, bool, int]], list[tuple[str, str]]]:
    """(path, text, dropped, in article, characters in links) of every block of text of a page,
    in order, and (path, target) of its links and images. A path names the elements from the
    root, with their marks."""
    out: list[tuple[str, str, bool, bool, int]] = []
    targets: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, dropped, in article
    parts: list[str] = []
    at, linked, inside_link = 0, 0, False

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            # text markup inside a block is not part of its path
            top = next(x for x in reversed(stack) if x[0] in BLOCK or not x[0])
            out.append((top[1], text, stack[-1][2], stack[-1][3], min(linked, len(text))))
        linked = 0

    def close(tag: str) -> None:
        while stack[-1][0] != tag:
            if stack[-1][0] in BLOCK:
                flush()
            stack.pop()
        if tag in BLOCK:
            flush()
        stack.pop()

    found = _TAG.search(page)
    while found:
        parts.append(page[at : found.start()])
        linked += inside_link * (found.start() - at)
        at = found.end()
        closing, tag, attributes = found[1], found[2], found[3]
        if tag is not None:
            tag = tag.lower()
            if tag == "a":
                inside_link = not closing
            if not closing and tag in ("a", "img"):
                top = next(x for x in reversed(stack) if x[0] in BLOCK or not x[0])
                targets.append((top[1], f"{tag} {attribute(attributes, 'href' if tag == 'a' else 'src')}"))
            if closing:
                if tag == "br":
                    parts.append(" ")
                elif any(x[0] == tag for x in stack):
                    # an end tag of text markup ends no block around it
                    inner = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                    if tag in BLOCK or not any(x[0] in BLOCK for x in stack[inner + 1 :]):
                        close(tag)
                    else:
                        del stack[inner]
            else:
                if tag in CLOSES:
                    ended, limits = CLOSES[tag]
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in ended:
                            close(stack[i][0])
                            break
                        if stack[i][0] in limits or tag == "p" and stack[i][0] in BLOCK:
                            break
                elif tag in BLOCK and tag != "p" and any(x[0] == "p" for x in stack):
                    # a block ends an open paragraph that is not outside an enclosing block
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p":
                            close("p")
                            break
                        if stack[i][0] in BLOCK:
                            break
                if tag in BLOCK:
                    flush()
                if tag == "br" or tag == "hr":
                    parts.append(" ")
                if tag in RAW and not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                elif tag not in VOID and not attributes.rstrip().endswith("/"):
                    mark = marks(attributes)
                    _, path, dropped, inside = stack[-1]
                    # headers and asides inside an article are declared by their tags all the same
                    out_of = dropped or tag in DROPPED or declared(mark) and tag not in ("html", "body", "article", "main")
                    stack.append((tag, f"{path}/{tag}{'.' + mark if mark else ''}", out_of, inside or tag in ("article", "main") or mark == "main"))
        found = _TAG.search(page, at)
    parts.append(page[at:])
    flush()
    return out, targets


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def site(url):
    """The last two labels of a url's host."""
    return F.substring_index(F.regexp_replace(F.coalesce(host(url), F.lit("")), r":[0-9]*$", ""), ".", -2)


def ancestors(path: str) -> list[str]:
    """The elements around an element, from the root."""
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(2, len(parts))]


def features(found: list[tuple], targets: list[tuple[str, str]]) -> set[tuple[str, int]]:
    """(path, hash) of the distinct phrases, link targets and image sources of a page."""
    own = {(path, _hash(phrase)) for path, text, *_ in found for part in _PHRASE.split(text) if (phrase := part.strip())}
    return own | {(path, _hash(target)) for path, target in targets}


def presentations(paths: set[str]) -> dict[str, int]:
    """The hash of the elements directly below each inner element."""
    below: dict[str, set[str]] = {}
    for path in paths:
        chain = [*ancestors(path), path]
        for outer, inner in zip(chain, chain[1:], strict=False):
            below.setdefault(outer, set()).add(inner)
    return {path: _hash(" ".join(sorted(inner))) for path, inner in below.items()}


PARSED = "page_id long, url string, site string, page long, blocks array<struct<path:string,text:string,dropped:boolean,inside:boolean,linked:int>>, features array<struct<path:string,value:long>>, looks array<struct<path:string,value:long>>"


def parsed(pages: DataFrame) -> DataFrame:
    """Every page's blocks, content features and presentations, parsed once; `page` is a hash of
    the blocks that are not dropped, equal for copies of a page; `row` numbers the rows, once
    they are stored."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("dropped", pa.bool_()), ("inside", pa.bool_()), ("linked", pa.int32())]))
        value = pa.list_(pa.struct([("path", pa.string()), ("value", pa.int64())]))
        names = ["page_id", "url", "site", "page", "blocks", "features", "looks"]
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch, rows, own, looks, same = whole.slice(at, 100), [], [], [], []
                for page in batch.column(3).to_pylist():
                    found, targets = blocks(page or "")
                    rows.append([dict(zip(("path", "text", "dropped", "inside", "linked"), b, strict=True)) for b in found])
                    own.append([{"path": p, "value": v} for p, v in features(found, targets)])
                    looks.append([{"path": p, "value": v} for p, v in presentations({b[0] for b in found}).items()])
                    same.append(_hash("\0".join(f"{b[0]} {b[1]}" for b in found if not b[2])))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(same, pa.int64()), pa.array(rows, block), pa.array(own, value), pa.array(looks, value)], names)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), site(F.col("url")).alias("site"), F.col("html").cast("string"))
    return rows.mapInArrow(parse, PARSED).withColumn("row", F.monotonically_increasing_id())


def tree(pages: DataFrame) -> DataFrame:
    """pages: parsed ones with `row`, a number of their own. Gives site, path, importance, pages
    (different ones that have the element) and share (of the site's text) of every element. All counts are sums by site, path and hash that are made in part before each
    shuffle, so a hot site is only more counts."""
    named = pages.select("site", "page", "row")
    first = named.groupBy("site", "page").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = keep(named.join(first, ["site", "page"]).where("row <> first").select("row"), "copies")
    once = pages.join(copies, "row", "left_anti")
    sizes = F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.length(b["text"]).alias("size"), b["linked"].alias("linked"), b["inside"].alias("inside")))
    log_m = F.log(F.greatest("m", F.lit(2)))
    # content: a feature that k of the m pages have, once each, has the entropy log k to the base m
    each = once.select("site", F.explode("features").alias("x")).groupBy("site", "x.path", "x.value").agg(F.count("*").alias("k"))
    at = once.select("site", F.explode(F.array_distinct(F.transform("features", lambda x: x["path"]))).alias("path")).groupBy("site", "path").agg(F.count("*").alias("m"))
    leaf = each.groupBy("site", "path").agg(F.sum(F.log("k")).alias("logs"), F.count("*").alias("n")).join(at, ["site", "path"])
    leaf = leaf.select("site", "path", "m", F.when(F.col("m") < 2, 1.0).otherwise(1 - F.col("logs") / F.col("n") / log_m).alias("content"))
    # presentation
    looks = once.select("site", F.explode("looks").alias("x")).groupBy("site", "x.path", "x.value").agg(F.count("*").alias("k"))
    inner = looks.groupBy("site", "path").agg(F.sum("k").alias("m"), F.count("*").alias("l"), F.sum(F.col("k") * F.log("k")).alias("k_log_k"))
    inner = inner.select("site", "path", "m", "l", F.when(F.col("m") < 2, 1.0).otherwise((F.log("m") - F.col("k_log_k") / F.col("m")) / log_m).alias("presentation"))
    # of text in links, by element and by all around it
    text = once.select("site", F.explode(sizes).alias("x")).groupBy("site", "x.path").agg(F.sum("x.size").alias("size"), F.sum("x.linked").alias("linked"), F.max("x.inside").alias("inside"))
    leaf = keep(leaf.join(text, ["site", "path"], "full_outer"), "leaves")
    around = leaf.select("site", F.explode(_ancestors(F.col("path"))).alias("path"), "content", "m", "size", "linked").groupBy("site", "path").agg(
        (F.sum(F.col("content") * F.col("m")) / F.sum(F.when(F.col("content").isNotNull(), F.col("m")))).alias("below"), F.sum("size").alias("size"), F.sum("linked").alias("linked")
    )
    own = F.pow(F.lit(GAMMA), F.col("l"))
    inner = inner.join(around, ["site", "path"]).select("site", "path", "m", ((1 - own) * F.col("presentation") + own * F.coalesce("below", F.lit(1.0))).alias("importance"), "size", "linked", (F.col("path").rlike(ARTICLE)).alias("inside"))
    leaves = leaf.where("content IS NOT NULL").select("site", "path", "m", F.col("content").alias("importance"), "size", "linked", F.coalesce("inside", F.lit(False)).alias("inside"))
    share = F.when(F.col("inside"), 0.0).otherwise(F.coalesce(F.col("linked") / F.col("size"), F.lit(0.0)))
    every = leaves.unionByName(inner).select("site", "path", "m", (F.col("importance") * (1 - share)).alias("importance"), "size")
    every = every.groupBy("site", "path").agg(F.max("importance").alias("importance"), F.max("m").alias("pages"), F.sum("size").alias("size"))
    whole = leaf.groupBy("site").agg(F.sum("size").alias("whole"))
    return every.join(whole, "site").select("site", "path", "importance", "pages", (F.coalesce("size", F.lit(0)) / F.col("whole")).alias("share"))


#: Paths that are in an article or main element, or around nothing else.
ARTICLE = r"/(article|main)(\.[^/]*)?(/|$)"


def _ancestors(path):
    """As ancestors(), for columns."""
    names = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(names) - 1)), lambda i: i < F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), "/"))


def template(pages: DataFrame, importance: float = IMPORTANCE) -> DataFrame:
    """site and path of the blocks that the tree removes: those of low importance, and those
    below an inner element of low importance."""
    scored = keep(tree(pages), "tree")
    low = scored.where((F.col("importance") < importance) & (F.col("share") <= 0.5)).select("site", "path")
    under = scored.select("site", F.col("path").alias("_path"), F.explode(_ancestors(F.col("path"))).alias("path")).join(low, ["site", "path"]).select("site", F.col("_path").alias("path"))
    return keep(low.unionByName(under).distinct(), "template")


def extract(pages: DataFrame, declarations: bool = True, importance: float = IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars and removed (blocks that the tree removes) of every page. The
    template's paths are broadcast while they number at most BROADCAST_PATHS, else joined."""
    own = keep(parsed(pages), "parsed-pages", "zstd")
    low = template(own, importance)
    gone = low.groupBy("site").agg(F.collect_set("path").alias("gone"))
    if low.count() <= BROADCAST_PATHS:
        gone = F.broadcast(gone)
    rows = own.select("page_id", "url", "site", "blocks").join(gone, "site", "left")
    removes = lambda b: F.coalesce(F.array_contains("gone", b["path"]), F.lit(False))
    said = F.filter("blocks", lambda b: ~b["dropped"]) if declarations else F.col("blocks")
    rows = rows.withColumns({"said": said, "removed": F.size(F.filter("blocks", removes)).cast("long")})
    if declarations:
        rows = rows.withColumn("said", F.when(F.exists("said", lambda b: b["inside"]), F.filter("said", lambda b: b["inside"])).otherwise(F.col("said")))
    text = F.array_join(F.transform(F.filter("said", lambda b: ~removes(b)), lambda b: b["text"]), "\n\n")
    return rows.select("page_id", "url", text.alias("text"), "removed").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "removed")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op6_main_text": op6_main_text}
ORACLE_SQL: dict[str, str] = {}
