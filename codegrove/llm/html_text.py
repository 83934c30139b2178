"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its block elements, each told apart by its path from the root. Over the pages of a host, tokens with
the same occurrence vector (how often each page has them) form a class; a vector is kept as the number of its pages and a
sum of hashes of (page, count). Classes that half of the host's pages share are the template; their tokens are nested by
path. A slot is what lies between: the text whose deepest template token is the same. Slots under article or main tokens
are the main text where the host's template has some, else all that lies in the lowest element that contains the slots with
much text and few links; paragraphs, headings, lists, quotes and tables do not count as such an element. Menus, headers,
footers, sidebars, notices, adverts, forms and comments are told by their element or by a word of its class, id or role,
on every page, and left out. A page without text in its host's main slots, or whose host has one page, is read by the same
rules from the page alone.

Edge cases: a null html counts as empty, an empty page has an empty text; a page whose url is null or has no host belongs to the
host ''; unclosed and cut off markup ends with the page; of elements nested deeper than DEEP the paths, not the texts, end there; repeated rows each count as a page; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, stored, table

SUPPORT, LEAST_PAGES = 0.5, 2
#: A slot has much text if it has this share of the largest slot's text; less than half of it may be in links.
SHARE = 0.25
#: Characters of all templates' hosts and paths up to which they are sent to every executor.
FEW_CHARS = 4_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|svg|math|iframe|object)\b[^>]*>.*?(?:</\2\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that a text consists of, and that don't contain a whole one.
_PARTS = set("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre figure figcaption table caption colgroup thead tbody tfoot tr td th address details summary".split())
#: Elements that are never main text.
_OUT = set("head nav header footer aside form button select menu dialog input label legend fieldset".split())
#: Words of a class, id or role that name what isn't main text; and those that do so unless the name is that of a text.
_WORDS = set(
    "adv advert advertisement adverts advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter signup login"
    " share sharing social sidebar sidebars menu navbar nav navigation breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus related recommended recommendations footer"
    " pagination pager toolbar topbar complementary contentinfo".split()
)
_WEAK = set("ad ads alert banner header masthead modal notice notices overlay popup search skip subscribe widget widgets".split())
_TEXTS = set("article articles blog body content entry free main page post posts story stories text".split())
#: Words before which a name says that something is there or isn't.
_SAYS = set("has have is no non not with without".split())
_SPLIT = re.compile(r"[^a-z]+")
#: Elements nested deeper than this have the path of the one at this depth.
DEEP = 256


def _left_out(name: str) -> bool:
    """Whether a name (a class, an id, a role or a label) is that of something beside the text: comment-body is, alert-story and no-sidebar are not."""
    words = [w for w in _SPLIT.split(name) if w]
    if not words or words[0] in _SAYS:
        return False
    return not _WORDS.isdisjoint(words) or words[-1] in _WEAK or (not _WEAK.isdisjoint(words) and _TEXTS.isdisjoint(words))


def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's token, whether it is left out, and whether it is an article's."""
    words, out = set(), tag in _OUT
    for key, v in _NAME.findall(attributes):
        value = v.lower().strip("\"'")
        words |= {w for w in _SPLIT.split(value) if w}
        out = out or (tag not in ("html", "body", "main") and any(map(_left_out, [value] if key.lower() == "aria-label" else value.split())))
    return (f"{tag}.{'.'.join(sorted(words))}" if words else tag), out, tag in ("article", "main") or "articlebody" in words


def blocks(page: str) -> Iterator[tuple[str, str, int, bool, bool]]:
    """Blocks of text in page order: path, text, characters in links, left out, in an article. An element gives an empty block."""
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, left out, in an article
    links, parts, linked, at = 0, [], 0, 0
    open_tags: dict[str, int] = {}

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        n, parts, linked = linked, [], 0
        if text:
            yield stack[-1][1], text, n, stack[-1][2], stack[-1][3]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += links and m.start() - at
        at = m.end()
        if m[1]:
            parts.append(html.escape(m[1]))
        tag = (m[4] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m[3] else 1
            continue
        yield from flush()
        if m[3]:
            while open_tags.get(tag):
                ended = stack.pop()[0]
                open_tags[ended] -= 1
                if ended == tag:
                    break
            continue
        ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        if ends and stack[-1][0] in ends:
            open_tags[stack.pop()[0]] -= 1
        if tag in _VOID:
            continue
        token, out, article = _named(tag, m[5])
        _, path, was_out, was_in = stack[-1]
        deeper = f"{path}>{token}" if path else token
        stack.append((tag, path if len(stack) > DEEP else deeper, was_out or out, was_in or article))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        yield stack[-1][1], "", 0, stack[-1][2], stack[-1][3]
    if at < len(page):
        parts.append(page[at:])
    yield from flush()


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's pages, by host and path."""
    names = ["host", "path", "pages", "vector", "chars", "links", "out", "article"]

    def made(sums: dict) -> pa.RecordBatch:
        keys = list(sums)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
        cols += [pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([k[2] for k in keys], pa.bool_()), pa.array([k[3] for k in keys], pa.bool_())], names)

    sums: dict[tuple, list[int]] = {}
    for b in batches:
        for page, url, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own: dict[tuple, list[int]] = {}
            host = host_of(url)
            own[host, "", False, False] = [1, 0, 0]
            for path, t, linked, out, article in blocks(text or ""):
                x = own.setdefault((host, path, out, article), [0, 0, 0])
                x[0] += not t
                x[1] += len(t)
                x[2] += linked
            for k, (n, chars, linked) in own.items():
                x = sums.setdefault(k, [0, 0, 0, 0])
                x[0] += 1
                x[1] += zlib.crc32(f"{page} {n}".encode())
                x[2] += chars
                x[3] += linked
        if len(sums) > 50_000:
            yield made(sums)
            sums = {}
    yield made(sums)


def templates(pages: DataFrame) -> DataFrame:
    """host, slots (the template's paths) and main (those of main text) of each host with LEAST_PAGES pages or more."""
    prepare(pages.sparkSession)
    tokens = pages.select("page_id", "url", "html").mapInArrow(_tokens, "host string, path string, pages long, vector long, chars long, links long, out boolean, article boolean")
    tokens = stored(tokens.groupBy("host", "path", "out", "article").agg(*[F.sum(c).alias(c) for c in ("pages", "vector", "chars", "links")]), "tokens")
    hosts = tokens.where("path = ''").select("host", F.col("pages").alias("all_pages")).where(F.col("all_pages") >= LEAST_PAGES)
    classes = tokens.where("path != ''").join(hosts, "host").groupBy("host", "vector", F.col("pages")).agg(F.count("*").alias("size"), F.first("all_pages").alias("all_pages"))
    valid = classes.where(F.col("pages") >= SUPPORT * F.col("all_pages")).select("host", "vector", "pages")
    kept = tokens.where("path != ''").join(valid, ["host", "vector", "pages"]).select("host", F.col("path").alias("slot"), "out", "article")
    # a text belongs to the deepest template token above it
    steps = tokens.where("path != '' AND chars > 0").withColumn("s", F.split("path", ">"))
    above = steps.select("host", "path", "chars", "links", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.concat_ws(">", F.slice("s", F.lit(1), n)))).alias("slot"))
    deepest = above.join(kept, ["host", "slot"]).groupBy("host", "path").agg(F.max_by("slot", F.length("slot")).alias("slot"), F.first("chars").alias("chars"), F.first("links").alias("links"))
    slots = deepest.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).join(kept, ["host", "slot"]).where("NOT out")
    best = slots.groupBy("host").agg(F.max("chars").alias("most"), F.bool_or("article").alias("has_article"))
    slots = slots.join(best, "host")
    articles = slots.where("has_article AND article").select("host", "slot")
    large = slots.where(~F.col("has_article") & (F.col("chars") >= SHARE * F.col("most")) & (2 * F.col("links") < F.col("chars")))
    # the steps above a slot's last element that isn't a part; what the first and the last of a host's have in common, all have
    steps = F.split("slot", ">")
    whole = F.transform(steps, lambda x: ~F.substring_index(x, ".", 1).isin(*_PARTS))
    parts = F.array_position(F.reverse(whole), True).cast("int")
    large = large.select("host", F.slice(steps, F.lit(1), F.when(parts > 0, F.size(steps) - parts + 1).otherwise(0)).alias("steps"))
    ends = large.groupBy("host").agg(F.min("steps").alias("a"), F.max("steps").alias("b"))
    same = F.filter(F.zip_with("a", F.sequence(F.lit(1), F.size("a")), lambda x, n: F.when(F.slice("a", F.lit(1), n) == F.slice("b", F.lit(1), n), x)), lambda x: x.isNotNull())
    around = ends.select("host", F.when(F.size("a") == 0, "").otherwise(F.concat_ws(">", same)).alias("slot"))
    return articles.unionByName(around).groupBy("host").agg(F.sort_array(F.collect_set("slot")).alias("main"))


def main_text(page: str, main: list[str] | None) -> str:
    """Text of a page, given the main slots of its host's template."""
    found = [(path, t, linked, article) for path, t, linked, out, article in blocks(page) if t and not out]
    slots = set(main or ())

    def inside(path: str) -> bool:
        while path and path not in slots:
            path = path.rpartition(">")[0]
        return path in slots

    own = [inside(x[0]) for x in found]
    articles = [x[3] for x in found]
    if any(articles):  # an article that the host's template lacks is main text too
        own = [a or (o and any(a and o for a, o in zip(articles, own, strict=True))) for a, o in zip(articles, own, strict=True)]
    elif not any(own):
        own = [not x[2] or 2 * x[2] < len(x[1]) for x in found]
    return " ".join(x[1] for x, o in zip(found, own, strict=True) if o)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page."""
    spark = pages.sparkSession
    found = stored(templates(pages), "templates")
    few = (found.agg(F.sum(F.length("host") + F.length(F.concat_ws(" ", "main")))).first()[0] or 0) <= FEW_CHARS
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1)), F.lit(""))
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x or "", m) for x, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = pages.select("page_id", "url", "html", host.alias("host")).join(F.broadcast(found) if few else found, "host", "left")
    return joined.select("page_id", "url", "html", "main").mapInArrow(run, "page_id long, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
