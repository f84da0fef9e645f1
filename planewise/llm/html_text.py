"""Main text of web pages by site template removal.

Each page is read once by a tolerant tag scanner into text blocks and container elements.  An
element's subtree hash covers its tag, its text and its children's hashes (attributes aside).  Spark
counts on how many pages of unlike content each subtree occurs on a host; subtrees on ``least_pages`` and
``share`` of the host's contents or more (text blocks: ``least_block_pages`` and ``block_share``) are site template,
and their blocks are deleted.  Copies of a page, told by their text without furniture by name, count once.  Elements whose tag or role, and
containers whose class or id, name them as furniture go too, which matters for what differs from page to page and on hosts of few pages.  A class names
furniture by a whole token, or by its last part but for words like ``box`` or ``list`` (``NAMES``, ``ENDS``, ``NEUTRAL``); inside an article only whole
tokens for adverts, share boxes and readers' comments do (``INNER_NAMES``), and text blocks such as paragraphs never go by class.  Where a page marks its article
(``article``, or ``main`` if it has more text outside articles than in them), only blocks in it are text.  Its blocks may be quoted by many articles, so they are template only if they also stand
at the same place, one of the first or last ``PLACES`` blocks, on ``same_place`` of the pages that have them, or if they are on
``article_share`` of the host's contents wherever they stand; headings only by the latter, as near copies share their title.

Between the two passes a page travels as its compressed blocks; the hashes that recur come back to it
by a join on (host, hash), so nothing is broadcast and no host meets in one task.

Contract: null html is empty html and gives empty text; without a host in the url nothing is counted for the page;
each of repeated rows gets its text; a null page id or url stays null; pages are read whole; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import trimmed, written

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption caption td th address summary".split())
CONTAINERS = frozenset("html body div section article main aside nav header footer form ul ol dl table thead tbody tfoot tr figure fieldset details menu dialog hgroup search".split())
BLOCKS = TEXT_BLOCKS | CONTAINERS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Not text at all.
SILENT = frozenset("head script style noscript template iframe svg math object audio video canvas button select textarea title datalist noembed noframes xmp".split())
#: Furniture by name; ``header`` only outside an article.
FURNITURE = frozenset("nav footer aside form menu dialog search".split())
DROPPED = SILENT | FURNITURE
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer sidebar sidebars aside widget widgets comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations toolbar pagination pager skip copyright masthead topbar".split()
)
#: Last parts of compound names, such as ``site-footer``.
ENDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar banner widget comments cookies consent notice popup modal newsletter toolbar pagination pager".split())
#: Last parts that say nothing: ``comments-list`` is named by what is before them.
NEUTRAL = frozenset("area bar block box button buttons container form items links list panel posts section slot unit wrap wrapper".split())
#: Whole names that count inside an article as well.
INNER_NAMES = frozenset("ad ads advert adverts advertisement sponsored share sharing newsletter comments commentlist comment-list disqus disqus_thread respond".split())
OUTER_NAMES = frozenset("header headers".split())
#: A start tag of one of these ends an open one of the same list.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|\Z)|/?[a-zA-Z][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[-_]+")
_SALTS = 32
#: Kinds of subtrees.
CONTAINER, BLOCK, ARTICLE_BLOCK, ARTICLE_HEADING = range(4)
#: Blocks at either end of a page's text that count as places; PLACES is every other place.
PLACES = 3


def _named(token: str) -> bool:
    """Whether a class or id names furniture."""
    parts = [p for p in _PART.split(token) if p]
    while len(parts) > 1 and parts[-1] in NEUTRAL:
        parts.pop()
    return bool(parts) and parts[-1] in (NAMES if len(parts) == 1 else ENDS)


def _furniture(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if not attrs or attrs.isspace() or tag in ("html", "body", "article", "main") and "hidden" not in attrs and "comment" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            if tag in TEXT_BLOCKS:
                continue
            tokens = value.split()
            if in_article:
                if not INNER_NAMES.isdisjoint(tokens):
                    return True
            elif any(_named(t) or t in OUTER_NAMES for t in tokens):
                return True
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


class _Element:
    __slots__ = ("tag", "first", "parts", "silent", "named", "article", "main")

    def __init__(self, tag: str, first: int, silent: bool, named: bool, article: bool, main: bool):
        self.tag, self.first, self.silent, self.named, self.article, self.main = tag, first, silent, named, article, main
        self.parts: list[str] = []


def scan(page: str) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """(blocks, subtrees): the page's blocks, empty where they are furniture by name or outside the article, and of each counted element its hash, its blocks' range and kind."""
    blocks: list[tuple[str, bool, bool, bool]] = []
    subtrees: list[tuple[int, int, int, int]] = []
    stack = [_Element("", 0, False, False, False, False)]
    text: list[str] = []

    def flush() -> None:
        if text:
            top = stack[-1]
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                top.parts.append(line)
                if not top.silent:
                    blocks.append((line, top.article, top.main, top.named))

    def close() -> None:
        flush()
        e = stack.pop()
        up = stack[-1]
        digest = xxhash.xxh64_intdigest("\x00".join([e.tag, *e.parts]).encode("utf-8", "surrogatepass"))
        up.parts.append(f"<{digest:x}")
        if len(blocks) > e.first and e.tag not in ("html", "body", "article", "main"):
            kind = CONTAINER if e.tag not in TEXT_BLOCKS else BLOCK if not (e.article or e.main) else ARTICLE_HEADING if e.tag in HEADINGS else ARTICLE_BLOCK
            subtrees.append((_signed(digest), e.first, len(blocks), kind))

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or tag in DROPPED:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                while depth and len(stack) > depth:
                    close()
                if tag in BLOCKS:
                    flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in BLOCKS and tag not in DROPPED and not (m[3] and ("hidden" in m[3] or "display" in m[3])):
            continue  # inline: its text belongs to the block around it
        top = stack[-1]
        named = top.named or _furniture(tag, m[3], top.article or top.main)
        if tag in RAW:  # no markup inside
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCKS:
            flush()
            if tag not in CONTAINERS or tag in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in CLOSES.get(tag, ()):
                        while len(stack) > i:
                            close()
                        break
                    if stack[i].tag in CONTAINERS and stack[i].tag != "tr":
                        break
            if stack[-1].tag == "p":
                close()
        elif tag == "head":
            flush()
        if not m[4]:
            top = stack[-1]
            stack.append(_Element(tag, len(blocks), top.silent or tag in SILENT, named, top.article or tag == "article", top.main or tag == "main"))
    flush()
    while len(stack) > 1:
        close()
    own = [b for b in blocks if not b[3]]
    inside, beside = (sum(len(b[0]) for b in own if (b[1] if article else b[2] and not b[1])) for article in (True, False))
    place = 2 if beside > inside else 1 if inside else 0  # the main part, the article, everything
    return ["" if named or place and not (article, main)[place - 1] else line for line, article, main, named in blocks], subtrees


def _found(host: str, blocks: list[str], subtrees: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """The page's subtrees, by a digest of host, kind and subtree: (digest, first block, block behind) of each; and by digest the kind and, for ARTICLE_BLOCK, the text blocks before and after, up to PLACES."""
    before = [0, *accumulate(1 if b else 0 for b in blocks)]
    ranges: list[tuple[int, int, int]] = []
    places: dict[int, int] = {}
    for digest, a, z, kind in subtrees:
        if kind >= ARTICLE_BLOCK and before[z] == before[a]:
            continue  # no text: furniture by name or outside the article
        key = _signed(xxhash.xxh64_intdigest(f"{kind} {digest} {host}".encode("utf-8", "surrogatepass")))
        top = bottom = PLACES
        if kind == ARTICLE_BLOCK:
            top, bottom = min(before[a], PLACES), min(before[-1] - before[z], PLACES)
        had = places.get(key, PLACES << 2 | PLACES)
        ranges.append((key, a, z))
        places[key] = kind << 4 | min(had >> 2 & 3, top) << 2 | min(had & 3, bottom)
    return ranges, places


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 3, least_block_pages: int = 10, share: float = 0.005, block_share: float = 0.02, article_share: float = 0.3, same_place: float = 0.9) -> DataFrame:
    """(page_id, url, text, removed) of every page; ``removed`` counts the text blocks deleted because they recur."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("k"), host.alias("host"), "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                packed, contents, digests, places = [], [], [], []
                for h, page in zip(part[3].to_pylist(), part[4].to_pylist(), strict=True):
                    blocks, subtrees = scan(page or "")
                    ranges, found = _found(h, blocks, subtrees) if h else ([], {})
                    packed.append(zlib.compress(json.dumps([blocks, ranges], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 6))
                    contents.append(_signed(xxhash.xxh64_intdigest("\n".join(b for b in blocks if b).encode("utf-8", "surrogatepass"))))
                    digests.append(list(found))
                    places.append(list(found.values()))
                more = [pa.array(packed, pa.binary()), pa.array(contents, pa.int64()), pa.array(digests, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *more], names=["page_id", "url", "k", "host", "packed", "content", "digests", "places"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for packed, hits in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True):
                blocks, ranges = json.loads(zlib.decompress(packed))
                gone = {i for d, a, z in ranges if hits and d in hits for i in range(a, z)}
                texts.append("\n".join(b for i, b in enumerate(blocks) if b and i not in gone))
                removed.append(sum(1 for i in gone if blocks[i]))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["page_id", "url", "text", "removed"])

    parsed = rows.mapInArrow(trimmed(parse), "page_id long, url string, k long, host string, packed binary, content long, digests array<long>, places array<byte>")
    # pages are scanned twice: that costs less than keeping their blocks
    seen = written(parsed.where("size(digests) > 0").select("k", "host", "content", "digests", "places"), "subtrees")
    one = seen.groupBy("host", "content").agg(F.min_by(F.struct("digests", "places"), "k").alias("x"))
    each = one.select("host", F.inline(F.arrays_zip("x.digests", "x.places"))).toDF("host", "digest", "place")
    sides = [F.count(F.when(F.shiftright("place", n).bitwiseAND(3) == k, 1)) for n in (2, 0) for k in range(PLACES)]
    often = each.groupBy("host", "digest", F.shiftright("place", 4).alias("kind")).agg(F.count("*").alias("pages"), F.greatest(*sides).alias("placed"))
    often = often.where(F.col("pages") >= F.when(F.col("kind") == CONTAINER, F.lit(least_pages)).otherwise(F.lit(least_block_pages)))
    # hosts where the shares ask for more, each several times, so that one host's subtrees are dealt out
    large = one.groupBy("host").agg(F.count("*").alias("contents")).where(F.col("contents") * max(share, block_share, article_share) > min(least_pages, least_block_pages))
    large = large.select("host", "contents", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    often = often.withColumn("salt", F.pmod("digest", F.lit(_SALTS)).cast("int")).join(large, ["host", "salt"], "left")
    least = F.when(F.col("kind") == CONTAINER, F.lit(share)).when((F.col("kind") == BLOCK) | (F.col("placed") >= same_place * F.col("pages")), F.lit(block_share)).otherwise(F.lit(article_share))
    often = often.where(F.col("pages") >= F.coalesce("contents", F.lit(0)) * least).select("digest")
    hits = seen.select("k", F.explode("digests").alias("digest")).join(often, "digest").groupBy("k").agg(F.collect_set("digest").alias("hits"))
    return parsed.select("page_id", "url", "k", "packed").join(hits, "k", "left").select("page_id", "url", "packed", "hits").mapInArrow(trimmed(cut), "page_id long, url string, text string, removed long")
