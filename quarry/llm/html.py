"""HTML extraction by site template removal.

Every page is parsed into a tree; the subtrees of its containers (not of paragraphs, headings or other text blocks, which articles
of a host may share as quotations) are hashed with their tags, classes and text. Spark counts on how many different pages of a host
each hash stands; those on MIN_PAGES or more are the host's template, and a second pass deletes them. What recurs too seldom to be
told that way, on a host of few pages or because it is new on each page as an advert or a comment is, goes by what it says that it
is: its tag, or a class, id or role that consists of the words below. What is left of the page's articles is its text; of `main`
where it has no article, else of the body.

An article is an `article` element, unless it or an element around it says that it is a comment, an advert, a related link or
the like. In it, `aside`, `header` and `button` are text. An element by whose name all would go is kept.

Character references are decoded; white space inside a block becomes one space; blocks are joined in page order by one.

Inputs: null or empty html gives an empty text; a null url is the host ''. Unclosed elements end where the page does (drawings and
formulas where a block begins), and stray end tags are ignored. Pages that are copies of each other count once, so copies do not
make a text a template. Of several articles all are kept, equal ones too. Repeated page_ids are rows of their own; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Set
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map
from quarry.session import table, written

#: A subtree is template if it stands on this many different pages of a host.
MIN_PAGES = 5
#: Template subtrees that are broadcast (8 bytes each); more are joined to the pages by a shuffle.
SENT_KEYS = 1_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext q ruby rt rp s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption pre blockquote figcaption br hr option".split())
#: A start tag of the first kind ends open elements of the second.
CLOSES = {x: ("p",) for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: Start tags that end an open drawing or formula.
BREAKS = frozenset([*CLOSES, "li", "article", "main", "body"])
#: Elements beyond which a start tag ends nothing.
SCOPES = frozenset("article aside body div fieldset footer form header html main nav ol section table td th ul".split())
#: Elements that a block ends, though they are not closed.
FOREIGN = ("svg", "math")
#: Elements that are never text, and those that are not text outside of articles.
CUT_TAGS = frozenset("nav footer form head select input dialog menu svg".split())
CUT_OUTSIDE = frozenset("aside button header".split())
#: Words that say what an element is, and words that may stand beside them in a name.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus "
    "footer login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related respond share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget".split()
)
HEADS = frozenset("header masthead".split())
FILLERS = frozenset(
    "area bar block body bottom box button buttons col column container content fixed form global group icons inner item left link links list main mobile outer page panel post posts "
    "primary reader right row secondary section site slot sticky text thread top unit user widgets wp wrap wrapper".split()
)
MAINS = frozenset("main main-content maincontent content-main".split())


@lru_cache(maxsize=1 << 16)
def says(token: str, words: frozenset[str]) -> bool:
    """Whether a name, such as cookie-banner or comments_list, consists of one of the words and of nothing that says otherwise."""
    parts = PARTS.findall(token)
    return not words.isdisjoint(parts) and all(p in words or p in FILLERS or p.isdigit() for p in parts)


class Page:
    """Elements as parallel lists in page order, and the runs of text with the element they stand in."""

    __slots__ = ("tags", "names", "parents", "runs")

    def __init__(self, html: str):
        self.tags, self.names, self.parents = [""], [frozenset()], [-1]
        self.runs: list[tuple[int, str]] = []  # (element, text); a text of one space marks a block's edge
        stack, at, end = [0], 0, len(html)
        tags, runs = self.tags, self.runs
        while at < end:
            m = TOKEN.search(html, at)
            if m is None:
                runs.append((stack[-1], unescape(html[at:])))
                break
            if m.start() > at:
                runs.append((stack[-1], unescape(html[at : m.start()])))
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        del stack[k:]
                        break
                if tag not in INLINE:
                    runs.append((stack[-1], " "))
                continue
            if tag not in INLINE:
                runs.append((stack[-1], " "))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if tag in VOID:
                continue
            if tag in BREAKS:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in FOREIGN:
                        del stack[k:]
                        break
                    if tags[stack[k]] in SCOPES:
                        break
            if tag in CLOSES:
                over = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = tags[stack[k]]
                    if open_tag in over:
                        del stack[k:]
                        break
                    if open_tag in SCOPES:
                        break
            attrs = m["attrs"] or m["attrs2"] or ""
            found = NAMED.findall(attrs) if attrs else ()
            self.names.append(frozenset(" ".join([a or b or c for a, b, c in found]).lower().split()) if found else frozenset())
            tags.append(tag)
            self.parents.append(stack[-1])
            if not attrs.rstrip().endswith("/") or tag not in ("path",):
                stack.append(len(tags) - 1)

    def keys(self, host: str) -> dict[int, int]:
        """By container: a signed 64-bit hash of the host and of its subtree with its text."""
        n = len(self.tags)
        site = xxhash.xxh64(host.encode("utf-8", "surrogatepass")).digest()
        digests = [xxhash.xxh64(f"<{t} {' '.join(sorted(c))}>".encode("utf-8", "surrogatepass")) for t, c in zip(self.tags, self.names)]
        texts: list[list[str]] = [[] for _ in range(n)]
        for e, text in self.runs:
            texts[e].append(text)
        out = {}
        for e in range(n - 1, 0, -1):  # children come after their parents
            digests[e].update(" ".join("".join(texts[e]).split()).encode("utf-8", "surrogatepass"))
            own = digests[e].digest()
            digests[self.parents[e]].update(own)
            if self.tags[e] not in INLINE and self.tags[e] not in BLOCKS and self.tags[e] not in ("html", "head", "body", "article", "main"):
                out[e] = int.from_bytes(xxhash.xxh64(site + own).digest(), "big", signed=True)
        return out

    def text(self, template: Set[int] = frozenset(), by_name: bool = True) -> str:
        """The articles' text without the template's elements and, if by_name, without those that say that they are none."""
        roots = self._roots()
        found = self._text(roots, template, by_name)
        return found if found or not by_name else self._text(roots, template, False)

    def _text(self, roots: list[int], template: Set[int], by_name: bool) -> str:
        n = len(self.tags)
        root, inside = [-1] * n, [False] * n  # root: of what is kept; inside: in an article
        for e in roots:
            root[e], inside[e] = e, self.tags[e] == "article"
        for e in range(1, n):
            parent = self.parents[e]
            if root[e] < 0 <= root[parent]:
                inside[e] = inside[parent] or self.tags[e] == "article"
                if e not in template and not self._says(e, inside[e], by_name):
                    root[e] = root[parent]
        parts: dict[int, list[str]] = {e: [] for e in roots}
        for e, text in self.runs:
            if root[e] >= 0:
                parts[root[e]].append(text)
        return " ".join(" ".join(["".join(x) for x in parts.values()]).split())

    def _says(self, e: int, inside: bool, by_name: bool) -> bool:
        tag = self.tags[e]
        if tag in CUT_TAGS or not inside and tag in CUT_OUTSIDE:
            return True
        return by_name and any(says(x, CUT_WORDS) or not inside and says(x, HEADS) for x in self.names[e])

    def _roots(self) -> list[int]:
        """The articles that are not in one another, else the `main` elements, else the page."""
        n = len(self.tags)
        for wanted in (lambda e: self.tags[e] == "article", lambda e: self.tags[e] == "main" or not MAINS.isdisjoint(self.names[e])):
            under, found = [False] * n, []  # under: in one that is found, or in one that is none
            for e in range(1, n):
                under[e] = under[self.parents[e]] or self.tags[e] in CUT_TAGS or self.tags[e] == "aside" or any(says(x, ASIDES) for x in self.names[e])
                if not under[e] and wanted(e) and not any(says(x, CUT_WORDS) for x in self.names[e]):
                    found.append(e)
                    under[e] = True
            if found:
                return found
        return [0]


#: Names of elements whose articles are not the page's own.
ASIDES = frozenset("comment comments related".split())


def extract(html: str | None, host: str = "", template: Set[int] = frozenset()) -> str:
    """One page's main text. template: hashes of the host's template (`Page.keys`)."""
    if not html:
        return ""
    page = Page(html)
    return page.text({e for e, key in page.keys(host).items() if key in template} if template else frozenset())


def host_of(url):
    """The host of a url column, in lower case; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, page) of the containers of rows (host, page, html)."""
    for batch in batches:
        pages, keys = [], []
        for host, page, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found = set(Page(html).keys(host).values()) if html else ()
            keys += found
            pages += [page] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pages, pa.int64())], ["key", "page"])


def _text_batches(batches: Iterator[pa.RecordBatch], known: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Texts of rows (page_id, url, host, html[, keys]); the template's keys are broadcast as a sorted array, or come with each row."""
    for batch in batches:
        texts = []
        for i, (host, html) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if not html:
                texts.append("")
                continue
            page = Page(html)
            keys = page.keys(host)
            if known is None:
                here = set(batch.column(4)[i].as_py() or ())
                texts.append(page.text({e for e, key in keys.items() if key in here}))
                continue
            own = np.fromiter(keys.values(), np.int64, len(keys))
            at = np.minimum(np.searchsorted(known.value, own), max(len(known.value) - 1, 0))
            hit = known.value[at] == own if len(known.value) else np.zeros(len(own), bool)
            texts.append(page.text({e for e, h in zip(keys, hit.tolist()) if h}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def templates(rows: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(key) of the subtrees that stand on `min_pages` different pages of their host, and (key, page) of all, of `rows` (host, page, html)."""
    seen = written(arrow_map(rows.select("host", "page", "html"), _key_batches, "key long, page long").distinct(), "html-keys")
    return written(seen.groupBy("key").count().where(F.col("count") >= min_pages).select("key"), "html-templates"), seen


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, sent_keys: int = SENT_KEYS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    A template of more than `sent_keys` subtrees meets the pages in a join by page, each with its own template subtrees only."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of("url").alias("host"), "html", F.xxhash64("html").alias("page"))
    known, seen = templates(rows, min_pages)
    schema = "page_id long, url string, text string, n_chars long"
    if known.count() <= sent_keys:
        keys = np.sort(np.array([r["key"] for r in known.collect()], np.int64))
        shared = pages.sparkSession.sparkContext.broadcast(keys)
        return arrow_map(rows.select("page_id", "url", "host", "html"), lambda it: _text_batches(it, shared), schema)
    own = seen.join(known, "key").groupBy("page").agg(F.collect_list("key").alias("keys"))
    return arrow_map(rows.join(own, "page", "left").select("page_id", "url", "host", "html", "keys"), lambda it: _text_batches(it, None), schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
