"""Main text of web pages: subtrees that recur across a site go first, then what HTML marks as not the article."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import in_arrow, spill

#: A container is a template of its host if at least so many of the host's different pages have it; other subtrees, and
#: containers in an article that hold more than SHORT words, must also be on this share of the pages.
MIN_PAGES, MIN_SHARE, SHORT = 5, 0.5, 40

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCKS = frozenset(["p"])
SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROOTS = frozenset(["article", "main"])
OPEN = frozenset(["html", "body", "article", "main"])
# What is not the article, by element, by role, and by word of a class or id.
NOT_TEXT = frozenset("head nav footer aside form button select dialog menu object audio video canvas fieldset".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
NOT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription popup modal overlay comment comments commentlist disqus replies respond sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer share sharing social related recommended widget login signup pagination pager toolbar masthead skip paywall".split()
)
# Those that also begin compound names inside an article; compound names beside the article, and the elements that hold others: only those go by a class or id.
BEGIN = frozenset("ad ads adv advert advertisement adsense banner sponsor sponsored promo cookie consent newsletter subscribe popup modal comment comments disqus respond paywall".split())
BESIDE = frozenset("site-header page-header top-bar topbar site-footer page-footer left-col right-col side-col left-column right-column left-rail right-rail side-rail".split())
CONTAINERS = frozenset("address aside center details div dir dl figure footer form frameset header hgroup li menu nav ol section table tbody td tr ul".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
_QUOTE = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|\Z)""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether HTML says that an element is not the article: by its tag, role, style or, if it is a container, its names.

    Inside an article a class or id must be such a name or begin with one (`ad-slot`, `comment-list`); outside, any word
    of it counts. A paragraph or heading never goes by a name.
    """
    if tag in NOT_TEXT or tag == "header" and not in_article:
        return True
    for name, value in _ATTRIBUTE.findall(attributes) if "=" in attributes or "hidden" in attributes.lower() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in NOT_ROLES:
            return True
        if name == "style" and _UNSEEN.search(value):
            return True
        if name in ("class", "id") and tag in CONTAINERS:
            names = value.replace("_", "-").split()
            if not NOT_NAMES.isdisjoint(names if in_article else _WORD.findall(value)) or not BESIDE.isdisjoint(names):
                return True
            if not BEGIN.isdisjoint(n.split("-")[0] for n in names):
                return True
    return False


class _Scanner:
    """Tags of a page, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(from, to, tag or "" for comments, whether it ends an element, attributes); the parser may move `self.at`."""
        page, self.at, end = self.page, 0, len(self.page)
        while m := _OPEN.search(page, self.at):
            tag = (m[2] or "").lower()
            if m[0] == "<!--":
                stop = page.find("-->", m.end())
                self.at = stop + 3 if stop >= 0 else end
            else:
                stop = self._close(m.end()) if tag else page.find(">", m.end())
                self.at = stop + 1 if stop >= 0 else end
            yield m.start(), self.at, tag, bool(m[1]), page[m.end() : max(m.end(), self.at - 1)] if tag else ""

    def _close(self, at: int) -> int:
        """Where the tag ends that is open at `at`: a > outside quotes. Once quotes do not match, they mean nothing more."""
        first = at
        while self.quotes:
            m = _QUOTE.search(self.page, at)
            if m and m[0] == ">":
                return m.start()
            at = self.page.find(m[0], m.end()) + 1 if m else 0
            if at == 0:
                self.quotes = False
        return self.page.find(">", first)


class _Element:
    """An open element: whether it is unwanted or inside a root, its subtree's number, and what its hash is made of."""

    __slots__ = ("inside", "number", "parts", "tag", "unwanted")

    def __init__(self, tag: str, unwanted: bool, inside: bool, number: int, parts: list[bytes]):
        self.tag, self.unwanted, self.inside, self.number, self.parts = tag, unwanted, inside, number, parts


class Page:
    """A parsed page: blocks (text, inside an article or main, unwanted, innermost subtree), and subtrees as hashes and parents.

    Every element that stands for itself is a subtree; its hash covers its tags, its text and the hashes of the
    subtrees in it. `loose` tells which subtrees are templates by the number of pages alone: containers outside of
    roots, or of few words.
    """

    def __init__(self, page: str | None):
        import xxhash

        self.blocks: list[tuple[str, bool, bool, int]] = []
        self.hashes: list[int] = []
        self.parents: list[int] = []
        box: list[bool] = []
        within: list[bool] = []
        page = page or ""
        stack: list[_Element] = [_Element("", False, False, -1, [])]
        open_count: Counter[str] = Counter()
        buffer: list[str] = []

        def flush() -> None:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1]
                self.blocks.append((text, top.inside, top.unwanted, top.number))
                top.parts.append(text.encode("utf-8", "surrogatepass"))

        def close(k: int) -> None:
            while len(stack) > k:
                e = stack.pop()
                open_count[e.tag] -= 1
                if e.tag not in INLINE:
                    h = xxhash.xxh64_digest(b"\0".join(e.parts), 8)
                    if e.number >= 0:
                        self.hashes[e.number] = int.from_bytes(h, "big")
                    stack[-1].parts.append(h)

        def last(tags: frozenset[str] | set[str]) -> int:
            """The innermost open element of these tags; 0 if there is none."""
            if not any(open_count[t] for t in tags):
                return 0
            return next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in tags)

        scanner, at = _Scanner(page), 0
        for start, _, tag, ends, attributes in scanner:
            if at < start:
                buffer.append(html.unescape(page[at:start]))
            at = scanner.at
            if not tag:
                continue
            inline = tag in INLINE
            if ends:
                if not inline:
                    flush()
                if k := last({tag}):
                    if not inline or all(e.tag in INLINE for e in stack[k + 1 :]):
                        close(k)
                    else:  # crossed tags: only the inline one ends
                        open_count[tag] -= 1
                        del stack[k]
                continue
            if not inline:
                flush()
                if open_count["p"] and tag not in VOID | RAW:
                    k = len(stack) - 1
                    while stack[k].tag in INLINE:
                        k -= 1
                    if stack[k].tag == "p":
                        close(k)
                if tag in SAME_CLOSES and (k := last({tag, *SAME_CLOSES[tag]})) and stack[k].tag == tag:
                    close(k)
            elif tag == "br":
                buffer.append(" ")
            if tag in VOID or tag == "svg" and attributes.endswith("/"):
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                scanner.at = at = stop.end() if stop else len(page)
                continue
            up, number = stack[-1], stack[-1].number
            unwanted = up.unwanted or _unwanted(tag, attributes, up.inside)
            inside = up.inside or tag in ROOTS
            parts = up.parts
            if not inline:
                parts = [" ".join([tag, *attributes.split()]).encode("utf-8", "surrogatepass")]
                if tag not in OPEN:
                    number = len(self.hashes)
                    self.hashes.append(0)
                    self.parents.append(up.number)
                    box.append(tag in CONTAINERS)
                    within.append(inside)
            stack.append(_Element(tag, unwanted, inside, number, parts))
            open_count[tag] += 1
        if at < len(page):
            buffer.append(html.unescape(page[at:]))
        flush()
        close(1)
        words = [0] * len(self.hashes)
        for text, _, _, number in self.blocks:
            if number >= 0:
                words[number] += text.count(" ") + 1
        for k in range(len(words) - 1, -1, -1):  # parents come first
            if self.parents[k] >= 0:
                words[self.parents[k]] += words[k]
        self.loose = [b and (not i or n <= SHORT) for b, i, n in zip(box, within, words, strict=True)]

    def text(self, templates: frozenset[int] = frozenset()) -> str:
        """The article, one block a line: first the subtrees whose hash is in `templates` go, then unwanted elements and,
        where a page has an article or main, all outside of it."""
        gone: list[bool] = []
        for h, up in zip(self.hashes, self.parents, strict=True):  # parents come first
            gone.append(h in templates or up >= 0 and gone[up])
        left = [b for b in self.blocks if not (b[3] >= 0 and gone[b[3]])]
        rooted = any(inside for _, inside, _, _ in self.blocks)
        return "\n".join(text for text, inside, unwanted, _ in left if not unwanted and (inside or not rooted))


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The article of a page, less subtrees whose hash is in `templates`, one block a line."""
    return Page(page).text(templates)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, templates) of `pages` (host, html): hashes of the subtrees, of any element from head to foot, that recur
    across a host's different pages; copies of one page count once, so an article that is repeated is no template.

    Containers need `min_pages` pages; paragraphs, headings and long containers of an article `min_share` of the host's
    pages too, as articles may quote each other. A host's list holds what recurs on its pages, not their texts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            hosts, sums, out, loose = [], [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                page = page.as_py() or ""
                parsed = Page(page)
                found: dict[int, bool] = {}
                for h, x in zip(parsed.hashes, parsed.loose, strict=True):
                    found[h] = x or found.get(h, False)
                out += map(_signed, found)
                loose += found.values()
                hosts += [host] * len(found)
                sums += [_signed(xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass")))] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(out, pa.int64()), pa.array(sums, pa.int64()), pa.array(loose, pa.bool_())], ["host", "h", "sum", "loose"])

    known = pages.where("host <> ''")
    each = in_arrow(known.select("host", "html"), run, "host string, h long, sum long, loose boolean").distinct()
    seen = each.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.max("loose").alias("loose")).where(F.col("n") >= min_pages)
    of = known.select("host", F.xxhash64("html").alias("sum")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return seen.join(of, "host").where(F.col("loose") | (F.col("n") >= min_share * F.col("pages"))).groupBy("host").agg(F.collect_list("h").alias("templates"))


def extract_text(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """`df` without `page`, with text and n_chars: the main text of every row's whole html.

    Null and empty pages give "". Rows with no host in their url keep all but structural boilerplate. Repeated rows are
    one page of their host, and each is returned. Deep, unclosed and very long pages take time by their length. An
    empty table gives no row. Columns of `df` named like a result are replaced.
    """
    keep = [c for c in df.columns if c not in (page, "text", "n_chars")]
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), host.alias("host"), F.col(page).cast("string").alias("html"))
    templates = spill(site_templates(rows), "templates")
    rows = rows.join(templates, "host", "left")
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            of: dict[str, frozenset] = {}  # one set a host of the batch
            out = []
            for p, h, t in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("templates"), strict=True):
                if h not in of:
                    of[h] = frozenset(x & (1 << 64) - 1 for x in t.as_py() or ())
                out.append(main_text(p.as_py(), of[h]))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(out, pa.string())], schema.names)

    done = in_arrow(rows, run, schema)
    return done.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", F.length("text").cast("long").alias("n_chars"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
