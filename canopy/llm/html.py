"""Main text of web pages by site template removal.

Every element subtree is hashed, inside the article as outside of it. Spark counts, per host, in how many distinct page
contents (texts that the rules leave, so copies count once) a subtree occurs; those in at least half of them are the
site's template and go with all they contain. An exact check follows: of what is left,
only text of the article stays (or of the whole body where a page marks no article, or where all text of its articles
was template), without elements whose tag, role or class names them as menus, notices, adverts, forms and the like.
Subtrees that hold nothing but what the check drops anyway are not counted.

Defined cases: null and empty html give an empty text; a null url or one without a host shares the host ``''``; repeated
rows are separate pages; unclosed and unopened tags are closed or skipped as browsers do; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import over_batches, pinned

#: A subtree is part of a site's template when it occurs in at least this share of the host's distinct page contents, and
#: in at least so many. A host with fewer contents has no template: two pages alike do not tell it from a copied text.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 3

# Fixed values of HTML: elements without content, elements that flow inside a line, elements that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
MAIN = frozenset(("article", "main"))
NOISE_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe svg button select textarea head title menu dialog object canvas".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_NAMES = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|"
    r"sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|comments?|disqus|replies|share|sharing|social|related|widget|login"
)
#: Outside an article: names with a word of these. ``has-sidebar`` and the like state what else is on the page.
NOISE_NAMES = re.compile(rf"(?:^|\s)(?!(?:has|with|without|no|is)[_-])(?:\S*[_-])?(?:{_NAMES})(?![^\s_-])|(?:^|\s)(?:site[_-]|global[_-])?header(?!\S)", re.I)
#: Names that say it as a whole; an element of such a name that holds articles is a list of teasers if there are others.
TEASER_NAMES = re.compile(rf"(?:^|\s)(?:{_NAMES})(?:[_-](?:posts?|articles?|items?|list|links))?(?!\S)", re.I)
#: Inside an article: whole names that clearly mean adverts, comments or forms.
ARTICLE_NAMES = re.compile(
    r"(?:^|\s)(?:ads?|advert|adverts|advertisements?|advertising|sponsored|comments?|comments?[_-](?:list|section|area|form)|commentlist|respond|replies|"
    r"disqus|disqus_thread|(?:contact|search|login|signup|subscribe|newsletter)[_-]?form)(?!\S)",
    re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _is_noise(tag: str, attrs: dict) -> bool:
    return tag in NOISE_TAGS or (attrs.get("role") or "").lower() in NOISE_ROLES or "hidden" in attrs


def _is_named(tag: str, attrs: dict, names: re.Pattern) -> bool:
    if tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False
    return any(names.search(attrs[k] or "") for k in ("class", "id") if k in attrs)


class _Element:
    __slots__ = ("tag", "noise", "main", "hash", "first", "named", "teasers", "holds")

    def __init__(self, tag: str, noise: bool, main: bool, first: int, hashed: bool):
        self.tag, self.noise, self.main, self.first = tag, noise, main, first
        self.hash = hashlib.blake2b(tag.encode(), digest_size=8) if hashed else None
        #: Noise by name, by a whole name, and whether an article lies inside.
        self.named = self.teasers = self.holds = False


class PageParser(HTMLParser):
    """One pass over a page: text blocks with their place and, with ``hashed``, the digests of the subtrees around them.

    ``blocks`` holds [text, inside the article, noise by rule, digests of the subtrees around it].
    """

    def __init__(self, hashed: bool = True):
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.blocks: list[list] = []
        self.parts: list[str] = []
        self.hashed = hashed
        self.saw_main = False
        self.noise_depth = self.main_depth = 0
        self.named: list[_Element] = []
        self.around: list[tuple[_Element, ...]] = []
        self.free_main = False

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.end_block()
        if tag in CLOSES_P:
            self.close_implied("p", stop=("article", "div", "section", "main", "td", "body", "li", "button"))
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self.close_implied(tag, stop=("ul", "ol", "dl", "table", "select", "menu"))
        if tag in VOID:
            return
        attrs = dict(attrs)
        noise = _is_noise(tag, attrs) or (tag == "header" and not self.main_depth)  # in an article it holds the title
        element = _Element(tag, noise, self.main_depth > 0 or tag in MAIN, len(self.blocks), self.hashed and tag not in ("html", "body"))
        if _is_named(tag, attrs, ARTICLE_NAMES if self.main_depth else NOISE_NAMES):
            element.named, element.teasers = True, bool(self.main_depth) or _is_named(tag, attrs, TEASER_NAMES)
            self.named.append(element)
        if tag in MAIN and not self.noise_depth:
            self.saw_main = True
            self.free_main |= not self.named
            for outer in self.named:
                outer.holds = True
        self.main_depth += tag in MAIN
        self.noise_depth += element.noise
        self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_block()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                while len(self.open) > at:
                    self.pop()
                return
            if self.open[at].tag in MAIN and tag in INLINE:  # an inline end tag without its start
                return

    def close_implied(self, tag, stop):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                while len(self.open) > at:
                    self.pop()
                return
            if self.open[at].tag in stop:
                return

    def pop(self):
        element = self.open.pop()
        self.main_depth -= element.tag in MAIN
        self.noise_depth -= element.noise
        if element.named:
            self.named.pop()
        if element.hash is not None:
            if element.tag not in INLINE:
                self.end_block_of(element)
            digest = int.from_bytes(element.hash.digest(), "little", signed=True)
            for block in self.blocks[element.first :]:
                block[3].append(digest)
            if self.open and self.open[-1].hash is not None:
                self.open[-1].hash.update(element.hash.digest())

    def end_block_of(self, element):
        if self.parts:
            self.open.append(element)
            self.noise_depth += element.noise
            self.main_depth += element.tag in MAIN
            self.named += [element] * element.named
            self.end_block()
            if element.named:
                self.named.pop()
            self.main_depth -= element.tag in MAIN
            self.noise_depth -= element.noise
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1].hash is not None:
            self.open[-1].hash.update(data.encode("utf-8", "surrogatepass"))
        if not (self.open and self.open[-1].tag in ("script", "style")):
            self.parts.append(data)

    def end_block(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.blocks.append([text, self.main_depth > 0, self.noise_depth > 0, []])
                self.around.append(tuple(self.named))

    def finish(self):
        self.close()
        self.end_block()
        while self.open:
            self.pop()
        # A name rule does not reach articles: an element that holds one is no noise, unless it lists teasers beside others.
        for block, named in zip(self.blocks, self.around):
            block[2] |= any(not e.holds or (e.teasers and self.free_main) for e in named)


def parse_page(html: str, hashed: bool = True) -> PageParser:
    parser = PageParser(hashed)
    parser.feed(html)
    parser.finish()
    return parser


def page_text(page: PageParser, deleted: set[int]) -> str:
    """The exact check on what is left of a page without the subtrees ``deleted``."""
    left = [block for block in page.blocks if not block[2] and deleted.isdisjoint(block[3])]
    inside = [block for block in left if block[1]]
    # Articles that were nothing but template mark no article.
    marked = inside or (page.saw_main and not any(main and not noise for _, main, noise, _ in page.blocks))
    return " ".join(block[0] for block in (inside if marked else left))


SUBTREES = "host string, page binary, content long, subtrees array<bigint>"
TEXTS = "page_id long, url string, text string"


def _hash_batch(batch: pa.RecordBatch):
    contents, subtrees = [], []
    for html in batch.column("html").to_pylist():
        blocks = [block for block in parse_page(html or "").blocks if not block[2]]
        text = "\n".join(block[0] for block in blocks).encode("utf-8", "surrogatepass")
        contents.append(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True))
        subtrees.append(sorted({digest for block in blocks for digest in block[3]}))
    yield pa.RecordBatch.from_arrays(
        [batch.column("host"), batch.column("page"), pa.array(contents, pa.int64()), pa.array(subtrees, pa.list_(pa.int64()))],
        ["host", "page", "content", "subtrees"],
    )


def _text_batch(batch: pa.RecordBatch):
    texts = []
    for html, deleted in zip(batch.column("html").to_pylist(), batch.column("deleted").to_pylist()):
        texts.append(page_text(parse_page(html or "", hashed=bool(deleted)), set(deleted or ())))
    yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def keyed(pages: DataFrame) -> DataFrame:
    """Pages with their host and the digest of their html; equal pages of a host have equal templates."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#:]*)", 1)), F.lit(""))
    return pages.select("page_id", "url", host.alias("host"), F.unhex(F.md5(F.coalesce("html", F.lit("")).cast("binary"))).alias("page"), "html")


def site_templates(hashed: DataFrame, min_pages: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """The subtrees ``(host, digest, pages)`` in a ``share`` of the distinct contents of their host, and in ``min_pages``.

    Equal contents count once. Counts are summed before the shuffle, so a host with a third of all pages is no hot group;
    the candidates are written before the join with the hosts' counts, so that such a host can be split there.
    """
    shown = hashed.where(F.size("subtrees") > 0)
    each = shown.select("host", "content", F.explode("subtrees").alias("digest")).distinct()
    counts = pinned(each.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages))
    hosts = pinned(shown.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("contents")))
    return counts.join(hosts, "host").where(F.col("pages") >= share * F.col("contents")).select("host", "digest", "pages")


def extract(pages: DataFrame, min_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page.

    Pages are parsed twice, once for their digests and once for their text, so that no text is written between. Deleted
    subtrees are written before the join with the pages; both its sides are then exchanges, and a page with many copies
    can be split.
    """
    named = keyed(pages)
    hashed = pinned(over_batches(named.select("host", "page", "html"), _hash_batch, SUBTREES))
    templates = pinned(site_templates(hashed, min_pages))
    around = hashed.select("host", "page", F.explode("subtrees").alias("digest"))
    hit = around.join(templates.select("host", "digest"), ["host", "digest"], "left_semi")
    hit = pinned(hit.groupBy("host", "page").agg(F.collect_set("digest").alias("deleted")))
    joined = named.join(hit, ["host", "page"], "left").select("page_id", "url", "html", "deleted")
    return over_batches(joined, _text_batch, TEXTS).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
