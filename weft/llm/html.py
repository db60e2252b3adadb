"""Main text of HTML pages: removal of site templates, and rules for what is never text.

Each page is walked once: every block element's subtree gets a hash of its names, text and children, whatever it is.
Spark counts on how many different pages of a host, of each of its URL sections and of each of its layouts a hash
occurs. A subtree on most pages of one of these, and on many, is a part of the site's template; one apart from the
page's text (outside its articles, or in an element that rules rule out) is if it is on many pages, as menus of several
kinds are. Passages that many articles of a host quote stay. A template goes with all that is in it. In what is left, navigation, headers, footers, asides, forms, adverts, notices, comments and the like are
known by element, role, class or id and go even where they differ from page to page.

Counts are combined on the map side, so a host with a third of all pages is no single task. Copies of a page are
counted once. Templates are 8 bytes each and are sent to the tasks as long as they are few enough (MOST_TEMPLATES,
which is checked); beyond that a page finds its own by a join.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

#: A subtree is a template's if it is on so many different pages of a host and, unless it is apart from the text, on this
#: share of the different pages of the host, of one of its URL sections or of one of its layouts.
LEAST_PAGES, LEAST_SHARE = 20, 0.6
#: Templates up to which they are sent to all tasks: 2 MB.
MOST_TEMPLATES = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html option optgroup caption legend tbody thead tfoot tr td th".split())
#: Elements that end an open one of these kinds, up to the container they belong to.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"})}
NEVER = frozenset("head nav header footer aside form script style noscript template iframe svg math canvas object audio video button select datalist textarea dialog menu title xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: Words in a class or id that tell what an element is.
WORDS = COMMENTS | frozenset("ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe share sharing social related recommended widget login signup search pagination pager toolbar skip".split())
WHOLE = frozenset(("html", "body", "main"))

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|[!?][^>]*(?:>|$)|(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$))", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"\d+")


def _is_boilerplate(name: str, attrs: dict[str, str]) -> bool:
    if name in NEVER:
        return True
    if not attrs or name in WHOLE:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    words = set(_WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    return not words.isdisjoint(COMMENTS if name == "article" else WORDS)


class _Element:
    __slots__ = ("article", "block", "gone", "main", "name", "number", "parts")

    def __init__(self, name: str, attrs: dict[str, str], parent: _Element | None, number: int):
        self.name, self.number = name, number
        self.gone = bool(parent and parent.gone) or _is_boilerplate(name, attrs)
        self.article = bool(parent and parent.article) or name == "article"
        self.main = bool(parent and parent.main) or name == "main" or attrs.get("role") == "main"
        self.parts = [name, attrs.get("class", ""), attrs.get("id", "")]


class _Open:
    """The open elements. Finds the innermost one of a name, or of all blocks, without going through the others."""

    def __init__(self, root: _Element):
        self.stack, self.at, self.blocks = [root], {}, [0]

    def push(self, e: _Element) -> None:
        self.at.setdefault(e.name, []).append(len(self.stack))
        if e.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def pop(self) -> _Element:
        e = self.stack.pop()
        self.at[e.name].pop()
        if e.name in BLOCK:
            self.blocks.pop()
        return e

    def last(self, names: set[str] | frozenset[str]) -> int:
        """Where the innermost open element of these names is; 0: nowhere."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)


class Page:
    """A page's blocks of text in page order, and its block elements in the order of their beginnings.

    hashes, parents: of each block element, the subtree's hash (0 for a whole page or article, which is no template) and
    the element around it (-1: none). apart: of each, whether it is apart from the page's text. texts, within:
    of each block, its text and its innermost block element. kinds: what is known of where it is (see KIND). layout:
    a hash of the names and classes, without digits, of the elements around the page's text. marked: whether the page
    has an article or main element.
    """

    def __init__(self, page: str):
        self.hashes: list[int] = []
        self.parents: list[int] = []
        self.texts: list[str] = []
        self.within: list[int] = []
        self.kinds: list[int] = []
        self.apart: list[bool] = []
        self._names: list[str] = []
        self._outside: list[bool] = []
        self.marked = False
        self._walk(page)
        self.apart = [gone or self.marked and out for gone, out in zip(self.apart, self._outside, strict=True)]
        inside = self.chosen(self.kinds, self.marked)
        around: set[int] = set()
        for k, e in enumerate(self.within):
            while inside[k] and e >= 0 and e not in around:
                around.add(e)
                e = self.parents[e]
        self.layout = xxhash.xxh64_intdigest("\x1f".join(sorted({self._names[e] for e in around})).encode("utf-8", "surrogatepass"))

    @staticmethod
    def chosen(kinds: list[int], marked: bool) -> list[bool]:
        """Which blocks are the page's: of those that no rule rules out, the articles' (or else the main element's, if any)."""
        free = [k for k in kinds if not k & RULED]
        for kind in (ARTICLE, MAIN):
            if any(k & kind for k in free):
                return [not k & RULED and bool(k & kind) for k in kinds]
        return [not k & RULED and not marked for k in kinds]

    def _walk(self, page: str) -> None:
        root = _Element("", {}, None, -1)
        open_ = _Open(root)
        held: list[str] = []
        lost: set[int] = set()

        def flush() -> None:
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                held.clear()
                if text:
                    top = open_.stack[-1]
                    self.texts.append(text)
                    self.within.append(top.number)
                    self.kinds.append(ARTICLE * top.article | MAIN * top.main)

        def close() -> None:
            e = open_.pop()
            digest = xxhash.xxh64_intdigest("\x1f".join(e.parts).encode("utf-8", "surrogatepass"))
            if e.name in BLOCK and e.name not in WHOLE and e.name != "article":
                self.hashes[e.number] = digest
            open_.stack[-1].parts.append(format(digest, "x"))

        def close_to(names: set[str], limit: set[str] | frozenset[str]) -> None:
            while (i := open_.last(names)) and i > open_.last(limit):
                flush()
                while len(open_.stack) > i:
                    close()

        def add(text: str) -> None:
            top = open_.stack[-1]
            if not text:
                return
            top.parts.append(text)
            if not top.gone:
                held.append(text)
            elif top.number not in lost and not text.isspace():  # one block without its text, to be counted
                lost.add(top.number)
                self.texts.append("")
                self.within.append(top.number)
                self.kinds.append(RULED)

        at, end = 0, len(page)
        while at < end:
            m = _TAG.search(page, at)
            if m is None:
                add(page[at:])
                break
            add(page[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                add(m["cdata"] or "")
                continue
            name = name.lower()
            if m["close"]:
                i = open_.last({name})
                border = open_.blocks[-1]
                if i and (name in BLOCK or i > border):
                    if border >= i:
                        flush()
                    while len(open_.stack) > i:
                        close()
                elif name == "p":
                    flush()
                continue
            if name in RAW:
                e = _RAW_END[name].search(page, at)
                at = e.end() if e else end
                continue
            if name == "br":
                add(" ")
                continue
            if name in ENDS_P:
                close_to({"p"}, {"table", "button", "td", "th"})
            if name in ENDS:
                close_to(*ENDS[name])
            if name in BLOCK:
                flush()
            if name in VOID:
                continue
            raw = m["attrs"]
            attrs = {a.lower(): b or c or d for a, b, c, d in reversed(_ATTR.findall(raw))} if raw and raw != "/" else {}
            parent = open_.stack[-1]
            e = _Element(name, attrs, parent, parent.number)
            if e.gone and not parent.gone and name in NEVER:
                flush()
            self.marked |= name in ("article", "main")
            if name in BLOCK:
                e.number = len(self.hashes)
                self.hashes.append(0)
                self.apart.append(e.gone)
                self._outside.append(not (e.article or e.main))
                self.parents.append(open_.stack[open_.blocks[-1]].number)
                self._names.append(f"{name} {_DIGITS.sub('', attrs.get('class', ''))}")
            open_.push(e)
        flush()
        while len(open_.stack) > 1:
            close()


#: Keeps a subtree that is apart from the text from being counted with equal ones that are not.
APART = 0x3C6EF372FE94F82B
#: Bits of a block's kind: in an element that rules rule out, in an article, in a main element.
RULED, ARTICLE, MAIN = 1, 2, 4
_RAW_END = {name: re.compile(rf"</{name}[^>]*>", re.I) for name in RAW}


def blocks_of(page: str) -> list[tuple[str, list[int]]]:
    """The blocks that rules alone leave, each with the hashes of the block elements around it, the outermost first."""
    p, out = Page(page), []
    for k, use in enumerate(Page.chosen(p.kinds, p.marked)):
        if use:
            marks, e = [], p.within[k]
            while e >= 0:
                marks.append(p.hashes[e])
                e = p.parents[e]
            out.append((p.texts[k], marks[::-1]))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(*parts: str) -> int:
    return _signed(xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")))


_HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")
_SECTION = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/")


def page_blocks(pages: DataFrame) -> DataFrame:
    """uid, page_id, url; host, section, layout (hashes; 0: no host); content (a hash of the text that rules
    leave); marked; elements (array of key: the subtree's hash with the host's, or 0; parent; apart); blocks (array of text, within, kind) of every page.

    Only page_id, url and html are read.
    """
    kind = dict(pages.dtypes)["page_id"]

    def one(url: str | None, page: str | None) -> tuple:
        p = Page(page or "")
        host = _HOST.match(url or "")
        section = _SECTION.match(url or "")
        h = _hash("host", host[1].lower()) if host else 0
        # hashes of independent strings: their sum by xor is one too
        keys = [_signed(x) ^ h ^ APART * a if x else 0 for x, a in zip(p.hashes, p.apart, strict=True)]
        content = _hash(*(t for t, use in zip(p.texts, Page.chosen(p.kinds, p.marked), strict=True) if use)) ^ h
        elements = [{"key": k, "parent": e, "apart": a} for k, e, a in zip(keys, p.parents, p.apart, strict=True)]
        blocks = [{"text": t, "within": w, "kind": k} for t, w, k in zip(p.texts, p.within, p.kinds, strict=True)]
        return h, _hash("section", section[1] if section else ""), _hash("layout", str(p.layout)), content, p.marked, elements, blocks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.sliced(frames, 500):
            found = pd.DataFrame([one(u, x) for u, x in zip(frame.url, frame.html, strict=True)], columns=["host", "section", "layout", "content", "marked", "elements", "blocks"])
            yield pd.concat([frame[["uid", "page_id", "url"]].reset_index(drop=True), found], axis=1)

    rows = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", F.col("url").cast("string"), "html")
    return rows.mapInPandas(run, f"uid long, page_id {kind}, url string, host long, section long, layout long, content long, marked boolean, elements array<struct<key: long, parent: int, apart: boolean>>, blocks array<struct<text: string, within: int, kind: int>>")


def _groups(x: str) -> Column:
    """A page's groups as what `x` (its host's hash, or a subtree's key) is in each: its host, section and layout."""
    c = F.col(x)
    return F.array(c, c.bitwiseXOR(F.col("section")), c.bitwiseXOR(F.col("layout")))


def template_keys(blocks: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """key: the subtrees that are templates, each as its key in the group (see _groups) of whose pages it is a template.

    Pages are counted by distinct contents, so that copies of a page are one. A subtree is looked at in the groups
    only if it is on `least_pages` pages of its host, without which it can't be on so many of a group. Pages without a
    host have none.
    """
    hosted = blocks.where("host <> 0").select("uid", "host", "section", "layout", "content", F.array_distinct(F.filter(F.transform("elements", lambda e: F.struct(e["key"].alias("key"), e["apart"].alias("apart"))), lambda e: e["key"] != 0)).alias("keys"))
    first = hosted.groupBy("content").agg(F.min("uid").alias("uid"))
    pages = common.stored(hosted.join(first.select("uid"), "uid", "left_semi").drop("content"), "html-pages")
    each = pages.select("host", "section", "layout", F.explode("keys").alias("e")).select("host", "section", "layout", "e.*")
    often = common.stored(each.groupBy("key", "apart").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).select("key", "apart"), "html-often")
    inside = often.where("not apart").select("key")
    few = inside.count() <= MOST_TEMPLATES
    common_ones = each.where("not apart").join(F.broadcast(inside) if few else inside, "key")
    pairs = F.explode(F.arrays_zip(_groups("key").alias("key"), _groups("host").alias("of")))
    counted = common_ones.select(pairs.alias("x")).groupBy("x.key", "x.of").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    sizes = pages.select(F.explode(_groups("host")).alias("of")).groupBy("of").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    strict = counted.join(sizes, "of").where(F.col("n") >= F.col("pages") * least_share).select("key")
    found = common.stored(strict.unionByName(often.where("apart").select("key")).distinct(), "html-templates")
    common.discard(pages, often)
    return found


def _texts(blocks: DataFrame, few: np.ndarray | None) -> DataFrame:
    """page_id, url, text, template_blocks, ruled_blocks of pages, with the templates `few` or else those in their column gone."""
    kind = dict(blocks.dtypes)["page_id"]

    def one(elements: np.ndarray, gone: list[bool], blocks: list[dict], marked: bool) -> tuple[str, int, int]:
        for i, e in enumerate(elements):  # parents come before their children
            if e["parent"] >= 0 and gone[e["parent"]]:
                gone[i] = True
        left = [b for b in blocks if b["within"] < 0 or not gone[b["within"]]]
        use = Page.chosen([b["kind"] for b in left], marked)
        return "\n".join(b["text"] for b, u in zip(left, use, strict=True) if u), len(blocks) - len(left), len(left) - sum(use)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.sliced(frames, 1000):
            out = []
            for row in frame.itertuples(index=False):
                keys = np.fromiter((e["key"] for e in row.elements), np.int64, len(row.elements))
                gone = np.zeros(len(keys), bool)
                for other in (0, row.section, row.layout):
                    if not row.host:
                        break
                    own = keys ^ np.int64(other)
                    if few is not None:
                        at = np.searchsorted(few, own)
                        gone |= (at < len(few)) & (few[np.minimum(at, len(few) - 1)] == own) if len(few) else False
                    elif row.templates is not None:
                        gone |= np.isin(own, row.templates)
                out.append((row.page_id, row.url, *one(row.elements, gone.tolist(), row.blocks, row.marked)))
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "template_blocks", "ruled_blocks"]).astype({"page_id": frame.page_id.dtype})

    return blocks.mapInPandas(run, f"page_id {kind}, url string, text string, template_blocks int, ruled_blocks int")


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text, n_chars (code points), template_blocks, ruled_blocks (blocks that went with templates, and
    of the rest by rules) of every page.

    Blocks are joined by one line end, in page order; white space inside a block is one blank. A null or empty page
    has an empty text. Pages that are copies of each other are not a template; a page of nothing but templates has an
    empty text. Repeated rows are all returned; an empty table gives an empty one.
    """
    blocks = common.stored(page_blocks(pages), "html-blocks")
    templates = template_keys(blocks, least_pages, least_share)
    if templates.count() <= MOST_TEMPLATES:
        found = _texts(blocks, np.sort(np.array([r.key for r in templates.collect()], np.int64)))  # bounded by the count
    else:
        own = blocks.where("host <> 0").select("uid", F.explode(F.array_distinct(F.flatten(F.transform("elements.key", lambda k: F.array(k, k.bitwiseXOR(F.col("section")), k.bitwiseXOR(F.col("layout"))))))).alias("key"))
        hits = own.join(templates, "key").groupBy("uid").agg(F.collect_list("key").alias("templates"))
        found = _texts(blocks.join(hits, "uid", "left"), None)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "template_blocks", "ruled_blocks")


def op10_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """main_text of all pages."""
    return main_text(common.pages(spark, sf_dir))
