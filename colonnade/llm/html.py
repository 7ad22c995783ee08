"""Main text of web pages: element subtrees that recur on many pages of a host are deleted, then blocks are joined.

Each page is parsed once per pass into a light element tree. The first pass hashes the subtrees of boilerplate candidates
(elements outside paragraphs and headings of the article) and Spark counts, for each host, on how many pages each hash
occurs. Counts are combined before the shuffle and only hashes at or over the threshold are kept. The second pass deletes
those subtrees, elements whose tag, role, class or id says that they are menus, headers, footers, sidebars, notices,
adverts, forms or reader comments, and scripts and styles; what remains is the text. If a page has an article or main
element, text outside it is left out. An article's header stays, as it has the title.

A class or id counts only if it says nothing else, so that a section named "related-work" or "side-effects" stays; a few
words, such as "sidebar", count in any name. It never counts on a heading, nor on an element that holds nearly all of the
text. Names that articles use too, such as "login" or "related", count in an article only where there is no running text.

An article's own paragraphs are never deleted because they recur: many pages may hold the same passage.

Defined results: null html gives an empty text; a page without any element is text as a whole; unclosed elements end
with their parent; unknown character references stay as they are; a null url is a host of its own; repeated rows count
as separate pages; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Names of HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg xmp noembed noframes".split())
DROPPED = frozenset("script style template iframe svg head title nav footer header aside form button select textarea dialog menu input fieldset option canvas object embed audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset("address article aside blockquote body br_block caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "br_block"}
CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
# Words of a class or id that mark what is not the article, and words that only say where or what kind of box it is.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side footer header masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay subscribe newsletter signup login comment comments replies reply respond disqus share sharing social related recommended widget "
    "widgets pagination pager toolbar skip".split()
)
BOXES = frozenset("area bar bars block bottom box button buttons center column container content form global inline inner items left link links list main outer page panel primary right row secondary section site slot thread tools top unit wrap wrapper".split())
# Marks that no other phrase has, and marks that parts of an article may have too.
PLAIN_MARKS = frozenset("adbox advert adverts advertisement breadcrumb breadcrumbs disqus gdpr masthead navbar pagination sidebar".split())
WEAK = frozenset("banner header login menu menus modal overlay popup recommended related reply respond side signup skip social toolbar widget widgets".split())
WORDS = re.compile(r"[^\W_]+")
# A tag ends before the next one begins, unless that is in quotes: so an unclosed one is given up after a look at what follows it.
START = re.compile(r"<([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
END = re.compile(r"</([a-zA-Z][^\s/<>]*+)[^<>]*+>")
ATTR = re.compile(r"([^\s/>\"'=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|[\"'=/]")
SPACE = re.compile(r"\s+")


def marks(value: str) -> set[str]:
    """The marks of a class or id: of names that are all marks, boxes or numbers, and the plain marks of any name."""
    out: set[str] = set()
    for name in value.lower().split():
        words = WORDS.findall(name)
        found = {w for w in words if w in MARKS}
        out |= found if found and all(w in MARKS or w in BOXES or w.isdigit() for w in words) else found & PLAIN_MARKS
    return out


MOST = 0.9  # of a page's text: what holds as much is not left out for its name
RUNNING = 8  # words outside links that make running text


class Node:
    __slots__ = ("tag", "attrs", "kids", "template", "words", "linked")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids, self.template, self.words, self.linked = tag, attrs, [], False, 0, 0

    def unwanted(self, inside: bool, whole: int) -> bool:
        """Whether tag, role or class say that this is not the article; inside: it is in one. whole: words of all that it is part of."""
        if self.template or self.tag in DROPPED and not (inside and self.tag == "header"):
            return True
        if self.attrs and self.tag not in ("html", "body", "article", "main"):
            found: set[str] = set()
            for m in ATTR.finditer(self.attrs):
                name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
                    return True
                if name in ("class", "id"):
                    found |= marks(value)
            if found and self.tag not in HEADINGS and self.words < MOST * whole:
                running = self.words - self.linked
                return not (inside and found <= WEAK and running >= RUNNING and running >= self.linked)
        return False


def count_words(root: Node) -> None:
    """Words of each element, and those in links, but for what has no text of its own."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        link = link or node.tag == "a"
        stack += [(kid, link) for kid in node.kids if not isinstance(kid, str) and kid.tag not in ("script", "style", "head")]
    for node, link in reversed(order):
        own = sum(len(kid.split()) for kid in node.kids if isinstance(kid, str))
        node.words = own + sum(kid.words for kid in node.kids if not isinstance(kid, str))
        node.linked = node.words if link or node.tag == "a" else sum(kid.linked for kid in node.kids if not isinstance(kid, str))


class Open:
    """Open elements, with the places of each name and of blocks, so that no end tag looks through all of them."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK and node.tag != "p":
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags: set[str] | frozenset[str] | tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, i: int) -> None:
        """End the element at a place and all in it."""
        for node in self.stack[i:]:
            self.places[node.tag].pop()
        while self.blocks[-1] >= i:
            self.blocks.pop()
        del self.stack[i:]


def tree(page: str) -> Node:
    """Element tree of a page, with the usual implied end tags. A tag that has no end is text."""
    root = Node("#root")
    opened, at, text = Open(root), 0, 0
    while True:
        start = page.find("<", at)
        if start < 0:
            if text < len(page):
                opened.stack[-1].kids.append(page[text:])
            return root
        at, tag, m, raw = start + 1, None, None, None
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", start):
            end = page.find("]]>", start + 9)
            at = len(page) if end < 0 else end + 3
            raw = page[start + 9 : len(page) if end < 0 else end].replace("&", "&amp;")
        elif page[at : at + 1] in ("!", "?"):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        else:
            m = (END if page[at : at + 1] == "/" else START).match(page, start)
            if m is None:
                continue
            tag, at = m[1].lower(), m.end()
        if start > text:
            opened.stack[-1].kids.append(page[text:start])
        text = at
        if raw is not None:
            opened.stack[-1].kids.append(raw)
        if tag is None:
            continue
        if page[start + 1] == "/":
            i = opened.nearest((tag,))
            # a stray end tag of an inline element does not end blocks
            if i > 0 and (tag in BLOCK or i > opened.blocks[-1]):
                opened.close(i)
            continue
        if tag in CLOSES_P and (i := opened.nearest(("p",))) > opened.blocks[-1]:
            opened.close(i)
        if tag in CLOSERS and (i := opened.nearest(CLOSERS[tag])) > max(0, opened.nearest(SCOPE[tag])):
            opened.close(i)
        if opened.stack[-1].tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            opened.close(len(opened.stack) - 1)
        node = Node(tag, m[2].rstrip("/") if m[2] else "")
        opened.stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.kids.append(page[at : end.start() if end else len(page)])
            at = text = end.end() if end else len(page)
            continue
        opened.push(node)


def candidates(root: Node) -> Iterator[tuple[int, Node]]:
    """(hash, element) of subtrees that may be template: not the article, its ancestors, nor blocks of running text in it."""
    order, stack = [], [(root, False)]
    while stack:  # parents before children
        node, inside = stack.pop()
        order.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        stack += [(kid, inside) for kid in node.kids if not isinstance(kid, str)]
    done: dict[int, tuple[bytes, bool]] = {}
    for node, inside in reversed(order):
        h, holds = xxhash.xxh3_64(), node.tag in ("article", "main")
        h.update(f"<{node.tag} {node.attrs}>".encode("utf-8", "surrogatepass"))
        for kid in node.kids:
            if isinstance(kid, str):
                h.update(SPACE.sub(" ", kid).encode("utf-8", "surrogatepass"))
            else:
                k, below = done.pop(id(kid))
                holds |= below
                h.update(k)
        value = h.intdigest()
        if not holds and node.tag not in NEVER and not (inside and node.tag in LISTS):
            yield value - (1 << 63), node
        done[id(node)] = value.to_bytes(8, "little"), holds


# Elements that are never template by themselves: page frames, running text and what is inline in it.
NEVER = frozenset("#root html body head p h1 h2 h3 h4 h5 h6 blockquote pre a b i em strong span br hr img u s small big sub sup code q cite mark font center figcaption script style title meta link".split())
# Those that are not inside an article.
LISTS = frozenset("ul ol dl li dd dt table tbody thead tr td th figure".split())


def text_of(root: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page, blocks joined by an empty line.

    If without the template nothing is left, as on copies of one page, the template is not deleted.
    """
    if template:
        gone = [node for h, node in candidates(root) if h in template]
        for node in gone:
            node.template = True
        said = text_of(root)
        if said or not gone:
            return said
        for node in gone:
            node.template = False

    count_words(root)
    tops, stack = [], [root]
    while stack:
        for kid in reversed(stack.pop().kids):
            if not isinstance(kid, str) and not kid.unwanted(False, root.words):
                stack.append(kid)
        while stack and stack[-1].tag in ("article", "main"):
            tops.append(stack.pop())

    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            said = SPACE.sub(" ", unescape("".join(run)).replace("\u00a0", " ")).strip()
            if said:
                blocks.append(said)
            run.clear()

    for top in tops or [root]:
        stack = [(top, 0)]
        while stack:
            node, i = stack.pop()
            if i == len(node.kids):
                if node.tag in BLOCK:
                    flush()
                continue
            stack.append((node, i + 1))
            kid = node.kids[i]
            if isinstance(kid, str):
                run.append(kid)
            elif kid.tag == "br":
                run.append(" ")
            elif not kid.unwanted(bool(tops), top.words):
                if kid.tag in BLOCK:
                    flush()
                stack.append((kid, 0))
        flush()
    return "\n\n".join(blocks)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"


def extract(pages: DataFrame, min_pages: int = 8, min_share: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """Columns in keep and text, n_chars for each row of pages (url, html).

    A subtree is template if it is on at least min_pages pages of its host and on min_share of them.
    """
    kept = pages.columns if keep is None else keep
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["host", "subtree", "n"])
            seen.clear()
            return b

        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {value for value, _ in candidates(tree(page or ""))}
                for value in (*own, PAGE):
                    seen[h, value] = seen.get((h, value), 0) + 1
            if len(seen) > 200_000:
                yield out()
        yield out()

    counts = pages.select(host, "html").mapInArrow(hashes, "host string, subtree long, n long").groupBy("host", "subtree").agg(F.sum("n").alias("n")).where((F.col("n") >= min_pages) | (F.col("subtree") == PAGE))
    counts = materialize(counts, "subtrees")
    totals = counts.where(F.col("subtree") == PAGE).select("host", F.col("n").alias("pages"))
    # at least a share of a host's pages each: a bounded list for each host
    template = counts.where(F.col("subtree") != PAGE).join(totals, "host").where(F.col("n") >= min_share * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_set("subtree")).alias("template"))
    template = materialize(template, "template")
    size = template.agg(F.coalesce(F.sum(F.size("template") + 4), F.lit(0))).first()[0]
    joined = pages.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept))).alias("kept"), "html", host)
    # beyond a size that is safe to broadcast, Spark shuffles pages by host and splits hot hosts, as both sides are plain reads
    joined = joined.join(F.broadcast(template) if size <= BROADCAST else template, "host", "left").select("kept", "html", "template")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [text_of(tree(page or ""), frozenset(t or ())) for page, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array([len(x) for x in said], pa.int64())], names=["kept", "text", "n_chars"])

    schema = joined.select("kept").schema.add("text", "string").add("n_chars", "long")
    out = joined.mapInArrow(texts, schema)
    return out.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(kept)), "text", "n_chars")


#: Numbers in a list of templates that are broadcast at most.
BROADCAST = 2_000_000
#: Counts the pages of a host; no subtree hashes to it but by accident.
PAGE = (1 << 63) - 1
