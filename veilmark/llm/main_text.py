"""Operator 4: main text of web pages with a site style tree for each host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilmark.llm.common import bound_batches, parts, written
from veilmark.llm.dom import BLOCK, RAW, Node, parse

#: Elements, roles and words of class or id that say a branch is no main text.
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select head hr datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments respond disqus share sharing social "
    "related recommended newsletter subscribe popup modal overlay signup login toolbar pagination pager widget skip".split()
)
_CONTENT_ROOTS = ("article", "main")
_TITLED = frozenset("h1 h2 h3 h4 h5 h6 section a span".split())
_WORD = re.compile(r"[a-z0-9]+")
#: Removal lists of hosts up to this number are broadcast; more are joined by a shuffle.
_BROADCAST_PATHS = 100_000
_GAMMA = 0.9


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _nodes(root: Node) -> Iterator[Node]:
    """The elements below `root` in page order, without recursion."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


class Page:
    """A parsed page with the style of every element: its path of tags and classes as one number."""

    def __init__(self, html: str | None) -> None:
        self.root = parse(html)
        self.above_roots: set[int] = set()
        for node in _nodes(self.root):
            up = node.parent if node.tag in _CONTENT_ROOTS else None
            while up is not None and id(up) not in self.above_roots:
                self.above_roots.add(id(up))
                up = up.parent
        self._classify(True)
        if self.above_roots and not self.has_root:
            self._classify(False)

    def _classify(self, named: bool) -> None:
        """Path and kind of every element; `named`: whether class names make noise of what holds an article or main."""
        self.path: dict[int, int] = {}
        self.kind: dict[int, str] = {}
        holds_root: set[int] = set()
        for node in _nodes(self.root):
            above = self.path.get(id(node.parent), 0)
            attributes = node.attributes()
            style = f"{node.tag}.{'.'.join(sorted(attributes.get('class', '').lower().split()))}"
            self.path[id(node)] = _hash(f"{above}/{style}")
            self.kind[id(node)] = self._prior(node, attributes, named)
            if node.tag in _CONTENT_ROOTS and self.kind[id(node)] != "noise" and self.kind[id(node.parent)] not in ("dropped", "noise"):
                self.kind[id(node)] = "content" if node.tag == "article" else "main"
                up = node.parent
                while up is not None and id(up) not in holds_root:
                    holds_root.add(id(up))
                    up = up.parent
        self.has_article = "content" in self.kind.values()
        self.has_root = bool(holds_root)
        self.holds_root = holds_root

    def _prior(self, node: Node, attributes: dict[str, str], named: bool) -> str:
        """dropped: no text at all; noise: named as something beside the main text; inner: in a content root; plain."""
        above = self.kind.get(id(node.parent), "plain")
        if above == "dropped" or node.tag in RAW or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return "dropped"
        if above == "noise":
            return "noise"
        inner = above in ("content", "main", "inner")
        if node.tag not in ("html", "body", "#root", *_CONTENT_ROOTS):
            classes, own_id = attributes.get("class", "").lower(), attributes.get("id", "").lower()
            if id(node) in self.above_roots:  # layout names like has-sidebar
                words = set(classes.split()) if named else set()
            elif inner:  # ids of headings and sections come from their titles
                words = {*classes.split(), *([] if node.tag in _TITLED else [own_id])}
            else:
                words = set(_WORD.findall(f"{classes} {own_id}"))
            if node.tag in NOISE_TAGS or attributes.get("role", "").lower() in NOISE_ROLES or words & NOISE_WORDS:
                return "noise"
            if node.tag == "header" and not inner:
                return "noise"
        return "inner" if inner else "plain"

    def style_rows(self) -> Iterator[tuple[int, str, int, list[int] | None, int | None]]:
        """(path, kind, feature, ancestors, article) of the style tree's nodes; article is a hash of the content root's text for nodes in one.

        Presentation: the order of the children's styles, all nodes of a path together. Content: each block's text.
        """
        shapes: dict[int, list[str]] = {}
        ancestors: dict[int, tuple] = {}
        contents: set[tuple[int, int]] = set()
        inner: set[int] = set()
        for node in _nodes(self.root):
            kind = self.kind[id(node)]
            if kind in ("dropped", "content", "main"):
                continue
            path = self.path[id(node)]
            if kind == "inner":
                inner.add(path)
            ancestors.setdefault(path, (ancestors.get(self.path.get(id(node.parent), 0)), path))
            shapes.setdefault(path, []).append(" ".join(c.tag if isinstance(c, Node) else "#" for c in node.children))
            own = " ".join(" ".join(c.split()) for c in node.children if isinstance(c, str)).strip()
            if own:
                contents.add((path, _hash(own)))
        whole = _hash(self.text()) if inner else None
        for path, found in shapes.items():
            up, above = [], ancestors[path]
            while above is not None:
                up.append(above[1])
                above = above[0]
            yield path, "p", _hash("|".join(found)), up, whole if path in inner else None
        for path, feature in contents:
            yield path, "c", feature, None, whole if path in inner else None

    def _kept(self, low: frozenset[int]) -> set[int]:
        """Elements that importance can't remove: they hold a content root, or a text outside the branches of `low`."""
        kept = set(self.holds_root)
        for node in _nodes(self.root) if low and not self.has_root else ():
            if self.kind[id(node)] == "plain" and self.path[id(node)] not in low and any(isinstance(c, str) and c.strip() for c in node.children):
                while node is not None and id(node) not in kept:
                    kept.add(id(node))
                    node = node.parent
        return kept

    def _boilerplate(self, low: frozenset[int]) -> set[int]:
        """Elements in a content root whose branch is of low importance; none if they hold over a quarter of its characters, as then
        they are the text of pages that are much alike, and no boilerplate in it."""
        found: set[int] = set()
        total = dropped = 0
        for node in _nodes(self.root) if low and self.has_root else ():
            if self.kind[id(node)] not in ("inner", "content", "main"):
                continue
            if id(node.parent) in found or (self.kind[id(node)] == "inner" and self.path[id(node)] in low):
                found.add(id(node))
            size = sum(len(c.strip()) for c in node.children if isinstance(c, str))
            total += size
            dropped += size if id(node) in found else 0
        return found if dropped * 4 <= total else set()

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """The blocks of the main text, joined by newlines, without branches that are noise or of low importance."""
        blocks, words = [], []
        kept, boilerplate = self._kept(low), self._boilerplate(low)
        stack: list = [self.root]
        wanted = ("content", "inner") if self.has_article else ("main", "inner") if self.has_root else None
        inside_article = {id(self.root): False}

        def end() -> None:
            joined = " ".join("".join(words).split())
            if joined:
                blocks.append(joined)
            words.clear()

        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                end() if node[0] in BLOCK else words.append(" ")
                continue
            if isinstance(node, str):
                words.append(node)
                continue
            kind = self.kind[id(node)]
            if kind in ("dropped", "noise") or id(node) in boilerplate or (kind == "plain" and self.path[id(node)] in low and id(node) not in kept):
                if node.tag in BLOCK:
                    end()
                continue
            inside = inside_article.get(id(node.parent), False) or kind == ("content" if self.has_article else "main")
            inside_article[id(node)] = inside
            if node.tag in BLOCK:
                end()
                stack.append((node.tag,))
            elif node.tag in ("br", "td", "th", "img", "wbr"):
                words.append("" if node.tag == "wbr" else " ")
                if node.tag in ("td", "th"):
                    stack.append((node.tag,))
            for c in reversed(node.children):
                if isinstance(c, Node) or wanted is None or inside:
                    stack.append(c)
        end()
        return "\n".join(blocks)


def host_of(url: str = "url"):
    """The lower-cased host of an address column; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def low_importance(pages: DataFrame, min_pages: int = 5, threshold: float = 0.25) -> DataFrame:
    """(host, path): branches of each host's style tree whose importance is below `threshold`.

    The DOMs of a host merge by their paths of tags and classes. A node's presentation importance is the entropy
    of its children's order over the m pages that have it, to base m; its content importance is 1 less the mean
    entropy of its blocks' texts over pages: a text on all pages has entropy 1, a text of its own 0. An inner
    node weighs its own presentation by 1 - 0.9**(number of its shapes) and its branch's contents by the rest.
    A page loses a branch only if the branch holds no content root and no text of an element of higher importance.
    Inside a content root each different article counts once, whatever pages copy it, so that copies make no text unimportant.
    Paths on fewer than `min_pages` pages are never judged. Counts combine on the map side, so a host with a
    third of all pages is no larger than its number of different nodes and texts.
    """
    schema = "host bigint, path bigint, kind string, feature bigint, ancestors array<bigint>, article bigint"
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                rows = [(host, *r) for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in Page(html).style_rows()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, arrow_schema.types, strict=True)], schema=arrow_schema)

    bound_batches(pages.sparkSession)
    rows = written(pages.select(F.xxhash64(host_of()).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(styles, schema))
    key = ["host", "path", "kind", "feature"]
    outside = rows.filter("article is null").groupBy(*key).agg(F.count("*").alias("n"), F.first("ancestors", True).alias("ancestors"))
    inside = rows.filter("article is not null").groupBy(*key, "article").agg(F.first("ancestors", True).alias("ancestors"))
    counts = outside.unionByName(inside.groupBy(*key).agg(F.count("*").alias("n"), F.first("ancestors", True).alias("ancestors")))
    nodes = written(
        counts.groupBy("host", "path").agg(
            F.sum(F.when(F.col("kind") == "p", F.col("n"))).alias("m"),
            F.sum(F.when(F.col("kind") == "p", F.col("n") * F.log("n"))).alias("shape_nlogn"),
            F.count(F.when(F.col("kind") == "p", 1)).alias("shapes"),
            F.coalesce(F.sum(F.when(F.col("kind") == "c", F.col("n"))), F.lit(0)).alias("texts"),
            F.coalesce(F.sum(F.when(F.col("kind") == "c", F.col("n") * F.log("n"))), F.lit(0.0)).alias("text_nlogn"),
            F.first("ancestors", True).alias("ancestors"),
        ).filter(F.col("m") >= min_pages)
    )
    branches = nodes.select("host", F.explode("ancestors").alias("path"), "texts", (F.col("text_nlogn") / F.log("m")).alias("spread"))
    branches = branches.groupBy("host", "path").agg(F.sum("texts").alias("texts"), F.sum("spread").alias("spread"))
    m = F.col("m")
    presentation = (F.log(m) - F.col("shape_nlogn") / m) / F.log(m)
    content = 1 - F.col("branch.spread") / F.col("branch.texts")
    own = F.lit(1) - F.pow(F.lit(_GAMMA), F.col("shapes"))
    judged = nodes.alias("node").join(branches.alias("branch"), ["host", "path"]).filter("branch.texts > 0")
    return judged.filter(own * presentation + (1 - own) * content < threshold).select("host", "path")


def main_texts(pages: DataFrame, min_pages: int = 5, threshold: float = 0.25) -> DataFrame:
    """One row for each row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    A first pass builds the style tree of every host and lists its branches of low importance; a second one
    removes those from each page, and what its elements, roles or class names call a menu, header, footer,
    sidebar, notice, advert, form or comment. Pages with an article (else a main element) give that element's
    text; in it a branch goes whose importance over different articles of the host is low (a share line, a legal line, a teaser), unless such
    branches are over a quarter of it: a text that other pages copy is still main text there. Inside it, and on
    what holds it, only a whole class name (inside also a whole id, but not of a heading or section) counts, not a part
    between hyphens; where such a name would leave a page without any article or main element, it doesn't count.

    Character references are decoded, white space in a block is one space, blocks join by a newline; nothing
    is capped. A null page, and one without main text, gives an empty text. A null url belongs to the host
    without a name. Repeated rows get a row each; other columns are not read.
    """
    low = written(low_importance(pages, min_pages, threshold).groupBy("host").agg(F.collect_set("path").alias("low"), F.count("*").alias("n")))
    size = low.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lists = low.select("host", "low")
    id_type = dict(pages.dtypes)["page_id"]
    schema = f"page_id {id_type}, url string, text string"
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64(host_of()).alias("host"))
    rows = rows.join(F.broadcast(lists) if size <= _BROADCAST_PATHS else lists, "host", "left").select("page_id", "url", "html", "low")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                texts = [Page(html).text(frozenset(paths or ())) for html, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema=arrow_schema)

    return rows.mapInArrow(extract, schema).withColumn("n_chars", F.length("text").cast("bigint"))
