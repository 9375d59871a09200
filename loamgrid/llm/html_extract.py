"""Main text of web pages by removal of site templates.

Each page is parsed into elements, and every block element that doesn't hold the
article or its heading is hashed as a subtree, in two ways: by names and text, and
by its shape: names, roles, classes and ids (digits masked) and the set of shapes
within it, without any text. Spark counts on how many different pages of a host
each subtree recurs, and what recurs on ``MIN_PAGES`` pages or more is deleted from
every page of that host. Menus, adverts, footers and comments keep their shape from
page to page where their words change.

A shape only counts where it tells more than a plain paragraph or list: an element
with a class, id or role, one that HTML has for such parts (``nav``, ``footer``),
or one of mostly links. The page's main block is no template: the article, or where
none is marked, the block that holds most of the text, and what lies in it. In it
only equal text on ``MIN_INSIDE`` pages or more and more than half of the host's is
deleted, as articles quote each other.

Elements that never hold an article's text (scripts, form controls, navigation)
go in any case; so do adverts and comments within an article that say so in a class
of just that name. A host of fewer than ``MIN_PAGES`` different pages shows no
recurrence: there rules by class, and the article's own mark, take the place.

Two pages count as different if their titles, first headings or articles (all
text, where none is marked) differ; copies of a page, whatever their urls, count
once and don't turn its text into a template.

The recurring keys are sent to the workers only up to ``BROADCAST_KEYS``; beyond
that they are joined to the pages that hold them.

Cases: null or empty html gives an empty text; a null url is a host of its own;
a very long page is read whole, in time and memory by its length, and nested to
any depth; repeated rows give a row each; a null page_id stays null; a subtree
counts once a page, so ties don't arise; further columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, session

MIN_PAGES = 4
MIN_INSIDE = 8
BROADCAST_KEYS = 2_000_000

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening element closes an open one of these names, within the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = frozenset("head script style noscript template nav footer aside form dialog menu iframe svg math object embed video audio canvas select button textarea title xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended recommendations comment comments disqus respond replies login search widget pagination pager copyright skip".split()
)
MAIN = frozenset(["article", "main"])
#: Elements whose shape tells a template by their name alone; inline elements that are part of a shape.
STRUCTURAL = frozenset("nav footer aside header form dialog menu".split())
SHAPED = frozenset("a img input select button textarea".split())
#: A class of one of these names alone marks an advert or comments, within an article too.
FOREIGN = frozenset("ad ads advert adverts advertisement sponsored adsbygoogle comments disqus".split())
DIGITS = re.compile(r"\d+")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("tag", "attributes", "children", "holds", "chars", "linked", "digest", "shape")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes = tag, attributes
        self.children: list = []
        self.holds = tag in MAIN or tag == "h1"  # it or something in it is the article or its heading
        self.chars = self.linked = 0  # of text, and of text in links

    def named(self) -> dict[str, str]:
        """Classes, id, role and the like."""
        return {n.lower(): v.strip("\"'").lower() for n, v in ATTRIBUTE.findall(self.attributes)} if self.attributes else {}


def parse(source: str) -> Node:
    """The element tree of a page; a child is an element or a run of text."""
    root = Node("", "")
    stack, at, n = [root], 0, len(source)
    nodes, is_open = [root], Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            is_open[node.tag] -= 1
            stack[-1].holds |= node.holds
            stack[-1].chars += node.chars
            stack[-1].linked += node.chars if node.tag == "a" else node.linked

    def text(a: int, b: int) -> None:
        if b > a:
            run = source[a:b]
            stack[-1].children.append(html.unescape(run) if "&" in run else run)
            stack[-1].chars += b - a

    while True:
        m = TOKEN.search(source, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            block = tag in BLOCKS
            for depth in range(len(stack) - 1 if is_open[tag] else 0, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if not block and stack[depth].tag in BLOCKS:
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1 if is_open["p"] else 0, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in BLOCKS:
                    break
        elif tag in CLOSES:
            ends, within = CLOSES[tag]
            found = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in within:
                    break
                if stack[depth].tag in ends:
                    found = depth
            if found:
                close(found)
        node = Node(tag, m[3])
        nodes.append(node)
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            if tag == "title":
                node.children.append(html.unescape(source[at : end.start() if end else n]))
            at = end.end() if end else n
            continue
        stack.append(node)
        is_open[tag] += 1
    close(1)
    for node in reversed(nodes):  # an element comes after those that it lies in
        parts = [node.tag.encode("utf-8", "surrogatepass")]
        for c in node.children:
            if not isinstance(c, str):
                parts.append(c.digest)
            elif words := c.split():
                parts.append(" ".join(words).encode("utf-8", "surrogatepass"))
        node.digest = xxhash.xxh3_64_digest(b"\0".join(parts))
        within = sorted({c.shape for c in node.children if not isinstance(c, str) and (c.tag in BLOCKS or c.tag in SHAPED)})
        names = [f"{n}={' '.join(sorted(DIGITS.sub('0', v).split()))}" for n, v in sorted(node.named().items())]
        node.shape = xxhash.xxh3_64_digest(b"\0".join([" ".join([node.tag, *names]).encode("utf-8", "surrogatepass"), *within]))
    return root


def events(root: Node, into=lambda node: True):
    """Depth first, without recursion: each run of text, each element, and None after an element that was gone ``into``."""
    stack = [(root, iter(root.children))]
    while stack:
        c = next(stack[-1][1], None)
        if c is None:
            node, _ = stack.pop()
            if stack:
                yield node, False
        elif isinstance(c, str):
            yield c, True
        else:
            yield c, True
            if into(c):
                stack.append((c, iter(c.children)))


def text_of(root: Node) -> str:
    return " ".join("".join(c for c, _ in events(root) if isinstance(c, str)).split())


def shown(root: Node) -> str:
    """All text of an element but that of heads, scripts and styles."""
    hidden = ("head", "script", "style", "noscript", "template")
    return " ".join("".join(c if isinstance(c, str) else " " for c, _ in events(root, lambda x: x.tag not in hidden)).split())


def first(root: Node, *tags: str) -> Node | None:
    return next((c for c, _ in events(root) if not isinstance(c, str) and c.tag in tags), None)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def key_of(host: str, digest: bytes, kind: bytes = b"0") -> int:
    """Signed 64-bit hash of a host's subtree by its kind: text outside articles (0), within (1), or shape (s); of the host with an empty digest."""
    return xxhash.xxh3_64_intdigest(kind + digest + host.encode("utf-8", "surrogatepass")) - 2**63


def candidate(node: Node) -> bool:
    """A block with text that doesn't hold the article: it may be a template."""
    return node.tag in BLOCKS and not node.holds and node.chars > 0 and node.tag not in ("html", "body", "head")


def shaped(node: Node) -> bool:
    """Whether a candidate's shape tells more than a plain paragraph or list."""
    return node.tag in STRUCTURAL or 2 * node.linked >= node.chars or bool(node.named())


def main_blocks(root: Node) -> set[int]:
    """The page's main block and what holds it: the articles, else from the page down as long as one block has most of the unlinked text."""
    if first(root, *MAIN) is not None:
        return set()
    node, path = root, {id(root)}
    while True:
        inner = [c for c in node.children if not isinstance(c, str) and c.tag in BLOCKS and c.tag not in DROPPED]
        best = max(inner, key=lambda c: c.chars - c.linked, default=None)
        if best is None or 2 * (best.chars - best.linked) <= node.chars - node.linked:
            return path
        node = best
        path.add(id(node))


class Place:
    """Where a walk through a page is: within the main block or not."""

    def __init__(self, root: Node):
        self.path, self.inside = main_blocks(root), 0
        self.deepest = None
        if self.path:  # the last of the path is the block itself
            node = root
            while True:
                inner = next((c for c in node.children if not isinstance(c, str) and id(c) in self.path), None)
                if inner is None:
                    break
                node = inner
            self.deepest = node if node.tag not in ("", "html", "body") else None

    def main(self, node: Node) -> bool:
        return node.tag in MAIN or node is self.deepest

    def keys(self, host: str, node: Node) -> list[int]:
        """The keys by which an element may be deleted."""
        if not candidate(node) or id(node) in self.path:
            return []
        out = [key_of(host, node.digest, b"%d" % (self.inside > 0))]
        if shaped(node) and (not self.inside or node.tag in STRUCTURAL):
            out.append(key_of(host, node.shape, b"s"))
        return out


def subtree_keys(url: str | None, source: str) -> tuple[dict[int, bool], int, int]:
    """A page's candidate subtrees, each once, with whether they are text in an article; the keys of its host and of itself."""
    root, host = parse(source), host_of(url)
    main = first(root, *MAIN)
    name = "\0".join([*(text_of(x) for x in (first(root, "title"), first(root, "h1")) if x is not None), shown(main or root)])
    own, place = key_of(host, b""), Place(root)
    keys = {own: False}
    for c, opened in events(root, lambda x: x.tag not in RAW):
        if isinstance(c, str):
            continue
        if opened:
            for n, k in enumerate(place.keys(host, c)):
                keys[k] = place.inside > 0 and not n
        if place.main(c):
            place.inside += 1 if opened else -1
    return keys, own, xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) - 2**63


def boilerplate(node: Node, in_main: bool, by_class: bool) -> bool:
    """The rules by element and role, and those by class: within the main block of one name alone, elsewhere of any part of a name."""
    if node.tag in DROPPED or node.tag == "header" and not (in_main or node.holds):
        return True
    if node.holds or not node.attributes or node.tag in ("html", "body"):
        return False
    names = node.named()
    if "hidden" in names or names.get("role") in DROPPED_ROLES:
        return True
    if in_main:
        return not FOREIGN.isdisjoint(names.get("class", "").split())
    return by_class and any(not DROPPED_WORDS.isdisjoint(re.split(r"[\s_-]+", names.get(n, ""))) for n in ("class", "id"))


def main_text(url: str | None, source: str, recurring, large: bool | None = None, rules=boilerplate) -> str:
    """Text of a page without the subtrees whose keys are ``recurring``, one line a block; ``large``: of a host with recurrence (else told by the keys)."""
    root, host = parse(source), host_of(url)
    large = recurring(key_of(host, b"")) if large is None else large
    only_main = not large and first(root, *MAIN) is not None
    lines: list[str] = []
    run: list[str] = []
    place = Place(root)

    def flush():
        line = " ".join("".join(run).split())
        run.clear()
        if line:
            lines.append(line)

    def kept(node: Node) -> bool:
        return not any(map(recurring, place.keys(host, node))) and not rules(node, place.inside > 0, not large)

    state = {"into": True}
    for c, opened in events(root, lambda _: state["into"]):
        if isinstance(c, str):
            if place.inside or not only_main:
                run.append(c)
            continue
        if opened and c.tag == "br":
            run.append(" ")
        if c.tag in BLOCKS:
            flush()
        if opened:
            state["into"] = kept(c)
        if place.main(c) and (not opened or state["into"]):
            place.inside += 1 if opened else -1
    flush()
    return "\n".join(lines)


def _keys(batches):
    for b in batches:
        rows = []
        for url, source in zip(b.column(0), b.column(1)):
            found, host, name = subtree_keys(url.as_py(), source.as_py())
            rows += [(k, host, inside, name) for k, inside in found.items()]
        cols = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["key", "host", "inside", "page"])


def _texts(batches, sets):
    """``sets``: whether a key recurs, given the row's own list of recurring keys or None."""
    for b in batches:
        own = b.column(3) if b.num_columns > 3 else [None] * b.num_rows
        out = [main_text(url.as_py(), source.as_py(), sets(k)) for url, source, k in zip(b.column(1), b.column(2), own)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_inside: int = MIN_INSIDE, broadcast_keys: int = BROADCAST_KEYS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    spark = session(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.select("url", "html").mapInArrow(_keys, "key long, host long, inside boolean, page long")
    counts = materialise(keyed.groupBy("key", "host", "inside").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages), "subtrees")
    hosts = counts.where("key = host").select("host", F.col("n").alias("pages"))
    many = ~F.col("inside") | (F.col("n") >= min_inside) & (2 * F.col("n") > F.col("pages"))
    recurring = counts.join(hosts, "host").where(many).select("key")
    held = recurring.limit(broadcast_keys + 1).toArrow().column("key")
    schema = "page_id long, url string, text string"
    if len(held) <= broadcast_keys:
        keys = spark.sparkContext.broadcast(np.sort(held.to_numpy()))

        def shared(_own):
            a = keys.value

            def known(k: int) -> bool:
                i = int(np.searchsorted(a, k))
                return i < len(a) and a[i] == k

            return known

        out = rows.mapInArrow(lambda it: _texts(it, shared), schema)
    else:
        page_keys = rows.select(F.xxhash64("url", "html").alias("row"), "url", "html").distinct().mapInArrow(_keys_of_rows, "row long, key long")
        listed = page_keys.join(recurring, "key").groupBy("row").agg(F.collect_set("key").alias("keys"))
        joined = rows.withColumn("row", F.xxhash64("url", "html")).join(listed, "row", "left").select("page_id", "url", "html", "keys")
        out = joined.mapInArrow(lambda it: _texts(it, lambda own: frozenset(own.as_py() or ()).__contains__), schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def _keys_of_rows(batches):
    for b in batches:
        rows, keys = [], []
        for row, url, source in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            found = subtree_keys(url.as_py(), source.as_py())[0]
            keys += found
            rows += [row] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.int64())], names=["row", "key"])
