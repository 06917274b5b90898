"""Main text of web pages by wrapper induction.

Every page becomes a DOM tree; neighbouring siblings of one label and kind count as one repeated node. A label is the tag with
its class and id names, without those that hold a digit, as they number pages. Trees of the same host are aligned by simple
tree matching into one template per host, in every task first and then between tasks. A template node knows on how many pages
it occurred, whether its own text was the same on all of them, and how much text it had inside and outside links.

The template decides, from ``SUPPORT`` distinct pages on:

* Constant text is template, and so is a block among like siblings whose text stands on at least half of the host's pages with
  such blocks. Headings of an article stay though they are constant, as their sections vary.
* The way from the root to the node with most varying text outside links leads to the main content. Containers beside that way
  go if most of their text is linked or if they hold little text, unless they have the main heading.

Tags, roles and names of classes and ids that say menu, header, footer, sidebar, notice, advert, form or reader comments come
before it, on hosts of few pages too: a part goes if all words of a name are listed, or if one is and it holds little of the
page's text (``PARTLY_NAMED``). Never dropped by name are the body, an article or main element, what holds the page's main
element, first heading or article (a form around the page), and headers inside an article.

Copies of an article may stand on one host many times under other adverts and menus: pages count as one if they have the same
text in their root, which is the article or main element that holds most of the text outside named parts, else the whole page.

All pages take part in their host's template; they are parsed twice, to build it and to apply it. A template holds ``NODES``
nodes at most: beyond that those seen on the fewest pages go, and what they would have decided stays content. A task holds
``TEMPLATES`` of them before they are handed on. Partial templates of a host are merged in two steps, so a host with most of
all pages isn't merged in one task.

Defined cases: a null html gives the empty text; a null or broken url is the host ``''``; a page without markup is one block;
an unfinished tag at the end is dropped and an unfinished comment, script or style runs to the end; repeated rows are
extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import column, finish, store, stored

SUPPORT = 3           # pages on which a text must stand unchanged to be template
TEMPLATES = 5_000     # hosts whose templates a task holds at a time
SALT = 64
NODES = 2_000         # nodes of a template; beyond that, those seen on the fewest pages go
LABEL_NAMES = 4       # the tag and so many of a node's names make its label
MAIN = 0.6            # share of a node's text that makes one of its children the way to the main content
MINOR = 0.1           # parts beside that way with less than this share of the main content's text are none of it
PARTLY_NAMED = 0.3    # parts with one listed word in a name go if they hold less than this share of the page's text
DEPTH = 120           # elements nested deeper add their text to the one at this depth
BROADCAST_HOSTS = 2_000
BROADCAST_BYTES = 8 << 20

# Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "button")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                 "th": ("td", "th"), "option": ("option",)}
KEEPS_ITEMS = frozenset("ul ol dl table menu".split())
OTHER_TAGS = frozenset("nav footer aside form menu dialog head".split())
HEADERS = frozenset("header banner masthead".split())
ASIDE = frozenset("nav footer aside menu dialog head".split())  # never around the main content
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
OTHER_NAMES = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar side "
                        "menu nav navbar navigation breadcrumb breadcrumbs header masthead footer notice notices cookie "
                        "cookies consent gdpr alert popup modal overlay comment comments reply replies respond disqus share "
                        "sharing social related recommended newsletter subscribe subscription signup login search form "
                        "widget toolbar pagination pager".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
ARTICLE = re.compile(r"/(?:article|main)[./]")
DIGIT = re.compile(r"\d")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption summary figcaption".split())
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 figure".split())
HOST = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    __slots__ = ("tag", "label", "top", "other", "maybe", "kids")

    def __init__(self, tag: str, attributes: str = ""):
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        names = sorted({*found.get("class", "").split(), *found.get("id", "").split()})
        self.tag = tag
        self.label = ".".join([tag, *(n for n in names if not DIGIT.search(n))][:LABEL_NAMES])  # numbered names differ by page
        words_of = [{*re.split(r"[-_\d]+", n.lower())} - {""} for n in names]
        named = [words for words in words_of if words and words <= OTHER_NAMES]
        self.maybe = any(words & OTHER_NAMES for words in words_of)
        self.top = any(words <= HEADERS for words in named) or found.get("role", "") == "banner" or tag == "header"
        self.other = tag in OTHER_TAGS or bool(named) or found.get("role", "") in OTHER_ROLES
        self.kids: list = []


def hashed(*parts: str) -> int:
    """A signed 64-bit hash, the same in every process."""
    whole = "\0".join(parts).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "big", signed=True)


def parse(page: str) -> Node:
    """The DOM tree; texts are raw strings among the children."""
    root = Node("#page")
    stack, at, size = [root], 0, len(page)
    too_deep: dict[str, int] = {}
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            cut = re.search(r"<[/a-zA-Z!?]", rest)
            stack[-1].kids.append(rest[:cut.start()] if cut else rest)
            break
        if m.start() > at:
            stack[-1].kids.append(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if too_deep.get(tag):
                too_deep[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in BLOCK:
            shut = CLOSES_ITSELF.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in shut:
                    del stack[i:]
                    if not shut or tag != "tr":
                        break
                elif stack[i].tag in KEEPS_ITEMS or stack[i].tag in ("div", "article", "section", "td", "li"):
                    break
        if len(stack) >= DEPTH and tag not in VOID:
            too_deep[tag] = too_deep.get(tag, 0) + 1
            continue
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag not in VOID:
            stack.append(node)
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Take back "other" where it can't hold: around the main content, and for headers inside an article."""
    found: dict[str, list[Node]] = {}

    def walk(node: Node, above: list[Node], inside: bool, top: bool) -> None:
        if node.tag in ("html", "body", "main", "article"):
            node.other = False
        elif inside and node.top:
            node.other = node.tag in OTHER_TAGS
        inside = inside or node.tag in ("main", "article")
        top = top or node.top and not inside
        above = [*above, node]
        if node.tag in ("main", "article") or node.tag == "h1" and not top:
            first = found.setdefault(node.tag, above)
            if any(n.other for n in first) and not any(n.other for n in above):
                found[node.tag] = above  # rather the first that stands in no named part
        for kid in node.kids:
            if not isinstance(kid, str) and kid.tag not in ASIDE:
                walk(kid, above, inside, top)

    walk(root, [], False, False)
    way: list[Node] = next((found[tag] for tag in ("main", "h1", "article") if tag in found), [])
    for node in way:
        node.other = False
    _name_parts(root, {id(n) for n in way})
    if way:
        return
    node = root  # without any of them, a part that holds all text
    while True:
        kids = [k for k in node.kids if (k if isinstance(k, str) else "" if k.tag in ASIDE else _inner(k)).strip()]
        if len(kids) != 1 or isinstance(kids[0], str):
            return
        node = kids[0]
        if node.tag in ("form", "body", "html"):
            node.other = False


def _name_parts(root: Node, way: set[int]) -> None:
    """Parts of which one word in a name is listed go too, if they hold little of the page's text and not its main part."""
    sizes: dict[int, int] = {}

    def measure(node: Node) -> int:
        size = sum(len(k.strip()) if isinstance(k, str) else measure(k) for k in node.kids)
        sizes[id(node)] = 0 if node.other else size
        return sizes[id(node)]

    whole = measure(root)

    def walk(node: Node) -> None:
        for kid in node.kids:
            if not isinstance(kid, str) and not kid.other:
                if (kid.maybe and kid.tag in BLOCK and kid.tag not in ("html", "body", "main", "article") and kid.tag not in HEADINGS
                        and id(kid) not in way and not kid.top and sizes[id(kid)] < PARTLY_NAMED * whole):
                    kid.other = True
                else:
                    walk(kid)

    walk(root)


class Shape:
    """A node of a page's skeleton: one or more like siblings. ``free`` and ``linked`` count its own characters outside and
    inside links, both zero in parts that are named as something else."""

    __slots__ = ("label", "text", "kids", "nodes", "owns", "free", "linked")

    def __init__(self, nodes: list[Node], named: bool = False):
        self.nodes, self.label = nodes, nodes[0].label
        self.text = self.free = self.linked = 0
        named = named or nodes[0].other
        self.owns: list[str] = []  # the own text of each node
        kids: list[list[Node]] = []
        for node in nodes:
            own: list[str] = []
            for kid in node.kids:
                if isinstance(kid, str):
                    own.append(kid)
                elif kid.tag in BLOCK or kid.other:
                    if kids and kids[-1][0].label == kid.label and _alike(kids[-1][0], kid):
                        kids[-1].append(kid)
                    else:
                        kids.append([kid])
                else:  # inline elements belong to the text around them
                    own.append(_inner(kid))
                    self.linked += 0 if named else _linked(kid)
            self.owns.append(" ".join("".join(own).split()))
            self.free += 0 if named else len(self.owns[-1])
            if self.owns[-1]:
                self.text = zlib.crc32(self.owns[-1].encode("utf-8", "surrogatepass"), self.text)
        self.free = max(0, self.free - self.linked)
        self.kids = [Shape(k, named) for k in kids]


def _alike(a: Node, b: Node) -> bool:
    """Whether neighbours of one label are the same kind of part: plain containers must hold the same kinds of children."""
    if a.tag not in ("div", "section") or "." in a.label:
        return True
    kinds = lambda node: {k.tag for k in node.kids if not isinstance(k, str)}
    return kinds(a) == kinds(b)


def _linked(node: Node) -> int:
    """Characters inside links."""
    if node.tag == "a":
        return len(_inner(node).strip())
    return sum(_linked(k) for k in node.kids if not isinstance(k, str))


def _inner(node: Node) -> str:
    return "".join(k if isinstance(k, str) else _inner(k) for k in node.kids)


def _texts(node: Node, out: list[str], roots: list[tuple[int, int]], inside: bool = False) -> None:
    """The texts outside named parts, and where among them those of outermost article and main elements begin and end."""
    top, first = node.tag in ("article", "main") and not inside, len(out)
    for kid in node.kids:
        if isinstance(kid, str):
            if kid and not kid.isspace():
                out.append(" ".join(kid.split()))
        elif not kid.other:
            _texts(kid, out, roots, inside or top)
    if top:
        roots.append((first, len(out)))


def identity(root: Node) -> int:
    """Equal for pages with the same text in their root."""
    texts: list[str] = []
    roots: list[tuple[int, int]] = []
    _texts(root, texts, roots)
    size = sum(map(len, texts))
    for a, b in roots:
        if 2 * sum(map(len, texts[a:b])) > size:
            return hashed(*texts[a:b])
    return hashed(*texts)


def template(shape: Shape, page: int = 0) -> dict:
    """A page's template: label, least identities of its pages ("n", at most ``SUPPORT``), number of pages, hash of the own text
    (null once it varies), free and linked characters on all pages, children."""
    return {"l": shape.label, "n": [page], "p": 1, "t": shape.text, "c": shape.free, "a": shape.linked,
            "k": [template(k, page) for k in shape.kids]}


def blocks_of(shape: Shape, path: str = "") -> Iterator[tuple[str, str, Node]]:
    """(path, own text, node) of every node with text."""
    path = f"{path}/{shape.label}"
    for node, own in zip(shape.nodes, shape.owns):
        if own:
            yield path, own, node
    for kid in shape.kids:
        yield from blocks_of(kid, path)


def _label(x) -> str:
    return x["l"] if isinstance(x, dict) else x.label


def _kids(x) -> list:
    return x["k"] if isinstance(x, dict) else x.kids


def matching(a, b) -> int:
    """Nodes that simple tree matching pairs in two trees."""
    if _label(a) != _label(b):
        return 0
    return 1 + _table(_kids(a), _kids(b))[0][-1][-1]


def _table(a: list, b: list) -> tuple[list[list[int]], list[list[int]]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gain = [[0] * len(b) for _ in a]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            g = gain[i][j] = matching(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + g)
    return best, gain


def aligned(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Positions of two lists of trees in one order, paired where simple tree matching pairs them."""
    if [_label(x) for x in a] == [_label(x) for x in b]:
        return [(i, i) for i in range(len(a))]
    head = 0
    while head < min(len(a), len(b)) and _label(a[head]) == _label(b[head]):
        head += 1
    best, gain = _table(a[head:], b[head:])
    i, j, out = len(a) - head, len(b) - head, []
    while i or j:
        if i and j and gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((head + i, head + j))
        elif j and best[i][j] == best[i][j - 1]:
            j -= 1
            out.append((None, head + j))
        else:
            i -= 1
            out.append((head + i, None))
    return [(k, k) for k in range(head)] + out[::-1]


def merge(into: dict, other: dict) -> dict:
    """The union of two templates with the same root label."""
    kids = []
    for i, j in aligned(into["k"], other["k"]):
        kids.append(into["k"][i] if j is None else other["k"][j] if i is None else merge(into["k"][i], other["k"][j]))
    same = into["t"] if into["t"] == other["t"] else None
    return {"l": into["l"], "n": sorted({*into["n"], *other["n"]})[:SUPPORT], "p": into["p"] + other["p"], "t": same,
            "c": into["c"] + other["c"], "a": into["a"] + other["a"], "k": kids}


def bounded(t: dict) -> dict:
    """The template with ``NODES`` nodes at most: those on the fewest pages go first, with what is below them."""
    support: list[int] = []

    def walk(node: dict) -> None:
        support.append(node["p"])
        for kid in node["k"]:
            walk(kid)

    walk(t)
    if len(support) <= NODES:
        return t
    least = sorted(support, reverse=True)[NODES // 2]  # half, so that pruning is rare

    def prune(node: dict) -> dict:
        return {**node, "k": [prune(k) for k in node["k"] if k["p"] > least]}

    return prune(t)


def judge(t: dict) -> dict:
    """Mark ("x") the parts of a host's template that stand beside its main content.

    The way to the main content leads from the root to the child with most of the varying text outside links, down to the
    article or main element or the node that holds the prose. Containers beside the way are no part of it if most of their
    text is linked or they hold little text, on the average page. Parts with a main heading stay, and so does all where no way
    shows.
    """
    def weight(node: dict) -> tuple[int, int]:
        fixed = len(node["n"]) >= SUPPORT and node["t"] is not None
        free, linked = (0, 0) if fixed else (node["c"], node["a"])
        for kid in node["k"]:
            f, a = weight(kid)
            free, linked = free + f, linked + a
        node["w"] = free, linked
        return free, linked

    tag = lambda node: node["l"].split(".")[0]
    headed = lambda node: tag(node) == "h1" or any(headed(k) for k in node["k"])
    weight(t)
    way, node = [], t
    while tag(node) not in ("article", "main"):
        prose = sum(k["w"][0] for k in node["k"] if tag(k) in PROSE)
        best = max(node["k"], key=lambda k: k["w"][0], default=None)
        if best is None or 2 * prose >= node["w"][0] or best["w"][0] < MAIN * node["w"][0]:
            break
        way.append((node, best))
        node = best
    if len(node["n"]) >= SUPPORT:
        usual = node["w"][0] / node["p"]
        for above, on in way:
            for kid in above["k"]:
                free, linked = kid["w"]
                if (kid is not on and len(kid["n"]) >= SUPPORT and tag(kid) in BLOCK and tag(kid) not in PROSE and not headed(kid)
                        and (linked > free or free / kid["p"] < MINOR * usual)):
                    kid["x"] = 1
    return t


def constant(shape: Shape, known: dict | None, out: set[int], beside: set[int], inside: bool = False) -> None:
    """Collect the nodes of a page that are template by its host's template, and those that stand beside its main content.

    A constant heading inside an article isn't template: its section varies.
    """
    if known is None:
        return
    inside = inside or shape.nodes[0].tag in ("article", "main")
    if known.get("x"):
        beside.update(map(id, shape.nodes))
    if len(known["n"]) >= SUPPORT and known["t"] is not None and shape.text and not (inside and shape.nodes[0].tag in HEADINGS):
        out.update(map(id, shape.nodes))
    for i, j in aligned(shape.kids, known["k"]):
        if i is not None:
            constant(shape.kids[i], known["k"][j] if j is not None else None, out, beside, inside)


def extract(page: str, known: dict | None, repeated: frozenset = frozenset()) -> str:
    """The page's content blocks, joined by line feeds."""
    root = parse(page)
    shape = Shape([root])
    fixed: set[int] = set()
    beside: set[int] = set()
    constant(shape, known, fixed, beside)
    if repeated:
        fixed.update(id(node) for path, own, node in blocks_of(shape)
                     if hashed(path, own) in repeated and not (node.tag in HEADINGS and ARTICLE.search(path)))
    blocks: list[str] = []
    pieces: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            blocks.append(text)
        pieces.clear()

    def walk(node: Node, inside: bool, above: bool) -> None:
        inside = inside or node.tag in ("article", "main")
        if node.other or id(node) in beside or node.tag == "header" and not inside:
            close()
            return
        block = node.tag in BLOCK
        if block:
            close()
        shown = id(node) not in fixed and (block or above)
        for kid in node.kids:
            if not isinstance(kid, str):
                if kid.tag == "br":
                    pieces.append(" ")
                else:
                    walk(kid, inside, shown)  # an inline element follows the block around it
            elif shown:
                pieces.append(kid)
        if block:
            close()

    walk(root, False, True)
    close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """The url's host in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


FIRST = "host string, template string, slot bigint, block bigint, page bigint"


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one look at a task's pages yields: templates (host, template), a host perhaps several times, and of each page's text
    blocks (host, slot, block, page); block is null once for each slot."""
    held: dict[str, dict] = {}
    kinds = (pa.string(), pa.string(), *[pa.int64()] * 3)
    names = ["host", "template", "slot", "block", "page"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names=names)

    def flush() -> pa.RecordBatch:
        out = batch_of([(host, json.dumps(t), None, None, None) for host, t in held.items()])
        held.clear()
        return out

    for batch in batches:
        rows: dict[tuple, None] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(page.as_py() or "")
            shape, same = Shape([root]), identity(root)
            new = template(shape, same)
            held[host] = bounded(merge(held[host], new)) if host in held else bounded(new)
            for path, own, _ in blocks_of(shape):
                slot = hashed(path)
                rows[host, None, slot, None, same] = rows[host, None, slot, hashed(path, own), same] = None
            if len(held) >= TEMPLATES:
                yield flush()
        yield batch_of(list(rows))
    if held:
        yield flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One template for each run of rows of one host."""
    host, held = None, None
    for batch in batches:
        out: list[tuple[str, str]] = []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            new = json.loads(text.as_py())
            if name == host:
                held = bounded(merge(held, new))
            else:
                if held is not None:
                    out.append((host, json.dumps(held)))
                host, held = name, new
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.string()),
                                          pa.array([t for _, t in out], pa.string())], names=["host", "template"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(held)])], names=["host", "template"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    repeated: dict[str, frozenset] = {}
    for batch in batches:
        texts = []
        for page, host, text, texts_of in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
            if host not in known:
                if len(known) >= TEMPLATES:
                    known.clear()
                    repeated.clear()
                known[host] = judge(json.loads(text.as_py())) if text.is_valid else None
                repeated[host] = frozenset(texts_of.as_py() or ())
            texts.append(extract(page.as_py() or "", known[host], repeated[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                         names=["key", "url", "text"])


def first_look(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Partial templates and hashed text blocks of all pages, parsed once and stored."""
    rows = pages.select(host_of(column(url).cast("string")).alias("host"), column(html).cast("string").alias("html"))
    return store(rows.mapInArrow(_first, FIRST), "looked")


def templates(looked: DataFrame) -> DataFrame:
    """(host, template) with one row per host, from all of its pages."""
    kind = "host string, template string"
    parts = looked.filter("template is not null").select("host", "template").withColumn("salt", F.spark_partition_id() % SALT)
    parts = parts.repartition("host", "salt").sortWithinPartitions("host", "salt").select("host", "template")
    parts = store(parts.mapInArrow(_merged, kind), "parts")
    return parts.repartition("host").sortWithinPartitions("host").mapInArrow(_merged, kind)


def repeated_blocks(looked: DataFrame) -> DataFrame:
    """(host, repeated): texts, each with its path, on ``SUPPORT`` distinct pages and on half of those with that path."""
    found = looked.filter("template is null").select("host", "slot", "block", "page").dropDuplicates()
    found = store(found.groupBy("host", "slot", "block").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT), "blocks")
    slots = found.filter("block is null").select("host", "slot", F.col("n").alias("whole"))
    often = found.filter("block is not null").join(slots, ["host", "slot"]).filter("2 * n >= whole")
    return often.groupBy("host").agg(F.sort_array(F.collect_list("block")).alias("repeated"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) per row of ``pages``."""
    mark = stored()
    looked = first_look(pages, url, html)
    known = templates(looked).join(repeated_blocks(looked), "host", "left")
    known = finish(known, "templates", mark)
    size_of = F.octet_length("template") + F.coalesce(8 * F.size("repeated"), F.lit(0))
    hosts, size = known.agg(F.count("*"), F.coalesce(F.sum(size_of), F.lit(0))).first()
    if hosts <= BROADCAST_HOSTS and size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    rows = pages.select(column(key).alias("key"), column(url).cast("string").alias("url"),
                        column(html).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).join(known, "host", "left")
    rows = rows.select("key", "url", "html", "host", "template", "repeated")
    kind = f"key {rows.schema['key'].dataType.simpleString()}, url string, text string"
    return rows.mapInArrow(_extracted, kind).withColumnRenamed("key", key).withColumnRenamed("url", url)


def query(spark, folder: str) -> DataFrame:
    """The main text of every page."""
    out = main_text(spark.read.parquet(f"{folder}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
