"""Main text of web pages by wrapper induction.

1. For every host a bounded number of pages is chosen by the hash of their id
   (one aggregation, combined map-side; a host with a third of all pages costs a
   few numbers per task).
2. Their DOM trees, with runs of like siblings folded, are aligned by simple tree
   matching.  Aligned nodes whose text is the same on every page are template;
   those whose text varies are slots.  The wrapper is the deepest node that
   holds all varying text outside of page furniture (or the article element that
   holds nearly all), and the template's constant texts.
3. Every page is parsed once, in a narrow pass, and read through its host's
   wrapper; a page that the wrapper doesn't fit, or that is alone on its host, is
   read from its article or body."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import in_parts, small_batches, table

# Fixed values of HTML: elements without content, elements that begin a block,
# and the open elements that such a beginning or a like sibling closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option "
            "p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "title", "option", "optgroup", "legend", "summary"}
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "p": {"p"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
        "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "td", "th", "div", "article", "section", "body", "html"}
# Elements and names of page furniture: menus, headers, footers, sidebars, notices, adverts, forms, comments.
FURNITURE = set("head title script style noscript template nav header footer aside form button select textarea "
                "input iframe object svg canvas dialog menu search".split())
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|"
    r"notices?|alert|popup|modal|overlay|newsletter|subscribe|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|"
    r"aside|footer|header|masthead|comments?|replies|disqus|respond|share|sharing|social|related|recommended|"
    r"widget|toolbar|pagination|pager|skip)(?:$|[\s_-])", re.I)
FURNITURE_ROLE = set("navigation banner contentinfo complementary search form alert dialog menu".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    __slots__ = ("tag", "label", "furniture", "children", "parent", "inside")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.label, self.parent, self.children = tag, tag, parent, []
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        if not attrs:
            self.furniture = tag in FURNITURE and not (tag == "header" and self.inside)
            return
        d = dict(attrs)
        names = f"{d.get('class') or ''} {d.get('id') or ''}".strip()
        self.label = f"{tag}.{names}" if names else tag
        self.furniture = (tag in FURNITURE and not (tag == "header" and self.inside)
                          or bool(names and FURNITURE_NAME.search(names) and tag not in ("body", "html", "main"))
                          or (d.get("role") or "").lower() in FURNITURE_ROLE
                          or "hidden" in d or (d.get("aria-hidden") or "").lower() == "true")


def ancestors(node):
    while node is not None:
        yield node
        node = node.parent


class _Builder(HTMLParser):
    """A forgiving tree: unclosed paragraphs, items and cells end where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(p.tag == tag for p in ancestors(self.at)):
            return
        close = LIKE.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if close:
            found = None
            for p in ancestors(self.at):
                if p.tag in close:
                    found = p
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif p.tag in SCOPE and not (tag in ("tr", "tbody", "tfoot") and p.tag in ("td", "th")):
                    break
            if found is not None:
                self.at = found.parent
        if tag == "body":
            for p in ancestors(self.at):
                if p.tag == "head":
                    self.at = p.parent
                    break
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "b", "i", "a"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for p in ancestors(self.at):
            if p.tag == tag:
                self.at = p.parent or self.root
                return
            if tag not in BLOCK and p.tag in BLOCK:      # an inline end doesn't leave its block
                return

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def content_blocks(node: Node, constant: set, path: str = "") -> list[str]:
    """Texts of the blocks below ``node`` outside of furniture and template
    constants, white space folded.  Iterative: pages may nest deeply."""
    out, buf = [], []

    def flush():
        text = " ".join("".join(buf).split())
        buf.clear()
        if text:
            out.append(text)

    stack = [(node, path, False)]
    while stack:
        item, where, leaving = stack.pop()
        if isinstance(item, str):
            if not constant or (where, " ".join(item.split())) not in constant:
                buf.append(item)
            continue
        if leaving:
            flush()
            continue
        if item.furniture and item is not node:
            continue
        if item.tag == "br":
            buf.append(" ")
            continue
        block = item.tag in BLOCK
        if block:
            flush()
            stack.append((item, where, True))
        stack.extend((c, where if isinstance(c, str) else f"{where}/{c.label}", False)
                     for c in reversed(item.children))
    flush()
    return out


# --- induction ---------------------------------------------------------------------------------

class Shape:
    """A folded node: like siblings in a row are one, with all their texts."""
    __slots__ = ("label", "path", "furniture", "children", "texts")

    def __init__(self, label, path, furniture):
        self.label, self.path, self.furniture = label, path, furniture
        self.children, self.texts = [], []


def _texts_below(node: Node):
    """All texts outside of furniture, however deep."""
    stack = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item.strip():
                yield " ".join(item.split())
        elif not item.furniture:
            stack.extend(reversed(item.children))


def fold(node: Node, depth: int = 60) -> Shape:
    shape = Shape(node.label, "", node.furniture)

    def add(shape, node, depth):
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    shape.texts.append(" ".join(c.split()))
                continue
            last = shape.children[-1] if shape.children else None
            if last is None or last.label != c.label:
                last = Shape(c.label, f"{shape.path}/{c.label}", c.furniture)
                shape.children.append(last)
            if depth:
                add(last, c, depth - 1)
            else:
                last.texts.extend(_texts_below(c))

    add(shape, node, depth)
    return shape


def tree_match(a: Shape, b: Shape) -> tuple[int, list]:
    """Simple tree matching: the most nodes that pair up with their order and
    ancestry kept, and those pairs."""
    if a.label != b.label:
        return 0, []
    n, m = len(a.children), len(b.children)
    inner = [[tree_match(x, y) for y in b.children] for x in a.children]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + inner[i - 1][j - 1][0])
    pairs, i, j = [(a, b)], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += inner[i - 1][j - 1][1]
            i, j = i - 1, j - 1
    return best[n][m] + 1, pairs


def induce(pages: list[str]) -> dict:
    """The wrapper of pages of one host: the path of the content and the constant
    texts (path, text).  Pages alike in all their text say nothing, so one of them is used."""
    shapes, seen = [], set()
    for h in pages:
        s = fold(parse(h))
        key = tuple(_all_texts(s))
        if key not in seen:
            seen.add(key)
            shapes.append(s)
    if len(shapes) < 2:
        return {"path": None, "constant": []}
    first, aligned, loose = shapes[0], {}, {}
    for other in shapes[1:]:
        pairs = tree_match(first, other)[1]
        paired = {id(y) for _, y in pairs}
        for x, y in pairs:
            aligned.setdefault(id(x), []).append(y)
            loose[id(x)] = loose.get(id(x), 0) + sum(_content_size(c) for c in y.children if id(c) not in paired)

    constant, weight, full = [], {}, {}     # full: with what other pages have and the first hasn't

    def visit(x):
        """Varying text below x, outside of furniture."""
        mates = aligned.get(id(x), [])
        always = len(mates) == len(shapes) - 1 and len(shapes) > 2
        varying = 0
        for t in x.texts:
            if always and all(t in y.texts for y in mates):
                constant.append((x.path, t))
            else:
                varying += len(t)
        varying += sum(len(t) for y in mates for t in y.texts)
        more = varying + loose.get(id(x), 0)
        for c in x.children:
            varying += visit(c)
            more += full[id(c)]
        weight[id(x)], full[id(x)] = (0, 0) if x.furniture else (varying, more)
        return weight[id(x)]

    def descend(of, share):
        """The lowest node with that share of the varying text; no lower than an article."""
        at = first
        while True:
            top = max(at.children, key=lambda c: of[id(c)], default=None)
            tag = top.label.split(".")[0] if top else ""
            if (top is None or of[id(top)] < share * of[id(first)] or tag in HEADINGS or tag not in BLOCK
                    or tag in ("p", "li")):
                return at
            at = top
            if tag in ("article", "main"):
                return at

    visit(first)
    core = descend(weight, 0.9)
    at = core if core.label.split(".")[0] in ("article", "main") else descend(full, 1)
    # inside the core a repeated passage is text, not template; beside it only what varies is content
    constant = [c for c in constant if not (core.path and (c[0] + "/").startswith(core.path + "/"))]
    return {"path": at.path or None, "constant": constant}


def _content_size(s: Shape) -> int:
    return 0 if s.furniture else sum(map(len, s.texts)) + sum(map(_content_size, s.children))


def _all_texts(s: Shape):
    yield from s.texts
    for c in s.children:
        yield from _all_texts(c)


# --- extraction --------------------------------------------------------------------------------

def _find(root: Node, path: str) -> list[tuple[Node, str]]:
    level = [(root, "")]
    for label in path.split("/")[1:]:
        level = [(c, f"{p}/{label}") for n, p in level for c in n.children
                 if isinstance(c, Node) and c.label == label and not c.furniture]
    return level


def _article(root: Node) -> list[tuple[Node, str]]:
    """Outermost article or main elements outside of furniture; else the whole page."""
    found, stack = [], [(root, "")]
    while stack:
        node, path = stack.pop()
        if node.tag in ("article", "main"):
            found.append((node, path))
            continue
        stack.extend((c, f"{path}/{c.label}") for c in reversed(node.children)
                     if isinstance(c, Node) and not c.furniture)
    return found or [(root, "")]


def extract(html: str, wrapper: dict | None) -> str:
    """Blocks of the article in page order, two line breaks between them."""
    if not html:
        return ""
    root = parse(html)
    where = _find(root, wrapper["path"]) if wrapper and wrapper["path"] else []
    constant = {tuple(c) for c in wrapper["constant"]} if wrapper else set()
    blocks = [t for node, path in where or _article(root) for t in content_blocks(node, constant, path)]
    return "\n\n".join(blocks)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def induce_wrappers(pages: DataFrame, page_id: str, url: str, html: str, sample: int) -> DataFrame:
    """(host, wrapper as JSON), from at most ``sample`` pages of each host."""
    slim = pages.select(host_of(url).alias("host"), F.col(page_id).alias("pid")).where("pid is not null")
    chosen = slim.groupBy("host").agg(*[F.min_by("pid", F.xxhash64("pid", F.lit(i))).alias(f"p{i}")
                                        for i in range(sample)])
    ids = chosen.select(F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(sample)]))).alias("pid")).distinct()
    picked = (pages.select(F.col(page_id).alias("pid"), host_of(url).alias("host"),
                           F.coalesce(F.col(html), F.lit("")).alias("html"))
              .join(ids, "pid").dropDuplicates(["pid"]))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")
        return pd.DataFrame({"host": [group.host.iloc[0]], "wrapper": [json.dumps(induce(list(group.html)))]})

    return picked.groupBy("host").applyInPandas(fit, "host string, wrapper string")


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *,
                      sample: int = 6) -> DataFrame:
    """One row per input row: the page id, the url, text and n_chars (code points).

    A null or empty html has an empty text; pages without a url share one wrapper;
    rows without a page id are never chosen for the induction; repeated rows keep
    their rows; an empty table gives an empty result.  Other columns are not read."""
    small_batches(pages)
    scratch = Scratch(pages.sparkSession)
    wrappers = scratch.cut(induce_wrappers(pages, page_id, url, html, sample), "wrappers")
    idt = pages.schema[page_id].dataType.simpleString()
    rows = (pages.select(F.col(page_id).alias("pid"), F.col(url).alias("url"), F.col(html).alias("html"),
                         host_of(url).alias("host"))
            .join(wrappers, "host", "left").select("pid", "url", "html", "wrapper"))

    def run(batches):
        known: dict = {}
        for b in in_parts(batches, 64):
            texts = []
            for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if w not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[w] = json.loads(w) if w else None
                texts.append(extract(h or "", known[w]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[page_id, "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"`{page_id}` {idt}, url string, text string, n_chars bigint")


def op7_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
