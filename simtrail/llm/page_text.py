"""Operator 7: main text of web pages by a tree-structured graphical model.

Every block element of a page is a binary variable (content or not).  Its
node potential is a naive Bayes table over its tag, the words of its class and
id, link share and text length; each parent-child pair has a potential table by
the child's tag.  Sum-product messages go upward from the leaves and downward
from the root; a block of text is kept if the marginal of its element is at
least one half.

The tables are counted from labelled pages: pages that mark their article
(``article``, ``main`` or ``role=main``) label their own elements (inside it,
and not inside a menu, form, advert, notice or comment part).  At most
``train_pages`` pages are read for that (those with the least hash of the
html, a documented parameter), and the ``MOST_NAMES`` most frequent class and id
words of them (also a parameter) get a table; prior counts stand in for what
they lack.  So a page that marks no article is read by the names that labelled
pages use for the same parts; without any labelled page the priors decide, and a
page without a single known name or tag gives no text.

Output rules: character references decoded, white space (of any script) inside a
block becomes one space, blocks are trimmed and joined in page order by one ``\\n``.

Defined results: null and empty html give an empty text; an open ``head`` ends
where the body begins, marked or not; other unclosed elements end with the page; repeated pages are each returned.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simtrail.llm.shared import share, shared
from simtrail.session import materialize

TRAIN_PAGES = 4_000
MOST_NAMES = 20_000
# Uses of a class or id word below which it has no table.
LEAST_USES = 5
# Elements whose text is no text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object head title select button textarea canvas audio video".split())
# Those that stand inside a line of text without ending its block.
IN_LINE = SKIPPED - {"head", "title"}
# What a head may hold; any other element ends it.
HEAD = frozenset("head title meta link base style script noscript template".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br".split()
)
# A start tag on the left ends an open element on the right (within the nearest scope).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
# Names of parts that are not the article, as found in tags, classes and ids.
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer header masthead topbar notice notices cookie cookies consent alert popup modal overlay newsletter "
    "subscribe signup login form search share sharing social related recommended widget comment comments reply replies "
    "disqus respond copyright legal".split()
)
MAIN_WORDS = frozenset("article main content post entry story body text page".split())
OTHER_TAGS = frozenset("nav aside footer form".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")


class Page:
    """Block elements in page order and the blocks of text below them."""

    __slots__ = ("parent", "tag", "words", "marked", "own", "links", "blocks")

    def __init__(self):
        self.parent, self.tag, self.words, self.marked = [-1], ["#"], [frozenset()], [False]
        self.own, self.links = [0], [0]
        self.blocks: list[tuple[int, str]] = []


def parse(source: str) -> Page:
    """A forgiving single pass over the tags of a page."""
    page = Page()
    stack = [("#", 0)]  # open elements: (tag, its node; inline elements carry their block's)
    node, skip, in_link = 0, 0, 0
    text: list[str] = []

    def flush():
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if joined:
                page.blocks.append((node, joined))
                page.own[node] += len(joined)

    def add_text(piece: str):
        if piece and not skip:
            text.append(piece)
            if in_link:
                page.links[node] += len(piece)

    def close_to(depth: int):
        nonlocal node, skip, in_link
        while len(stack) > depth:
            tag, _ = stack.pop()
            if tag in SKIPPED:
                skip -= 1
            elif tag == "a":
                in_link -= 1
            if tag not in INLINE and tag not in IN_LINE:
                flush()
            node = stack[-1][1] if stack else 0

    at, size = 0, len(source)
    while at < size:
        cut = source.find("<", at)
        if cut < 0:
            add_text(source[at:])
            break
        add_text(source[at:cut])
        m = _TAG.match(source, cut)
        if m is None:
            add_text("<")
            at = cut + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close_to(depth)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if len(stack) > 1 and tag not in HEAD and any(name == "head" for name, _ in stack):
            close_to(next(i for i, (name, _) in enumerate(stack) if name == "head"))
        if tag == "br":
            add_text(" ")
            continue
        if tag in INLINE:
            if tag not in VOID:
                stack.append((tag, node))
                in_link += tag == "a"
            continue
        if tag not in IN_LINE:
            flush()
        if tag in VOID:
            continue
        # A block start tag ends an open paragraph; items end their siblings.
        ends, scope = CLOSES.get(tag, (None, None))
        for depth in range(len(stack) - 1, 0, -1) if tag not in IN_LINE else ():
            name = stack[depth][0]
            if name == "p" or ends and name in ends:
                close_to(depth)
                if name != "p":
                    break
            elif name not in INLINE and (scope is None or name in scope):
                break
        attrs = m[3]
        words, marked = frozenset(), False
        if attrs and "=" in attrs:
            found = _ATTR.findall(attrs)
            words = frozenset(w for _, v in found for w in _WORD.findall(v.lower()))
            marked = any(k.lower() == "role" and v.strip("\"'").lower() == "main" for k, v in found)
        page.parent.append(stack[-1][1])
        page.tag.append(tag)
        page.words.append(words)
        page.marked.append(marked)
        page.own.append(0)
        page.links.append(0)
        node = len(page.tag) - 1
        if attrs.endswith("/"):
            node = stack[-1][1]
            continue
        stack.append((tag, node))
        skip += tag in SKIPPED
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if end is None:
                close_to(len(stack) - 1)
                at = size
            else:
                at = end.end()
                close_to(len(stack) - 1)
    close_to(1)
    flush()
    return page


def node_features(page: Page) -> list[list[str]]:
    """Feature names of each element."""
    n = len(page.tag)
    total, linked = page.own[:], page.links[:]
    for i in range(n - 1, 0, -1):  # children follow their parents
        total[page.parent[i]] += total[i]
        linked[page.parent[i]] += linked[i]
    out = []
    for i in range(n):
        words = page.words[i]
        share = linked[i] / total[i] if total[i] else 0.0
        names = [
            f"t:{page.tag[i]}",
            f"l:{min(int(share * 4), 3)}" if total[i] else "l:-",
            f"n:{min(total[i].bit_length(), 14)}",
        ]
        if words & OTHER_WORDS:
            names.append("w:other")
        elif words & MAIN_WORDS:
            names.append("w:main")
        if page.marked[i]:
            names.append("r:main")
        names += [f"c:{w}" for w in sorted(words)]
        out.append(names)
    return out


def own_labels(page: Page) -> list[int] | None:
    """Labels that a page with a marked article gives to its elements; None without one."""
    n = len(page.tag)
    inside, other = [0] * n, [0] * n
    found = False
    for i in range(n):
        p = page.parent[i]
        up_in, up_other = (inside[p], other[p]) if p >= 0 else (0, 0)
        tag, words = page.tag[i], page.words[i]
        main = (tag in ("article", "main") or page.marked[i]) and not words & OTHER_WORDS
        found |= main
        inside[i] = 1 if main else up_in
        away = tag in OTHER_TAGS or bool(words & OTHER_WORDS) or tag == "header" and not up_in
        other[i] = 1 if away else up_other
    return [int(a and not b) for a, b in zip(inside, other, strict=True)] if found else None


# Prior counts (feature, label 0, label 1): general knowledge that training pages may lack.
PRIOR = {
    **{f"t:{t}": (2000, 0.2) for t in ("nav", "aside", "footer", "form")},
    **{f"t:{t}": (8, 0.2) for t in ("#", "html", "body", "header")},
    **{f"t:{t}": (0.2, 8) for t in ("article", "main")},
    **{f"t:{t}": (1, 3) for t in ("p", "h1", "h2", "h3", "pre", "blockquote")},
    "r:main": (0.2, 8),
    "w:other": (2000, 0.2),
    "w:main": (2, 4),
    "l:3": (6, 1),
    "l:0": (1, 3),
}
# The features of an element depend on each other (a paragraph is long and has
# few links), so weaker kinds speak with a bounded voice.
LARGEST = {"t": 3.0, "l": 1.5, "n": 1.0, "w": 12.0, "c": 4.0, "r": 3.0}
# Containers may differ from their parent; any other element rarely does.
CONTAINERS = frozenset("# html body div section article main header nav aside footer form ul ol table center td".split())
STAY_CONTAINER, STAY_LEAF = 20.0, 1500.0


def page_counts(page: Page) -> Counter:
    """Counts of (kind, name, parent label, label) of a labelled page; empty without labels."""
    labels = own_labels(page)
    out: Counter = Counter()
    if labels is None:
        return out
    for i, names in enumerate(node_features(page)):
        for name in names:
            out["f", name, -1, labels[i]] += 1
        out["y", "", -1, labels[i]] += 1
        if i:
            out["e", page.tag[i], labels[page.parent[i]], labels[i]] += 1
    return out


class PageModel:
    """Log potentials of the tags and the class and id words of the training pages; bounded by ``train``'s parameters."""

    def __init__(self, counts: dict):
        y = [1.0 + counts.get(("y", "", -1, v), 0) for v in (0, 1)]
        names = {k[1] for k in counts if k[0] == "f"} | set(PRIOR)
        self.node = {}
        for name in names:
            prior = PRIOR.get(name, (0.5, 0.5))
            given = [counts.get(("f", name, -1, v), 0) + prior[v] for v in (0, 1)]
            odds = math.log(given[1] / (y[1] + 20)) - math.log(given[0] / (y[0] + 20))
            most = LARGEST["w"] if PRIOR.get(name, (0, 0))[0] >= 1000 else LARGEST[name[0]]
            self.node[name] = min(max(odds, -most), most)
        self.edge = {}
        for tag in {k[1] for k in counts if k[0] == "e"} | CONTAINERS | {"*"}:
            table = []
            for parent in (0, 1):
                # Elements take their parent's label unless counts say otherwise.
                weight = STAY_CONTAINER if tag in CONTAINERS else STAY_LEAF
                stay = [weight if v == parent else 1.0 for v in (0, 1)]
                given = [counts.get(("e", tag, parent, v), 0) + stay[v] for v in (0, 1)]
                table.append(tuple(math.log(g / sum(given)) for g in given))
            self.edge[tag] = tuple(table)

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each element by upward and downward messages."""
        n = len(page.tag)
        odds = [sum(self.node.get(name, 0.0) for name in names) for names in node_features(page)]
        up0, up1 = [0.0] * n, odds
        to0, to1 = [0.0] * n, [0.0] * n
        edges = [self.edge.get(t) or self.edge["*"] for t in page.tag]
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = edges[i]
            a0, a1 = up0[i], up1[i]
            x, y = e00 + a0, e01 + a1
            to0[i] = (x if x > y else y) + log(1 + exp(-abs(x - y)))
            x, y = e10 + a0, e11 + a1
            to1[i] = (x if x > y else y) + log(1 + exp(-abs(x - y)))
            p = page.parent[i]
            up0[p] += to0[i]
            up1[p] += to1[i]
        down0, down1 = [0.0] * n, [0.0] * n
        for i in range(1, n):
            (e00, e01), (e10, e11) = edges[i]
            p = page.parent[i]
            # The parent's belief without this element's own message.
            b0, b1 = up0[p] + down0[p] - to0[i], up1[p] + down1[p] - to1[i]
            x, y = b0 + e00, b1 + e10
            d0 = (x if x > y else y) + log(1 + exp(-abs(x - y)))
            x, y = b0 + e01, b1 + e11
            d1 = (x if x > y else y) + log(1 + exp(-abs(x - y)))
            down0[i], down1[i] = 0.0, d1 - d0
        return [1 / (1 + exp(min(max(u0 + d0 - u1 - d1, -500), 500))) for u0, u1, d0, d1 in zip(up0, up1, down0, down1, strict=True)]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        keep = self.marginals(page)
        return "\n".join(t for node, t in page.blocks if keep[node] >= 0.5)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for source in batch.column("html").to_pylist():
            if source:
                total.update(page_counts(parse(source)))
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.string()),
            pa.array([k[2] for k in keys], pa.int32()),
            pa.array([k[3] for k in keys], pa.int32()),
            pa.array([total[k] for k in keys], pa.int64()),
        ],
        ["kind", "name", "parent", "label", "n"],
    )


def train(pages: DataFrame, *, train_pages: int = TRAIN_PAGES, most_names: int = MOST_NAMES) -> PageModel:
    """Count the potentials on at most ``train_pages`` pages, for at most ``most_names`` class and id words."""
    order = pages.where("html is not null").select(F.xxhash64("html").alias("h"))
    cut = order.orderBy("h").limit(train_pages).agg(F.max("h").alias("cut")).scalar()
    sample = pages.where("html is not null").where(F.xxhash64("html") <= cut).select("html")
    counts = materialize(
        sample.mapInArrow(_count, "kind string, name string, parent int, label int, n long")
        .groupBy("kind", "name", "parent", "label")
        .agg(F.sum("n").alias("n")),
        "page-counts",
    )
    named = F.col("name").startswith("c:")
    words = counts.where(named).groupBy("name").agg(F.sum("n").alias("uses")).where(F.col("uses") >= LEAST_USES)
    words = words.orderBy(F.desc("uses"), "name").limit(most_names).select("name")
    kept = counts.where(~named).unionByName(counts.where(named).join(words, "name", "left_semi"))
    return PageModel({(r["kind"], r["name"], r["parent"], r["label"]): r["n"] for r in kept.collect()})


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared(model)
        for batch in batches:
            names = [c for c in batch.schema.names if c != "__html"]
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = [fitted.text(h) for h in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"]
                )

    return run


def with_main_text(pages: DataFrame, model: PageModel) -> DataFrame:
    """``pages`` with ``text`` instead of ``html`` (an existing column ``text`` is replaced)."""
    fitted = share(pages.sparkSession, model)
    rest = pages.drop("text", "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    source = pages.drop("text").withColumnRenamed("html", "__html")
    return source.mapInArrow(_extract(fitted), f"{schema}, text string")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return with_main_text(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
