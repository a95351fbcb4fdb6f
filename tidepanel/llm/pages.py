"""Main text of web pages: a tree-structured graphical model over the DOM.

Every DOM node (elements and text runs) has a hidden label, content or not. Node
potentials come from the node's features (tag, hints in class, id and role, text length,
punctuation, links); edge potentials tie a child's label to its parent's. Both are counted on
labelled pages, i.e. pages whose markup names the article, smoothed by stated priors. The
label comes from the naming tag alone (without menus, asides, forms, footers, buttons and
comment sections inside it); what class names tell is a feature whose worth is counted like
any other, so a name that clutters one corpus and holds text in another is learned as such.
A third of the pages show all names, a third hide the naming tag, and a third hide every
landmark and class name, so that the model also learns to do without them. Sum-product
messages up and down the tree give each text run's marginal probability of being content;
runs above one half are kept.

Training reads a bounded sample (``MAX_FIT_PAGES``, chosen by hash) and collects only counts
per feature value; the extraction is one scan, page by page, so a lost task is simply run
again.

Defined results: null or empty html gives the empty text; broken markup is repaired the
usual way (open paragraphs end at the next block, unknown end tags are ignored, unclosed
comments and scripts run to the end); repeated pages get equal rows; very long pages take
time in proportion to their nodes; without labelled pages the priors decide; an empty
table gives no rows; only the id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FIT_PAGES = 2000
PRIOR_COUNT = 20.0  # a stated prior weighs at least so many nodes,
PRIOR_SHARE = 0.05  # and this share of the counted ones: labelled pages show few kinds of clutter

# HTML element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea template iframe noembed noframes svg select".split())
BLOCK = set("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead
tr ul""".split())
SELF_CLOSING = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": set()}

# Stated priors: how likely a node with the feature is content.
PRIORS = {
    "tag:article": 0.97, "tag:main": 0.95, "tag:p": 0.8, "tag:pre": 0.85, "tag:blockquote": 0.85, "tag:h1": 0.6, "tag:h2": 0.7, "tag:h3": 0.7,
    "tag:nav": 0.02, "tag:footer": 0.02, "tag:aside": 0.02, "tag:header": 0.1, "tag:form": 0.02, "tag:button": 0.02, "tag:label": 0.05,
    "tag:menu": 0.02, "tag:dialog": 0.03, "tag:fieldset": 0.03, "tag:a": 0.3,
    "hint:ad": 0.01, "hint:comment": 0.01, "hint:nav": 0.02, "hint:foot": 0.02, "hint:head": 0.1, "hint:side": 0.02, "hint:notice": 0.02,
    "hint:form": 0.02, "hint:share": 0.02, "hint:content": 0.95,
    "text:tiny": 0.3, "text:short": 0.45, "text:medium": 0.6, "text:long": 0.85, "end:yes": 0.65, "end:no": 0.4, "link:yes": 0.2, "link:no": 0.55,
    "in:ad": 0.01, "in:comment": 0.01, "in:nav": 0.01, "in:foot": 0.01, "in:side": 0.01, "in:notice": 0.01, "in:form": 0.01, "in:share": 0.01,
    "in:content": 0.9, "in:none": 0.5,
}
TEXT_WEIGHT = 0.4  # the features of a text run tell much the same, so each counts less
CLUTTER_TAGS = {"nav": "nav", "menu": "nav", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "label": "form", "button": "form",
                "dialog": "notice"}
TAGS = set("""a article aside b blockquote body br button dd div dl dt em figure figcaption footer form h1 h2 h3 h4 h5 h6 header html
i label li main menu nav ol p pre section span strong table tbody td th thead tr u ul dialog fieldset head""".split())
NAMING = {"article", "main"}
LANDMARKS = NAMING | set(CLUTTER_TAGS) | {"header", "section"}
UNLABELLED = {"nav", "aside", "form", "footer", "button"}  # never content, also inside the named article
# Whole parts of class names; "side-bar_left" has the parts side, bar, left.
HINTS = [
    ("ad", r"ads?|advert\w*|sponsor\w*|promo\w*|banner"), ("comment", r"comments?|commentlist|disqus|replies|respond|discussion"),
    ("nav", r"nav\w*|menus?|breadcrumbs?|pagination|pager|toc"), ("foot", r"footer|copyright|contentinfo|colophon"),
    ("head", r"header|masthead|topbar|logo"), ("side", r"side|sidebar|sidenav|aside|widgets?|related|recommend\w*|complementary"),
    ("notice", r"notices?|cookies?|consent|gdpr|alert|popup|modal|newsletter|subscribe|signup"),
    ("form", r"forms?|search|login"), ("share", r"share|sharing|social"),
    ("content", r"article|content|main|post|story|entry|bodytext"),
]
HINT_RE = [(name, re.compile(p)) for name, p in HINTS]
# Parts that say nothing of what an element is, only that it is one.
CARRIER = set("""container wrapper wrap box list bar links link item items section block area inner outer unit top bottom left right site page global
primary secondary body content articles posts stories buttons button media icons icon panel group row col column region slot thread form text""".split())
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
MARKED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Page:
    """Nodes of a page in document order: parent, tag, class hints, text (for text runs), block number."""

    def __init__(self, source: str):
        self.parent, self.tag, self.marks, self.text, self.block = [-1], ["html"], [""], [""], [0]
        stack, block, at = [0], 0, 0
        closing = {}
        while m := TOKEN.match(source, at):
            at = m.end()
            end, name, attributes = m.group(1), m.group(2), m.group(3)
            if name:
                name = name.lower()
                if name in RAW and not attributes.endswith("/"):
                    close = closing.setdefault(name, re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)).search(source, at)
                    at = close.end() if close else len(source)
                    continue
                if name in BLOCK:
                    block += 1
                    self._leave(stack, {"p"}, {"table", "button"})
                if name in SELF_CLOSING:
                    self._leave(stack, SELF_CLOSING[name], SCOPE[name])
                marks = " ".join(" ".join(filter(None, x)) for x in MARKED.findall(attributes)) if "=" in attributes else ""
                self._add(stack[-1], name, marks, " " if name == "br" else "", block)
                if name not in VOID and not attributes.endswith("/"):
                    stack.append(len(self.tag) - 1)
            elif end:
                end = end.lower()
                if end in BLOCK:
                    block += 1
                self._leave(stack, {end}, set())
            elif source[m.start()] != "<" or m.end() == m.start() + 1:
                self._add(stack[-1], "#text", "", entities.unescape(m.group()), block)

    def _add(self, parent: int, tag: str, marks: str, text: str, block: int) -> None:
        self.parent.append(parent)
        self.tag.append(tag)
        self.marks.append(marks)
        self.text.append(text)
        self.block.append(block)

    def _leave(self, stack: list[int], tags: set[str], scope: set[str]) -> None:
        """Closes the innermost open element of ``tags``, unless ``scope`` bars the way."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in tags:
                del stack[k:]
                return
            if tag in scope:
                return


def hints(marks: str) -> set[str]:
    """What the class names say: the kind of the last part of each that is no carrier.

    "social-links" is about sharing, "social-quote" is a quote, of which nothing is known.
    """
    out = set()
    for name in marks.split():
        parts = [x.lower() for x in PART.findall(name)]
        own = list(parts)
        while len(own) > 1 and (own[-1] in CARRIER or own[-1].isdigit()):
            own.pop()
        found = [kind for kind, p in HINT_RE for x in own[-1:] if p.fullmatch(x)]
        if not found or found == ["content"]:
            found = ["content"] if any(HINT_RE[-1][1].fullmatch(x) for x in parts) and all(
                x in CARRIER or x.isdigit() or HINT_RE[-1][1].fullmatch(x) for x in parts) else []
        out.update(found)
    return out


def features(page: Page, hide: int = 0) -> list[list[str]]:
    """Feature values of every node.

    ``hide`` 1 shows a naming tag as a plain division, 2 every landmark, and no class names.
    """
    out: list[list[str]] = []
    hidden = (set(), NAMING, LANDMARKS)[hide]
    linked = [False] * len(page.tag)
    inside = ["none"] * len(page.tag)  # what the innermost telling ancestor (or self) suggests
    for i, tag in enumerate(page.tag):
        up = page.parent[i]
        linked[i] = tag == "a" or (up >= 0 and linked[up])
        told = sorted(hints(page.marks[i])) if page.marks[i] and hide < 2 else []
        telling = [x for x in told if x not in ("content", "head")]
        shown = "div" if tag in hidden else tag
        if shown in CLUTTER_TAGS or telling:
            inside[i] = CLUTTER_TAGS.get(shown) or telling[0]
        elif "content" in told or shown in NAMING:
            inside[i] = "content"
        elif up >= 0:
            inside[i] = inside[up]
        if tag == "#text" or tag == "br":
            words = page.text[i].strip()
            n = len(words)
            size = "none" if not n else "tiny" if n < 25 else "short" if n < 80 else "medium" if n < 200 else "long"
            out.append([f"text:{size}", f"end:{'yes' if words[-1:] in set('.!?:;»”') and n else 'no'}", f"link:{'yes' if linked[i] else 'no'}", f"in:{inside[i]}"])
            continue
        out.append([f"tag:{shown if shown in TAGS else 'other'}", f"in:{inside[i]}", *[f"hint:{x}" for x in told]])
    return out


def markup_labels(page: Page) -> list[int] | None:
    """Labels of a page whose markup names exactly one article (else none).

    Class names count only where they name a comment section.
    """
    named = [i for i, t in enumerate(page.tag) if t == "article"] or [i for i, t in enumerate(page.tag) if t == "main"]
    if len(named) != 1:
        return None
    label = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        if i == named[0]:
            label[i] = 1
        elif label[page.parent[i]]:
            label[i] = int(page.tag[i] not in UNLABELLED and not (page.marks[i] and "comment" in hints(page.marks[i])))
    return label


def _edge(page: Page, i: int, parent_label: int) -> str:
    """Name of the edge potential above a node: text runs and elements have their own."""
    return f"edge:{'text' if page.tag[i] == '#text' else 'element'}:{parent_label}"


EDGES = [f"edge:{kind}:{label}" for kind in ("text", "element") for label in (0, 1)]


def _count(batches: Iterator):
    import pandas as pd

    for frame in batches:
        seen: Counter = Counter()
        for source, hide in zip(frame["html"], frame["hide"], strict=True):
            page = Page(source or "")
            label = markup_labels(page)
            if label is None:
                continue
            for i, values in enumerate(features(page, int(hide))):
                for f in values:
                    seen[f, label[i]] += 1
                if i:
                    seen[_edge(page, i, label[page.parent[i]]), label[i]] += 1
        yield pd.DataFrame([(f, y, n) for (f, y), n in seen.items()], columns=["feature", "label", "n"])


def train(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_FIT_PAGES,
          id_col: str = "page_id") -> dict[str, tuple[float, float]]:
    """Potentials (not content, content) of every feature value and parent label."""
    # the hash draws each copy of a page by itself, whatever its file or batch; other bits hide its names
    key = F.xxhash64(F.col(id_col), F.col(html_col).cast("string"))
    d = pages.select(F.col(html_col).cast("string").alias("html"), key.alias("key")).where(F.col("html").isNotNull())
    total = d.count()
    share = min(1.0, max_pages / max(1, total))
    drawn = d.where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20))
    drawn = drawn.select("html", F.pmod(F.shiftright("key", 20), F.lit(3)).cast("int").alias("hide"))
    rows = drawn.mapInPandas(_count, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()
    seen = {(r["feature"], r["label"]): float(r["n"]) for r in rows}  # at most two rows per feature value
    return potentials(seen)


def potentials(seen: dict[tuple[str, int], float]) -> dict[str, tuple[float, float]]:
    """Counts by (feature value, label), smoothed by the stated priors."""
    names = set(PRIORS) | {f for f, _ in seen} | set(EDGES)
    mass = [sum(n for (f, y), n in seen.items() if y == label and f.startswith("tag:")) for label in (0, 1)]
    weight = [max(PRIOR_COUNT, PRIOR_SHARE * m) for m in mass]
    out = {}
    for f in names:
        if f.startswith("edge:"):
            stay = 0.98 if f.startswith("edge:text") else 0.9
            label = int(f[-1])
            n = [seen.get((f, y), 0.0) + weight[label] * (stay if y == label else 1 - stay) for y in (0, 1)]
            out[f] = (n[0] / sum(n), n[1] / sum(n))
        else:
            p = PRIORS.get(f, 0.5)
            out[f] = tuple((seen.get((f, y), 0.0) + weight[y] * (p if y else 1 - p)) / (mass[y] + weight[y]) for y in (0, 1))
    return out


def marginals(page: Page, model: dict[str, tuple[float, float]], hide: int = 0) -> list[float]:
    """P(content) of every node by sum-product messages up and down the tree."""
    n = len(page.tag)
    kinds = {kind: (model[f"edge:{kind}:0"], model[f"edge:{kind}:1"]) for kind in ("text", "element")}
    edges = [kinds["text" if t == "#text" else "element"] for t in page.tag]
    local = []
    for values in features(page, hide):
        odds = 0.0
        for f in values:
            if f in model:
                odds += math.log(model[f][1] / model[f][0]) * (TEXT_WEIGHT if f[:4] in ("text", "end:", "link") else 1.0)
        odds = max(-30.0, min(30.0, odds))
        local.append((1 / (1 + math.exp(odds)), 1 / (1 + math.exp(-odds))))
    belief = [list(x) for x in local]  # local potential times the messages of the children
    message: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        b0, b1 = belief[i]
        edge = edges[i]
        m0, m1 = edge[0][0] * b0 + edge[0][1] * b1, edge[1][0] * b0 + edge[1][1] * b1
        s = m0 + m1
        message[i] = (m0 / s, m1 / s)
        up = belief[page.parent[i]]
        up[0] *= m0 / s
        up[1] *= m1 / s
        s = up[0] + up[1]
        up[0] /= s
        up[1] /= s
    out = [0.0] * n
    down = [(1.0, 0.0)] * n  # the root is not content
    for i in range(n):
        if i:
            up, edge = page.parent[i], edges[i]
            # the parent without this child's own message
            c0, c1 = down[up][0] * belief[up][0] / max(message[i][0], 1e-300), down[up][1] * belief[up][1] / max(message[i][1], 1e-300)
            d0, d1 = c0 * edge[0][0] + c1 * edge[1][0], c0 * edge[0][1] + c1 * edge[1][1]
            s = (d0 + d1) or 1.0
            down[i] = (d0 / s, d1 / s)
        p0, p1 = down[i][0] * belief[i][0], down[i][1] * belief[i][1]
        out[i] = p1 / ((p0 + p1) or 1.0)
    return out


def main_text(source: str, model: dict[str, tuple[float, float]]) -> str:
    """Kept text runs of a page, one line per block."""
    page = Page(source)
    keep = marginals(page, model)
    blocks: dict[int, list[str]] = {}
    for i, text in enumerate(page.text):
        if text and (keep[i] > 0.5 or page.tag[i] == "br" and page.block[i] in blocks):
            blocks.setdefault(page.block[i], []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, html_col, id_col=id_col))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py() or "", shared.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")
