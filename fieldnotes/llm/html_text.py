"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of elements. Each element is content or not: its tag, the kind of its class, id and role
names, and the length, links and punctuation of the text below it give its own potentials, and a potential for each
parent and child ties neighbours together. Sum-product messages upward and downward give every element's marginal.
Potentials are the shares counted over labelled pages; tasks count, Spark sums. The text of elements that are more
likely content than not is joined in page order.

Null and empty pages have an empty text. Broken markup is closed where its parents end. Repeated rows are extracted
each for itself; columns that clash with the results are replaced, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe object canvas head title textarea select option button audio video map".split())
#: What may stand in a head; the start of anything else, or text, ends a head that is still open.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What the start of an element ends, up to the nearest of the boundaries.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TAGS = {t: g for g, names in enumerate(["article main", "section", "div body html center", "p pre", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "a", " ".join(sorted(INLINE - {"a"})), "table tbody thead tr", "td th", "form fieldset input", "nav", "aside", "header", "footer", "blockquote figure figcaption"]) for t in names.split()}
#: Kinds of class, id and role names, the first that fits.
KINDS = [re.compile(rf"(?:^|[\s_-])(?:{x})(?:$|[\s_\d-])", re.I) for x in (
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|adsense|dfp|commercial|native-ad",
    r"comments?|comment-?list|disqus|replies|reply|respond|discussion|reviews?|reader-?comments?",
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|toast|disclaimer|warning",
    r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|tabs?|toc|skip\w*|topbar",
    r"side-?bar\w*|aside|widgets?|complementary|rail|right-?col\w*|left-?col\w*|tags?|tag-?cloud|categories|archive\w*",
    r"related\w*|recommend\w*|more|popular|trending|share|sharing|social|follow\w*|author-?bio|bio",
    r"footer\w*|foot|contentinfo|copyright|colophon|legal|bottom",
    r"header|head|masthead|site-?title|logo|branding|top",
    r"form|search\w*|login|register|contact|input|field",
    r"article\w*|post\w*|entry\w*|story\w*|content\w*|main\w*|body-?text|text|article-?body|articlebody|page-?content|prose|markdown",
)]


class Node:
    __slots__ = ("tag", "parent", "parts", "names", "label")

    def __init__(self, tag: str, parent: int, names: str, label: str):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.parts: list = []  # texts, and places of children


def parse(html: str | None) -> list[Node]:
    """Elements in page order; the first one is the page itself."""
    nodes = [Node("html", -1, "", "")]
    stack, at, size = [0], 0, len(html or "")
    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        shut, tag, names = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if html[m.start()] != "<" or at == m.start() + 1:
                if not m[0].isspace():
                    _end_head(nodes, stack)
                nodes[stack[-1]].parts.append(m[0])
            continue
        tag = tag.lower()
        if not shut and tag not in IN_HEAD and tag != "html":
            _end_head(nodes, stack)
        if shut:
            if tag == "br":
                nodes[stack[-1]].parts.append("\n")
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P:
            _close(nodes, stack, {"p"}, {"td", "th", "div", "section", "article", "li", "blockquote", "table", "main", "aside", "form"})
        if tag in CLOSES:
            _close(nodes, stack, *CLOSES[tag])
        if tag in VOID:
            nodes[stack[-1]].parts.append(" ")
            continue
        given = {a[0].lower(): a[1] or a[2] or a[3] for a in NAMED.findall(names)} if names else {}
        label = given.pop("data-label", "")
        if tag in ("html", "body"):
            nodes[0].names, nodes[0].label = f"{nodes[0].names} {' '.join(given.values())}".strip(), label or nodes[0].label
            continue
        nodes[stack[-1]].parts.append(len(nodes))
        nodes.append(Node(tag, stack[-1], " ".join(given.values()), label))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
        elif not names.rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append(len(nodes) - 1)
    return nodes


def _end_head(nodes: list[Node], stack: list[int]) -> None:
    """Ends an open head, unless an element in it is still open."""
    if nodes[stack[-1]].tag == "head":
        stack.pop()


def _close(nodes: list[Node], stack: list[int], tags: set, bounds: set) -> None:
    for k in range(len(stack) - 1, 0, -1):
        tag = nodes[stack[k]].tag
        if tag in tags:
            del stack[k:]
            return
        if tag in bounds:
            return


def _bin(value: float, bounds: tuple) -> int:
    return sum(value >= b for b in bounds)


#: Values that each feature can take: tag, kind, length, links, punctuation, place in a paragraph.
SIZES = (len(set(TAGS.values())) + 1, len(KINDS) + 1, 5, 4, 3)


def observed(nodes: list[Node]) -> np.ndarray:
    """The features of each element."""
    chars, links, marks = ([0] * len(nodes) for _ in range(3))
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.tag in HIDDEN:
            continue
        for p in n.parts:
            if isinstance(p, int):
                chars[i] += chars[p]
                links[i] += links[p]
                marks[i] += marks[p]
            else:
                size = len(p.strip())
                chars[i] += size
                marks[i] += p.count(".") + p.count(",") if size else 0
        if n.tag == "a":
            links[i] = chars[i]
    return np.array([
        (
            TAGS.get(n.tag, SIZES[0] - 1),
            next((k for k, kind in enumerate(KINDS) if kind.search(n.names)), len(KINDS)) if n.names else len(KINDS),
            _bin(chars[i], (1, 30, 100, 400)),
            _bin(links[i] / max(1, chars[i]), (0.05, 0.3, 0.7)),
            _bin(marks[i] / max(1, chars[i]), (0.004, 0.012)),
        )
        for i, n in enumerate(nodes)
    ])


class Model:
    """Logarithms of what features say, own[f][tag, value, state], and shares of pairs by the child's tag,
    pair[tag, parent state, child state]. Names say the same whatever the tag; the tag itself speaks through pairs."""

    def __init__(self, own: list[np.ndarray], pair: np.ndarray, first: np.ndarray):
        # tags with few examples fall back to what all tags say
        every = [c.sum(0) + 0.5 for c in own]
        smooth = [c + 4 * e / e.sum(0) for c, e in zip(own, every)]
        smooth[1] = np.broadcast_to(own[1].sum(0) + 0.5, own[1].shape)
        self.own = [np.log(c / c.sum(1, keepdims=True)) for c in smooth]
        pair = pair + 0.3
        self.pair = pair / pair.sum(2, keepdims=True)
        self.first = (first + 0.5) / (first + 0.5).sum()

    def marginals(self, nodes: list[Node], seen: np.ndarray | None = None) -> list[float]:
        """The chance of each element to be content, by messages up to the page and down again."""
        seen = observed(nodes) if seen is None else seen
        logs = sum(own[seen[:, 0], seen[:, f]] for f, own in enumerate(self.own) if f)
        own = np.exp(logs - logs.max(1, keepdims=True)).tolist()
        pairs, tags = self.pair.tolist(), seen[:, 0].tolist()
        many = len(nodes)
        up0, up1 = [1.0] * many, [1.0] * many  # products of the children's messages
        to0, to1 = [1.0] * many, [1.0] * many  # message to the parent
        for i in range(many - 1, 0, -1):
            (p00, p01), (p10, p11) = pairs[tags[i]]
            a, b = own[i][0] * up0[i], own[i][1] * up1[i]
            x, y = p00 * a + p01 * b, p10 * a + p11 * b
            to0[i], to1[i] = x / (x + y), y / (x + y)
            parent = nodes[i].parent
            x, y = up0[parent] * to0[i], up1[parent] * to1[i]
            scale = x + y
            up0[parent], up1[parent] = (x / scale, y / scale) if scale > 0 else (0.5, 0.5)
        found = [0.0] * many
        down0, down1 = [1.0] * many, [1.0] * many
        down0[0], down1[0] = self.first.tolist()
        for i in range(many):
            if i:
                parent, ((p00, p01), (p10, p11)) = nodes[i].parent, pairs[tags[i]]
                # the parent's belief without what this child has sent
                x = down0[parent] * own[parent][0] * up0[parent] / max(to0[i], 1e-300)
                y = down1[parent] * own[parent][1] * up1[parent] / max(to1[i], 1e-300)
                x, y = x / (x + y), y / (x + y)
                down0[i], down1[i] = x * p00 + y * p10, x * p01 + y * p11
            a, b = down0[i] * own[i][0] * up0[i], down1[i] * own[i][1] * up1[i]
            found[i] = b / (a + b) if a + b > 0 else 0.5
        return found


def main_text(html: str | None, model: Model) -> str:
    nodes = parse(html)
    if len(nodes) == 1:
        return " ".join(unescape("".join(nodes[0].parts)).split())
    chance = model.marginals(nodes)
    pieces: list[str] = []
    todo: list = [0]
    while todo:  # a text, or an element to open
        here = todo.pop()
        if isinstance(here, str):
            pieces.append(here)
            continue
        n = nodes[here]
        if n.tag in HIDDEN:
            continue
        keep = chance[here] > 0.5
        block = n.tag not in INLINE
        inner = [p for p in n.parts if isinstance(p, int) or keep or p.isspace()]
        if block:
            inner = ["\n", *inner, "\n"]
        todo.extend(reversed(inner))
    return " ".join(unescape("".join(pieces)).split())


def labelled_pages(spark: SparkSession, many: int = 600) -> DataFrame:
    """(page_id, html): pages made from parts, with data-label="1" on what is content and "0" on what is not."""
    rng = np.random.default_rng(17)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick("ka", "lo", "mi", "ter", "ing", "the", "and", "es", "on", "ra") for _ in range(int(rng.integers(1, 4))))

    def words_of(low: int, high: int) -> str:
        return " ".join(word() + pick("", "", "", "", "", ",", ".") for _ in range(int(rng.integers(low, high)))) + "."

    def listed(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{i}'>{word()} {word()}</a></li>" for i in range(n)) + "</ul>"

    def boiler() -> str:
        text, links = words_of(3, 40), listed(int(rng.integers(2, 8)))
        tag, name = pick(
            ("nav", ""), ("nav", "menu"), ("div", "nav main-menu"), ("div", "breadcrumbs"), ("ul", "menu"), ("header", ""), ("div", "header"), ("div", "masthead top"),
            ("footer", ""), ("div", "footer"), ("div", "copyright legal"), ("aside", ""), ("aside", "sidebar"), ("div", "sidebar widget"), ("div", "ad"), ("div", "advert banner"),
            ("section", "sponsor"), ("div", "cookie-notice"), ("div", "newsletter subscribe"), ("div", "notice alert"), ("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("div", "comment"),
            ("form", ""), ("form", "search login"), ("div", "related"), ("div", "share social"), ("div", "popup modal"), ("p", "notice"), ("p", "ad"), ("div", "promo"),
        )
        body = pick(links, text, f"<p>{text}</p>", f"<p>{words_of(10, 60)}</p><p>{words_of(5, 60)}</p>", f"<h3>{words_of(1, 4)}</h3>{links}", f"&copy; {text}", f"<label>{word()}</label><input name='q'><span>{word()}</span>", f"<div class='item'><p>{words_of(8, 70)}</p></div>" * int(rng.integers(1, 4)))
        if tag in ("p", "ul"):
            body = text if tag == "p" else links[4:-5]
        return f"<{tag} class='{name}' data-label='0'>{body}</{tag}>" if name else f"<{tag} data-label='0'>{body}</{tag}>"

    def content() -> str:
        parts = [f"<h1>{words_of(2, 12)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 9))):
            parts.append(pick(
                f"<p>{words_of(1, 90)}</p>", f"<p>{words_of(8, 120)}</p>", f"<p><b>{words_of(1, 30)}<br><p>{words_of(5, 90)}</p>", f"<p>{words_of(4, 60)} <a href='x'>{word()}</a> {words_of(3, 40)}</p>",
                f"<h2>{words_of(1, 6)}</h2>", f"<ul><li>{words_of(1, 12)}</li><li>{words_of(1, 12)}</li></ul>", f"<ol><li>{words_of(1, 30)}</li><li>{words_of(2, 9)} <a href='x'>{word()}</a></li></ol>", f"<p>{words_of(2, 12)} <a href='x'>{word()} {word()}</a>.</p>", f"<blockquote><p>{words_of(5, 40)}</p></blockquote>", f"<p><em>{words_of(2, 9)}</em> {words_of(9, 50)}</p>",
                f"<div>{words_of(8, 90)}</div>", f"<table><tr><td>{words_of(1, 5)}</td><td>{word()}</td></tr></table>", f"<pre><code>{words_of(3, 20)}</code></pre>", f"<figure><figcaption>{words_of(3, 12)}</figcaption></figure>",
            ))
            if rng.random() < 0.12:
                parts.append(boiler())
        tag, name = pick(("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post entry-content"), ("section", "story"), ("div", "main-content"), ("div", ""), ("section", ""), ("td", "content"))
        return f"<{tag} class='{name}' data-label='1'>{''.join(parts)}</{tag}>" if name else f"<{tag} data-label='1'>{''.join(parts)}</{tag}>"

    pages = []
    for i in range(many):
        bare = rng.random() < 0.15
        inside = content()
        if rng.random() < 0.4:  # texts without punctuation
            inside = re.sub(r"[.,](?=[ <])", "", inside)
        if bare:  # the page itself is what holds the content
            inside = inside[inside.index(">") + 1 : inside.rindex("<")]
        body = "".join(boiler() for _ in range(int(rng.integers(0 if bare else 1, 4)))) + inside + "".join(boiler() for _ in range(int(rng.integers(0 if bare else 1, 5))))
        body = body if bare else pick("{}", "<div>{}</div>", "<div class='wrapper page'>{}</div>", "<div id='container'>{}</div>").format(body)
        pages.append((i, f"<!DOCTYPE html><html><head><title>{word()}</title></head><body data-label='{int(bare)}'>{body}</body></html>"))
    return spark.createDataFrame(pages, "page_id long, html string")


def train(labelled: DataFrame) -> Model:
    """Shares over labelled pages. Elements without a label take their parent's; the page itself is no content."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, int] = {}
        for batch in batches:
            for html in batch["html"]:
                nodes = parse(html)
                seen, states = observed(nodes), [0] * len(nodes)
                for i, n in enumerate(nodes):
                    states[i] = int(n.label) if n.label in ("0", "1") else states[n.parent] if i else 0
                    keys = [(f, int(seen[i][0]) * 64 + int(v), states[i]) for f, v in enumerate(seen[i])] + ([(-1 - int(seen[i][0]), 1 + states[n.parent], states[i])] if i else [(-1, 0, states[i])])
                    for k in keys:
                        total[k] = total.get(k, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["what", "value", "state", "n"])

    rows = labelled.select("html").mapInPandas(count, "what int, value int, state int, n long").groupBy("what", "value", "state").agg(F.sum("n").alias("n"))
    own, pair, first = [np.zeros((SIZES[0], s, 2)) for s in SIZES], np.zeros((SIZES[0], 2, 2)), np.zeros(2)
    for what, value, state, n in rows.collect():  # as many rows as the model has numbers
        if what >= 0:
            own[what][value // 64, value % 64, state] = n
        elif value:
            pair[-1 - what, value - 1, state] = n
        else:
            first[state] = n
    return Model(own, pair, first)


def extract(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """pages with `text` and `n_chars` instead of html."""
    model = train(labelled if labelled is not None else labelled_pages(pages.sparkSession))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(h, shared.value) for h in part], dtype=object)

    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    return pages.select(*kept, text(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
