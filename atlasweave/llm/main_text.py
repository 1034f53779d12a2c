"""Main text of web pages: boosted trees over the nodes of the element tree, decoded along its hierarchy.

Every element gets features of its subtree, attributes, place and siblings. The trees learn from pages of the table whose
article is marked as such, as they are and with their parts moved into other page skeletons without that
mark. Their log-odds are decoded over the whole tree: on the way from the root elements are outside, then inside, then
in an excluded part, so no element contradicts its ancestors, and the most likely such choice wins.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasweave.llm.boosting import Boosted

#: Pages that training sees at most, drawn by hash, and the skeletons that each is moved into.
TRAINING_PAGES, SKELETONS = 150, 4
_SEED = 11
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+")
_SILENT = frozenset("script style noscript template svg math iframe object head title textarea select button canvas".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KINDS = ("article", "main", "section", "div", "p", "h", "ul", "li", "table", "nav", "header", "footer", "aside", "form", "a", "blockquote", "body", "inline", "other")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    texts: int = 0
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, int]]]:
    """Elements in page order, the first one a root, and (element, text, block) of each text; blocks begin and end at block elements."""
    nodes, texts = [Node("#root", -1, 0, [])], []
    stack, block, at = [0], 0, 0

    def close(to: int) -> None:
        nonlocal block
        while len(stack) > to:
            block += nodes[stack.pop()].tag not in _INLINE

    while True:
        match = _TAG.search(page, at)
        end = match.start() if match else len(page)
        if end > at:
            texts.append((stack[-1], page[at:end], block))
        if not match:
            break
        at, tag = match.end(), (match[2] or "").lower()
        if not tag:
            continue
        if match[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    close(k)
                    break
                if tag in _INLINE and nodes[stack[k]].tag not in _INLINE:
                    break
            continue
        if tag == "br":
            texts.append((stack[-1], " ", block))
            continue
        if tag not in _INLINE:
            for k in range(len(stack) - 1, 0, -1):
                name = nodes[stack[k]].tag
                if name == "p" or name in _CLOSES.get(tag, ()):
                    close(k)
                    if name == "p":
                        continue
                    break
                if name not in _INLINE:
                    break
            block += 1
        if tag in _VOID:
            continue
        found = [] if not match[3].strip() else [w.lower() for a in _ATTRIBUTE.findall(match[3]) for w in _WORD.findall("".join(a))]
        parent = stack[-1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, found))
        nodes[parent].children.append(len(nodes) - 1)
        if tag in _RAW:
            stop = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            block += 1
            continue
        if not match[3].rstrip().endswith("/") or tag not in ("path", "circle", "rect", "use"):
            stack.append(len(nodes) - 1)
    return nodes, texts


def _kind(tag: str) -> int:
    if tag in _KINDS:
        return _KINDS.index(tag)
    if re.fullmatch("h[1-6]", tag):
        return _KINDS.index("h")
    if tag in ("ol", "dl"):
        return _KINDS.index("ul")
    if tag in ("td", "tr", "th", "tbody", "thead"):
        return _KINDS.index("table")
    return _KINDS.index("inline" if tag in _INLINE else "other")


_KIND: dict[str, int] = {}
_PLAIN = np.zeros(2)


def features(nodes: list[Node], texts: list[tuple[int, str, int]], odds: dict[str, float]) -> np.ndarray:
    """One row per element: subtree sizes and densities, links, marks, attribute tokens, depth, place, parent and siblings."""
    n = len(nodes)
    chars, links, words, stops = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for at, text, _ in texts:
        if text.isspace():
            continue
        size = len(text)
        chars[at] += size
        words[at] += text.count(" ") + 1
        stops[at] += text.count(". ") + text.count(",") + text.endswith(".")
    kind, parent, depth = np.empty(n, int), np.empty(n, int), np.empty(n)
    token, worst = np.zeros(n), np.zeros(n)
    order, siblings, tags, blocks, within = np.zeros(n), np.ones(n), np.ones(n), np.zeros(n), np.zeros((n, 2))
    for i, node in enumerate(nodes):
        if (k := _KIND.get(node.tag)) is None:
            k = _KIND[node.tag] = _kind(node.tag)
        kind[i], parent[i], depth[i] = k, node.parent, node.depth
        if node.tokens:
            known = [odds.get(w, 0.0) for w in node.tokens]
            token[i], worst[i] = sum(known), min(known)
        if node.tag == "p":
            blocks[i] = 1
        for k, child in enumerate(node.children):
            order[child], siblings[child] = k, len(node.children)
        if i:
            up = within[node.parent]
            within[i] = min(up[0], token[i]), max(up[1], token[i])
    links[:] = np.where(kind == _KINDS.index("a"), chars, 0)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        words[p] += words[i]
        stops[p] += stops[i]
        links[p] += chars[i] if nodes[i].tag == "a" else links[i]
        tags[p] += tags[i]
        blocks[p] += blocks[i]
    density, linked = chars / tags, links / np.maximum(chars, 1)
    up = np.maximum(parent, 0)
    before, after = np.zeros((n, 2)), np.zeros((n, 2))
    for node in nodes:
        for a, b in zip(node.children, node.children[1:]):
            before[b] = density[a], linked[a]
            after[a] = density[b], linked[b]
    return np.stack([
        kind, kind[up], kind[up[up]], depth, np.log1p(chars), np.log1p(words), np.log1p(tags), np.log1p(density), linked, stops / np.maximum(words, 1),
        chars / np.maximum(words, 1), np.log1p(blocks), blocks / tags, token, worst, token[up], within[:, 0], within[:, 1], order, siblings, order / siblings,
        np.arange(n) / n, chars / max(1.0, chars[0]), chars / np.maximum(chars[up], 1), np.log1p(density[up]), linked[up],
        np.log1p(before[:, 0]), before[:, 1], np.log1p(after[:, 0]), after[:, 1],
    ], axis=1)


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[bool]:
    """Inside or not, for each element: outside, then inside, then excluded along every path, the most likely choice over the whole tree."""
    n = len(nodes)
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    outside, inside, excluded = no.tolist(), yes.tolist(), no.tolist()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        if nodes[i].tag in _SILENT:
            inside[i] = -math.inf
        outside[p] += max(outside[i], inside[i])
        inside[p] += max(inside[i], excluded[i])
        excluded[p] += excluded[i]
    state = [0] * n
    for i in range(1, n):
        above = state[nodes[i].parent]
        state[i] = (0 if outside[i] >= inside[i] else 1) if above == 0 else (1 if inside[i] >= excluded[i] else 2) if above == 1 else 2
    return [s == 1 for s in state]


@dataclass
class PageModel:
    odds: dict[str, float]
    trees: Boosted

    def texts(self, pages: list[str]) -> list[str]:
        parsed = [parse(page) for page in pages]
        rows = [features(nodes, texts, self.odds) for nodes, texts in parsed]
        scores = self.trees.log_odds(np.concatenate(rows)) if rows else np.empty(0)
        out, at = [], 0
        for nodes, texts in parsed:
            out.append(_joined(decode(nodes, scores[at : at + len(nodes)]), texts))
            at += len(nodes)
        return out


def _joined(inside: list[bool], texts: list[tuple[int, str, int]]) -> str:
    blocks: dict[int, list[str]] = {}
    for node, text, block in texts:
        if inside[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


# Parts of the skeletons that pages are moved into: what such parts are called, for either side.
_GOOD = "article post entry content story main body text page single hentry blog news detail".split()
_BAD = {
    "nav": "nav menu navigation breadcrumb topbar links", "header": "header masthead banner site top logo", "footer": "footer bottom copyright legal site",
    "aside": "sidebar aside widget related recommended trending popular more", "notice": "notice cookie consent alert popup newsletter subscribe modal",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner", "form": "form search login signup contact", "comments": "comments comment respond discussion reply replies thread reader",
    "share": "share social tools byline tags meta",
}
_BAD_TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "form": ("form",), "comments": ("section", "div", "ol")}


def _moved(article: str, others: list[str], lines: list[str], rng: np.random.Generator) -> str:
    """A page with the article's blocks inside a marked wrapper, and parts of the other side around and in it; data-main marks the truth."""
    pick = lambda items: items[int(rng.integers(len(items)))]

    def line() -> str:
        words = pick(lines).split()
        return " ".join(words[: int(rng.integers(2, 40))])

    def bad(kind: str) -> str:
        tag = pick(_BAD_TAGS.get(kind, ("div",)))
        name = " ".join(str(pick(_BAD[kind].split())) for _ in range(int(rng.integers(1, 3)))) if rng.random() < 0.85 or tag == "div" else ""
        links = "".join(f'<{w}><a href="#">{" ".join(line().split()[:3])}</a></{w}>' for w in [pick(["li", "span", "p", "div"])] * int(rng.integers(2, 8)))
        plain = "".join(f"<{w}>{line()}</{w}>" for w in [pick(["p", "div", "span", "li"])] * int(rng.integers(1, 5)))
        inner = {"nav": links, "header": links if rng.random() < 0.5 else f"<h1>{line()}</h1>", "footer": plain if rng.random() < 0.5 else links, "aside": f"<h3>{line()}</h3>" + (links if rng.random() < 0.6 else plain), "form": f"<label>{line()}</label><input name=q><p>{line()}</p>", "comments": "".join(f'<div class="comment"><b>{line()}</b><p>{line()} {line()}</p></div>' for _ in range(int(rng.integers(1, 6)))), "share": links}.get(kind, pick([plain, plain, pick(others)]))
        return f"<{tag}{f' {pick(["class", "id"])}="{pick(["", "site-", "page-"])}{name}"' if name else ''}>{inner}</{tag}>"

    cut = re.split(r"(?=<p[ >])", article)
    if rng.random() < 0.4 and len(cut) > 2:
        cut.insert(int(rng.integers(1, len(cut))), "</b></p>" + bad(pick(["ad", "share", "notice", "aside"])))
    tag = pick(["article", "div", "div", "section", "main"])
    name = "" if tag in ("article", "main") and rng.random() < 0.5 else f' {pick(["class", "id"])}="{"-".join(str(pick(_GOOD)) for _ in range(int(rng.integers(1, 3))))}"'
    main = f"<{tag}{name} data-main>{''.join(cut)}</{tag}>"
    if rng.random() < 0.4:
        main += bad("comments")
    if rng.random() < 0.5:
        main = f'<div class="{pick(["wrapper", "container", "row", "layout", "site"])}">{main}{bad("aside") if rng.random() < 0.6 else ""}</div>'
    head = [bad(k) for k in ("nav", "header", "notice", "ad", "form", "share") if rng.random() < 0.45]
    tail = [bad(k) for k in ("comments", "aside", "ad", "share", "notice", "form", "footer") if rng.random() < 0.45]
    rng.shuffle(head)
    return f"<html><head><title>{line()}</title></head><body>{''.join(head)}{main}{''.join(tail)}</body></html>"


def _truth(page: str) -> tuple[list[Node], list[tuple[int, str, int]], np.ndarray] | None:
    """Elements and which of them belong: those in the marked part, or the page's only article, less what lies in named parts of the other side."""
    marked = " data-main" in page
    nodes, texts = parse(page.replace(" data-main", " id=truemark") if marked else page)
    tops = [i for i, x in enumerate(nodes) if ("truemark" in x.tokens if marked else x.tag == "article")]
    if len(tops) != 1:
        return None
    bad_names = {w for names in _BAD.values() for w in names.split()}
    inside = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        if i == tops[0]:
            inside[i] = True
            node.tokens[:] = [w for w in node.tokens if w != "truemark"]
        elif i and inside[node.parent]:
            inside[i] = not (node.tag in ("nav", "header", "footer", "aside", "form") or bad_names & set(node.tokens) and node.tag not in _INLINE)
    return nodes, texts, inside


def train(pages: list[str], skeletons: int = SKELETONS) -> PageModel:
    """A model of the pages that mark exactly one article. Without any, it finds no main text."""
    rng, found = np.random.default_rng(_SEED), []
    articles = [m[1] for page in pages if (m := re.search(r"<article[^>]*>(.*?)</article>", page, re.S | re.I))]
    lines = [t.strip() for page in pages for _, t, _ in parse(page)[1] if len(t.split()) > 3] or ["text"]
    others = [f"<p>{line}</p>" for line in lines[:200]]
    for page in pages:
        found.append(_truth(page))
    for article in articles:
        found += [_truth(_moved(article, others, lines, rng)) for _ in range(skeletons)]
    known = [x for x in found if x]
    good, bad = Counter(), Counter()
    for nodes, _, inside in known:
        for node, is_in in zip(nodes, inside.tolist(), strict=True):
            (good if is_in else bad).update(set(node.tokens))
    odds = {w: math.log((good[w] + 0.5) / (bad[w] + 0.5)) for w in sorted(good | bad)}
    trees = Boosted()
    if not known or not any(x[2].any() for x in known):
        trees.base = -20.0
        return PageModel(odds, trees)
    return PageModel(odds, trees.fit(np.concatenate([features(nodes, texts, odds) for nodes, texts, _ in known]), np.concatenate([x[2] for x in known]).astype(float)))


#: Hash values that pages are drawn by.
_HASHES = 1 << 40


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose html has exactly one marked part."""
    for batch in batches:
        html = batch.column(batch.schema.get_field_index("html")).to_pylist()
        yield batch.filter(pa.array([_truth(page) is not None for page in html], pa.bool_()))


def train_from_table(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = TRAINING_PAGES) -> PageModel:
    """A model of about ``rows`` pages that mark exactly one article, drawn by a hash of the id; null ids and null pages teach nothing.

    Only pages with a mark in their source are drawn, and only drawn ones are parsed; the draw widens until it has ``rows`` or all.
    """
    known = pages.select(pages[id_col].alias("id"), pages[html_col].alias("html")).where("id is not null and html is not null")
    known = known.where(F.col("html").rlike("(?i)<article|\\sdata-main"))
    draw = F.pmod(F.xxhash64("id"), F.lit(_HASHES))
    limit = -(-_HASHES * rows // max(rows, known.count()))
    while True:
        some = known.where(draw < limit).withColumn("draw", draw)
        drawn = some.mapInArrow(_marked, some.schema).toPandas()
        if len(drawn) >= rows * 3 // 4 or limit >= _HASHES:
            break
        limit = min(_HASHES, limit * max(2, min(16, rows // max(1, len(drawn)) + 1)))
    # a widened draw can hold more than was asked for
    drawn = drawn.sort_values(["draw", "id", "html"]).head(rows * 5 // 4).sort_values(["id", "html"])
    return train(drawn["html"].tolist())


def extract_text(pages: DataFrame, model: PageModel, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``, the main text of each whole page: blocks in page order, one to a line; empty if there is none or the page is null.

    Every row and column stays; a column of the input named like ``out`` is replaced.
    """
    pages = pages.drop(out) if out != html_col else pages
    names, at = [*pages.columns, out], pages.columns.index(html_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = shared.value.texts([p or "" for p in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return pages.mapInArrow(run, T.StructType([*pages.schema, T.StructField(out, T.StringType())]))
