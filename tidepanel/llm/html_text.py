"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block element is a node with a hidden state, content or boilerplate.
Unary potentials come from features of the node, pairwise potentials join it to
its parent; one upward and one downward sum-product pass give exact marginals.
Both kinds of potential are trained by gradient ascent on the likelihood of
labelled pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.common import sliced

# --- fixed values: element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
#: Elements that are left out with all that is nested in them.
LEFT_OUT = frozenset("template svg object".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary dialog menu button "
    "select center head hgroup search".split()
)
#: Elements that a following block start or one of their own kind closes.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
SCOPE = frozenset("ul ol dl table html body article section div main aside nav td th form".split())
#: Words in class, id and role that tell the kind of a box.
HINTS = (
    "nav menu breadcrumb header masthead footer sidebar aside widget related ad ads advert sponsor promo banner cookie consent "
    "notice alert popup modal newsletter subscribe signup form login search comment comments reply respond share social "
    "pagination copyright toc hidden content article post entry main story body text"
).split()
# ---
#: A tag whose attributes are read one by one, without going back: quotes count only after an equals sign.
TAG = re.compile(
    r"<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+)*+[\s/]*+)>"
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HINT_OF = {w: i for i, w in enumerate(HINTS)}
BOXES = frozenset(i for w, i in HINT_OF.items() if w not in ("content", "article", "post", "entry", "main", "story", "body", "text"))
SPLIT = re.compile(r"[^a-z]+")
#: First and last parts of names that tell about a page or a box's state, not its kind: has-sidebar, comments-open, search-results.
ABOUT_FIRST, ABOUT_LAST = frozenset("no has with without hide show is not".split()), frozenset("open closed enabled disabled results result".split())


def kinds_in(value: str) -> Iterator[int]:
    """The hints in a class, id or role."""
    for name in value.lower().split():
        parts = [x for x in SPLIT.split(name) if x]
        if len(parts) > 1 and (parts[0] in ABOUT_FIRST or parts[-1] in ABOUT_LAST):
            continue
        yield from (HINT_OF[x] for x in parts if x in HINT_OF)


class Page:
    """The block tree of a page: parents, tags, hints, and the text runs in page order."""

    __slots__ = ("parent", "tag", "hints", "runs", "chars", "linked", "labels")

    def __init__(self, source: str):
        self.parent, self.tag, self.hints = [-1], ["#"], [frozenset()]
        self.chars, self.linked = [0], [0]
        self.labels: list[int | None] = [0]
        self.runs: list[tuple[int, list[str]]] = []
        self._parse(source)

    def _text(self, node: int, text: str, links: int, fresh: bool) -> bool:
        if not text.strip():
            if text and self.runs and not fresh and self.runs[-1][0] == node:
                self.runs[-1][1].append(" ")
            return fresh
        n = len(text)
        self.chars[node] += n
        if links:
            self.linked[node] += n
        if fresh or not self.runs or self.runs[-1][0] != node:
            self.runs.append((node, [text]))
        else:
            self.runs[-1][1].append(text)
        return False

    def _parse(self, source: str) -> None:
        open_tags: list[tuple[str, int]] = [("#", 0)]
        links, fresh, at, end = 0, True, 0, len(source)
        unclosed: set[str] = set()

        def after(mark: str, start: int) -> int:
            """The place behind the next ``mark``, or the end."""
            return found + len(mark) if (found := source.find(mark, start)) >= 0 else end

        while at < end:
            begin = source.find("<", at)
            if begin < 0:
                fresh = self._text(open_tags[-1][1], html.unescape(source[at:]), links, fresh)
                break
            follows = source[begin + 1 : begin + 2]
            if not (follows in ("!", "?", "/") or follows.isascii() and follows.isalpha()):  # no markup
                begin = source.find("<", begin + 1)
                begin = end if begin < 0 else begin
                fresh = self._text(open_tags[-1][1], html.unescape(source[at:begin]), links, fresh)
                at = begin
                continue
            if begin > at:
                fresh = self._text(open_tags[-1][1], html.unescape(source[at:begin]), links, fresh)
            if source.startswith("<!--", begin):
                at = after(">", begin + 4) if source.startswith((">", "->"), begin + 4) else after("-->", begin + 4)
                continue
            if source.startswith("<![CDATA[", begin):
                at = after("]]>", begin)
                continue
            found = TAG.match(source, begin)
            if found is None:  # a comment of another kind, or a quote without end
                at = after(">", begin + 1)
                continue
            at = found.end()
            name = found[2].lower()
            if found[1]:
                if name == "a":
                    links = max(0, links - 1)
                elif name in BLOCK:
                    for i in range(len(open_tags) - 1, 0, -1):
                        if open_tags[i][0] == name:
                            del open_tags[i:]
                            fresh, links = True, 0
                            break
                continue
            if name in RAW and name not in unclosed and not found[3].rstrip().endswith("/"):
                close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                if close:
                    at = after(">", close.end())
                elif name in ("script", "style"):  # as browsers do: all that follows is its text
                    break
                else:
                    unclosed.add(name)
                continue
            if name in LEFT_OUT and name not in unclosed and not found[3].rstrip().endswith("/"):
                depth = 1
                for tag in re.compile(f"<(/?){name}(?=[\\s/>])", re.I).finditer(source, at):
                    depth += -1 if tag[1] else 1
                    if not depth:
                        at = after(">", tag.end())
                        break
                else:
                    unclosed.add(name)
                continue
            if name == "br":
                fresh = self._text(open_tags[-1][1], " ", links, fresh)
            elif name == "hr":
                fresh = True
            elif name == "a":
                links += 1
            elif name in BLOCK:
                if open_tags[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    open_tags.pop()
                if name in CLOSED_BY:
                    for i in range(len(open_tags) - 1, 0, -1):
                        if open_tags[i][0] in CLOSED_BY[name]:
                            del open_tags[i:]
                            break
                        if open_tags[i][0] in SCOPE:
                            break
                hints, label = set(), None
                if found[3]:
                    for key, a, b, c in ATTRIBUTE.findall(found[3]):
                        key = key.lower()
                        if key in ("hidden", "aria-hidden"):
                            if (a or b or c).lower() != "false":
                                hints.add(HINT_OF["hidden"])
                        else:
                            hints.update(kinds_in(a or b or c))
                    if "data-content=" in found[3]:
                        label = int('data-content="1"' in found[3])
                up = open_tags[-1][1]
                self.parent.append(up)
                self.tag.append(name)
                self.hints.append(frozenset(hints))
                self.chars.append(0)
                self.linked.append(0)
                self.labels.append(self.labels[up] if label is None else label)
                open_tags.append((name, len(self.parent) - 1))
                fresh, links = True, 0

    def blocks(self) -> Iterator[tuple[int, str]]:
        for node, parts in self.runs:
            if text := " ".join("".join(parts).split()):
                yield node, text


#: Feature layout: tag, hint, link share, length, place; each node has few, so they are index lists.
TAGS = {t: i for i, t in enumerate(sorted(BLOCK | {"#"}))}
AT_HINT = len(TAGS)
AT_LINK = AT_HINT + len(HINTS)
AT_LENGTH = AT_LINK + 4
AT_PLACE = AT_LENGTH + 6
AT_BOTH = AT_PLACE + 8
FEATURES = AT_BOTH + 16
KIND = {t: 1 for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figcaption")} | {
    t: 2 for t in ("ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "tr", "td", "th")
} | {t: 3 for t in ("div", "section", "article", "main", "body", "html", "#")}


def features(page: Page) -> list[list[int]]:
    n = len(page.parent)
    place, out = [0] * n, []
    # what holds the article, or the whole page, is no box, whatever its class says
    holds = [tag in ("html", "body") for tag in page.tag]
    for i in range(n - 1, 0, -1):
        if page.tag[i] in ("article", "main") or holds[i]:
            holds[page.parent[i]] = True
    for i in range(n):
        tag, up = page.tag[i], page.parent[i]
        own = place[up] if up >= 0 else 0
        if tag in ("article", "main"):
            own |= 1
        elif tag in ("nav", "footer", "aside", "form", "menu", "dialog"):
            own |= 2
        elif tag == "header" and not own & 1:
            own |= 2
        hints = page.hints[i] - BOXES if holds[i] and HINT_OF["hidden"] not in page.hints[i] else page.hints[i]
        if not BOXES.isdisjoint(hints):
            own |= 2
        place[i] = own
        f = [TAGS[tag], AT_PLACE + own, AT_BOTH + 4 * own + KIND.get(tag, 0)]
        f.extend(AT_HINT + h for h in sorted(hints))
        if chars := page.chars[i]:
            f.append(AT_LINK + min(3, int(4 * page.linked[i] / chars)))
            f.append(AT_LENGTH + min(5, int(math.log10(chars) * 2)))
        if tag == "header" and own & 1:
            f.append(AT_PLACE + 4)
        out.append(f)
    return out


def marginals(parent: list[int], unary: list[float], pair: tuple[float, float, float, float]) -> tuple[list[float], list[tuple]]:
    """P(content) of each node and, for each node but the root, its pairwise marginal with the parent.

    ``unary`` is the log odds of content, ``pair`` the log potentials
    (parent, child) = 00, 01, 10, 11.  Parents precede their children.
    """
    n = len(parent)
    e00, e01, e10, e11 = (math.exp(x) for x in pair)
    up0, up1 = [1.0] * n, [math.exp(max(-30.0, min(30.0, u))) for u in unary]
    m0, m1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        a, b = up0[i], up1[i]
        x, y = e00 * a + e01 * b, e10 * a + e11 * b
        s = x + y
        m0[i], m1[i] = x / s, y / s
        p = parent[i]
        c, d = up0[p] * m0[i], up1[p] * m1[i]
        s = c + d
        up0[p], up1[p] = c / s, d / s
    b1 = [0.0] * n
    b1[0] = up1[0] / (up0[0] + up1[0])
    pairs: list[tuple] = [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(1, n):
        p = parent[i]
        o0, o1 = (1.0 - b1[p]) / max(m0[i], 1e-300), b1[p] / max(m1[i], 1e-300)
        q00, q01, q10, q11 = o0 * e00 * up0[i], o0 * e01 * up1[i], o1 * e10 * up0[i], o1 * e11 * up1[i]
        s = q00 + q01 + q10 + q11
        pairs[i] = (q00 / s, q01 / s, q10 / s, q11 / s)
        b1[i] = pairs[i][1] + pairs[i][3]
    return b1, pairs


def train(pages: list[Page], rounds: int = 120, rate: float = 1.0, decay: float = 0.002) -> tuple[np.ndarray, tuple]:
    """Weights and pair potentials of greatest likelihood given the labels of the pages' nodes."""
    w, t = np.zeros(FEATURES), np.zeros(4)
    seen = [(p, features(p), [int(x or 0) for x in p.labels]) for p in pages]
    nodes = sum(len(p.parent) for p in pages)
    scale_w, scale_t = np.full(FEATURES, 1e-8), np.full(4, 1e-8)
    for _ in range(rounds):
        gw, gt = np.zeros(FEATURES), np.zeros(4)
        for page, feats, labels in seen:
            unary = [float(w[f].sum()) for f in feats]
            b, pairs = marginals(page.parent, unary, tuple(t))
            for i, f in enumerate(feats):
                gw[f] += labels[i] - b[i]
                if i:
                    gt[2 * labels[page.parent[i]] + labels[i]] += 1
                    gt -= pairs[i]
        gw, gt = gw / nodes - decay * w, gt / nodes - decay * t
        scale_w += gw * gw
        scale_t += gt * gt
        w += rate * gw / np.sqrt(scale_w)
        t += rate * gt / np.sqrt(scale_t)
    return w, tuple(float(x) for x in t)


def labelled_pages(n: int = 80, seed: int = 7) -> list[str]:
    """Labelled training pages: ``data-content`` marks content (1) and boilerplate (0) for a subtree."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))) + "."

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k)) + "</ul>"

    def para() -> str:
        kind = rng.random()
        if kind < 0.08:
            return "<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.14:
            return f"<h2>{words(1, 6)}</h2>"
        if kind < 0.2:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if kind < 0.24:
            return f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"
        if kind < 0.28:
            return f'<p><a href="/x">{words(2, 6)}</a></p>'
        return f"<p>{words(1, 90)}</p>"

    boxes = [
        lambda: f'<nav data-content="0">{links(rng.randint(2, 8))}</nav>',
        lambda: f'<div class="{rng.choice(["ad", "advert", "ads banner", "sponsor", "promo"])}" data-content="0">{words(3, 25)}</div>',
        lambda: f'<aside class="{rng.choice(["sidebar", "related", "widget", ""])}" data-content="0"><h3>{words(1, 3)}</h3>{links(3)}<p>{words(4, 20)}</p></aside>',
        lambda: f'<div id="{rng.choice(["cookie-notice", "consent", "cookie banner", "alert notice"])}" data-content="0"><p>{words(5, 25)}</p><button>{words(1, 1)}</button></div>',
        lambda: f'<form class="{rng.choice(["newsletter", "search", "login", ""])}" data-content="0"><p>{words(2, 9)}</p><button>ok</button></form>',
        lambda: f'<{(t := rng.choice(["section", "div"]))} {rng.choice(["id", "class"])}="comments" data-content="0"><h3>{words(1, 2)}</h3>'
        + "".join(f'<div class="comment"><p>{words(3, 60)}</p></div>' for _ in range(3)) + f"</{t}>",
        lambda: f'<div class="{rng.choice(["share", "social share", "breadcrumb", "pagination", "menu"])}" data-content="0">{links(2)}</div>',
        lambda: f'<div class="sidebar" data-content="0"><p>{words(4, 40)}</p></div>',
    ]
    out = []
    for i in range(n):
        tag, extra = rng.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("article", "")])
        head = f"<h1>{words(1, 12)}</h1>"
        body = [f'<header data-content="1">{head}</header>' if rng.random() < 0.2 else head, *(para() for _ in range(rng.randint(1, 14)))]
        for _ in range(rng.randint(0, 2)):
            body.insert(rng.randint(1, len(body)), rng.choice(boxes)())
        top = f'<header data-content="0"><p>{words(1, 6)}</p>{links(3)}</header>' if rng.random() < 0.5 else ""
        parts = [top, *(rng.choice(boxes)() for _ in range(rng.randint(0, 3))), f'<{tag}{extra} data-content="1">{"".join(body)}</{tag}>']
        parts += [*(rng.choice(boxes)() for _ in range(rng.randint(0, 2))), f'<footer data-content="0"><p>{words(2, 12)}</p></footer>' if i % 2 else f'<footer data-content="0">&copy; {words(2, 12)}</footer>']
        if rng.random() < 0.4:
            parts = ['<div class="wrapper">', *parts, "</div>"]
        body_class = rng.choice(["", "", ' class="single has-sidebar"', ' class="post comments-open"', ' class="page no-sidebar"'])
        out.append(f"<html><head><title>{words(1, 5)}</title></head><body{body_class}>{''.join(parts)}</body></html>")
    return out


@lru_cache(maxsize=1)
def default_model() -> tuple[np.ndarray, tuple]:
    return train([Page(p) for p in labelled_pages()])


class Extractor:
    def __init__(self, model: tuple[np.ndarray, tuple] | None = None):
        weights, self.pair = model or default_model()
        self.weights = [float(x) for x in weights]

    def marginal_blocks(self, source: str | None) -> list[tuple[str, float]]:
        """(text of the block, probability of content) in page order."""
        page = Page(source or "")
        w = self.weights
        unary = [sum(w[k] for k in f) for f in features(page)]
        b, _ = marginals(page.parent, unary, self.pair)
        return [(text, b[node]) for node, text in page.blocks()]

    def text(self, source: str | None) -> str:
        return "\n\n".join(text for text, p in self.marginal_blocks(source) if p >= 0.5)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", model: tuple | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per page.

    NULL and empty pages, and pages without content, give the empty text;
    broken markup is read as far as it goes, in time linear in the page's
    length.  Repeated rows give repeated rows, an empty table none; other
    columns are left out.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model)
        for batch in sliced(batches, source):
            texts = [extractor.text(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}
    return pages.select(page_id, url, source).mapInArrow(run, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars bigint")
