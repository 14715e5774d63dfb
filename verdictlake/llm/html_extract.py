"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is parsed into a tree of its block elements. Each node is content, surroundings or a mere container
of both; its tag, its class and id words and the shape of its text give unary potentials, and each
parent-child link a pairwise one that depends on the child's kind. Sum-product messages run from the leaves to the root and back, which gives
every node's marginal exactly, as the graph is a tree; blocks of nodes more likely content than not are
kept. Weights are trained by gradient steps on the likelihood of labelled pages (``labelled_pages``):
expected features come from the same message passing.

Many pages are done at once: nodes of all pages of a batch lie in flat arrays, and messages move a depth
at a time.

Defined cases: null and empty html have the empty text; text outside of any tag is read as the page's
body; unclosed and stray tags are mended as browsers do for paragraphs, list items and table parts; formulas
and the text of ``object`` are read, drawings (``svg``) are not, and an unclosed one ends where a block begins
or ends; a page that ends within a tag, a comment or a script ends there; repeated rows are each read; null
ids and urls are kept; a marginal of exactly one half is no content; an empty table gives an empty result;
pages are read in full, however long or deeply nested, in time that grows with their length; other columns
are not read, so their names do not matter.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import ship, slices, texts_of

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose insides are not text of the page, and are read up to their end tag or the page's end.
RAW = frozenset("script style noscript template textarea iframe title annotation annotation-xml".split())
#: Start tags that end an open drawing.
BREAKS = BLOCKS | frozenset("b big br code em embed i img meta nobr ruby s small span strong strike sub sup tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, up to the nearest of the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: A whole tag. A quote opens a value only behind an equals sign; nothing is tried twice, so a match or its
#: failure takes one pass.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: The slash of an unquoted value does not end an element.
_VALUE_SLASH = re.compile(r"=\s*+[^\s\"'>=]*/\Z")
_MARKS = re.compile(r"\b(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Bounds of text length in code points, and of the share of text in links, that bin a node's own text.
LENGTHS, LINKED = (1, 20, 60, 150, 400), (0.01, 0.3, 0.8)


@dataclass
class Page:
    """Nodes in page order (parents first) and runs of text, each with its node."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    marks: list[tuple[str, ...]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)


def parse(source: str) -> Page:
    """The tree of block elements; inline elements only tell which text is linked. One pass over the page."""
    page = Page()
    stack: list[tuple[str, int]] = []  # open block elements with their node
    opened: Counter[str] = Counter()
    text: list[str] = []
    link: int | None = None  # how many blocks were open when the open link began
    drawing = 0  # open svg elements

    def flush() -> None:
        if text:
            run = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if run:
                at = node()
                page.runs.append((at, run))
                page.size[at] += len(run)
                page.ends[at] += run[-1] in ".!?…:;\"”»。"

    def node() -> int:
        if not stack:
            open_("body", ())
        return stack[-1][1]

    def open_(tag: str, marks: tuple[str, ...]) -> None:
        if not page.parent and tag not in ("html", "head", "body"):
            open_("body", ())  # a fragment stands in the body of a page
        up = stack[-1][1] if stack else -1
        page.parent.append(up)
        page.depth.append(page.depth[up] + 1 if up >= 0 else 0)
        page.marks.append((tag, *marks))
        for counts in (page.size, page.linked, page.ends):
            counts.append(0)
        stack.append((tag, len(page.parent) - 1))
        opened[tag] += 1

    def close(tags, bounds) -> None:
        nonlocal link
        if not any(opened[t] for t in tags):
            return
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in tags:
                flush()
                opened.subtract(t for t, _ in stack[at:])
                del stack[at:]
                if link is not None and link > at:
                    link = None
                return
            if stack[at][0] in bounds:
                return

    def say(run: str) -> None:
        if not drawing:
            text.append(run)
            if link is not None:
                page.linked[node()] += len(run)

    at, end = 0, len(source)
    while at < end:
        begin = source.find("<", at)
        if begin < 0:
            say(source[at:])
            break
        if begin > at:
            say(source[at:begin])
        m = _TAG.match(source, begin)
        if m is None:
            after = source[begin + 1 : begin + 3]
            if after[:1] in ("!", "?") or (after[:1] == "/" and after[1:] and not _is_letter(after[1:])):
                # a comment, a declaration, or what passes for one
                stop = source.find("-->", begin + 2) + 2 if source.startswith("<!--", begin) else source.find(">", begin)
                if stop < begin:
                    break
                at = stop + 1
            elif _is_letter(after.lstrip("/")[:1]):
                break  # the page ends within a tag
            else:
                say("<")
                at = begin + 1
            continue
        at = m.end()
        tag, rest = m[2].lower(), m[3]
        if m[1]:
            if tag == "svg":
                drawing = max(0, drawing - 1)
            elif tag == "br":
                say(" ")
            elif tag == "a":
                link = None
            elif tag in BLOCKS and opened[tag]:
                drawing = 0
                close({tag}, ())
            continue
        if tag in RAW:
            found = _CLOSING[tag].search(source, at)
            stop = source.find(">", found.end()) if found else -1
            if stop < 0:
                break
            at = stop + 1
            continue
        if tag == "svg":
            drawing += not (rest.endswith("/") and not _VALUE_SLASH.search(rest))
            continue
        if drawing:
            if tag not in BREAKS:
                continue
            drawing = 0
        if tag in BLOCKS:
            flush()
            if tag in CLOSES:
                close(*CLOSES[tag])
            close({"p"}, {"button", "td", "th", "table", "caption"})
            if tag in HEADINGS:
                close(HEADINGS, {"div", "section", "article", "main", "body", "td", "li"})
            if tag == "hr":
                continue
            found = {k.lower(): a or b or c for k, a, b, c in _MARKS.findall(rest)} if rest else {}
            words = tuple(dict.fromkeys(_WORD.findall(" ".join(v for k, v in found.items() if k != "data-label").lower())))
            open_(tag, words)
            if "data-label" in found:
                page.label.append(len(page.parent) - 1)
        elif tag == "br":
            say(" ")
        elif tag == "a" and not rest.endswith("/"):
            link = len(stack)
    flush()
    return page


def _is_letter(c: str) -> bool:
    return c[:1].isascii() and c[:1].isalpha()


# -- labelled pages -----------------------------------------------------------------------------

#: Class and id words of parts that are not main text, and of parts that hold it.
OUTSIDE = {
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted banner".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager topbar tabs".split(),
    "head": "header masthead logo branding top".split(),
    "foot": "footer foot copyright legal colophon bottom".split(),
    "side": "sidebar side aside widget related recommended trending popular tags".split(),
    "note": "cookie cookies consent notice gdpr alert popup modal overlay disclaimer paywall".split(),
    "form": "form search newsletter subscribe signup login register share social sharing".split(),
    "talk": "comment comments reply replies discussion respond thread disqus feedback".split(),
}
INSIDE = "article content post entry main body text story page".split()
_TAGS = {"ad": "div section aside", "menu": "nav ul div menu", "head": "header div", "foot": "footer div", "side": "aside div section", "note": "div section dialog", "form": "form div section", "talk": "section div ol ul"}


def labelled_pages(n: int = 320, seed: int = 20) -> list[str]:
    """Pages made from parts whose role is known; content elements carry ``data-label``."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bdklmnrstv") for _ in range(rng.randint(1, 4)))
    phrase = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    prose = lambda: ". ".join(phrase(3, 14).capitalize() for _ in range(rng.randint(1, 7))) + "."
    short = lambda: rng.choice([phrase(1, 4), prose(), phrase(2, 8) + "."])
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'

    def outside(kind: str) -> str:
        tag = rng.choice(_TAGS[kind].split())
        named = rng.choice(OUTSIDE[kind])
        plain = tag in ("nav", "header", "footer", "aside", "form", "menu", "dialog")
        mark = "" if plain and rng.random() < 0.6 else f' {rng.choice(["class", "id"])}="{named}{rng.choice(["", "-" + word(), " " + word()])}"'
        links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 7))) + "</ul>"
        if tag in ("ul", "ol", "menu"):
            return f"<{tag}{mark}>" + "".join(f"<li>{link() if kind != 'talk' else '<p>' + prose() + '</p>'}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"
        inner = {
            "menu": links,
            "head": lambda: rng.choice([f"<h1>{phrase(1, 4)}</h1>", f"<div>{link()}</div>", f"<p>{phrase(2, 8)}</p>", links()]),
            "foot": lambda: rng.choice([f"&copy; {phrase(1, 4)} {short()}", f"<p>{short()}</p>", links(), prose()]),
            "side": lambda: rng.choice([f"<h3>{phrase(1, 3)}</h3>{links()}", f"<p>{prose()}</p>", prose(), f"<h2>{phrase(1, 3)}</h2><p>{short()}</p>"]),
            "form": lambda: f"<label>{phrase(1, 4)}</label><input><button>{word()}</button>" + rng.choice(["", f"<p>{short()}</p>"]),
            "talk": lambda: "".join(f"<{t}>{rng.choice(['', '<h4>' + word() + '</h4>'])}<p>{prose()}</p></{t}>" for t in [rng.choice(["div", "article", "li"])] * rng.randint(1, 4)),
        }.get(kind, lambda: rng.choice([short(), prose(), f"<p>{short()}</p>", link() + " " + short()]))()
        return f"<{tag}{mark}>{inner}</{tag}>"

    def inside(tag: str, text: str) -> str:
        return f'<{tag} data-label="1">{text}' + (f"</{tag}>" if tag != "p" or rng.random() < 0.8 else "")

    def article() -> str:
        tag = rng.choice(["article", "article", "main", "div", "section", "div"])
        mark = "" if tag in ("article", "main") and rng.random() < 0.7 else f' {rng.choice(["class", "id"])}="{rng.choice(INSIDE)}{rng.choice(["", "-" + word()])}"'
        parts = [inside(rng.choice(["h1", "h1", "h2"]), phrase(2, 9))] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                lead = rng.choice(["", "", "<b>" + phrase(1, 3) + "</b> ", link() + " "])
                parts.append(inside("p", lead + rng.choice([prose(), prose(), phrase(1, 6) + ".", phrase(1, 5)])))
            elif kind < 0.77:
                parts.append(inside(rng.choice(["h2", "h3"]), phrase(1, 6)))
            elif kind < 0.84:
                lines = "".join(inside("li", rng.choice([phrase(2, 9), prose()])) for _ in range(rng.randint(2, 5)))
                parts.append(f'<{(t := rng.choice(["ul", "ol"]))} data-label="1">{lines}</{t}>')
            elif kind < 0.89:
                parts.append(f'<blockquote data-label="1">{rng.choice([prose(), inside("p", prose())])}</blockquote>')
            elif kind < 0.92:
                cells = "".join("<tr data-label=1>" + "".join(inside("td", phrase(1, 4)) for _ in range(3)) + "</tr>" for _ in range(2))
                parts.append(f'<table data-label="1">{cells}</table>')
            elif kind < 0.95:
                parts.append(inside(rng.choice(["pre", "div", "figure"]), prose()))
            else:
                parts.append(outside(rng.choice(["ad", "side", "form", "note", "menu", "talk"])))
        if rng.random() < 0.15:
            parts.append(outside("talk"))
        return f'<{tag}{mark} data-label="1">' + "".join(parts) + f"</{tag}>"

    pages = []
    for _ in range(n):
        before = [outside(k) for k in rng.sample(["menu", "head", "ad", "note", "form", "side", "menu"], rng.randint(0, 4))]
        after = [outside(k) for k in rng.sample(["foot", "side", "ad", "talk", "form", "note", "foot"], rng.randint(0, 4))]
        body = "".join([*before, article(), *after])
        wrap = rng.random()
        if wrap > 0.95:
            pages.append(f'<body data-label="1">{" ".join(rng.choice([prose(), phrase(1, 6)]) for _ in range(rng.randint(1, 3)))}')
            continue
        if wrap > 0.88:
            body = "".join([*before, inside("h1", phrase(1, 6)), *(inside("p", rng.choice([prose(), phrase(2, 9)])) for _ in range(rng.randint(1, 6))), *after])
        if wrap < 0.25:
            body = f'<div id="{rng.choice(["wrap", "container", "page", "site", "app"])}">{body}</div>'
        pages.append(f"<html><head><title>{phrase(2, 5)}</title></head><body>{body}</body></html>")
    return pages


# -- the model ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Feature names with their weights for each label, and pairwise weights for each kind of child."""

    vocab: dict[str, int]
    unary: np.ndarray  # (features, LABELS)
    pair: np.ndarray  # (kinds, LABELS, LABELS): parent's label, child's label


#: Labels: a container of both, surroundings, content.
LABELS, CONTENT = 3, 2


#: Kinds of child by tag, for the pairwise potentials; 0 is any other.
KINDS = {t: 1 for t in "p h1 h2 h3 h4 h5 h6 pre blockquote dt dd figcaption".split()} | {t: 2 for t in "li ul ol dl table tbody thead tr td th".split()} | {t: 3 for t in "nav header footer aside form menu button select dialog".split()} | {"article": 4, "main": 4}
N_KINDS = 5


@dataclass
class Forest:
    """Nodes of many pages in flat arrays."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    row: np.ndarray  # of each feature that is on: its node
    col: np.ndarray  # and its number
    base: np.ndarray  # first node of each page


def features_of(page: Page) -> list[list[str]]:
    """Names of what is on at each node."""
    out = []
    for marks, size, linked, ends in zip(page.marks, page.size, page.linked, page.ends, strict=True):
        tag, *words = marks
        on = [f"tag {tag}", "bias", f"size {sum(size >= b for b in LENGTHS)}"]
        on += [f"word {w}" for w in words]
        if size:
            on.append(f"linked {sum(linked / size >= b for b in LINKED)}")
            on.append(f"ends {min(ends, 1)}")
        out.append(on)
    return out


def plant(pages: list[Page], number) -> Forest:
    parent, depth, kind, row, col, base = [], [], [], [], [], []
    at = 0
    for page in pages:
        base.append(at)
        parent += [p + at if p >= 0 else -1 for p in page.parent]
        depth += page.depth
        kind += [KINDS.get(m[0], 0) for m in page.marks]
        for k, on in enumerate(features_of(page)):
            for name in on:
                if (c := number(name)) is not None:
                    row.append(at + k)
                    col.append(c)
        at += len(page.parent)
    arr = lambda x: np.array(x, np.int64)
    return Forest(arr(parent), arr(depth), arr(kind), arr(row), arr(col), arr(base))


def unaries(f: Forest, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of what is on, for each node and label."""
    return np.stack([np.bincount(f.row, weights[f.col, k], len(f.parent)) for k in range(LABELS)], axis=1)


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def messages(f: Forest, score: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product: each node's label marginals, and the joint (parent, child) of each node.

    Upward a node tells its parent how well each label of the parent suits what is below; downward the
    parent tells it what all the rest holds. Logs throughout.
    """
    n = len(f.parent)
    belief, up = score.copy(), np.zeros((n, LABELS))
    order = np.argsort(f.depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(f.depth[order])) + 1) if n else []
    link = pair[f.kind]
    for nodes in reversed(levels[1:]):
        up[nodes] = _total(link[nodes] + belief[nodes][:, None, :], 2)
        np.add.at(belief, f.parent[nodes], up[nodes])
    joint = np.zeros((n, LABELS, LABELS))
    for nodes in levels[1:]:
        above = (belief[f.parent[nodes]] - up[nodes])[:, :, None] + link[nodes]
        both = above + belief[nodes][:, None, :]
        joint[nodes] = both - _total(both.reshape(len(nodes), -1), 1)[:, None, None]
        belief[nodes] += _total(above, 1)
    marginal = np.exp(belief - _total(belief, 1)[:, None]) if n else belief
    return marginal, np.where(f.parent[:, None, None] >= 0, np.exp(joint), 0)


def labels_of(f: Forest, pages: list[Page]) -> np.ndarray:
    """Content where marked, containers above it, surroundings elsewhere."""
    y = np.ones(len(f.parent), np.int64)
    for base, page in zip(f.base.tolist(), pages, strict=True):
        for k in page.label:
            y[base + k] = CONTENT
            up = page.parent[k]
            while up >= 0 and y[base + up] == 1 and up not in page.label:
                y[base + up] = 0
                up = page.parent[up]
    return y


@cache
def trained(n_pages: int = 320, seed: int = 20, steps: int = 150) -> Model:
    """Weights of greatest penalised likelihood on the labelled pages (Adam steps)."""
    pages = [parse(p) for p in labelled_pages(n_pages, seed)]
    vocab: dict[str, int] = {}
    f = plant(pages, lambda name: vocab.setdefault(name, len(vocab)))
    y = labels_of(f, pages)
    told = np.eye(LABELS)[y]
    child = np.flatnonzero(f.parent >= 0)
    truth = np.zeros((N_KINDS, LABELS, LABELS))
    np.add.at(truth, (f.kind[child], y[f.parent[child]], y[child]), 1)
    cut = len(vocab) * LABELS
    w = np.zeros(cut + truth.size)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        unary, pair = w[:cut].reshape(-1, LABELS), w[cut:].reshape(truth.shape)
        marginal, joint = messages(f, unaries(f, unary), pair)
        off = told - marginal
        grad_u = np.stack([np.bincount(f.col, off[f.row, k], len(vocab)) for k in range(LABELS)], axis=1)
        expected = np.zeros_like(truth)
        np.add.at(expected, f.kind[child], joint[child])
        grad = np.r_[grad_u.ravel(), (truth - expected).ravel()] / len(pages) - 0.001 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(vocab, w[:cut].reshape(-1, LABELS), w[cut:].reshape(truth.shape))


def main_texts(sources: list[str], model: Model) -> list[str]:
    """Main text of each page: blocks of nodes whose content marginal is above one half."""
    pages = [parse(s) for s in sources]
    f = plant(pages, model.vocab.get)
    marginal, _ = messages(f, unaries(f, model.unary), model.pair)
    keep = (marginal[:, CONTENT] > 0.5).tolist()
    return ["\n".join(run for node, run in page.runs if keep[base + node]) for base, page in zip(f.base.tolist(), pages, strict=True)]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, as the query's contract lays down. One narrow pass."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = main_texts(texts_of(b.column(2)), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
