"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree. Each has a label: part of the article, or not. A node
has a potential from its own features, every parent and child share a potential, and messages
are passed up and then down the tree (sum-product), which gives each node's marginal. The
potentials are fitted on labelled pages by the gradient of the likelihood, whose expectations
come from the same messages. Text of nodes with a marginal above one half is the main text.

Defined cases: null and empty html, and pages without article, give an empty text; unclosed or
stray tags are mended; white space (also from character references) inside a block becomes one
space and a line break (br) is white space; rows with equal ids are read each on its own; extra
columns play no part.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import slices
from assayloom.llm.dom import Page, parse

#: Labelled pages that the potentials are fitted on, and steps of the fit.
TRAIN_PAGES = 400
STEPS = 300
# Element names and words in class, id or role that may tell article from rest.
_TAGS = (
    "article main section header footer nav aside div p h1 h2 h3 h4 ul ol li dl table tr td "
    "blockquote pre figure figcaption form label button select option textarea fieldset body "
    "html span b i em strong details summary dialog address address hr menu center"
).split()
_WORDS = (
    "article post entry content main body story text prose | ad ads advert advertisement sponsor "
    "sponsored promo promoted banner | nav menu navbar breadcrumb breadcrumbs pagination tabs | "
    "footer foot copyright legal | header masthead top topbar | sidebar side rail widget aside | "
    "comment comments reply replies discussion disqus respond | cookie cookies notice consent gdpr "
    "alert modal popup overlay | share social follow | related recommended more trending popular | "
    "newsletter subscribe signup login search form | style-hidden hidden sr-only | byline author "
    "meta date tags"
)
_GROUPS = [set(g.split()) for g in _WORDS.split("|")]
_SPLIT = re.compile(r"[^a-z]+")
_TAG_AT = {t: i for i, t in enumerate(dict.fromkeys(_TAGS))}
_N_TAGS, _N_GROUPS = len(_TAG_AT) + 1, len(_GROUPS)
N_FEATURES = _N_TAGS + 2 * _N_GROUPS + 12


@lru_cache(maxsize=100_000)
def _word_groups(marks: str) -> tuple[int, ...]:
    words = set(_SPLIT.split(marks)) | set(marks.split())
    return tuple(i for i, g in enumerate(_GROUPS) if words & g)


def features(page: Page) -> np.ndarray:
    """One row per node: element, own and inherited word groups, text and link measures."""
    n = len(page.tag)
    out = np.zeros((n, N_FEATURES), np.float32)
    own = np.zeros((n, 3))  # characters, characters in links, sentence marks
    for node, _, text, link in page.texts:
        size = len(text) if not text.isspace() else 0
        own[node] += (size, size * link, text.count(".") + text.count(",") + text.count("?"))
    whole, parent = own.copy(), page.parent
    for i in range(n - 1, 0, -1):
        whole[parent[i]] += whole[i]
    g = _N_TAGS
    for i in range(n):
        out[i, _TAG_AT.get(page.tag[i], _N_TAGS - 1)] = 1
        for k in _word_groups(page.marks[i]) if page.marks[i] else ():
            out[i, g + k] = 1
        if i:
            out[i, g + _N_GROUPS:g + 2 * _N_GROUPS] = np.maximum(
                out[parent[i], g:g + _N_GROUPS],
                out[parent[i], g + _N_GROUPS:g + 2 * _N_GROUPS])
    at = g + 2 * _N_GROUPS
    links = whole[:, 1] / np.maximum(1, whole[:, 0])
    out[:, at] = np.log1p(own[:, 0]) / 5
    out[:, at + 1] = np.log1p(whole[:, 0]) / 5
    out[:, at + 2] = links
    out[:, at + 3] = links > 0.5
    out[:, at + 4] = np.minimum(1, 10 * whole[:, 2] / np.maximum(1, whole[:, 0]))
    out[:, at + 5] = whole[:, 0] / max(1.0, whole[0, 0])
    out[:, at + 6] = whole[:, 0] == 0
    out[:, at + 7] = own[:, 0] > 80
    out[:, at + 8] = np.arange(n) / n
    out[:, at + 9] = 1
    out[0, at + 10] = 1
    # An article or main element that nothing around it marks as something else.
    rest = out[:, g + 1:g + _N_GROUPS].any(1) | out[:, g + _N_GROUPS + 1:at].any(1)
    out[:, at + 11] = (out[:, _TAG_AT["article"]] + out[:, _TAG_AT["main"]] > 0) & ~rest
    return out


@dataclass
class Forest:
    """Nodes of several pages; ``levels`` lists them by depth."""

    parent: np.ndarray
    levels: list[np.ndarray]

    @staticmethod
    def of(pages: list[Page]) -> Forest:
        parent, depth, start = [], [], 0
        for page in pages:
            for i, p in enumerate(page.parent):
                parent.append(-1 if i == 0 else start + p)
                depth.append(0 if i == 0 else depth[start + p] + 1)
            start += len(page.parent)
        order = np.argsort(depth, kind="stable")
        cuts = np.cumsum(np.bincount(depth))[:-1] if depth else []
        return Forest(np.array(parent), np.split(order, cuts))


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def messages(forest: Forest, unary: np.ndarray, pair: np.ndarray):
    """Sum-product: (log beliefs of nodes, log beliefs of (parent, child) label pairs).

    ``unary``: (nodes, 2) log potentials; ``pair``: (parent label, child label).
    """
    up = unary.copy()  # own potential and all messages from below
    sent = np.zeros_like(unary)  # message of each node to its parent
    for level in forest.levels[:0:-1]:
        sent[level] = _soft(pair[None] + up[level][:, None, :], 2)
        np.add.at(up, forest.parent[level], sent[level])
    belief, joint = up.copy(), np.zeros((len(unary), 2, 2))
    for level in forest.levels[1:]:
        above = belief[forest.parent[level]] - sent[level]  # parent without this child
        joint[level] = above[:, :, None] + pair[None] + up[level][:, None, :]
        belief[level] = _soft(joint[level], 1)
    return belief, joint


@dataclass(frozen=True)
class TreeModel:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, pages: list[Page]) -> np.ndarray:
        """Probability that each node of the pages, one after the other, is content."""
        forest = Forest.of(pages)
        unary = np.zeros((len(forest.parent), 2))
        unary[:, 1] = np.concatenate([features(p) for p in pages]) @ self.weights
        belief, _ = messages(forest, unary, self.pair)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))


def train_tree_model(pages: list[Page], steps: int = STEPS, decay: float = 1e-4) -> TreeModel:
    """Potentials that make the labels of the pages likely (gradient steps with momentum)."""
    forest = Forest.of(pages)
    x = np.concatenate([features(p) for p in pages]).astype(np.float64)
    y = np.concatenate([p.label for p in pages])
    below = np.concatenate(forest.levels[1:])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[below]], y[below]), 1)
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = v = np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        unary = np.stack([np.zeros(len(x)), x @ w], 1)
        belief, joint = messages(forest, unary, pair)
        share = np.exp(belief - _soft(belief, 1)[:, None])[:, 1]
        pairs = joint[below]
        pairs = np.exp(pairs - _soft(_soft(pairs, 2), 1)[:, None, None])
        slope = np.concatenate([
            x.T @ (y - share) / len(x) - decay * w,
            ((seen - pairs.sum(0)) / len(x) - decay * pair).ravel(),
        ])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope ** 2
        move = 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, pair = w + move[:-4], pair + move[-4:].reshape(2, 2)
    return TreeModel(w, pair)


def text_of(page: Page, content: np.ndarray) -> str:
    """Blocks of the content nodes in page order, joined by an empty line."""
    blocks: list[tuple[int, list[str]]] = []
    for node, block, text, _ in page.texts:
        if content[node]:
            if not blocks or blocks[-1][0] != block:
                blocks.append((block, []))
            blocks[-1][1].append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in blocks)
    return "\n\n".join(line for line in lines if line)


# --- labelled pages ------------------------------------------------------------------------------

_SYLLABLES = "the er in on an re de la que und sch ment ción ung ou ti ha st le en ar os".split()
_RESTS = {
    "nav": (["nav", "div", "ul", "header"], ["menu", "navbar", "main-nav", "breadcrumb", ""]),
    "ad": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "sponsored", "promo banner"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", ""]),
    "header": (["header", "div"], ["header", "masthead", "topbar", ""]),
    "side": (["aside", "div", "section"], ["sidebar", "widget", "related", "rail", "trending"]),
    "notice": (["div", "section", "dialog"], ["cookie-notice", "notice", "consent", "alert", "modal"]),
    "form": (["form", "div"], ["newsletter", "subscribe", "search", "login", "signup", ""]),
    "comments": (["section", "div", "ol"], ["comments", "comment-list", "discussion", "replies"]),
    "share": (["div", "ul"], ["share", "social", "follow"]),
}


def _words(rng: random.Random, n: int) -> str:
    made = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(n):
        if rng.random() < 0.12:
            made[i] += rng.choice(".,.,.?;")
    return " ".join(made).capitalize() + rng.choice([".", ".", ""])


def _links(rng: random.Random) -> str:
    inner = "".join(
        f'<li><a href="/{i}">{_words(rng, rng.randint(1, 4))}</a></li>'
        for i in range(rng.randint(2, 9))
    )
    return rng.choice(["<ul>{}</ul>", "{}", "<ol>{}</ol>"]).format(inner)


def _rest(rng: random.Random, kind: str) -> str:
    tags, classes = _RESTS[kind]
    tag, mark = rng.choice(tags), rng.choice(classes)
    if kind in ("nav", "share") or (kind == "side" and rng.random() < 0.5):
        inner = _links(rng)
    elif kind == "form":
        inner = (f"<label>{_words(rng, 2)}</label><input name='e'><p>{_words(rng, rng.randint(2, 25))}"
                 f"</p><button>{_words(rng, 1)}</button>")
    elif kind == "comments":
        inner = f"<h3>{_words(rng, 2)}</h3>" + "".join(
            f'<{t} class="{rng.choice(["comment", "reply", ""])}"><p>{_words(rng, rng.randint(3, 60))}</p></{t}>'
            for t in [rng.choice(["div", "li", "article"]) for _ in range(rng.randint(1, 5))])
    elif rng.random() < 0.5:
        inner = _words(rng, rng.randint(2, 30))
    else:
        inner = "".join(f"<p>{_words(rng, rng.randint(2, 40))}</p>" for _ in range(rng.randint(1, 3)))
    if not mark and tag == "div":
        mark = kind
    where = rng.choice(["class", "class", "class", "id", "role"])
    named = f' {where}="{mark}"' if mark and rng.random() < 0.9 else ""
    if not named and tag in ("div", "section", "ul", "ol"):
        named = f' class="{mark or kind}"'
    return f'<{tag}{named} data-main="0">{inner}</{tag}>'


def labelled_page(seed: int) -> str:
    """A made-up page whose article carries ``data-main="1"`` and whose rest does not."""
    rng = random.Random(seed)
    body = [f"<h1>{_words(rng, rng.randint(1, 10))}</h1>"] if rng.random() < 0.85 else []
    long = rng.random() < 0.85
    for _ in range(rng.randint(1, 12) if rng.random() < 0.75 else 1):
        pick, n = rng.random(), rng.randint(1, 90 if long else 12)
        if pick < 0.72:
            text = _words(rng, n)
            if rng.random() < 0.2:
                text = rng.choice(["<b>{}<br>", "<em>{}</em>", '{} <a href="/x">link text</a>.']).format(text)
            body.append(f"<p>{text}" + ("</p>" if rng.random() < 0.85 else ""))
        elif pick < 0.80:
            body.append(f"<h2>{_words(rng, rng.randint(1, 6))}</h2>")
        elif pick < 0.87:
            items = "".join(f"<li>{_words(rng, rng.randint(2, 25))}</li>" for _ in range(rng.randint(1, 6)))
            body.append(f"<ul>{items}</ul>")
        elif pick < 0.91:
            body.append(f"<blockquote>{_words(rng, n)}</blockquote>")
        elif pick < 0.94:
            body.append("<table><tr><td>" + _words(rng, 3) + "<td>" + _words(rng, 2) + "</table>")
        else:
            body.append(_rest(rng, rng.choice(["ad", "share", "form", "side", "notice"])))
    tag = rng.choice(["article", "article", "article", "main", "div", "section", "div"])
    mark = rng.choice(["article", "post-content", "entry", "story body", "content", "main", "text"])
    named = f' class="{mark}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    main = f'<{tag}{named} data-main="1">{"".join(body)}</{tag}>'
    if rng.random() < 0.4:
        outer = rng.choice(["div", "main", "section"])
        main = f'<{outer} class="{rng.choice(["wrapper", "container", "content", "page", "row"])}">{main}' + (
            _rest(rng, rng.choice(["side", "comments", "ad"])) if rng.random() < 0.5 else ""
        ) + f"</{outer}>"
    before = [_rest(rng, k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.45]
    after = [_rest(rng, k) for k in ("share", "side", "comments", "form", "ad", "footer") if rng.random() < 0.4]
    if rng.random() < 0.15:
        before = after = []
    inner = "".join([*before, main, *after])
    if rng.random() < 0.2:
        return inner
    return f"<html><head><title>t</title></head><body>{inner}</body></html>"


@lru_cache(maxsize=2)
def default_model(pages: int = TRAIN_PAGES, steps: int = STEPS) -> TreeModel:
    """The model fitted on made-up labelled pages; the same in every session."""
    return train_tree_model([parse(labelled_page(seed)) for seed in range(pages)], steps)


# --- Spark ---------------------------------------------------------------------------------------


def _extractor(model: TreeModel):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            pages = [parse(h or "") for h in batch.column("html").to_pylist()]
            content = model.marginals(pages) > 0.5
            texts, at = [], 0
            for page in pages:
                texts.append(text_of(page, content[at:at + len(page.tag)]))
                at += len(page.tag)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return extract


def extract_main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; the html is read whole."""
    return pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(
        _extractor(model or default_model()),
        "page_id bigint, url string, text string, n_chars bigint",
    )
