"""Main-text extraction from HTML by boosted trees over DOM nodes.

Each block element is described by its text (length, words, punctuation, link
share, subtree density), its attributes' tokens (by the log-odds learned for
each of them), its depth, its siblings and its ancestors, and scored by
gradient-boosted trees. A hierarchical decoding
then labels the tree at once: main, boilerplate, or a container left open, at
the least total cost under which boilerplate has no main descendants. Text
whose nearest block element is main is kept.

The pages carry no labels, so the trees are trained on pages made here by rule
from a fixed seed (``made_pages``): articles of varied markup, length and style
among menus, headers, sidebars, notices, adverts, forms, comments and footers,
with unclosed and unquoted tags, and bare articles of a few words.

Blocks end where block elements begin or end; white space within one becomes a
space; a line break counts as white space.

Cases: null and empty html give an empty text; html without tags is kept whole
if it reads as prose to the trees; repeated rows and null ids are rows of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import batch_of, map_rows
from .dom import Page, parse

TRAIN_PAGES = 700
#: Further training pages whose articles have ``LONG`` parts.
LONG_PAGES, LONG = 40, (64, 400)
#: And pages whose articles have ``SHORT`` parts of a few characters.
SHORT_PAGES, SHORT = 300, (1, 5)
#: Nodes with a token from which on it has a weight.
TOKEN_SUPPORT = 3
SEED = 20240607

# Tokens of class, id and role that made pages have around main text and around the rest.
FOR = tuple("article articlebody body content contents entry main post prose story text paragraph headline".split())
AGAINST = tuple(
    "ad ads advert advertisement banner bar breadcrumb breadcrumbs comment comments consent cookie copyright disqus feedback foot footer form header "
    "login masthead menu meta modal nav navbar navigation newsletter notice popup promo promoted recommend related reply rail search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
# Tags in the order of their feature number.
TAGS = (
    "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "blockquote", "pre", "figure", "figcaption", "table", "tr", "td",
    "th", "ul", "ol", "li", "dl", "dt", "dd", "header", "footer", "nav", "aside", "form", "fieldset", "address", "details", "summary", "dialog",
)
_TAG = {t: k for k, t in enumerate(TAGS)}
_INSIDE = ("article", "main", "nav", "header", "footer", "aside", "form")
_STOP = re.compile(r"[.!?;:,]")
#: Elements that may hold main text and boilerplate alike, and what leaving one open costs.
OPEN = frozenset("html body div section main article header".split())
OPEN_COST = 0.4


@dataclass
class Model:
    """Log-odds of main text by attribute token, and the trees."""

    tokens: dict[str, float]
    trees: gbt.Trees


def describe(page: Page, tokens: dict[str, float]) -> np.ndarray:
    """A row of features for each node, by the weights of tokens."""
    n = len(page.nodes)
    chars, words, stops, lines = (np.zeros(n) for _ in range(4))
    caps, marks = np.zeros(n), np.zeros(n)
    before, total = np.full(n, -1.0), 0.0
    for own, text in page.events:
        if text and (t := text.strip()):
            if before[own] < 0:
                before[own] = total
            chars[own] += len(t)
            words[own] += t.count(" ") + 1
            stops[own] += len(_STOP.findall(t))
            lines[own] += 1
            caps[own] += t[0].isupper()
            marks[own] += "©" in t or "·" in t
            total += len(t)
    linked = np.zeros(n)
    for own, size in page.linked:
        linked[own] += size
    tags, paragraphs, items, deep = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    own_chars = chars.copy()
    sums = (chars, words, stops, lines, caps, marks, tags, paragraphs, items, linked)
    for k in range(n - 1, 0, -1):
        node = page.nodes[k]
        paragraphs[k] += node.tag == "p"
        items[k] += node.tag in ("li", "td", "dt")
        for s in sums:
            s[node.parent] += s[k]
        deep[node.parent] = max(deep[node.parent], deep[k] + 1)
        if before[k] >= 0 and (before[node.parent] < 0 or before[k] < before[node.parent]):
            before[node.parent] = before[k]
    place, same, around = np.zeros(n), np.ones(n), np.zeros(n)  # among siblings: index, number of that tag, characters of both neighbours
    for node in page.nodes:
        family = node.children
        alike = Counter(page.nodes[s].tag for s in family)
        for i, s in enumerate(family):
            place[s], same[s] = i, alike[page.nodes[s].tag]
            around[s] = (chars[family[i - 1]] if i else 0) + (chars[family[i + 1]] if i + 1 < len(family) else 0)
    rows = np.zeros((n, 31))
    inside: list[tuple] = [()] * n
    good, bad = np.zeros(n), np.zeros(n)
    for k, node in enumerate(page.nodes):
        up = node.parent
        odds = [tokens.get(t, 0.0) for t in node.tokens]
        g, b = sum(x for x in odds if x > 0), -sum(x for x in odds if x < 0)
        good[k], bad[k] = g + (0.7 * good[up] if k else 0), b + (0.7 * bad[up] if k else 0)
        inside[k] = tuple(i or node.tag == t for i, t in zip(inside[up] if k else (False,) * len(_INSIDE), _INSIDE, strict=True))
        family = len(page.nodes[up].children) if k else 1
        w = max(words[k], 1)
        rows[k] = (
            _TAG.get(node.tag, len(TAGS)), node.depth, math.log1p(chars[k]), math.log1p(words[k]), stops[k] / w, chars[k] / w, chars[k] / tags[k],
            math.log1p(own_chars[k]), lines[k], caps[k] / max(lines[k], 1), marks[k], math.log1p(paragraphs[k]), items[k] / tags[k], deep[k],
            chars[k] / max(total, 1), max(before[k], 0) / max(total, 1), family, place[k] / family, same[k], math.log1p(around[k]), g, b,
            good[k], bad[k], min(1.0, linked[k] / max(chars[k], 1)), *inside[k][:6],
        )
    return rows


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Whether each node is main: the cheapest labelling in which boilerplate has no main below it."""
    n = len(page.nodes)
    main, other = np.logaddexp(0, -odds), np.logaddexp(0, odds)
    open_ = np.where([bool(v.children) and v.tag in OPEN for v in page.nodes], OPEN_COST, np.inf)
    under_main, under_other = np.zeros(n), np.zeros(n)  # least cost of the subtree by its parent's label
    under_open = np.zeros(n)
    below_main, below_other, below_open = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n - 1, -1, -1):
        as_main, as_other, as_open = main[k] + below_main[k], other[k] + below_other[k], open_[k] + below_open[k]
        under_main[k], under_other[k] = min(as_main, as_other), as_other
        under_open[k] = min(as_main, as_other, as_open)
        if k:
            up = page.nodes[k].parent
            below_main[up] += under_main[k]
            below_other[up] += under_other[k]
            below_open[up] += under_open[k]
    label = np.zeros(n, dtype=np.int8)  # 0 boilerplate, 1 main, 2 open
    for k, node in enumerate(page.nodes):
        above = 2 if k == 0 else label[node.parent]
        costs = [other[k] + below_other[k], main[k] + below_main[k] if above else np.inf, open_[k] + below_open[k] if above == 2 else np.inf]
        label[k] = int(np.argmin(costs))
    return (label == 1) | ((label == 2) & (odds > 0))


def blocks(page: Page, kept: np.ndarray) -> list[str]:
    """The kept text in page order, one string for each block."""
    out, now = [], []
    for own, text in page.events:
        if text is None:
            if now:
                out.append(" ".join("".join(now).split()))
                now = []
        elif kept[own]:
            now.append(text)
    if now:
        out.append(" ".join("".join(now).split()))
    return [b for b in out if b]


class Extractor:
    """The trained trees at work."""

    def __init__(self, model: Model):
        self.model = model

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s or "") for s in sources]
        rows = [describe(p, self.model.tokens) for p in pages]
        odds = self.model.trees.decide(np.concatenate(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for page, own in zip(pages, rows, strict=True):
            out.append("\n\n".join(blocks(page, decode(page, odds[at : at + len(own)]))))
            at += len(own)
        return out


def made_pages(count: int, seed: int = SEED, size: tuple[int, int] = (1, 12), short: bool = False) -> list[tuple[str, list[str]]]:
    """Pages made by rule, and the blocks of their main text; ``size`` bounds the parts of an article, which may be of a few characters."""
    rng = random.Random(seed)
    pick = lambda *x: x[int(rng.random() * len(x))]
    syllables = ["th", "er", "an", "in", "re", "on", "st", "ou", "le", "de", "que", "ein", "ung", "ció", "os", "ma", "ti", "ble", "ré", "ü"]

    def word() -> str:
        return "".join(pick(*syllables) for _ in range(rng.randrange(1, 4)))

    style = "plain"

    def sentence(low: int = 3, high: int = 18) -> str:
        """In the style of the article at hand: not all main text reads well."""
        if style == "short":
            return tiny()
        own = [word() for _ in range(rng.randrange(low, high))]
        if style == "bars":
            return " | ".join(own) + pick("", ".", " |")
        if style == "low":
            return " ".join(own) + pick("", ".", ",")
        if style == "loud":
            return " ".join(w.upper() + "!!" for w in own)
        if style == "noise":
            return " ".join(w + pick("***", "%%%", "###", "&amp;") for w in own).replace("&amp;", "+")
        if style == "same":
            return " ".join([pick(own[0], f"{rng.randrange(999)}.{rng.randrange(999)}")] * len(own))
        return " ".join(own).capitalize() + pick(".", ".", ".", "!", "?")

    def tiny() -> str:
        return pick(word(), word()[:1], word().capitalize() + ".", f"{word()} {word()}", str(rng.randrange(100)))

    def prose(most: int = 7) -> str:
        if style == "short" or rng.random() < 0.03:
            return tiny()
        return " ".join(sentence(1) for _ in range(rng.randrange(1, most)))

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{pick(word(), word().capitalize())}{pick("", "", ",", ".")}</a></{tag}>' for _ in range(k))

    def few() -> int:
        return rng.randrange(2, 9)

    def boilerplate(where: str) -> str:
        short = pick(sentence(2, 12), prose(3))
        if rng.random() < 0.25:
            inner = pick(short, f"<p>{short}</p>", f"<ul>{links(few())}</ul>", f"<h3>{word()}</h3><p>{short}</p>")
            return f'<{(t := pick("div", "section", "aside"))} {pick("class", "id")}="{pick(*AGAINST)}">{inner}</{t}>'
        if where == "top":
            return pick(
                f"<nav><ul>{links(few())}</ul></nav>", f'<header><div class="logo">{word()}</div><nav>{links(few(), "span")}</nav></header>',
                f'<div class="menu"><ul>{links(few())}</ul></div>', f'<div id="cookie-notice"><p>{short}</p><button>ok</button></div>',
                f'<div class="ad">{short}</div>', f'<header class="site-header"><h1>{word()}</h1><p>{sentence(2, 6)}</p></header>',
                f'<ul class="breadcrumb">{links(3)}</ul>', f"<nav>{links(few(), 'div')}</nav>", f'<form role="search"><label>{word()}</label><input name=q></form>',
            )
        if where == "middle":
            return pick(
                f'<div class="ad">{short}</div>', f"<aside>{short}</aside>", f'<div class="share">{links(3, "span")}</div>', f'<aside class="related"><h3>{word()}</h3><ul>{links(few())}</ul></aside>',
                f'<form><p>{short}</p><input type=text></form>', f'<div class="promo banner"><p>{short}</p></div>', f"<!-- ad {few()} --><script>var x='<p>';</script>",
            )
        comments = "".join(f'<{t} class="comment"><b>{word()}</b><p>{prose(4)}</p></{t}>' for t in [pick("li", "div", "article")] * few())
        return pick(
            f"<footer>&copy; {word()}.example.com &middot; {short}</footer>", f"<footer><p>{short}</p><ul>{links(few())}</ul></footer>",
            f'<div id="footer"><p>&copy; {short}</p></div>', f'<section id="comments"><h2>{word()}</h2>{comments}</section>', f'<div class="comments"><ol>{comments}</ol></div>',
            f'<aside class="sidebar"><h3>{word()}</h3><ul>{links(few())}</ul><p>{short}</p></aside>', f'<div class="newsletter"><form><p>{short}</p><input></form></div>',
            f'<div class="widget related"><h4>{word()}</h4>{links(few(), "p")}</div>', f'<div class="ad">{short}</div>',
        )

    def article() -> tuple[str, list[str]]:
        parts, main = [], []

        def add(markup: str, *texts: str) -> None:
            parts.append(markup)
            main.extend(texts)

        if rng.random() < 0.85:
            title = sentence(2, 12)
            add(pick("<h1>{}</h1>", '<h1 class="title">{}</h1>', "<header><h1>{}</h1></header>", "<h2>{}</h2>").format(title), title)
        for _ in range(rng.randrange(*size)):
            kind, t = rng.random(), prose()
            if kind < 0.6:
                add(f"<p>{t}</p>", t)
            elif kind < 0.68:
                add(f"<p><b>{t}<br>", t)
            elif kind < 0.74:
                add(f"<p>{t}", t)
            elif kind < 0.8:
                h = sentence(1, 6)
                add(f"<h2>{h}</h2><p>{t}</p>", h, t)
            elif kind < 0.85:
                own = [sentence(1, 9) for _ in range(few())]
                add("<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>", *own)
            elif kind < 0.89:
                add(f"<blockquote><p>{t}</p></blockquote>", t)
            elif kind < 0.92:
                add(f"<figure><img src=x><figcaption>{t}</figcaption></figure>", t)
            elif kind < 0.94:
                own = [sentence(1, 4) for _ in range(4)]
                add("<table><tr>" + "".join(f"<td>{x}</td>" for x in own) + "</tr></table>", *own)
            elif kind < 0.96:
                add(f"<div>{t}</div>", t)
            else:
                add(boilerplate("middle"))
        return "".join(parts), main

    out = []
    for _ in range(count):
        style = "short" if short else pick("plain", "plain", "plain", "bars", "low", "loud", "noise", "same")
        inner, main = article()
        style = "plain"
        shell = pick(
            "<article>{}</article>", "<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>',
            f'<div class="{pick(*FOR)}">{{}}</div>', f'<section id="{pick(*FOR)}">{{}}</section>', '<div id="main"><div class="post">{}</div></div>', '<section class="story"><div>{}</div></section>', '<div class="entry-content" itemprop="articleBody">{}</div>', "<div>{}</div>",
        )
        body = "".join(boilerplate("top") for _ in range(rng.randrange(0, 4))) + shell.replace("{}", inner) + "".join(boilerplate("end") for _ in range(rng.randrange(0, 4)))
        if short and rng.random() < 0.5:
            out.append((pick("{}", "<body>{}</body>", "<html><body>{}</body></html>").format(shell.replace("{}", inner)), main))
            continue
        if rng.random() < 0.3:
            body = f"<div class={pick('wrap', 'page', 'container')}>{body}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>", main))
    return out


@lru_cache(maxsize=2)
def trained(count: int = TRAIN_PAGES, seed: int = SEED) -> Model:
    """Tokens' weights and trees, trained on the made pages; a node is main if most of its text is."""
    made = made_pages(count, seed) + made_pages(LONG_PAGES, seed + 1, LONG) + made_pages(SHORT_PAGES, seed + 2, SHORT, short=True)
    pages, labels, helds = [], [], []
    seen: tuple[Counter, Counter] = Counter(), Counter()  # tokens by label
    for source, main in made:
        page = parse(source)
        n = len(page.nodes)
        yes, all_ = np.zeros(n), np.zeros(n)
        left = Counter(main)
        for own, text in page.events:
            if text and (t := " ".join(text.split())):
                hit = left[t] > 0
                left[t] -= hit
                all_[own] += len(t)
                yes[own] += hit * len(t)
        for k in range(n - 1, 0, -1):
            all_[page.nodes[k].parent] += all_[k]
            yes[page.nodes[k].parent] += yes[k]
        label = yes > 0.5 * all_
        for k in np.flatnonzero(all_):
            seen[int(label[k])].update(page.nodes[k].tokens)
        pages.append(page)
        labels.append(label)
        helds.append(all_ > 0)
    other, main_ = seen
    tokens = {t: math.log((main_[t] + 0.5) / (other[t] + 0.5)) for t in sorted({*other, *main_}) if other[t] + main_[t] >= TOKEN_SUPPORT}
    rows = np.concatenate([describe(p, tokens)[h] for p, h in zip(pages, helds, strict=True)])
    return Model(tokens, gbt.fit(rows, np.concatenate([x[h] for x, h in zip(labels, helds, strict=True)]).astype(float)))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def make():
        extractor = Extractor(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = extractor.texts(batch.column(2).to_pylist())
            sizes = pa.array(list(map(len, texts)), pa.int64())
            return batch_of(page_id=batch.column(0), url=batch.column(1), text=pa.array(texts, pa.string()), n_chars=sizes)

        return step

    return map_rows(pages.select(F.col("page_id").cast("long"), "url", "html"), make, EXTRACTED)
