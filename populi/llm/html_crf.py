"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is the sequence of its leaf blocks; each block has features of its ancestors (tags, names in class, id and role)
and of its text (length, links, punctuation, place in the page). The field has weights per feature and label and for the
step between neighbours, inside one container and across; it is trained by maximum likelihood on labelled pages and
decoded by Viterbi. Labels come from the pages themselves, as most mark their article: blocks inside article or main and
outside any boilerplate element are main text. Every labelled page is also laid out anew, its article and other blocks put
into containers drawn from `LAYOUTS`, so that the field knows layouts that the table does not show. Pages without an
article of their own teach through the others' layouts only.

Defined results: a null or empty page, or one without main text, gives an empty text; character references are decoded,
white space inside a block becomes one space, blocks are joined by one space; nothing is cut. Repeated rows give the same
result each; further columns are ignored; an empty table gives an empty result. The fit reads at most `sample` pages
(smallest hashes of the id first) of at most `LONGEST` characters; every page is decoded whole."""

from __future__ import annotations

import html
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from populi.llm.common import per_batch, text_or_empty
from populi.llm.html_blocks import Block, blocks

SAMPLE, LONGEST = 240, 60_000
LAYOUTS = 3  # new layouts of each labelled page
EPOCHS, RATE, DECAY = 8, 0.1, 1e-3
HASHED = 4096  # places of the features

# Containers of main text and of boilerplate as pages write them, used to lay pages out anew.
MAIN = ['<article>', '<main>', '<div class="content">', '<div class="post-content">', '<div class="entry-content">', '<section class="story">',
        '<div id="article-body">', '<div class="article-text">', '<div role="main">', '<div class="post">', '<div id="main-content">', '<article class="post">']
MENU = ['<nav>', '<div class="menu">', '<ul class="navigation">', '<div id="navbar">', '<div class="breadcrumbs">', '<div role="navigation">', '<div class="topnav">']
HEADER = ['<header>', '<div class="header">', '<div id="masthead">', '<div class="site-header">', '<header class="banner">']
FOOTER = ['<footer>', '<div class="footer">', '<div id="site-footer">', '<div class="copyright">', '<div role="contentinfo">', '<footer class="legal">']
SIDE = ['<aside>', '<div class="sidebar">', '<div class="widget">', '<div class="related">', '<div id="side">', '<aside class="recommended">', '<div class="share social">', '<div class="tags">']
NOTICE = ['<div class="cookie-notice">', '<div class="consent">', '<div class="gdpr banner">', '<div class="notice">', '<div role="alert">', '<div class="popup modal">', '<div class="newsletter subscribe">', '<div class="disclaimer">']
ADVERT = ['<div class="ad">', '<div class="advert">', '<div class="ads">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<aside class="ad">', '<div id="banner-ad">']
FORM = ['<form>', '<form class="search">', '<form id="login">', '<div class="signup form">']
COMMENT = ['<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="comment-list">', '<div class="replies">', '<div class="discussion respond">', '<section id="reader-comments">']


def _names(containers: list[list[str]]) -> frozenset[str]:
    out: set[str] = set()
    for group in containers:
        for opening in group:
            out |= blocks(opening + "x")[0].above
    return frozenset(out)


BOILERPLATE = _names([MENU, FOOTER, SIDE, NOTICE, ADVERT, FORM, COMMENT]) - {"t:div", "t:section", "t:ul", "t:ol"}
ARTICLE = frozenset({"t:article", "t:main", "n:main"})


def features(page: list[Block]) -> list[list[int]]:
    """Places of the active features of each block."""
    out, n = [], len(page)
    for i, b in enumerate(page):
        length = len(b.text)
        words = b.text.count(" ") + 1
        active = [*b.above, "tag:" + b.tag, "bias",
                  f"len:{min(length.bit_length(), 11)}", f"words:{min(words.bit_length(), 8)}",
                  f"links:{0 if not b.links else 1 + min(3, 3 * b.links // max(length, 1))}",
                  f"end:{'.' if b.text[-1] in '.!?…\"”»' else 'x'}", f"stops:{min(b.text.count('. ') + b.text.count(', '), 4)}",
                  f"place:{10 * i // n}", "copy:" + str("©" in b.text or "rights reserved" in b.text.lower()),
                  f"bar:{'|' in b.text or '»' in b.text or '›' in b.text}"]
        out.append([_place(a) for a in active])
    return out


_PLACES: dict[str, int] = {}  # a cache of hashes


def _place(name: str) -> int:
    at = _PLACES.get(name)
    if at is None:
        if len(_PLACES) > 200_000:
            _PLACES.clear()
        h = 2166136261
        for byte in name.encode("utf-8", "surrogatepass"):  # FNV-1a, alike in every process
            h = (h ^ byte) * 16777619 & 0xFFFFFFFF
        at = _PLACES[name] = h % HASHED
    return at


def steps(page: list[Block]) -> list[int]:
    """For each block after the first: 1 inside the container of the one before, else 0."""
    return [int(a.container is b.container or a.container == b.container) for a, b in zip(page, page[1:])]


class Field:
    """emit: HASHED scores of label 1 against 0; move: [across or inside][label before][label]; first: of the first block."""

    def __init__(self):
        self.emit, self.move, self.first = np.zeros(HASHED), np.zeros((2, 2, 2)), np.zeros(2)

    def _scores(self, active: list[list[int]]) -> np.ndarray:
        flat = self.emit[np.concatenate([np.array(a) for a in active])]
        starts = np.cumsum([0, *map(len, active[:-1])])
        return np.add.reduceat(flat, starts)

    def decode(self, page: list[Block]) -> list[int]:
        """Most likely labels; ties go to 0."""
        if not page:
            return []
        emit = self._scores(features(page)).tolist()
        move = self.move.tolist()
        zero, one = self.first[0], self.first[1] + emit[0]
        back = []
        for s, e in zip(steps(page), emit[1:]):
            (m00, m01), (m10, m11) = move[s]
            from0, from1 = int(one + m10 > zero + m00), int(one + m11 > zero + m01)
            zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11) + e
            back.append((from0, from1))
        labels = [int(one > zero)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def gradient(self, active: list[list[int]], step: list[int], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log likelihood: of each block's score, of the moves, of the first label."""
        emit, n = self._scores(active), len(active)
        e = np.column_stack([np.zeros(n), emit])
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = self.first + e[0]
        for i in range(1, n):
            alpha[i] = np.logaddexp(alpha[i - 1, 0] + self.move[step[i - 1], 0], alpha[i - 1, 1] + self.move[step[i - 1], 1]) + e[i]
        for i in range(n - 2, -1, -1):
            after = beta[i + 1] + e[i + 1]
            beta[i] = np.logaddexp(self.move[step[i], :, 0] + after[0], self.move[step[i], :, 1] + after[1])
        total = np.logaddexp(*alpha[-1])
        p = np.exp(alpha + beta - total)
        move = np.zeros((2, 2, 2))
        for i in range(1, n):
            s = step[i - 1]
            move[s] -= np.exp(alpha[i - 1][:, None] + self.move[s] + (e[i] + beta[i])[None, :] - total)
            move[s, labels[i - 1], labels[i]] += 1
        first = -p[0]
        first[labels[0]] += 1
        return np.array(labels) - p[:, 1], move, first

    def fit(self, pages: list[tuple[list[Block], list[int]]], seed: int = 5) -> None:
        """AdaGrad over pages in a seeded order, with shrinking."""
        held = [(features(p), steps(p), y) for p, y in pages if p]
        g_emit, g_move, g_first = np.full(HASHED, 1e-2), np.full((2, 2, 2), 1e-2), np.full(2, 1e-2)
        order = list(range(len(held)))
        rng = random.Random(seed)
        for _ in range(EPOCHS):
            rng.shuffle(order)
            for k in order:
                active, step, y = held[k]
                d, move, first = self.gradient(active, step, y)
                at = np.concatenate([np.array(a) for a in active])
                grad = np.zeros(HASHED)
                np.add.at(grad, at, np.repeat(d, [len(a) for a in active]))
                used = np.unique(at)
                grad = grad[used] / len(y) - DECAY * self.emit[used]
                g_emit[used] += grad ** 2
                self.emit[used] += RATE * grad / np.sqrt(g_emit[used])
                for w, g, acc in ((self.move, move / len(y) - DECAY * self.move, g_move), (self.first, first / len(y) - DECAY * self.first, g_first)):
                    acc += g ** 2
                    w += RATE * g / np.sqrt(acc)


def own_labels(page: list[Block]) -> list[int] | None:
    """Labels from a page's own markup; None if it marks no article."""
    inside = [bool(b.above & ARTICLE) for b in page]
    return [int(a and not b.above & BOILERPLATE) for a, b in zip(inside, page)] if any(inside) else None


def laid_out(page: list[Block], labels: list[int], others: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The page's main text in a new layout, with boilerplate of the other texts around and sometimes inside it."""
    def ending(opening: str) -> str:
        return f"</{opening[1:].split(' ')[0].rstrip('>')}>"

    def some(n: int) -> list[str]:
        return [html.escape(t) for t in (rng.choice(others) for _ in range(n))]

    def part(kind: list[str]) -> str:
        opening = rng.choice(kind)
        short = [" ".join(t.split()[:rng.randint(1, 12)]) for t in some(rng.randint(1, 6))]
        if kind is MENU or kind is SIDE and rng.random() < 0.5:
            body = "<ul>" + "".join(f'<li><a href="#">{t}</a></li>' for t in short) + "</ul>"
        elif kind is COMMENT:
            body = "".join(f"<{tag}>{t}</{tag}>" for t in some(rng.randint(1, 4)) for tag in [rng.choice(["p", "div", "li"])])
        elif kind is FORM:
            body = "".join(f"<label>{t}</label><input>" for t in short[:3]) + "<button>" + short[0] + "</button>"
        else:
            text = rng.choice([short[0], *some(1)])
            body = rng.choice([text, f"<p>{text}</p>", f'<p>{text} <a href="#">{short[-1]}</a></p>'])
            if kind is FOOTER and rng.random() < 0.6:
                body = rng.choice(["&copy; ", "© 2020 "]) + body
        return opening + body + ending(opening)

    before = [part(k) for k in (NOTICE, HEADER, MENU, ADVERT, FORM) if rng.random() < 0.5]
    after = [part(k) for k in (SIDE, COMMENT, ADVERT, FORM, NOTICE) if rng.random() < 0.45] + [part(FOOTER)] * (rng.random() < 0.9)
    rng.shuffle(before)
    opening = rng.choice(MAIN)
    body = []
    for b, y in zip(page, labels):
        if y:
            tag = b.tag if b.tag in ("p", "h1", "h2", "h3", "li", "blockquote") else "p"
            body.append(f"<{tag}>{html.escape(b.text)}</{tag}>")
            if rng.random() < 0.04:
                body.append(part(rng.choice([ADVERT, SIDE, NOTICE])))
    if rng.random() < 0.15:
        body.append(part(COMMENT))
    source = "<body>" + "".join(before) + rng.choice(["", '<div class="wrapper">', '<div id="page">']) + opening + "".join(body) + ending(opening) + "".join(after)
    found = blocks(source)
    main = blocks(opening + "x")[0].above
    return found, [int(main <= b.above and not b.above & (BOILERPLATE - main)) for b in found]


def train(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS, seed: int = 3) -> Field:
    """Fit on a bounded sample of pages and their new layouts."""
    source = (pages.select(F.col("page_id").cast("long").alias("page_id"), text_or_empty("html").alias("html"))
              .where((F.col("html") != "") & (F.length("html") <= LONGEST)).withColumn("k", F.xxhash64("page_id", "html")))
    keys = source.select("k").distinct().orderBy("k").limit(sample)  # `sample` numbers; their pages are fetched by a join
    chosen = source.join(F.broadcast(keys), "k", "left_semi").dropDuplicates(["k"]).orderBy("k").toPandas()
    field, rng, known = Field(), random.Random(seed), []
    for source in chosen["html"]:
        page = blocks(source)
        labels = own_labels(page)
        if labels and any(labels):
            known.append((page, labels))
    others = [b.text for page, labels in known for b, y in zip(page, labels) if len(b.text) < 600] or ["Home", "About us", "All rights reserved."]
    lines = known + [laid_out(page[:], labels, others, rng) for page, labels in known for _ in range(layouts)]
    field.fit([(p, y) for p, y in lines if p])
    return field


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, field.decode(found)) if y)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text of every row."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([main_text(p, field) for p in batch.column("html").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
            .mapInArrow(per_batch(one), "page_id long, url string, text string"))


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
