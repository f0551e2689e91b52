"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. Each is described by its tag path (hashed names of its elements and their classes)
and by hashed words, and a bidirectional LSTM, written in numpy, reads the sequence in both directions, so that every
block is judged in the light of the whole page. Blocks judged to be article text are joined.

The labeller is trained where it is used: on a bounded sample of the pages, whose semantic elements label their blocks,
and on the same sentences set into layouts that name things differently. Words and path parts are dropped at random in
training, so that no single name decides. The sample's bounds: TRAIN_PAGES pages of up to TRAIN_CHARS characters, those
of the smallest hash; of each, TRAIN_BLOCKS blocks, half of them from either end; and for the layouts the sentences of
its first SENTENCE_BLOCKS blocks. They bound the training alone: extraction reads every block of every page.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html_blocks import SLOTS, Block, blocks_of, slot

TRAIN_PAGES, TRAIN_CHARS, TRAIN_BLOCKS, SENTENCE_BLOCKS, STEPS, BATCH = 120, 200_000, 40, 200, 420, 24
PATH, WORDS, NUMBERS, HIDDEN = SLOTS, 48, 5, 20
INPUT = PATH + WORDS + NUMBERS
#: Blocks (rows times the longest page's blocks) that are padded and read at once.
PADDED = 60_000

#: Names by which pages mark what surrounds an article, by kind, and the article itself.
AROUND = {
    "menu": ["<nav>{}</nav>", '<div class="menu">{}</div>', '<ul class="navbar">{}</ul>', '<div id="navigation">{}</div>', '<div class="breadcrumb">{}</div>', '<div role="navigation">{}</div>'],
    "header": ["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div class="site-header">{}</div>', '<div class="topbar">{}</div>', '<div role="banner">{}</div>'],
    "footer": ["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="site-footer">{}</div>', '<div class="copyright">{}</div>', '<div role="contentinfo">{}</div>'],
    "sidebar": ["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar"><section>{}</section></div>', '<div class="widget">{}</div>', '<div class="related">{}</div>', '<div role="complementary">{}</div>'],
    "notice": ['<div class="cookie-banner">{}</div>', '<div class="cookie notice">{}</div>', '<div id="consent">{}</div>', '<div class="popup">{}</div>', '<div class="newsletter">{}</div>', '<div role="alert">{}</div>', "<dialog>{}</dialog>"],
    "advert": ['<div class="ad">{}</div>', '<div class="ads">{}</div>', '<div class="advert">{}</div>', '<div class="advertisement">{}</div>', '<div class="sponsored">{}</div>', '<div class="promo">{}</div>'],
    "form": ["<form>{}</form>", '<form class="search">{}</form>', '<form id="login"><fieldset>{}</fieldset></form>', "<form><select><option>{}</select></form>"],
    "comments": ['<div class="comments">{}</div>', '<section id="comments">{}</section>', '<div class="comment"><div class="comment-body">{}</div></div>', '<ol class="comment-list"><li class="comment">{}</li></ol>', '<div id="disqus-thread">{}</div>', '<div class="replies">{}</div>'],
}
BODY = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content"><div class="post">{}</div></div>', '<div class="article-body">{}</div>', '<section class="entry-content">{}</section>', '<div role="main">{}</div>', '<div class="story"><div class="text">{}</div></div>', "<div>{}</div>", '<div id="main">{}</div>']
BODY += ['<div class="post-body">{}</div>', '<div class="blog-post">{}</div>', "<main><section>{}</section></main>", '<section class="single"><div class="entry">{}</div></section>', '<article class="entry"><div class="body">{}</div></article>', "<section><div><div>{}</div></div></section>"]
#: Names that say nothing of what they hold.
NEUTRAL = "wrap wrapper container page inner outer row col site grid box layout block group flex clearfix m x1".split()
OUTSIDE = frozenset("nav footer aside form dialog menu select option head".split())
OUTSIDE_NAMES = frozenset("ad ads advert advertisement sponsored promo nav menu navbar navigation breadcrumb header masthead topbar banner header footer copyright contentinfo sidebar widget related complementary cookie consent popup newsletter notice alert comment comments disqus replies".split())
#: Words for layouts when the table has too few of its own.
FILLER = "the of and to in is that for it was with as on are this be at by from have an or which one had not but what all were when we there can".split()


class Slots(dict):
    """Hash slots of names, kept for names met before; emptied when it grows large."""

    def __init__(self, size: int, most: int = 500_000) -> None:
        super().__init__()
        self.size, self.most = size, most

    def __missing__(self, name: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[name] = out = slot(name, self.size)
        return out


def features(blocks: list[Block], paths: dict, words: Slots) -> np.ndarray:
    """One row per block: path parts, words' shares, and five numbers. paths caches the path part."""
    out = np.zeros((len(blocks), INPUT), np.float32)
    for row, b in zip(out, blocks, strict=True):
        bits = b.path.slots | (1 << slot(f"/{b.path.tag}", PATH) if b.path.depth else 0)
        if (own := paths.get(bits)) is None:
            if len(paths) > 50_000:
                paths.clear()
            own = paths[bits] = np.flatnonzero([bits >> k & 1 for k in range(PATH)])
        row[own] = 1
        tokens = b.text.split()
        counts = np.bincount([words[t] for t in tokens], minlength=WORDS)
        row[PATH : PATH + WORDS] = np.minimum(0.5, np.sqrt(counts / len(tokens)))
        n = len(b.text)
        row[PATH + WORDS :] = min(1.0, b.linked / n), np.log1p(n) / 8, np.log1p(len(tokens)) / 6, b.path.depth / 12, b.text[-1:] in ".!?"
    return out


def semantic_label(b: Block) -> bool:
    """What the page's own elements say: inside an article or main, and in nothing that surrounds or follows one."""
    tags = [t for t, _ in b.path]
    inside = "article" in tags or "main" in tags
    return inside and not OUTSIDE & set(tags) and not OUTSIDE_NAMES & {n for _, ns in b.path for n in ns}


def layout(sentences: list[str], rng: random.Random) -> str:
    """A page made of the given sentences in a random layout."""
    marked: list[str] = []

    def pick(k: int) -> str:
        """Up to k words of a sentence; now and then one word over and over."""
        words = rng.choice(sentences).split()
        return " ".join([rng.choice(words)] * k if rng.random() < 0.06 else words[:k])

    def around(kind: str) -> None:
        shape = rng.choice(AROUND[kind])
        n = rng.randint(1, 5)
        if kind == "menu" or kind in ("footer", "sidebar", "header") and rng.random() < 0.5:
            inner = "<ul>" + "".join(f'<li><a href="/">{pick(3)}</a></li>' for _ in range(n)) + "</ul>"
        elif kind == "form":
            n, inner = 1, pick(4)
        elif kind == "comments":
            inner = "".join(f"<p>{pick(rng.choice((6, 20, 60)))}</p>" for _ in range(n))
        elif rng.random() < 0.5:
            n, inner = 1, pick(rng.choice((3, 8, 20)))
        else:
            inner = "".join(f"<p>{pick(rng.choice((3, 8, 20)))}</p>" for _ in range(n))
        marked.append(shape.format(inner))

    before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < 0.5]
    after = [k for k in ("sidebar", "comments", "advert", "form", "notice", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    for kind in before:
        around(kind)
    shape, inside = rng.choice(BODY), []
    opening, closing = shape.split("{}")
    marked.append(opening)
    if rng.random() < 0.8:
        head = f"<h{rng.choice('112')}>{pick(9)}</h1>"
        inside.append(f"<header>{head}</header>" if "article" in shape and rng.random() < 0.2 else head)
    wrapped = rng.random() < 0.3
    for _ in range(rng.choice((1, 2, 5, 10, 18))):
        text = pick(rng.choice((3, 12, 40, 100)))
        inside.append(rng.choice([f"<p>{text}</p>"] * 6 + [f"<p><b>{text}<br>", f"<h2>{text}</h2>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li></ul>", f"<div>{text}</div>", f"<pre>{text}</pre>"]))
    for x in inside:
        marked.append(rng.choice(("<div>{}</div>", "<section>{}</section>", f'<div class="{rng.choice(NEUTRAL)}">{{}}</div>')).format(x) if wrapped and rng.random() < 0.6 else x)
        if rng.random() < 0.04:
            around(rng.choice(("advert", "sidebar", "form", "notice")))
    if rng.random() < 0.2:
        around("comments")
    marked.append(closing)
    for kind in after:
        around(kind)
    while rng.random() < 0.4:  # boxes around a stretch of the page's parts, the article among them
        box = f'<div class="{" ".join(rng.sample(NEUTRAL, rng.randint(0, 2)))}">'
        low, high = rng.randint(0, marked.index(opening)), rng.randint(len(marked) - 1 - marked[::-1].index(closing), len(marked) - 1)
        marked[low : high + 1] = [box, *marked[low : high + 1], "</div>"]
    return "<html><body>" + "".join(marked) + "</body></html>"


def sentences_of(pages: list[str]) -> list[str]:
    out = [s for page in pages for b in blocks_of(page)[:SENTENCE_BLOCKS] for s in b.text.split("\n") if s]
    return out if len(out) >= 50 else out + [" ".join(FILLER[(i * 7 + k) % len(FILLER)] for k in range(3 + i % 60)) for i in range(200)]


def training_set(pages: list[str], seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Sample pages labelled by their elements, and made-up layouts labelled by how they were made."""
    rng = random.Random(seed)
    out = []
    for page in pages:
        blocks = blocks_of(page)
        if len(blocks) > TRAIN_BLOCKS:  # a stretch from either end, so that both the surroundings and the article show
            half = TRAIN_BLOCKS // 2
            blocks = blocks[:half] + blocks[-half:]
        labels = np.array([semantic_label(b) for b in blocks], np.float32)
        if labels.any():
            out.append((blocks, labels))
    sentences = [s.replace("<", " ").replace("&", " ") for s in sentences_of(pages)]
    for _ in range(len(pages) + 400):
        blocks = made_up(sentences, rng)
        if blocks:
            out.append(([b for b, _ in blocks], np.array([x for _, x in blocks], np.float32)))
    return out


def made_up(sentences: list[str], rng: random.Random) -> list[tuple[Block, bool]]:
    """Blocks of a made-up page and whether they are its article; the layouts' own names tell."""
    out = []
    for b in blocks_of(layout(sentences, rng)):
        names = {n for _, ns in b.path for n in ns}
        tags = {t for t, _ in b.path}
        header = "header" in tags and "article" not in tags
        label = not (OUTSIDE & tags or OUTSIDE_NAMES & names or header)
        out.append((b, label))
    return out[:TRAIN_BLOCKS]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # gates: input, forget, output, candidate
    w["o"] = rng.normal(0, HIDDEN**-0.5, (2 * HIDDEN,))
    w["q"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def run_cells(x: np.ndarray, w: dict, d: str, trace: list | None = None) -> np.ndarray:
    """Hidden states (time, page, HIDDEN) of one direction over inputs (time, page, INPUT)."""
    steps, pages, _ = x.shape
    driven = x.reshape(-1, x.shape[2]) @ w[f"x{d}"] + w[f"c{d}"]
    driven = driven.reshape(steps, pages, -1)
    h = c = np.zeros((pages, HIDDEN), np.float32)
    out = np.empty((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        z = driven[t] + h @ w[f"h{d}"]
        gates, new = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, c = c, f * c + i * new
        squashed = np.tanh(c)
        if trace is not None:
            trace.append((h, before, i, f, o, new, squashed))
        out[t] = h = o * squashed
    return out


def backed(x: np.ndarray, trace: list, dh_all: np.ndarray, w: dict, d: str, grad: dict) -> None:
    """Add the gradients of one direction's weights, given those of its hidden states."""
    steps, pages, _ = x.shape
    dz_all = np.empty((steps, pages, 4 * HIDDEN), np.float32)
    dh = dc = np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, new, squashed = trace[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz_all[t] = dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
        grad[f"h{d}"] += h.T @ dz
        dh, dc = dz @ w[f"h{d}"].T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grad[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
    grad[f"c{d}"] += flat.sum(axis=0)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (time, page, INPUT), which are real (time, page), and the time order that turns each page round."""
    lengths = np.array([len(r) for r in rows])
    steps = int(lengths.max())
    x = np.zeros((steps, len(rows), INPUT), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k] = r
    t = np.arange(steps)[:, None]
    return x, t < lengths, np.where(t < lengths, lengths - 1 - t, t)


def turned(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(x, order[:, :, None], axis=0)


def judge(rows: list[np.ndarray], w: dict) -> list[np.ndarray]:
    """For each page, the log-odds of each block being article text."""
    x, _, order = padded(rows)
    forth, back = run_cells(x, w, "f"), turned(run_cells(turned(x, order), w, "b"), order)
    score = forth @ w["o"][:HIDDEN] + back @ w["o"][HIDDEN:] + w["q"]
    return [score[: len(r), k] for k, r in enumerate(rows)]


def train(pages: list[str], seed: int = 7, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights fitted by Adam on the training set; the same pages give the same weights."""
    rng = np.random.default_rng(seed)
    paths, words = {}, Slots(WORDS)
    data = [(features(blocks, paths, words), labels) for blocks, labels in training_set(pages, seed)]
    w = start_weights(rng)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = rng.integers(len(data), size=BATCH)
        x, real, order = padded([data[k][0] for k in chosen])
        y = np.zeros(real.shape, np.float32)
        for k, c in enumerate(chosen):
            y[: len(data[c][1]), k] = data[c][1]
        x[:, :, :PATH] *= rng.random((x.shape[1], PATH)) > 0.05
        x[:, :, PATH : PATH + WORDS] *= rng.random((x.shape[1], WORDS)) > 0.5
        round_x, trace_f, trace_b = turned(x, order), [], []
        forth, back = run_cells(x, w, "f", trace_f), turned(run_cells(round_x, w, "b", trace_b), order)
        score = forth @ w["o"][:HIDDEN] + back @ w["o"][HIDDEN:] + w["q"]
        d = (sigmoid(score) - y) * real / real.sum()
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["o"][:HIDDEN], grad["o"][HIDDEN:] = np.tensordot(d, forth, 2), np.tensordot(d, back, 2)
        grad["q"][0] = d.sum()
        backed(x, trace_f, d[:, :, None] * w["o"][:HIDDEN], w, "f", grad)
        backed(round_x, trace_b, turned(d[:, :, None] * w["o"][HIDDEN:], order), w, "b", grad)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g / max(1.0, norm)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
            w[k] = (w[k] - rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def extract(pages: list[str], w: dict, paths: dict, words: Slots) -> list[str]:
    """The article text of each page: its blocks, joined by line feeds, in page order."""
    parsed = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    rows = {k: features(b, paths, words) for k, b in enumerate(parsed) if b}
    group: list[int] = []
    order = sorted(rows, key=lambda k: len(rows[k]))
    for at, k in enumerate(order):
        group.append(k)
        following = len(rows[order[at + 1]]) if at + 1 < len(order) else None
        if following is None or following * (len(group) + 1) > PADDED:
            for j, score in zip(group, judge([rows[j] for j in group], w), strict=True):
                out[j] = "\n".join(b.text for b, s in zip(parsed[j], score, strict=True) if s > 0)
            group = []
    return out


def extract_batches(batches: Iterator[pa.RecordBatch], w: dict) -> Iterator[pa.RecordBatch]:
    """Batches of (page_id, url, html) as (page_id, url, text, n_chars); keys stay as they are."""
    paths, words = {}, Slots(WORDS)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = extract([h or "" for h in part.column(2).to_pylist()], w, paths, words)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def sample_pages(pages: DataFrame, n: int = TRAIN_PAGES, chars: int = TRAIN_CHARS) -> list[str]:
    """The html of the n pages of up to `chars` characters whose keys have the smallest hashes: n * chars characters at most."""
    fit = pages.where(F.length("html").between(1, chars))
    ids = fit.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(n)
    rows = fit.join(F.broadcast(ids.distinct()), "page_id").select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(n)
    return [r.html for r in rows.collect()]


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null and empty html, and pages without article blocks, give an empty text. Rows that repeat give equal rows.
    """
    pages = pages.select("page_id", "url", "html")
    weights = train(sample_pages(pages))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(partial(extract_batches, w=weights), f"page_id {kind}, url string, text string, n_chars bigint")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
