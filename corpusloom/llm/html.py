"""Main-text extraction: a recurrent labeller over the leaf blocks of a page.

A page becomes the sequence of its text blocks. A bidirectional LSTM (numpy) reads, for every block, a hashed
vector of its tag path and a hashed vector of its words, and labels the block with the whole page as
context. It is trained here, on a bounded sample of the pages with labels from the markup's own meaning,
and on rewrapped copies of them in which the telling tags are renamed, dropped or joined by other boilerplate.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .textvec import blocks as byte_blocks, column, mix, words

# HTML's elements by role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg iframe object canvas math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog button select textarea fieldset".split())
MARKED = re.compile(r"(^|[-_])(ad|ads|advert|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|related|replies|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget)s?($|[-_])", re.I)

PATH_DIM, WORD_DIM, EXTRA = 48, 32, 5


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


@dataclass(frozen=True)
class LabellerParams:
    """``pages``: bound of the training sample (chosen by hash over all pages). ``blocks``: pages with more blocks aren't
    trained on. ``hidden``: cells in each direction. ``copies``: rewrapped copies of each sampled page,
    more where that makes fewer than ``least`` pages in all. ``steps``: least number of updates, for small samples."""

    pages: int = 250
    blocks: int = 400
    hidden: int = 16
    copies: int = 4
    least: int = 800
    epochs: int = 14
    steps: int = 700
    rate: float = 0.01
    seed: int = 7
    batch: int = 32


class _Leaves(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.out: list[Block] = []
        self.words: list[str] = []
        self.linked = self.links = self.silent = 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.out.append(Block(tuple(p for _, p in self.stack if p), text, self.linked))
        self.words, self.linked = [], 0

    def _pop_to(self, tags: str, until: tuple[str, ...] = ()) -> None:
        names = tags.split()
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in names:
                for t, _ in self.stack[i:]:
                    self.links -= t == "a"
                    self.silent -= t in SILENT
                del self.stack[i:]
                return
            if tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.words.append(" ")
        if tag in CLOSES_P:
            self._pop_to("p", ("table", "button"))
        if tag in SIBLINGS:
            self._pop_to(*SIBLINGS[tag])
        if tag == "body":
            self._pop_to("head")
        if tag in VOID:
            return
        name = tag
        marks = [v for k, v in attrs if v and k in ("class", "id", "role")]
        if marks:
            name += "." + ".".join(" ".join(marks).lower().split())
        self.stack.append((tag, "" if tag in INLINE else name))
        self.links += tag == "a"
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if tag not in VOID:
            self._pop_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words.append(data)
            if self.links:
                self.linked += len(data)


def leaves(html: str | None) -> list[Block]:
    """Text blocks in page order. Scripts, styles, comments and the head are no text."""
    if not html:
        return []
    p = _Leaves()
    p.feed(html)
    p.close()
    p.flush()
    return p.out


def by_markup(b: Block) -> int:
    """What the markup says: 1 article text, 0 boilerplate."""
    good = False
    for step in b.path:
        tag, *marks = step.split(".")
        if tag in BOILERPLATE or any(MARKED.search(m) for m in marks) or (tag == "header" and not good):
            return 0
        good |= tag in CONTENT or any(m in ("article", "content", "entry", "main", "post", "story") for m in marks)
    return int(good)


_hashed: dict[str, np.ndarray] = {}


def _token(t: str) -> np.ndarray:
    if t not in _hashed:
        if len(_hashed) > 100_000:
            _hashed.clear()
        seed = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        rng = np.random.default_rng(seed)
        _hashed[t] = (rng.integers(0, 2, PATH_DIM) * 2 - 1).astype(np.float32)
    return _hashed[t]


def _names(step: str) -> list[str]:
    """The tag and the marks of a step, and the parts of marks like article-body, so that a name is known by its parts."""
    marks = step.split(".")
    return marks + [x for m in marks if "-" in m or "_" in m for x in re.split("[-_]+", m) if x]


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page a (blocks, PATH_DIM + WORD_DIM + EXTRA) array."""
    flat = [b for p in pages for b in p]
    if not flat:
        return [np.zeros((0, PATH_DIM + WORD_DIM + EXTRA), np.float32) for _ in pages]
    x = np.zeros((len(flat), PATH_DIM + WORD_DIM + EXTRA), np.float32)
    known: dict[tuple, np.ndarray] = {}
    for i, b in enumerate(flat):
        v = known.get(b.path)
        if v is None:
            v = np.zeros(PATH_DIM, np.float32)
            for depth, step in enumerate(reversed(b.path)):
                for t in _names(step):
                    v += _token(t) / (1 + 0.3 * depth)
            known[b.path] = v = v / 2
        x[i, :PATH_DIM] = v
        n = len(b.text)
        x[i, -EXTRA:] = (np.log1p(n) / 4, b.linked / n if b.linked < n else 1, b.text[-1] in ".!?…\"'", b.text.count(",") / (1 + n / 40), 1)
    at = 0
    for block in byte_blocks([b.text for b in flat]):
        h, doc, _, _ = words(block, True)
        n = len(block)
        sign = 1 - 2 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.int64)
        bag = np.bincount(doc * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64), sign, n * WORD_DIM).reshape(n, WORD_DIM)
        x[at : at + n, PATH_DIM : PATH_DIM + WORD_DIM] = bag / np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1)
        at += n
    cuts = np.cumsum([len(p) for p in pages])[:-1]
    return np.split(x, cuts)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Labeller:
    """Weights of a bidirectional LSTM with one output. ``run`` takes (time, pages, features) and a mask."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, p: LabellerParams) -> Labeller:
        rng = np.random.default_rng(p.seed)
        d, h = PATH_DIM + WORD_DIM + EXTRA, p.hidden
        w = {}
        for side in "fb":
            w[f"x{side}"] = (rng.normal(size=(d, 4 * h)) / np.sqrt(d)).astype(np.float32)
            w[f"h{side}"] = (rng.normal(size=(h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # remember at first
            w[f"c{side}"] = bias
        w["o"] = (rng.normal(size=(2 * h, 1)) / np.sqrt(2 * h)).astype(np.float32)
        w["d"] = np.zeros(1, np.float32)
        return cls(w)

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        n, b, _ = x.shape
        h = self.w[f"h{side}"].shape[0]
        pre = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        out = np.zeros((n, b, h), np.float32)
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            z = pre[t] + state @ self.w[f"h{side}"]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            c = m * (f * cell + i * g)
            tc = np.tanh(c)
            new = m * o * tc
            if keep is not None:
                keep.append((t, i, f, o, g, cell, tc, state, m))
            state, cell = new, c
            out[t] = state
        return out

    def run(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, "f", None), self._pass(x, mask, "b", None)], 2)
        return _sigmoid(both @ self.w["o"] + self.w["d"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h = self.w["hf"].shape[0]
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._pass(x, mask, s, kept[s]) for s in "fb"], 2)
        p = _sigmoid(both @ self.w["o"] + self.w["d"])[..., 0]
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        dz = ((p - y) * mask / total)[..., None].astype(np.float32)
        g = {"o": np.einsum("tbh,tbk->hk", both, dz), "d": dz.sum((0, 1))}
        dboth = dz @ self.w["o"].T
        for k, s in enumerate("fb"):
            dout = dboth[..., k * h : (k + 1) * h]
            wh = self.w[f"h{s}"]
            g[f"x{s}"], g[f"h{s}"], g[f"c{s}"] = np.zeros_like(self.w[f"x{s}"]), np.zeros_like(wh), np.zeros(4 * h, np.float32)
            dstate = dcell = np.zeros_like(dout[0])
            for t, i, f, o, gg, before, tc, prev, m in reversed(kept[s]):
                dh = (dout[t] + dstate) * m
                dc = (dcell + dh * o * (1 - tc * tc)) * m
                d = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                g[f"x{s}"] += x[t].T @ d
                g[f"h{s}"] += prev.T @ d
                g[f"c{s}"] += d.sum(0)
                dstate, dcell = d @ wh.T, dc * f
        return loss, g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of article text for every block; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, x in enumerate(pages) if len(x)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            most = max(1, 60_000 // len(pages[order[min(at + 63, len(order) - 1)]]))
            part = order[at : at + min(128, most)]
            x, mask = _padded([pages[i] for i in part])
            p = self.run(x, mask)
            for k, i in enumerate(part):
                out[i] = p[: len(pages[i]), k]
            at += len(part)
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(p) for p in pages)
    x = np.zeros((n, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((n, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _rewrapped(page: list[Block], y: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A copy of a page with other wrappers and more kinds of boilerplate, made of its own words."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    good = pick(["article", "main", "div.content", "div.post", "section.entry", "div.story", "div.article-body", "div.content-main", "div.post-content", "div.entry-text"])
    bad = pick(["nav", "div.menu", "div.navbar", "ul.navigation", "header", "div.article-menu", "div.content-nav", "div.main-menu"])
    swap = {"article": good, "nav": bad, "footer": pick(["footer", "div.footer", "section.site-footer", "div.article-footer", "div.content-footer", "div.post-footer"])}
    outer = [] if rng.random() < 0.5 else [pick(["div", "div.wrap", "div.page", "section"])]
    blocks, labels = [], []
    pool = " ".join(b.text for b in page).split() or ["x"]

    def add(path: str, n: int, words_each: int, linked: bool) -> None:
        for _ in range(n):
            text = " ".join(pick(pool) for _ in range(int(rng.integers(1, words_each + 1))))
            blocks.append(Block(("html", "body", *outer, *path.split()), text, len(text) * linked))
            labels.append(0)

    def extra(where: str) -> None:
        for path, n, k, linked in (
            ("aside ul li", 4, 3, True), ("aside p", 2, 30, False), ("div.sidebar div", 3, 8, True), ("div.notice p", 1, 20, False), ("div.cookie-banner p", 1, 25, False),
            ("form div", 2, 3, False), ("form label", 2, 2, False), ("section.comments div.comment p", 4, 40, False), ("div.comments ol li p", 3, 30, False), ("div.ad p", 1, 12, False),
            ("div.related ul li", 4, 8, True), ("header div", 2, 4, True), ("div.share a", 2, 2, True), ("div.newsletter p", 1, 15, False),
        ):
            if rng.random() < 0.3:
                add(path, int(rng.integers(1, n + 1)), k, linked)

    extra("before")
    for b, v in zip(page, y, strict=True):
        path = tuple(s for step in b.path for s in ([swap.get(step, step)] if step not in ("html", "body") else [step, *outer] if step == "body" else [step]))
        blocks.append(Block(path, b.text, b.linked))
        labels.append(v)
    extra("after")
    return blocks, labels


def train(html: list[str | None], p: LabellerParams = LabellerParams()) -> Labeller:
    """A labeller from a bounded list of pages. Pages without any block are left out; with no page at all, every block
    is labelled by the untrained weights and the markup alone decides (see ``extract``)."""
    rng = np.random.default_rng(p.seed)
    sample = [page for page in map(leaves, html[: p.pages]) if 0 < len(page) <= p.blocks]
    copies = max(p.copies, p.least // max(len(sample), 1))
    data = []
    for page in sample:
        y = [by_markup(b) for b in page]
        data += [(page, y)] + [_rewrapped(page, y, rng) for _ in range(copies)]
    model = Labeller.fresh(p)
    if not data:
        return model
    xs, ys = features([d[0] for d in data]), [np.array(d[1], np.float32) for d in data]
    order = sorted(range(len(xs)), key=lambda i: len(xs[i]))
    batches = [order[i : i + p.batch] for i in range(0, len(order), p.batch)]
    m1 = {k: np.zeros_like(v) for k, v in model.w.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for _ in range(max(p.epochs, -(-p.steps // len(batches)))):
        for k in rng.permutation(len(batches)):
            x, mask = _padded([xs[i] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batches[k]):
                y[: len(ys[i]), j] = ys[i]
            _, g = model.gradients(x, mask, y)
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for n, v in g.items():  # Adam on clipped gradients
                v = v * min(1, 1 / (norm + 1e-9))
                m1[n] = 0.9 * m1[n] + 0.1 * v
                m2[n] = 0.99 * m2[n] + 0.01 * v * v
                model.w[n] = model.w[n] - p.rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-7)
    return model


def train_on(pages: DataFrame, page_id: str = "page_id", html: str = "html", p: LabellerParams = LabellerParams()) -> Labeller:
    """Sample ``p.pages`` pages by the hash of their id over the whole table, and train on the driver (the sample is bounded)."""
    ids = [r[0] for r in pages.where(F.col(html).isNotNull()).select(page_id).orderBy(F.xxhash64(page_id), page_id).limit(p.pages).collect()]
    rows = pages.where(F.col(page_id).isin(ids)).select(page_id, html).limit(4 * p.pages).collect() if ids else []
    return train([r[1] for r in sorted(rows, key=lambda r: (str(r[0]), r[1] or ""))], p)


def extract(pages: DataFrame, model: Labeller, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole html; null and empty html, and pages without article blocks, give
    the empty string. A column already called ``out`` is replaced."""
    base = pages.drop(out)
    weights = model.w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(weights)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [leaves(h) for h in column(b, html)]
                good = labeller.label(features(found))
                text = ["\n\n".join(x.text for x, g in zip(page, p, strict=True) if g >= 0.5) for page, p in zip(found, good, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema, T.StructField(out, T.StringType())]))


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = train_on(pages.select("page_id", "html"))
    done = extract(pages.select("page_id", "url", "html"), model)
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
