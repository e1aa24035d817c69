"""HTML main-text extraction by a recurrent block labeller.

A page is a sequence of blocks. A bidirectional LSTM in numpy reads, for each block, a vector of its
hashed tag path, one of its hashed words and a few lengths, and labels it main text or not with the whole
page as context. It is trained here. Generated pages of many layouts, around texts of a bounded sample of
pages, carry the truth they were made with; of the sampled pages themselves those with an `article` or `main`
element teach what the HTML standard says of it. Half of all training pages are read without the names that
tell: their tags, classes and ids are replaced at random, so that text and position have to tell alone.

Defined results: a null or blank page has an empty text of 0 characters; pages are read one by one, so
repeated ids and further columns change nothing; an empty table gives no rows (the labeller then knows the
generated layouts only).
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import narrow, read
from .html_blocks import Block, Node, blocks

PATH_DIM, WORD_DIM, HIDDEN = 96, 48, 24
DIM = PATH_DIM + WORD_DIM + 6
#: Most pages that a fit takes (those of the smallest xxhash64 of url and id), the longest of them in characters,
#: and how many pages are generated beside them.
SAMPLE_PAGES, SAMPLE_CHARS, GENERATED_PAGES = 240, 65_536, 480
#: Steps of a page that a prediction reads at once.
STEPS = 1024

# Elements by the HTML standard that hold a page's main content, and that stand outside of it.
MAIN = {"article", "main"}
OUTSIDE = {"nav", "aside", "footer", "form", "header", "dialog"}


def standard_label(block: Block) -> bool | None:
    """What the HTML standard's sectioning elements say of a block; None where there is no article or main around it."""
    node, outside, title = block.node, False, False
    while node:
        title |= node.words[0] == "h1"
        outside |= node.words[0] in OUTSIDE and not (node.words[0] == "header" and title)
        if node.words[0] in MAIN:
            return not outside
        node = node.parent
    return False if outside else None


_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    slot = _slots.get(word)
    if slot is None:
        if len(_slots) > 100_000:
            _slots.clear()
        slot = _slots[word] = zlib.crc32(word.encode()) % PATH_DIM
    return slot


def _path_vector(node: Node | None) -> np.ndarray:
    """Counts of the hashed words of the elements around a block; each element adds to its parent's once."""
    todo = []
    while node and node.cache is None:
        todo.append(node)
        node = node.parent
    out = node.cache if node else np.zeros(PATH_DIM, np.float32)
    for n in reversed(todo):
        out = n.cache = out.copy()
        for word in n.words:
            out[_slot(word)] += 1
    return out


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), DIM), np.float32)
    for i, b in enumerate(page):
        out[i, :PATH_DIM] = np.minimum(_path_vector(b.node), 4)
        n = len(b.text)
        out[i, -6:] = (np.log1p(n) / 8, np.log1p(b.text.count(" ")) / 6, min(1.0, b.linked / max(n, 1)), b.text[-1] in ".!?", "©" in b.text, i / max(len(page), 1))
    raw = [b.text.encode("utf-8", "replace") for b in page]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    data = T.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    starts, ends, at = T.word_spans(data, offsets, T.SPACED)
    slots = (T.span_hashes(data, starts, ends) % np.uint64(WORD_DIM)).astype(np.int64)
    row = np.repeat(np.arange(len(page)), np.diff(at))
    counts = np.bincount(row * WORD_DIM + slots, minlength=len(page) * WORD_DIM).reshape(len(page), WORD_DIM)
    out[:, PATH_DIM:-6] = 3 * counts / np.maximum(np.diff(at), 1)[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BlockLabeller:
    w: list[np.ndarray]  # for each direction: (DIM + HIDDEN + 1) x 4 HIDDEN
    out: np.ndarray  # 2 HIDDEN + DIM + 1

    @classmethod
    def fresh(cls, seed: int = 3) -> BlockLabeller:
        r = np.random.default_rng(seed)
        w = [r.standard_normal((DIM + HIDDEN + 1, 4 * HIDDEN)) * 0.15 for _ in range(2)]
        for x in w:
            x[-1, HIDDEN : 2 * HIDDEN] = 1  # open forget gates
        return cls(w, r.standard_normal(2 * HIDDEN + DIM + 1) * 0.05)

    def _direction(self, w: np.ndarray, x: np.ndarray, live: np.ndarray, state=None, tape: bool = True):
        """x: pages x steps x DIM; live: which steps exist. The states, what the backward pass needs, and the last state."""
        n, steps, _ = x.shape
        h, c = state or (np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)))
        fed = x @ w[:DIM] + w[-1]
        hs, memory = np.zeros((n, steps, HIDDEN)), []
        for t in range(steps):
            z = fed[:, t] + h @ w[DIM:-1]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            m = live[:, t, None]
            if tape:
                memory.append((h, c, i, f, o, g, tc))
            h, c = np.where(m, o * tc, h), np.where(m, new_c, c)
            hs[:, t] = h
        return hs, memory, (h, c)

    def _backward(self, w, x, live, memory, grad_h):
        n, steps, _ = x.shape
        dh, dc, dw = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros_like(w)
        dz_all = np.zeros((n, steps, 4 * HIDDEN))
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc = memory[t]
            m = live[:, t, None]
            d = dh + grad_h[:, t]
            dcell = np.where(m, dc + d * o * (1 - tc**2), 0)
            dz = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), np.where(m, d * tc, 0) * o * (1 - o), dcell * i * (1 - g**2)), 1)
            dz_all[:, t] = dz
            dw[DIM:-1] += h.T @ dz
            dh = np.where(m, dz @ w[DIM:-1].T, d)
            dc = np.where(m, dcell * f, dc)
        dw[:DIM] = np.einsum("ntd,ntk->dk", x, dz_all, optimize=True)
        dw[-1] = dz_all.sum((0, 1))
        return dw

    @staticmethod
    def _padded(pages: list[np.ndarray], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages)) if steps is None else steps
        x, live = np.zeros((len(pages), steps, DIM)), np.zeros((len(pages), steps), bool)
        for i, p in enumerate(pages):
            x[i, : len(p)], live[i, : len(p)] = p, True
        return x, live

    def _states(self, x, live):
        a, ma, _ = self._direction(self.w[0], x, live)
        # read backwards, the padding comes first and leaves the state as it is
        b, mb, _ = self._direction(self.w[1], x[:, ::-1], live[:, ::-1])
        return np.concatenate((a, b[:, ::-1], x, np.ones((*live.shape, 1))), 2), ma, mb

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text of each block; pages of similar length share a pass."""
        out: list = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            top = at + 1
            while top < len(order) and top - at < 256 and (top + 1 - at) * len(pages[order[top]]) <= 16_384:
                top += 1
            own, at = order[at:top], top
            for i, p in zip(own, self._probabilities([pages[i] for i in own])):
                out[i] = p
        return out

    def _probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """STEPS blocks at a time in each direction: beyond the vectors, a block takes a few numbers only."""
        steps = max(map(len, pages))
        logit = np.zeros((len(pages), steps))
        for k, reverse in enumerate((False, True)):
            starts, state = range(0, steps, STEPS), None
            for a in reversed(starts) if reverse else starts:
                x, live = self._padded([p[a : a + STEPS] for p in pages], min(STEPS, steps - a))
                way = slice(None, None, -1 if reverse else 1)
                hs, _, state = self._direction(self.w[k], x[:, way], live[:, way], state, tape=False)
                logit[:, a : a + STEPS] += hs[:, way] @ self.out[k * HIDDEN : (k + 1) * HIDDEN]
                if not reverse:
                    logit[:, a : a + STEPS] += x @ self.out[2 * HIDDEN : -1] + self.out[-1]
        return [_sigmoid(row[: len(p)]) for row, p in zip(logit, pages)]

    @classmethod
    def fit(cls, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 24) -> BlockLabeller:
        """pages: (vectors, label of each block: 1, 0, or -1 for none). Adam on the log-loss."""
        model = cls.fresh()
        params = [*model.w, model.out]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        r, step = random.Random(5), 0
        for _ in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][0]) + r.random() * 12))
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            r.shuffle(groups)
            for own in groups:
                x, live = model._padded([pages[i][0] for i in own])
                y = np.full(live.shape, -1.0)
                for row, i in enumerate(own):
                    y[row, : len(pages[i][1])] = pages[i][1]
                states, ma, mb = model._states(x, live)
                err = np.where(y >= 0, _sigmoid(states @ model.out) - y, 0) / max((y >= 0).sum(), 1)
                d = err[:, :, None] * model.out[: 2 * HIDDEN]
                grads = [model._backward(model.w[0], x, live, ma, d[:, :, :HIDDEN]), model._backward(model.w[1], x[:, ::-1], live[:, ::-1], mb, d[:, ::-1, HIDDEN:]), np.einsum("nt,ntk->k", err, states)]
                step += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return model


#: Opens every text of a generated page that belongs to the article (a private-use character).
_TRUE = "\ue000"

# Names that pages give their parts.
_PARTS = {
    "menu": "nav menu navbar navigation topbar breadcrumb".split(),
    "head": "header masthead branding".split(),
    "side": "sidebar aside widget related sponsor promo share social newsletter".split(),
    "ad": "ad ads advert advertisement banner sponsored".split(),
    "notice": "notice cookie consent popup modal alert".split(),
    "comments": "comments comment replies respond discussion".split(),
    "foot": "footer copyright legal disclaimer".split(),
    "main": "content post entry story article-body main".split(),
}


def generated(bodies: list[str], asides: list[str], count: int, seed: int = 11) -> list[str]:
    """Pages of many layouts; the article's texts are made of bodies and start with _TRUE, the rest of asides."""
    r = random.Random(seed)
    bodies = [t for t in bodies if t.split()] or ["Some words of a text, and more of them.", "Another text stands here."]
    asides = [t for t in asides if t.split()] or ["Home", "About us", "Contact", "Subscribe now", "Privacy policy", "Next page"]

    def words(texts: list[str], least: int, most: int) -> str:
        own = r.choice(texts).split()
        n, at = r.randint(least, most), r.randrange(len(own))
        return " ".join((own * (2 + n // len(own)))[at : at + n])

    def say(least: int, most: int) -> str:
        return words(asides if r.random() < 0.5 else bodies, least, most)

    def true(least: int, most: int) -> str:
        text = words(bodies, least, most)
        return _TRUE + (text if r.random() < 0.2 else text.rstrip(",.;:") + r.choice(".....?!"))

    def part(kind: str, inside: str, tags: list[str]) -> str:
        name = " ".join(r.sample(_PARTS[kind], r.randint(1, 2)))
        return f'<{(tag := r.choice(tags))} {r.choice(["class", "id"])}="{name}">{inside}</{tag}>'

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{say(1, 3)}</a>' for i in range(n)]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "<p>" + " | ".join(items) + "</p>", "".join(f"<div>{x}</div>" for x in items)])

    def blurb() -> str:
        return r.choice([links(r.randint(2, 7)), f"<p>{say(3, 25)}</p>", say(4, 12), f"<h3>{say(1, 4)}</h3>" + "".join(f"<p>{say(3, 16)}</p>" for _ in range(r.randint(1, 3)))])

    def aside() -> str:
        kind = r.choice(["side", "side", "ad", "ad", "notice"])
        if r.random() < 0.15:
            return f"<form><p>{say(2, 6)}</p><input><button>{say(1, 2)}</button></form>"
        return part(kind, blurb(), ["aside", "div", "section"] if kind == "side" else ["div", "div", "section"])

    def article() -> str:
        body = []
        for _ in range(r.randint(1, 14)):
            body.append(f"<p>{true(1, 4) if r.random() < 0.15 else true(4, 90)}</p>")
            if r.random() < 0.12:
                body.append(r.choice([f"<h2>{true(1, 6)}</h2>", f"<blockquote>{true(4, 30)}</blockquote>", f"<ul><li>{true(2, 20)}</li><li>{true(2, 20)}</li></ul>", f"<p><b>{true(2, 30)}<br>", f"<table><tr><th>{true(1, 3)}</th><td>{true(1, 5)}</td></tr></table>", f"<pre>{true(2, 20)}</pre>"]))
            if r.random() < 0.06:
                body.append(aside())
        title = f"<h1>{true(1, 12)}</h1>" if r.random() < 0.9 else ""
        shape = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "part", "<div role=main>{}</div>"])
        return part("main", title + "".join(body), ["div", "section"]) if shape == "part" else shape.format(title + "".join(body))

    def comments() -> str:
        return part("comments", f"<h3>{say(1, 3)}</h3>" + "".join(f"<div><p>{say(1, 2)}</p><p>{say(3, 40)}</p><a href=#>{say(1, 1)}</a></div>" for _ in range(r.randint(1, 6))), ["section", "div"])

    pages = []
    for _ in range(count):
        page = [part("menu", links(r.randint(3, 9)), ["nav", "nav", "div"])] if r.random() < 0.85 else []
        if r.random() < 0.4:
            page.insert(r.randint(0, len(page)), part("head", f"<p>{say(1, 6)}</p>", ["header", "div"]))
        page += [aside() for _ in range(r.choice([0, 0, 1, 1, 2]))] + [article()]
        page += [comments()] if r.random() < 0.3 else []
        page += [aside() for _ in range(r.choice([0, 0, 1, 2]))]
        if r.random() < 0.85:
            page.append(part("foot", r.choice([f"&copy; {say(1, 14)}", f"<p>{say(2, 20)}</p>{links(3)}", f"<p>&copy; {say(2, 9)}</p>", say(3, 14)]), ["footer", "footer", "div"]))
        pages.append("<html><body>" + "".join(page) + "</body></html>")
    return pages


def _nameless(page: list[Block], r: random.Random) -> None:
    """Replaces what the elements are called: sections by div, classes and ids by words that say nothing."""
    told = {w for names in _PARTS.values() for x in names for w in x.split("-")} | MAIN | OUTSIDE | {"section"}
    new: dict[tuple[str, ...], tuple[str, ...]] = {}
    seen = set()
    for b in page:
        node = b.node
        while node and id(node) not in seen:
            seen.add(id(node))
            if len(node.words) > 1 or node.words[0] in told:
                tag = "div" if node.words[0] in told else node.words[0]
                node.words = new.setdefault(node.words, (tag, *(f"c{r.randrange(1000)}" for _ in node.words[1:])))
            node = node.parent


def train(pages: list[str], *, generated_pages: int = GENERATED_PAGES, seed: int = 5) -> BlockLabeller:
    """A labeller from the pages and as many generated ones as are asked for, half of each without telling names."""
    r = random.Random(seed)
    rows, bodies, asides = [], [], []
    for n, page in enumerate(pages):
        own = blocks(page)
        for b in own:
            (asides if b.linked * 2 > len(b.text) or len(b.text) < 25 else bodies).append(b.text)
        labels = [standard_label(b) for b in own]
        if any(labels):
            # beside an article or main, what stands in neither is outside
            labels = np.array([float(bool(x)) for x in labels])
            if n % 2:
                _nameless(own, r)
            rows.append((vectors(own), labels))
    for n, page in enumerate(generated(bodies, asides, generated_pages)):
        own = blocks(page)
        labels = np.array([float(b.text.startswith(_TRUE)) for b in own])
        for b in own:
            b.text = b.text.replace(_TRUE, "") or "."
        if n % 2:
            _nameless(own, r)
        rows.append((vectors(own), labels))
    return BlockLabeller.fit(rows)


def fit(pages: DataFrame, *, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS, generated_pages: int = GENERATED_PAGES) -> BlockLabeller:
    """A labeller from at most sample_pages pages of up to sample_chars characters each."""
    rows = pages.where(f"html is not null and length(html) between 1 and {int(sample_chars)}").select(F.xxhash64("url", "page_id").alias("_a"), F.xxhash64("html").alias("_b"), "html")
    chosen = rows.select("_a", "_b").distinct().orderBy("_a", "_b").limit(sample_pages)
    mine = rows.join(F.broadcast(chosen), ["_a", "_b"]).dropDuplicates(["_a", "_b"]).select("html")
    return train(sorted(r.html for r in mine.collect()), generated_pages=generated_pages)


def extract(pages: DataFrame, model: BlockLabeller) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    narrow(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                parsed = [blocks(x or "") for x in batch.column("html").to_pylist()]
                marks = model.predict([vectors(p) for p in parsed])
                texts = ["\n".join(b.text for b, keep in zip(p, m) if keep >= 0.5) for p, m in zip(parsed, marks)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
