"""Main text of web pages by a recurrent labeller of blocks.

A page is read as the sequence of its blocks (text between block-level tags, character
references decoded). Each block becomes one vector: the sum over hashed names on its
tag path (tags, classes, ids, last pair of tags), the mean over its hashed words and a
few measures. A bidirectional LSTM in numpy runs over all blocks of the page, and every
block is judged by what both directions have seen, so that it counts where in the page
it stands. The text is what is left, in page order.

The labeller is fitted on the driver on ``TRAIN_PAGES`` made-up pages (see
:mod:`page_samples`), from a seed; no page of the table is used for it. Pages are
independent of each other, so the work is one pass without a shuffle. Pages of like
length run together, padded, at most ``CELLS`` blocks at a time.

Defined cases: a null or empty html gives an empty text; text that no tag surrounds is
a block; an unclosed comment or script runs to the end; repeated rows are judged alike;
a null page id or url stays null; an empty table gives no rows; other columns are not
read. Very long pages are read whole.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import held, hold_only, in_batches
from pairloom.llm.page_samples import MARK, sample_pages

TRAIN_PAGES = 900
SEED = 11
EPOCHS = 8
BUCKETS = 512
DIM = 24
HIDDEN = 16
MEASURES = 6
CELLS = 100_000
CHARS = 4_000_000

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title textarea template noscript iframe svg object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
_CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
_LISTS = frozenset("ul ol dl table article section div main aside nav footer header body".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:"[^"]*"|'[^']*'|[^>"'])*))(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S
)
_NAMES = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


class _Buckets(dict):
    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[name] = _bucket(name)
        return value


_buckets = held(_Buckets())


def blocks_of(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, names on the tag path, characters inside links) of every block in order."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[str, tuple[str, ...], int]] = []
    texts: list[str] = []
    path: tuple[str, ...] = ()
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            out.append((text, path, linked))
        texts.clear()
        linked = 0

    def path_now() -> tuple[str, ...]:
        tags = [t for t, _ in stack if t not in INLINE]
        return tuple(n for _, names in stack for n in names) + (("pair " + ">".join(tags[-2:]),) if tags else ())

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.match(page, at)
        at = found.end()
        tag = found[2]
        if tag is None:
            text = found[0]
            if text[0] != "<" or len(text) == 1:
                if not texts:
                    path = path_now()
                text = html.unescape(text) if "&" in text else text
                texts.append(text)
                linked += len(text) if links else 0
            continue
        tag = tag.lower()
        if found[1]:
            if any(t == tag for t, _ in stack):
                if tag not in INLINE:
                    flush()
                while stack:
                    gone, _ = stack.pop()
                    links -= gone == "a"
                    if gone == tag:
                        break
            elif tag == "p":
                flush()
            continue
        if tag in UNSEEN:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            if close:
                at = page.find(">", close.end() - 1) + 1 or end
            continue
        if tag == "br":
            texts.append(" " if texts else "")
            continue
        if tag not in INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if tag in _CLOSED_BY.get(stack[i][0], ()):
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in _LISTS:
                    break
        if tag in VOID or found[3].endswith("/") and tag in INLINE:
            continue
        names = [] if tag in INLINE else ["tag " + tag]
        if found[3] and tag not in INLINE:
            for kind, *values in _NAMES.findall(found[3]):
                names += [f"name {x}" for x in "".join(values).lower().split()]
        links += tag == "a"
        stack.append((tag, tuple(names)))
    flush()
    return out


def _measures(text: str, linked: int, words: int) -> tuple[float, ...]:
    n = len(text)
    return (
        np.log1p(n) / 5, np.log1p(words) / 4, min(1.0, linked / n), float(text[-1] in ".!?:;"), float(text[0].isupper()),
        float(words < 4),
    )


class Sequences:
    """Blocks of several pages as flat arrays."""

    def __init__(self, pages: list[list[tuple[str, tuple[str, ...], int]]]):
        self.lengths = np.array([len(p) for p in pages], np.int64)
        tags: list[int] = []
        words: list[int] = []
        n_tags, n_words, measures = [], [], []
        look = _buckets.__getitem__
        for page in pages:
            for text, path, linked in page:
                said = text.lower().split()
                tags.extend(map(look, path))
                words.extend(map(look, said))
                n_tags.append(len(path))
                n_words.append(len(said))
                measures.append(_measures(text, linked, len(said)))
        self.tags, self.words = np.array(tags, np.int64), np.array(words, np.int64)
        self.n_tags, self.n_words = np.array(n_tags, np.int64), np.array(n_words, np.int64)
        self.measures = np.array(measures, np.float32).reshape(-1, MEASURES)


def _sums(table: np.ndarray, ids: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    full = counts > 0
    if full.any():
        starts = np.cumsum(counts) - counts
        for a in range(0, len(counts), 20_000):  # bounds what is gathered at once
            part = np.flatnonzero(full[a : a + 20_000]) + a
            if len(part):
                low, high = starts[part[0]], starts[part[-1]] + counts[part[-1]]
                out[part] = np.add.reduceat(table[ids[low:high]], starts[part] - low, axis=0)
    return out * scale[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights of the model, its forward pass and one step of fitting."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)

        self.w = {"tags": start(BUCKETS, DIM) * 4, "words": start(BUCKETS, DIM) * 4, "measures": start(MEASURES, DIM), "bias": np.zeros(DIM, np.float32)}
        for way in ("on", "back"):
            self.w[f"{way}_x"], self.w[f"{way}_h"] = start(DIM, 4 * HIDDEN), start(HIDDEN, 4 * HIDDEN)
            self.w[f"{way}_b"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.w["out"], self.w["out_b"] = start(2 * HIDDEN + DIM, 1)[:, 0], np.zeros(1, np.float32)

    def vectors(self, s: Sequences) -> np.ndarray:
        w = self.w
        x = _sums(w["tags"], s.tags, s.n_tags, 1 / np.sqrt(np.maximum(s.n_tags, 1)))
        x += _sums(w["words"], s.words, s.n_words, 1 / np.maximum(s.n_words, 1))
        return np.tanh(x + s.measures @ w["measures"] + w["bias"]).astype(np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (time, page, HIDDEN); padding holds zeros."""
        steps, n, _ = x.shape
        wh = self.w[f"{way}_h"]
        given = x @ self.w[f"{way}_x"] + self.w[f"{way}_b"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if way == "on" else range(steps - 1, -1, -1):
            g = given[t] + h @ wh
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            before = h, c
            m = mask[t][:, None]
            c = (f * c + i * u) * m
            h = o * np.tanh(c) * m
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, u, c, before))
        return out

    def scores(self, s: Sequences) -> np.ndarray:
        """One number per block, above zero for main text. Pages of like length run together."""
        x = self.vectors(s)
        starts = np.cumsum(s.lengths) - s.lengths
        out = np.zeros(len(x), np.float32)
        order = np.argsort(s.lengths, kind="stable")
        order = order[s.lengths[order] > 0]
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * s.lengths[order[b]] <= CELLS:
                b += 1
            rows, mask = _padded(starts[order[a:b]], s.lengths[order[a:b]])
            part = x[rows]
            hidden = np.concatenate([self._run("on", part, mask, None), self._run("back", part, mask, None), part], axis=2)
            out[rows[mask > 0]] = (hidden @ self.w["out"] + self.w["out_b"])[mask > 0]
            a = b
        return out

    def gradient(self, s: Sequences, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over all blocks."""
        w = self.w
        x = self.vectors(s)
        rows, mask = _padded(np.cumsum(s.lengths) - s.lengths, s.lengths)
        part = x[rows] * mask[:, :, None]
        kept: dict[str, list] = {"on": [], "back": []}
        hidden = np.concatenate([self._run(way, part, mask, kept[way]) for way in kept] + [part], axis=2)
        wrong = (_sigmoid(hidden @ w["out"] + w["out_b"]) - truth[rows]) * mask / mask.sum()
        grad = {"out": np.einsum("tn,tnd->d", wrong, hidden), "out_b": np.array([wrong.sum()])}
        into = wrong[:, :, None] * w["out"]
        dx = into[:, :, 2 * HIDDEN :].copy()
        for k, way in enumerate(kept):
            dh_out = into[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh = dc = np.zeros_like(dh_out[0])
            gates = np.zeros((*part.shape[:2], 4 * HIDDEN), np.float32)
            grad[f"{way}_h"] = np.zeros_like(w[f"{way}_h"])
            for t, i, f, o, u, c, (h_before, c_before) in reversed(kept[way]):
                m = mask[t][:, None]
                dh = (dh + dh_out[t]) * m
                tc = np.tanh(c)
                dc = (dc + dh * o * (1 - tc * tc)) * m
                g = np.concatenate([dc * u * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                gates[t] = g
                grad[f"{way}_h"] += h_before.T @ g
                dh, dc = g @ w[f"{way}_h"].T, dc * f
            grad[f"{way}_x"] = np.einsum("tnd,tng->dg", part, gates)
            grad[f"{way}_b"] = gates.sum((0, 1))
            dx += gates @ w[f"{way}_x"].T
        flat = np.zeros_like(x)
        flat[rows[mask > 0]] = dx[mask > 0]
        flat *= 1 - x * x
        grad["measures"], grad["bias"] = s.measures.T @ flat, flat.sum(0)
        for name, ids, counts, scale in (
            ("tags", s.tags, s.n_tags, 1 / np.sqrt(np.maximum(s.n_tags, 1))),
            ("words", s.words, s.n_words, 1 / np.maximum(s.n_words, 1)),
        ):
            grad[name] = np.zeros_like(w[name])
            np.add.at(grad[name], ids, np.repeat(flat * scale[:, None], counts, axis=0))
        return grad


def _padded(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the blocks as (time, page), and which of them are real."""
    steps = np.arange(lengths.max())[:, None]
    mask = steps < lengths[None, :]
    return np.where(mask, starts[None, :] + steps, 0), mask.astype(np.float32)


def fit(pages: int = TRAIN_PAGES, seed: int = SEED, epochs: int = EPOCHS, batch: int = 30) -> Labeller:
    """A labeller fitted on made-up pages by Adam."""
    parsed = [p for p in map(blocks_of, sample_pages(pages, seed)) if p]
    model = Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    rng = np.random.default_rng(seed)
    turn, turns = 0, epochs * -(-len(parsed) // batch)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(parsed)), -(-len(parsed) // batch)):
            group = [parsed[i] for i in at]
            truth = np.array([MARK in text for page in group for text, _, _ in page], np.float32)
            clean = [[(text.replace(MARK, "") or " ", path, linked) for text, path, linked in page] for page in group]
            turn += 1
            rate = 0.02 * (1 - turn / (turns + 1))
            for k, g in model.gradient(Sequences(clean), truth).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = (model.w[k] - rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return model


_fitted: dict[tuple[int, int, int], Labeller] = {}


def labeller(pages: int = TRAIN_PAGES, seed: int = SEED, epochs: int = EPOCHS) -> Labeller:
    key = (pages, seed, epochs)
    if key not in _fitted:
        _fitted[key] = fit(*key)
    return _fitted[key]


def texts_of(model: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of each page."""
    parsed = [blocks_of(p) for p in pages]
    score = iter(model.scores(Sequences(parsed)).tolist())
    return [" ".join(text for text, _, _ in page if next(score) > 0) for page in parsed]


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(_buckets)
        for batch in batches:
            pages, texts, chars = [], [], 0
            for page in batch.column(2).to_pylist():
                pages.append(page)
                chars += len(page or "")
                if chars > CHARS:
                    texts += texts_of(model, pages)
                    pages, chars = [], 0
            texts += texts_of(model, pages) if pages else []
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return in_batches(rows, run, "page_id long, url string, text string, n_chars long")
