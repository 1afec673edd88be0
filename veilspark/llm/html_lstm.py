"""A bidirectional LSTM in numpy that labels each block of a page as main text or not.

A block's vector: the mean embedding of the names on its tag path and of the hashes of its words, and a few measures. The
LSTM reads the page's blocks forwards and backwards, so a block is judged in the context of the whole document.
"""

from __future__ import annotations

import io
import pkgutil
import zlib
from functools import lru_cache

import numpy as np

from veilspark.llm.html_blocks import Block

PATHS, WORDS, WIDTH, MEASURES, HIDDEN = 512, 1024, 12, 9, 16


@lru_cache(200_000)
def word_bucket(word: str) -> int:
    return zlib.crc32(word.lower().strip(".,;:!?()[]«»\"'").encode()) % WORDS


@lru_cache(50_000)
def path_bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % PATHS


def measures(b: Block, i: int, n: int, words: int) -> list[float]:
    c, t = len(b.text), b.text
    return [np.log1p(c) / 6, np.log1p(words) / 5, min(1.0, b.linked / c), t.count(",") / words, (t[-1] in ".!?…:;\"”»") * 1.0, i / n, t.count("©") + t.count("|") * 0.5, sum(map(t.count, ".!?")) / words, b.hidden * 1.0]


class Features:
    """Pages' blocks as flat arrays: buckets of path names and words with their ends, and the measures."""

    def __init__(self, pages: list[list[Block]]):
        self.lengths = np.array([len(p) for p in pages], dtype=np.int64)
        paths, words, self.path_end, self.word_end, rows = [], [], [], [], []
        for page in pages:
            for i, b in enumerate(page):
                paths.extend(map(path_bucket, b.path or ("?",)))
                own = list(map(word_bucket, b.text.split()))
                words.extend(own)
                self.path_end.append(len(paths))
                self.word_end.append(len(words))
                rows.append(measures(b, i, len(page), len(own)))
        self.paths, self.words = np.array(paths, dtype=np.int64), np.array(words, dtype=np.int64)
        self.measures = np.array(rows, dtype=np.float32).reshape(-1, MEASURES)


def _means(table: np.ndarray, index: np.ndarray, end: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], end[:-1]])
    return np.add.reduceat(table[index], starts, axis=0) / (end - starts)[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(seed: int = 0) -> dict[str, np.ndarray]:
    rng, n = np.random.default_rng(seed), 2 * WIDTH + MEASURES
    w = {"paths": rng.normal(0, 0.3, (PATHS, WIDTH)), "words": rng.normal(0, 0.3, (WORDS, WIDTH)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
    for d in "fb":
        w |= {f"x{d}": rng.normal(0, n**-0.5, (n, 4 * HIDDEN)), f"h{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    return {k: x.astype(np.float32) for k, x in w.items()}


def inputs(w: dict[str, np.ndarray], f: Features) -> np.ndarray:
    """A vector for each block of all pages."""
    path, word = _means(w["paths"], f.paths, np.array(f.path_end)), _means(w["words"], f.words, np.array(f.word_end))
    return np.concatenate([path, word, f.measures], axis=1).astype(np.float32)


def run_lstm(w: dict[str, np.ndarray], d: str, x: np.ndarray, keep: bool = False):
    """One direction over x (steps, pages, features): the hidden states, and what the backward pass needs."""
    steps, n, _ = x.shape
    gates = x @ w[f"x{d}"] + w[f"c{d}"]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, saved = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        g = gates[t] + h @ w[f"h{d}"]
        i, o = sigmoid(g[:, :HIDDEN]), sigmoid(g[:, 3 * HIDDEN :])
        forget, new = sigmoid(g[:, HIDDEN : 2 * HIDDEN]), np.tanh(g[:, 2 * HIDDEN : 3 * HIDDEN])
        before = (h, c)
        c = forget * c + i * new
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((*before, i, forget, new, o, tc))
    return out, saved


def reversed_rows(lengths: np.ndarray, steps: int) -> np.ndarray:
    """For each step and page, the step that the backward reading takes there; padding stays at the end."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def padded(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat rows as (steps, pages, features), and where the rows stand in it."""
    steps = int(lengths.max())
    page = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((steps, len(lengths), x.shape[1]), np.float32)
    out[step, page] = x
    return out, step, page


def probabilities(w: dict[str, np.ndarray], f: Features) -> np.ndarray:
    """For every block of all pages: the probability that it is main text."""
    has = np.flatnonzero(f.lengths)
    if not len(has):
        return np.zeros(0)
    x, lengths = inputs(w, f), f.lengths
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(x))
    order = has[np.argsort(lengths[has], kind="stable")]
    k = 0
    while k < len(order):  # pages of like length together, so that little is padding; at most about 2^17 rows at once
        n = max(1, min(512, (1 << 17) // int(lengths[order[min(k + 511, len(order) - 1)]])))
        group = order[k : k + n]
        rows = np.concatenate([np.arange(starts[p], starts[p] + lengths[p]) for p in group])
        xs, step, page = padded(x[rows], lengths[group])
        turn = reversed_rows(lengths[group], len(xs))
        forward, _ = run_lstm(w, "f", xs)
        backward, _ = run_lstm(w, "b", np.take_along_axis(xs, turn[:, :, None], axis=0))
        backward = np.take_along_axis(backward, turn[:, :, None], axis=0)
        out[rows] = sigmoid(np.concatenate([forward, backward], axis=2)[step, page] @ w["out"] + w["bias"][0])
        k += n
    return out


def gradients(w: dict[str, np.ndarray], f: Features, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the blocks, and its gradients by back-propagation through time."""
    x = inputs(w, f)
    xs, step, page = padded(x, f.lengths)
    turn = reversed_rows(f.lengths, len(xs))[:, :, None]
    xb = np.take_along_axis(xs, turn, axis=0)
    (hf, sf), (hb, sb) = run_lstm(w, "f", xs, True), run_lstm(w, "b", xb, True)
    h = np.concatenate([hf, np.take_along_axis(hb, turn, axis=0)], axis=2)[step, page]
    p = sigmoid(h @ w["out"] + w["bias"][0])
    loss = float(-np.mean(np.where(y == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
    e = (p - y) / len(y)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["bias"] = h.T @ e, np.array([e.sum()])
    dh = np.zeros((*xs.shape[:2], 2 * HIDDEN), np.float32)
    dh[step, page] = e[:, None] * w["out"]
    dx = np.zeros_like(xs)
    for d, part, saved, inp in (("f", dh[:, :, :HIDDEN], sf, xs), ("b", np.take_along_axis(dh[:, :, HIDDEN:], turn, axis=0), sb, xb)):
        nh, nc = np.zeros_like(part[0]), np.zeros_like(part[0])
        back = np.zeros_like(inp)
        for t in range(len(inp) - 1, -1, -1):
            h0, c0, i, forget, new, o, tc = saved[t]
            a = part[t] + nh
            c = nc + a * o * (1 - tc * tc)
            dg = np.concatenate([c * new * i * (1 - i), c * c0 * forget * (1 - forget), c * i * (1 - new * new), a * tc * o * (1 - o)], axis=1)
            g[f"x{d}"] += inp[t].T @ dg
            g[f"h{d}"] += h0.T @ dg
            g[f"c{d}"] += dg.sum(axis=0)
            nh, nc = dg @ w[f"h{d}"].T, c * forget
            back[t] = dg @ w[f"x{d}"].T
        dx += back if d == "f" else np.take_along_axis(back, turn, axis=0)
    flat = dx[step, page]
    for name, index, ends, cols in (("paths", f.paths, f.path_end, slice(0, WIDTH)), ("words", f.words, f.word_end, slice(WIDTH, 2 * WIDTH))):
        n = np.diff(np.concatenate([[0], ends]))
        np.add.at(g[name], index, np.repeat(flat[:, cols] / n[:, None], n, axis=0))
    return loss, g


@lru_cache(1)
def trained() -> dict[str, np.ndarray]:
    """The weights that ``train_extractor`` has left in the package."""
    with np.load(io.BytesIO(pkgutil.get_data("veilspark.llm", "extractor.npz"))) as z:
        return {k: z[k].astype(np.float32) for k in z.files}
