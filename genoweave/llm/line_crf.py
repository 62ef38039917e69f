"""Quality: a linear-chain conditional random field that labels every line of a text good or bad.

Each line has on/off features of its own and those of the line before and after it; two states and a
2 x 2 transition matrix join the lines. Forward-backward gives each line's probability of being bad. Weighted
by the lines' lengths they make the document's bad share, which a logistic fit turns into a quality score.

Only documents carry labels. Training starts with the document's label on all its lines, then lets lines of bad
documents that look good be good (the worst line stays bad), and fits again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import by_text, in_one_task, sample_texts

#: Labelled rows the model is fitted on, at most; each with all its lines.
SAMPLE_ROWS = 4_000

UPPER, LOWER, DIGIT, SPACE, SYMBOL, STOP, OTHER = range(7)
N_OWN = 22


def _classes() -> np.ndarray:
    table = np.full(1 << 16, OTHER, "uint8")
    for i in range(1 << 16):
        c = chr(i)
        if c in " \t\r\x0b\x0c\n":
            table[i] = SPACE
        elif c.isupper():
            table[i] = UPPER
        elif c.isalpha():
            table[i] = LOWER
        elif c.isdigit():
            table[i] = DIGIT
        elif c in ".,;:?'\"-()":
            table[i] = STOP
        elif c.isprintable():
            table[i] = SYMBOL
    return table


_table: np.ndarray | None = None


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """On/off features (lines x 3 N_OWN: own, line before, line after) and lengths of the lines that have a word."""
    global _table
    if _table is None:
        _table = _classes()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, 3 * N_OWN), "float32"), np.zeros(0)
    joined = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _table[np.minimum(joined, (1 << 16) - 1)]
    size = np.array([len(x) for x in lines])
    first = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    counts = np.stack([np.add.reduceat((kinds == k).astype("int32"), first) for k in range(7)], 1).astype(float)
    counts[:-1, SPACE] -= 1  # the line ends between them
    letters = np.maximum(1, counts[:, UPPER] + counts[:, LOWER])
    size = np.maximum(1, size)
    words = np.empty((len(lines), 3))
    seen: dict[str, int] = {}
    again = np.zeros(len(lines))
    for i, line in enumerate(lines):
        own = line.split()
        distinct = set(own)
        words[i] = len(own), len(distinct), sum(map(str.__eq__, own[1:], own)) if len(distinct) < len(own) else 0
        again[i] = seen.get(line, 0)
        seen[line] = again[i] + 1
    n = np.maximum(1, words[:, 0])
    upper, symbol, digit = counts[:, UPPER] / letters, counts[:, SYMBOL] / size, counts[:, DIGIT] / size
    by_word, rare, echo, long_ = counts[:, SYMBOL] / n, words[:, 1] / n, words[:, 2] / n, size / n
    own = np.stack([
        np.ones(len(lines)), upper > 0.3, upper > 0.7, symbol > 0.02, symbol > 0.1, symbol > 0.25, digit > 0.1, digit > 0.3,
        by_word > 0.3, by_word > 1, by_word > 2, (rare < 0.8) & (n >= 8), (rare < 0.5) & (n >= 8), (rare < 0.25) & (n >= 8), echo > 0.1, echo > 0.5,
        again > 0, again > 2, n < 4, n > 60, long_ > 12, counts[:, STOP] / size < 0.005,
    ], 1).astype("float32")
    around = np.zeros_like(own)
    out = np.concatenate([own, around, around], 1)
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]
    out[:-1, 2 * N_OWN :] = own[1:]
    return out, size.astype(float)


def marginals(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of state 1 (bad) at every line. emit: log weight of state 1 against 0; trans: log weights, 2 x 2."""
    n = len(emit)
    odds = np.exp(np.clip(emit, -30, 30)).tolist()
    (a, b), (c, d) = np.exp(trans).tolist()
    forward, f0, f1 = [], 1.0, odds[0]
    s = f0 + f1
    forward.append((f0 / s, f1 / s))
    for i in range(1, n):
        p0, p1 = forward[-1]
        f0, f1 = p0 * a + p1 * c, (p0 * b + p1 * d) * odds[i]
        s = f0 + f1
        forward.append((f0 / s, f1 / s))
    out, b0, b1 = [0.0] * n, 1.0, 1.0
    for i in range(n - 1, -1, -1):
        p0, p1 = forward[i]
        x0, x1 = p0 * b0, p1 * b1
        out[i] = x1 / (x0 + x1)
        w = odds[i]
        b0, b1 = a * b0 + b * w * b1, c * b0 + d * w * b1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
    return np.array(out)


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    fit: tuple[float, float, float] = (3.0, -6.0, 0.0)

    def bad_share(self, text: str) -> float:
        """Length-weighted mean of the lines' marginals; a text without lines: 0."""
        x, size = line_features(text)
        return float(marginals(x @ self.weights, self.trans) @ size / size.sum()) if len(size) else 0.0

    def score(self, text: str) -> float:
        return _sigmoid(float(np.dot(self.fit, _inputs(self.bad_share(text)))))


def _inputs(bad: float) -> tuple[float, float, float]:
    return 1.0, bad, float(np.clip(np.log((bad + 1e-4) / (1 - bad + 1e-4)), -7, 7))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class _Chains:
    """Padded chains, longest first, so that step t touches only chains with more than t lines."""

    def __init__(self, sizes: list[int]):
        self.order = np.argsort([-n for n in sizes], kind="stable")
        n = np.array(sizes)[self.order]
        self.active = [int((n > t).sum()) for t in range(int(n[0]))]
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1][self.order]
        self.rows = [start[:k] + t for t, k in enumerate(self.active)]

    def run(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of state 1, expected transition counts and the sum of log normalisers."""
        e, m = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], 1), np.exp(trans)
        alphas, scales, log_z = [], [], 0.0
        for t, rows in enumerate(self.rows):
            a = e[rows] if t == 0 else (alphas[-1][: len(rows)] @ m) * e[rows]
            s = a.sum(1, keepdims=True)
            log_z += float(np.log(s).sum())
            alphas.append(a / s)
            scales.append(s)
        out, pairs = np.zeros(len(emit)), np.zeros((2, 2))
        beta = np.ones((len(self.rows[-1]), 2))
        for t in range(len(self.rows) - 1, -1, -1):
            rows = self.rows[t]
            if len(beta) < len(rows):
                beta = np.concatenate([beta, np.ones((len(rows) - len(beta), 2))])
            p = alphas[t] * beta
            out[rows] = p[:, 1] / p.sum(1)
            if t:
                right = e[rows] * beta / scales[t]
                left = alphas[t - 1][: len(rows)]
                pairs += (left.T @ right) * m
                beta = right @ m.T
        return out, pairs, log_z


def _fit_chain(x: np.ndarray, y: np.ndarray, sizes: list[int], start: Model | None, rounds: int = 120, ridge: float = 1e-3) -> Model:
    """Conditional likelihood by Adam."""
    chains, n = _Chains(sizes), len(y)
    first = np.zeros(n, bool)
    first[np.concatenate([[0], np.cumsum(sizes)])[:-1]] = True
    seen = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    par = np.concatenate([start.weights, start.trans.ravel()]) if start else np.zeros(x.shape[1] + 4)
    m = v = np.zeros_like(par)
    for step in range(1, rounds + 1):
        w, trans = par[:-4], par[-4:].reshape(2, 2)
        p, pairs, _ = chains.run(x @ w, trans)
        grad = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / n - ridge * par
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        par = par + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(par[:-4], par[-4:].reshape(2, 2))


def learn(texts: list[str], good: list[int]) -> Model:
    """Fits the chain and then the score from documents labelled good (1) or bad (0)."""
    xs, sizes, labels = [], [], []
    for text, y in zip(texts, good, strict=True):
        x, _ = line_features(text or "")
        if len(x):
            xs.append(x)
            sizes.append(len(xs[-1]))
            labels.append(1 - y)
    if not xs or len(set(labels)) < 2:
        share = float(np.mean(good)) if good else 0.5
        return Model(np.zeros(3 * N_OWN), np.zeros((2, 2)), (float(np.log((share + 0.01) / (1.01 - share))), 0.0, 0.0))
    x, ends = np.concatenate(xs).astype(float), np.cumsum(sizes)
    y = np.repeat(labels, sizes)
    model = None
    for _ in range(3):
        model = _fit_chain(x, y, sizes, model, 120 if model is None else 60)
        p, _, _ = _Chains(sizes).run(x @ model.weights, model.trans)
        for bad, a, b in zip(labels, ends - sizes, ends, strict=True):
            if bad:
                y[a:b] = p[a:b] > 0.5
                y[a + int(np.argmax(p[a:b]))] = 1
    from .toxicity import _logistic

    inputs = np.array([_inputs(model.bad_share(t or "")) for t in texts])
    model.fit = tuple(_logistic(inputs, np.array(good, float), ridge=0.1))
    return model


def train(docs: DataFrame, labelled: DataFrame, *, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most `rows` labelled rows, half of them bad if there are as many, in one executor task."""
    return in_one_task(sample_texts(docs, labelled, label_col, rows, id_col, text_col), learn, lambda: learn([], []))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and quality score (0 to 1) of every whole text. Null and empty texts have no bad line."""
    return by_text(docs, lambda t: (model.score(t),), [("score", "double")], id_col, text_col)
