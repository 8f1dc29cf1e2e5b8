"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of byte classes, word
statistics and length, in bins, of the line and of the lines before and after
it. Training labels all lines of a document with the document's label; the
model maximises the chain's conditional likelihood by Adam in numpy. A document
is scored by forward and backward passes over all its lines: the mean of the
marginal probability of `good`, weighted by the lines' lengths.

At most `sample` labelled documents of at most `train_chars` characters are
learned from, chosen by a hash of their ids. A null or empty text is one empty
line. Without labels of both kinds every score is 0.5. Repeated rows score
alike; rows are kept one to one with all their columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, trimmed

N_BINS, THRESHOLD = 10, 0.7
#: Byte classes whose share in a line is a feature.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"!", b"|", b"#$%&*@^~", b".,;:?'\"()-", b"<>{}[]=/\\_+`", bytes(range(128, 256))]


def class_table() -> bytes:
    t = bytearray([len(CLASSES)]) * 256
    for k, chars in enumerate(CLASSES):
        for c in chars:
            t[c] = k
    return bytes(t)


TABLE = class_table()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes plus 1, and the number of lines of each text.

    Lines are looked at one by one, so that no array is longer than the table of features or a line.
    """
    rows, n_lines, k = [], [], len(CLASSES) + 1
    for text in texts:
        own = (text or "").split("\n")
        n_lines.append(len(own))
        for x, again in zip(own, _repeats(own)):
            codes = x.encode("utf-8", "surrogatepass").translate(TABLE)
            words = x.split()
            rows.append((*map(codes.count, range(k)), len(codes), len(words), len(set(words)), again))
    counts, n_lines = np.array(rows, np.float64).reshape(len(rows), k + 4), np.array(n_lines, np.int64)
    shares, (size, n_words, distinct, again) = counts[:, :k], counts[:, k:].T
    some = np.maximum(n_words, 1)
    x = np.column_stack([shares / np.maximum(size, 1)[:, None], np.log1p(size), size / some, distinct / some, np.log1p(n_words), again, np.repeat(np.log1p(n_lines), n_lines)])
    return x, size.astype(np.int64) + 1, n_lines


def _repeats(own: list[str]) -> list[float]:
    seen: dict[str, int] = {}
    for x in own:
        seen[x] = seen.get(x, 0) + 1
    return [float(seen[x] > 1) for x in own]


@dataclass
class ChainModel:
    cuts: list[np.ndarray]  # bin edges of each feature
    weights: np.ndarray  # (this, previous, next) x features x (bins + 1); the last is `no such line`
    bias: float
    transitions: np.ndarray  # 2 x 2, from bad or good to bad or good
    known: bool = True
    scale: tuple[float, float] = (1.0, 0.0)  # of a score's log-odds: what makes it the chance of label 1

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], side="right").astype(np.uint8) for f, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), np.uint8)


def neighbours(bins: np.ndarray, n_lines: np.ndarray, none: int) -> np.ndarray:
    """Bins of each line, of the line before it and of the line after it: 3 x lines x features."""
    before, after = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    ends = np.cumsum(n_lines)
    before[ends - n_lines] = none
    after[ends - 1] = none
    return np.stack([bins, before, after])


def emissions(weights: np.ndarray, bias: float, near: np.ndarray) -> np.ndarray:
    """Log-odds of `good` that a line brings by itself."""
    e = np.full(near.shape[1], bias)
    for side in range(3):
        for f in range(near.shape[2]):
            e += weights[side, f][near[side, :, f]]
    return e


def marginals(e: np.ndarray, n_lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions of each kind, by forward and backward passes over all texts at once."""
    order = np.argsort(-n_lines, kind="stable")
    count, start = n_lines[order], (np.cumsum(n_lines) - n_lines)[order]
    longest = int(count[0]) if len(count) else 0
    unary = np.column_stack([np.zeros_like(e), e])
    alpha, beta = np.empty_like(unary), np.zeros_like(unary)
    active = np.searchsorted(-count, -np.arange(longest), side="left")  # texts with more than t lines
    for t in range(longest):
        at = start[: active[t]] + t
        if t:
            prev = alpha[at - 1]
            alpha[at] = np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1]) + unary[at]
        else:
            alpha[at] = unary[at]
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        ahead = beta[at + 1] + unary[at + 1]
        beta[at] = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
    both = alpha + beta
    z = np.logaddexp(both[:, 0], both[:, 1])
    first = np.ones(len(e), bool)
    first[np.cumsum(n_lines) - n_lines] = False
    to = np.flatnonzero(first)
    pair = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            pair[a, b] = np.exp(alpha[to - 1, a] + trans[a, b] + unary[to, b] + beta[to, b] - z[to]).sum()
    return np.exp(both[:, 1] - z), pair


def train(texts: list[str], labels: list[int], steps: int = 150, rate: float = 0.05, decay: float = 1e-3) -> ChainModel:
    x, size, n_lines = line_features(texts)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, N_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = ChainModel(cuts, np.zeros((3, len(cuts), N_BINS + 2)), 0.0, np.zeros((2, 2)), len(set(labels)) > 1)
    if not model.known:
        return model
    near = neighbours(model.bins(x), n_lines, N_BINS + 1)
    y = np.repeat(np.array(labels, np.float64), n_lines)
    inner = np.repeat(n_lines - 1, 1)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = inner[np.array(labels) == label].sum()
    theta, m, v = np.zeros(model.weights.size + 5), 0.0, 0.0
    n = len(texts)
    for k in range(1, steps + 1):
        w, bias, trans = theta[:-5].reshape(model.weights.shape), theta[-5], theta[-4:].reshape(2, 2)
        p, pair = marginals(emissions(w, bias, near), n_lines, trans)
        r = p - y
        g = np.zeros_like(w)
        for side in range(3):
            for f in range(w.shape[1]):
                g[side, f] = np.bincount(near[side, :, f], weights=r, minlength=w.shape[2])
        grad = np.concatenate([g.ravel(), [r.sum()], (pair - seen).ravel()]) / n + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model.weights, model.bias, model.transitions = theta[:-5].reshape(model.weights.shape), float(theta[-5]), theta[-4:].reshape(2, 2)
    p, _ = marginals(emissions(model.weights, model.bias, near), n_lines, model.transitions)
    model.scale = _platt(by_length(p, size, n_lines), np.array(labels, np.float64))
    return model


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic regression of labels on a score's log-odds; the slope stays positive."""
    x, theta = np.column_stack([_log_odds(s), np.ones(len(s))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ theta))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(h, x.T @ (p - y) + 1e-3 * (theta - [1.0, 0.0]))
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 and np.isfinite(theta).all() else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, train_chars: int = 50_000, seed: int = 0, **options) -> ChainModel:
    """Learn from (doc_id, text) and (doc_id, quality); the sample is bounded by `sample` rows of `train_chars` characters."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("quality").alias("__q"))
        .distinct()
        .orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id", "__q")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").where(F.length("text") <= train_chars).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "__q", "text").limit(2 * sample).collect()
    model = train([r.text for r in rows], [r["__q"] for r in rows], **options)
    del rows
    trimmed()
    return model


def by_length(p: np.ndarray, size: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Mean of the lines' marginals of each text, weighted by length."""
    at = np.cumsum(n_lines) - n_lines
    return np.clip(np.add.reduceat(p * size, at) / np.add.reduceat(size, at), 0.0, 1.0)


def score_texts(model: ChainModel, texts: list[str | None]) -> np.ndarray:
    if not model.known:
        return np.full(len(texts), 0.5)
    x, size, n_lines = line_features(texts)
    p, _ = marginals(emissions(model.weights, model.bias, neighbours(model.bins(x), n_lines, N_BINS + 1)), n_lines, model.transitions)
    return 1 / (1 + np.exp(-(model.scale[0] * _log_odds(by_length(p, size, n_lines)) + model.scale[1])))


def score(df: DataFrame, model: ChainModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from `threshold` on); they replace columns of these names."""
    new = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    own = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in own]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = score_texts(sent.value, part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, *new])

    return df.mapInArrow(run, T.StructType([*own, *(T.StructField(n, t) for n, t in new.items())]))
