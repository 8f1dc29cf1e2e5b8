"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are its words and their character n-grams of 3 letters,
hashed into buckets with one embedding each; the mean embedding goes through a
linear softmax. Both are trained by stochastic gradient descent in numpy, on at
most `sample` labelled documents of at most `train_chars` characters each,
chosen by a hash of their ids. A part of the sample sets the temperature that
calibrates probabilities and the threshold below which a text is rejected.

Every text is scored whole. A text that is null or has no letter is `und` with
score 0, and rejected. Ties go to the first language in alphabetical order.
Without any labelled row all texts are `und`. Repeated rows are scored alike;
rows are kept one to one with all their columns.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, trimmed

UNDETERMINED = "und"
CACHE_WORDS = 500_000


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # buckets x languages: embeddings times the softmax's matrix
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def grams(self, word: str) -> np.ndarray:
        """Buckets of a word: the word and its character trigrams; none if it has no letter."""
        return grams(word, len(self.weights))


def grams(word: str, buckets: int) -> np.ndarray:
    w = word.lower().strip(".,;:!?\"'()[]*#$%&|-")
    if not any(map(str.isalpha, w)):
        return np.empty(0, np.int64)
    w = f"<{w}>"
    pieces = [w] + [w[i : i + 3] for i in range(len(w) - 2)]
    return np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) % buckets for p in pieces], np.int64)


def bag(text: str, buckets: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    parts = [cache[w] if w in cache else cache.setdefault(w, grams(w, buckets)) for w in text.split()]
    ids, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
    return ids, n / max(1, n.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], buckets: int = 1 << 16, dim: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 0, reject_share: float = 0.002) -> LanguageModel:
    names = sorted(set(langs))
    cache: dict = {}
    bags = [bag(t, buckets, cache) for t in texts]
    y = np.array([names.index(x) for x in langs], np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation([i for i, (ids, _) in enumerate(bags) if len(ids)])
    held = order[: len(order) // 5]
    fit = order[len(held) :]
    emb = rng.normal(0, 1 / dim, (buckets, dim))
    out, bias = np.zeros((dim, max(1, len(names)))), np.zeros(max(1, len(names)))
    steps = max(1, epochs * len(fit))
    k = 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, share = bags[i]
            x = share @ emb[ids]
            g = softmax(x @ out + bias)
            g[y[i]] -= 1
            step = rate * (1 - k / steps)
            back = out @ g
            out -= step * np.outer(x, g)
            bias -= 0.1 * step * g
            emb[ids] -= (20 * step) * share[:, None] * back  # shares are small where a text is long
            k += 1
    model = LanguageModel(names, (emb @ out).astype(np.float64), bias)
    if len(held):
        z = np.stack([s @ model.weights[i] + bias for i, s in (bags[h] for h in held)])
        grid = np.exp(np.linspace(-2.5, 2.5, 51))
        loss = [-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        top = softmax(z / model.temperature).max(axis=1)
        model.threshold = float(min(0.5, np.quantile(top, reject_share)))
    return model


def fit(docs: DataFrame, sample: int = 3000, train_chars: int = 50_000, seed: int = 0, **options) -> LanguageModel:
    """Learn from (doc_id, text, lang) rows with both; the sample is bounded by `sample` rows of `train_chars` characters."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= train_chars))
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = known.select("doc_id", h.alias("h")).distinct().orderBy("h", "doc_id").limit(sample)  # ids first: texts come for these only
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").orderBy("h", "doc_id", "text", "lang").limit(sample).collect()
    model = train([r.text for r in rows], [r.lang for r in rows], seed=seed, **options)
    del rows
    trimmed()
    return model


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred, score (calibrated probability) and rejected; they replace columns of these names."""
    new = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    own = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in own]
    sent = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(batches):
        m, k = sent.value, len(sent.value.langs)
        ids: dict[str, int] = {}
        rows = np.zeros((1024, k + 1))

        def add(words):
            nonlocal rows
            for w in words:
                if w not in ids:
                    if len(ids) == len(rows):
                        rows = np.concatenate([rows, np.zeros_like(rows)])
                    g = m.grams(w)
                    rows[len(ids)] = [*m.weights[g].sum(axis=0), len(g)] if k and len(g) else 0
                    ids[w] = len(ids)

        for batch in batches:
            for part in slices(batch):
                sums, flat, owners = np.zeros((part.num_rows, k + 1)), [], []
                if len(ids) > CACHE_WORDS:
                    ids.clear()
                for i, t in enumerate(part.column(text).to_pylist()):
                    words = t.split() if t else ()
                    if words:
                        try:
                            at = [ids[w] for w in words]
                        except KeyError:
                            add(words)
                            at = [ids[w] for w in words]
                        flat.append(np.array(at, np.int32))
                        owners.append(i)
                if flat:
                    starts = np.cumsum([0, *map(len, flat)])[:-1]
                    sums[owners] = np.add.reduceat(rows[np.concatenate(flat)], starts, axis=0)
                known = sums[:, -1] > 0
                p = softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1) + m.bias[:k]) / m.temperature) if k else np.zeros((part.num_rows, 1))
                score = np.where(known, p.max(axis=1), 0.0)
                best = p.argmax(axis=1)
                lang = [m.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score), pa.array(~known | (score < m.threshold))], names=[*names, *new])

    return df.mapInArrow(run, T.StructType([*own, *(T.StructField(n, t) for n, t in new.items())]))
