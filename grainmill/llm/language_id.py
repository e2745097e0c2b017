"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are byte n-grams of the lower-cased text with everything but letters read as a space. A document's vector is the
mean of its subword embeddings and a linear softmax reads the language from it. As that layer is linear, prediction adds up
one row of class scores per subword (embedding times weights, multiplied out once), over the whole text.

Training takes at most about ``sample_rows`` different labelled rows, chosen evenly over all languages (more than 4096 of them are an
error) by a hash of the row; a fifth of
them is held back to fit a temperature (so that the score is a calibrated probability) and a rejection threshold, the score
below which calibration rows were more often wrong than ``1 - target_precision`` allows. The model has a fixed size.

Cases: null text or text without any letter is ``und`` with score 0; an empty training set gives ``und`` for all; rows with
null language are never learned from but get a prediction; repeated rows get equal predictions; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from grainmill.llm.bytesops import blocks, raw

ORDERS = (2, 3, 4)
BITS = 15
#: ASCII letters and all bytes of longer characters stay, the rest reads as a space
_LETTER = np.full(256, 32, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams within each row and the row of each; n-grams with a double space are left out."""
    x = _LETTER[data]
    n = len(x)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out, rows = [], []
    gap = (x[1:] == 32) & (x[:-1] == 32) if n > 1 else np.zeros(0, bool)
    gaps = np.concatenate([[0], np.cumsum(gap)])
    for k in ORDERS:
        m = n - k + 1
        if m <= 0:
            continue
        g = np.zeros(m, np.uint32)
        for j in range(k):
            g = g * np.uint32(0x01000193) ^ x[j : j + m] * np.uint32(0x9E3779B1 + 2 * k)
        keep = (row[:m] == row[k - 1 :]) & (gaps[k - 1 : k - 1 + m] == gaps[:m])
        out.append((g[keep] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
        rows.append(row[:m][keep])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows)


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text and their shares."""
    out = []
    for t in texts:
        b = np.frombuffer(t.lower().encode(), np.uint8)
        ids, _ = subwords(b, np.array([0, len(b)]))
        u, c = np.unique(ids, return_counts=True)
        out.append((u, c / max(1, c.sum())))
    return out


class Model:
    """Class scores per subword bucket, temperature and rejection threshold."""

    def __init__(self, labels: list[str], table: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.labels, self.table, self.temperature, self.threshold = labels, table.astype(np.float32), temperature, threshold

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the labels for each row."""
        n = len(offsets) - 1
        logits = np.zeros((n, len(self.labels)))
        for i, j in blocks(offsets, 1 << 20):
            ids, rows = subwords(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = np.maximum(np.bincount(rows, minlength=j - i), 1)
            for c in range(len(self.labels)):
                logits[i:j, c] = np.bincount(rows, weights=self.table[:, c][ids], minlength=j - i) / size
        return self.probabilities(logits)


def train(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 5, rate: float = 0.5, target_precision: float = 0.99, seed: int = 7) -> Model | None:
    """Fit embeddings and softmax by plain SGD, one document a step, then temperature and threshold on held-back rows."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1.0 / dim, 1.0 / dim, (1 << BITS, dim))
    w = np.zeros((dim, len(labels)))
    feats, y = _counts(texts), np.array([labels.index(x) for x in langs])
    order = rng.permutation(len(y))
    held, fit = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order[:0], order)
    steps = epochs * len(fit)
    for t, i in enumerate(np.concatenate([rng.permutation(fit) for _ in range(epochs)])):
        ids, share = feats[i]
        if not len(ids):
            continue
        h = share @ emb[ids]
        z = h @ w
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[i]] -= 1
        lr = rate * (1 - t / steps)
        back = w @ p
        w -= lr * 10 * np.outer(h, p)
        emb[ids] -= lr * np.outer(share * np.sqrt(len(ids)), back)
    model = Model(labels, emb @ w)
    if len(held):
        logits = np.array([feats[i][1] @ model.table[feats[i][0]] if len(feats[i][0]) else np.zeros(len(labels)) for i in held])

        def loss(temperature: float) -> float:
            model.temperature = temperature
            return -float(np.log(np.maximum(model.probabilities(logits)[np.arange(len(held)), y[held]], 1e-12)).mean())

        model.temperature = min(np.geomspace(0.02, 20, 61), key=loss)
        p = model.probabilities(logits)
        best, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        by = np.argsort(-best)
        good = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= target_precision)
        model.threshold = float(best[by][good[-1]]) if len(good) else 1.0
    return model


def sample_labelled(docs: DataFrame, sample_rows: int, most_labels: int = 4096) -> tuple[list[str], list[str]]:
    """About ``sample_rows`` different labelled rows, equally many of each language where there are enough, chosen by their hash."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(most_labels + 1).collect()}
    if not counts:
        return [], []
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} languages")
    each = max(1, sample_rows // len(counts))
    rates = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))))
    row = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), "text", "lang")
    chosen = labelled.select("text", "lang", row.alias("o")).where(F.pmod("o", F.lit(1 << 30)) / float(1 << 30) < rates[F.col("lang")])
    # a row that repeats very often counts once
    rows = chosen.dropDuplicates(["o"]).orderBy("o").limit(2 * sample_rows + len(counts)).collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``accepted`` (the score reaches the rejection threshold) to ``docs``."""
    state = None if model is None else (model.labels, model.table, model.temperature, model.threshold)
    shared = docs.sparkSession.sparkContext.broadcast(state)
    names = docs.columns
    lower = F.when(F.col("text").rlike(r"\p{L}"), F.lower("text"))

    def run(batches):
        m = Model(*shared.value) if shared.value else None
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            if m is None:
                pred, score, ok = ["und"] * len(text), np.zeros(len(text)), [False] * len(text)
            else:
                p = m.score(*raw(text))
                none = np.asarray(text.is_null())
                pred = np.where(none, "und", np.array(m.labels, object)[p.argmax(axis=1)])
                score = np.where(none, 0.0, p.max(axis=1))
                ok = (score >= m.threshold) & ~none
            extra = [pa.array(list(pred), pa.string()), pa.array(score, pa.float64()), pa.array(list(map(bool, ok)), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], [*names, "lang_pred", "score", "accepted"])

    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return docs.withColumn("_lower", lower).mapInArrow(run, schema)


def identify(docs: DataFrame, held_out: Column, sample_rows: int = 6000) -> DataFrame:
    """Learn from the rows that are not ``held_out`` and predict all: doc_id, held_out, lang_pred, score, accepted."""
    model = train(*sample_labelled(docs.where(~held_out), sample_rows))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return predict(src, model).drop("text")
