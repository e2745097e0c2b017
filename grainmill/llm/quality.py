"""Quality classifier with hierarchical empirical Bayes: document evidence under host and path-level site posteriors.

Two logistic models (good quality, toxic) over the presence of hashed words and the shares of character classes are fitted on
at most ``sample_rows`` labelled documents, chosen by id hash, and calibrated on a fifth of them. Texts are turned into features
where they are read; the driver gets the few words that go with a label more than chance allows, and of each labelled document
those of its words and its shape. The models give every document the log-odds of being good: quality 1 and not toxic.

Grouped sums of these probabilities give each host and each path below it a posterior mean; a site of few documents is shrunk
toward its parent by a strength that is estimated from the variance between sites (analysis of variance), so a sparse path
leans on its host and a sparse host on the global mean. A document's own probability is left out of its sites' sums. Its score
replaces the global prior of its evidence by that of its path.

Evidence is computed once and written with the columns that are kept. Sums are pre-aggregated before the shuffle, so one source
with a third of all rows is one row a task. The site table is broadcast if it has at most ``broadcast_sites`` rows; beyond that
it is joined by shuffle, with the sites of more than a thousandth of all rows salted.

Cases: null and empty text have the evidence of a text without words; null hosts and paths are sites of their own; without
usable labels every document is kept; repeated rows count as documents and get equal scores; ids labelled twice count as
toxic if one label says so and as good if all do; an empty table gives no rows; further columns are kept, and columns named like results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm.bytesops import blocks, raw, word_hashes
from grainmill.llm.shared import fresh, hot_keys, join_salted, materialize, release, revive, small_batches, tidy

BITS = 18
_WORD = np.full(256, 32, np.uint8)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
#: capitals, digits, white space and single marks that junk is made of
_CLASSES = [range(65, 91), range(48, 58), [9, 10, 13, 32], b"!", b"$", b"#%&*", b"|", b".,;:?'", b"@<>=_{}[]\\/", range(128, 256)]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets of each row, the row of each, and a matrix of shape features."""
    n = len(offsets) - 1
    h, row, _, _ = word_hashes(_WORD[data], offsets)
    words = np.bincount(row, minlength=n)
    pair = np.unique((row.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    rows, ids = pair >> BITS, pair & ((1 << BITS) - 1)
    size = np.maximum(np.diff(offsets), 1)
    k = len(_CLASSES) + 1
    where = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(where * k + _CLASS[data], minlength=n * k).reshape(n, k) / size[:, None]
    distinct = np.bincount(rows, minlength=n)
    more = np.stack([np.log1p(np.diff(offsets)), words / size, distinct / np.maximum(words, 1)], axis=1)
    return ids, rows, np.concatenate([np.sqrt(shares), more], axis=1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights of both heads and the scaling of the shape features."""

    def __init__(self, words: np.ndarray, shape: np.ndarray, bias: np.ndarray, mean: np.ndarray, std: np.ndarray, slope: np.ndarray):
        self.words, self.shape, self.bias, self.mean, self.std, self.slope = words, shape, bias, mean, std, slope

    def logits(self, ids, rows, x) -> np.ndarray:
        x = np.clip((x - self.mean) / self.std, -6, 6)
        z = x @ self.shape + self.bias
        for c in range(2):
            z[:, c] += np.bincount(rows, weights=self.words[:, c][ids], minlength=len(x))
        return z * self.slope

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Log-odds that a document is of good quality and not toxic."""
        data, offsets = raw(column)
        out = [np.zeros(0)]
        for i, j in blocks(offsets, 1 << 19):
            z = self.logits(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            p = np.clip(sigmoid(z[:, 0]) * sigmoid(-z[:, 1]), 1e-6, 1 - 1e-6)
            out.append(np.log(p / (1 - p)))
        return np.concatenate(out)


def chosen_words(seen: np.ndarray, hits: np.ndarray, share: np.ndarray, least: int, least_z: float) -> np.ndarray:
    """Which words go with a label more than chance allows; the mass of rare words would only be learned by heart.

    seen: documents with each word; hits: those of them with each label; share: of each label in all documents.
    """
    spread = np.sqrt(seen[:, None] * share * (1 - share) + 1e-9)
    return (seen >= least) & (np.abs(hits - seen[:, None] * share) >= least_z * spread).any(axis=1)


def fit(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, labels: np.ndarray, held: np.ndarray, steps: int = 250, rate: float = 0.05) -> Model | None:
    """Both heads by full-batch Adam. ids, rows: chosen words and their documents; x: shapes; labels: quality and toxic; held: for calibration."""
    n = len(x)
    if not n:
        return None
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    weight = (~held).astype(float)
    # dense ids keep the gradient small
    used, dense = np.unique(ids, return_inverse=True)
    xs = np.clip((x - mean) / std, -6, 6)
    theta = [np.zeros((len(used), 2)), np.zeros((x.shape[1], 2)), np.zeros(2)]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    for t in range(1, steps + 1):
        z = xs @ theta[1] + theta[2]
        for c in range(2):
            z[:, c] += np.bincount(rows, weights=theta[0][:, c][dense], minlength=n)
        r = (sigmoid(z) - labels) * weight[:, None] / weight.sum()
        g = [np.stack([np.bincount(dense, weights=r[:, c][rows], minlength=len(used)) for c in range(2)], axis=1) + 1e-5 * theta[0], xs.T @ r + 1e-4 * theta[1], r.sum(axis=0)]
        for p, d, (a, b) in zip(theta, g, moments, strict=True):
            a[:] = 0.9 * a + 0.1 * d
            b[:] = 0.99 * b + 0.01 * d * d
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    words = np.zeros((1 << BITS, 2), np.float32)
    words[used] = theta[0]
    model = Model(words, theta[1], theta[2], mean, std, np.ones(2))
    if held.any():
        z = model.logits(ids, rows, x)[held]
        for c in range(2):
            loss = lambda s: -np.log(np.clip(sigmoid(np.where(labels[held][:, c] > 0, 1, -1) * s * z[:, c]), 1e-9, 1)).mean()  # noqa: B023, E731
            model.slope[c] = min(np.geomspace(0.1, 10, 41), key=loss)
    return model


def labelled_features(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, labels, words and shape of at most ``sample_rows`` labelled ids, chosen by hash. Their list has a proven bound and is broadcast."""
    known = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column(3))
            for i, j in blocks(offsets, 1 << 19):
                ids, row, x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))
                shape = pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), words, shape], ["doc_id", "quality", "toxic", "words", "shape"])

    src = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("double"), F.col("toxic").cast("double"), "text")
    seen = src.mapInArrow(tidy(run), "doc_id long, quality double, toxic double, words array<int>, shape array<double>")
    # of the texts of one id the same is taken whatever their order
    least = F.struct(F.col("shape"), F.col("words"), F.col("quality"), F.col("toxic"))
    with small_batches(docs.sparkSession):
        return materialize(seen.groupBy("doc_id").agg(F.min(least).alias("r")).select("doc_id", "r.*"), "labelled")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int, least: int = 5, least_z: float = 4.5) -> Model | None:
    """The model of the labelled documents. The driver gets counts of hashed words, at most 2^18 rows, and the features chosen by them."""
    sample = labelled_features(docs, labels, sample_rows).withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 4)
    own = sample.where("NOT held")
    total = own.agg(F.count(F.lit(1)), F.avg("quality"), F.avg("toxic")).first()
    if total[0] < 40:
        sample, own = sample.withColumn("held", F.lit(False)), sample
        total = own.agg(F.count(F.lit(1)), F.avg("quality"), F.avg("toxic")).first()
    if not total[0]:
        return None
    counts = own.select(F.explode("words").alias("word"), "quality", "toxic").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("t"))
    got = counts.where(F.col("n") >= least).toArrow()
    word, seen, q, t = (got.column(c).to_numpy() for c in ("word", "n", "q", "t"))
    share = np.clip(np.array(total[1:], float), 1e-6, 1 - 1e-6)
    words = word[chosen_words(seen.astype(float), np.stack([q, t], axis=1), share, least, least_z)]

    def only_chosen(batches):
        for batch in batches:
            lists = batch.column(5)
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            keep = np.isin(flat, words)
            at = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(lists)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(pa.array(at), pa.array(flat[keep]))], batch.schema.names)

    columns = "doc_id long, quality double, toxic double, held boolean, shape array<double>, words array<int>"
    rows = sample.select("doc_id", "quality", "toxic", "held", "shape", "words").mapInArrow(tidy(only_chosen), columns).toArrow().sort_by("doc_id")
    x = rows.column("shape").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    lists = rows.column("words").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    labels = np.stack([rows.column(c).to_numpy() for c in ("quality", "toxic")], axis=1)
    return fit(lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(rows.num_rows), sizes), x, labels, rows.column("held").to_numpy(zero_copy_only=False))


def with_evidence(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``evidence``: calibrated log-odds of being good, from the whole text."""
    if model is None:
        return docs.withColumn("evidence", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("double")
    def evidence(text: pa.Array) -> pa.Array:
        out = pa.array(revive(Model, shared.value).evidence(text), pa.float64())
        release()  # the worker lives on through later stages
        return out

    return docs.withColumn("evidence", evidence("text"))


def probability(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def strength(groups: DataFrame) -> float:
    """Prior strength of a level: within-group over between-group variance. groups: parent, n, s (sum), q (sum of squares)."""
    parent = groups.groupBy("parent").agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ssn"), F.sum("q").alias("Q"))
    r = parent.agg(F.sum(F.col("Q") - F.col("ssn")), F.sum(F.col("N") - F.col("k")), F.sum(F.col("ssn") - F.col("S") * F.col("S") / F.col("N")), F.sum(F.col("k") - 1), F.sum(F.col("N") - F.col("nn") / F.col("N"))).first()
    if not r[1] or not r[3] or not r[4]:
        return 10.0
    within = max(float(r[0]) / float(r[1]), 1e-6)
    between = max((float(r[2]) - float(r[3]) * within) / float(r[4]), 1e-6)
    return min(max(within / between, 1.0), 1e4)


def site_table(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Sums of every host and path, the global mean, and the prior strengths of both levels."""
    p = probability(F.col("evidence"))
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    mean = float(total[1] / total[0]) if total[0] else 0.5
    k_host = strength(hosts.select(F.lit(0).alias("parent"), F.col("host_n").alias("n"), F.col("host_s").alias("s"), F.col("host_q").alias("q")))
    k_path = strength(paths.select(F.col("host").alias("parent"), "n", "s", "q"))
    return materialize(paths.join(hosts, "host").drop("q", "host_q"), "site_sums"), mean, k_host, k_path


RESULTS = ("evidence", "host_posterior", "path_posterior", "score", "keep")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample_rows: int = 12_000, keep_from: float = 0.9, broadcast_sites: int = 100_000, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (those ``columns`` of it, all without) with ``evidence``, ``host_posterior``, ``path_posterior``, ``score`` and ``keep``."""
    model = learn(docs, labels, sample_rows)
    columns = [c for c in columns or docs.columns if c not in RESULTS]
    site = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("none"))
    inner = {c: fresh(docs, c) for c in ("_host", "_path", "_n", "_s", "_host_n", "_host_s")}
    wide = docs.withColumn(inner["_host"], site(host)).withColumn(inner["_path"], site(path)).drop(*RESULTS)
    with small_batches(docs.sparkSession):
        marked = materialize(with_evidence(wide, model).select(*columns, inner["_host"], inner["_path"], "evidence"), "evidence")
    sums, mean, k_host, k_path = site_table(marked.select(F.col(inner["_host"]).alias("host"), F.col(inner["_path"]).alias("path"), "evidence"))
    sums = sums.select(*(F.col(c).alias(inner[f"_{c}"]) for c in sums.columns))
    keys = [inner["_host"], inner["_path"]]
    if sums.limit(broadcast_sites + 1).count() <= broadcast_sites:
        out = marked.join(F.broadcast(sums), keys)
    else:
        hot = hot_keys(sums.withColumn("_copies", F.col(inner["_n"])), keys, "_copies", marked.count())
        out = join_salted(marked, sums, keys, hot, F.struct("evidence", F.monotonically_increasing_id()))
    n, own, host_n, host_s = (F.col(inner[c]) for c in ("_n", "_s", "_host_n", "_host_s"))
    p = probability(F.col("evidence"))
    out = out.withColumn("host_posterior", (k_host * mean + host_s - p) / (k_host + host_n - 1))
    out = out.withColumn("path_posterior", (k_path * F.col("host_posterior") + own - p) / (k_path + n - 1))
    out = out.withColumn("score", probability(F.col("evidence") + logit(F.col("path_posterior")) - logit(F.lit(mean))))
    return out.withColumn("keep", F.lit(True) if model is None else F.col("score") >= keep_from).drop(*inner.values())
