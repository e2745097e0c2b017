"""Benchmark decontamination: every training passage is a BM25 query against an inverted index of test items.

Items become postings (term hash, item, BM25 impact divided by the item's own total, so that a score is the matched share of
an item in 0..1). Items are grouped into bands by the power of two that holds their length; passages are twice that long and half
overlapping, so every copy of an item lies whole in one passage; in a band, items of neighbouring lengths form blocks.

Retrieval is block-max WAND on a batch of passages at once. The terms of an item that together cannot reach the threshold less
``slack`` are its non-essential lists. From the other, essential lists a passage gets an upper bound per block (block maxima of
the lists it holds plus the block's largest non-essential rest); blocks whose bound misses the threshold are skipped, the items
of the other blocks are scored exactly, and all that reach the threshold are retrieved. Every retrieved item is then verified
with 5-word shingles: the shares of its question (all but its last sentence) and of its answer (the last sentence) that the
passage holds must both reach ``overlap``, or that of the whole item must.

Term frequencies are counted by Spark over all items. The index is cut into shards of about ``shard_bytes`` of item text, which
tasks build; shards are broadcast together up to ``broadcast_bytes`` of index. Documents are read where they are and never shuffled.

Cases: null and empty texts have no passages; items without words are ignored; repeated items are all reported; very long
texts are scanned whole, in bounded blocks of rows; no items or no documents give no hits; further columns are kept.
"""

from __future__ import annotations

import pickle
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainmill.llm.bytesops import blocks, mix, raw, word_hashes
from grainmill.llm.shared import fresh, materialize, release, revive

K1, B = 1.2, 0.75
BLOCK = 8
WORD_BYTES = 40
ITEM_SCHEMA = "item_row long, item_id long, words int, sizes array<int>, terms array<bigint>, tf array<int>, q array<bigint>, a array<bigint>, w array<bigint>"
HIT = "array<struct<item_id:bigint,passage:int,score:double,question:double,answer:double,whole:double>>"
_WORD = np.full(256, 32, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of a word sequence, one a start; of the whole sequence if it is shorter."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    out = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        out += h[j : n - size + 1 + j] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1) ** 3 | 1) % (1 << 64))
    return mix(out + np.uint64(size))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last sentence or line is the answer if another stands before it."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(_WORD[data], np.array([0, len(data)]))[0]


def item_terms(items: DataFrame) -> DataFrame:
    """Terms with frequencies and the question, answer and whole shingles of every item that has words."""

    def run(batches):
        for batch in batches:
            out = []
            for row, item, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = _hashes(text)
                if not len(h):
                    continue
                terms, tf = np.unique(h, return_counts=True)
                question, answer = split_item(text)
                words = [_hashes(x) for x in (question, answer, text)]
                sets = [np.unique(shingles(x)).view(np.int64) for x in words]
                out.append((row, item, len(h), [min(5, max(1, len(x))) for x in words], terms.view(np.int64), tf.astype(np.int32), *sets))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["item_row", "item_id", "words", "sizes", "terms", "tf", "q", "a", "w"])

    src = items.where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long").alias("item_id"), "text")
    return src.mapInArrow(run, ITEM_SCHEMA)


class Band:
    """Index of the items of similar length: essential block postings, exact postings by block, shingles."""

    def __init__(self, rows: list, step: int, df: dict[int, int], n_items: int, mean_words: float, threshold: float, slack: float):
        rows = sorted(rows, key=lambda r: (r["words"], r["item_row"]))
        self.step = step
        self.ids = [r["item_id"] for r in rows]
        self.sets = [tuple((np.array(r[c], np.int64).view(np.uint64), k) for c, k in zip(("q", "a", "w"), r["sizes"], strict=True)) for r in rows]
        n_blocks = -(-len(rows) // BLOCK)
        self.rest = np.zeros(n_blocks)
        essential: dict[tuple[int, int], float] = {}
        self.exact: list[tuple[np.ndarray, np.ndarray]] = []
        for b in range(n_blocks):
            table: dict[int, np.ndarray] = {}
            for k, r in enumerate(rows[b * BLOCK : (b + 1) * BLOCK]):
                tf = np.array(r["tf"], float)
                d = np.array([df[t] for t in r["terms"]], float)
                impact = np.log1p((n_items - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * r["words"] / mean_words))
                impact /= impact.sum()
                order = np.argsort(impact, kind="stable")
                rest = np.cumsum(impact[order])
                free = int(np.searchsorted(rest, threshold - slack, side="right"))
                self.rest[b] = max(self.rest[b], rest[free - 1] if free else 0.0)
                for j, t in enumerate(r["terms"]):
                    table.setdefault(t, np.zeros(BLOCK))[k] = impact[j]
                for j in order[free:]:
                    key = (r["terms"][j], b)
                    essential[key] = max(essential.get(key, 0.0), impact[j])
            terms = np.array(sorted(table), np.int64).view(np.uint64)
            at = np.argsort(terms)
            self.exact.append((terms[at], np.array([table[t] for t in sorted(table)])[at]))
        keys = np.array([t for t, _ in essential], np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        self.terms, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.block = np.array([b for _, b in essential], np.int64)[order]
        self.bound = np.array(list(essential.values()))[order]

    def search(self, h: np.ndarray, word_at: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
        """(document, passage, item, score, overlaps) of every retrieved and verified pair; word_at: first word of each row."""
        if not len(self.terms) or not len(h):
            return []
        step, n_blocks = self.step, len(self.rest)
        term = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        pos = np.flatnonzero(self.terms[term] == h)
        if not len(pos):
            return []
        term = term[pos]
        doc = np.searchsorted(word_at, pos, side="right") - 1
        words = np.diff(word_at)
        passages = np.maximum(-(-words // step) - 1, 1)
        base = np.concatenate([[0], np.cumsum(passages)])
        local = (pos - word_at[doc]) // step
        # a position lies in the passage that starts at or before it and in the one before that
        cell, t = [], []
        for back in (0, 1):
            w = local - back
            ok = (w >= 0) & (w < passages[doc])
            cell.append(base[doc[ok]] + w[ok])
            t.append(term[ok])
        cell, t = np.concatenate(cell), np.concatenate(t)
        pair = np.unique(cell * len(self.terms) + t)
        cell, t = pair // len(self.terms), pair % len(self.terms)
        lists = self.first[t + 1] - self.first[t]
        at = np.repeat(self.first[t] - np.cumsum(lists) + lists, lists) + np.arange(lists.sum())
        key, inverse = np.unique(np.repeat(cell, lists) * n_blocks + self.block[at], return_inverse=True)
        bound = np.bincount(inverse, weights=self.bound[at])
        alive = key[bound + self.rest[key % n_blocks] >= threshold - 1e-9]
        out, last, own, grams, seen, d = [], -1, None, {}, None, 0
        for k in alive:
            c, b = int(k // n_blocks), int(k % n_blocks)
            if c != last:
                d = int(np.searchsorted(base, c, side="right") - 1)
                start = word_at[d] + (c - base[d]) * step
                own = h[start : min(start + 2 * step, word_at[d + 1])]
                grams, last, seen = {}, c, np.unique(own)
            terms, impact = self.exact[b]
            i = np.minimum(np.searchsorted(seen, terms), len(seen) - 1)
            score = impact[seen[i] == terms].sum(axis=0)
            for j in np.flatnonzero(score >= threshold - 1e-9):
                item = b * BLOCK + int(j)
                if item >= len(self.ids):
                    continue
                parts = []
                for s, size in self.sets[item]:
                    if size not in grams:
                        grams[size] = np.unique(shingles(own, size)) if len(own) >= size else np.zeros(0, np.uint64)
                    parts.append(float(np.isin(s, grams[size]).mean()) if len(s) else 1.0)
                q, a, w = parts
                if (q >= overlap and a >= overlap) or w >= overlap:
                    out.append((d, c - int(base[d]), self.ids[item], float(score[j]), q, a, w))
        return out


def build(items: DataFrame, threshold: float, slack: float, shard_bytes: int) -> DataFrame | None:
    """The index: shard and pickled attributes of a band, one row a band of a shard; None without items.

    Tasks build it, a group of at most about ``shard_bytes`` of item text each, with the document frequencies of its own terms beside it.
    """
    terms = materialize(item_terms(items), "items")
    n_items, mean_words, n_words = terms.agg(F.count(F.lit(1)), F.avg("words"), F.sum("words")).first()
    if not n_items:
        return None
    n_shards = int(-(-n_words * WORD_BYTES // shard_bytes))
    band = F.ceil(F.log2(F.greatest("words", F.lit(32)))).cast("int")
    dealt = terms.withColumns({"shard": F.pmod(F.xxhash64("item_row"), F.lit(n_shards)).cast("int"), "band": band})
    each = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = dealt.select("shard", "band", F.explode("terms").alias("term")).distinct().join(each, "term").select(F.col("shard").alias("own_shard"), F.col("band").alias("own_band"), "term", "df")

    def index(rows: pa.Table, counts: pa.Table) -> pa.Table:
        df = dict(zip(counts["term"].to_pylist(), counts["df"].to_pylist(), strict=True))
        shard, power = rows["shard"][0].as_py(), rows["band"][0].as_py()
        state = vars(Band(rows.to_pylist(), 1 << power, df, n_items, mean_words, threshold, slack))
        return pa.table({"shard": pa.array([shard], pa.int32()), "state": pa.array([pickle.dumps(state)], pa.binary())})

    return materialize(dealt.groupBy("shard", "band").cogroup(own.groupBy("own_shard", "own_band")).applyInArrow(index, "shard int, state binary"), "index")


def rounds(index: DataFrame, most: int) -> list[list[int]]:
    """Shards that are searched together: as many as stay within ``most`` bytes of index, at least one."""
    out, size = [], 0
    for shard, n in index.groupBy("shard").agg(F.sum(F.octet_length("state"))).orderBy("shard").collect():  # two numbers a shard
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(shard)
        size += n
    return out


def with_hits(docs: DataFrame, items: DataFrame, threshold: float = 0.5, slack: float = 0.3, overlap: float = 0.8, shard_bytes: int = 16 << 20, broadcast_bytes: int = 128 << 20) -> DataFrame:
    """``docs`` with ``hits``: the test items that it holds, with their passage, BM25 score and overlaps.

    The documents are read once for every ``broadcast_bytes`` of index. Where that is more than once, the hits of a round are written before
    the next is sent, and the driver passes on the bytes of one round at a time.
    """
    spark = docs.sparkSession
    docs = docs.drop("hits")
    index = build(items, threshold, slack, shard_bytes)
    if index is None:
        return docs.withColumn("hits", F.array().cast(HIT))
    together = rounds(index, broadcast_bytes)
    sent = lambda shards: spark.sparkContext.broadcast([bytes(r["state"]) for r in index.where(F.col("shard").isin(shards)).collect()])
    if len(together) == 1:
        return docs.withColumn("hits", searcher(sent(together[0]), threshold, overlap)("text"))
    row = fresh(docs, "row_id")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    parts = []
    for shards in together:
        states = sent(shards)
        parts.append(materialize(docs.select(row, searcher(states, threshold, overlap)("text").alias("hits")).where(F.size("hits") > 0), "hits"))
        states.destroy()
    each = reduce(DataFrame.unionByName, parts)
    merged = each.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))  # at most one list a round
    return docs.join(merged, row, "left").withColumn("hits", F.coalesce("hits", F.array().cast(HIT))).drop(row)


def searcher(shared, threshold: float, overlap: float):
    """A column function from texts to their verified hits in the bands whose pickled attributes are broadcast."""
    bands: list[Band] = []  # filled once a task

    @F.arrow_udf(HIT)
    def search(text: pa.Array) -> pa.Array:
        found: list[list] = [[] for _ in range(len(text))]
        if not bands:
            bands.extend(revive(Band, pickle.loads(state)) for state in shared.value)
        data, offsets = raw(text)
        for i, j in blocks(offsets, 1 << 19):
            h, row, _, _ = word_hashes(_WORD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
            word_at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
            for band in bands:
                for d, passage, item, score, q, a, w in band.search(h, word_at, threshold, overlap):
                    found[i + d].append({"item_id": item, "passage": passage, "score": score, "question": q, "answer": a, "whole": w})
        release()  # the worker lives on through later stages
        return pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("passage", pa.int32()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("whole", pa.float64())])))

    return search


def decontaminate(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    kept, own = docs, None
    if "hits" in {c.lower() for c in docs.columns}:
        own = next(c for c in docs.columns if c.lower() == "hits")
        kept = docs.withColumnRenamed(own, fresh(docs, "hits"))
    out = with_hits(kept, items, **parameters).where(F.size("hits") == 0).drop("hits")
    return out if own is None else out.withColumnRenamed(fresh(docs, "hits"), own)
