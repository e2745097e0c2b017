"""Ranked lexical search: every item against all documents, by an integer form of BM25 over postings in term buckets.

1. *Tokens.* Arrow tasks find the terms of whole texts and count those that items hold; a document is one row with its length,
   the numbers of those terms and how often each occurs.
2. *Postings.* The rows are dealt by document and exploded to postings (bucket, term, document, occurrences, length norm). A
   bucket is a hash of the term. All postings of a document lie in one partition, so what belongs to an item and a document
   never travels; a term that most documents hold is spread like any other.
3. *Score.* Item terms, with weight and repeats, join the postings on (bucket, term); every match is scored in whole numbers, and
   matches are summed by item and document where they are.
4. *Rank.* ``row_number`` over each item; every partition sends its own ``k`` best of an item only.

Terms of the items are broadcast up to ``most_terms`` (item, term) pairs. Beyond it texts give all their terms and the joins are
shuffled by Spark; the result is the same.

Cases: null texts have no terms, as documents or items; documents without terms don't count in N and are never ranked; items without
terms, or whose terms occur nowhere, have no rows; score 0 is no hit; every row of ``items`` is an item of its own, equal or null ids
included; repeated documents are ranked each; ties go to the smaller ``doc_id``, null last; empty tables give an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainmill.llm.bytesops import blocks, raw, term_bytes, word_hashes
from grainmill.llm.shared import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BUCKETS = 64
INDEX = "row_id long, doc_id long, n long, terms array<string>, tfs array<int>"


def item_terms(items: DataFrame) -> DataFrame:
    """``item`` (a number for each row), ``item_id``, ``term`` and ``times``."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.translate("text", UPPER, UPPER.lower()).alias("text"))
    found = rows.select("item", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    return found.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class Vocabulary:
    """Terms by the hash of their bytes; equal hashes are told apart by the bytes."""

    def __init__(self, terms: list[str]):
        data = [t.encode() for t in terms]
        joined = np.frombuffer(b" ".join(data), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in data]) - 1 if data else np.zeros(0, np.int64)
        starts = ends - np.array([len(t) for t in data], np.int64)
        hashes = word_hashes(joined, np.array([0, len(joined)]), term_bytes())[0]
        order = np.argsort(hashes)
        if (np.diff(hashes[order]) == 0).any():
            raise ValueError("two terms share a 64-bit hash")
        self.terms, self.data, self.hashes, self.starts, self.sizes, self.order = pa.array(terms, pa.string()), joined, hashes[order], starts, ends - starts, order

    def numbers(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 if it is none. ``data`` has lower-case letters."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == hashes, self.order[at], -1)
        out[(out >= 0) & (self.sizes[out] != sizes)] = -1
        hit = np.flatnonzero(out >= 0)
        if len(hit):
            size = sizes[hit]
            cuts = np.cumsum(size) - size
            within = np.arange(size.sum()) - np.repeat(cuts, size)
            same = data[np.repeat(starts[hit], size) + within] == self.data[np.repeat(self.starts[out[hit]], size) + within]
            out[hit[~np.logical_and.reduceat(same, cuts)]] = -1
        return out


def counted(batches: Iterator[pa.RecordBatch], wanted: list[str] | None) -> Iterator[pa.RecordBatch]:
    """Per document its number of terms, and those of ``wanted`` (None: all) with their counts."""
    known = None if wanted is None else Vocabulary(wanted)
    for batch in batches:
        whole, offsets = raw(batch.column(2))
        for i, j in blocks(offsets):
            data, cuts = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            hashes, row, starts, ends = word_hashes(data, cuts, term_bytes())
            lower = data.copy()
            lower[(lower >= 65) & (lower <= 90)] += 32
            if known is None:
                text = lower.tobytes()
                own = Vocabulary(list(dict.fromkeys(text[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))))
            else:
                own = known
            number = own.numbers(hashes, lower, starts, ends - starts)
            held = number >= 0
            pair, tf = np.unique(row[held] * max(len(own.terms), 1) + number[held], return_counts=True)
            owner, term = np.divmod(pair, max(len(own.terms), 1))
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=j - i))]).astype(np.int32))
            n = np.bincount(row, minlength=j - i)
            terms = pa.ListArray.from_arrays(at, own.terms.take(pa.array(term)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), terms, pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))], ["row_id", "doc_id", "n", "terms", "tfs"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, most_terms: int = 300_000) -> DataFrame:
    """The ``k`` documents of highest score of every item: item_id, rank, doc_id, score."""
    asked = materialize(item_terms(items), "item_terms")
    small = asked.count() <= most_terms
    wanted = [r["term"] for r in asked.select("term").distinct().collect()] if small else None
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = materialize(rows.mapInArrow(lambda batches: counted(batches, wanted), INDEX).where("n > 0"), "index")
    whole = index.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    documents, length = whole["N"], whole["L"] or 1
    # weights of the terms that items hold; only whole numbers leave the logarithm
    frequency = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    weighed = asked.join(frequency, "term").select("item", "item_id", "term", (F.col("times") * weight).alias("weight"), bucket).where("weight > 0")
    weighed = materialize(weighed, "weighed")
    norm = (25 + F.expr(f"(75L * n * {documents}L) div {length}L")).alias("m")
    dealt = index.repartition("row_id").select("row_id", "doc_id", norm, F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    postings = dealt.select("row_id", "doc_id", "m", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    met = postings.join(F.broadcast(weighed) if small else weighed, ["bucket", "term"])
    scored = met.select("item", "item_id", "row_id", "doc_id", F.expr("weight * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("score"))
    summed = scored.groupBy("row_id", "item", "item_id", "doc_id").agg(F.sum("score").alias("score")).where("score > 0")
    rank = F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST, row_id)")
    return summed.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
