"""Removal of repeated byte strings: each byte covered by a ``length``-byte string that starts anywhere else in the corpus too.

A suffix array of the corpus would be one unsplittable structure, so equal strings are first brought together by content: the
anchor of a window of ``length`` bytes is its smallest hashed 24-byte gram (leftmost on ties), a function of the window alone,
and neighbouring windows of one anchor form a segment of about 1.4 times ``length`` bytes. Equal windows have equal anchors.

1. Documents are cut into portions of about 2 MB, which are written once and read by every step. Anchors are counted over the
   corpus: each portion sends every distinct anchor once with its count and the smallest and largest hash of its segments.
   Anchors are dealt by a fresh hash (a minimum of hashes is itself no even number), to as many parts as the portions ask for.
   An anchor that occurs once can't repeat. An anchor whose segments are all equal repeats as a whole. The others are contested.
2. Every window holds its anchor's gram and as many bytes as half a window has on its left or on its right. Contested segments
   that share neither side with another segment of their anchor are settled: nothing in them repeats. The distinct ones of
   the rest are dealt by anchor into buckets of a few MB; an anchor with very many of them is dealt in chunks. For each bucket a task sorts the suffixes of its segments, takes the Burrows-Wheeler transform, and derives common
   prefixes by increasing value: from every boundary of common prefix v, backward extension by the characters of the interval
   that starts there gives the boundaries of v + 1, breadth first, up to ``length``. Boundaries never reached separate
   suffixes that share ``length`` bytes or more: those are the repeated windows.
3. For anchors in chunks, the windows that stay single in their chunk, and one of each repeated kind, are counted by hash over
   the chunks, so nothing is lost to the split.
4. Each portion gets the verdicts on its segments back, unites the covered ranges and removes them.

Cases: null text counts as empty; texts shorter than ``length`` are never changed; copies inside one document count, overlapping
ones too; repeated rows are copies of each other; a portion holds at least one document, however long, and nothing else grows
with the input; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainmill.llm.bytesops import _VALUE, blocks, mix, powers, raw
from grainmill.llm.shared import materialize, shuffle_partitions, work_dir

GRAM = 24
CHUNK = 4096
PORTION_BYTES, PART_BYTES = 2 << 20, 48 << 20  # a part gets the anchors of so many bytes of text
PORTION = "portion long, ids binary, data binary, offsets binary"
FACT = "portion long, kind int, total long, at binary, status binary, ah long, sh long, bits binary, late array<int>"
_POS = np.uint64((1 << 28) - 1)


class Hasher:
    """Hashes of any byte range of one array in constant time."""

    def __init__(self, data: np.ndarray):
        self.pw, self.inv = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * self.pw[: len(data)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inv[start] + (end - start).astype(np.uint64))


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbouring keys, from running minima of blocks of w in both directions."""
    n = len(key)
    x = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = key
    x = x.reshape(-1, w)
    fore = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


class Runs:
    """Runs of windows of one anchor: first and last start, anchor hash (evenly spread) and segment hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.length, self.gram = length, min(GRAM, length)
        self.first = self.last = self.anchor = np.zeros(0, np.int64)
        self.ah = self.sh = np.zeros(0, np.uint64)
        if len(data) >= length:
            self._find(data, offsets)

    def _find(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n, length, gram = len(data), self.length, self.gram
        self.hasher = h = Hasher(data)
        grams = n - gram + 1
        key = (h.total[gram:] - h.total[:grams]) * h.inv[:grams]
        key += np.uint64(gram)
        key = mix(key)
        low = sliding_min((key & ~_POS) | np.arange(grams, dtype=np.uint64), length - gram + 1)
        anchor = (low & _POS).astype(np.int64)
        inside = np.zeros(n - length + 1, bool)
        for i, j in zip(offsets[:-1], offsets[1:], strict=True):
            if j - i >= length:
                inside[i : j - length + 1] = True
        new = np.empty(len(anchor), bool)
        new[0], new[1:] = True, (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < len(new))]
        new[cuts] = True
        self.first = first = np.flatnonzero(new & inside)
        # a run ends before the next run, the next document or the last window of its own document
        stop = np.flatnonzero(new | ~inside)
        nxt = np.searchsorted(stop, first, side="right")
        self.last = last = np.where(nxt < len(stop), stop[np.minimum(nxt, len(stop) - 1)], len(new)) - 1
        self.anchor = anchor[first]
        place = self.anchor - first
        # a minimum of hashes crowds near zero, so it is mixed once more
        self.ah = mix(key[self.anchor] ^ np.uint64(0x2545F4914F6CDD1D))
        self.sh = mix(h(first, last + length) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sides(self, i: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Hashes of the gram of each run with half a window to its left, and to its right; null if the segment ends before."""
        half = (self.length - self.gram) // 2
        at, first, end = self.anchor[i], self.first[i], self.last[i] + self.length
        left, right = at - half, at + self.gram + half
        out = []
        for a, b, ok in ((left, at + self.gram, left >= first), (at, right, right <= end)):
            out.append(pa.array(self.hasher(np.where(ok, a, at), np.where(ok, b, at)).view(np.int64), mask=~ok))
        return out[0], out[1]


def suffix_order(segments: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters (0 ends a segment), suffix array by the first ``depth`` characters at least, and the rank of every suffix.

    Suffixes that agree so far share the rank of the first of them; segment ends sort by segment. Each round sorts by three
    ranks at a time, so the compared length triples.
    """
    m = len(segments)
    sizes = np.array([len(s) + 1 for s in segments])
    n = int(sizes.sum())
    ends = np.cumsum(sizes) - 1
    text = np.zeros(n, np.int64)
    keep = np.ones(n, bool)
    keep[ends] = False
    whole = np.concatenate(segments)
    code = np.zeros(256, np.int64)
    present = np.flatnonzero(np.bincount(whole, minlength=256))
    code[present] = np.arange(1, len(present) + 1)
    text[keep] = code[whole]
    owner = np.repeat(np.arange(m), sizes)
    end = ends[owner]
    at = np.arange(n)
    bits = int(len(present)).bit_length()
    h = 63 // bits
    left = end - at
    padded = np.concatenate([text, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for t in range(h):
        key = (key << bits) | np.where(left >= t, padded[t : t + n], 0)
    base = n + m + 1
    rank = np.empty(n, np.int64)

    def behind(distance: int) -> np.ndarray:
        out = owner.copy()
        inside = np.flatnonzero(left >= distance)
        out[inside] = rank[inside + distance] + m
        return out

    while True:
        order = np.argsort(key)
        by = key[order]
        starts = np.concatenate([[0], np.flatnonzero(by[1:] != by[:-1]) + 1])
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        if h >= depth or len(starts) == n:
            return text, order, rank
        if base**3 < 1 << 63:
            key, h = (rank * base + behind(h)) * base + behind(2 * h), 3 * h
        else:
            key, h = rank * base + behind(h), 2 * h


def repeated_starts(segments: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For every segment, which of its windows of ``length`` bytes start at another place of the segments too."""
    text, order, rank = suffix_order(segments, length + 1)
    n = len(text)
    before = np.where(order > 0, text[order - 1], 0).astype(np.uint16)  # the Burrows-Wheeler transform; 0 where a segment starts
    by = np.argsort(before, kind="stable").astype(np.int32)
    # where the same character stood last; a segment start counts as seen nowhere, which leaves it out below
    last_seen = np.full(n, -1, np.int32)
    grouped = before[by]
    same = (grouped[1:] == grouped[:-1]) & (grouped[1:] > 0)
    last_seen[by[1:][same]] = by[:-1][same]
    # backward extension of the suffix at each place of the order
    back = rank[order - 1].astype(np.int32)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    head = text[order]
    new = np.flatnonzero((head[1:] != head[:-1]) | (head[1:] == 0)) + 1
    known[new] = True
    for _ in range(length - 1):
        if not len(new):
            break
        bounds = np.flatnonzero(known)
        stop = bounds[np.searchsorted(bounds, new, side="right")]
        size = stop - new
        single = size == 1
        # members of the interval that starts at each new boundary, if the boundary parts them from their last equal character
        wide, w = new[~single], size[~single]
        i = np.concatenate([new[single], np.repeat(wide - np.cumsum(w) + w, w) + np.arange(w.sum())])
        q = np.concatenate([new[single], np.repeat(wide, w)])
        seen = last_seen[i]
        p = back[i[(seen >= 0) & (seen < q)]]
        p = p[~known[p]]
        known[p] = True
        p.sort()
        new = p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p
    repeated = np.zeros(n, bool)
    repeated[order] = ~known[:-1] | ~known[1:]
    out, at = [], 0
    for s in segments:
        out.append(repeated[at : at + len(s) - length + 1])
        at += len(s) + 1
    return out


def portions(docs: DataFrame) -> DataFrame:
    """Documents in portions of about 2 MB, in the order in which they are read."""
    src = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column(2))
            for i, j in blocks(offsets):
                ids = pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i)], ["doc_id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as w:
                    w.write_batch(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([data[offsets[i] : offsets[j]].tobytes()], pa.binary()), pa.array([(offsets[i : j + 1] - offsets[i]).astype(np.int64).tobytes()], pa.binary())],
                    ["portion", "ids", "data", "offsets"],
                )

    return src.mapInArrow(run, PORTION)


def stored_portions(docs: DataFrame) -> DataFrame:
    """The portions, cut once and written: where Arrow batches end depends on the columns read and the size of the rows.

    A row group takes a few portions only, as writers and readers hold one in memory.
    """
    path = f"{work_dir(docs.sparkSession).rstrip('/')}/portions-{uuid.uuid4().hex}"
    cut = portions(docs)
    few = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
    cut.write.options(**few).parquet(path)
    return docs.sparkSession.read.schema(cut.schema).parquet(path)


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["data"], np.uint8), np.frombuffer(row["offsets"], np.int64)


def _status(table: pa.Table, u: np.ndarray) -> np.ndarray:
    """Of every distinct anchor: 0 occurs once, 1 its segments are all equal, 2 contested."""
    status = np.zeros(len(u), np.uint8)
    facts = [r for r in table.to_pylist() if r["kind"] == 0]
    if len(u) and not facts:
        raise ValueError("a portion has anchors but no facts")
    for r in facts:
        if r["total"] != len(u):
            raise ValueError("facts of another portion")
        if r["at"]:
            status[np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["status"], np.uint8)
    return status


def anchor_status(texts: DataFrame, length: int) -> DataFrame:
    """For every portion the anchors that occur more than once in the corpus; one row at least if it has anchors at all."""
    parts = max(shuffle_partitions(texts.sparkSession), -(-texts.count() * PORTION_BYTES // PART_BYTES))

    def count(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                found = Runs(*_open(row), length)
                ah, sh = found.ah, found.sh
                order = np.lexsort((sh, ah))
                u, first, c = np.unique(ah[order], return_index=True, return_counts=True)
                low, high = sh[order][first], sh[order][first + c - 1]
                owner = ((u >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                # only the parts that the portion has anchors of are looked at, however many there are
                starts = np.flatnonzero(np.diff(owner, prepend=owner[0] + np.uint64(1) if len(owner) else 0))
                span = [slice(a, b) for a, b in pairwise([*starts, len(u)])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(owner[starts].astype(np.int32)), pa.array([row["portion"]] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array([len(u)] * len(starts), pa.int64()),
                        *(pa.array([x[s].tobytes() for s in span], pa.binary()) for x in (u, low, high, np.minimum(c, 2).astype(np.uint8))),
                    ],
                    ["part", "portion", "base", "total", "ah", "low", "high", "n"],
                )

    def judge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ah, low, high = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("ah", "low", "high"))
        n = np.concatenate([np.frombuffer(r["n"], np.uint8) for r in rows]).astype(np.int64)
        size = np.array([len(r["n"]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.concatenate([r["base"] + np.arange(s) for r, s in zip(rows, size, strict=True)])
        order = np.argsort(ah, kind="stable")
        new = np.concatenate([[True], ah[order][1:] != ah[order][:-1]])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        least, most = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
        verdict = np.where(np.add.reduceat(n[order], first) < 2, 0, np.where(least == most, 1, 2)).astype(np.uint8)
        status = np.empty(len(ah), np.uint8)
        status[order] = verdict[group]
        out = [[], [], [], []]
        cuts = np.concatenate([[0], np.cumsum(size)])
        for i, r in enumerate(rows):
            s = slice(cuts[i], cuts[i + 1])
            hit = np.flatnonzero(status[s])
            if len(hit) or r["base"] == 0:
                for x, v in zip(out, (r["portion"], r["total"], at[s][hit].astype(np.uint32).tobytes(), status[s][hit].tobytes()), strict=True):
                    x.append(v)
        del owner
        k = len(out[0])
        return pa.table(
            [pa.array(out[0], pa.int64()), pa.array([0] * k, pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())))],
            names=["portion", "kind", "total", "at", "status", "ah", "sh", "bits", "late"],
        )

    counted = texts.mapInArrow(count, "part int, portion long, base long, total long, ah binary, low binary, high binary, n binary")
    return counted.groupBy("part").applyInArrow(judge, FACT)


def contested_segments(texts: DataFrame, status: DataFrame, length: int) -> DataFrame:
    """The distinct contested segments of every portion: portion, anchor and segment hash, copies, side hashes, bytes."""

    kept = pa.schema([(c, pa.int64()) for c in ("portion", "ah", "sh", "copies", "left", "right")] + [("segment", pa.binary())])

    def pick(texts: pa.Table, facts: pa.Table) -> pa.Table:
        out = []
        if not texts.num_rows:
            raise ValueError("facts without their portion")
        for row in texts.to_pylist():
            data, offsets = _open(row)
            if facts.num_rows and not any(facts["status"].to_pylist()):
                continue
            found = Runs(data, offsets, length)
            ah, sh = found.ah, found.sh
            u, back = np.unique(ah, return_inverse=True)
            i = np.flatnonzero(_status(facts, u)[back] == 2)
            order = i[np.lexsort((sh[i], ah[i]))]
            if not len(order):
                continue
            new = np.concatenate([[True], (ah[order][1:] != ah[order][:-1]) | (sh[order][1:] != sh[order][:-1])])
            starts = np.flatnonzero(new)
            copies = np.diff(np.append(starts, len(order)))
            i = order[starts]
            bytes_of = pa.array([data[a:b].tobytes() for a, b in zip(found.first[i], found.last[i] + length, strict=True)], pa.binary())
            columns = [np.full(len(i), row["portion"]), ah[i].view(np.int64), sh[i].view(np.int64), copies]
            out.append(pa.table([*map(pa.array, columns), *found.sides(i), bytes_of], schema=kept))
        return pa.concat_tables(out) if out else kept.empty_table()

    return texts.groupBy("portion").cogroup(status.groupBy("portion")).applyInArrow(pick, "portion long, ah long, sh long, copies long, left long, right long, segment binary")


def shared_sides(contested: DataFrame) -> DataFrame:
    """The contested segments that share a side with another segment, or a copy, of their anchor; no others hold a repeat."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("h")), F.struct(F.lit(1).alias("side"), F.col("right").alias("h"))))
    rows = contested.select("ah", "sh", "copies", sides.alias("s")).where("s.h IS NOT NULL").select("ah", "sh", "copies", F.xxhash64("ah", "s").alias("key"))
    shared = rows.groupBy("key").agg(F.sum("copies").alias("c")).where("c > 1").select("key")
    # a hash of anchor and side stands for a segment here: more of them pass than must, none too few
    live = rows.join(shared, "key", "left_semi").select("ah", "sh").distinct()
    return contested.join(live, ["ah", "sh"], "left_semi")


def judged_segments(contested: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """ah, sh, bits (repeated windows of the segment, packed) and late (starts of windows that repeat in another chunk)."""
    distinct = materialize(shared_sides(contested).groupBy("ah", "sh").agg(F.sum("copies").alias("copies"), F.first("segment").alias("segment")), "segments")
    total = distinct.agg(F.sum(F.length("segment"))).first()[0] or 0
    many = distinct.groupBy("ah").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CHUNK)
    chunks = F.ceil(F.coalesce("c", F.lit(1)) / CHUNK)
    dealt = distinct.join(many, "ah", "left").withColumn("split", F.col("c").isNotNull()).withColumn("chunk", F.pmod("sh", chunks)).drop("c")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("ah", "chunk"), F.lit(max(1, -(-total // bucket_bytes)))))

    def judge(table: pa.Table) -> pa.Table:
        # a chunk of a split anchor is judged by itself; all else of the bucket goes together
        out = [[] for _ in range(6)]
        rows = table.sort_by([("split", "ascending"), ("ah", "ascending"), ("chunk", "ascending"), ("sh", "ascending")]).to_pylist()
        groups: dict = {}
        for r in rows:
            groups.setdefault((r["ah"], r["chunk"]) if r["split"] else None, []).append(r)
        for key, own in groups.items():
            segments = [np.frombuffer(r["segment"], np.uint8) for r in own]
            found = repeated_starts(segments, length)
            seen: set[int] = set()
            for r, s, hit in zip(own, segments, found, strict=True):
                if r["copies"] > 1:
                    hit = np.ones_like(hit)
                for x, v in zip(out, (0, r["ah"], r["sh"], np.packbits(hit).tobytes(), None, None), strict=True):
                    x.append(v)
                if key is not None:
                    at = np.arange(len(hit))
                    for start, w in enumerate(Hasher(s)(at, at + length).view(np.int64).tolist()):
                        if hit[start] and w in seen:
                            continue
                        seen.add(w)
                        for x, v in zip(out, (1, r["ah"], r["sh"], None, w, -1 if hit[start] else start), strict=True):
                            x.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["kind", "ah", "sh", "bits", "wh", "start"])

    judged = materialize(dealt.select("ah", "sh", "copies", "segment", "split", "chunk", "bucket").groupBy("bucket").applyInArrow(judge, "kind int, ah long, sh long, bits binary, wh long, start int"), "judged")
    windows = judged.where("kind = 1").select("ah", "sh", "wh", "start")
    shared = materialize(windows.groupBy("ah", "wh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "shared_windows")
    late = windows.where("start >= 0").join(shared, ["ah", "wh"], "left_semi").groupBy("ah", "sh").agg(F.collect_list("start").alias("late"))
    return judged.where("kind = 0").select("ah", "sh", "bits").join(late, ["ah", "sh"], "left")


def remove_repeats(docs: DataFrame, length: int = 200, bucket_bytes: int = 1 << 20, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the ``kept`` bytes."""
    stored = stored_portions(docs)
    status = materialize(anchor_status(stored, length), "anchors")
    contested = materialize(contested_segments(stored, status, length), "contested")
    verdicts = contested.select("portion", "ah", "sh").join(judged_segments(contested, length, bucket_bytes), ["ah", "sh"])
    null = lambda t: F.lit(None).cast(t)
    facts = status.unionByName(verdicts.select("portion", F.lit(1).alias("kind"), null("long").alias("total"), null("binary").alias("at"), null("binary").alias("status"), "ah", "sh", "bits", "late"))

    def finish(texts: pa.Table, facts: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        if not texts.num_rows:
            raise ValueError("facts without their portion")
        for row in texts.to_pylist():
            data, offsets = _open(row)
            ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).to_pylist()
            gone = np.zeros(len(data), bool)
            if not facts.num_rows or any(facts["at"].to_pylist()):
                found = Runs(data, offsets, length)
                first, last, ah, sh = found.first, found.last, found.ah, found.sh
                u, back = np.unique(ah, return_inverse=True)
                state = _status(facts, u)[back]
                edge = np.zeros(len(data) + 1, np.int64)
                i = np.flatnonzero(state == 1)
                np.add.at(edge, first[i], 1)
                np.add.at(edge, last[i] + length, -1)
                verdict = {(r["ah"], r["sh"]): (r["bits"], r["late"]) for r in facts.to_pylist() if r["kind"] == 1}
                i = np.flatnonzero(state == 2)
                for k, a, s in zip(i, ah[i].view(np.int64).tolist(), sh[i].view(np.int64).tolist(), strict=True):
                    if (a, s) not in verdict:  # shares no side with another segment
                        continue
                    bits, late = verdict[a, s]
                    hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(last[k] - first[k] + 1)).astype(bool)
                    if late:
                        hit[late] = True
                    starts = first[k] + np.flatnonzero(hit)
                    edge[starts] += 1
                    edge[starts + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
            for d, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True):
                g = gone[a:b]
                kept = data[a:b][~g].tobytes()
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if b > a else 0
                for x, v in zip(out, (d, int(b - a), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                    x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = stored.groupBy("portion").cogroup(facts.groupBy("portion")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_kept else done.drop("kept")
