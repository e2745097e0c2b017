"""N-gram Jaccard join by grouped prefixes: components of documents whose word-shingle sets overlap by a given share.

The shingles of a set are ordered by exact document frequency (then hash), rare first. Two sets of Jaccard similarity t
share a shingle within their first ``n - ceil(t n) + 1`` ones. A shingle that occurs in one document only can match
nothing, so a document with that many of them is settled at once; of the others only shingles with two or more documents
are kept, which is all that an intersection needs.

1. *Count.* Arrow tasks turn texts into shingle hashes and send the distinct ones of each batch, with local counts, to the
   range that owns them; a range adds up frequencies and sends those above one back to the batches that hold the shingle.
   A shingle of a third of all documents costs one entry a batch.
2. *Collapse.* Documents with equal sets (128-bit digest) become one item; items with equal prefixes and size one group.
3. *Link through pivots.* In each prefix bucket the items are verified against two pivots, and components are formed. Then
   each bucket that holds several components draws a further pivot from the most frequent one for the items of the others.
4. *Settle the rest.* Only group pairs of one bucket that still lie in different components are filtered by size, position
   and parity bitmap, expanded to members, filtered by bitmap again and verified. A set's bitmap flips a bit a shingle, so
   two bitmaps differ in at most as many bits as the sets differ in shingles; near misses seldom pass, links always do. Large groups of near copies are one component by then, so their pairs are
   never listed, and no link is lost. A pair with several common prefix shingles is listed where the first of them stands:
   each row carries the ``SEEN`` shingles that begin its prefix, and a pair that shares an earlier one is left to that.

A digest or component of many documents is split into salts where documents take its component.

Cases: null, empty or blank texts have an empty set and are linked with nothing; fewer words than ``k`` make one shingle
of the whole sequence; repeated rows are separate rows with one component; a null ``doc_id`` never is a component's
smallest id unless all are null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainmill.llm.bytesops import blocks, mix, raw, shingle_sets
from grainmill.llm.shared import connected_components, discard, hot_keys, join_salted, materialize, shuffle_partitions, small_batches, tidy

_FLUSH, _ROWS = 500_000, 10_000  # a portion ends at so many shingles or rows
PART_BYTES = 16 << 20  # a range of hashes gets the shingles of about so many bytes of text
SEEN = 32
WORDS = 8  # of 64 bits in the parity bitmap of a set
COUNTS = "part int, batch long, base long, total long, tokens binary, counts binary"
SHARED = "batch long, kind int, total long, at binary, tokens binary, freq binary, docs binary"
PROFILE = "row_id long, doc_id long, n long, hi long, lo long, lone long, prefix array<bigint>, tokens array<bigint>, bits array<bigint>"


def planes(x: np.ndarray) -> bytes:
    """Byte planes of an integer array, which compress well for sorted or small values."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def unplanes(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not b:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set of hashes: each flips one bit, so two sets differ in at least as many hashes as bits."""
    at = (mix(tokens) % np.uint64(64 * WORDS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def differing(a: str, b: str) -> str:
    """SQL: how many bits of two bitmaps differ, null without one of them."""
    return "(" + " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(WORDS)) + ")"


def _batches(source, k: int):
    """Shingle sets of (row_id, doc_id, text) in bounded portions of whole rows, wherever batches end: portion id (first row), row and document ids, sets, sizes."""
    rows, ids, sets, sizes, held = [], [], [], [], 0

    def portion():
        out = pa.concat_arrays(rows), pa.concat_arrays(ids), np.concatenate(sets), np.concatenate(sizes)
        return out[0][0].as_py(), *out

    for batch in source:
        data, offsets = raw(batch.column(2))
        for i, j in blocks(offsets, 1 << 19):
            s, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
            rows.append(batch.column(0).slice(i, j - i))
            ids.append(batch.column(1).slice(i, j - i))
            sets.append(s)
            sizes.append(np.diff(at))
            held += len(s)
            if held >= _FLUSH or sum(map(len, rows)) >= _ROWS:
                yield portion()
                rows, ids, sets, sizes, held = [], [], [], [], 0
    if rows:
        yield portion()


def shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies of a range's shingles (rows of ``COUNTS``), of those above one, for each portion that holds them (rows of ``SHARED``)."""
    rows, tokens, counts = [], [], []
    for b in batches:
        rows += b.select(["batch", "base", "total"]).to_pylist()
        tokens += [unplanes(x.as_buffer(), np.uint64) for x in b.column("tokens")]
        counts += [unplanes(x.as_buffer(), np.uint32) for x in b.column("counts")]
        del b
    ends = np.cumsum([0, *map(len, tokens)])
    tokens, counts = np.concatenate(tokens), np.concatenate(counts)
    order = np.argsort(tokens, kind="stable").astype(np.uint32)
    # most shingles occur once and go before anything else is laid out for them
    ranked = tokens[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    del ranked
    more = ~(first & np.append(first[1:], True)) | (counts[order] > 1)
    order, first = order[more], first[more]
    starts = np.flatnonzero(first)
    freq = np.repeat(np.add.reduceat(counts[order], starts, dtype=np.int64), np.diff(starts, append=len(order)))
    freq = np.minimum(freq, 2**32 - 1).astype(np.uint32)
    # back to the order of the rows, in each of which shingles ascend
    back = np.argsort(order)
    order, freq = order[back].astype(np.int64), freq[back]
    tokens = tokens[order]
    cuts = np.searchsorted(order, ends)
    for i, j in blocks(16 * cuts, 4 << 20):
        span = [slice(a, b) for a, b in pairwise(cuts[i : j + 1])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["batch"] for r in rows[i:j]], pa.int64()), pa.array([0] * (j - i), pa.int32()), pa.array([r["total"] for r in rows[i:j]], pa.int64()),
                pa.array([planes((order[s] - e + r["base"]).astype(np.uint32)) for r, s, e in zip(rows[i:j], span, ends[i:j], strict=True)], pa.binary()), pa.array([planes(tokens[s]) for s in span], pa.binary()),
                pa.array([planes(freq[s]) for s in span], pa.binary()), pa.array([None] * (j - i), pa.binary()),
            ],
            names=["batch", "kind", "total", "at", "tokens", "freq", "docs"],
        )


def profile(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """One row per document: set size, digest and, unless the document is settled, its prefix and its shared shingles."""
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-volume // PART_BYTES))
    src = docs.select("row_id", F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(source):
        for batch, _, _, tokens, _ in _batches(source, k):
            u, c = np.unique(tokens, return_counts=True)
            owner = ((u >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            # only the ranges that the batch has shingles of are looked at, however many there are
            starts = np.flatnonzero(np.diff(owner, prepend=owner[0] + np.uint64(1) if len(owner) else 0))
            span = [slice(a, b) for a, b in pairwise([*starts, len(u)])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner[starts].astype(np.int32)), pa.array([batch] * len(starts), pa.int64()),
                    pa.array(starts, pa.int64()), pa.array([len(u)] * len(starts), pa.int64()),
                    pa.array([planes(u[s]) for s in span], pa.binary()),
                    pa.array([planes(c[s].astype(np.uint32)) for s in span], pa.binary()),
                ],
                ["part", "batch", "base", "total", "tokens", "counts"],
            )

    def members(source):
        for batch, rows, ids, tokens, size in _batches(source, k):
            u, at = np.unique(tokens, return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            step = np.diff(at, prepend=0)
            filled = starts[size > 0]
            step[filled] = at[filled]
            hi, lo = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            if len(filled):
                hi[size > 0] = np.add.reduceat(mix(tokens), filled)
                lo[size > 0] = np.bitwise_xor.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), filled)
            head = pa.RecordBatch.from_arrays([rows, ids, pa.array(size, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], ["row_id", "doc_id", "n", "hi", "lo"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch], pa.int64()), pa.array([1], pa.int32()), pa.array([len(u)], pa.int64()), pa.array([planes(step.astype(np.uint32))], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["batch", "kind", "total", "at", "tokens", "freq", "docs"],
            )

    def assemble(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 1)
        if any(r["total"] != own["total"] for r in rows):
            raise ValueError("the documents changed between two reads; materialise the input first")
        head = pa.ipc.open_stream(own["docs"]).read_all()
        size = head.column("n").to_numpy()
        freq, value = np.ones(own["total"], np.int64), np.zeros(own["total"], np.uint64)
        for r in rows:
            if r["kind"] == 0:
                i = unplanes(r["at"], np.uint32)
                freq[i], value[i] = unplanes(r["freq"], np.uint32), unplanes(r["tokens"], np.uint64)
        step = unplanes(own["at"], np.uint32).astype(np.int64)
        ends = np.cumsum(size)
        lone, prefix, shared, bits = [], [], [], []
        for n, e in zip(size, ends, strict=True):
            at = np.cumsum(step[e - n : e])
            f = freq[at]
            more = f > 1
            ones = int(n - more.sum())
            length = int(n - (threshold * n + 99) // 100 + 1)
            lone.append(ones)
            if n == 0 or ones >= length:
                prefix.append(None)
                shared.append(None)
                bits.append(None)
                continue
            t, f = value[at[more]], f[more]
            order = np.lexsort((t, f))
            prefix.append(t[order[: length - ones]].view(np.int64))
            shared.append(t.view(np.int64))
            bits.append(bitmap(t))
        kind = pa.list_(pa.int64())
        return pa.table([head.column("row_id"), head.column("doc_id"), head.column("n"), head.column("hi"), head.column("lo"), pa.array(lone, pa.int64()), pa.array(prefix, kind), pa.array(shared, kind), pa.array(bits, kind)], names=["row_id", "doc_id", "n", "hi", "lo", "lone", "prefix", "tokens", "bits"])

    freq = src.mapInArrow(tidy(count), COUNTS).groupBy("part").applyInArrow(tidy(shared_counts), SHARED)
    return freq.unionByName(src.mapInArrow(tidy(members), SHARED)).groupBy("batch").applyInArrow(tidy(assemble), PROFILE)


def _verified(pairs: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of items whose sets overlap enough, written. Shingles of one document only can't be in an intersection."""
    pairs = materialize(pairs, "pairs")
    total = pairs.count()
    if not total:
        return pairs
    left = items.select(F.col("item").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = items.select(F.col("item").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    hot = {c: hot_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("c")), [c], "c", total) for c in "ab"}
    met = join_salted(join_salted(pairs, left, ["a"], hot["a"], F.col("b")), right, ["b"], hot["b"], F.col("a"))
    out = materialize(met.where(100 * both >= threshold * (F.col("na") + F.col("nb") - both)).select("a", "b"), "links")
    discard(pairs)
    return out


def _place(items: DataFrame, links: DataFrame) -> DataFrame:
    """The component of every item, written: item, gid, n, r (shared shingles), bits, comp."""
    comp = connected_components(links)
    return materialize(items.join(comp, F.col("item") == F.col("node"), "left").select("item", "gid", "n", (F.col("n") - F.col("lone")).alias("r"), "bits", F.coalesce("comp", "item").alias("comp")), "placed")


def link(prof: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Components of the items (one per distinct set) that can have links: node, comp."""
    live = prof.where(F.col("tokens").isNotNull())
    items = live.join(classes.select("item"), live.row_id == F.col("item"), "left_semi").select(F.col("row_id").alias("item"), "n", "lone", "prefix", "tokens", "bits", F.xxhash64("n", "lone", "prefix").alias("gid"))
    items = materialize(items, "items")
    groups = items.groupBy("gid").agg(F.min("item").alias("leader"), F.count("*").alias("members"))
    heads = items.join(groups.drop("gid"), F.col("item") == F.col("leader")).select("gid", "leader", "members", "n", "lone", F.slice("prefix", 1, SEEN).alias("head"), F.posexplode("prefix").alias("pos", "token"))
    heads = heads.withColumn("head", F.slice("head", F.lit(1), F.col("pos")))
    used = heads.groupBy("token").agg(F.sum("members").alias("c")).where("c > 1").select("token")
    rows = materialize(heads.join(used, "token", "left_semi").withColumn("band", F.floor(F.log("n") / float(np.log(100 / threshold)) * 2)), "prefixes")
    # pivots: of each bucket and size band the leader with the fewest shingles of its own, to which most others are close,
    # and another by hash; in a group, its leader
    own, any_ = F.struct("lone", F.xxhash64("gid").alias("h"), "leader"), F.struct(F.xxhash64("gid").alias("h"), "leader")
    pivots = rows.groupBy("token", "band").agg(F.min(own).alias("lo"), F.max(any_).alias("hi")).where("lo.leader <> hi.leader")
    near = rows.join(pivots, ["token", "band"]).select("leader", F.explode(F.array("lo.leader", "hi.leader")).alias("pivot"))
    inner = items.join(groups.where("members > 1"), "gid").select("item", "leader")
    pairs = near.union(inner.select("item", "leader")).where("leader <> pivot").select(F.least("leader", "pivot").alias("a"), F.greatest("leader", "pivot").alias("b")).distinct()
    first = _verified(pairs, items, threshold)
    links, placed = first, _place(items, first)
    # each bucket that holds several components draws one more pivot from the most frequent one, for the others; members of a
    # group that are apart stand for themselves here
    apart = placed.groupBy("gid", "comp").agg(F.min("item").alias("one"))
    led = rows.join(apart, "gid").select("token", "band", "one", "comp", "n", (F.col("n") - F.col("lone")).alias("r"))
    drawn = F.max(F.struct(F.xxhash64("token", "one").alias("h"), "one", "comp", "n", "r")).alias("pivot")
    each = led.groupBy("token", "band", "comp").agg(drawn, F.count(F.lit(1)).alias("c"))
    pivots = each.groupBy("token", "band").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("pivot"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    near = led.join(pivots, ["token", "band"]).where(f"comp <> pivot.comp AND least(r, pivot.r) >= ceil({threshold}L * (n + pivot.n) / {100 + threshold}.0D - 1e-9)")
    more = _verified(near.select(F.least("one", "pivot.one").alias("a"), F.greatest("one", "pivot.one").alias("b")).distinct(), items, threshold)
    if not more.isEmpty():  # else the components stay, and so does their table
        links, last = links.unionByName(more), placed
        placed = _place(items, links)
        discard(last)
    # what is left: pairs of one bucket in different components
    cells = placed.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("size"), F.when(F.count(F.lit(1)) == 1, F.any_value("bits")).alias("bits"))
    spread = rows.select("token", "pos", "gid", "n", "lone", "head").join(cells, "gid")
    # pairs of components, by the bounds of what they have in the bucket: sizes, shared shingles, place of the token
    box = spread.groupBy("token", "comp").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("lone")).alias("r"), F.min(F.col("pos") + F.col("lone")).alias("p"), F.when(F.count(F.lit(1)) == 1, F.any_value("head")).alias("head"), F.max(F.col("n") - F.col("lone") - F.col("pos") - 1).alias("rest"), F.max("pos").alias("q"), F.when(F.count(F.lit(1)) == 1, F.any_value("bits")).alias("bits"))
    least = f"ceil({threshold}L * (x.n0 + y.n0) / {100 + threshold}.0D - 1e-9)"
    # where both know all that stands before the token, they have nothing of it in common
    ahead = f"if(x.head IS NOT NULL AND y.head IS NOT NULL AND x.q <= {SEEN} AND y.q <= {SEEN}, 0, least(x.q, y.q))"
    able = f"100 * x.n1 >= {threshold} * y.n0 AND 100 * y.n1 >= {threshold} * x.n0 AND least(x.r, y.r) >= {least} AND 1 + least(x.rest, y.rest) + {ahead} >= {least} AND x.p <= x.n1 - {least} AND y.p <= y.n1 - {least} AND NOT coalesce(arrays_overlap(x.head, y.head), false) AND coalesce(x.r + y.r - {differing('x.bits', 'y.bits')} >= 2 * {least}, true)"
    cross = box.alias("x").join(box.alias("y"), F.expr(f"x.token = y.token AND x.comp < y.comp AND {able}")).select(F.col("x.token").alias("token"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb"), *(F.col(f"y.{c}").alias(f"y_{c}") for c in ("n0", "n1", "r", "rest", "q", "head", "bits")))
    a = spread.select("token", *(F.col(c).alias(f"{c}_a") for c in ("pos", "gid", "n", "lone", "head", "size", "bits")), F.col("comp").alias("ca"))
    b = spread.select("token", *(F.col(c).alias(f"{c}_b") for c in ("pos", "gid", "n", "lone", "head", "size", "bits")), F.col("comp").alias("cb"))
    need = F.expr(f"ceil({threshold}L * (n_a + n_b) / {100 + threshold}.0D - 1e-9)")
    known = (F.col("pos_a") <= SEEN) & (F.col("pos_b") <= SEEN)
    best = F.when(known, 0).otherwise(F.least("pos_a", "pos_b")) + 1 + F.least(F.expr("n_a - lone_a - pos_a - 1"), F.expr("n_b - lone_b - pos_b - 1"))
    # the token must stand in the prefix that this very pair of sizes asks for
    early = (F.expr("pos_a + lone_a") <= F.col("n_a") - need) & (F.expr("pos_b + lone_b") <= F.col("n_b") - need)
    sized = (100 * F.col("n_a") >= threshold * F.col("n_b")) & (100 * F.col("n_b") >= threshold * F.col("n_a"))
    # a group of the first component must be able to meet the bounds of the second
    need_y = f"ceil({threshold}L * (n_a + y_n0) / {100 + threshold}.0D - 1e-9)"
    ahead_y = f"if(y_head IS NOT NULL AND pos_a <= {SEEN} AND y_q <= {SEEN}, 0, least(pos_a, y_q))"
    able_y = F.expr(f"100 * y_n1 >= {threshold} * n_a AND 100 * n_a >= {threshold} * y_n0 AND least(n_a - lone_a, y_r) >= {need_y} AND pos_a + lone_a <= n_a - {need_y} AND 1 + least(n_a - lone_a - pos_a - 1, y_rest) + {ahead_y} >= {need_y} AND NOT coalesce(arrays_overlap(head_a, y_head), false) AND coalesce(n_a - lone_a + y_r - {differing('bits_a', 'y_bits')} >= 2 * {need_y}, true)")
    met = cross.join(a, ["token", "ca"]).where(able_y).drop("y_n0", "y_n1", "y_r", "y_rest", "y_q", "y_head", "y_bits")
    alike = F.coalesce(F.expr(f"n_a - lone_a + n_b - lone_b - {differing('bits_a', 'bits_b')}") >= 2 * need, F.lit(True))
    pairs = met.join(b, ["token", "cb"]).where(sized & (best >= need) & early & ~F.arrays_overlap("head_a", "head_b") & alike)
    # the smaller side is expanded first, then each of its items meets those of the other that its bitmap allows
    cell = lambda x, c: F.struct(F.col(f"gid_{x}").alias("gid"), F.col(c).alias("comp"))
    less = F.col("size_a") <= F.col("size_b")
    cand = pairs.select(F.when(less, cell("a", "ca")).otherwise(cell("b", "cb")).alias("s"), F.when(less, cell("b", "cb")).otherwise(cell("a", "ca")).alias("t"))
    cand = cand.select(F.col("s.gid").alias("gid_a"), F.col("s.comp").alias("ca"), F.col("t.gid").alias("gid_b"), F.col("t.comp").alias("cb")).distinct()
    m1, m2 = (placed.select(F.col("gid").alias(f"gid_{x}"), F.col("comp").alias(f"c{x}"), F.col("item").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "r", "bits"))) for x in "ab")
    close = sized & (F.expr(f"r_a + r_b - {differing('bits_a', 'bits_b')}") >= 2 * need)
    second = cand.join(m1, ["gid_a", "ca"]).join(m2, ["gid_b", "cb"]).where(close).select("a", "b")
    more = _verified(second, items, threshold)
    out = placed if more.isEmpty() else _place(items, links.unionByName(more))
    discard(items, rows, *([placed] if out is not placed else []))
    return out.select(F.col("item").alias("node"), "comp")


def components(docs: DataFrame, k: int = 5, threshold: int = 80, row: str | None = None) -> DataFrame:
    """One row per document: ``row_id``, ``doc_id``, ``n_shingles``, ``component_id`` (smallest linked document id).

    ``row``: a column of stored, unique row numbers; without it rows are numbered here as they are read.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    with small_batches(docs.sparkSession):
        prof = materialize(profile(docs.select(number.alias("row_id"), "doc_id", "text"), k, threshold), "profiles")
    small = prof.where("n > 0 AND tokens IS NOT NULL").select("row_id", "doc_id", "n", "hi", "lo")
    classes = small.groupBy("hi", "lo", "n").agg(F.min("row_id").alias("item"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    comp = link(prof, classes, threshold)
    # items without links stay alone with their copies
    own = classes.join(comp, F.col("item") == F.col("node"), "left").select("hi", "lo", "n", "copies", "least_id", F.coalesce("comp", "item").alias("comp"))
    own = materialize(own, "class_components")
    low = own.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("c"))
    hot = hot_keys(low, ["comp"], "c", own.count())
    owned = join_salted(own, low.drop("c"), ["comp"], hot, F.struct("hi", "lo")).select("hi", "lo", "n", "copies", "component_id")
    hot = hot_keys(own, ["hi", "lo", "n"], "copies", own.agg(F.sum("copies")).first()[0] or 0)
    placed = join_salted(small, owned.drop("copies"), ["hi", "lo", "n"], hot, F.col("row_id"))
    linked = placed.select("row_id", "doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = prof.where("n = 0 OR tokens IS NULL").select("row_id", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)
