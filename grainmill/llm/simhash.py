"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A document's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of its word shingles,
repeats included. Fingerprints that differ in at most ``BITS`` = 2 bits share at least ``MATCHES`` = 6 of their 8 positional
bytes, as two bits touch two bytes at most.

1. *Collapse.* Equal fingerprints become one, so copies never meet each other.
2. *Index.* The eight positions form four pairs. Two fingerprints that share six bytes share at least two whole pairs, so a
   fingerprint is posted under the six choices of two pairs: a list holds the fingerprints with four equal positional bytes.
3. *Count.* Within a list the shared positional bytes of each pair are tallied, pairs that reach the guaranteed six are kept
   and verified by their differing bits. A list sends on a spanning forest of its links, never all of them.
4. *Long lists.* A list of more than ``most`` different fingerprints is dealt out again by two of its four other positions:
   its pairs then share six bytes already and differ in two, so a list holds 65,536 fingerprints at most however large
   the table is. There the one- and two-bit variants of the two open bytes are looked up instead of comparing pairs.

Nothing is capped, and no link between different fingerprints is lost. Lists are streamed in key order through Arrow tasks.

Cases: null, empty or blank texts have fingerprint zero, which links like any other; fewer words than a shingle give one shingle
of the whole sequence; equal fingerprints always link; repeated rows stay rows of their own; rows with a null ``doc_id``
are linked, and a component has the smallest id that is not null (null if it has none); an empty table gives an empty result;
further columns of ``docs`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from grainmill.llm.bytesops import _LOWER, _SPACE, blocks, raw, word_hashes
from grainmill.llm.shared import connected_components, discard, hot_keys, join_salted, materialize

SEED = 42
BITS = 2
MATCHES = 8 - BITS
_STEP = 1 << 17


def shingle_values(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every k-word shingle (words lower-cased, joined by one space), and the row of each."""
    _, row, starts, ends = word_hashes(data, offsets)
    if not len(row):
        return np.zeros(0, np.uint64), row
    inside = ~_SPACE[data]
    # one blank stays behind each word; the words of a row always have one between them
    stays = inside.copy()
    stays[1:] |= inside[:-1]
    place = np.concatenate([[0], np.cumsum(stays)])
    text, starts, ends = np.where(inside, _LOWER[data], np.uint8(0x20))[stays].tobytes(), place[starts], place[ends]
    words = np.bincount(row, minlength=len(offsets) - 1)
    last = np.cumsum(words)[row]
    at = np.arange(len(row))
    whole = (words[row] < k) & (at == last - words[row])
    first = np.flatnonzero((at + k <= last) | whole)
    until = ends[np.minimum(np.where(whole[first], last[first], first + k), len(ends)) - 1]
    shingles = map(text.__getitem__, map(slice, starts[first].tolist(), until.tolist()))
    values = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(first))
    return values, row[first]


def majority(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each of ``n`` rows."""
    ones, total = np.zeros((n, 64), np.int64), np.bincount(row, minlength=n)
    for i in range(0, len(values), _STEP):
        own = row[i : i + _STEP]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        bits = np.unpackbits(values[i : i + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``row_id``, ``doc_id`` and ``fp`` (the 64 bits as a long) of every document."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(2))
            out = np.zeros(batch.num_rows, np.uint64)
            for i, j in blocks(offsets, 1 << 20):
                values, row = shingle_values(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                out[i:j] = majority(values, row, j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], ["row_id", "doc_id", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(hashed, "row_id long, doc_id long, fp long")


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and fingerprints of a stream in key order, cut between lists; equal rows once."""
    keys, fps = [], []
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if len(key) and (cut or (keys and keys[-1][-1] != key[0])):
            yield once(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps, fp[:cut]]))
            keys, fps = [], []
        keys.append(key[cut:])
        fps.append(fp[cut:])
    if keys:
        yield once(np.concatenate(keys), np.concatenate(fps))


def once(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows without repeats."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    return key[new], fp[new]


def tallied(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within lists: the positional bytes that a pair shares are counted, pairs with enough of them are verified."""
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
    size = np.diff(np.append(starts, len(key)))
    behind = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(starts, size)) - 1  # rows of the list that follow
    found = [], []
    at, step = np.flatnonzero(behind > 0), 1
    while len(at):
        differ = fp[at] ^ fp[at + step]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        enough = shared >= MATCHES
        linked = at[enough][np.bitwise_count(differ[enough].view(np.uint64)) <= BITS]
        found[0].append(fp[linked])
        found[1].append(fp[linked + step])
        step += 1
        at = at[behind[at] >= step]
    return tuple(np.concatenate(x) if x else fp[:0] for x in found)


def looked_up(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within lists whose fingerprints share six positions: variants of the two open bytes are looked up."""
    kind = key >> 48
    value = np.zeros(len(fp), np.int64)
    for c, held in enumerate(SIXES):
        a, b = (p for p in range(8) if p not in held)
        own = kind == c
        value[own] = ((fp[own] >> 8 * a) & 255) | ((fp[own] >> 8 * b) & 255) << 8
    number = np.cumsum(np.diff(key, prepend=key[0] if len(key) else 0) != 0)
    place = number << 16 | value
    order = np.argsort(place)
    place, fp = place[order], fp[order]
    found = [], []
    for size in range(1, BITS + 1):
        for bits in combinations(range(16), size):
            other = place ^ sum(1 << b for b in bits)
            at = np.minimum(np.searchsorted(place, other), max(len(place) - 1, 0))
            linked = np.flatnonzero((place[at] == other) & (other > place))
            found[0].append(fp[linked])
            found[1].append(fp[at[linked]])
    return forest(*(np.concatenate(x) for x in found))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the given ones connect: each node with the smallest one of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


PAIRS = list(combinations(range(4), 2))  # choices of two pairs of positions
SIXES = list(combinations(range(8), MATCHES))


def _byte(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _key(number: int, positions: tuple[int, ...]):
    """The number of a choice of positions and the bytes there, as one long."""
    out = F.lit(number).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


def links(different: DataFrame, most: int = 512, broadcast_keys: int = 500_000) -> DataFrame:
    """``a``, ``b``: links that connect all fingerprints of ``different`` (``fp``, each once) at most ``BITS`` bits apart.

    A list of more than ``most`` fingerprints is dealt out again. The keys of long lists are broadcast up to ``broadcast_keys``.
    """
    spots = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in PAIRS]
    posted = different.select("fp", F.explode(F.array(*(_key(c, s) for c, s in enumerate(spots)))).alias("key"))
    long = materialize(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "long_lists")
    known = F.broadcast(long) if long.count() <= broadcast_keys else long

    def compared(batches):
        for key, fp in whole_lists(batches):
            a, b = forest(*tallied(key, fp))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def varied(batches):
        for key, fp in whole_lists(batches):
            a, b = looked_up(key, fp)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def streamed(rows, work):
        return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(work, "a long, b long")

    short = streamed(posted.join(known, "key", "left_anti"), compared)
    # a long list's fingerprints go under its four positions and two others
    finer = []
    for c, spot in enumerate(spots):
        choices = [tuple(sorted({*spot, *more})) for more in combinations(sorted({*range(8)} - {*spot}), MATCHES - len(spot))]
        finer.append(F.when(F.shiftrightunsigned("key", 32) == c, F.array(*(_key(SIXES.index(x), x) for x in choices))))
    again = posted.join(known, "key", "left_semi").select("fp", F.explode(F.coalesce(*finer)).alias("key"))
    return short.unionByName(streamed(again, varied))


def components(docs: DataFrame, k: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hexadecimal) and ``component_id``, the smallest linked document id."""
    rows = materialize(fingerprints(docs, k), "fingerprints")
    different = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "different")
    found = materialize(links(different.select("fp")), "links")
    comp = connected_components(found)
    own = materialize(different.join(comp, different.fp == comp.node, "left").select("fp", "least", "copies", F.coalesce("comp", "fp").alias("comp")), "owned")
    low = own.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("c"))
    wide = hot_keys(low, ["comp"], "c", own.count())
    owned = materialize(join_salted(own, low.drop("c"), ["comp"], wide, F.col("fp")).select("fp", "copies", "component_id"), "placed")
    hot = hot_keys(owned, ["fp"], "copies", owned.agg(F.sum("copies")).first()[0] or 0)
    out = join_salted(rows, owned.drop("copies"), ["fp"], hot, F.col("row_id"))
    discard(different, found, own)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
