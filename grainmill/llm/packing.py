"""Packing of documents into fixed-length token windows by multiway Karmarkar-Karp differencing.

Every document is tokenised where it is read. Its ids, an end id last, are cut into full windows, which need no partner and
are sequences as they are, and a tail, which is cut into pieces of at most ``piece`` ids. Tail pieces are dealt by document hash into blocks of about
``block_tokens`` ids, and each block is packed on its own: differencing always merges the two partial partitions with the
largest spread, heaviest slots of one against lightest slots of the other, and the number of windows rises by one whenever
a window would exceed the capacity. A block has a bounded number of ids whatever the size of the corpus, so no task grows
with the input; the last window of a block is the only one that can be much emptier than the rest, and differencing
spreads that gap over all of its windows.

Cases: null text counts as empty and gives the end id alone; repeated rows are separate documents (keyed by row); an empty
table gives no rows; very long texts give more full windows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from grainmill.llm.bytesops import blocks, raw
from grainmill.llm.shared import materialize, small_batches, tidy

PIECE_SCHEMA = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


#: bytes of ASCII by kind: 1 white space, 2 letters and digits, 3 marks; others are 0
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in " \t\n\r\f\v"]] = 1
_KIND[[ord(c) for c in string.ascii_letters + string.digits]] = 2
_KIND[[ord(c) for c in string.punctuation]] = 3


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start in the bytes of texts: words with the space before them, marks after a word, white space as the tokenizer splits it."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    kind[1:][(data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)] = 2  # letters of Latin-1; not the signs of times and division
    space = kind == 1
    text = np.zeros(len(data) + 1, bool)
    text[offsets] = True
    start = np.zeros(len(data), bool)
    start[1:] = (kind[1:] == 3) & (kind[:-1] == 2)
    start[1:] |= space[1:] & ~space[:-1]
    # the last of several, if something follows it in the text, and what follows any but a plain space
    last = space & ~text[1:] & ~np.append(space[1:], True)
    start |= last
    start[1:] |= last[:-1] & (data[:-1] != 0x20)
    start |= text[:-1]
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole texts by ``tokenizers``, just as it gives them.

    A byte-level tokenizer splits texts before it merges, and no split part goes on past a space that follows something else,
    nor from a letter or digit of Latin-1 to a mark of ASCII. So texts are cut there, all texts of a block at once in their bytes, and Arrow finds the
    distinct chunks. Each is encoded by ``tokenizers`` once, and its ids are looked up from then on. A new
    chunk of Latin-1 letters is one split part, so the tokenizer's model merges it as it is; other new
    chunks are encoded together, a line each: a line end between two of them is a token of its own.
    Texts with other white space than ASCII's or with one of the tokenizer's added tokens, and other kinds of tokenizers, are
    encoded whole.
    """

    OTHER_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel already
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        kind = self.whole.pre_tokenizer
        self.by_chunk = isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space and self.whole.normalizer is None
        self.line_end = self._encode(["\n"])[0]
        self.by_chunk = self.by_chunk and len(self.line_end) == 1
        letters = [c for c in map(chr, range(256)) if c.isalpha()]
        self.plain = re.compile(f" ?[{''.join(letters)}]+")
        self.forms = {ord(c): kind.pre_tokenize_str(c)[0][0] for c in [" ", *letters]} if self.by_chunk else {}  # as the model knows them
        self.known: dict[str, bytes] = {}  # ids as bytes, which are small and join fast
        self.older: dict[str, bytes] = {}  # chunks known before the last change; those met again go back to ``known``
        self.most = most

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of every text (null: empty)."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.OTHER_SPACE) if self.by_chunk else pa.array(np.ones(len(texts), bool))
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        parted = iter(self._by_chunk(texts.filter(pc.invert(whole))))
        alone = iter(texts.filter(whole).to_pylist())
        return [np.array(self._encode([next(alone)])[0], "<u4") if w else next(parted) for w in whole.to_pylist()]

    def _by_chunk(self, texts: pa.Array) -> list[np.ndarray]:
        data, offsets = raw(texts)
        starts = chunk_starts(data, offsets)
        bounds = pa.py_buffer(np.append(starts, len(data)))
        chunks = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(data)).dictionary_encode()
        ids, ends = self._ids(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        # the ids of all chunks in the order of the texts
        code = chunks.indices.to_numpy()
        lengths = np.diff(ends)[code]
        done = np.concatenate([[0], np.cumsum(lengths)])
        flat = ids[np.repeat(ends[code] - done[:-1], lengths) + np.arange(done[-1])]
        at = done[np.searchsorted(starts, offsets)].tolist()
        return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, joined, and the n + 1 offsets of the chunks in them."""
        if 2 * len(self.known) > self.most:
            self.known, self.older = {}, self.known
        # the chunks of a block of texts are always at hand; those not met for long are forgotten, which keeps a worker small
        new = {c for c in chunks if c not in self.known}
        met = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in met)
        self._learn(new - met)
        found = [self.known[c] for c in chunks]
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum([0, *map(len, found)]) // 4

    def _learn(self, chunks: set[str]) -> None:
        blank = [c for c in chunks if c.isspace()]
        self.known.update((c, np.array(ids, "<u4").tobytes()) for c, ids in zip(blank, self._encode(blank), strict=True))
        plain = [c for c in chunks if self.plain.fullmatch(c)]
        merge = self.whole.model.tokenize
        for c in plain:
            ids = [t.id for t in merge(c.translate(self.forms))]
            self.known[c] = struct.pack(f"<{len(ids)}I", *ids)
        words = list(chunks.difference(blank, plain))
        for i in range(0, len(words), 5_000):
            some = words[i : i + 5_000]
            ids = np.array(self._encode(["\n".join(some) + "\n"])[0], "<u4")
            ends = np.flatnonzero(ids == self.line_end[0])
            if len(ends) != len(some):
                raise ValueError("a chunk holds a line end")
            flat, start = ids.tobytes(), 0
            for c, end in zip(some, ends.tolist(), strict=True):
                self.known[c] = flat[4 * start : 4 * end]
                start = end + 1


def _cut(total: int, window: int, piece: int) -> list[tuple[int, int]]:
    full = total // window
    out = [(i * window, window) for i in range(full)]
    tail = total - full * window
    if tail:
        parts = -(-tail // piece)
        at = full * window
        for i in range(parts):
            size = tail // parts + (i < tail % parts)
            out.append((at, size))
            at += size
    return out


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, window: int = 1024, piece: int = 256, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: where it lies in the document, its length and the CRC-32 of its ids."""

    def run(batches):
        enc = Encoder(tokenizer_path)
        for batch in batches:
            for i, j in blocks(raw(batch.column(2))[1], 1 << 20):
                names = {k: [] for k in ("row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                rows, ids = (batch.column(c).slice(i, j - i).to_pylist() for c in range(2))
                for r, d, body in zip(rows, ids, enc.encode(batch.column(2).slice(i, j - i)), strict=True):
                    tokens = np.append(body, np.array([end_id], "<u4"))
                    buf = tokens.tobytes()
                    for start, length in _cut(len(tokens), window, piece):
                        names["row_id"].append(r)
                        names["doc_id"].append(d)
                        names["start"].append(start)
                        names["length"].append(length)
                        names["ids_crc32"].append(zlib.crc32(buf[4 * start : 4 * (start + length)]))
                        names["doc_tokens"].append(len(tokens))
                        names["ids"].append(tokens[start : start + length].astype(np.int32) if with_ids else None)
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(names.values(), kinds, strict=True)], list(names))

    src = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return src.mapInArrow(tidy(run), PIECE_SCHEMA)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0..k-1) of every size under k-way largest differencing.

    A partial partition with an empty slot keeps the spread of its largest slot, so it goes on being merged with the next
    largest size until it is full or a full partition of larger spread comes in between. That stretch is done in one step.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    left, right = np.full(n + n * k, -1, np.int64), np.full(n + n * k, -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    ranked = sizes[order]
    used, heap, tick, at = n, [], 0, 0  # heap: partitions without an empty slot, or several of them

    def push(sums: np.ndarray, nodes: np.ndarray) -> None:
        nonlocal tick
        by = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tick, sums, nodes))
        tick += 1

    def take() -> tuple[np.ndarray, np.ndarray]:
        nonlocal at
        if at == n or (heap and -heap[0][0] >= ranked[at]):
            _, _, sums, nodes = heapq.heappop(heap)
            return sums, nodes
        limit = -heap[0][0] if heap else -1
        end = min(n, at + k, at + int(np.searchsorted(-ranked[at:], -limit, side="left")))
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[: end - at], nodes[: end - at] = ranked[at:end], order[at:end]
        at = end
        return sums, nodes

    while at < n or len(heap) > 1:
        s1, n1 = take()
        if n1[-1] >= 0 and s1[-1] > 0 and (at < n or heap):  # a full partition of its own
            push(s1, n1)
            continue
        if at == n and not heap:
            push(s1, n1)
            break
        s2, n2 = take()
        s2, n2 = s2[::-1], n2[::-1]
        nodes = np.where(n1 < 0, n2, n1)
        both = np.flatnonzero((n1 >= 0) & (n2 >= 0))
        if len(both):
            new = np.arange(used, used + len(both))
            left[new], right[new] = n1[both], n2[both]
            nodes[both] = new
            used += len(both)
        push(s1 + s2, nodes)
    part = np.full(used, -1, np.int64)
    for p, node in enumerate(heap[0][3]):
        if node >= 0:
            part[node] = p
    for node in range(used - 1, n - 1, -1):
        if part[node] >= 0:
            part[left[node]] = part[right[node]] = part[node]
    return part[:n]


def pack_sizes(sizes: np.ndarray, window: int) -> np.ndarray:
    """The window of every size, their number rising whenever a window would exceed its capacity.

    The fullest window is a nearly constant multiple of the mean, so the number that would fit follows from it; what
    is missing is added at a time, at least one window.
    """
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        part = difference(sizes, k)
        most = int(np.bincount(part, weights=sizes, minlength=k).max(initial=0))
        if most <= window:
            return part
        k += max(1, k * most // window - k)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, piece: int = 256, block_tokens: int = 262_144, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with the window (``sequence_id``) and the offset in it that hold them."""
    with small_batches(docs.sparkSession):
        pieces = materialize(tokenize_pieces(docs, tokenizer_path, window, piece, end_id, with_ids), "pieces")
    tails = pieces.where(F.col("length") < window)
    total = tails.agg(F.sum("length")).first()[0] or 0
    n_blocks = max(1, round(total / block_tokens))

    def place(key, pdf):
        pdf = pdf.sort_values(["row_id", "start"], ignore_index=True)
        size = pdf["length"].to_numpy()
        seq = pack_sizes(size, window)
        order = np.argsort(seq, kind="stable")
        ends = np.cumsum(size[order])
        starts = ends - size[order]
        first = np.concatenate([[True], np.diff(seq[order]) > 0])
        offset = np.empty(len(pdf), np.int64)
        offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        pdf["sequence_id"] = (((int(key[0]) << 32) + seq) << 1) + 1
        pdf["offset"] = offset
        return pdf.drop(columns="block")

    # full windows have even numbers, windows of tails odd ones
    full = pieces.where(F.col("length") == window).withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    dealt = tails.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(n_blocks)))
    return full.unionByName(dealt.groupBy("block").applyInPandas(place, PIECE_SCHEMA + ", sequence_id long, offset long"))
