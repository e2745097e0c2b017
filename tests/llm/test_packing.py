import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from grainmill.llm.packing import Encoder, difference, pack, pack_sizes

P = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
TEXTS = ["", None, "plain words", "  two  spaces\n\nlines\t tab ", "É l'été, it's 2024!! <|endoftext|>  x", "日本語 ☃ 🙂", "word " * 30_000]


def test_same_ids_as_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P)
    e, rng = Encoder(P, most=50), random.Random(3)
    assert e.by_chunk
    assert 50256 in plain.encode(TEXTS[4], add_special_tokens=False).ids
    letters = " \n\t'sdtrevml09.,!\x1c\x85\xa0\u2003\u3000é日\U0001f600\u0300\u200b\ufeff"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(8000)]
    marks = [*"&%#'\"-_/(", " ", "é", "don't", "I'll've", "Ab9", "7th", "x", "..."]
    texts += ["".join(rng.choices(marks, k=rng.randint(0, 12))) for _ in range(8000)]
    for i in range(0, len(texts), 500):
        got = e.encode(texts[i : i + 500])
        assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts[i : i + 500]]


def test_a_block_looks_up_each_distinct_chunk_once():
    class Counted(dict):
        asked = 0

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    e = Encoder(P)
    e.known = Counted()
    got = e.encode(["one two, three " * 5000] * 4)
    assert [x.tolist() for x in got] == [e.whole.encode("one two, three " * 5000, add_special_tokens=False).ids] * 4
    assert e.known.asked <= 3 * len(e.known)


def test_arrow_texts_encode_as_lists_do():
    e, texts = Encoder(P), [*TEXTS, " ", "a", "", " b", ", c\n", "\n\n d", None]
    for kind in (pa.string(), pa.large_string()):
        got = e.encode(pa.array(["dropped", *texts, "too"], kind).slice(1, len(texts)))
        assert [x.tolist() for x in got] == [e.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert e.encode([]) == [] and [x.tolist() for x in e.encode(["", None])] == [[], []]


def test_words_of_latin_letters_and_their_marks():
    e, rng = Encoder(P, most=2000), random.Random(5)
    letters = [chr(c) for c in range(0x20, 0x180) if not 0x7F <= c < 0xA0] + [" ", ",", "'s", "é", "\u0301", "\n"] * 20
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 25))).replace("\xa0", " ") for _ in range(6000)]
    got = e.encode(texts)
    assert [x.tolist() for x in got] == [x.ids for x in e.whole.encode_batch(texts, add_special_tokens=False)]
    alone = e.encode([c for c in letters if c.strip()])
    assert [x.tolist() for x in alone] == [e.whole.encode(c, add_special_tokens=False).ids for c in letters if c.strip()]


def slow_difference(sizes, k):
    """Largest differencing as it is told: merge the two partial partitions of largest spread until one is left."""
    heap = [[size] + [0] * (k - 1) for size in sizes]
    while len(heap) > 1:
        heap.sort(key=lambda x: x[0] - x[-1])
        a, b = heap.pop(), heap.pop()
        heap.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return sorted(heap[0])


def test_differencing_equals_the_plain_form():
    rng = np.random.default_rng(4)
    for n, k, high in ((40, 7, 100_000), (200, 25, 10**7), (9, 20, 1000), (60, 3, 10**6)):
        sizes = rng.choice(high, n, replace=False) + 1
        part = difference(sizes, k)
        assert sorted(np.bincount(part, weights=sizes, minlength=k).astype(int).tolist()) == slow_difference(sizes.tolist(), k)


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, block string").coalesce(1)
    rows = pack(df, P, block_tokens=8192, with_ids=True).collect()
    e, by_doc, by_seq = Encoder(P), {}, {}
    for r in rows:
        ids = np.array(r["ids"], "<u4")
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS * 3):
        got = [x for _, ids, _ in sorted(by_doc[i]) for x in ids]
        assert got == [*e.encode([t or ""])[0], 0] and by_doc[i][0][2] == len(got)
    for pieces in by_seq.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_seq) * 1024 <= total + 12 * 1024
    assert pack(df.limit(0), P).collect() == []


def test_differencing_is_near_equal_and_never_over():
    sizes = np.random.default_rng(1).integers(1, 257, 2000)
    part = pack_sizes(sizes, 1024)
    load = np.bincount(part, weights=sizes)
    assert load.max() <= 1024 and len(load) <= -(-sizes.sum() // 1024) + 2
    assert np.ptp(np.bincount(difference(sizes, 50), weights=sizes, minlength=50)) <= 2
