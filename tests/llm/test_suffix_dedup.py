import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from grainmill.llm import suffix_dedup
from grainmill.llm.suffix_dedup import remove_repeats, repeated_starts


def brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def run(spark, texts, n, **k):
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, portion string")
    rows = sorted(remove_repeats(df, n, with_kept=True, **k).collect(), key=lambda r: r["doc_id"])
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in rows]


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    return [" ".join(rng.choice(shared)[rng.randint(0, 20) :] if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [512, 4])
def test_matches_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    texts = corpus(random.Random(chunk), 80) + [None, "", "short", "a" * 400, "ab" * 300, "x" * 39, "x" * 40]
    assert run(spark, texts, 40, bucket_bytes=4000) == brute(texts, 40)


def test_edges(spark):
    assert run(spark, [], 40) == []
    assert run(spark, [None, "", "abc"], 40) == brute([None, "", "abc"], 40)
    text = " ".join(f"w{i}" for i in range(30_000))
    assert [r[1] for r in run(spark, [text, text], 200)] == [len(text)] * 2


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(3, 12))
        segments = [rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(n, 2 * n + 3))).astype(np.uint8) for _ in range(int(rng.integers(1, 30)))]
        count = Counter(bytes(s[i : i + n]) for s in segments for i in range(len(s) - n + 1))
        for s, hit in zip(segments, repeated_starts(segments, n), strict=True):
            assert [count[bytes(s[i : i + n])] > 1 for i in range(len(s) - n + 1)] == hit.tolist()


def test_batches_bounded_by_bytes(spark):
    texts = corpus(random.Random(9), 300)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4000")
    try:
        assert run(spark, texts, 40) == brute(texts, 40)
    finally:
        spark.conf.set(name, before)


def test_portion_without_facts_is_an_error(spark):
    docs = spark.createDataFrame([(1, "some words " * 50)], "doc_id long, text string")
    stored = suffix_dedup.stored_portions(docs)
    status = suffix_dedup.anchor_status(stored, 40)
    assert status.count()
    for a, b in ((stored, status.limit(0)), (stored.limit(0), status)):
        with pytest.raises(Exception, match="facts"):
            suffix_dedup.contested_segments(a, b, 40).collect()
