import random
import re

import numpy as np
from pyspark.sql import functions as F

from grainmill.llm.decontamination import K1, B, build, decontaminate, rounds, split_item, with_hits


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, threshold=0.5, overlap=0.8):
    """Every passage against every item, with plain sums and sets."""
    items = [(i, t) for i, t in items if words(t)]
    n, mean = len(items), np.mean([len(words(t)) for _, t in items])
    df = {}
    for _, t in items:
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1
    bands = {}
    for i, t in items:
        bands.setdefault(int(np.ceil(np.log2(max(len(words(t)), 32)))), []).append((i, t))
    out = set()
    for d, text in docs:
        h = words(text)
        for power, band in bands.items():
            step = 1 << power
            for p in range(max(-(-len(h) // step) - 1, 1) if h else 0):
                own = h[p * step : (p + 2) * step]
                for i, t in band:
                    w = words(t)
                    impact = {x: np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (K1 + 1) / (w.count(x) + K1 * (1 - B + B * len(w) / mean)) for x in set(w)}
                    if sum(v for x, v in impact.items() if x in set(own)) / sum(impact.values()) < threshold:
                        continue
                    shares = []
                    for part in (*split_item(t), t):
                        pw = words(part)
                        g = grams(pw, min(5, len(pw))) if pw else set()
                        shares.append(len(g & grams(own, min(5, len(pw)))) / len(g) if g else 1.0)
                    if (shares[0] >= overlap and shares[1] >= overlap) or shares[2] >= overlap:
                        out.add((d, p, i))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + (rng.choice("klmnop") if rng.random() < 0.7 else "")
    items = [(i, ". ".join(" ".join(word() for _ in range(rng.randint(2, 20))) for _ in range(rng.randint(1, 3)))) for i in range(40)] + [(90, "one two"), (91, "!!"), (92, None), (93, " ".join(word() for _ in range(120)))]
    docs = []
    for d in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 120)))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = "edit"
            parts += [" ".join(w).upper() if rng.random() < 0.3 else " ".join(w), " ".join(word() for _ in range(rng.randint(0, 90)))]
        docs.append((d, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "One, TWO!"), (203, items[3][1]), (203, items[3][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string")
    it = spark.createDataFrame(items, "item_id long, text string")
    for sizes in ({}, {"shard_bytes": 20_000}, {"shard_bytes": 20_000, "broadcast_bytes": 40_000}):
        got = {(r["doc_id"], h["passage"], h["item_id"]) for r in with_hits(df, it, **sizes).collect() for h in r["hits"]}
        assert got == brute(docs, items)
    assert with_hits(df.limit(0), it).collect() == []
    assert all(r["hits"] == [] for r in with_hits(df, it.limit(0)).collect())


def test_many_shards_find_the_same_and_columns_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").withColumn("row_id", F.col("doc_id") * 2)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = lambda **k: sorted((r["doc_id"], r["row_id"], sorted(h["item_id"] for h in r["hits"])) for r in with_hits(docs, items, **k).collect())
    one, many = found(), found(shard_bytes=20_000, broadcast_bytes=100_000)
    assert one == many and any(h for _, _, h in one)
    kept = decontaminate(docs.withColumn("hits", F.lit(7)), items)
    assert kept.columns == ["doc_id", "text", "row_id", "hits"] and {r["hits"] for r in kept.collect()} == {7}


def test_rounds_hold_every_shard_once_within_their_bytes(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    index = build(items, 0.5, 0.3, 20_000)
    sizes = {r[0]: r[1] for r in index.groupBy("shard").agg(F.sum(F.octet_length("state"))).collect()}
    got = rounds(index, 100_000)
    assert sorted(x for part in got for x in part) == sorted(sizes) and 1 < len(got) < len(sizes)
    assert all(len(part) == 1 or sum(sizes[x] for x in part) <= 100_000 for part in got)
    assert rounds(index, 1) == [[x] for x in sorted(sizes)]
