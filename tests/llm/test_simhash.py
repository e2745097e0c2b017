import random
import re

import numpy as np
import pytest
import xxhash

from grainmill.llm import simhash
from grainmill.llm.simhash import components, forest, links


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def brute(rows):
    prints = [fingerprint(x) for _, x in rows]
    group = grouped(prints)
    low = {}
    for g, (d, _) in zip(group, rows, strict=True):
        low[g] = min((x for x in (low.get(g), d) if x is not None), default=None)
    return sorted(((d, f"{p:016x}", low[g]) for (d, _), p, g in zip(rows, prints, group, strict=True)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, x, 0, 1, 2) for d, x in rows], "doc_id long, text string, fp int, row_id int, _salt int")
    return sorted((tuple(r) for r in components(df).collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "x").split()
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = rng.choice(["é", "B", "cc"])
        else:
            w = [rng.choice(["Ab", "ñu", "c", "dd", "e-e", "f g"]) * rng.randint(1, 4) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        rows.append((900 - i, rng.choice([" ", "\n", " \t"]).join(w)))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(5, None), (4, ""), (None, " \n"), (8, "a"), (7, "A"), (3, long), (2, long + " x"), (2, long), (None, "z y"), (None, "q q q q")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("most", [2, 40, 512])
def test_lists_of_any_length(spark, most):
    """Clusters of fingerprints one to six bits apart, more than a list may hold before it is dealt out again."""
    rng = np.random.default_rng(3)
    prints = list(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    for centre in prints[:6]:
        for _ in range(60):
            prints.append(centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False))))
    prints = sorted({int(x) for x in prints})
    rows = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links(rows, most).collect()]
    assert all(a != b for a, b in found)
    place = {x: i for i, x in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        root[find(place[a])] = find(place[b])
    same = lambda x: {frozenset(i for i, y in enumerate(x) if y == g) for g in x}
    assert same([find(i) for i in range(len(prints))]) == same(grouped(prints))


def test_forest_connects_the_same_nodes():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50, (2, 40))
    node, root = forest(a, b)
    assert len(node) == len(set(node)) and (root < node).all() and not set(node) & set(root)
    assert forest(a[:0], b[:0])[0].size == 0


def test_every_two_bit_link_meets_in_a_list():
    """Two changed bits leave two whole pairs of positions, and six positions, as they were."""
    for x in range(64):
        for y in range(x):
            touched = {x // 8, y // 8}
            assert any(not touched & {2 * i, 2 * i + 1, 2 * j, 2 * j + 1} for i, j in simhash.PAIRS)
            assert any(not touched & set(s) for s in simhash.SIXES)
