import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from grainmill.llm.bytesops import term_bytes, word_hashes
from grainmill.llm.lexical import TERM, Vocabulary, search


def terms(text):
    return re.findall(TERM, re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(d, Counter(terms(x))) for d, x in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for row, (d, b) in enumerate(bags):
            m = 25 + 75 * sum(b.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, row, d))
        out += [(item, rank, x[4], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=10, **more):
    d = spark.createDataFrame([(i, x, "t", 1) for i, x in docs], "doc_id long, text string, term string, bucket int")
    q = spark.createDataFrame([(i, x, 2) for i, x in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in search(d, q, k, **more).collect()), key=repr)


@pytest.mark.parametrize("most_terms", [300_000, 0])
def test_matches_brute_force(spark, most_terms):
    rng = random.Random(2)
    words = ["the", "The", "ça", "x1", "Ünit", "ümit", "名前", "of", "rare"] + [f"t{i}" for i in range(60)]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(n))
    docs = [(rng.randint(0, 10**6), text(rng.randint(0, 80))) for _ in range(150)]
    docs += docs[:20]
    items = [(i, text(rng.randint(1, 30))) for i in range(12)]
    assert run(spark, docs, items, most_terms=most_terms) == brute(docs, items, 10)
    assert run(spark, docs, items, k=3, most_terms=most_terms) == brute(docs, items, 3)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,!"), (None, "alpha beta"), (4, "alpha beta"), (5, "alpha beta"), (5, "gamma " * 200_000), (6, "a\x00b")]
    items = [(1, "ALPHA alpha"), (1, "beta"), (None, "gamma b"), (2, None), (3, ""), (4, "nowhere")]
    got = run(spark, docs, items)
    assert got == brute(docs, items, 10)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 1][-1] is None
    assert run(spark, [], items) == run(spark, docs, []) == []


def test_vocabulary_compares_bytes():
    v = Vocabulary(["abc", "é", "abcd"])
    data = np.frombuffer("abcd x é abc éé".encode(), np.uint8)
    h, _, a, b = word_hashes(data, np.array([0, len(data)]), term_bytes())
    assert v.numbers(h, data, a, b - a).tolist() == [2, -1, 1, 0, -1]
    # an equal hash of other bytes is no hit
    assert v.numbers(h[[3, 3]], data, a[[3, 0]], np.array([3, 4])).tolist() == [0, -1]
