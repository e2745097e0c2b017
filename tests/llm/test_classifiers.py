import random

import pytest
from pyspark.sql import functions as F

from grainmill.llm.language_id import identify
from grainmill.llm.quality import classify

DOCS = "doc_id long, text string, lang string, source string, score string"


def words(rng, stems, n):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


STEMS = {"aa": ["the", "ing", "er"], "bb": ["que", "los", "ción"], "cc": ["sch", "ung", "ße"]}


def test_language_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, STEMS[(lang := rng.choice(list(STEMS)))], rng.randint(3, 40)), lang, "s", None) for i in range(600)]
    rows += [(1000, None, "aa", "s", None), (1001, "", "aa", "s", None), (1002, "12 !!", None, "s", None), (1003, "the " * 50_000, None, None, None), (1003, "the " * 50_000, None, None, None)]
    out = identify(spark.createDataFrame(rows, DOCS), F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [i for i in range(600) if i % 3 == 1]
    assert sum(by[i]["lang_pred"] == rows[i][2] for i in held) / len(held) > 0.97
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None, None, None)], DOCS)
    assert [r["lang_pred"] for r in identify(df, F.lit(False)).collect()] == ["und"]
    assert identify(df.limit(0), F.lit(False)).collect() == []


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        kind = rng.random()
        bad_site = i % 10 == 3
        quality, toxic = int(kind > (0.7 if bad_site else 0.15)), int(rng.random() < 0.1)
        text = words(rng, STEMS["aa"], rng.randint(10, 60))
        if not quality:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text += " nastyword " + words(rng, STEMS["aa"], 10)
        rows.append((i, text, "aa", f"s{i % 10}" if i % 50 else None, None))
        if i % 2:
            labels.append((i, quality, toxic))
    rows += [(2000, None, None, None, None), (2001, "", "aa", "s1", None), (2002, rows[1][1], "aa", "s1", None)]
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels + [(5, None, None)], "doc_id long, quality int, toxic int")
    return rows, {i: (q, t) for i, q, t in labels}, df, lab, classify(df, lab, F.col("source"), F.col("lang")).collect()


def test_quality_keeps_good_and_rejects_bad(scored):
    rows, labels, _, _, out = scored
    assert len(out) == len(rows)
    keep = {r["doc_id"]: r["keep"] for r in out}
    good = [i for i, (q, t) in labels.items() if q and not t]
    bad = [i for i, (q, t) in labels.items() if not q or t]
    assert sum(keep[i] for i in good) / len(good) > 0.97
    assert sum(keep[i] for i in bad) / len(bad) < 0.1


def test_sites_shrink_toward_their_parents(scored):
    by = {r["source"]: r["host_posterior"] for r in scored[4] if r["source"]}
    assert by["s3"] < min(v for s, v in by.items() if s != "s3")
    assert all(0 < r["path_posterior"] < 1 and 0 <= r["score"] <= 1 for r in scored[4])


def test_site_join_by_shuffle_gives_the_same(spark, scored):
    _, _, df, lab, out = scored
    other = classify(df, lab, F.col("source"), F.col("lang"), broadcast_sites=0).collect()
    key = lambda rows: sorted((r["doc_id"], round(r["score"], 9)) for r in rows)
    assert key(other) == key(out)


def test_quality_edges(spark, scored):
    _, _, df, lab, _ = scored
    assert classify(df.limit(0), lab, F.col("source"), F.col("lang")).collect() == []
    assert all(r["keep"] for r in classify(df.limit(5), lab.limit(0), F.col("source"), F.col("lang")).collect())
