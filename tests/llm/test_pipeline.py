"""Every stage against a plain version of its decision, on the stage's own input."""

import os

import pytest

import corpus_pipeline as P
from grainmill.llm.shared import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in P.STAGES:
        out.append(materialize(f(spark, out[-1], SF), f"test-{name}"))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_line_dedup_stage(stages):
    from test_line_dedup import brute_spaces

    before = sorted(stages[1].collect(), key=lambda r: r["doc_id"])
    texts = brute_spaces([(r["doc_id"], r["text"]) for r in before])
    want = {r["doc_id"]: t for r, t in zip(before, texts, strict=True) if t == r["text"] or (t or "").strip()}
    after = stages[2].collect()
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicate_stage(stages):
    from test_ngram_join import brute

    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {c for d, n, c in brute(rows, 5, 80)}
    assert {r["doc_id"] for r in stages[3].collect()} == want


def test_decontamination_stage(spark, stages):
    from test_decontamination import brute

    rows = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _, _ in brute(rows, items)}
    assert {r["doc_id"] for r in stages[4].collect()} == {d for d, _ in rows} - leaked


def test_packing_stage_holds_every_document(stages):
    assert {r["doc_id"] for r in stages[5].select("doc_id").distinct().collect()} == {r["doc_id"] for r in stages[4].collect()}


def test_cases_and_clashing_columns(spark):
    """Nulls, blanks, repeated rows, names that the operators use: every stage keeps the values of what it keeps."""
    names = ["keep", "score", "evidence", "row_id", "removed", "hits", "hit", "component_id", "n_shingles", "_salt", "_salts", "n_lines_"]
    text = "A line that stands alone here.\nAnother quite plain line of words follows it.\nAnd a third one ends the text."
    rows = [(1, text, "en", "site"), (1, text, "en", "site"), (None, text + " more", None, None), (3, None, None, "site"), (4, "", "en", None), (5, " \n\t", "en", "site"), (6, "one", "de", "site"), (7, "x " * 50_000, "en", "site")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(d, t, lang, s, len(t or ""), *(f"{n}{i}" for n in names)) for i, (d, t, lang, s) in enumerate(rows)], schema)
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, SF), f"case-{name}")
        if name != "packing":
            assert out.columns == docs.columns
            kept = out.collect()
            assert all(len({r[n][len(n) :] for n in names}) == 1 for r in kept)
            assert name == "quality" or {r["doc_id"] for r in kept} >= {3, 4, 6}
        empty = stage(spark, docs.where("false"), SF)
        assert empty.collect() == []
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}


def test_quality_stage_by_plain_sums(spark, stages):
    """Posteriors and decisions recomputed from the evidence by sums over sites, host before path."""
    import math
    from collections import defaultdict

    from grainmill.llm.queries import quality_scores

    rows = quality_scores(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    p = [1 / (1 + math.exp(-r["evidence"])) for r in rows]
    host, path = defaultdict(list), defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        host[r["source"]].append(x)
        path[r["source"], r["lang"]].append(x)

    def strength(groups):
        """Within over between variance of {parent: [values of each child]}."""
        q = sum(x * x for kids in groups.values() for v in kids for x in v)
        ssn = sum(sum(v) ** 2 / len(v) for kids in groups.values() for v in kids)
        n = {a: sum(map(len, kids)) for a, kids in groups.items()}
        dof, more = sum(n[a] - len(kids) for a, kids in groups.items()), sum(len(kids) - 1 for kids in groups.values())
        base = sum(n[a] - sum(len(v) ** 2 for v in kids) / n[a] for a, kids in groups.items())
        if not dof or not more or not base:
            return 10.0
        within = max((q - ssn) / dof, 1e-6)
        between = max((ssn - sum(sum(map(sum, kids)) ** 2 / n[a] for a, kids in groups.items()) - more * within) / base, 1e-6)
        return min(max(within / between, 1.0), 1e4)

    by_host = defaultdict(list)
    for (a, _), v in path.items():
        by_host[a].append(v)
    k_host, k_path, mean = strength({0: list(host.values())}), strength(by_host), sum(p) / len(p)
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    kept = set()
    for r, x in zip(rows, p, strict=True):
        h = (k_host * mean + sum(host[r["source"]]) - x) / (k_host + len(host[r["source"]]) - 1)
        own = path[r["source"], r["lang"]]
        s = (k_path * h + sum(own) - x) / (k_path + len(own) - 1)
        score = 1 / (1 + math.exp(-(r["evidence"] + logit(s) - logit(mean))))
        assert (r["host_posterior"], r["path_posterior"], r["score"]) == pytest.approx((h, s, score), rel=1e-9, abs=1e-12)
        assert r["keep"] == (r["score"] >= 0.9)
        kept |= {r["doc_id"]} if r["keep"] else set()
    assert {r["doc_id"] for r in stages[1].collect()} == kept


def test_text_stages_run_in_small_batches(spark, monkeypatch, tmp_path):
    """Every stage that reads texts in Python does so within the bound on Arrow batches, and the session's setting stays."""
    from pyspark.sql.readwriter import DataFrameWriter

    name, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", {}, DataFrameWriter.parquet

    def parquet(self, path, *a, **b):
        seen[path.rsplit("/", 1)[-1].rsplit("-", 1)[0]] = spark.conf.get(name, None)
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    P.run(spark, SF)
    assert {k: seen[k] for k in ("labelled", "evidence", "profiles", "decontaminated", "pieces")} == dict.fromkeys(("labelled", "evidence", "profiles", "decontaminated", "pieces"), str(4 << 20))
    assert seen["stage-line_dedup"] is None and spark.conf.get(name, None) is None
