"""Claims, acceptance, frozen files, regrading, pools of calls and memos on small cases."""

import hashlib
import os
import threading
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from grainmill.operators import acceptance as A, calls, regrade as G
from grainmill.operators.claims import Claim, check
from grainmill.sources import files

CLAIMS = [
    Claim("best", "extreme", "acc", r"best is (\w+) at (\d+\.\d+)"),
    Claim("worst", "extreme", "acc", r"worst is (\w+) at (\d+\.\d+)", highest=False),
    Claim("count", "count", "acc", r"(\S+) runs beat base", baseline="base"),
    Claim("span", "range", "loss", r"loss lies in (\d+\.?\d*) to (\d+\.?\d*)"),
]


def test_claims(spark):
    figures = [("a", "base", "acc", 0.5), ("a", "x", "acc", 0.81234), ("a", "y", "acc", 0.81234), ("a", "z", "acc", 0.2), ("a", "x", "loss", 1.04), ("a", "y", "loss", 3.0), ("a", "w", "acc", None)]
    texts = {
        "right": "best is y at 0.812; worst is z at 0.2. 2 runs beat base. loss lies in 1.0 to 3",
        "numeral": "二 runs beat base",
        "wrong": "best is z at 0.8123; worst is z at 0.3. 3 runs beat base. loss lies in 1.1 to 3",
        "wrong_run": "best is nobody at 0.8123",
        "twice": "best is y at 0.812. best is y at 0.812.",
        "null": None,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc string, text string")
    f = spark.createDataFrame([(d, r, m, v) for d in texts for _, r, m, v in figures], "doc string, run string, metric string, value double")
    got = {(r["doc"], r["name"]): r["verdict"] for r in check(docs, f, CLAIMS).collect()}
    assert len(got) == len(texts) * len(CLAIMS)
    assert {got["right", c.name] for c in CLAIMS} == {"ok"} and {got["wrong", c.name] for c in CLAIMS} == {"wrong"}
    assert got["numeral", "count"] == "ok" and got["numeral", "best"] == "missing"
    assert got["wrong_run", "best"] == "wrong" and got["twice", "best"] == "ambiguous"
    assert {got["null", c.name] for c in CLAIMS} == {"missing"}
    unmeasured = check(docs.where("doc = 'right'"), f.where("false"), CLAIMS)
    assert {r["verdict"] for r in unmeasured.collect()} == {"unmeasured"}


def manifest(spark, change=None):
    rows = [{"id": i, "lot": f"l{i // 4}", "split": "train" if i < 12 else "val", "path": f"f{i}", "colours": [1, 2]} for i in range(20)]
    if change:
        change(rows)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "id long, lot string, split string, path string, colours array<int>")


def verdicts(spark, change=None, states=()):
    m = manifest(spark, change)
    there = spark.createDataFrame([(f"f{i}",) for i in range(20)], "path string")
    s = spark.createDataFrame([("x", "ok"), *states], "path string, state string")
    rule = F.when(F.substring("lot", 2, 9).cast("int") < 3, "train").otherwise("val")
    train, val = m.where("split = 'train'"), m.where("split = 'val'")
    faults = [
        A.fault("ids", A.repeated(m, "id"), F.col("id")), A.fault("files", A.absent(m, there, "path"), F.col("id")), A.fault("rule", A.off_rule(m, rule), F.col("id")),
        A.fault("lots", A.straddling(m, "lot"), F.col("lot")), A.fault("palette", A.foreign_colours(m, "id", "colours", [1, 2, 3]), F.col("id")),
        A.fault("apart", A.overlap(train, val, "id"), F.col("id")), A.fault("sums", s.where("state <> 'ok'"), F.col("path")), A.empty("val", val),
    ]
    rows = {r["check"]: r for r in A.report(faults).collect()}
    red = {k for k, r in rows.items() if not r["passed"]}
    assert ("all" in red) == bool(red - {"all"}) and len(rows) == 9
    return red - {"all"}, rows


def test_acceptance_turns_red_for_each_fault(spark):
    assert verdicts(spark)[0] == set()
    put = lambda i, k, v: lambda rows: rows[i].__setitem__(k, v)
    red, rows = verdicts(spark, put(3, "id", 2))
    assert red == {"ids"} and rows["ids"]["bad"] == 1 and rows["ids"]["examples"] == ["2"]
    assert verdicts(spark, put(3, "path", "gone"))[0] == {"files"}
    assert verdicts(spark, put(3, "path", None))[0] == {"files"}
    assert verdicts(spark, put(0, "split", "val"))[0] == {"rule", "lots"}
    assert verdicts(spark, put(5, "colours", [1, 9]))[0] == {"palette"}
    assert verdicts(spark, put(19, "id", 1))[0] == {"ids", "apart"}
    assert verdicts(spark, states=[("y", "extra")])[0] == {"sums"}
    assert verdicts(spark, lambda rows: [r.update(split="train") for r in rows])[0] == {"rule", "val"}


def test_frozen_folder(spark, tmp_path):
    """Files and digests by an independent writer and reader."""
    root = tmp_path / "it's here"
    for name in ("b.txt", "a.bin", "deep/c.json", "empty"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode() * 1000 if name != "empty" else b"")
    files.freeze(spark, str(root))
    lines = (root / "SHA256SUMS").read_text().splitlines()
    assert lines == [f"{hashlib.sha256((root / n).read_bytes()).hexdigest()}  {n}" for n in ("a.bin", "b.txt", "deep/c.json", "empty")]
    files.freeze(spark, str(root))
    assert (root / "SHA256SUMS").read_text().splitlines() == lines
    assert {r["state"] for r in files.verify_frozen(spark, str(root)).collect()} == {"ok"}
    (root / "b.txt").write_text("other")
    (root / "a.bin").unlink()
    (root / "deep" / "new").write_text("x")
    assert {r["path"]: r["state"] for r in files.verify_frozen(spark, str(root)).collect()} == {"a.bin": "missing", "b.txt": "changed", "deep/c.json": "ok", "deep/new": "extra", "empty": "ok"}


def test_find_files_below_nested_folders(spark, tmp_path):
    for name in ("x/one.pkl", "x/y/z/two.pkl", "three.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = files.find_files(spark, str(tmp_path), "*.pkl").collect()
    assert sorted((os.path.basename(r["path"]), r["length"]) for r in found) == [("one.pkl", 5), ("two.pkl", 5)]


def test_ordered_table(spark, tmp_path):
    df = spark.range(5000).select(F.xxhash64("id").alias("k"), F.struct((F.col("id") % 3).alias("a"), F.lit("q").alias("b")).alias("f"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    counts = files.write_ordered(files.flattened(df, "f", "feat_"), str(tmp_path / "t"), ["k"], {"zeros": F.count_if(F.col("feat_a") == 0)})
    assert counts == {"rows": 5000, "zeros": 1667}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "t").glob("part-*"))
    keys = [k for p in parts for k in pq.read_table(p).column("k").to_pylist()]
    assert len(parts) > 1 and keys == sorted(keys) and len(keys) == 5000
    assert pq.ParquetFile(parts[0]).metadata.row_group(0).column(0).compression == "ZSTD"
    assert files.ordered(spark, str(tmp_path / "t"), "k").first()["in_order"]
    df.select("k").repartition(4).write.parquet(str(tmp_path / "u"))
    assert not files.ordered(spark, str(tmp_path / "u"), "k").first()["in_order"]


def test_memo_survives_crashes(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(10)

    crashed = tmp_path / "only_temporary"
    (crashed / "_temporary" / "0").mkdir(parents=True)
    half = tmp_path / "half"
    spark.range(10).repartition(2).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    next(half.glob("part-*")).unlink()
    for path in (crashed, half, tmp_path / "new"):
        for reused in (False, True):
            table, there = calls.memo(spark, str(path), make)
            assert (table.count(), there) == (10, reused)
    assert len(made) == 3


def test_pool_is_bounded_ordered_and_complete(spark):
    lock, state = threading.Lock, {}

    def call(row):
        guard = state.setdefault("lock", lock())
        with guard:
            state["now"] = state.get("now", 0) + 1
            seen = state["now"]
        time.sleep(0.002 * (row["id"] % 5))
        with guard:
            state["now"] -= 1
        if row["id"] % 7 == 0:
            raise ValueError(f"no {row['id']}")
        return str(seen)

    state["lock"] = None
    state.clear()
    rows = spark.range(0, 200, 1, 2).withColumn("status_", F.lit("kept"))
    out = calls.pooled(rows, call, workers=3).collect()
    assert [r["id"] for r in out] == list(range(200))
    bad = [r for r in out if r["status"] == "error"]
    assert [r["id"] for r in bad] == [i for i in range(200) if i % 7 == 0] and bad[1]["error"] == "ValueError: no 7"
    most = max(int(r["value"]) for r in out if r["value"])
    assert 1 < most <= 3
    assert calls.pooled(rows.where("false"), call).collect() == []


def test_pool_drops_what_has_not_begun(spark, tmp_path):
    """A reader that has enough ends the task; no more calls begin than the pool had read ahead."""
    where = str(tmp_path)

    def call(row):
        open(f"{where}/{row['id']}", "w").close()
        time.sleep(0.01)
        return "x"

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        assert len(calls.pooled(spark.range(0, 6000, 1, 1), call, workers=2).limit(10).collect()) == 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    time.sleep(0.5)
    assert len(os.listdir(where)) < 5000


def test_regrade(spark):
    golds = spark.createDataFrame([(1, "a", "x", "s"), (2, "a", "y", None), (3, "b", None, None), (4, "a", "y", "t")], "id int, d1 string, d2 string, special string")
    answers = spark.createDataFrame([("r", 1, "s"), ("r", 2, "a"), ("r", 3, None), ("r", 4, "y"), ("r", 9, "a"), ("q", 3, "b")], "run string, id int, answer string")
    got = {(r["run"], r["definition"]): (r["hits"], r["n"], round(r["accuracy"], 6), r["floor"], r["beats_floor"]) for r in G.regrade(golds, answers, ["d1", "d2"], {"d2": "special"}, {"d1": "b"}).collect()}
    assert got == {("r", "d1"): (1, 3, 0.333333, 0.25, True), ("r", "d2"): (2, 3, 0.666667, 0.5, True), ("q", "d1"): (1, 1, 1.0, 0.25, True), ("q", "d2"): (0, 1, 0.0, 0.5, False)}


def test_points_are_added_up_in_the_order_of_the_table(spark, tmp_path):
    import duckdb

    from grainmill.plans import registry

    # their spread is 0.25 but for the last bit; cut into many partitions and shuffled by key, they keep the order of the file
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("create table lineitem as select i % 97 + 1 l_orderkey, cast(1 + i * 5 % 6 as integer) l_linenumber, (i * 31 % 11) / 100.0::double l_discount, (i * 17 % 9) / 100.0::double l_tax from range(400) t(i)")
    con.execute("insert into lineitem values (96720, 6, 0.05, 0.06), (96720, 5, 0.1, 0.01), (11018, 5, 0.01, 0.07), (11018, 4, 0.02, 0.04), (11018, 3, 0.06, 0.08), (11018, 6, 0.01, 0.04), (11018, 5, 0.01, 0.01), (11018, 4, 0.03, 0.03), (11018, 6, 0.0, 0.04), (11018, 5, 0.05, 0.01)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    want = sorted(tuple(r) for r in con.execute(registry.oracle_sql()["regrade"]).fetchall())
    assert sorted(tuple(r) for r in registry.queries()["regrade"](spark, str(tmp_path)).collect()) == want
    value = lambda p: p["x"]
    rows = spark.createDataFrame([([(0.1,), (0.2,), (0.3,)],), ([(0.3,), (0.2,), (0.1,)],), ([],)], "p array<struct<x: double>>")
    got = [tuple(r[0]) for r in rows.select(G.in_order(F.col("p"), value)).collect()]
    assert got[0][0] == (0.1 + 0.2 + 0.3) / 3 and got[1][0] == (0.3 + 0.2 + 0.1) / 3 and got[2] == (None, None)


def test_a_mean_on_a_bound_is_not_below_it_in_any_order(spark, tmp_path):
    import duckdb

    from grainmill.plans import registry

    # means of 0.35 exactly, which sums of doubles reach or miss by the last bit, some of them by their order; and lines and orders without values
    rows = [(1, 1, 0.05, 0.03), (1, 4, 0.09, 0.04), (2, 1, 0.04, 0.04), (2, 1, 0.02, 0.04), (2, 4, 0.01, 0.04), (2, 7, 0.05, 0.06)]
    rows += [(3, *r[1:]) for r in rows[:1:-1]] + [(4, 2, None, 0.02), (4, 2, 0.06, 0.02), (5, 1, None, 0.01), (6, None, 0.1, 0.08), (None, 1, 0.0, 0.0), (7, 5, float("nan"), 0.01)]
    for turn, part in (("there", rows), ("back", rows[::-1])):
        (tmp_path / turn).mkdir()
        con = duckdb.connect()
        con.execute("create table lineitem (l_orderkey bigint, l_linenumber integer, l_discount double, l_tax double)")
        con.executemany("insert into lineitem values (?, ?, ?, ?)", part)
        con.execute(f"copy lineitem to '{tmp_path}/{turn}/lineitem.parquet' (format parquet)")
        want = {tuple(r) for r in con.execute(registry.oracle_sql()["regrade"]).fetchall()}
        got = {tuple(r) for r in registry.queries()["regrade"](spark, f"{tmp_path}/{turn}").collect()}
        assert got == want and {r[:4] for r in got if r[:2] == (1, "outer_extent")} == {(1, "outer_extent", 3, 3)}
        assert {r[5] for r in got if r[1] == "mean_radius"} == {round(4 / 8, 9)} and any(r[0] is None for r in got)


def test_requests_are_rebuilt_as_they_were(spark):
    core = spark.createDataFrame([(1, "p1"), (2, "p2")], "id int, image string")
    asked = G.label_requests(core, "id", "image", "S", "P")
    again = G.chat_requests(G.exploded(asked, "id").orderBy(F.rand(1)), "id")
    messages = lambda df: {r["id"]: [tuple(m) for m in r["messages"]] for r in df.collect()}
    assert messages(again) == messages(asked) == {i: [("system", "S"), ("user", "<image>\nP")] for i in (1, 2)}
    chat = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "assistant", "c"), (2, 0, "assistant", "alone"), (3, 0, "user", None)]
    got = {r["id"]: (len(r["messages"]), r["answer"]) for r in G.chat_requests(spark.createDataFrame(chat, "id int, turn int, role string, text string"), "id").collect()}
    assert got == {1: (3, "b"), 3: (1, None)}


@pytest.mark.parametrize("missing", [True, False])
def test_format_gap_counts_absent_answers_as_wrong(spark, missing):
    gold = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, gold string")
    one = spark.createDataFrame([(1, "a"), (3, "b")] + ([] if missing else [(2, "a")]), "id int, answer string")
    two = spark.createDataFrame([(1, "A"), (2, "A"), (3, None)], "id int, answer string")
    got = {r["gold"]: (r["one"], r["two"], r["gap"]) for r in G.format_gap(gold, {"one": (one, lambda x: x), "two": (two, F.lower)}).collect()}
    assert got == {"a": (0.5, 1.0, 0.5) if missing else (1.0, 1.0, 0.0), "b": (1.0, 0.0, -1.0)}


@pytest.mark.parametrize("blocks", [(7, 13), (4096, 16_384)])
def test_similar_vectors_in_blocks(spark, blocks):
    from grainmill.operators import ranking as R

    rows = [(i, i % 3, [float(a), float(b), 1.0]) for i in range(60) for a, b in [((i * 7) % 5, (i * 3) % 4)]] + [(99, 0, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, apart long, e array<double>").select("id", "apart", R.normalised(F.col("e")).alias("vec")).where("vec IS NOT NULL")
    side = lambda df, n: df.select(*(F.col(c).alias(f"{n}_{c}") for c in df.columns))
    got = sorted((r["q_id"], r["rank"], r["c_id"]) for r in R.cosine_topk(side(v.where("id % 10 = 0"), "q"), side(v, "c"), 5, *blocks).collect())
    unit = {i: [x / sum(y * y for y in e) ** 0.5 for x in e] for i, _, e in rows[:-1]}
    want = []
    for q in range(0, 60, 10):
        near = sorted((-round(sum(x * y for x, y in zip(unit[q], unit[c], strict=True)), 9), c) for c in range(60) if c % 3 != q % 3)
        want += [(q, k, c) for k, (_, c) in enumerate(near[:5], 1)]
    assert got == sorted(want)
    assert R.cosine_topk(side(v.where("false"), "q"), side(v, "c"), 5, *blocks).collect() == []
