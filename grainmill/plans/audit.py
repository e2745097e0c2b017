"""Whole-report plans: full validation, the evaluation of all tasks, finished runs, table text, retries and stage memos."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import curate as C
from grainmill.operators.calls import memo, with_retries
from grainmill.plans.registry import _QUERIES, _SQL, query
from grainmill.plans.tables import MANIFEST, manifest
from grainmill.session import shared_dir, table
from grainmill.sources import files

PARTS = ["Hot-Widget", "cold_gear", "BlueRod", "Small-Plate", "Old_Ring", "large"]


@query("predicted_label", "select p_partkey id, case replace(p_name, ' ', '') " + " ".join(f"when '{v.lower().translate(str.maketrans('', '', ' _-'))}' then '{v}'" for v in PARTS) + " else 'INVALID' end label from part")
def predicted_label(spark, sf):
    """Names of parts as answers: a name of the vocabulary, spelt in another way there, or none of it."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.predicted_label(F.col("p_name"), PARTS).alias("label"))


SHAPES = {"click": ["ring", "arc"], "view": ["cluster"], "purchase": ["line", "arc"], "signup": ["cluster", "scattered"]}
CAUSES = ["because of", "Machine"]
_KINDS = ["click", "view", "purchase", "signup", "error"]
_SHAPE = ["ring", "arc", "cluster", "line", None]
_ZONE = ["center", "middle", "edge", "full", "none", "corner"]
_CLOCK = ["3", "12", "all", "none", "x", None, "7"]
_SIZE = ["0.5", "2.4", "9", "big", None]
_TEXT = ["a ring", "", "worn because of dust", "the MACHINE", "plain text"]


def _pick(values: list, i) -> object:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), i.cast("int"))


def _pick_sql(values: list, i: str) -> str:
    return f"case {i} " + " ".join(f"when {k} then {'null' if v is None else repr(v)}" for k, v in enumerate(values)) + " end"


_ANN = f"""ann as (select event_id id, event_type gold, case when event_id % 11 < 8 then event_type else {_pick_sql(_KINDS, 'event_id % 5')} end predicted, {_pick_sql(_ZONE, 'event_id % 6')} zone,
 case when event_type = 'error' then 'none' when value < 20 then 'center' when value < 60 then 'middle' else 'edge' end measured, {_pick_sql(_SHAPE, 'event_id % 5')} shape, {_pick_sql(_CLOCK, 'event_id % 7')} clock,
 case when event_id % 3 > 0 then cast(hour(ts) % 12 + 1 as integer) end want, {_pick_sql(_SIZE, 'event_id // 5 % 5')} size, {_pick_sql(_TEXT, 'event_id // 3 % 5')} captions, event_id % 17 = 0 unsure, case when event_id % 19 = 0 then event_id % 10 else 0 end gone, event_id % 23 = 0 absent, event_id % 29 = 0 odd from events)"""
_FITS = " or ".join(f"(gold = '{k}' and coalesce(shape in ({', '.join(map(repr, v))}), false))" for k, v in SHAPES.items())
_AWAY = "least(((try_cast(clock as integer) - want) % 12 + 12) % 12, ((want - try_cast(clock as integer)) % 12 + 12) % 12)"
_RULES = [
    ("missing_fields", "gone > 0", "least(40, 5 * gone)"),
    ("type_mismatch", "predicted is distinct from gold", "50"),
    ("invalid_radial_zone", "zone not in ('center', 'middle', 'edge', 'full', 'none')", "20"),
    ("radial_mismatch", "zone in ('center', 'middle', 'edge', 'full', 'none') and not (zone = measured or (gold = 'purchase' and zone = 'full'))", "15"),
    ("shape_suspicious", f"not ({_FITS})", "15"),
    ("clock_mismatch", f"want is not null and clock not in ('all', 'none') and {_AWAY} > 1", "15"),
    ("invalid_clock", "want is not null and clock not in ('all', 'none') and try_cast(clock as integer) is null", "15"),
    ("invalid_size_r", "size is not null and not coalesce(try_cast(size as double) between 0 and 2.5, false)", "15"),
    ("empty_caption", "trim(captions) = ''", "35"),
    ("root_cause_hallucination", "lower(captions) like '%because of%' or lower(captions) like '%machine%'", "25"),
    ("teacher_uncertain", "unsure", "20"),
]
_LOST = " + ".join(f"case when {t} then {p} else 0 end" for _, t, p in _RULES)
_DETAILS = {
    "missing_fields": f"':' || array_to_string(list_slice([{', '.join(map(repr, C.REQUIRED_FIELDS))}], 1, gone), ',')",
    "type_mismatch": "':' || coalesce(predicted, 'None') || '!=' || gold",
    "radial_mismatch": "':' || zone || '!=' || measured",
    "shape_suspicious": "':' || coalesce(shape, 'None')",
    "clock_mismatch": "':' || clock || '!=' || want",
}
_ISSUES = ", ".join(f"case when {t} then '{n}' || {_DETAILS.get(n, repr(''))} end" for n, t, _ in _RULES)


@query(
    "validate_annotation",
    f"with {_ANN}, v as (select *, case when absent or odd then 0 else greatest(0, least(100, 100 - ({_LOST}))) end score, case when absent then 'missing_annotation' when odd then 'invalid_result' else concat_ws(';', {_ISSUES}) end issues from ann) select id, score, issues, not absent and not odd and score >= 60 and gone = 0 and predicted is not distinct from gold passed from v",
)
def validate_annotation(spark, sf):
    """All rules of a structured annotation: missing, incomplete, wrong class, zone, shape, clock, size, captions, causes, doubt."""
    i, gold = F.col("event_id"), F.col("event_type")
    predicted = F.when(i % 11 < 8, gold).otherwise(_pick(_KINDS, i % 5))
    measured = F.when(F.col("value") < 20, "center").when(F.col("value") < 60, "middle").otherwise("edge")
    gone = F.when(i % 19 == 0, i % 10).otherwise(0).cast("int")
    fields = F.slice(F.array(*map(F.lit, C.REQUIRED_FIELDS)), gone + 1, F.lit(10))
    rules = C.annotation_rules(
        fields, gold, predicted, _pick(_ZONE, i % 6), measured, _pick(_SHAPE, i % 5), _pick(_CLOCK, i % 7), F.when(i % 3 > 0, F.hour("ts") % 12 + 1).cast("int"), _pick(_SIZE, F.floor(i / 5) % 5), _pick(_TEXT, F.floor(i / 3) % 5), i % 17 == 0,
        SHAPES, CAUSES, full="purchase", nothing="error",
    )
    score, issues, passed = C.validate_result(i % 23 != 0, i % 29 != 0, rules)
    return table(spark, sf, "events").select(i.alias("id"), score.cast("long").alias("score"), F.array_join(issues, ";").alias("issues"), passed.alias("passed"))


#: the scorers of a report: task, query, the column that names its rows, metric columns
SCORERS = [
    ("classification", "accuracy", None, ["accuracy"]),
    ("classification", "macro_f1", None, ["macro_f1"]),
    ("structured", "field_accuracy", "label", ["clock_accuracy", "size_accuracy"]),
    ("structured", "circular_mae", "label", ["mae"]),
    ("caption", "caption_rates", "lang", ["must_hit", "avoid_hit", "empty"]),
    ("robustness", "robustness", "perturbation", ["accuracy", "flip_rate"]),
    ("retrieval", "map_at_k", "k", ["map"]),
    ("retrieval", "ndcg_at_k", "k", ["ndcg"]),
]


def _evaluate_sql() -> str:
    from grainmill.plans import classify, ranking  # noqa: F401

    parts = [f"select '{task}' task, '{name}' scorer, {f'cast({key} as varchar)' if key else 'null'} part, '{m}' metric, cast({m} as double) score from ({_SQL[name]})" for task, name, key, metrics in SCORERS for m in metrics]
    return " union all ".join(parts)


@query("evaluate", _evaluate_sql())
def evaluate(spark, sf):
    """One report over five tasks, a row a metric; each scorer runs once."""
    out = None
    for task, name, key, metrics in SCORERS:
        rows = _QUERIES[name](spark, sf)
        part = F.col(key).cast("string") if key else F.lit(None).cast("string")
        found = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics))).alias("m")
        rows = rows.select(F.lit(task).alias("task"), F.lit(name).alias("scorer"), part.alias("part"), found).select("task", "scorer", "part", "m.metric", "m.score")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "finished_runs",
    "select o_orderkey tag from orders join (select l_orderkey, count(*) n, max(l_linenumber) asked from lineitem group by 1) on l_orderkey = o_orderkey where o_orderstatus = 'F' and n = asked",
)
def finished_runs(spark, sf):
    """Orders as runs: completed ones that logged as many lines as their highest line number asks for."""
    logged = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tag")).agg(F.count(F.lit(1)).alias("steps_logged"), F.max("l_linenumber").alias("max_steps"))
    outcome = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("stopped")
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tag"), outcome.alias("outcome")).join(logged, "tag")
    return C.finished(runs).select("tag")


@query("version_tail", "select c_nationkey, 'checkpoint-' || max(c_custkey) || '.' || 'b' latest from customer group by 1")
def version_tail(spark, sf):
    """The last of every group in version order, 10 behind 9."""
    name = F.concat(F.lit("checkpoint-"), F.col("c_custkey").cast("string"), F.lit(".b"))
    return table(spark, sf, "customer").select("c_nationkey", name.alias("name")).groupBy("c_nationkey").agg(F.max_by("name", S.version_key(F.col("name"))).alias("latest"))


@query("stable_order", f"with {MANIFEST} select id, label from manifest order by label, id")
def stable_order(spark, sf):
    """A total order on output: the id breaks ties."""
    return manifest(spark, sf).select("id", "label").orderBy("label", "id")


@query(
    "markdown_cells",
    r"""with l as (select 'd' || doc_id k, unnest(string_split(text, chr(10))) line from documents where text is not null union all select 's' || s_suppkey, '| metric | GSPO (G=' || s_nationkey || ', lr5e-5) | ' || s_name || '(G=8) lr1e-5 |' from supplier),
c as (select k, unnest(list_transform(string_split(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^\|+|\|+$', '', 'g'), '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) cell from l where contains(line, '|'))
select k, cell, case when starts_with(cell, 'GSPO (') then 'GSPO|' || regexp_extract(cell, 'G=(\d+)', 1) || '|5e-5' end run from c""",
)
def markdown_cells(spark, sf):
    """Cells of every line with bars in the documents, and of table heads whose names say which run they are or do not."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), F.explode(F.split("text", "\n")).alias("line"))
    head = F.concat(F.lit("| metric | GSPO (G="), F.col("s_nationkey").cast("string"), F.lit(", lr5e-5) | "), "s_name", F.lit("(G=8) lr1e-5 |"))
    heads = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("k"), head.alias("line"))
    lines = docs.unionByName(heads).where(F.contains("line", F.lit("|")))
    return lines.select("k", F.explode(S.table_cells(F.col("line"))).alias("cell")).withColumn("run", S.run_key(F.col("cell")))


@query("retried_calls", "select event_id id, case when event_id % 5 < 3 then 'ok' else 'error' end status, least(3, event_id % 5 + 1) attempt, case when event_id % 5 = 0 then 0 when event_id % 5 = 1 then 1 else 3 end waited, case when event_id % 5 >= 3 then 'ValueError: not yet' end error from events")
def retried_calls(spark, sf):
    """Calls that fail up to four times, tried three times each; errors become rows."""

    def call(row: dict, attempt: int) -> str:
        if attempt <= row["id"] % 5:
            raise ValueError("not yet")
        return "done"

    calls = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return with_retries(calls, call, retries=3, pause=0.0).select("id", "status", "attempt", "waited", "error")


@query("stage_memo", "select c_mktsegment segment, count(*) n, cast(true as boolean) reused from customer group by 1")
def stage_memo(spark, sf):
    """A stage whose output exists is read, not made again."""
    path = f"{shared_dir(spark).rstrip('/')}/memo-{uuid.uuid4().hex}"
    make = lambda: table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    memo(spark, path, make)
    out, reused = memo(spark, path, make)
    return out.withColumn("reused", F.lit(reused))


@query("png_dimensions", "select p_partkey, case when p_partkey % 9 > 0 then p_size * 300 end width, case when p_partkey % 9 > 0 then p_partkey + 70000 end height from part")
def png_dimensions(spark, sf):
    """Width and height from the head of PNG bytes, null for other bytes."""
    number = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    mark = F.when(F.col("p_partkey") % 9 > 0, "89504E470D0A1A0A").otherwise("FFD8FFE000104A46")
    head = F.unhex(F.concat(mark, F.lit("0000000D49484452"), number(F.col("p_size") * 300), number(F.col("p_partkey") + 70000)))
    width, height = files.png_size(F.col("head"))
    return table(spark, sf, "part").select("p_partkey", "p_size", head.alias("head")).select("p_partkey", width.alias("width"), height.alias("height"))


@query("report_glob", "select 'run-' || c_nationkey tag, count(*) customers, round(max(c_acctbal), 2) best from customer group by c_nationkey")
def report_glob(spark, sf):
    """A JSON report a nation below a folder, found by suffix and read back with its tag."""
    root = f"{shared_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    made = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.round(F.max("c_acctbal"), 2).alias("best"))
    made.select(F.concat(F.lit("run-"), F.col("c_nationkey").cast("string")).alias("tag"), F.to_json(F.struct("customers", "best")).alias("value")).write.partitionBy("tag").text(root)
    found = files.read_reports(spark, f"{root}/*/part-*", ".txt")
    report = F.from_json(F.trim("json"), "customers long, best double")
    return found.select(F.regexp_extract("path", r"tag=([^/]+)/", 1).alias("tag"), report.alias("r")).select("tag", "r.customers", "r.best")
