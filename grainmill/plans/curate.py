"""Curation of annotations: boundary and audit picks, validation, arbitration, review merge, rewards and request building."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from grainmill.functions.hashing import stable_bucket, stable_sample
from grainmill.operators import curate as C
from grainmill.plans.registry import query
from grainmill.plans.tables import CLOCKS, MANIFEST, PREDS, bucket_sql, clocks, manifest, predictions, predictions_sql
from grainmill.session import table

BOUNDARY_SQL = "(label = 'error' or size < 8 or coalesce(abs(size / 100 - 0.35) <= 0.05, false) or coalesce(abs(size / 100 - 0.72) <= 0.05, false) or (size / 500 >= 0.18 and size / 500 <= 0.32))"


def _boundary():
    r, length = F.col("size") / 100, F.col("size") / 500
    near = lambda x: F.coalesce(F.abs(r - x) <= 0.05, F.lit(False))
    return (F.col("label") == "error") | (F.col("size") < 8) | near(0.35) | near(0.72) | length.between(0.18, 0.32)


@query("boundary_flag", f"with {CLOCKS} select id, {BOUNDARY_SQL} boundary from clocks")
def boundary_flag(spark, sf):
    return clocks(spark, sf).select("id", _boundary().alias("boundary"))


_VALID = """case when answer = 'n/a' then 45 else 0 end + case when size < 1 then 20 else 0 end + case when abs(size_answer - size) > 1.5 then 15 else 0 end + case when label = 'error' and size > 50 then 30 else 0 end + case when try_cast(answer as integer) <> clock then 10 else 0 end"""
VALID_SQL = f"with {CLOCKS}, v as (select *, greatest(0, least(100, 100 - ({_VALID}))) score, label = 'error' and size > 50 hard from clocks)"


def _validated(spark, sf):
    rules = [
        ("unparsed", F.col("answer") == "n/a", 45, False),
        ("tiny", F.col("size") < 1, 20, False),
        ("size_off", F.abs(F.col("size_answer") - F.col("size")) > 1.5, 15, False),
        ("wrong_type", (F.col("label") == "error") & (F.col("size") > 50), 30, True),
        ("clock_off", F.col("answer").try_cast("int") != F.col("clock"), 10, False),
    ]
    score, issues, passed = C.validate(rules)
    return clocks(spark, sf).select("*", score.alias("score"), issues.alias("issues"), passed.alias("passed"))


@query("validate_score", VALID_SQL + " select id, score, score >= 60 and not hard passed from v")
def validate_score(spark, sf):
    return _validated(spark, sf).select("id", "score", "passed")


@query("validate_issues", f"with {CLOCKS} select id, concat_ws(',', case when answer = 'n/a' then 'unparsed' end, case when size < 1 then 'tiny' end, case when abs(size_answer - size) > 1.5 then 'size_off' end, case when label = 'error' and size > 50 then 'wrong_type' end, case when try_cast(answer as integer) <> clock then 'clock_off' end) issues from clocks")
def validate_issues(spark, sf):
    return _validated(spark, sf).select("id", F.array_join("issues", ",").alias("issues"))


@query("curate_plan", VALID_SQL + f" select id from v where not (score >= 60 and not hard) or {BOUNDARY_SQL} or cast(cast('0x' || substr(sha256('plan:' || id), 1, 16) as ubigint) as double) / 18446744073709551616.0 < 0.05")
def curate_plan(spark, sf):
    """Rows for a second opinion: failed, on a boundary, or in the stable audit sample."""
    return _validated(spark, sf).where(~F.col("passed") | _boundary() | stable_sample(F.col("id"), "plan", 0.05)).select("id")


@query("curate_finalize", VALID_SQL + f" select case when score >= 60 and not hard then 'accepted' else 'quarantine' end route, case when {bucket_sql('user_id', '3407', 100)} < 80 then 'train' when {bucket_sql('user_id', '3407', 100)} < 90 then 'val' else 'test' end split, count(*) n from v group by 1, 2")
def curate_finalize(spark, sf):
    from grainmill.functions.hashing import split_of

    v = _validated(spark, sf)
    return v.groupBy(F.when(F.col("passed"), "accepted").otherwise("quarantine").alias("route"), split_of(stable_bucket(F.col("user_id"), "3407", 100)).alias("split")).agg(F.count(F.lit(1)).alias("n"))


_TWO = f"with {predictions_sql('a')}, {predictions_sql('b', 45, 'second')}, j as (select id, a.gold, a.pred pa, b.pred pb, cast(id % 12 + 1 as integer) ca, cast((id + id % 3) % 12 + 1 as integer) cb from a join b using (id))"


def _two(spark, sf):
    a = predictions(spark, sf).select("id", "gold", F.col("pred").alias("pa"))
    b = predictions(spark, sf, 45, "second").select("id", F.col("pred").alias("pb"))
    j = a.join(b, "id")
    return j.withColumn("ca", (F.col("id") % 12 + 1).cast("int")).withColumn("cb", ((F.col("id") + F.col("id") % 3) % 12 + 1).cast("int"))


@query("disagreement", _TWO + " select id, concat_ws(',', case when pa <> pb then 'class' end, case when least(((ca - cb) % 12 + 12) % 12, ((cb - ca) % 12 + 12) % 12) > 1 then 'clock' end) fields from j")
def disagreement(spark, sf):
    """A clock differs only by more than one step."""
    near = F.least(F.pmod(F.col("ca") - F.col("cb"), F.lit(12)), F.pmod(F.col("cb") - F.col("ca"), F.lit(12))) <= 1
    cb = F.when(near, F.col("ca")).otherwise(F.col("cb"))
    return _two(spark, sf).select("id", F.array_join(C.disagreement({"class": (F.col("pa"), F.col("pb")), "clock": (F.col("ca"), cb)}), ",").alias("fields"))


@query("arbitrate", _TWO + " select id, case when not (pa <> pb or ca <> cb) then null when (pa = pb or pa = gold) and (ca = cb or ca = id % 12 + 1) then 'first' when (pa = pb or pb = gold) and (ca = cb or cb = id % 12 + 1) then 'second' end winner from j")
def arbitrate(spark, sf):
    j = _two(spark, sf)
    return j.select("id", C.arbitrate({"class": (F.col("pa"), F.col("pb"), F.col("gold")), "clock": (F.col("ca"), F.col("cb"), (F.col("id") % 12 + 1).cast("int"))}).alias("winner"))


@query("override_gold", _TWO + " select id, case when pa = gold then pb else gold end target, case when pa = gold then cb else ca end clock from j")
def override_gold(spark, sf):
    good = F.col("pa") == F.col("gold")
    return _two(spark, sf).select("id", F.when(good, F.col("pb")).otherwise(F.col("gold")).alias("target"), F.when(good, F.col("cb")).otherwise(F.col("ca")).alias("clock"))


@query("call_status", "select event_id, case when event_type = 'error' then 'failed' when value > 200 then 'unfinished' when event_id % 11 = 0 then 'wrong_model' when value < 1 then 'invalid' else 'success' end status, coalesce(case when event_id % 2 = 0 then value end, cast(json_extract_string(props, '$.k') as double)) cost from events")
def call_status(spark, sf):
    """The first rule that holds, and the first cost that is present."""
    v = F.col("value")
    status = F.when(F.col("event_type") == "error", "failed").when(v > 200, "unfinished").when(F.col("event_id") % 11 == 0, "wrong_model").when(v < 1, "invalid").otherwise("success")
    cost = F.coalesce(F.when(F.col("event_id") % 2 == 0, v), F.get_json_object("props", "$.k").cast("double"))
    return table(spark, sf, "events").select("event_id", status.alias("status"), cost.alias("cost"))


@query("floor_verdict", "with a as (select event_type, user_id % 6 run, avg(value) v from events group by 1, 2), f as (select event_type, median(value) f from events group by 1) select event_type, case when bool_and(v > f) then 'all' when bool_or(v > f) then 'mixed' else 'none' end verdict, count(*) filter (f between v - 5 and v + 5) n_covering from a join f using (event_type) group by 1")
def floor_verdict(spark, sf):
    e = table(spark, sf, "events")
    a = e.groupBy("event_type", (F.col("user_id") % 6).alias("run")).agg(F.avg("value").alias("v"))
    f = e.groupBy("event_type").agg(F.median("value").alias("f"))
    above = F.col("v") > F.col("f")
    return a.join(f, "event_type").groupBy("event_type").agg(F.when(F.bool_and(above), "all").when(F.bool_or(above), "mixed").otherwise("none").alias("verdict"), F.count_if(F.col("f").between(F.col("v") - 5, F.col("v") + 5)).alias("n_covering"))


@query("budget_stop", "with r as (select *, coalesce(sum(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) spent, max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) failed from events) select user_id, event_id, value from r where spent < 300 and coalesce(failed, 0) = 0")
def budget_stop(spark, sf):
    """Calls of every user before the budget is reached (the crossing call stays) or a call has failed."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf, "events").withColumn("spent", F.coalesce(F.sum("value").over(w), F.lit(0.0))).withColumn("failed", F.coalesce(F.max((F.col("event_type") == "error").cast("int")).over(w), F.lit(0)))
    return e.where("spent < 300 AND failed = 0").select("user_id", "event_id", "value")


@query("review_merge", "with a as (select doc_id, quality a from labels where doc_id % 3 <> 0), b as (select doc_id, toxic b from labels where doc_id % 5 <> 0) select d.doc_id, case when a is null and b is null then 'unreviewed' when a is null or b is null then 'single' when a = b then 'agreed' else 'disputed' end outcome from documents d left join a using (doc_id) left join b using (doc_id)")
def review_merge(spark, sf):
    lab = table(spark, sf, "labels")
    a = lab.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("a"))
    b = lab.where("doc_id % 5 <> 0").select("doc_id", F.col("toxic").alias("b"))
    j = table(spark, sf, "documents").select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left")
    outcome = F.when(F.col("a").isNull() & F.col("b").isNull(), "unreviewed").when(F.col("a").isNull() | F.col("b").isNull(), "single").when(F.col("a") == F.col("b"), "agreed").otherwise("disputed")
    return j.select("doc_id", outcome.alias("outcome"))


_REW = f"with {CLOCKS}, w as (select *, case when id % 4 = 0 then label || ' ' else label end ans from clocks)"


def _rewards(spark, sf):
    c = clocks(spark, sf)
    ans = F.when(F.col("id") % 4 == 0, F.concat("label", F.lit(" "))).when(F.col("id") % 4 == 1, F.lit("other")).otherwise(F.col("label"))
    keys = F.slice(F.array(*(F.lit(f"f{i}") for i in range(7))), F.lit(1), (F.col("id") % 8).cast("int"))
    gold_zone = F.when(F.col("id") % 5 != 0, F.when(F.col("size") < 50, "edge").otherwise("middle"))
    return c.select(
        "id",
        C.reward_class(ans, F.col("label")).alias("r_class"),
        C.reward_format(keys, [f"f{i}" for i in range(7)]).alias("r_format"),
        C.reward_field(F.when(F.col("size") < 40, "edge").otherwise("middle"), gold_zone).alias("r_radial"),
        C.reward_clock(F.col("answer").try_cast("int"), F.when(F.col("id") % 6 != 0, F.col("clock"))).alias("r_clock"),
    )


_R = {
    "class": "case when id % 4 = 1 then 0.0 else 1.0 end",
    "format": "(id % 8) / 7.0",
    "radial": "case when id % 5 = 0 then 1.0 when (size < 40) = (size < 50) then 1.0 else 0.0 end",
    "clock": "case when id % 6 = 0 then 1.0 when try_cast(answer as integer) is null then 0.0 when least(((try_cast(answer as integer) - clock) % 12 + 12) % 12, ((clock - try_cast(answer as integer)) % 12 + 12) % 12) <= 1 then 1.0 else 0.0 end",
}


@query("reward_class", f"with {CLOCKS} select id, cast({_R['class']} as double) r_class from clocks")
def reward_class(spark, sf):
    return _rewards(spark, sf).select("id", "r_class")


@query("reward_format", f"with {CLOCKS} select id, round(cast({_R['format']} as double), 9) r_format from clocks")
def reward_format(spark, sf):
    return _rewards(spark, sf).select("id", F.round("r_format", 9).alias("r_format"))


@query("reward_radial", f"with {CLOCKS} select id, cast({_R['radial']} as double) r_radial from clocks")
def reward_radial(spark, sf):
    return _rewards(spark, sf).select("id", "r_radial")


@query("reward_clock", f"with {CLOCKS} select id, cast({_R['clock']} as double) r_clock from clocks")
def reward_clock(spark, sf):
    return _rewards(spark, sf).select("id", "r_clock")


@query("reward_total", f"with {CLOCKS} select id, round(cast({_R['class']} + 0.2 * ({_R['format']}) + 0.4 * ({_R['radial']}) + 0.4 * ({_R['clock']}) as double), 6) total from clocks")
def reward_total(spark, sf):
    return _rewards(spark, sf).select("id", F.round(F.expr("r_class + 0.2D * r_format + 0.4D * r_radial + 0.4D * r_clock"), 6).alias("total"))


@query("explode_tasks", f"with {MANIFEST} select id || '-' || t row_id, t task, case when t = 'classify' then label when t = 'zone' then status else label || ' ' || status end target from manifest, (select unnest(['classify', 'zone', 'caption']) t)")
def explode_tasks(spark, sf):
    tasks = F.array(*(F.struct(F.lit(t).alias("t"), x.alias("target")) for t, x in (("classify", F.col("label")), ("zone", F.col("status")), ("caption", F.concat_ws(" ", "label", "status")))))
    return manifest(spark, sf).select("id", F.explode(tasks).alias("x")).select(F.concat_ws("-", F.col("id").cast("string"), "x.t").alias("row_id"), F.col("x.t").alias("task"), "x.target")


@query("requests_cross", f"with {MANIFEST} select id, t task from manifest, (select unnest(['classify', 'structured', 'caption']) t) where split = 'test'")
def requests_cross(spark, sf):
    return manifest(spark, sf).where("split = 'test'").select("id", F.explode(F.array(*map(F.lit, ("classify", "structured", "caption")))).alias("task"))


@query("gold_json", f"with {MANIFEST} select id, '{{\"label\":\"' || label || '\",\"status\":\"' || status || '\",\"lot\":' || lot || '}}' gold from manifest where split = 'train'")
def gold_json(spark, sf):
    return manifest(spark, sf).where("split = 'train'").select("id", F.to_json(F.struct("label", "status", "lot")).alias("gold"))
