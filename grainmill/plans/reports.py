"""Reports, round trips through files, and text-log summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grainmill.plans.registry import query
from grainmill.plans.tables import PREDS, predictions
from grainmill.session import shared_dir, table
from grainmill.sources import files


@query("jsonl_roundtrip", "select event_id, event_type, value, props from events")
def jsonl_roundtrip(spark, sf):
    path = f"{shared_dir(spark).rstrip('/')}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf, "events").select("event_id", "event_type", "value", "props"), path)
    return files.read_jsonl(spark, path, "event_id long, event_type string, value double, props string")


@query("review_sheet", "select doc_id, quality, case when toxic = 1 then null else source end note from labels join documents using (doc_id)")
def review_sheet(spark, sf):
    path = f"{shared_dir(spark).rstrip('/')}/sheet-{uuid.uuid4().hex}"
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    files.write_sheet(lab.select("doc_id", "quality", F.when(F.col("toxic") != 1, F.col("source")).alias("note")), path)
    return files.read_sheet(spark, path, "doc_id long, quality int, note string")


@query("flatten_features", "select vec_id, label feat_label, embedding[1] feat_first, len(embedding) feat_dim from embeddings")
def flatten_features(spark, sf):
    """Nested features become flat, prefixed columns."""
    nested = table(spark, sf, "embeddings").select("vec_id", F.struct("label", F.col("embedding")[0].alias("first"), F.size("embedding").alias("dim")).alias("features"))
    return nested.select("vec_id", *(F.col(f"features.{c}").alias(f"feat_{c}") for c in ("label", "first", "dim")))


@query("report_json", "select event_type, '{\"n\":' || count(*) || ',\"hi\":' || round(max(value), 2) || '}' report from events group by 1")
def report_json(spark, sf):
    a = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 2).alias("hi"))
    return a.select("event_type", F.to_json(F.struct("n", "hi")).alias("report"))


@query(
    "report_pivot",
    f"with {PREDS}, a as (select lot % 4 run, gold, avg(case when gold = pred then 1.0 else 0.0 end) acc from preds where not (lot % 4 = 2 and gold = '5-LOW') group by 1, 2) select gold, "
    + ", ".join(f"coalesce(printf('%.4f', max(acc) filter (run = {i})), 'not run') run{i}" for i in range(4))
    + " from a group by 1",
)
def report_pivot(spark, sf):
    """Metric rows by run columns; what was not measured says so and is never 0."""
    p = predictions(spark, sf).withColumn("run", F.col("lot") % 4).where("NOT (run = 2 AND gold = '5-LOW')")
    a = p.groupBy("gold").pivot("run", [0, 1, 2, 3]).agg(F.avg((F.col("gold") == F.col("pred")).cast("double")))
    return a.select("gold", *(F.when(F.col(str(i)).isNull(), "not run").otherwise(F.format_string("%.4f", F.col(str(i)))).alias(f"run{i}") for i in range(4)))


@query("checksum_verify", "select item_id, case when item_id % 5 = 0 then 'changed' else 'ok' end state from benchmark")
def checksum_verify(spark, sf):
    """Checksums of the items against a record in which some are stale."""
    b = table(spark, sf, "benchmark")
    found = b.select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    recorded = b.select("item_id", F.sha2(F.concat("text", F.when(F.col("item_id") % 5 == 0, "x").otherwise("")).cast("binary"), 256).alias("sha256"))
    return files.verify(found, recorded, "item_id")


@query("idle_table", "with s as (select user_id, cast(floor(epoch(ts) / 86400) as integer) d, count(*) n from events group by 1, 2) select d, count(distinct n) = 1 agree, min(n) lo, max(n) hi from s group by 1")
def idle_table(spark, sf):
    """Whether all logs of a day agree."""
    s = table(spark, sf, "events").groupBy("user_id", F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("d").agg((F.min("n") == F.max("n")).alias("agree"), F.min("n").alias("lo"), F.max("n").alias("hi"))


@query("effective_batch", "select s_suppkey, (s_suppkey % 8 + 1) * 2 * (s_nationkey % 4 + 1) batch from supplier")
def effective_batch(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 8 + 1) * 2 * (F.col("s_nationkey") % 4 + 1)).alias("batch"))


@query("collapsed_class", f"with {PREDS}, k as (select lot % 300 run, gold, count(*) filter (gold = pred) tp, count(*) n from preds group by 1, 2) select gold, bool_or(tp = 0) ever_collapsed, bool_and(tp < 0.01 * n) always_collapsed from k group by 1")
def collapsed_class(spark, sf):
    k = predictions(spark, sf).groupBy((F.col("lot") % 300).alias("run"), "gold").agg(F.count_if(F.col("gold") == F.col("pred")).alias("tp"), F.count(F.lit(1)).alias("n"))
    return k.groupBy("gold").agg(F.bool_or(F.col("tp") == 0).alias("ever_collapsed"), F.bool_and(F.col("tp") < 0.01 * F.col("n")).alias("always_collapsed"))


@query("extremes", f"with {PREDS}, a as (select lot % 12 run, gold, round(avg(case when gold = pred then 1.0 else 0.0 end), 9) acc from preds group by 1, 2) select gold, arg_max(run, acc * 1000 - run * 1e-9) best_run, max(acc) best, arg_min(run, acc * 1000 + run * 1e-9) worst_run, min(acc) worst from a group by 1")
def extremes(spark, sf):
    """The best and the worst run of every class, the smaller run on ties: what a written claim is held against."""
    a = predictions(spark, sf).groupBy((F.col("lot") % 12).alias("run"), "gold").agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 9).alias("acc"))
    m = a.groupBy("gold").agg(F.min(F.struct((-F.col("acc")).alias("a"), "run")).alias("b"), F.min(F.struct("acc", "run")).alias("w"))
    return m.select("gold", F.col("b.run").alias("best_run"), (-F.col("b.a")).alias("best"), F.col("w.run").alias("worst_run"), F.col("w.acc").alias("worst"))
