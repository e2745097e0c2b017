"""How the roles of the evaluation library are bound to the given tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainmill.functions.hashing import split_of, stable_bucket
from grainmill.session import table

CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def bucket_sql(key: str, seed: str, n: int) -> str:
    return f"cast(cast('0x' || substr(sha256('{seed}:' || cast({key} as varchar)), 1, 16) as ubigint) % {n} as integer)"


def class_at(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASSES)), i + 1)


def class_list_sql() -> str:
    return "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


def guess(key: Column, gold: Column, seed: str, wrong: int = 30) -> Column:
    """The gold class, or for a stable share of ``wrong`` percent any class; two percent are no class at all."""
    return F.when(stable_bucket(key, seed + "-bad", 100) < 2, "INVALID").when(stable_bucket(key, seed, 100) < wrong, class_at(stable_bucket(key, seed + "-class", 5))).otherwise(gold)


def guess_sql(key: str, gold: str, seed: str, wrong: int = 30) -> str:
    return f"case when {bucket_sql(key, seed + '-bad', 100)} < 2 then 'INVALID' when {bucket_sql(key, seed, 100)} < {wrong} then {class_list_sql()}[{bucket_sql(key, seed + '-class', 5)} + 1] else {gold} end"


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Samples: id, class, lot and the split of the lot."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("lot"), F.col("o_totalprice").alias("size"), F.col("o_orderstatus").alias("status"), split_of(stable_bucket(F.col("o_custkey"), "3407", 100)).alias("split"))


MANIFEST = f"""manifest as (select o_orderkey id, o_orderpriority label, o_custkey lot, o_totalprice size, o_orderstatus status,
 case when b < 80 then 'train' when b < 90 then 'val' else 'test' end split from (select *, {bucket_sql('o_custkey', '3407', 100)} b from orders))"""


def predictions(spark: SparkSession, sf: str, wrong: int = 30, seed: str = "pred") -> DataFrame:
    """id, gold and pred of every sample."""
    m = manifest(spark, sf)
    return m.select("id", "lot", F.col("label").alias("gold"), guess(F.col("id"), F.col("label"), seed, wrong).alias("pred"))


def predictions_sql(name: str = "preds", wrong: int = 30, seed: str = "pred") -> str:
    return f"{name} as (select o_orderkey id, o_custkey lot, o_orderpriority gold, {guess_sql('o_orderkey', 'o_orderpriority', seed, wrong)} pred from orders)"


PREDS = predictions_sql()


def geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Points of groups: x and y in a disk-like square, radius and angle clockwise from 12 o'clock."""
    li = table(spark, sf, "lineitem")
    x, y = F.col("l_discount") * 20 - 1, F.col("l_tax") * 25 - 1
    p = li.select(F.col("l_suppkey").alias("g"), x.alias("x"), y.alias("y"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return p.withColumn("r", r / F.lit(1.5)).withColumn("theta", F.pmod(F.atan2("x", "y"), F.lit(6.283185307179586)))


GEOMETRY = """pts as (select l_suppkey g, l_discount * 20 - 1 x, l_tax * 25 - 1 y from lineitem),
geo as (select g, x, y, sqrt(x * x + y * y) / 1.5 r, case when atan2(x, y) < 0 then atan2(x, y) + 6.283185307179586 else atan2(x, y) end theta from pts)"""


def clocks(spark: SparkSession, sf: str) -> DataFrame:
    """A true and a predicted clock position and size of every event; some predictions don't parse."""
    e = table(spark, sf, "events")
    hour = F.hour("ts") % 12 + 1
    off = stable_bucket(F.col("event_id"), "clock", 5)
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("label"), "user_id", F.col("value").alias("size"), hour.cast("int").alias("clock"),
        F.when(off == 4, F.lit("n/a")).otherwise((F.pmod(hour - 1 + off - 1, F.lit(12)) + 1).cast("string")).alias("answer"),
        (F.col("value") + off - 2).alias("size_answer"),
    )


CLOCKS = f"""clocks as (select event_id id, event_type label, user_id, value size, cast(hour(ts) % 12 + 1 as integer) clock,
 case when off = 4 then 'n/a' else cast((hour(ts) % 12 + off + 11) % 12 + 1 as varchar) end answer, value + off - 2 size_answer
 from (select *, {bucket_sql('event_id', 'clock', 5)} off from events))"""


def dist_sql(a: str, b: str) -> str:
    return f"least((({a} - {b}) % 12 + 12) % 12, (({b} - {a}) % 12 + 12) % 12)"
