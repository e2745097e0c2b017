"""Filters, joins and set operations bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions.hashing import stable_bucket
from grainmill.operators import relate as J
from grainmill.plans.registry import query
from grainmill.plans.tables import MANIFEST, PREDS, bucket_sql, manifest, predictions
from grainmill.session import table


@query("filter_split", f"with {MANIFEST} select id, split from manifest where split in ('train', 'val')")
def filter_split(spark, sf):
    return manifest(spark, sf).where(F.col("split").isin("train", "val")).select("id", "split")


@query("select_allowlist", f"with {MANIFEST} select id, split from manifest where split = 'test' and id in (select l_orderkey from lineitem where l_returnflag = 'R')")
def select_allowlist(spark, sf):
    allowed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return manifest(spark, sf).where("split = 'test'").join(allowed, "id", "left_semi").select("id", "split")


_ANN = "ann as (select event_id line, user_id id, event_type, value from events where event_type <> 'error')"


def _annotations(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("line"), F.col("user_id").alias("id"), "event_type", "value")


@query("left_join_last", f"with {_ANN} select c_custkey id, event_type, value from customer left join (select id, arg_max(event_type, line) event_type, arg_max(value, line) value from ann group by 1) on id = c_custkey")
def left_join_last(spark, sf):
    """The last good annotation of every sample; failed ones never count."""
    last = J.last_per_key(_annotations(spark, sf), "id", "line", F.col("event_type") != "error")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(last, "id", "left").select("id", "event_type", "value")


@query("two_way_left", "select c_custkey id, p.value first_value, s.value second_value from customer left join (select user_id id, arg_max(value, event_id) value from events where event_type = 'view' group by 1) p on p.id = c_custkey left join (select user_id id, arg_max(value, event_id) value from events where event_type = 'click' group by 1) s on s.id = c_custkey")
def two_way_left(spark, sf):
    a = _annotations(spark, sf)
    side = lambda kind, name: J.last_per_key(a, "id", "line", F.col("event_type") == kind).select("id", F.col("value").alias(name))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(side("view", "first_value"), "id", "left").join(side("click", "second_value"), "id", "left")


@query("gold_join", "select o_orderkey id, c_mktsegment gold, c_custkey is null missing from orders left join customer on o_custkey = c_custkey")
def gold_join(spark, sf):
    """Gold of every sample, with a flag where the lookup fails; a caller that must not miss asserts that none is set."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("gold"), F.col("c_custkey").isNull().alias("missing"))


@query("align_fallback", "with g as (select c_custkey id, row_number() over (order by c_custkey) - 1 pos from customer), a as (select s_suppkey * 20 id, s_name answer, row_number() over (order by s_suppkey) - 1 pos from supplier) select g.id, coalesce(k.answer, p.answer) answer from g left join a k on k.id = g.id left join a p on p.pos = g.pos")
def align_fallback(spark, sf):
    gold = J.with_position(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), ["id"])
    answers = J.with_position(table(spark, sf, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("answer")), ["id"])
    return J.align(gold, answers, ["id"], "pos").select("id", "answer")


@query("positional_join", "with a as (select *, row_number() over (order by c_custkey) - 1 pos from customer), b as (select *, row_number() over (order by p_partkey) - 1 pos from part) select pos, c_name, p_name, c_custkey = p_partkey same_key from a join b using (pos)")
def positional_join(spark, sf):
    a = J.with_position(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    b = J.with_position(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"])
    return a.join(b, "pos").select("pos", "c_name", "p_name", (F.col("c_custkey") == F.col("p_partkey")).alias("same_key"))


@query("qrels_cross", "select q.vec_id query_id, c.vec_id gallery_id, case when q.label <> c.label then 0 when q.vec_id % 3 = c.vec_id % 3 then 2 else 1 end relevance from embeddings q join embeddings c on q.vec_id % 25 = 0 and q.vec_id <> c.vec_id and q.vec_id % 7 <> c.vec_id % 7 and q.label = c.label")
def qrels_cross(spark, sf):
    """Judgements of a stated query set, not with itself nor its own lot; grade 0 is what is absent, so class is an equi-key."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    q, c = e.where("vec_id % 25 = 0").alias("q"), e.alias("c")
    pairs = q.join(c, F.expr("q.label = c.label AND q.vec_id <> c.vec_id AND q.vec_id % 7 <> c.vec_id % 7"))
    return pairs.select(F.col("q.vec_id").alias("query_id"), F.col("c.vec_id").alias("gallery_id"), F.expr("CASE WHEN q.vec_id % 3 = c.vec_id % 3 THEN 2 ELSE 1 END").alias("relevance"))


@query("qrels_graded", "select q.vec_id query_id, c.vec_id gallery_id, case when q.label <> c.label then 0 when q.vec_id % 3 = c.vec_id % 3 then 2 else 1 end relevance from embeddings q join embeddings c on q.vec_id % 100 = 0 and q.vec_id % 7 <> c.vec_id % 7")
def qrels_graded(spark, sf):
    """Judgements of every hundredth vector against all rows of other lots, grade 0 written out."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    q, c = e.where("vec_id % 100 = 0").alias("q"), e.alias("c")
    pairs = q.join(c, F.expr("q.vec_id % 7 <> c.vec_id % 7"))
    grade = F.expr("CASE WHEN q.label <> c.label THEN 0 WHEN q.vec_id % 3 = c.vec_id % 3 THEN 2 ELSE 1 END")
    return pairs.select(F.col("q.vec_id").alias("query_id"), F.col("c.vec_id").alias("gallery_id"), grade.alias("relevance"))


@query("leak_unresolved", "select l.doc_id, d.source from labels l left join documents d on l.doc_id = d.doc_id + 3")
def leak_unresolved(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") + 3).alias("doc_id"), "source")
    return table(spark, sf, "labels").select("doc_id").join(d, "doc_id", "left")


@query("resume_antijoin", "select o_orderkey id from orders where o_orderkey not in (select event_id from events where event_type <> 'error')")
def resume_antijoin(spark, sf):
    done = table(spark, sf, "events").where("event_type <> 'error'").select(F.col("event_id").alias("id"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(done, "id", "left_anti")


@query("resume_match", "select a.event_id id, min(b.event_id) done_by from events a join events b on a.user_id = b.user_id and a.event_type = b.event_type and a.props = b.props and b.value < 100 and b.event_id <> a.event_id group by 1")
def resume_match(spark, sf):
    """A finished call with the same identity, type and request: the smallest other id, from two grouped minima."""
    e = table(spark, sf, "events")
    key = ["user_id", "event_type", "props"]
    done = e.where("value < 100").select(*key, "event_id")
    least = done.groupBy(*key).agg(F.min("event_id").alias("low"))
    next_ = done.join(least, key).where("event_id > low").groupBy(*key).agg(F.min("event_id").alias("high"))
    hit = e.join(least, key).join(next_, key, "left").select(F.col("event_id").alias("id"), F.when(F.col("low") != F.col("event_id"), F.col("low")).otherwise(F.col("high")).alias("done_by"))
    return hit.where("done_by IS NOT NULL")


@query("matched_pairs", "with r as (select user_id % 30 cell, event_type, max(value) v from events group by 1, 2) select a.cell, a.v low, b.v high from r a join r b on a.cell = b.cell and a.event_type = 'view' and b.event_type = 'click'")
def matched_pairs(spark, sf):
    r = table(spark, sf, "events").groupBy((F.col("user_id") % 30).alias("cell")).pivot("event_type", ["view", "click"]).agg(F.max("value"))
    return r.dropna().select("cell", F.col("view").alias("low"), F.col("click").alias("high"))


@query("provenance_compare", "with a as (select c_custkey k, c_acctbal x from customer), b as (select o_custkey k, max(case when o_custkey % 5 = 0 then o_totalprice else c_acctbal end) x from orders join customer on o_custkey = c_custkey group by 1) select coalesce(a.k, b.k) k, case when a.k is null or b.k is null then 'missing' when round(a.x, 4) = round(b.x, 4) then 'ok' else 'mismatch' end outcome from a full join b on a.k = b.k")
def provenance_compare(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    b = o.join(a, "k").groupBy("k").agg(F.max(F.when(F.col("k") % 5 == 0, F.col("o_totalprice")).otherwise(F.col("x"))).alias("y"))
    j = a.join(b, "k", "full_outer")
    return j.select("k", F.when(F.col("x").isNull() | F.col("y").isNull(), "missing").when(F.round("x", 4) == F.round("y", 4), "ok").otherwise("mismatch").alias("outcome"))


@query("range_derive", "select e.event_id, count(*) n from (select event_id, value from events where event_type = 'purchase') e join (select event_id, value from events where event_type = 'signup') s on abs(e.value - s.value) <= 0.015 group by 1")
def range_derive(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("event_type = 'purchase'").select("event_id", F.col("value").alias("x"))
    b = e.where("event_type = 'signup'").select(F.col("value").alias("y"))
    return J.near_join(a, b, "x", "y", 0.015).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("oov_labels", f"with {PREDS} select pred, count(*) n from preds where pred not in (select distinct gold from preds) group by 1")
def oov_labels(spark, sf):
    p = predictions(spark, sf)
    return p.join(p.select(F.col("gold").alias("pred")).distinct(), "pred", "left_anti").groupBy("pred").agg(F.count(F.lit(1)).alias("n"))


@query("cell_compare", "with a as (select event_type k, unnest(['mean', 'hi']) col, unnest([round(avg(value), 4), max(value)]) x from events group by 1), b as (select event_type k, unnest(['mean', 'lo']) col, unnest([round(avg(case when event_type = 'view' then value + 1 else value end), 4), min(value)]) y from events group by 1) select coalesce(a.k, b.k) k, coalesce(a.col, b.col) col, case when a.col is null then 'extra' when b.col is null then 'missing' when x <> y then 'differs' else 'same' end state from a full join b on a.k = b.k and a.col = b.col")
def cell_compare(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("k"))
    moved = F.when(F.col("event_type") == "view", F.col("value") + 1).otherwise(F.col("value"))
    a = e.agg(F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("hi")).unpivot("k", ["mean", "hi"], "col", "x")
    b = e.agg(F.round(F.avg(moved), 4).alias("mean"), F.min("value").alias("lo")).unpivot("k", ["mean", "lo"], "col", "y")
    j = a.join(b, ["k", "col"], "full_outer")
    return j.select("k", "col", F.when(F.col("x").isNull(), "extra").when(F.col("y").isNull(), "missing").when(F.col("x") != F.col("y"), "differs").otherwise("same").alias("state"))


@query("span_coverage", "with s as (select user_id g, event_id a, event_id + 40 b from events where event_type = 'click') select p.event_id, count(s.a) covers from events p left join s on s.g = p.user_id and p.event_id between s.a and s.b group by 1")
def span_coverage(spark, sf):
    e = table(spark, sf, "events")
    spans = e.where("event_type = 'click'").select(F.col("user_id").alias("g"), F.col("event_id").alias("a"), (F.col("event_id") + 40).alias("b"))
    return J.covered(e.select(F.col("user_id").alias("g"), "event_id"), spans, "g", "event_id", "a", "b").select("event_id", "covers")


@query("lot_intersection", f"with {MANIFEST} select lot from manifest where split = 'train' intersect select lot from manifest where split = 'test'")
def lot_intersection(spark, sf):
    m = manifest(spark, sf)
    return m.where("split = 'train'").select("lot").intersect(m.where("split = 'test'").select("lot"))


@query("straddling_lots", "select o_custkey lot, count(distinct o_orderstatus) n from orders group by 1 having count(distinct o_orderstatus) > 1")
def straddling_lots(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("lot")).agg(F.count_distinct("o_orderstatus").alias("n")).where("n > 1")


@query("leak_overlap", "select d.doc_id, b.item_id from documents d join benchmark b on trim(d.text) = trim(b.text)")
def leak_overlap(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.trim("text").alias("t"))
    return table(spark, sf, "documents").select("doc_id", F.trim("text").alias("t")).join(b, "t").select("doc_id", "item_id")


_GROUPS = f"grp as (select id, case when {bucket_sql('id', 'grp', 10)} < 6 then 'train' when {bucket_sql('id', 'grp', 10)} < 8 then 'val' else 'test' end g from (select o_orderkey id from orders) union all select o_orderkey, 'rl' from orders where o_orderkey % 9 = 0)"


def _groups(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    b = stable_bucket(F.col("id"), "grp", 10)
    own = o.select("id", F.when(b < 6, "train").when(b < 8, "val").otherwise("test").alias("g"))
    return own.unionByName(o.where("id % 9 = 0").select("id", F.lit("rl").alias("g")))


@query("leak_pairs", f"with {_GROUPS} select a.g as first_group, b.g as second_group, count(*) n, a.g = 'rl' and b.g = 'train' allowed from grp a join grp b on a.id = b.id and a.g < b.g group by 1, 2")
def leak_pairs(spark, sf):
    g = _groups(spark, sf)
    j = g.alias("a").join(g.alias("b"), F.expr("a.id = b.id AND a.g < b.g"))
    return j.groupBy(F.col("a.g").alias("first_group"), F.col("b.g").alias("second_group")).agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", (F.col("first_group") == "rl") & (F.col("second_group") == "train"))


@query("leak_except", f"with {_GROUPS} select id from grp where g = 'rl' except select id from grp where g = 'train'")
def leak_except(spark, sf):
    g = _groups(spark, sf)
    return g.where("g = 'rl'").select("id").subtract(g.where("g = 'train'").select("id"))


@query("unaccounted", "select c_custkey id from customer except select o_custkey from orders where o_orderstatus = 'P' except select user_id from events")
def unaccounted(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return c.subtract(table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey")).subtract(table(spark, sf, "events").select("user_id"))


@query("union_requests", "select event_id id, 'a' part from events where event_type = 'view' union all select event_id, 'b' from events where event_type = 'click'")
def union_requests(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.lit("a").alias("part")).unionByName(e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.lit("b").alias("part")))


@query("array_key_diff", "select event_id, case when event_id % 4 = 0 then 'k' else '' end missing, case when event_id % 4 = 0 then 'extra' else '' end extra from events")
def array_key_diff(spark, sf):
    doc = F.when(F.col("event_id") % 4 == 0, F.replace("props", F.lit('"k"'), F.lit('"extra"'))).otherwise(F.col("props"))
    e = table(spark, sf, "events").select("event_id", F.json_object_keys(doc).alias("keys"))
    want = F.array(F.lit("k"))
    return e.select("event_id", F.array_join(F.array_except(want, "keys"), ",").alias("missing"), F.array_join(F.array_except("keys", want), ",").alias("extra"))


@query("feature_coverage", "select count(*) filter (text is null) no_text, count(*) filter (lang is null) no_lang, count(*) filter (source is null) no_source, min(n_chars) lo, max(n_chars) hi, count(*) n from documents")
def feature_coverage(spark, sf):
    return table(spark, sf, "documents").agg(F.count_if(F.col("text").isNull()).alias("no_text"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("source").isNull()).alias("no_source"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("config_diff", "with a as (select user_id % 12 k, max(event_id) v from events group by 1), b as (select user_id % 15 k, max(case when user_id % 15 < 5 then event_id else -1 end) v from events where user_id % 15 = user_id % 12 or user_id % 15 > 11 group by 1) select coalesce(a.k, b.k) k, a.v old, b.v new from a full join b on a.k = b.k where a.v is distinct from b.v")
def config_diff(spark, sf):
    """Keys whose values differ between two maps, a missing one being a difference."""
    e = table(spark, sf, "events")
    a = e.groupBy((F.col("user_id") % 12).alias("k")).agg(F.max("event_id").alias("old"))
    k = F.col("user_id") % 15
    b = e.where((k == F.col("user_id") % 12) | (k > 11)).groupBy(k.alias("k")).agg(F.max(F.when(k < 5, F.col("event_id")).otherwise(-1)).alias("new"))
    return a.join(b, "k", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("k", "old", "new")
