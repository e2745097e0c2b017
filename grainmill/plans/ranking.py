"""Retrieval scores, top lists and samples."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from grainmill.functions.hashing import stable_bucket, stable_key
from grainmill.operators import ranking as R
from grainmill.plans.registry import query
from grainmill.plans.tables import MANIFEST, PREDS, bucket_sql, class_at, class_list_sql, manifest, predictions
from grainmill.session import keep, table

KS = [1, 5, 10, 25, 50]
VEC_SQL = """v as (select vec_id id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
n as (select id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from v where list_sum(list_transform(e, lambda y: y * y)) > 0),
pairs as (select q.id q_id, q.label q_label, c.id c_id, c.label c_label, round(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 9) score from n q join n c on q.id % 10 = 0 and q.id <> c.id),
ranked as (select * from (select *, row_number() over (partition by q_id order by score desc, c_id) rank from pairs) where rank <= 50)"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", R.normalised(F.col("embedding")).alias("vec")).where("vec IS NOT NULL")


def _ranked(spark, sf, k=50):
    """The stated query set, every tenth vector, against all others."""
    return _nearest(_vectors(spark, sf).withColumn("apart", F.col("id")), "id % 10 = 0", k)


def _nearest(vectors, queries, k):
    side = lambda df, name: df.select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns))
    return R.cosine_topk(side(vectors.where(queries), "q"), side(vectors, "c"), k)


def _totals(spark, sf):
    v = _vectors(spark, sf)
    sizes = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    return v.where("id % 10 = 0").join(sizes, "label").select(F.col("id").alias("q_id"), "n_relevant")


@query("cosine_topk", f"with {VEC_SQL} select q_id, c_id, rank, round(score, 6) score from ranked where rank <= 10")
def cosine_topk(spark, sf):
    return _ranked(spark, sf, 10).select("q_id", "c_id", "rank", F.round("score", 6).alias("score"))


SCORES_SQL = f"""with {VEC_SQL},
tot as (select n.id q_id, s.n - 1 n_relevant from n join (select label, count(*) n from n group by 1) s using (label) where id % 10 = 0 and s.n > 1),
hit as (select *, sum(rel) over (partition by q_id order by rank) hits from (select *, case when q_label = c_label then 1 else 0 end rel from ranked)),
ks as (select unnest([1, 5, 10, 25, 50]) k),
per as (select t.q_id, k, coalesce(sum(case when rel = 1 and rank <= k then hits / rank end), 0) / least(any_value(n_relevant), k) ap, coalesce(sum(case when rank <= k then rel end), 0) / any_value(n_relevant) recall
 from tot t cross join ks left join hit using (q_id) group by 1, 2)"""


def _scored(spark, sf):
    ranked = _ranked(spark, sf).select("q_id", "rank", (F.col("q_label") == F.col("c_label")).cast("int").alias("relevant"))
    return R.ranked_scores(ranked, _totals(spark, sf), KS)


def _long(df, name):
    stacked = df.agg(*(F.avg(f"{name}{k}").alias(f"{name}{k}") for k in KS))
    return stacked.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"{name}{k}").alias("v")) for k in KS))).alias("s")).select("s.k", F.round("s.v", 9).alias(name if name != "ap" else "map"))


@query("map_at_k", SCORES_SQL + " select k, round(avg(ap), 9) map from per group by 1")
def map_at_k(spark, sf):
    return _long(_scored(spark, sf), "ap")


@query("recall_at_k", SCORES_SQL + " select k, round(avg(recall), 9) recall from per group by 1")
def recall_at_k(spark, sf):
    return _long(_scored(spark, sf), "recall")


@query(
    "ndcg_at_k",
    f"""with {VEC_SQL}, ks as (select unnest([10, 50]) k),
rel as (select q_id, rank, case when q_label <> c_label then 0 when q_id % 3 = c_id % 3 then 2 else 1 end rel from ranked),
idl as (select q_id, row_number() over (partition by q_id order by rel desc) rank, rel from (select q_id, case when q_label <> c_label then 0 when q_id % 3 = c_id % 3 then 2 else 1 end rel from pairs)),
got as (select q_id, k, sum((pow(2, rel) - 1) / log2(rank + 1)) g from rel, ks where rank <= k group by 1, 2),
best as (select q_id, k, sum((pow(2, rel) - 1) / log2(rank + 1)) b from idl, ks where rank <= k group by 1, 2)
select k, round(avg(coalesce(g, 0) / greatest(b, 1e-12)), 9) ndcg from best left join got using (q_id, k) group by 1""",
)
def ndcg_at_k(spark, sf):
    grade = F.when(F.col("q_label") != F.col("c_label"), 0).when(F.col("q_id") % 3 == F.col("c_id") % 3, 2).otherwise(1)
    ranked = _ranked(spark, sf).select("q_id", "rank", grade.alias("relevance"))
    # judged items are counted by class and residue; the ideal list is laid out from the counts, no pair is formed
    v = _vectors(spark, sf).select("id", "label", (F.col("id") % 3).alias("m"))
    cells = v.groupBy("label", "m").agg(F.count(F.lit(1)).alias("n"))
    by_label = cells.groupBy("label").agg(F.sum("n").alias("n_label"))
    q = v.where("id % 10 = 0").join(cells, ["label", "m"]).join(by_label, "label")
    n2, n1 = F.col("n") - 1, F.col("n_label") - F.col("n")
    slots = q.select(F.col("id").alias("q_id"), n2.alias("n2"), n1.alias("n1"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("rank"))
    ideal = slots.select("q_id", "rank", F.when(F.col("rank") <= F.col("n2"), 2).when(F.col("rank") <= F.col("n2") + F.col("n1"), 1).otherwise(0).alias("relevance"))
    means = R.ndcg(ranked, ideal, [10, 50]).agg(F.avg("ndcg10").alias("ndcg10"), F.avg("ndcg50").alias("ndcg50"))
    return means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(f"ndcg{k}", 9).alias("ndcg")) for k in (10, 50)))).alias("s")).select("s.k", "s.ndcg")


DIFF_SQL = "(case when status = 'F' then 3 else 0 end + case when size < 50000 then 2 when size > 400000 then 1 else 0 end + round(least(size / 100000, 5) / 5, 3))"


def _difficulty():
    size = F.col("size")
    return F.when(F.col("status") == "F", 3).otherwise(0) + F.when(size < 50000, 2).when(size > 400000, 1).otherwise(0) + F.round(F.least(size / 100000, F.lit(5.0)) / 5, 3)


@query("difficulty_score", f"with {MANIFEST} select id, round({DIFF_SQL}, 4) difficulty from manifest")
def difficulty_score(spark, sf):
    return manifest(spark, sf).select("id", F.round(_difficulty(), 4).alias("difficulty"))


@query(
    "stratified_core",
    f"""with {MANIFEST}, d as (select *, round({DIFF_SQL}, 4) difficulty, sha256('7:' || id) h from manifest where split = 'test'),
r as (select *, row_number() over (partition by label order by difficulty, h) e, count(*) over (partition by label) n from d)
select id, label from r where e <= greatest(20, 30 - least(10, n)) or n - e + 1 <= 10""",
)
def stratified_core(spark, sf):
    d = manifest(spark, sf).where("split = 'test'").withColumn("difficulty", F.round(_difficulty(), 4)).withColumn("h", stable_key(F.col("id"), "7"))
    return R.stratified_core(d, "label", "id", ["difficulty", "h"], [], 30, 0.35).select("id", "label")


@query("hash_pick", f"with {MANIFEST} select id, label, rn from (select *, row_number() over (partition by label order by sha256('43:' || id)) rn from manifest where split = 'test') where rn <= 10")
def hash_pick(spark, sf):
    m = manifest(spark, sf).where("split = 'test'")
    w = Window.partitionBy("label").orderBy(stable_key(F.col("id"), "43"))
    return m.withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("id", "label", "rn")


@query("capped_sample", f"with {MANIFEST} select id, label from (select *, row_number() over (partition by label order by sha256('cap:' || id)) rn from manifest) where rn <= case when label = '5-LOW' then 400 else 800 end")
def capped_sample(spark, sf):
    """A cap per class, a smaller one for the background class; the hash order stands for a seeded shuffle."""
    w = Window.partitionBy("label").orderBy(stable_key(F.col("id"), "cap"))
    cap = F.when(F.col("label") == "5-LOW", 400).otherwise(800)
    return manifest(spark, sf).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).select("id", "label")


@query("shuffle_limit", f"with {MANIFEST} select id, label from manifest where split = 'train' order by sha256('rl:' || id) limit 150")
def shuffle_limit(spark, sf):
    return manifest(spark, sf).where("split = 'train'").orderBy(stable_key(F.col("id"), "rl")).limit(150).select("id", "label")


@query("top_errors", f"with {PREDS} select id, gold, pred, round({bucket_sql('id', 'conf', 10000)} / 10000.0, 4) confidence from preds where gold <> pred order by {bucket_sql('id', 'conf', 10000)} desc, id limit 50")
def top_errors(spark, sf):
    p = predictions(spark, sf).where("gold <> pred").withColumn("c", stable_bucket(F.col("id"), "conf", 10000))
    return p.orderBy(F.desc("c"), "id").limit(50).select("id", "gold", "pred", F.round(F.col("c") / 10000.0, 4).alias("confidence"))


@query("head_n", "select event_id, event_type from events order by event_id limit 60")
def head_n(spark, sf):
    return table(spark, sf, "events").orderBy("event_id").limit(60).select("event_id", "event_type")


@query(
    "random_baseline",
    "with a as (" + " union all ".join(f"select {s} seed, avg(case when {class_list_sql()}[{bucket_sql('o_orderkey', f'rand{s}', 5)} + 1] = o_orderpriority then 1.0 else 0.0 end) acc from orders" for s in range(5)) + ") select round(avg(acc), 9) mean_accuracy, round(stddev_pop(acc), 9) std_accuracy from a",
)
def random_baseline(spark, sf):
    o = table(spark, sf, "orders")
    rates = o.agg(*(F.avg((class_at(stable_bucket(F.col("o_orderkey"), f"rand{s}", 5)) == F.col("o_orderpriority")).cast("double")).alias(f"a{s}") for s in range(5)))
    a = rates.select(F.explode(F.array(*(f"a{s}" for s in range(5)))).alias("acc"))
    return a.agg(F.round(F.avg("acc"), 9).alias("mean_accuracy"), F.round(F.stddev_pop("acc"), 9).alias("std_accuracy"))


def _in_hash_order(queries, pool, eligible, k):
    """The first k of every query's eligible pool in hash order.

    Every pair is hashed where the join forms it. Hashes are even, so those of the first k lie below a bound that leaves about
    4 k + 60 of the pool; a query with fewer than k below it is ranked again over its whole pool.
    """
    h = stable_key(F.concat(F.col("q_id").cast("string"), F.lit("-"), F.col("c_id").cast("string")), "rr")
    q, c = queries.select(F.col("vec_id").alias("q_id")), pool.select(F.col("vec_id").alias("c_id"))
    # as many tasks as cores: a few small files would leave most of them idle
    spread = c.repartition(pool.sparkSession.sparkContext.defaultParallelism * 4, "c_id")
    hashed = lambda some: some.join(spread, eligible(F.col("q_id"), F.col("c_id"))).select("q_id", "c_id", h.alias("h"))
    first = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("h"))).where(F.col("rank") <= k)
    share = min(1.0, (4 * k + 60) / max(1, pool.count()))
    bound = f"{min(16**12 - 1, int(share * 16**12)):012x}" + "~"  # above every hash that begins so
    near = keep(first(hashed(q).where(F.col("h") <= bound)))
    full = near.where(F.col("rank") == k).select("q_id")
    scarce = first(hashed(q.join(full, "q_id", "left_anti")))
    return near.join(full, "q_id", "left_semi").unionByName(scarce).select("q_id", "c_id", "rank")


@query(
    "random_ranking",
    "select q_id, c_id, rank from (select q.vec_id q_id, c.vec_id c_id, row_number() over (partition by q.vec_id order by sha256('rr:' || q.vec_id || '-' || c.vec_id)) rank from embeddings q join embeddings c on q.vec_id % 10 = 0 and q.vec_id <> c.vec_id) where rank <= 10",
)
def random_ranking(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    return _in_hash_order(e.where("vec_id % 10 = 0"), e, lambda q, c: q != c, 10)


@query(
    "cosine_topk_lots",
    f"with {VEC_SQL.split('pairs as')[0]} p as (select q.id q_id, c.id c_id, round(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 9) score from n q join n c on q.id % 100 = 0 and q.id % 7 <> c.id % 7) select q_id, c_id, rank, round(score, 6) score from (select *, row_number() over (partition by q_id order by score desc, c_id) rank from p) where rank <= 50",
)
def cosine_topk_lots(spark, sf):
    """The 50 most similar vectors from other lots than the query's own; queries are every hundredth id."""
    return _nearest(_vectors(spark, sf).withColumn("apart", F.col("id") % 7), "id % 100 = 0", 50).select("q_id", "c_id", "rank", F.round("score", 6).alias("score"))


@query(
    "random_ranking_lots",
    "select q_id, c_id, rank from (select q.vec_id q_id, c.vec_id c_id, row_number() over (partition by q.vec_id order by sha256('rr:' || q.vec_id || '-' || c.vec_id)) rank from embeddings q join embeddings c on q.vec_id % 100 = 0 and q.vec_id % 7 <> c.vec_id % 7) where rank <= 50",
)
def random_ranking_lots(spark, sf):
    """Fifty vectors in hash order from the eligible pool, that is from other lots."""
    e = table(spark, sf, "embeddings").select("vec_id")
    return _in_hash_order(e.where("vec_id % 100 = 0"), e, lambda q, c: q % 7 != c % 7, 50)


@query("first_per_key", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) rn from events) where rn = 1")
def first_per_key(spark, sf):
    return R.pick_first(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("best_checkpoint", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value, event_id) rn from events) where rn = 1")
def best_checkpoint(spark, sf):
    """The lowest loss of every run, the first on ties, as one mergeable aggregate."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.struct("value", "event_id")).alias("m"))
    return e.select("user_id", "m.event_id", "m.value")


@query("log_first_last", "select user_id, arg_min(value, event_id) first_value, arg_max(value, event_id) last_value from events group by 1")
def log_first_last(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))


@query("every_nth", "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) - 1 i, count(*) over (partition by user_id) n from events) where i % 10 = 0 or i = n - 1")
def every_nth(spark, sf):
    return R.every_nth(table(spark, sf, "events"), ["user_id"], ["event_id"], 10).select("user_id", "event_id")


@query("rowwise_best", "with a as (select event_type, user_id % 10 run, round(avg(value), 6) v from events group by 1, 2) select event_type, run, v from (select *, rank() over (partition by event_type order by v desc) r from a) where r = 1")
def rowwise_best(spark, sf):
    a = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 10).alias("run")).agg(F.round(F.avg("value"), 6).alias("v"))
    return a.withColumn("r", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("v")))).where("r = 1").drop("r")


ANSWER_SQL = """with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
o as (select *, coalesce(sum(strlen(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) off from l),
c as (select doc_id, max(case when length(line) < 20 then off + strlen(line) + 1 end) cut from o group by 1),
k as (select o.doc_id, o.line, coalesce(o.off >= c.cut, true) after_cut from o join c using (doc_id))
select doc_id, count(*) n_lines, coalesce(nullif(sum(case when after_cut then 1 else 0 end), 0), count(*)) n_kept from k group by 1"""


@query("answer_span", ANSWER_SQL)
def answer_span(spark, sf):
    """Lines after the last marker line by running byte offset; all lines if nothing follows it."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line") + 1
    off = lines.withColumn("off", F.coalesce(F.sum(size).over(w), F.lit(0)))
    cut = F.max(F.when(F.length("line") < 20, F.col("off") + size)).over(Window.partitionBy("doc_id"))
    kept = off.withColumn("cut", cut).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.when(F.coalesce(F.col("off") >= F.col("cut"), F.lit(True)), 1).otherwise(0)).alias("n"))
    return kept.select("doc_id", "n_lines", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("n_lines")).alias("n_kept"))
