"""Scores of predictions: classes, structured fields, clocks, captions, robustness, raters and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions.hashing import stable_bucket
from grainmill.functions.scalars import circular_distance, safe_div
from grainmill.functions.scalars import six_digits
from grainmill.operators import metrics as M
from grainmill.plans.registry import query
from grainmill.plans.tables import CLASSES, CLOCKS, MANIFEST, PREDS, bucket_sql, class_list_sql, clocks, dist_sql, manifest, predictions, predictions_sql
from grainmill.session import table


@query("class_counts", f"with {MANIFEST} select split, label, count(*) n from manifest group by 1, 2")
def class_counts(spark, sf):
    return manifest(spark, sf).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


_PIVOT = ", ".join(f"count(*) filter (label = '{c}') c{i}" for i, c in enumerate(CLASSES))


@query("split_pivot", f"with {MANIFEST} select split, {_PIVOT} from manifest group by 1")
def split_pivot(spark, sf):
    p = manifest(spark, sf).groupBy("split").pivot("label", CLASSES).count().fillna(0)
    return p.toDF("split", *(f"c{i}" for i in range(len(CLASSES))))


@query("dup_ids", "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def dup_ids(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("accuracy", f"with {PREDS} select round(avg(case when gold = pred then 1.0 else 0.0 end), 9) accuracy, count(*) n from preds")
def accuracy(spark, sf):
    return predictions(spark, sf).agg(F.round(F.avg(F.col("gold").eqNullSafe(F.col("pred")).cast("double")), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


_PRF = f"""with {PREDS}, c as (select unnest({class_list_sql()}) label),
k as (select label, count(*) filter (gold = label and pred = label) tp, count(*) filter (gold = label) n, count(*) filter (pred = label) p from c, preds group by 1),
f as (select label, case when p = 0 then 0 else tp / p end pr, case when n = 0 then 0 else tp / n end re, case when p + n = 0 then 0 else 2 * tp / (p + n) end f1, n from k)"""


@query("per_class_prf", _PRF + " select label, round(pr, 9) as precision, round(re, 9) recall, round(f1, 9) f1, n support from f")
def per_class_prf(spark, sf):
    m = M.per_class(predictions(spark, sf), CLASSES)
    return m.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("macro_f1", _PRF + " select round(avg(f1), 9) macro_f1 from f")
def macro_f1(spark, sf):
    return M.per_class(predictions(spark, sf), CLASSES).agg(F.round(F.avg("f1"), 9).alias("macro_f1"))


@query("confusion", f"with {PREDS} select gold, pred, count(*) n from preds group by 1, 2")
def confusion(spark, sf):
    return predictions(spark, sf).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


@query(
    "field_accuracy",
    f"with {CLOCKS} select label, round(avg(case when nullif(answer, 'n/a') is not distinct from cast(clock as varchar) then 1.0 else 0.0 end) filter (answer <> 'n/a'), 9) clock_accuracy, round(avg(case when round(size_answer, 2) is not distinct from round(size, 2) then 1.0 else 0.0 end), 9) size_accuracy from clocks group by 1",
)
def field_accuracy(spark, sf):
    """Parse errors leave the denominator; equal by the null-safe test."""
    c = clocks(spark, sf)
    same = F.col("answer").eqNullSafe(F.col("clock").cast("string")).cast("double")
    return c.groupBy("label").agg(F.round(F.avg(F.when(F.col("answer") != "n/a", same)), 9).alias("clock_accuracy"), F.round(F.avg(F.round("size_answer", 2).eqNullSafe(F.round("size", 2)).cast("double")), 9).alias("size_accuracy"))


@query("circular_mae", f"with {CLOCKS} select label, round(avg({dist_sql('try_cast(answer as integer)', 'clock')}), 9) mae, count(try_cast(answer as integer)) n from clocks group by 1")
def circular_mae(spark, sf):
    a = F.col("answer").try_cast("int")
    return clocks(spark, sf).groupBy("label").agg(F.round(F.avg(circular_distance(a, F.col("clock"))), 9).alias("mae"), F.count(a).alias("n"))


@query("size_mae", f"with {CLOCKS} select label, round(avg(abs(size_answer - size)), 6) mae from clocks group by 1")
def size_mae(spark, sf):
    return clocks(spark, sf).groupBy("label").agg(F.round(F.avg(F.abs(F.col("size_answer") - F.col("size"))), 6).alias("mae"))


MUST, AVOID = ["tion", "ing "], ["&&&", "***", "!!"]


@query(
    "caption_rates",
    "select lang, round(avg(case when " + " or ".join(f"contains(lower(text), '{t}')" for t in MUST) + " then 1.0 else 0.0 end), 9) must_hit, round(avg(case when " + " or ".join(f"contains(lower(text), '{t}')" for t in AVOID) + " then 1.0 else 0.0 end), 9) avoid_hit, round(avg(case when text is null or trim(text) = '' then 1.0 else 0.0 end), 9) empty from documents group by 1",
)
def caption_rates(spark, sf):
    low = F.lower("text")
    hit = lambda terms: F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: low.contains(t)), F.lit(False)).cast("double")
    empty = (F.col("text").isNull() | (F.trim("text") == "")).cast("double")
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg(hit(MUST)), 9).alias("must_hit"), F.round(F.avg(hit(AVOID)), 9).alias("avoid_hit"), F.round(F.avg(empty), 9).alias("empty"))


_VARIANTS = f"""with {PREDS}, var as (select id, gold, pred, p, case when b < 20 then {class_list_sql()}[b % 5 + 1] else pred end vpred
 from (select *, {bucket_sql("id || '-' || p", 'var', 100)} b from preds, (select unnest([0, 1, 2]) p)))"""


def _variants(spark, sf):
    v = predictions(spark, sf).withColumn("p", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    b = stable_bucket(F.concat(F.col("id").cast("string"), F.lit("-"), F.col("p").cast("string")), "var", 100)
    other = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("b") % 5 + 1)
    return v.withColumn("b", b).withColumn("vpred", F.when(F.col("b") < 20, other).otherwise(F.col("pred")))


@query("robustness", _VARIANTS + " select p perturbation, round(avg(case when vpred = gold then 1.0 else 0.0 end), 9) accuracy, count(*) filter (vpred = 'INVALID') n_invalid, round(sum(case when vpred <> pred then 1 else 0 end) / nullif(count(*) filter (vpred <> 'INVALID'), 0), 9) flip_rate from var group by 1")
def robustness(spark, sf):
    v = _variants(spark, sf)
    flips = F.sum((F.col("vpred") != F.col("pred")).cast("int"))
    return v.groupBy(F.col("p").alias("perturbation")).agg(
        F.round(F.avg((F.col("vpred") == F.col("gold")).cast("double")), 9).alias("accuracy"),
        F.count_if(F.col("vpred") == "INVALID").alias("n_invalid"),
        F.round(safe_div(flips, F.count_if(F.col("vpred") != "INVALID")), 9).alias("flip_rate"),
    )


@query("flip_rate", _VARIANTS + " select round(avg(case when v.vpred <> c.pred then 1.0 else 0.0 end), 9) flip_rate, count(*) n from var v left join preds c using (id)")
def flip_rate(spark, sf):
    """Variants join the clean prediction of their sample; without one there is no flip."""
    v = _variants(spark, sf).select("id", "vpred")
    clean = predictions(spark, sf).select("id", "pred")
    flip = F.coalesce(F.col("vpred") != F.col("pred"), F.lit(False))
    return v.join(clean, "id", "left").agg(F.round(F.avg(flip.cast("double")), 9).alias("flip_rate"), F.count(F.lit(1)).alias("n"))


@query("majority_floor", "with c as (select o_custkey % 10 g, o_orderpriority label, count(*) n from orders group by 1, 2), t as (select g, sum(n) total, count(*) k from c group by 1) select g, label, round(n / total, 9) share, round(1.0 / k, 9) chance from (select *, row_number() over (partition by g order by n desc, label) r from c) join t using (g) where r = 1")
def majority_floor(spark, sf):
    c = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).alias("g"), F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("g").agg(F.min(F.struct(-F.col("n"), "label")).alias("m"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return t.select("g", "m.label", F.round(-F.col("m.col1") / F.col("total"), 9).alias("share"), F.round(1.0 / F.col("k"), 9).alias("chance"))


@query("circular_median", f"with {CLOCKS}, l as (select label, c, sum({dist_sql('clock', 'c')}) loss from clocks, (select unnest(range(1, 13)) c) group by 1, 2) select label, cast(c as integer) best, cast(loss as bigint) loss from (select *, row_number() over (partition by label order by loss, c) r from l) where r = 1")
def circular_median(spark, sf):
    """Counts of the 12 positions decide; the candidates meet counts, never rows."""
    n = clocks(spark, sf).groupBy("label", "clock").agg(F.count(F.lit(1)).alias("n"))
    cand = n.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(12))))
    loss = cand.groupBy("label", "c").agg(F.sum(circular_distance(F.col("clock"), F.col("c")) * F.col("n")).alias("loss"))
    return loss.groupBy("label").agg(F.min(F.struct("loss", "c")).alias("m")).select("label", F.col("m.c").alias("best"), "m.loss")


@query("numeric_summary", "select event_type, round(avg(value), 6) mean, round(median(value), 6) median, min(value) lo, max(value) hi, round(max(value) - min(value), 6) spread from events group by 1")
def numeric_summary(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.max(v) - F.min(v), 6).alias("spread"))


@query("corr", f"with {CLOCKS} select label, round(corr(size_answer, size), 6) r from clocks group by 1")
def corr(spark, sf):
    constant = (F.stddev_pop("size") == 0) | (F.stddev_pop("size_answer") == 0)
    return clocks(spark, sf).groupBy("label").agg(F.round(F.when(~constant, F.corr("size_answer", "size")), 6).alias("r"))


@query("cohen_kappa", "with l as (select quality a, toxic b from labels where quality is not null and toxic is not null), n as (select count(*) n, avg(case when a = b then 1.0 else 0.0 end) po from l), e as (select sum(x.n * y.n) s from (select a k, count(*) n from l group by 1) x join (select b k, count(*) n from l group by 1) y using (k)) select n, round(po, 9) observed, round(s / (n * n), 9) expected, round((po - s / (n * n)) / (1 - s / (n * n)), 9) kappa from n, e")
def cohen_kappa(spark, sf):
    k = M.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic")
    return k.select("n", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


_PAIR = f"with {predictions_sql('a')}, {predictions_sql('b', 45, 'second')}"


def _pair(spark, sf):
    a = predictions(spark, sf).select("id", "gold", (F.col("gold") == F.col("pred")).cast("int").alias("a"))
    b = predictions(spark, sf, 45, "second").select("id", (F.col("gold") == F.col("pred")).cast("int").alias("b"))
    return a.join(b, "id")


@query("mcnemar", _PAIR + " select gold, count(*) filter (a.gold = a.pred and b.gold <> b.pred) n10, count(*) filter (a.gold <> a.pred and b.gold = b.pred) n01 from a join b using (id, gold) group by 1")
def mcnemar(spark, sf):
    """Discordant pairs of every class."""
    d = _pair(spark, sf)
    return d.groupBy("gold").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("n10"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("n01"))


_P = "case when n = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) end"
_CELLS = _PAIR + ", c as (select {key} cell, count(*) filter (a.gold = a.pred and b.gold <> b.pred) n10, count(*) filter (a.gold <> a.pred and b.gold = b.pred) n01 from a join b using (id, gold) group by 1), d as (select *, n10 + n01 n, least(n10, n01) k from c)"


@query("mcnemar_by_class", _CELLS.format(key="gold") + f" select cell, n10, n01, printf('%.5e', {_P}) p from d")
def mcnemar_by_class(spark, sf):
    """Exact p-values of the discordant counts of every class, with six significant digits."""
    d = _pair(spark, sf).groupBy(F.col("gold").alias("cell")).agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("n10"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("n01"))
    return d.select("cell", "n10", "n01", six_digits(M.mcnemar(F.col("n01"), F.col("n10"))).alias("p"))


@query("mcnemar_p", _CELLS.format(key="id % 50") + f" select cell, n10, n01, round({_P}, 9) p from d")
def mcnemar_p(spark, sf):
    """Exact p-values of the discordant counts of every lot residue."""
    d = _pair(spark, sf).groupBy((F.col("id") % 50).alias("cell")).agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("n10"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("n01"))
    return d.select("cell", "n10", "n01", F.round(M.mcnemar(F.col("n01"), F.col("n10")), 9).alias("p"))


@query("bootstrap_ci", f"with {PREDS}, b as {M.bootstrap_counts_sql('preds', 'case when gold = pred then 1 else 0 end', 500, 'boot')} select round(quantile_cont(mean, 0.025), 9) lo, round(quantile_cont(mean, 0.975), 9) hi, count(*) n from b")
def bootstrap_ci(spark, sf):
    """Percentile interval of 500 replicates with linear interpolation; weights have no cap."""
    b = M.bootstrap_counts(predictions(spark, sf), F.col("gold") == F.col("pred"), 500, "boot")
    return b.agg(F.round(F.percentile("mean", 0.025), 9).alias("lo"), F.round(F.percentile("mean", 0.975), 9).alias("hi"), F.count(F.lit(1)).alias("n"))


@query("paired_boot", _PAIR + f", d as (select cast(a.gold = a.pred as integer) - cast(b.gold = b.pred as integer) x from a join b using (id)), r as (select mean, row_number() over (order by mean, rep) - 1 i from {M.bootstrap_counts_sql('d', 'x', 20_000, 'pair')}) select round(max(mean) filter (i = 500), 9) lo, round(max(mean) filter (i = 19500), 9) hi, max(mean) filter (i = 500) > 0 or max(mean) filter (i = 19500) < 0 excludes_zero from r")
def paired_boot(spark, sf):
    """Order statistics of 20,000 replicate differences, as the interval is defined without interpolation."""
    n = 20_000
    b = M.bootstrap_counts(_pair(spark, sf), F.col("a") - F.col("b"), n, "pair")
    s = b.agg(F.array_sort(F.collect_list("mean")).alias("m"))  # one value a replicate
    lo, hi = F.get("m", F.lit(int(0.025 * n))), F.get("m", F.lit(int(0.975 * n)))
    return s.select(F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"), ((lo > 0) | (hi < 0)).alias("excludes_zero"))


_CELLS = "(select coalesce(gold, '?') || '|' || coalesce(pred, '?') x, count(*) n from preds group by 1)"
_F1 = " + ".join(f"coalesce(2 * sum(case when gold = '{c}' and pred = '{c}' then w else 0 end) / nullif(sum(case when gold = '{c}' then w else 0 end) + sum(case when pred = '{c}' then w else 0 end), 0), 0)" for c in CLASSES)


@query(
    "bootstrap_macro_f1",
    f"with {PREDS}, b as (select rep, ({_F1}) / {len(CLASSES)} v from (select rep, w, split_part(x, '|', 1) gold, split_part(x, '|', 2) pred from {M.poisson_weights_sql(_CELLS, 500, 'macro')}) group by rep) select round(quantile_cont(v, 0.025), 9) lo, round(quantile_cont(v, 0.975), 9) hi, count(*) n from b",
)
def bootstrap_macro_f1(spark, sf):
    """Percentile interval of macro-F1 over 500 replicates."""
    b = M.bootstrap_metric(predictions(spark, sf), M.macro_f1_of(CLASSES), 500, "macro")
    return b.agg(F.round(F.percentile("value", 0.025), 9).alias("lo"), F.round(F.percentile("value", 0.975), 9).alias("hi"), F.count(F.lit(1)).alias("n"))


@query("class_median", "select label, round(median(cast(list_aggregate(embedding, 'max') as double)), 6) median_peak from embeddings group by 1")
def class_median(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.round(F.median(F.array_max("embedding").cast("double")), 6).alias("median_peak"))


@query("usage_rollup", "select coalesce(source, 'total') file, sum(coalesce(n_chars, 0)) units, count(*) n from documents group by rollup(source)")
def usage_rollup(spark, sf):
    return table(spark, sf, "documents").rollup("source").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("units"), F.count(F.lit(1)).alias("n")).select(F.coalesce("source", F.lit("total")).alias("file"), "units", "n")


_STEPS = "steps as (select user_id run, cast(floor(epoch(ts) / 86400) as integer) step, stddev_pop(value) sd, avg(value) m, count(*) n from events group by 1, 2)"


def _steps(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("run"), F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("step")).agg(F.stddev_pop("value").alias("sd"), F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))


@query("reward_signal", f"with {_STEPS} select run, round(avg(m), 6) mean, round(avg(sd), 6) mean_sd, bool_or(sd > 0) any_signal from steps group by 1")
def reward_signal(spark, sf):
    return _steps(spark, sf).groupBy("run").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("sd"), 6).alias("mean_sd"), F.bool_or(F.col("sd") > 0).alias("any_signal"))


@query("idle_share", f"with {_STEPS} select run, round(count(*) filter (n = 1) / count(*), 9) idle_share from steps group by 1")
def idle_share(spark, sf):
    """Steps whose group has no spread because it has one member."""
    return _steps(spark, sf).groupBy("run").agg(F.round(safe_div(F.count_if(F.col("n") == 1), F.count(F.lit(1))), 9).alias("idle_share"))


@query("identity_check", "select user_id, round(max(abs(value - 0.5 * (2 * value + (event_id % 3) * 1e-5))), 9) gap, bool_and(abs(value - 0.5 * (2 * value + (event_id % 3) * 1e-5)) <= 1e-4) ok from events where event_type <> 'error' group by 1")
def identity_check(spark, sf):
    gap = F.abs(F.col("value") - 0.5 * (2 * F.col("value") + (F.col("event_id") % 3) * 1e-5))
    return table(spark, sf, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.round(F.max(gap), 9).alias("gap"), F.bool_and(gap <= 1e-4).alias("ok"))


@query("seed_spread", "with a as (select event_type, user_id % 3 seed, avg(value) v from events group by 1, 2), g as (select avg(value) v from events) select event_type, round(max(a.v) - min(a.v), 6) spread, round(any_value(abs(g.v)) * 0.5, 6) threshold, max(a.v) - min(a.v) > any_value(abs(g.v)) * 0.5 noisy, arg_max(seed, a.v) best_seed from a, g group by 1")
def seed_spread(spark, sf):
    e = table(spark, sf, "events")
    a = e.groupBy("event_type", (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("v"))
    effect = e.agg((F.abs(F.avg("value")) * 0.5).alias("t"))  # one row
    s = a.groupBy("event_type").agg((F.max("v") - F.min("v")).alias("s"), F.max_by("seed", "v").alias("best_seed"))
    return s.join(effect, F.lit(True)).select("event_type", F.round("s", 6).alias("spread"), F.round("t", 6).alias("threshold"), (F.col("s") > F.col("t")).alias("noisy"), "best_seed")


@query("drop_rate", f"with {CLOCKS}, c as (select label, count(*) n, count(*) filter (answer = 'n/a') d from clocks group by 1), t as (select sum(d) / sum(n) r from c) select label, n, d dropped, round(d / n, 9) rate, d / n > 2 * r flagged from c, t")
def drop_rate(spark, sf):
    c = clocks(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") == "n/a").alias("dropped"))
    t = c.agg((F.sum("dropped") / F.sum("n")).alias("r"))  # one row
    return c.join(t, F.lit(True)).select("label", "n", "dropped", F.round(F.col("dropped") / F.col("n"), 9).alias("rate"), (F.col("dropped") / F.col("n") > 2 * F.col("r")).alias("flagged"))


@query("geo_mean", "select user_id, round(exp(avg(ln(value)) filter (event_type <> 'error' and value > 0)), 6) confidence from events group by 1")
def geo_mean(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.exp(F.avg(F.when((F.col("event_type") != "error") & (F.col("value") > 0), F.log("value")))), 6).alias("confidence"))


@query("agreement", f"with {predictions_sql('a')}, {predictions_sql('b', 45, 'second')}, j as (select id, a.pred = b.pred exact, left(a.pred, 1) = left(b.pred, 1) func from a join b using (id)) select round(avg(case when exact then 1.0 else 0.0 end), 9) exact_share, round(avg(case when func then 1.0 else 0.0 end), 9) functional_share, (select string_agg(id, ',' order by id) from (select id from j where not exact order by id limit 20)) first_mismatches from j")
def agreement(spark, sf):
    a = predictions(spark, sf).select("id", F.col("pred").alias("p"))
    b = predictions(spark, sf, 45, "second").select("id", F.col("pred").alias("q"))
    j = a.join(b, "id")
    shares = j.agg(F.round(F.avg((F.col("p") == F.col("q")).cast("double")), 9).alias("exact_share"), F.round(F.avg((F.left("p", F.lit(1)) == F.left("q", F.lit(1))).cast("double")), 9).alias("functional_share"))
    first = j.where("p <> q").orderBy("id").limit(20).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("first_mismatches"))
    return shares.join(first, F.lit(True))


@query("cost_summary", "select event_type, round(sum(value), 6) credits, count(*) attempts, count(*) filter (value < 100) successes, round(sum(value) / count(*), 6) per_attempt, round(sum(value) / nullif(count(*) filter (value < 100), 0), 6) per_success from events group by 1")
def cost_summary(spark, sf):
    ok = F.count_if(F.col("value") < 100)
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 6).alias("credits"), F.count(F.lit(1)).alias("attempts"), ok.alias("successes"), F.round(safe_div(F.sum("value"), F.count(F.lit(1))), 6).alias("per_attempt"), F.round(safe_div(F.sum("value"), ok), 6).alias("per_success"))


_RUN_F1 = f"""with {PREDS}, c as (select lot % 40 run, l.label, count(*) filter (gold = l.label and pred = l.label) tp from preds, (select unnest({class_list_sql()}) label) l where id % 3 = 0 group by 1, 2)"""


@query("zeroed_class", _RUN_F1.replace(" where id % 3 = 0", "") + " select run, bool_or(tp < 45) any_low, bool_and(tp > 0) all_found from c group by 1")
def zeroed_class(spark, sf):
    p = predictions(spark, sf).withColumn("run", F.col("lot") % 40)
    tp = p.groupBy("run").agg(*(F.count_if((F.col("gold") == c) & (F.col("pred") == c)).alias(f"t{i}") for i, c in enumerate(CLASSES)))
    t = F.array(*(f"t{i}" for i in range(len(CLASSES))))
    return tp.select("run", F.exists(t, lambda x: x < 45).alias("any_low"), F.forall(t, lambda x: x > 0).alias("all_found"))


@query("rate_direction", "with a as (select user_id % 20 cell, avg(value) filter (event_type = 'view') lo, avg(value) filter (event_type = 'click') hi from events group by 1) select cell, round(hi - lo, 6) change, case when hi > lo then 'raised' when hi < lo then 'lowered' else 'same' end direction from a where lo is not null and hi is not null")
def rate_direction(spark, sf):
    a = table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("cell")).pivot("event_type", ["view", "click"]).agg(F.avg("value")).dropna()
    return a.select("cell", F.round(F.col("click") - F.col("view"), 6).alias("change"), F.when(F.col("click") > F.col("view"), "raised").when(F.col("click") < F.col("view"), "lowered").otherwise("same").alias("direction"))
