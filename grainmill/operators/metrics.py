"""Classification, agreement and paired-test metrics as grouped aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.functions.scalars import safe_div


def per_class(df: DataFrame, classes: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of a fixed class list in one pass; 0 where a denominator is 0."""
    aggs = []
    for i, c in enumerate(classes):
        g, p = F.col(gold).eqNullSafe(c), F.col(pred).eqNullSafe(c)
        aggs += [F.count_if(g & p).alias(f"tp{i}"), F.count_if(g).alias(f"n{i}"), F.count_if(p).alias(f"p{i}")]
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("p")) for i, c in enumerate(classes)))).alias("r")).select("r.*")
    zero = F.lit(0.0)
    return rows.select(
        "label",
        F.coalesce(safe_div(F.col("tp"), F.col("p")), zero).alias("precision"),
        F.coalesce(safe_div(F.col("tp"), F.col("n")), zero).alias("recall"),
        F.coalesce(safe_div(2 * F.col("tp"), F.col("p") + F.col("n")), zero).alias("f1"),
        F.col("n").alias("support"),
    )


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected agreement; kappa is null without rows or where chance explains all."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    left, right = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na")), cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "k").agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    seen = cells.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum("n").alias("n"))
    # two one-row tables
    both = seen.join(chance, F.lit(True))
    po, pe = safe_div(F.col("same"), F.col("n")), safe_div(F.coalesce("s", F.lit(0)), F.col("n") * F.col("n"))
    return both.select("n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series sixteen places up, where it is exact to fourteen digits."""
    x = n.cast("double") + 17
    square = x * x
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * square)) / square) / square) / x
    return series - sum((F.log(n.cast("double") + i) for i in range(1, 17)), F.lit(0.0))


def mcnemar(n01: Column, n10: Column) -> Column:
    """Exact two-sided p-value of the discordant counts, capped at 1.

    The binomial tail is summed from its largest term down, relative to that, and only that term is needed in logarithms. Terms
    fall below a rounding step within ten standard deviations, so the cost is the root of the counts.
    """
    n, k = n01 + n10, F.least(n01, n10)
    steps = F.least(k, F.ceil(5 * F.sqrt(n.cast("double"))) + 60).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(s: Column, i: Column) -> Column:
        term = s["term"] * (k - i) / (n - k + i + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    tail = F.aggregate(F.when(steps > 0, F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")), start, down, lambda s: s["sum"])
    largest = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(largest + F.log(2 * tail))))


def poisson_table(counts: DataFrame) -> DataFrame:
    """For every row of x and n the distribution of Poisson(n): x, k and the probability p of at most k.

    What lies outside the table is below 1e-17, less than a step of a 48-bit hash. Probabilities are sums of logarithms from
    the first k on, taken relative to the largest, so no count is too large.
    """
    spread = F.lit(9.5) * F.sqrt("n") + 40
    low, high = F.greatest(F.lit(0), F.floor(F.col("n") - spread)).cast("long"), F.ceil(F.col("n") + spread).cast("long")
    up = Window.partitionBy("x").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    k = counts.withColumn("low", low).withColumn("k", F.explode(F.sequence(low, high)))
    logs = k.withColumn("l", F.sum(F.when(F.col("k") > F.col("low"), F.log(F.col("n") / F.col("k"))).otherwise(0.0)).over(up))
    p = logs.withColumn("p", F.exp(F.col("l") - F.max("l").over(Window.partitionBy("x"))))
    return p.select("x", "k", (F.sum("p").over(up) / F.sum("p").over(Window.partitionBy("x"))).alias("p"))


def poisson_weights(counts: DataFrame, replicates: int, seed: str) -> DataFrame:
    """x, rep and the weight w, one draw of Poisson(n), for every row of ``counts`` (x, n) and replicate."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("x").cast("string"), F.lit(":"), F.col("rep").cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("double") / float(16**12)
    draws = counts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select("x", "rep", F.lit(None).cast("long").alias("k"), u.alias("p"))
    table = poisson_table(counts).select("x", F.lit(None).cast("int").alias("rep"), "k", "p")
    # from the top down, the last step of the distribution above a draw is the smallest k whose probability exceeds it
    down = Window.partitionBy("x").orderBy(F.desc("p"), F.col("k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    w = F.coalesce(F.last("k", ignorenulls=True).over(down), F.max("k").over(Window.partitionBy("x")))
    return draws.unionByName(table).withColumn("w", w).where("rep is not null").select("x", "rep", "w")


def poisson_weights_sql(counts: str, replicates: int, seed: str) -> str:
    """The DuckDB form of :func:`poisson_weights`: a subquery of x, rep, w for a subquery of x, n.

    A draw takes the smallest k whose probability of at most k exceeds it, by an ordered join.
    """
    return f"""(with c as {counts},
t as (select x, n, cast(greatest(0, floor(n - 9.5 * sqrt(n) - 40)) as bigint) low, unnest(range(cast(greatest(0, floor(n - 9.5 * sqrt(n) - 40)) as bigint), cast(ceil(n + 9.5 * sqrt(n) + 40) as bigint) + 1)) k from c),
l as (select x, k, sum(case when k > low then ln(n / cast(k as double)) else 0 end) over (partition by x order by k) l from t),
e as (select x, k, exp(l - max(l) over (partition by x)) p from l),
p as (select x, k, sum(p) over (partition by x order by k) / sum(p) over (partition by x) p from e),
d as (select x, rep, cast(cast('0x' || substr(sha256('{seed}:' || cast(x as varchar) || ':' || rep), 1, 12) as ubigint) as double) / {float(16**12)!r} u from c, (select unnest(range({replicates})) rep)),
w as (select d.x, rep, k from d asof left join p on d.x = p.x and d.u < p.p),
hi as (select x, max(k) m from p group by 1)
select x, rep, coalesce(k, m) w from w join hi using (x))"""


def bootstrap_counts_sql(table: str, value: str, replicates: int, seed: str) -> str:
    """The DuckDB form of :func:`bootstrap_counts`."""
    counts = f"(select cast({value} as double) x, count(*) n from {table} where {value} is not null group by 1)"
    return f"(select rep, sum(w * x) / nullif(sum(w), 0) mean from {poisson_weights_sql(counts, replicates, seed)} group by rep)"


def bootstrap_counts(df: DataFrame, value: Column, replicates: int, seed: str) -> DataFrame:
    """Poisson bootstrap of the mean of a value with few distinct cases: n equal rows together weigh Poisson(n) in a replicate.

    That is the sum of their Poisson(1) weights, so the replicates cost the distinct values and not the rows. Weights have no
    cap. A replicate that weighs nothing has no mean.
    """
    counts = df.select(value.cast("double").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("x is not null")
    return poisson_weights(counts, replicates, seed).groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("mean"))


def bootstrap_metric(df: DataFrame, metric: Callable[[DataFrame], DataFrame], replicates: int, seed: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Poisson bootstrap of any metric of (gold, pred) counts: ``metric`` turns rows of rep, gold, pred, w into rep, value.

    Rows are counted to cells first, so the replicates cost the pairs of classes and not the rows.
    """
    cells = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("x", F.concat_ws("|", F.coalesce("gold", F.lit("?")), F.coalesce("pred", F.lit("?"))))
    weights = poisson_weights(cells.select("x", "n"), replicates, seed)
    return metric(weights.join(cells.select("x", "gold", "pred"), "x").select("rep", "gold", "pred", "w"))


def macro_f1_of(classes: list[str]) -> Callable[[DataFrame], DataFrame]:
    """The macro-F1 of weighted cells, for :func:`bootstrap_metric`."""

    def metric(cells: DataFrame) -> DataFrame:
        parts = []
        for c in classes:
            of = lambda test: F.sum(F.when(test, F.col("w")).otherwise(0))
            both = of(F.col("gold").eqNullSafe(c)) + of(F.col("pred").eqNullSafe(c))
            parts.append(F.coalesce(safe_div(2 * of(F.col("gold").eqNullSafe(c) & F.col("pred").eqNullSafe(c)), both), F.lit(0.0)))
        return cells.groupBy("rep").agg((sum(parts, F.lit(0.0)) / len(classes)).alias("value"))

    return metric
