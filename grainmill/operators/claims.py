"""Written claims held against recomputed figures.

A claim names the sentence that makes it, as a pattern whose groups are what it asserts. Texts are searched for all patterns, what is
found becomes typed values, and these meet figures that are computed anew from the rows: nothing is read back from the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.functions.scalars import numeral


@dataclass(frozen=True)
class Claim:
    """A sentence about one metric of several runs.

    ``kind`` extreme: the groups are a run and its value, the ``highest`` or lowest of all. ``kind`` count: the group is how many
    runs lie strictly above ``above``, or above the run ``baseline`` (which is not counted). ``kind`` range: the groups are the least
    and the greatest value. Numbers hold to the decimals they are written with; counts may be written as numerals.
    """

    name: str
    kind: str
    metric: str
    pattern: str
    highest: bool = True
    above: float | None = None
    baseline: str | None = None


def written(docs: DataFrame, claims: list[Claim]) -> DataFrame:
    """doc, name, kind, metric, how often the sentence stands in the text, and the texts of its first groups."""

    def found(c: Claim) -> Column:
        groups = [F.regexp_extract_all("text", F.lit(c.pattern), F.lit(i)) for i in ((1,) if c.kind == "count" else (1, 2))]
        first = [F.get(g, F.lit(0)) for g in groups] + [F.lit(None).cast("string")]
        return F.struct(F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.lit(c.metric).alias("metric"), F.coalesce(F.size(groups[0]), F.lit(0)).alias("times"), first[0].alias("first"), first[1].alias("second"))

    return docs.select("doc", F.explode(F.array(*map(found, claims))).alias("c")).select("doc", "c.*")


def recomputed(figures: DataFrame, claims: list[Claim]) -> DataFrame:
    """doc, name, lo, hi and n of every claim from ``figures`` (doc, run, metric, value); one grouped aggregation."""
    rules = F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(c.metric).alias("of"), F.lit(c.above).cast("double").alias("above"), F.lit(c.baseline).cast("string").alias("baseline")) for c in claims))
    rows = figures.where("value IS NOT NULL").withColumn("c", F.explode(F.filter(rules, lambda r: r["of"] == F.col("metric"))))
    base = F.max(F.when(F.col("run") == F.col("c.baseline"), F.col("value")))
    values = F.collect_list(F.when(~F.col("run").eqNullSafe(F.col("c.baseline")), F.col("value")))  # a value a run
    by = rows.groupBy("doc", F.col("c.name").alias("name")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.coalesce(F.first("c.above"), base).alias("limit"), values.alias("vs"))
    return by.select("doc", "name", "lo", "hi", F.size(F.filter("vs", lambda v: v > F.col("limit"))).alias("n"))


def holds(text: Column, value: Column) -> Column:
    """Whether a written number is ``value`` to the decimals it is written with."""
    decimals = F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)
    return F.coalesce(F.abs(text.try_cast("double") - value) <= 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9, F.lit(False))


def check(docs: DataFrame, figures: DataFrame, claims: list[Claim]) -> DataFrame:
    """doc, name, kind, verdict and what was asserted and computed.

    Verdicts: missing (the sentence is not there), ambiguous (it stands there more than once), unmeasured (no figure), ok, wrong. An extreme
    holds for any run that reaches it. ``docs``: doc, text; ``figures``: doc, run, metric, value.
    """
    w = written(docs, claims)
    own = figures.select("doc", "metric", F.col("run").alias("first"), F.col("value").alias("own"))
    # a run is looked up for extremes only; elsewhere the first group is a number
    w = w.join(own, ["doc", "metric", "first"], "left").join(recomputed(figures, claims), ["doc", "name"], "left")
    top = F.create_map(*(F.lit(x) for c in claims for x in (c.name, c.highest)))
    extreme = F.when(F.try_element_at(top, F.col("name")), F.col("hi")).otherwise(F.col("lo"))
    right = (
        F.when(F.col("kind") == "extreme", F.col("own").eqNullSafe(extreme) & holds(F.col("second"), extreme))
        .when(F.col("kind") == "count", numeral(F.col("first")) == F.col("n"))
        .otherwise(holds(F.col("first"), F.col("lo")) & holds(F.col("second"), F.col("hi")))
    )
    verdict = F.when(F.col("times") == 0, "missing").when(F.col("times") > 1, "ambiguous").when(F.col("hi").isNull(), "unmeasured").when(F.coalesce(right, F.lit(False)), "ok").otherwise("wrong")
    said = F.when(F.col("times") == 1, F.concat_ws(" ", "first", "second"))
    four = lambda c: F.format_string("%.4f", c)
    truth = F.when(F.col("hi").isNull(), None).when(F.col("kind") == "extreme", four(extreme)).when(F.col("kind") == "count", F.col("n").cast("string")).otherwise(F.concat_ws(" ", four(F.col("lo")), four(F.col("hi"))))
    return w.select("doc", "name", "kind", verdict.alias("verdict"), said.alias("asserted"), truth.alias("computed"))
