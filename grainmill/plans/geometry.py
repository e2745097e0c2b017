"""Point-set and raster features of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions.scalars import rotate_clock
from grainmill.operators import geometry as G
from grainmill.plans.registry import query
from grainmill.plans.tables import CLOCKS, GEOMETRY, clocks, geometry
from grainmill.session import table

RASTER = "cells as (select distinct l_suppkey g, cast(l_quantity as integer) r, cast(l_partkey % 60 as integer) c from lineitem)"


def raster(spark, sf):
    """Cells of suppliers, some of them more than once."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("g"), F.col("l_quantity").cast("int").alias("r"), (F.col("l_partkey") % 60).cast("int").alias("c"))


@query("isolated_filter", f"with {RASTER} select a.g, a.r, a.c, count(*) n from cells a join cells b on a.g = b.g and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by 1, 2, 3 having count(*) > 1")
def isolated_filter(spark, sf):
    return G.neighbours(raster(spark, sf)).where("n > 1")


@query("feature_status", f"with {RASTER}, n as (select a.g, a.r, a.c, count(*) n from cells a join cells b on a.g = b.g and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by 1, 2, 3), k as (select g, count(*) raw_count, count(*) filter (n > 1) kept from n group by 1) select s_suppkey g, coalesce(raw_count, 0) raw_count, coalesce(kept, 0) kept, case when raw_count is null then 'no_defect' when kept = 0 then 'filtered_empty' else 'ok' end status from supplier left join k on g = s_suppkey")
def feature_status(spark, sf):
    """Groups without any cell keep a row."""
    k = G.neighbours(raster(spark, sf)).groupBy("g").agg(F.count(F.lit(1)).alias("raw_count"), F.count_if(F.col("n") > 1).alias("kept"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("g")).join(k, "g", "left")
    status = F.when(F.col("raw_count").isNull(), "no_defect").when(F.col("kept") == 0, "filtered_empty").otherwise("ok")
    return s.select("g", F.coalesce("raw_count", F.lit(0)).alias("raw_count"), F.coalesce("kept", F.lit(0)).alias("kept"), status.alias("status"))


@query(
    "circle_fit",
    f"""with {GEOMETRY}, m as (select g, avg(x) mx, avg(y) my from geo group by 1), q as (select g, x - mx u, y - my v, mx, my from geo join m using (g)),
s as (select g, any_value(mx) mx, any_value(my) my, sum(u*u) uu, sum(u*v) uv, sum(v*v) vv, sum(u*u*u) + sum(u*v*v) a, sum(v*v*v) + sum(v*u*u) b, count(*) n from q group by 1)
select g, round(mx + (a * vv - b * uv) / 2 / (uu * vv - uv * uv), 6) cx, round(my + (b * uu - a * uv) / 2 / (uu * vv - uv * uv), 6) cy, round(sqrt(pow((a * vv - b * uv) / 2 / (uu * vv - uv * uv), 2) + pow((b * uu - a * uv) / 2 / (uu * vv - uv * uv), 2) + (uu + vv) / n), 6) radius from s""",
)
def circle_fit(spark, sf):
    return G.circle_fit(geometry(spark, sf)).select("g", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "radius")))


@query("radial_hist", f"with {GEOMETRY} select g, cast(least(floor(r * 10), 9) as integer) bin, round(count(*) / (2 * least(floor(r * 10), 9) + 1), 6) density from geo where r <= 1 group by 1, least(floor(r * 10), 9)")
def radial_hist(spark, sf):
    """Ten rings, the outer edge inside the last, points beyond it dropped, counts over ring area."""
    b = geometry(spark, sf).where("r <= 1").withColumn("bin", F.least(F.floor(F.col("r") * 10), F.lit(9)).cast("int"))
    return b.groupBy("g", "bin").agg(F.round(F.count(F.lit(1)) / (2 * F.col("bin") + 1), 6).alias("density"))


SECTOR_SQL = "cast(least(floor(theta / 0.5235987755982988), 11) as integer)"


def _sector():
    return F.least(F.floor(F.col("theta") / 0.5235987755982988), F.lit(11)).cast("int")


@query("angular_hist", f"with {GEOMETRY}, h as (select g, {SECTOR_SQL} bin, count(*) n from geo group by 1, 2) select g, bin, round(n / sum(n) over (partition by g), 9) p from h")
def angular_hist(spark, sf):
    return G.shares(geometry(spark, sf).withColumn("bin", _sector())).select("g", "bin", F.round("p", 9).alias("p"))


@query("entropy", f"with {GEOMETRY}, h as (select g, {SECTOR_SQL} bin, count(*) n from geo group by 1, 2), p as (select g, n / sum(n) over (partition by g) p from h) select g, round(-sum(p * log2(p)), 6) entropy from p group by 1")
def entropy(spark, sf):
    return G.shares(geometry(spark, sf).withColumn("bin", _sector())).groupBy("g").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


@query("resultant", f"with {GEOMETRY} select g, round(sqrt(pow(avg(sin(theta)), 2) + pow(avg(cos(theta)), 2)), 6) len from geo group by 1")
def resultant(spark, sf):
    return geometry(spark, sf).groupBy("g").agg(F.round(F.hypot(F.avg(F.sin("theta")), F.avg(F.cos("theta"))), 6).alias("len"))


@query("clock_sector", f"with {GEOMETRY}, h as (select g, {SECTOR_SQL} bin, count(*) n from geo group by 1, 2) select g, bin + 1 sector from (select *, row_number() over (partition by g order by n desc, bin) k from h) where k = 1")
def clock_sector(spark, sf):
    """The fullest sector, the lowest on ties, as one aggregate."""
    h = geometry(spark, sf).groupBy("g", _sector().alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("g").agg(F.min(F.struct(-F.col("n"), "bin")).alias("m")).select("g", (F.col("m.bin") + 1).alias("sector"))


@query("anisotropy", f"with {GEOMETRY}, s as (select g, var_samp(x) a, var_samp(y) b, covar_samp(x, y) c, count(*) n from geo group by 1) select g, case when n < 2 then 0 else round(((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c)) / greatest((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c), 1e-12), 6) end ratio from s")
def anisotropy(spark, sf):
    return G.anisotropy(geometry(spark, sf)).select("g", F.round("ratio", 6).alias("ratio"))


@query("centroid_stats", f"with {GEOMETRY} select g, round(avg(x), 6) + 0.0 cx, round(avg(y), 6) + 0.0 cy, round(avg(r), 6) mean_r, round(stddev_pop(r), 6) sd_r, round(max(x) - min(x), 6) span_x, round(max(y) - min(y), 6) span_y, round(max(r), 6) extent from geo group by 1")
def centroid_stats(spark, sf):
    x, y, r = (F.col(c) for c in "xyr")
    return geometry(spark, sf).groupBy("g").agg((F.round(F.avg(x), 6) + 0.0).alias("cx"), (F.round(F.avg(y), 6) + 0.0).alias("cy"), F.round(F.avg(r), 6).alias("mean_r"), F.round(F.stddev_pop(r), 6).alias("sd_r"), F.round(F.max(x) - F.min(x), 6).alias("span_x"), F.round(F.max(y) - F.min(y), 6).alias("span_y"), F.round(F.max(r), 6).alias("extent"))


@query("zone_redefine", f"with {GEOMETRY}, a as (select g, avg(r) mean_r, median(r) median_r, max(r) max_r from geo group by 1) select g, case when mean_r < 0.35 then 'center' when mean_r < 0.72 then 'middle' else 'edge' end by_mean, case when median_r < 0.35 then 'center' when median_r < 0.72 then 'middle' else 'edge' end by_median, case when max_r < 0.35 then 'center' when max_r < 0.72 then 'middle' else 'edge' end by_max from a")
def zone_redefine(spark, sf):
    from grainmill.functions.scalars import zone_of

    a = geometry(spark, sf).groupBy("g").agg(F.avg("r").alias("mean_r"), F.median("r").alias("median_r"), F.max("r").alias("max_r"))
    return a.select("g", zone_of(F.col("mean_r")).alias("by_mean"), zone_of(F.col("median_r")).alias("by_median"), zone_of(F.col("max_r")).alias("by_max"))


@query("perturb_explode", f"with {CLOCKS} select id || '_' || k variant_id, k perturbation, cast(case when k = 'rotate' then ((clock - 1 - 3 * (id % 4)) % 12 + 12) % 12 + 1 else clock end as integer) clock from clocks, (select unnest(['resize', 'recolor', 'rotate']) k)")
def perturb_explode(spark, sf):
    """Three variants of every sample with the gold that follows from each."""
    c = clocks(spark, sf)
    v = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), x.cast("int").alias("c")) for k, x in (("resize", F.col("clock")), ("recolor", F.col("clock")), ("rotate", rotate_clock(F.col("clock"), F.col("id") % 4))))))
    return c.select("id", v.alias("v")).select(F.concat_ws("_", F.col("id").cast("string"), "v.k").alias("variant_id"), F.col("v.k").alias("perturbation"), F.col("v.c").alias("clock"))


@query("palette_check", "select l_suppkey g, count(distinct l_returnflag || l_linestatus) n_colours, count(distinct case when l_returnflag || l_linestatus not in ('AF', 'NO', 'RF') then l_returnflag || l_linestatus end) n_foreign from lineitem group by 1")
def palette_check(spark, sf):
    colours = F.collect_set(F.concat("l_returnflag", "l_linestatus"))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(colours.alias("s"))
    return g.select("g", F.size("s").alias("n_colours"), F.size(F.array_except("s", F.array(F.lit("AF"), F.lit("NO"), F.lit("RF")))).alias("n_foreign"))


@query("palette_packing", "with c as (select p_size g, (p_partkey % 256) * 65536 + (p_size * 5) * 256 + p_partkey % 7 packed from part) select g, count(distinct packed) n_colours, min(packed) lowest, max(packed) highest from c group by 1")
def palette_packing(spark, sf):
    """Red, green and blue packed into one integer, and the palette of every group."""
    red, green, blue = F.col("p_partkey") % 256, F.col("p_size") * 5, F.col("p_partkey") % 7
    packed = F.shiftleft(red.cast("long"), 16).bitwiseOR(F.shiftleft(green.cast("long"), 8)).bitwiseOR(blue.cast("long"))
    g = table(spark, sf, "part").groupBy(F.col("p_size").alias("g"))
    return g.agg(F.countDistinct(packed).alias("n_colours"), F.min(packed).alias("lowest"), F.max(packed).alias("highest"))
