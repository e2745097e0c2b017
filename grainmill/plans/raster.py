"""Raster geometry: circle of the boundary, all features in one pass, and perturbed copies of rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import raster as R
from grainmill.plans.registry import query
from grainmill.session import table

HIGH, WIDE = 10, 11

CELLS = """cells as (select l_suppkey * 10 + l_linenumber g, cast(floor((l_quantity - 1) / 5) as integer) r, cast(round(l_discount * 100) as integer) c,
 max(case when l_returnflag = 'R' and l_tax < 0.03 then 2 else 1 end) v from lineitem group by 1, 2, 3)"""

CIRCLE = f"""{CELLS},
inner_ as (select a.g, a.r, a.c from cells a join cells b on a.g = b.g and abs(a.r - b.r) + abs(a.c - b.c) = 1 group by 1, 2, 3 having count(*) = 4),
edge0 as (select g, r, c from cells anti join inner_ using (g, r, c)), few as (select g from edge0 group by 1 having count(*) < 3),
edge as (select * from edge0 where g not in (select g from few) union all select g, r, c from cells where g in (select g from few)),
m as (select g, avg(c) mx, avg(r) my from edge group by 1), q as (select g, c - mx u, r - my v, mx, my from edge join m using (g)),
s as (select g, any_value(mx) mx, any_value(my) my, sum(u*u) uu, sum(u*v) uv, sum(v*v) vv, sum(u*u*u) + sum(u*v*v) a, sum(v*v*v) + sum(v*u*u) b, count(*) n from q group by 1),
d as (select *, (a * vv - b * uv) / 2 / (uu * vv - uv * uv) du, (b * uu - a * uv) / 2 / (uu * vv - uv * uv) dv from s where uu * vv - uv * uv > 1e-9 * (uu + vv) * (uu + vv)),
circle as (select g, mx + du cx, my + dv cy, greatest(sqrt(greatest(du * du + dv * dv + (uu + vv) / n, 1)), 1) radius from d)"""


WORD = 55  # cells in one of the two words of bits that hold a matrix


def matrices(spark, sf):
    """One matrix for each supplier and line number, by way of four words: a bit for every inside and every marked cell.

    The matrix is exploded from an array of one, so that it is a value of its row and not an expression made again for every cell that
    a feature looks at.
    """
    li = table(spark, sf, "lineitem")
    mark = (F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.03)
    spot = F.floor((F.col("l_quantity") - 1) / 5).cast("int") * WIDE + F.round(F.col("l_discount") * 100).cast("int")
    placed = li.select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("g"), spot.alias("spot"), mark.alias("mark"))
    bit = lambda k: F.when(F.floor(F.col("spot") / WORD) == k, F.expr(f"shiftleft(1L, spot - {k * WORD})"))
    words = placed.groupBy("g").agg(*(F.coalesce(F.bit_or(f(bit(k))), F.lit(0)).alias(f"{n}{k}") for n, f in (("inside", lambda b: b), ("marked", lambda b: F.when(F.col("mark"), b))) for k in range(-(-HIGH * WIDE // WORD))))
    at = lambda n, i: F.shiftright(f"{n}{i // WORD}", i % WORD).bitwiseAND(F.lit(1)).cast("int")
    rows = F.array(*(F.array(*(at("inside", r * WIDE + c) + at("marked", r * WIDE + c) for c in range(WIDE))) for r in range(HIGH)))
    return words.select("g", F.explode(F.array(rows)).alias("matrix"))


@query("raster_circle", f"with {CIRCLE} select g, round(cx, 6) cx, round(cy, 6) cy, round(radius, 6) radius from circle")
def raster_circle(spark, sf):
    """Where the boundary cells lie on a line SQL has no circle; such rows are left to the tests."""
    fitted = matrices(spark, sf).select("g", R.fit_circle(F.col("matrix")).alias("k"), _flat(F.col("matrix")).alias("flat"))
    return fitted.where("NOT flat").select("g", *(F.round(f"k.{x}", 6).alias(x) for x in ("cx", "cy", "radius")))


def _flat(matrix):
    """Whether the boundary cells lie on a line."""
    on_line = lambda e, p: (e[1]["r"] - e[0]["r"]) * (p["c"] - e[0]["c"]) == (e[1]["c"] - e[0]["c"]) * (p["r"] - e[0]["r"])
    return R.let(R.boundary(matrix), lambda e: (F.size(e) < 3) | F.forall(e, lambda p: on_line(e, p)))


FEATURES = f"""with {CIRCLE},
marks as (select distinct a.g, a.r, a.c from cells a join cells b on a.g = b.g and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 and not (a.r = b.r and a.c = b.c) where a.v = 2 and b.v = 2),
n as (select g, count(*) valid_count, count(*) filter (v = 2) raw_count from cells group by 1),
p as (select g, (c - cx) / radius x, (cy - r) / radius y from marks join circle using (g)),
t as (select *, sqrt(x * x + y * y) rad, case when atan2(x, y) < 0 then atan2(x, y) + 6.283185307179586 else atan2(x, y) end theta from p),
b as (select *, cast(least(floor(theta / 0.5235987755982988), 11) as integer) sec, case when rad <= 1 then cast(least(floor(rad * 10), 9) as integer) end ring from t),
hh as (select x.g, x.s, count(y.sec) k from (select g, unnest(range(12)) s from (select distinct g from b)) x left join b y on y.g = x.g and y.sec = x.s group by 1, 2),
hs as (select g, string_agg(cast(k as varchar), ',' order by s) sector_counts, arg_max(s, k * 100 - s) + 1 clock, sum(case when k > 0 then -(k / n) * log2(k / n) else 0 end) entropy from (select *, sum(k) over (partition by g) n from hh) group by 1),
rs as (select g, sum(ring * round(d / dd, 8)) ring_moment from (select *, sum(d) over (partition by g) dd from (select g, ring, count(*) / (2 * ring + 1) d from b where ring is not null group by 1, 2)) group by 1),
f as (select g, count(*) kept, avg(x) mx, avg(y) my, avg(rad) mr, stddev_pop(rad) sr, max(x) - min(x) sx, max(y) - min(y) sy, max(rad) - min(rad) span, sqrt(pow(avg(sin(theta)), 2) + pow(avg(cos(theta)), 2)) resultant,
 var_samp(x) va, var_samp(y) vb, covar_samp(x, y) vc from b group by 1)
select g, valid_count, raw_count, coalesce(kept, 0) kept, case when kept > 0 then 'ok' when raw_count > 0 then 'filtered_empty' else 'no_defect' end status,
 round(coalesce(kept, 0) / valid_count, 6) ratio, round(radius, 6) radius, round(sqrt(mx * mx + my * my), 6) centroid_r,
 case when kept is null then 'none' when sqrt(mx * mx + my * my) < 0.35 then 'center' when sqrt(mx * mx + my * my) < 0.72 then 'middle' else 'edge' end zone,
 cast(clock as integer) clock, round(mr, 6) mean_r, round(sr, 6) sd_r, round(greatest(sx, sy), 6) extent, round(span, 6) span, round(coalesce(resultant, 0), 6) resultant,
 coalesce(sector_counts, '0,0,0,0,0,0,0,0,0,0,0,0') sector_counts, round(abs(coalesce(entropy, 0)), 6) entropy, round(coalesce(ring_moment, 0), 6) ring_moment,
 round(case when kept > 0 then coalesce(greatest((va + vb) / 2 - sqrt(pow((va - vb) / 2, 2) + vc * vc), 0) / greatest((va + vb) / 2 + sqrt(pow((va - vb) / 2, 2) + vc * vc), 1e-12), 0) end, 6) anisotropy
from n join circle using (g) left join f using (g) left join hs using (g) left join rs using (g)"""



@query("raster_features", FEATURES)
def raster_features(spark, sf):
    """Filter, circle, histograms, sector, spread and status of every raster in one pass over the matrices."""
    m = matrices(spark, sf).select("g", _flat(F.col("matrix")).alias("flat"), R.static_features(F.col("matrix")).alias("f")).where("NOT flat")
    six = lambda c, name: F.round(c, 6).alias(name)
    counts = F.array_join(F.transform("f.angular_probability", lambda p: F.round(p * F.col("f.defect_count")).cast("int").cast("string")), ",")
    moment = F.aggregate(F.transform("f.radial_density", lambda d, i: d * i), F.lit(0.0), lambda t, x: t + x)
    return m.select(
        "g", F.col("f.valid_count").cast("long").alias("valid_count"), F.col("f.raw_defect_count").cast("long").alias("raw_count"), F.col("f.defect_count").cast("long").alias("kept"), F.col("f.status").alias("status"),
        six("f.defect_ratio", "ratio"), six("f.wafer_radius", "radius"), six("f.centroid_radius_r", "centroid_r"), F.col("f.radial_zone").alias("zone"), F.col("f.clock_sector").alias("clock"),
        six("f.mean_radius_r", "mean_r"), six("f.std_radius_r", "sd_r"), six("f.defect_extent_r", "extent"), six("f.radial_span_r", "span"), six("f.resultant_length", "resultant"),
        counts.alias("sector_counts"), six(F.abs("f.angle_entropy_bits"), "entropy"), six(moment, "ring_moment"), six("f.anisotropy_min_over_max", "anisotropy"),
    )


PALETTE = [0x000000, 0x00FF00, 0xFF0000]  # fixed values: outside, inside, marked

VARIANTS = f"""with {CELLS}, full_ as (select g, r, c, coalesce(v, 0) v from (select g, r, c from (select distinct g from cells), (select unnest(range({HIGH})) r), (select unnest(range({WIDE})) c)) left join cells using (g, r, c)),
p as (select *, [0, 65280, 16711680][v + 1] p from full_),
big as (select g, 'resize' perturbation, i, j, p from (select unnest(range({2 * HIGH})) i), (select unnest(range(7)) j), p where r = cast(floor((i + 0.5) * {HIGH} / {2 * HIGH}) as integer) and c = cast(floor((j + 0.5) * {WIDE} / 7) as integer)),
red as (select g, 'recolour' perturbation, r i, c j, case p when 65280 then 46110 when 16711680 then 16732240 else p end p from p),
turned as (select g, 'turn' perturbation, {WIDE} - 1 - c i, r j, p from p),
every_ as (select * from big union all select * from red union all select * from turned)
select g || '_' || perturbation variant, cast(max(i) + 1 as integer) high, cast(max(j) + 1 as integer) wide, sha256(string_agg(cast(p as varchar), ',' order by i, j)) pixels from every_ group by g, perturbation"""


@query("perturbed_rasters", VARIANTS)
def perturbed_rasters(spark, sf):
    """Three variants of every raster's picture: another size, another palette, a quarter turn."""
    m = matrices(spark, sf).select("g", R.painted(F.col("matrix"), PALETTE).alias("image"))
    image = F.col("image")
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("p")) for k, x in (("resize", R.resize_nearest(image, 2 * HIGH, 7)), ("recolour", R.recolour(image)), ("turn", R.quarter_turn(image)))))
    v = m.select("g", F.explode(kinds).alias("v")).select(F.concat_ws("_", F.col("g").cast("string"), "v.k").alias("variant"), F.col("v.p").alias("p"))
    text = F.array_join(F.transform(F.flatten("p"), lambda x: x.cast("string")), ",")
    return v.select("variant", F.size("p").alias("high"), F.size(F.get("p", F.lit(0))).alias("wide"), F.sha2(text, 256).alias("pixels"))
