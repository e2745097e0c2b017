"""Raster expressions against plain Python and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import raster as R


def disk(size=31):
    c = (size - 1) / 2
    return [[1 if (x - c) ** 2 + (y - c) ** 2 <= (c - 1) ** 2 else 0 for x in range(size)] for y in range(size)]


def at(m, r, c):
    return (m[r][c] or 0) if 0 <= r < len(m) and 0 <= c < len(m[r]) else 0


def brute_circle(m):
    inside = [(r, c) for r, row in enumerate(m) for c in range(len(row)) if at(m, r, c) > 0]
    wide = max((len(row) for row in m), default=0)
    if not inside:
        return (wide - 1) / 2, (len(m) - 1) / 2, max(min(len(m), wide) / 2, 1.0)
    edge = [(r, c) for r, c in inside if min(at(m, r - 1, c), at(m, r + 1, c), at(m, r, c - 1), at(m, r, c + 1)) == 0]
    edge = edge if len(edge) >= 3 else inside
    a = np.array([(c, r, 1.0) for r, c in edge])
    z = np.linalg.lstsq(a, np.array([c * c + r * r for r, c in edge], float), rcond=None)[0]
    return z[0] / 2, z[1] / 2, max(math.sqrt(max(z[2] + (z[0] ** 2 + z[1] ** 2) / 4, 1.0)), 1.0)


def brute(m, apply_filter=True):
    marks = [(r, c) for r, row in enumerate(m) for c in range(len(row)) if at(m, r, c) == 2]
    raw = len(marks)
    if apply_filter:
        marks = [(r, c) for r, c in marks if sum(at(m, r + a, c + b) == 2 for a in (-1, 0, 1) for b in (-1, 0, 1)) > 1]
    cx, cy, radius = brute_circle(m)
    out = {"status": "ok" if marks else "filtered_empty" if raw else "no_defect", "raw_defect_count": raw, "defect_count": len(marks), "wafer_radius": radius, "valid_count": sum(at(m, r, c) > 0 for r, row in enumerate(m) for c in range(len(row)))}
    if not marks:
        return out | {"centroid_radius_r": None, "radial_density": [0.0] * 10, "angular_probability": [0.0] * 12, "resultant_length": 0.0, "clock_sector": None, "anisotropy_min_over_max": None}
    x, y = np.array([(c - cx) / radius for _, c in marks]), np.array([(cy - r) / radius for r, _ in marks])
    x, y = (np.where(np.abs(z) < 1e-9, 0.0, z) for z in (x, y))  # the solver's noise would decide the sector on an axis
    rad, ang = np.hypot(x, y), np.mod(np.arctan2(x, y), 2 * np.pi)
    rings, edges = np.histogram(rad, bins=10, range=(0, 1))
    dens = rings / (np.pi * (edges[1:] ** 2 - edges[:-1] ** 2))
    sect = np.histogram(ang, bins=12, range=(0, 2 * np.pi))[0]
    p = sect / sect.sum()
    eig = np.linalg.eigvalsh(np.cov(np.stack([x, y]))) if len(x) > 1 else [0, 1]
    return out | {
        "centroid_radius_r": math.hypot(x.mean(), y.mean()), "radial_density": list(dens / dens.sum() if dens.sum() else dens), "angular_probability": list(p),
        "resultant_length": math.hypot(np.sin(ang).mean(), np.cos(ang).mean()), "clock_sector": int(sect.argmax()) + 1, "mean_radius_r": rad.mean(), "std_radius_r": rad.std(),
        "defect_extent_r": max(np.ptp(x), np.ptp(y)), "radial_span_r": np.ptp(rad), "angle_entropy_bits": -sum(q * math.log2(q) for q in p if q), "anisotropy_min_over_max": max(eig[0], 0) / max(eig[-1], 1e-12),
    }


def cases():
    rng = np.random.default_rng(5)
    out = [[], [[]], [[0, 0], [0, 0], [0, 0]], [[1]], [[0, 2], [0, 0]], [[1, 1, 1, 1, 2, 2]], [[1], [2], [2]], [[0, 0, 1], [0, 1, 0], [1, 0, 0]], [[1, 0, 0], [0, 0, 0], [0, 0, 1]], [[1, None, 2], [2], [1, 1, 1, 1]], disk()]
    for size in (4, 9, 15):
        for share in (0.1, 0.4):
            m = disk(size)
            out.append([[2 if v and rng.random() < share else v for v in row] for row in m])
            out.append(rng.choice([0, 1, 2], (size, size + 3)).tolist())
    return out


@pytest.mark.parametrize("apply_filter", [True, False])
def test_features(spark, apply_filter):
    made = cases()
    df = spark.createDataFrame(list(enumerate(made)), "i int, m array<array<int>>")
    got = {r["i"]: r["f"] for r in df.select("i", R.static_features(F.col("m"), apply_filter).alias("f")).collect()}
    for i, m in enumerate(made):
        for name, want in brute(m, apply_filter).items():
            found = got[i][name]
            if name in ("resultant_length", "angle_entropy_bits") or isinstance(want, (float, list)):
                assert found == pytest.approx(want, abs=1e-7), (i, name)
            else:
                assert found == want, (i, name)
        assert got[i]["filtered_points_removed"] == got[i]["raw_defect_count"] - got[i]["defect_count"]
    null = spark.createDataFrame([(None,)], "m array<array<int>>").select(R.static_features(F.col("m")).alias("f")).first()
    assert null["f"] is None


def test_circle(spark):
    made = cases()
    df = spark.createDataFrame(list(enumerate(made)), "i int, m array<array<int>>")
    for r in df.select("i", R.fit_circle(F.col("m")).alias("k")).collect():
        assert tuple(r["k"]) == pytest.approx(brute_circle(made[r["i"]]), abs=1e-6), r["i"]


def test_marks_at_the_top_and_single_marks(spark):
    top, single = disk(), disk()
    for r in (4, 5):
        for c in (14, 15, 16):
            top[r][c] = 2
    single[15][15] = 2
    a, b = (r["f"] for r in spark.createDataFrame([(0, top), (1, single)], "i int, m array<array<int>>").orderBy("i").select(R.static_features(F.col("m")).alias("f")).collect())
    assert a["clock_sector"] in (12, 1) and a["centroid_xy_r"][1] > 0
    assert (b["status"], b["raw_defect_count"], b["defect_count"], b["filtered_points_removed"]) == ("filtered_empty", 1, 0, 1)
    kept = spark.createDataFrame([(top,), (single,)], "m array<array<int>>").select(R.isolated_filter(F.col("m")).alias("m")).collect()
    assert [sum(v == 2 for row in r["m"] for v in row) for r in kept] == [6, 0]


def test_a_turned_raster_has_the_turned_clock(spark):
    made = []
    for spot in ((4, 17), (15, 24), (24, 20), (20, 5), (6, 8)):
        m = disk()
        for a in (0, 1):
            for b in (0, 1):
                m[spot[0] + a][spot[1] + b] = 2
        made.append((m,))
    both = F.struct(R.static_features(F.col("m"))["clock_sector"].alias("a"), R.static_features(R.quarter_turn(F.col("m")))["clock_sector"].alias("b"))
    for r in spark.createDataFrame(made, "m array<array<int>>").select(both.alias("k")).collect():
        assert r["k"]["b"] == (r["k"]["a"] - 1 - 3) % 12 + 1


def test_pictures(spark):
    m = [[0, 1, 2], [2, 1, 0]]
    df = spark.createDataFrame([(m,)], "m array<array<int>>")
    image = R.painted(F.col("m"), [0x000000, 0x00FF00, 0xFF0000])
    r = df.select(R.quarter_turn(F.col("m")).alias("turn"), R.resize_nearest(F.col("m"), 4, 2).alias("size"), R.recolour(image).alias("colour")).first()
    assert r["turn"] == np.rot90(np.array(m)).tolist()
    assert r["size"] == [[0, 2], [0, 2], [2, 0], [2, 0]]
    assert r["colour"] == [[0, 0x00B41E, 0xFF5050], [0xFF5050, 0x00B41E, 0]]


def test_a_matrix_is_made_once_for_all_that_look_at_it(spark, tmp_path):
    from grainmill.plans import raster as P

    cells = [(1, 1, 1.0, 0.0, 0.0, "R"), (1, 1, 5.9, 0.0, 0.05, "R"), (1, 1, 46.0, 0.1, 0.01, "R"), (1, 1, 47.0, 0.1, 0.01, "A"), (1, 1, 30.0, 0.05, 0.0, None), (1, 2, None, 0.05, 0.0, "R")]
    spark.createDataFrame(cells, "l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["g"]: {(i, j): v for i, row in enumerate(r["matrix"]) for j, v in enumerate(row) if v} for r in P.matrices(spark, str(tmp_path)).collect()}
    assert got == {11: {(0, 0): 2, (9, 10): 2, (5, 5): 1}, 12: {}}
    plan = P.raster_circle(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    # no step above the one that makes matrices holds the columns they are made from
    made = [str(plan.apply(i).nodeName()) for i in range(12) if plan.apply(i) is not None]
    assert "Generate" in made[: made.index("Aggregate")]
