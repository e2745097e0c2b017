"""Rasters as ``array<array<int>>`` columns (0 outside, 1 inside, 2 marked): filter, circle, features and perturbations as column expressions.

Everything is one expression of built-in array functions over a row's matrix, so a table of matrices is read once, nothing is shuffled
and no row leaves the JVM. Cells outside a matrix, missing cells of short rows and null cells count as 0. A null matrix has null
features; one without inside cells has the centre of its frame and half its shorter side as circle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from grainmill.functions.scalars import zone_of

RINGS, SECTORS = 10, 12
TURN = 6.283185307179586


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(matrix: Column, r: Column, c: Column) -> Column:
    return F.coalesce(F.get(F.get(matrix, r), c), F.lit(0))


def cells(matrix: Column) -> Column:
    """All cells as structs r, c, v."""
    return F.flatten(F.transform(matrix, lambda row, r: F.transform(row, lambda v, c: F.struct(r.alias("r"), c.alias("c"), F.coalesce(v, F.lit(0)).alias("v")))))


def total(points: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda t, p: t + f(p))


def kept_marks(matrix: Column) -> Column:
    """Marked cells that have a marked one among their eight neighbours."""
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]

    def near(p: Column) -> Column:
        found = F.lit(False)
        for a, b in around:
            found = found | (at(matrix, p["r"] + a, p["c"] + b) == 2)
        return found

    return F.filter(cells(matrix), lambda p: (p["v"] == 2) & near(p))


def isolated_filter(matrix: Column) -> Column:
    """The matrix with isolated marks as plain inside cells."""
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]

    def value(v: Column, r: Column, c: Column) -> Column:
        found = F.lit(False)
        for a, b in around:
            found = found | (at(matrix, r + a, c + b) == 2)
        return F.when((v == 2) & ~found, 1).otherwise(v)

    return F.transform(matrix, lambda row, r: F.transform(row, lambda v, c: value(v, r, c)))


def boundary(matrix: Column) -> Column:
    """Inside cells that an erosion with the four-neighbour cross takes away; all inside cells where those are fewer than three."""
    inside = F.filter(cells(matrix), lambda p: p["v"] > 0)

    def eroded(p: Column) -> Column:
        stays = F.lit(True)
        for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            stays = stays & (at(matrix, p["r"] + a, p["c"] + b) > 0)
        return stays

    return let(inside, lambda whole: let(F.filter(whole, lambda p: ~eroded(p)), lambda edge: F.when(F.size(edge) < 3, whole).otherwise(edge)))


def _least_squares(points: Column) -> Column:
    """Struct cx, cy, squared radius of the circle of least squares; where the points lie on a line, the solution of least norm."""
    n = F.size(points)
    mean = F.struct((total(points, lambda p: p["c"]) / n).alias("x"), (total(points, lambda p: p["r"]) / n).alias("y"))

    def centred(m: Column) -> Column:
        u, v = (lambda p: p["c"] - m["x"]), (lambda p: p["r"] - m["y"])
        return F.struct(
            m["x"].alias("x"), m["y"].alias("y"),
            total(points, lambda p: u(p) * u(p)).alias("uu"), total(points, lambda p: u(p) * v(p)).alias("uv"), total(points, lambda p: v(p) * v(p)).alias("vv"),
            total(points, lambda p: u(p) * (u(p) * u(p) + v(p) * v(p))).alias("a"), total(points, lambda p: v(p) * (u(p) * u(p) + v(p) * v(p))).alias("b"),
            total(points, lambda p: (p["c"] * p["c"] + p["r"] * p["r"]).cast("double")).alias("bb"),
            total(points, lambda p: u(p) * (p["c"] * p["c"] + p["r"] * p["r"])).alias("ub"), total(points, lambda p: v(p) * (p["c"] * p["c"] + p["r"] * p["r"])).alias("vb"),
        )

    def circle(cx: Column, cy: Column, rr: Column) -> Column:
        return F.struct(cx.alias("cx"), cy.alias("cy"), rr.alias("rr"))

    def plain(s: Column) -> Column:
        det = 2 * (s["uu"] * s["vv"] - s["uv"] * s["uv"])
        du, dv = (s["a"] * s["vv"] - s["b"] * s["uv"]) / det, (s["b"] * s["uu"] - s["a"] * s["uv"]) / det
        return let(F.struct(du.alias("u"), dv.alias("v")), lambda d: circle(s["x"] + d["u"], s["y"] + d["v"], d["u"] * d["u"] + d["v"] * d["v"] + (s["uu"] + s["vv"]) / n))

    def line(s: Column) -> Column:
        # the points are the mean plus t times (dx, dy), and their squared norms alpha plus beta t
        wide = s["uu"] >= s["vv"]
        dx, dy = F.when(wide, s["uu"]).otherwise(s["uv"]), F.when(wide, s["uv"]).otherwise(s["vv"])
        unit = let(F.struct(dx.alias("x"), dy.alias("y"), F.hypot(dx, dy).alias("h")), lambda d: F.struct((d["x"] / d["h"]).alias("x"), (d["y"] / d["h"]).alias("y")))

        def solved(d: Column) -> Column:
            beta = (s["ub"] * d["x"] + s["vb"] * d["y"]) / (s["uu"] + s["vv"])
            off = s["y"] * d["x"] - s["x"] * d["y"]
            return let(F.struct(beta.alias("b"), off.alias("s"), (s["bb"] / n - beta * (s["x"] * d["x"] + s["y"] * d["y"])).alias("q")), lambda k: least(d, k))

        def least(d: Column, k: Column) -> Column:
            gamma = k["q"] * k["s"] / (1 + k["s"] * k["s"])
            z0, z1, z2 = k["b"] * d["x"] - gamma * d["y"], k["b"] * d["y"] + gamma * d["x"], k["q"] - gamma * k["s"]
            return circle(z0 / 2, z1 / 2, z2 + (z0 * z0 + z1 * z1) / 4)

        return let(unit, solved)

    def point(s: Column) -> Column:
        b = s["x"] * s["x"] + s["y"] * s["y"]
        f = b / (b + 1)
        return circle(s["x"] * f / 2, s["y"] * f / 2, f + f * f * b / 4)

    def chosen(s: Column) -> Column:
        flat = s["uu"] * s["vv"] - s["uv"] * s["uv"] <= 1e-9 * (s["uu"] + s["vv"]) * (s["uu"] + s["vv"])
        return F.when(s["uu"] + s["vv"] == 0, point(s)).when(flat, line(s)).otherwise(plain(s))

    return let(mean, lambda m: let(centred(m), chosen))


def fit_circle(matrix: Column) -> Column:
    """Struct cx, cy, radius of the circle through the boundary of the inside cells; radius 1 at least."""
    wide, high = F.coalesce(F.array_max(F.transform(matrix, lambda row: F.size(row))), F.lit(0)), F.size(matrix)
    frame = F.struct(((wide - 1) / 2).alias("cx"), ((high - 1) / 2).alias("cy"), F.greatest(F.least(high, wide) / 2, F.lit(1.0)).alias("radius"))
    fitted = lambda edge: let(_least_squares(edge), lambda k: F.struct(k["cx"], k["cy"], F.sqrt(F.greatest(k["rr"], F.lit(1.0))).alias("radius")))
    return let(boundary(matrix), lambda edge: F.when(F.size(edge) == 0, frame).otherwise(fitted(edge)))


def histogram(bins: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.size(F.filter(bins, lambda x: x == b)))


def _measured(points: Column) -> Column:
    """Features of points x, y, r (in radii) and t (clockwise angle from the top); at least one point."""
    n = F.size(points)
    spread = lambda f: F.array_max(F.transform(points, f)) - F.array_min(F.transform(points, f))
    rings = histogram(F.transform(F.filter(points, lambda p: p["r"] <= 1), lambda p: F.least(F.floor(p["r"] * RINGS), F.lit(RINGS - 1)).cast("int")), RINGS)
    sectors = histogram(F.transform(points, lambda p: F.least(F.floor(p["t"] / (TURN / SECTORS)), F.lit(SECTORS - 1)).cast("int")), SECTORS)
    per_area = F.transform(rings, lambda k, i: k / (2 * i + 1).cast("double"))
    sums = F.struct(
        (total(points, lambda p: p["x"]) / n).alias("x"), (total(points, lambda p: p["y"]) / n).alias("y"), (total(points, lambda p: p["r"]) / n).alias("r"),
        (total(points, lambda p: F.sin(p["t"])) / n).alias("sin"), (total(points, lambda p: F.cos(p["t"])) / n).alias("cos"),
        per_area.alias("rings"), sectors.alias("sectors"),
    )

    def out(s: Column) -> Column:
        square = lambda f, g: total(points, lambda p: f(p) * g(p))
        dx, dy = (lambda p: p["x"] - s["x"]), (lambda p: p["y"] - s["y"])
        cov = F.struct((square(dx, dx) / (n - 1)).alias("a"), (square(dy, dy) / (n - 1)).alias("b"), (square(dx, dy) / (n - 1)).alias("c"))
        root = lambda k: F.sqrt(F.pow((k["a"] - k["b"]) / 2, F.lit(2)) + k["c"] * k["c"])
        ratio = lambda k: F.greatest((k["a"] + k["b"]) / 2 - root(k), F.lit(0.0)) / F.greatest((k["a"] + k["b"]) / 2 + root(k), F.lit(1e-12))
        rings_sum = F.aggregate(s["rings"], F.lit(0.0), lambda t, x: t + x)
        shares = F.transform(s["sectors"], lambda k: k / n)
        centre = F.hypot(s["x"], s["y"])
        return F.struct(
            F.array(s["x"], s["y"]).alias("centroid_xy_r"), centre.alias("centroid_radius_r"), zone_of(centre).alias("radial_zone"),
            F.array_position(s["sectors"], F.array_max(s["sectors"])).cast("int").alias("clock_sector"), s["r"].alias("mean_radius_r"),
            F.sqrt(total(points, lambda p: F.pow(p["r"] - s["r"], F.lit(2))) / n).alias("std_radius_r"),
            F.greatest(spread(lambda p: p["x"]), spread(lambda p: p["y"])).alias("defect_extent_r"), spread(lambda p: p["r"]).alias("radial_span_r"),
            F.transform(s["rings"], lambda k: F.bround(F.when(rings_sum > 0, k / rings_sum).otherwise(k), 8)).alias("radial_density"),
            F.transform(shares, lambda k: F.bround(k, 8)).alias("angular_probability"), F.hypot(s["sin"], s["cos"]).alias("resultant_length"),
            F.aggregate(shares, F.lit(0.0), lambda t, k: t - F.when(k > 0, k * F.log2(k)).otherwise(0.0)).alias("angle_entropy_bits"),
            F.when(n < 2, 0.0).otherwise(let(cov, ratio)).alias("anisotropy_min_over_max"),
        )

    return let(sums, out)


def static_features(matrix: Column, apply_filter: bool = True) -> Column:
    """All features of a matrix as one struct; those of the marks have fixed values where no mark is left."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    nothing = lambda kind: F.lit(None).cast(kind)
    unmarked = F.struct(
        nothing("array<double>").alias("centroid_xy_r"), nothing("double").alias("centroid_radius_r"), F.lit("none").alias("radial_zone"), nothing("int").alias("clock_sector"),
        nothing("double").alias("mean_radius_r"), nothing("double").alias("std_radius_r"), nothing("double").alias("defect_extent_r"), nothing("double").alias("radial_span_r"),
        zeros(RINGS).alias("radial_density"), zeros(SECTORS).alias("angular_probability"), F.lit(0.0).alias("resultant_length"), F.lit(0.0).alias("angle_entropy_bits"), nothing("double").alias("anisotropy_min_over_max"),
    )

    def placed(p: Column, k: Column) -> Column:
        x, y = (p["c"] - k["cx"]) / k["radius"], (k["cy"] - p["r"]) / k["radius"]
        return F.struct(x.alias("x"), y.alias("y"), F.hypot(x, y).alias("r"), F.pmod(F.atan2(x, y), F.lit(TURN)).alias("t"))

    def joined(s: Column) -> Column:
        raw, kept, valid = F.size(F.filter(s["cells"], lambda p: p["v"] == 2)), F.size(s["marks"]), F.size(F.filter(s["cells"], lambda p: p["v"] > 0))
        status = F.when(kept > 0, "ok").when(raw > 0, "filtered_empty").otherwise("no_defect")
        points = F.transform(s["marks"], lambda p: placed(p, s["circle"]))
        own = [f.strip("`") for f in ("centroid_xy_r", "centroid_radius_r", "radial_zone", "clock_sector", "mean_radius_r", "std_radius_r", "defect_extent_r", "radial_span_r", "radial_density", "angular_probability", "resultant_length", "angle_entropy_bits", "anisotropy_min_over_max")]
        measured = let(points, lambda p: F.when(F.size(p) > 0, _measured(p)).otherwise(unmarked))
        return let(
            measured,
            lambda m: F.struct(
                status.alias("status"), valid.alias("valid_count"), raw.alias("raw_defect_count"), kept.alias("defect_count"), (raw - kept).alias("filtered_points_removed"),
                (kept / F.greatest(valid, F.lit(1))).alias("defect_ratio"), F.array(s["circle"]["cx"], s["circle"]["cy"]).alias("wafer_center_xy"), s["circle"]["radius"].alias("wafer_radius"),
                *(m[f].alias(f) for f in own),
            ),
        )

    marks = kept_marks(matrix) if apply_filter else F.filter(cells(matrix), lambda p: p["v"] == 2)
    whole = F.struct(cells(matrix).alias("cells"), marks.alias("marks"), fit_circle(matrix).alias("circle"))
    return F.when(matrix.isNotNull(), let(whole, joined))


def resize_nearest(matrix: Column, height: int, width: int) -> Column:
    """The matrix at another size; each new cell takes the old cell at its centre."""
    spot = lambda i, old, new: F.floor((i + 0.5) * old / new).cast("int")
    row = lambda old: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.get(old, spot(j, F.size(old), width)))
    return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: row(F.get(matrix, spot(i, F.size(matrix), height))))


def quarter_turn(matrix: Column) -> Column:
    """A quarter turn against the clock: the last column becomes the first row."""
    wide = F.coalesce(F.array_max(F.transform(matrix, lambda row: F.size(row))), F.lit(0))
    columns = F.when(wide > 0, F.sequence(F.lit(1), wide)).otherwise(F.array().cast("array<int>"))
    return F.transform(columns, lambda k: F.transform(matrix, lambda row: F.get(row, wide - k)))


def painted(matrix: Column, palette: list[int]) -> Column:
    """Cells as colours, red, green and blue packed into one integer."""
    colours = F.array(*map(F.lit, palette))
    return F.transform(matrix, lambda row: F.transform(row, lambda v: F.get(colours, v)))


GREEN, RED = 0x00B41E, 0xFF5050  # fixed values: what clearly green and clearly red pixels become


def recolour(image: Column) -> Column:
    """Pixels in which green or red outweighs both other channels get the second palette's green or red."""

    def pixel(p: Column) -> Column:
        r, g, b = F.shiftright(p, 16).bitwiseAND(F.lit(255)), F.shiftright(p, 8).bitwiseAND(F.lit(255)), p.bitwiseAND(F.lit(255))
        return F.when((g > r) & (g > b), GREEN).when((r > g) & (r > b), RED).otherwise(p)

    return F.transform(image, lambda row: F.transform(row, pixel))
