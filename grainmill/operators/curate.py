"""Validation, arbitration and rewards of structured annotations as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def validate(rules: list[tuple[str | Column, Column, int | Column, bool]], passing: int = 60) -> tuple[Column, Column, Column]:
    """Score, issues and verdict from penalty rules (name, broken?, penalty, hard?). A null test is not broken; a name may be a column.

    The score starts at 100 and stays in 0..100; an annotation passes from ``passing`` on unless a hard rule is broken.
    """
    broken = [(name, F.coalesce(test, F.lit(False)), points, hard) for name, test, points, hard in rules]
    lost = sum((F.when(t, points).otherwise(0) for _, t, points, _ in broken), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost))
    issues = F.array_compact(F.array(*(F.when(t, F.lit(name) if isinstance(name, str) else name) for name, t, _, _ in broken)))
    hard = F.lit(False)
    for _, t, _, h in broken:
        if h:
            hard = hard | t
    return score, issues, (score >= passing) & ~hard


def validate_result(present: Column, is_object: Column, rules: list[tuple[str | Column, Column, int | Column, bool]], passing: int = 60) -> tuple[Column, Column, Column]:
    """:func:`validate` for an annotation that may be missing, or whose result may be no object: both score 0 and never pass."""
    score, issues, passed = validate(rules, passing)
    lost = F.when(~present, "missing_annotation").when(~is_object, "invalid_result")
    return F.when(lost.isNotNull(), 0).otherwise(score), F.when(lost.isNotNull(), F.array(lost)).otherwise(issues), lost.isNull() & passed


# fixed values: what an annotation must hold, its zones, shapes by class and words that guess at causes
REQUIRED_FIELDS = ["caption_en", "caption_zh", "clock_direction", "continuity", "defect_type", "density", "radial_zone", "shape", "size_r", "uncertain"]
ZONES = ["center", "middle", "edge", "full", "none"]


def annotation_rules(
    fields: Column, gold: Column, predicted: Column, zone: Column, measured_zone: Column, shape: Column, clock: Column, measured_clock: Column, size: Column, captions: Column, uncertain: Column,
    shapes: dict[str, list[str]], causes: list[str], full: str = "Near_full", nothing: str = "none",
) -> list[tuple[str | Column, Column, int | Column, bool]]:
    """The rules of a present annotation, for :func:`validate`. ``fields``: names of the fields that it has.

    Issues carry what they are about: the fields that are missing, and what was said against what was measured.
    """
    absent = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED_FIELDS)), fields))
    gone = F.size(absent)
    told = lambda name, *parts: F.concat(F.lit(f"{name}:"), *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    unlike = F.lit("!=")
    wanted = F.when(gold == nothing, "none").otherwise(measured_zone)
    known = F.coalesce(zone.isin(ZONES), F.lit(False))
    right = (zone == wanted) | ((gold == full) & (zone == "full"))
    fits = F.lit(False)
    for label, some in shapes.items():
        fits = fits | ((gold == label) & F.coalesce(shape.isin(some), F.lit(False)))
    asked = measured_clock.isNotNull() & clock.isNotNull() & ~clock.isin("all", "none")
    hour, radius = clock.try_cast("int"), size.try_cast("double")
    away = F.least(F.pmod(hour - measured_clock, F.lit(12)), F.pmod(measured_clock - hour, F.lit(12)))
    cause = F.lit(False)
    for word in causes:
        cause = cause | F.lower(captions).contains(word.lower())
    return [
        (told("missing_fields", F.array_join(absent, ",")), gone > 0, F.least(F.lit(40), 5 * gone), True),
        (told("type_mismatch", predicted, unlike, gold), ~predicted.eqNullSafe(gold), 50, True),
        ("invalid_radial_zone", ~known, 20, False),
        (told("radial_mismatch", zone, unlike, wanted), known & wanted.isNotNull() & ~right, 15, False),
        (told("shape_suspicious", shape), ~fits, 15, False),
        (told("clock_mismatch", clock, unlike, measured_clock), asked & (away > 1), 15, False),
        ("invalid_clock", asked & hour.isNull(), 15, False),
        ("invalid_size_r", size.isNotNull() & ~F.coalesce(radius.between(0, 2.5), F.lit(False)), 15, False),
        ("empty_caption", F.coalesce(F.trim(captions), F.lit("")) == "", 35, False),
        ("root_cause_hallucination", cause, 25, False),
        ("teacher_uncertain", F.coalesce(uncertain, F.lit(False)), 20, False),
    ]


def disagreement(fields: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields in which two annotations differ, null-safe."""
    return F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(name)) for name, (a, b) in fields.items())))


def arbitrate(fields: dict[str, tuple[Column, Column, Column]]) -> Column:
    """'first' or 'second' if the measured value supports that side in every disputed field, else null."""
    disputed = F.lit(False)
    first = second = F.lit(True)
    for a, b, measured in fields.values():
        differ = ~a.eqNullSafe(b)
        disputed = disputed | differ
        first = first & (~differ | a.eqNullSafe(measured))
        second = second & (~differ | b.eqNullSafe(measured))
    return F.when(disputed & first, "first").when(disputed & second, "second")


def reward_class(answer: Column, gold: Column) -> Column:
    return F.coalesce((F.regexp_replace(answer, r"^\s+|\s+$", "") == gold).cast("double"), F.lit(0.0))


def reward_format(keys: Column, wanted: list[str]) -> Column:
    """Share of the wanted keys that are there; 0 if there is no object."""
    return F.coalesce(F.size(F.array_intersect(keys, F.array(*map(F.lit, wanted)))) / float(len(wanted)), F.lit(0.0))


def reward_field(answer: Column, gold: Column) -> Column:
    """1 without a gold value, else an exact match."""
    return F.when(gold.isNull(), 1.0).otherwise(F.coalesce((answer == gold).cast("double"), F.lit(0.0)))


def reward_clock(answer: Column, gold: Column, n: int = 12) -> Column:
    """1 without a gold position, else within one step."""
    d = F.least(F.pmod(answer - gold, F.lit(n)), F.pmod(gold - answer, F.lit(n)))
    return F.when(gold.isNull(), 1.0).otherwise(F.coalesce((d <= 1).cast("double"), F.lit(0.0)))


def finished(runs: DataFrame) -> DataFrame:
    """Runs that completed and logged every step that was asked for."""
    return runs.where((F.col("outcome") == "completed") & (F.col("steps_logged") == F.col("max_steps")))
