"""Scalar rules for labels, clock positions, zones, model answers and log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: label vocabulary, and a name that is no spelling of it
LABELS = ["Center", "Donut", "Edge_Loc", "Edge_Ring", "Loc", "Near_full", "Random", "Scratch", "none"]
OTHER_NAMES = {"normal": "none"}
UNLABELLED = ["", "nan", "unknown", "[]"]
# fixed values: zone limits and numerals
CENTER_LIMIT, MIDDLE_LIMIT = 0.35, 0.72
NUMERALS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def lookup(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def normalize_label(x: Column, labels: list[str] = LABELS, others: dict[str, str] = OTHER_NAMES, keep_unknown: bool = False) -> Column:
    """Any spelling of a label (case, brackets, words joined by space, hyphen, underscore or nothing) as the vocabulary has it.

    Unlabelled text is null. Unknown text is null too, or with ``keep_unknown`` itself, with underscores for hyphens.
    """
    text = F.regexp_replace(F.regexp_replace(x, r"[\[\]'\"]", ""), r"^\s+|\s+$", "")
    plain = F.regexp_replace(F.lower(text), r"[\s_-]+", "")
    known = F.try_element_at(lookup({v.lower().replace("_", "").replace("-", ""): v for v in labels} | {k: v for k, v in others.items() if v in labels}), plain)
    rest = F.regexp_replace(text, "-", "_") if keep_unknown else F.lit(None)
    return F.when(plain.isin([v for v in UNLABELLED if v not in {w.lower() for w in labels}]), F.lit(None)).otherwise(F.coalesce(known, rest))


def predicted_label(x: Column, labels: list[str] = LABELS) -> Column:
    """The label that an answer names, INVALID for anything else."""
    return F.coalesce(normalize_label(x, labels), F.lit("INVALID"))


def six_digits(p: Column) -> Column:
    """A small number with six significant digits as text, so that 2.8e-26 does not become 0."""
    return F.format_string("%.5e", p)


def version_key(x: Column) -> Column:
    """A text that sorts as versions do: every run of digits padded to 18 places."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 18, "0")).otherwise(p)), "")


def table_cells(line: Column) -> Column:
    """The cells of a Markdown table row, trimmed."""
    bare = F.regexp_replace(trim_all(line), r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"\|"), trim_all)


def run_key(header: Column) -> Column:
    """Algorithm, group size and learning rate that a column header names, however it is punctuated; null for other headers."""
    pattern = r"^([A-Za-z]+)\s*\(\s*G=(\d+)\s*[,)]?\s*lr\s*([0-9.eE+-]+)\s*\)?$"
    part = lambda i: F.regexp_extract(trim_all(header), pattern, i)
    return F.when(part(1) != "", F.concat_ws("|", part(1), part(2).cast("int").cast("string"), part(3)))


def circular_distance(a: Column, b: Column, n: int = 12) -> Column:
    return F.least(F.pmod(a - b, F.lit(n)), F.pmod(b - a, F.lit(n)))


def clock_close(a: Column, b: Column) -> Column:
    """Within one step, null-safe: two missing clocks are close, one missing is not."""
    return F.when(a.isNull() | b.isNull(), a.eqNullSafe(b)).otherwise(circular_distance(a, b) <= 1)


def rotate_clock(c: Column, turns: Column) -> Column:
    """The clock position after ``turns`` quarter turns against the clock; null stays null."""
    return F.pmod(c - 1 - 3 * turns, F.lit(12)) + 1


def zone_of(r: Column) -> Column:
    return F.when(r < CENTER_LIMIT, "center").when(r < MIDDLE_LIMIT, "middle").when(r.isNotNull(), "edge")


def graded_relevance(same_class: Column, same_zone: Column, close: Column) -> Column:
    return F.when(~same_class, 0).when(same_zone & close, 2).otherwise(1)


def make_id(a: Column, b: Column) -> Column:
    """First digits of ``a`` padded to 8, and ``b`` padded to 3; longer numbers are kept whole."""
    pad = lambda x, n: F.when(F.length(x) >= n, x).otherwise(F.lpad(x, n, "0"))
    return F.concat(pad(F.regexp_extract(a, r"(\d+)", 1), 8), F.lit("_"), pad(b.cast("string"), 3))


def strip_thinking(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?is)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def parse_label(x: Column, labels: list[str]) -> Column:
    """The last line if it is a label, else the first label (in vocabulary order) that it holds as a word, else anywhere."""
    lines = F.filter(F.split(x, "\n"), lambda s: trim_all(s) != "")
    last = trim_all(F.try_element_at(lines, F.lit(-1)))
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(last), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    first = lambda test: F.coalesce(*(F.when(test(v), v) for v in labels))
    return F.coalesce(first(lambda v: last == v), first(lambda v: words.contains(f" {v.lower()} ")), first(lambda v: F.lower(x).contains(v.lower())))


def coerce_number(x: Column) -> Column:
    """Text as a number where it looks like one, else null."""
    return F.when(x.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), x.try_cast("double"))


def numeral(x: Column) -> Column:
    """Digits, or Chinese numerals of 1 to 99."""
    unit = lambda c: F.coalesce(F.try_element_at(lookup(NUMERALS), c), F.lit(0))
    tens = F.substring_index(x, "十", 1)
    ones = F.substring_index(x, "十", -1)
    ten = F.when(tens == "", 1).otherwise(unit(tens)) * 10 + unit(ones)
    return F.coalesce(x.try_cast("int"), F.when(x.contains("十"), ten).otherwise(F.try_element_at(lookup(NUMERALS), x)))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def renderings(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every way a number may be written: ``key``, ``form`` (rounded, truncated, mantissa), ``d`` (1 to 6 decimals) and ``s``.

    Rounding is that of the exact binary value, half to even, which no built-in expression has; truncation is that of the
    twelve-decimal form. Numbers under 0.01 have the mantissa of their seven-digit form too. Null and non-finite values have none.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import math

        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], []]
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v is None or not math.isfinite(v):
                    continue
                long_form = f"{v:.12f}"
                cut = long_form.index(".") + 1
                forms = [("rounded", d, f"{v:.{d}f}") for d in range(1, 7)] + [("truncated", d, long_form[: cut + d]) for d in range(1, 7)]
                if v and abs(v) < 1e-2:
                    mantissa = float(f"{v:.6e}".split("e")[0])
                    forms += [("mantissa", d, f"{mantissa:.{d}f}") for d in range(1, 7)]
                for form, d, s in forms:
                    for x, y in zip(out, (k, form, d, s), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], [key, "form", "d", "s"])

    return df.select(key, F.col(value).cast("double").alias(value)).mapInArrow(run, f"{key} {kind}, form string, d int, s string")


def decimal_tokens(text: Column) -> Column:
    """Signed decimals of 3 to 6 fraction digits, line by line, citations (arXiv numbers, dotted versions) removed."""
    lines = F.split(text, r"\R|[\x1c-\x1e]")
    clean = lambda line: F.regexp_replace(line, r"(?iU)arxiv[:\s]*\S+|\b\d+\.\d+\.\d+\b", " ")
    return F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(clean(line), F.lit(r"(?U)(?<![.\d])-?\d+\.\d{3,6}"), F.lit(0))))
