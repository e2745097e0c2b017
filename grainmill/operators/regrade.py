"""One set of answers graded again: against several definitions of the gold, and in two formats of the question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.functions.scalars import safe_div


def regrade(golds: DataFrame, answers: DataFrame, definitions: list[str], accepted: dict[str, str] | None = None, constants: dict[str, str] | None = None) -> DataFrame:
    """Accuracy of every run against every definition, beside what a constant answer would reach.

    ``golds``: id and a column a definition; ``answers``: run, id, answer (null: none, not scored). ``accepted`` names for a definition a
    further column whose value counts as right too; ``constants`` the constant answer of a definition, else its most frequent gold.
    Golds are unpivoted once; answers meet them in one join. Returns run, definition, hits, n, accuracy, floor, beats_floor.
    """
    accepted, constants = accepted or {}, constants or {}
    nothing = F.lit(None).cast("string")
    cells = F.array(*(F.struct(F.lit(d).alias("definition"), F.col(d).alias("gold"), (F.col(accepted[d]) if d in accepted else nothing).alias("also")) for d in definitions))
    long = golds.select("id", F.explode(cells).alias("g")).select("id", "g.*")
    fixed = F.create_map(*(F.lit(x) for kv in (constants or {"": ""}).items() for x in kv))
    counts = long.groupBy("definition", "gold").agg(F.count(F.lit(1)).alias("n"))
    constant = F.try_element_at(fixed, F.col("definition"))
    best = F.when(constant.isNull(), F.max(F.when(F.col("gold").isNotNull(), F.col("n")))).otherwise(F.max(F.when(F.col("gold") == constant, F.col("n"))))
    floors = counts.groupBy("definition").agg(safe_div(F.coalesce(best, F.lit(0)), F.sum("n")).alias("floor"))
    right = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)) | F.coalesce(F.col("answer") == F.col("also"), F.lit(False))
    met = answers.where("answer IS NOT NULL").join(long, "id").groupBy("run", "definition").agg(F.count_if(right).alias("hits"), F.count(F.lit(1)).alias("n"))
    scored = met.join(F.broadcast(floors), "definition").withColumn("accuracy", safe_div(F.col("hits"), F.col("n")))
    return scored.select("run", "definition", "hits", "n", "accuracy", "floor", (F.col("accuracy") > F.col("floor")).alias("beats_floor"))


def in_order(points: Column, value: Callable[[Column], Column]) -> Column:
    """Struct mean and sd (population) of a value of an array's points, added up in the array's order as an aggregate adds up rows.

    Means that lie on the bound of a zone fall to the side that the last bit of the sum says, so the order of addition is part of the
    result and must not follow from partitions.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))

    def add(s: Column, p: Column) -> Column:
        off = value(p) - s["mean"]
        mean = s["mean"] + off / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), (s["sum"] + value(p)).alias("sum"), mean.alias("mean"), (s["square"] + off * (value(p) - mean)).alias("square"))

    return F.aggregate(points, start, add, lambda s: F.struct(F.try_divide(s["sum"], s["n"]).alias("mean"), F.sqrt(F.try_divide(s["square"], s["n"])).alias("sd")))


def chat_requests(rows: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Requests rebuilt from chat rows: the messages up to the last user turn in order, and the answer that follows it.

    The inverse of exploding requests into rows. A conversation without a user turn has no request; one that ends with the user has a
    null answer; rows of an equal turn follow in order of role and text.
    """
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("all"))  # a conversation is one row
    last = F.array_max(F.transform("all", lambda m, i: F.when(m["role"] == "user", i)))
    cut = whole.withColumn("asked", last).where("asked IS NOT NULL")
    plain = F.transform(F.slice("all", F.lit(1), F.col("asked") + 1), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    behind = F.filter("all", lambda m, i: (i > F.col("asked")) & (m["role"] == "assistant"))
    return cut.select(key, plain.alias("messages"), F.get(behind, F.lit(0))["content"].alias("answer"))


def exploded(requests: DataFrame, key: str) -> DataFrame:
    """Chat rows of requests: key, turn, role, text."""
    return requests.select(key, F.posexplode("messages").alias("turn", "m")).select(key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def label_requests(core: DataFrame, key: str, image: str, system: str, prompt: str) -> DataFrame:
    """One classification request a sample, in the form of the training data."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    return core.select(key, F.lit("classification").alias("task"), F.array(said("system", system), said("user", f"<image>\n{prompt}")).alias("messages"), F.array(image).alias("images"))


def format_gap(gold: DataFrame, formats: dict[str, tuple[DataFrame, Callable[[Column], Column]]], by: str = "gold") -> DataFrame:
    """Accuracy by class in each of two formats and their difference.

    ``gold``: id and ``by``; ``formats``: name to answers (id, answer) and the rule that reads a label from an answer. An answer that is
    not there, or names no label, is wrong. All formats are scored in one aggregation.
    """
    rows = gold
    for name, (answers, read) in formats.items():
        rows = rows.join(answers.select("id", read(F.col("answer")).alias(f"read_{name}")), "id", "left")
    right = lambda name: F.avg(F.coalesce(F.col(f"read_{name}") == F.col(by), F.lit(False)).cast("double"))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(right(name).alias(name) for name in formats))
    a, b = formats
    return out.withColumn("gap", F.col(b) - F.col(a))
