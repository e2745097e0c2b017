"""Line deduplication through deletion neighbourhoods, in DataFrame functions only.

A line is read as its lower-cased words. Two lines match if they have the same words or, both having at least ``min_words``
words, if one edit of one word (substitution, insertion or deletion) turns one into the other. A line is removed if an earlier
line of the corpus matches it; earlier means: smaller document id (null last), then row, then line number. Lines without words
stay. As matching goes to any earlier line, removed or not, the result does not depend on the order of evaluation.

1. Lines become 128-bit hashes with outer keys. Equal lines are aggregated to one with its earliest place (map-side first, so a
   line in a third of all documents costs one row a task).
2. An outer key leaves out one of four stretches of a line and hashes the words before and behind it. One edit lies in one
   stretch, so two lines that it parts share the outer key of that stretch; only lines that share one go on.
3. For the stretches that they share, their deletion variants become hashed keys: with the hole kept in place
   (substitutions) and closed (insertion, deletion).
4. Per key the earliest place is aggregated, and lines are joined with that alone: each line meets one partner a key, never
   all members of it. The partner's words are then compared for a real distance of one.
5. Removed line numbers are gathered per document and filtered out of its text. Lines in more than a thousandth of all places
   (fewer than a thousand such lines can be) are salted for this, so no task gets all copies of one.

Cases: null text stays null, empty text stays empty; repeated rows are separate documents (the later one loses its lines);
null document ids come last; an empty table gives no rows; very long lines cost little more than their length; further columns
are kept whatever their names, but columns named ``n_lines`` or ``n_removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm.shared import discard, fresh, hot_keys, join_counted, join_salted, materialize

SPACE = r"[ \t\r\f\x0B]+"
STRETCHES = 4
BLOCK = 128
MASKS = 1 << 20


def normal(low: Column) -> Column:
    """A lower-cased text with single spaces between the words of its lines. Most texts are in that form already."""
    odd = low.startswith(" ") | low.endswith(" ")
    for c in ("  ", " \n", "\n ", "\t", "\r", "\f", "\x0b"):
        odd = odd | low.contains(c)
    single = F.regexp_replace(low, SPACE, " ")
    return F.when(odd, F.regexp_replace(single, "(?md)^ | $", "")).otherwise(low)


def place(*names: str) -> Column:
    """Sorts by document id (null last), row and line."""
    doc, row, line = names
    return F.struct(F.col(doc).isNull().alias("no_id"), F.col(doc).alias("doc_id"), F.col(row).alias("row_id"), F.col(line).alias("line_no"))


def stretch(length: Column, c: int) -> tuple[Column, Column]:
    """Words before and behind stretch ``c`` of a line compared at ``length`` words."""
    return F.floor(length * c / STRETCHES).cast("int"), (length - F.floor(length * (c + 1) / STRETCHES)).cast("int")


def outer_keys(norm: Column, n: Column) -> Column:
    """The outer keys of a line, first as it is, then as the longer of two lines that an insertion parts."""
    keys = []
    for length in (n, n - 1):
        for c in range(STRETCHES):
            before, behind = stretch(length, c)
            head, tail = (F.call_function("substring_index", norm, F.lit(" "), x) for x in (before, -behind))
            keys.append(F.xxhash64(F.lit(c), length, head, tail))
    return F.array(*keys)


def line_rows(docs: DataFrame) -> DataFrame:
    """The lines with words: place, normal form and number of words."""
    low = docs.where(F.col("text").isNotNull()).select("row_id", F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("low"))
    # whole texts are normalised before they are split, so nothing is computed twice for a line
    lines = low.select("row_id", "doc_id", F.posexplode_outer(F.split(normal(F.col("low")), "\n")).alias("line_no", "norm"))
    return lines.where("norm <> ''").withColumn("n", F.length("norm") - F.length(F.replace("norm", F.lit(" "))) + 1)


def line_hashes(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h1", F.xxhash64("norm")).withColumn("h2", F.xxhash64(F.lit("second"), "norm"))


def running_xor(values: Column) -> Column:
    """The XOR of the first 0, 1, ... n values, in blocks, so that no long array is copied at every step."""
    zero = F.lit(0).cast("long")
    grow = lambda acc, v: F.array_append(acc, F.element_at(acc, -1).bitwiseXOR(v))
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    cut = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<bigint>>"))

    def join(blocks: Column) -> Column:
        starts = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda x, v: x.bitwiseXOR(v))), F.array(zero), grow)
        whole = F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.get(starts, i)), grow), F.lit(2), F.lit(BLOCK)))
        return F.concat(F.array(zero), F.flatten(whole))

    return F.transform(F.array(cut), join)[0]


def variant_keys(words: Column, n: Column, shared: Column) -> Column:
    """The deletion variants of a line as (key, role): with the hole in place (2), closed (1), and the whole line itself (0).

    ``shared`` says for which stretches: (long, c, twins, longer), where ``long`` marks the keys of the line as the longer one,
    ``twins`` that another line of its length shares the key, and ``longer`` that a longer line does. A variant is the XOR of the
    hashes of its words with their positions, so each costs one step.
    """
    # all prefixes of the words in place, and all of the words moved one to the left
    here = F.transform(words, lambda w, i: F.xxhash64(w, i))
    back = F.transform(words, lambda w, i: F.xxhash64(w, i - 1))
    sums = F.struct(here.alias("here"), running_xor(here).alias("before"), running_xor(back).alias("moved"))
    item = lambda key, role: F.struct(key.alias("key"), F.lit(role).alias("role"))

    def span(x: Column) -> Column:
        length = n - x["long"].cast("int")
        first = F.floor(length * x["c"] / STRETCHES).cast("int")
        size = n - (length - F.floor(length * (x["c"] + 1) / STRETCHES)).cast("int") - first
        return F.when(size > 0, F.sequence(first, first + size - 1)).otherwise(F.array().cast("array<int>"))

    def keys(s: Column) -> Column:
        total, moved = F.element_at(s["before"], -1), F.element_at(s["moved"], -1)
        holes = F.flatten(F.transform(F.filter(shared, lambda x: ~x["long"] & x["twins"]), span))
        gaps = F.array_distinct(F.flatten(F.transform(F.filter(shared, lambda x: x["long"]), span)))
        hole = F.transform(holes, lambda i: item(F.xxhash64(F.lit("hole"), n, i, total.bitwiseXOR(F.get(s["here"], i))), 2))
        closed = F.transform(gaps, lambda i: item(F.xxhash64(F.lit("closed"), n - 1, F.get(s["before"], i).bitwiseXOR(moved).bitwiseXOR(F.get(s["moved"], i + 1))), 1))
        whole = F.when(F.exists(shared, lambda x: ~x["long"] & x["longer"]), F.array(item(F.xxhash64(F.lit("closed"), n, total), 0))).otherwise(F.array().cast("array<struct<key:bigint,role:int>>"))
        return F.concat(hole, closed, whole)

    # a lambda variable is computed once, however often it is named
    return F.transform(F.array(sums), keys)[0]


def one_edit(a: Column, b: Column) -> Column:
    """Whether the word arrays differ by exactly one edit of one word (or not at all)."""
    long = F.when(F.size(a) >= F.size(b), a).otherwise(b)
    short = F.when(F.size(a) >= F.size(b), b).otherwise(a)
    m = F.size(short)
    differ = F.zip_with(short, F.slice(long, F.lit(1), F.greatest(m, F.lit(1))), lambda x, y: ~F.equal_null(x, y))
    first = F.coalesce(F.array_position(differ, True), F.lit(0)).cast("int")
    p = F.when(first > 0, first - 1).otherwise(m)
    same = F.size(F.filter(differ, lambda t: t)) <= 1
    moved = F.equal_null(F.slice(long, p + 2, F.greatest(m - p, F.lit(0))), F.slice(short, p + 1, F.greatest(m - p, F.lit(0))))
    return F.when(F.size(a) == F.size(b), same).when(F.size(long) - m == 1, moved).otherwise(False)


def shared_stretches(live: DataFrame) -> DataFrame:
    """tag (h1 without its last three bits) of the lines that share an outer key with a line that they can match, and what they share."""
    # the place among the keys takes the last three bits of h1; lines with one tag are taken together, which only adds lines
    rows = live.select(F.posexplode("outer").alias("at", "key"), "h1").select("key", F.shiftright("h1", 3).alias("tag"), "at")
    rows = rows.select("key", F.shiftleft("tag", 3).bitwiseOR(F.col("at").cast("long")).alias("id"))
    at = F.col("id").bitwiseAND(7).cast("int")
    # two lines as the longer one each say nothing; their keys are compared in the other role as well
    both = rows.groupBy("key").agg(F.sum(F.when(at < STRETCHES, F.lit(1)).otherwise(F.lit(1 << 32))).alias("n"))
    short, long = F.col("n").bitwiseAND((1 << 32) - 1), F.shiftright("n", 32)
    used = both.where((short > 1) | ((short == 1) & (long > 0))).select("key", (short > 1).alias("twins"), (long > 0).alias("longer"), (short + long).alias("c"))
    used = materialize(used, "outer_keys")
    hot = hot_keys(used, ["key"], "c", used.agg(F.sum("c")).first()[0] or 0)
    met = join_salted(rows, used.drop("c"), ["key"], hot, F.col("id"))
    said = F.struct((at >= STRETCHES).alias("long"), (at % STRETCHES).alias("c"), "twins", "longer")
    return met.groupBy(F.shiftright("id", 3).alias("tag")).agg(F.collect_set(said).alias("shared"))


def of_rows(docs: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """``docs`` less the rows that can be told from those ``wanted`` before the shuffle: a mask of 64 bits for 64 row numbers.

    The masks are broadcast if they are ``MASKS`` at most; beyond that every row is left to the join that follows.
    """
    masks = row_masks(wanted)
    if masks.count() > MASKS:
        return docs
    hit = fresh(docs, "hit")
    return in_masks(docs, row, masks, hit).where(hit).drop(hit)


def row_masks(wanted: DataFrame) -> DataFrame:
    number = F.col(wanted.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))
    return materialize(wanted.groupBy(F.shiftright(number, 6).alias("rows")).agg(F.bit_or(bit).alias("mask")), "masks")


def in_masks(docs: DataFrame, row: str, masks: DataFrame, hit: str) -> DataFrame:
    """``docs`` with a column ``hit``, whether the row number is in the masks."""
    rows, mask = fresh(docs, "rows"), fresh(docs, "mask")
    marked = docs.withColumn(rows, F.shiftright(row, 6)).join(F.broadcast(masks.toDF(rows, mask)), rows, "left")
    bit = F.call_function("shiftright", F.coalesce(mask, F.lit(0)), F.col(row).bitwiseAND(63).cast("int")).bitwiseAND(1)
    return marked.withColumn(hit, bit == 1).drop(rows, mask)


def candidates(docs: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """seq, h1, h2, words, n and shared of the distinct lines that share all but one stretch with another; seq follows their places."""
    live = distinct.where(F.col("n") >= min_words)
    want = live.withColumn("tag", F.shiftright("h1", 3)).join(shared_stretches(live), "tag").select("h1", "h2", "first", "shared")
    want = materialize(want, "want")
    # the words are read again where each line stands first: one row a document, with the lines wanted of it
    by_row = want.groupBy(F.col("first.row_id").alias("row_id")).agg(F.collect_list(F.struct("first.line_no", "h1", "h2", "first", "shared")).alias("want"))
    low = of_rows(docs, "row_id", want.select("first.row_id")).join(by_row.hint("merge"), "row_id").select("want", F.lower("text").alias("low"))
    lines = low.select("want", F.split(normal(F.col("low")), "\n").alias("lines"))
    said = lambda w: F.struct(*(w[c].alias(c) for c in ("h1", "h2", "first", "shared")), F.get("lines", w["line_no"]).alias("norm"))
    picked = lines.select(F.explode(F.transform("want", said)).alias("w")).select("w.*")
    # ranges are in order and ids grow within and over partitions, so the id is an order that fits in eight bytes
    ordered = picked.repartitionByRange("first").sortWithinPartitions("first").select(F.monotonically_increasing_id().alias("seq"), "h1", "h2", F.split("norm", " ").alias("words"), "shared")
    return materialize(ordered.withColumn("n", F.size("words")), "candidates")


def near_lines(docs: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2) of the distinct lines that an earlier, different line matches with one edit."""
    cand = candidates(docs, distinct, min_words)
    keys = cand.select("seq", F.explode(variant_keys(F.col("words"), F.col("n"), F.col("shared"))).alias("v")).select("seq", "v.key", F.col("v.role").cast("byte").alias("role"))
    # per key the earliest line, of all and of the whole lines; variants that close a hole only match whole lines, and back
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("seq")))
    # variants are cheap to make again, so they are shuffled but never stored
    least = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), of(2).alias("hole"), of(1).alias("closed"), of(0).alias("whole"))
    least = materialize(least.where("c > 1 AND (hole IS NOT NULL OR (closed IS NOT NULL AND whole IS NOT NULL))"), "earliest")
    hot = hot_keys(least, ["key"], "c", least.agg(F.sum("c")).first()[0] or 0)
    partner = F.when(F.col("role") == 2, F.col("hole")).when(F.col("role") == 1, F.col("whole")).otherwise(F.col("closed"))
    met = join_salted(keys, least.drop("c"), ["key"], hot, F.col("seq"))
    pairs = materialize(met.withColumn("partner", partner).where("partner < seq").select("seq", "partner").distinct(), "pairs")
    own = cand.select("seq", "h1", "h2", F.col("words").alias("a"))
    other = cand.select(F.col("seq").alias("partner"), F.col("words").alias("b"))
    near = materialize(join_counted(pairs, other, "partner", F.col("seq")).join(own, "seq").where(one_edit(F.col("a"), F.col("b"))).select("h1", "h2").distinct(), "near")
    discard(cand, least, pairs)
    return near


def removed_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """row_id and the numbers of its removed lines; ``docs`` has row_id, doc_id and text."""
    lines = line_hashes(line_rows(docs))
    hashed = lines.select("h1", "h2", "n", place("doc_id", "row_id", "line_no").alias("at"), F.when(F.col("n") >= min_words, outer_keys(F.col("norm"), F.col("n"))).alias("outer"))
    distinct = materialize(hashed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("outer").alias("outer")), "lines")
    near = near_lines(docs, distinct, min_words)
    # only lines that have something to remove are looked for again
    verdict = distinct.select("h1", "h2", "first", "copies").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("near OR copies > 1").select("h1", "h2", "first", "copies", F.coalesce("near", F.lit(False)).alias("near"))
    verdict = materialize(verdict, "verdicts")
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    discard(distinct, near)
    at = place("doc_id", "row_id", "line_no")
    hot = hot_keys(verdict, ["h1", "h2"], "copies", total)
    found = join_salted(lines.select("h1", "h2", at.alias("at")), verdict.drop("copies"), ["h1", "h2"], hot, F.col("at")).where("near OR at > first")
    found = materialize(found.groupBy(F.col("at.row_id").alias("row_id")).agg(F.collect_list("at.line_no").alias("removed")), "removed")
    discard(verdict)
    return found


def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``docs`` without the lines that an earlier line of the corpus matches, with ``n_lines`` and ``n_removed``."""
    docs = docs.drop("n_lines", "n_removed")
    row, gone = fresh(docs, "row_id"), fresh(docs, "removed")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    removed = removed_lines(numbered.select(F.col(row).alias("row_id"), "doc_id", "text"), min_words)
    # the lists grow with the corpus, so they are never broadcast
    removed = removed.select(F.col("row_id").alias(row), F.col("removed").alias(gone)).hint("merge")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    masks = row_masks(removed.select(row))
    if masks.count() <= MASKS:
        # documents that lose nothing are told before the shuffle and stay where they are
        hit = fresh(numbered.withColumn(gone, F.lit(0)), "hit")
        marked = in_masks(numbered, row, masks, hit)
        same = marked.where(~F.col(hit)).withColumn(gone, F.lit(None).cast("array<int>"))
        out = marked.where(hit).join(removed, row).unionByName(same).drop(hit)
    else:
        out = numbered.join(removed, row, "left")
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(F.col("n_removed") > 0, kept).otherwise(F.col("text"))).drop(row, gone)
