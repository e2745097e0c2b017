"""WARC records of web pages and a Merkle fixity audit of their replicas.

``write_records`` serialises pages as WARC/1.1 response records. The rows of one input split make one volume, in row order, so
writing needs no shuffle; a record carries its volume, sequence number, offset and length. ``parse_records`` reads the payload
back from the bytes alone.

A replica's tree has a leaf per record, the SHA-256 of its bytes, its offset and its length. ``fanout`` neighbouring nodes of a volume, in
offset order, are hashed into their parent together with the byte range that they cover, level by level; the roots of the
volumes, in order, are hashed the same way up to one root. Every level is one grouped aggregation of at most ``fanout`` rows a
group, so no volume or archive is ever gathered in one task.

``audit`` compares two roots and, only where they differ, the children of differing nodes, one equi-join a level, down to the
records: changed bytes, lost records and added records are told apart. Equal branches are never looked at again.

Cases: null url or html are written as empty with a marker header, so they stay distinct from empty strings; a null page_id is
written as such; repeated rows are separate records; very long pages are records like others; an empty archive has no root, and
two empty archives are equal; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm.shared import materialize

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def record_bytes(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """One WARC response record: header block, empty line, payload, two line ends."""
    payload = F.coalesce(html, F.lit("")).cast("binary")
    missing = F.concat_ws(",", F.when(url.isNull(), "url"), F.when(html.isNull(), "html"))
    key = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit(""))).cast("binary"), 256)
    uuid = F.concat_ws("-", *(F.substr(key, F.lit(i), F.lit(n)) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    lines = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Page-ID: "), F.coalesce(page_id.cast("string"), F.lit("null"))),
        F.concat(F.lit("WARC-Missing: "), missing),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(payload, 256)),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines, F.lit(CRLF)).cast("binary"), payload, F.lit(CRLF * 2).cast("binary"))


def write_records(pages: DataFrame) -> DataFrame:
    """page_id, volume, seq and record (bytes) of every page."""
    row = F.monotonically_increasing_id()
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", row.alias("row_id"))
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    return out.select("page_id", F.shiftright("row_id", 33).alias("volume"), F.col("row_id").bitwiseAND((1 << 33) - 1).alias("seq"), record.alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, url, html and whether the payload fits its digest, read from the bytes of ``record`` alone."""
    head = F.substring_index(F.col("record").cast("string"), CRLF * 2, 1)
    value = lambda name: F.regexp_extract("head", f"{name}: ?([^\r\n]*)", 1)
    start = F.octet_length("head") + 5
    payload = F.substr("record", start, F.octet_length("record") - start - 3)
    out = records.select("record", head.alias("head")).select("head", payload.alias("payload"), value("WARC-Missing").alias("missing"))
    return out.select(
        value("WARC-Page-ID").try_cast("long").alias("page_id"),
        F.when(~F.col("missing").contains("url"), value("WARC-Target-URI")).alias("url"),
        F.when(~F.col("missing").contains("html"), F.col("payload").cast("string")).alias("html"),
        (F.sha2("payload", 256) == value("WARC-Payload-Digest: sha256")).alias("intact"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """The leaves of a replica: record hashes with their offsets, which are running sums of the lengths of a volume.

    Offsets are summed in two steps, within runs of 4096 records and over the runs, so that no volume is one window partition.
    """
    run = F.shiftright("seq", 12)
    base = records.select("page_id", "volume", "seq", run.alias("run"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    base = materialize(base, "record_hashes")
    totals = base.groupBy("volume", "run").agg(F.sum("length").alias("size"))
    before = totals.withColumn("start", F.coalesce(F.sum("size").over(Window.partitionBy("volume").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    inside = Window.partitionBy("volume", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("inner", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(before, ["volume", "run"])
    return placed.select("page_id", "volume", "seq", (F.col("start") + F.col("inner")).alias("offset"), "length", "sha256")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    group = F.floor(F.col("node") / fanout).cast("long")
    children = F.array_sort(F.collect_list(F.struct("node", "hash", "first", "last")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"] % fanout, c["hash"], c["first"], c["last"])), ";")
    return nodes.groupBy("volume", group.alias("node")).agg(F.sha2(text.cast("binary"), 256).alias("hash"), F.min("first").alias("first"), F.max("last").alias("last"))


def extent(leaf: DataFrame) -> tuple[int, int]:
    """Largest sequence and volume number, -1 for an empty replica."""
    row = leaf.agg(F.max("seq"), F.max("volume")).first()
    return (-1, -1) if row[0] is None else (row[0], row[1])


def tree(leaf: DataFrame, fanout: int = 16, most: tuple[int, int] | None = None) -> list[DataFrame]:
    """Levels from the leaves to the one root: volume, node, hash, first and last byte. Nodes above volumes have volume -1.

    ``most``: sequence and volume number that the tree must be high enough for, so that trees to compare have equal heights.
    """
    most_seq, most_volume = most or extent(leaf)
    levels = [leaf.select("volume", F.col("seq").alias("node"), F.sha2(F.concat_ws(":", "sha256", "offset", "length").cast("binary"), 256).alias("hash"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"))]
    while most_seq > 0:
        levels.append(materialize(_parents(levels[-1], fanout), "nodes"))
        most_seq //= fanout
    levels.append(levels[-1].select(F.lit(-1).cast("long").alias("volume"), F.col("volume").alias("node"), "hash", "first", "last"))
    while most_volume > 0:
        levels.append(materialize(_parents(levels[-1], fanout), "nodes"))
        most_volume //= fanout
    return levels


def root(levels: list[DataFrame]) -> str | None:
    row = levels[-1].select("hash").first()
    return None if row is None else row[0]


def audit(first: DataFrame, second: DataFrame, fanout: int = 16) -> tuple[DataFrame, dict]:
    """Leaves (volume, node) that differ with their state, and a report: both roots and the nodes compared on every level."""
    most = tuple(map(max, extent(first), extent(second)))
    a, b = tree(first, fanout, most), tree(second, fanout, most)
    report = {"roots": (root(a), root(b)), "compared": []}
    if report["roots"][0] == report["roots"][1]:
        return first.sparkSession.createDataFrame([], "volume long, node long, state string"), report
    wanted = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        x, y = (z.select("volume", "node", "hash") for z in (x, y))
        if wanted is not None:
            x, y = (_children(z, wanted, fanout) for z in (x, y))
        both = x.alias("x").join(y.alias("y"), F.expr("x.volume = y.volume AND x.node = y.node"), "full_outer")
        state = F.when(F.col("x.hash").isNull(), "added").when(F.col("y.hash").isNull(), "lost").when(F.col("x.hash") != F.col("y.hash"), "changed").otherwise("same")
        level = materialize(both.select(F.coalesce("x.volume", "y.volume").alias("volume"), F.coalesce("x.node", "y.node").alias("node"), state.alias("state")), "compared")
        report["compared"].append(level.count())
        wanted = level.where("state <> 'same'")
    return wanted, report


def _children(nodes: DataFrame, wanted: DataFrame, fanout: int) -> DataFrame:
    """Nodes below the wanted ones: of the same volume, or the tops of the volumes that the archive level names."""
    inner = wanted.where("volume >= 0").select(F.col("volume").alias("v"), F.col("node").alias("parent"))
    outer = wanted.where("volume < 0").select(F.col("node").alias("parent"))
    own = nodes.join(inner, (F.col("volume") == F.col("v")) & (F.floor(F.col("node") / fanout) == F.col("parent")), "left_semi")
    return own.unionByName(nodes.where("volume < 0").join(outer, F.floor(F.col("node") / fanout) == F.col("parent"), "left_semi")).unionByName(nodes.where("volume >= 0 AND node = 0").join(outer, F.col("volume") == F.col("parent"), "left_semi"))
