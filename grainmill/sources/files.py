"""Readers and writers of the file kinds that the library exchanges. All paths are Spark paths; writes commit as a job."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

SUMS = "SHA256SUMS"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped and one bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A review sheet: CSV with a header, quotes and line breaks inside fields, blank cells null."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """Nulls become blank cells."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_reports(spark: SparkSession, glob: str, suffix: str) -> DataFrame:
    """One row a report file: its path, its tag (name without suffix) and its JSON text."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(name, f"{suffix}$", "").alias("tag"), F.col("value").alias("json"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def find_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths and sizes of the files below a root that fit a name pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def checksums(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file below a root. A scan skips empty files, so they are taken from the listing that Spark has made for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    plain = F.regexp_replace("path", "^([A-Za-z0-9]+):/+", "$1:/").alias("path")  # file:/a and file:///a are one
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").select(plain)
    found = files.select(plain, F.sha2("content", 256).alias("sha256"))
    return listed.join(found, "path", "left").select("path", F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("sha256"))


def verify(found: DataFrame, recorded: DataFrame, key: str = "path") -> DataFrame:
    """State of every file against a record: ok, changed, missing or extra."""
    j = found.select(key, F.col("sha256").alias("found")).join(recorded.select(key, F.col("sha256").alias("recorded")), key, "full_outer")
    state = F.when(F.col("recorded").isNull(), "extra").when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("recorded"), "ok").otherwise("changed")
    return j.select(key, state.alias("state"))


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path on it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _below(spark: SparkSession, root: str) -> DataFrame:
    """Digests by the path below the root, without the list of digests itself."""
    fs, p = hadoop_path(spark, root)
    top = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    rest = F.expr(f"substring(path, locate({_quoted(top)}, path) + {len(top)})")
    return checksums(spark, root).select(rest.alias("path"), "sha256").where(F.col("path") != SUMS)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def freeze(spark: SparkSession, root: str) -> None:
    """Writes SHA256SUMS into a folder: a line of digest, two blanks and path for every file below it, in order of paths.

    Files are digested by tasks; only the lines meet in one file, which appears under its name once it is whole.
    """
    aside = f"{root.rstrip('/')}/.sums-{uuid.uuid4().hex}"
    lines = _below(spark, root).repartition(1).sortWithinPartitions("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))
    lines.write.text(aside)
    fs, folder = hadoop_path(spark, aside)
    part = next((x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")), None)
    _, target = hadoop_path(spark, f"{root.rstrip('/')}/{SUMS}")
    fs.delete(target, False)
    if part is None:
        fs.create(target).close()
    else:
        fs.rename(part, target)
    fs.delete(folder, True)


def read_sums(spark: SparkSession, root: str) -> DataFrame:
    """path and sha256 of a folder's list; blank lines are skipped."""
    lines = spark.read.text(f"{root.rstrip('/')}/{SUMS}").where("trim(value) <> ''")
    return lines.select(F.expr("substring(value, locate('  ', value) + 2)").alias("path"), F.substring_index("value", "  ", 1).alias("sha256"))


def verify_frozen(spark: SparkSession, root: str) -> DataFrame:
    """path and state (ok, changed, missing, extra) of the files of a frozen folder."""
    return verify(_below(spark, root), read_sums(spark, root))


def flattened(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """The fields of a struct column as columns of their own."""
    fields = df.schema[column].dataType.names
    return df.select(*(c for c in df.columns if c != column), *(F.col(f"{column}.{f}").alias(prefix + f) for f in fields))


def write_ordered(df: DataFrame, path: str, order: list[str], counts: dict[str, Column] | None = None) -> dict:
    """Parquet in the global order of ``order``, range by range, zstd-compressed; returns rows and ``counts``, taken in the writing job."""
    seen = Observation()
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in (counts or {}).items())).write.option("compression", "zstd").mode("overwrite").parquet(path)
    return seen.get


def ordered(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row ``in_order``: whether the files of a table, by name, hold ranges of ``key`` that follow each other."""
    from pyspark.sql import Window

    by_file = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    before = F.lag("hi").over(Window.orderBy("file"))  # one row a file
    return by_file.select((before <= F.col("lo")).alias("fine")).agg(F.coalesce(F.bool_and("fine"), F.lit(True)).alias("in_order"))


def png_size(content) -> tuple:
    """Width and height columns of PNG bytes, null for anything else."""
    ok = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.when(ok, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long"))
    return number(17), number(21)
