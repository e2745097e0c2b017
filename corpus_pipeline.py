"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, benchmark decontamination and packing, in this order.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. Stages but the last return the
columns of ``documents``; ``n_chars`` follows the text.

Cases: null, empty and blank texts pass quality by their site's posterior, lose no line, are near duplicates of nothing, hold no
benchmark item and are packed as their end id alone; of repeated rows the first stays (near duplicates), others are told
apart by row, never by ``doc_id``, which may be null; ties go to the smaller ``doc_id``; an empty table stays empty through all stages;
further columns keep their values whatever their names, up to packing, which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm.decontamination import decontaminate
from grainmill.llm.line_dedup import dedup_lines
from grainmill.llm.ngram_join import components
from grainmill.llm.packing import pack
from grainmill.llm.quality import RESULTS
from grainmill.llm.queries import quality_scores, tokenizer_path
from grainmill.llm.shared import fresh, materialize, small_batches
from grainmill.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier rejects go."""
    own = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in RESULTS}
    scored = quality_scores(docs.withColumnsRenamed(own), table(spark, sf_dir, "labels"))
    return scored.where("keep").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; a document that lost all of its lines with words goes too."""
    out = dedup_lines(docs).where("n_removed = 0 OR text RLIKE '[^\\\\s]'")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id, the first row of it if ids repeat."""
    row = fresh(docs, "row_id")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = components(docs, k=5, threshold=80, row=row)
    alone = F.concat(F.lit("row "), F.col("row_id").cast("string"))
    group = F.when(F.col("n_shingles") == 0, alone).otherwise(F.coalesce(F.col("component_id").cast("string"), alone))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    stays = materialize(rows.withColumn("group", group).groupBy("group").agg(F.min_by("row_id", order).alias(row)).select(row), "representatives")
    return docs.join(stays, row, "left_semi").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    with small_batches(spark):  # so it is written here
        return materialize(decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns), "decontaminated")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences of at most 1024 tokens."""
    return pack(docs, tokenizer_path()).drop("row_id", "ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: a trained classifier and a tokenizer have no SQL form; the tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a scale-factor folder; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
