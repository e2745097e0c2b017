"""The registered queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm.oracles import ORACLE
from grainmill.session import table


def tokenizer_path() -> str:
    """The vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    from grainmill.llm.ngram_join import components

    return components(table(spark, sf_dir, "documents"), k=4, threshold=85).drop("row_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the ids whose CRC-32 modulo 3 is not 1."""
    from grainmill.llm.language_id import identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(docs, held_out)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    from grainmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("row_id", "ids")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 200-byte strings starting at two places cover."""
    from grainmill.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the benchmark items that it holds."""
    from grainmill.llm.decontamination import with_hits

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = with_hits(docs, table(spark, sf_dir, "benchmark")).drop("text")
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    best = F.array_max(F.transform("hits", lambda h: h["score"]))
    return hits.select("doc_id", (F.size("hits") > 0).alias("contaminated"), items.alias("item_ids"), best.alias("best_score"))


def quality_scores(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The source is the host; as documents carry no path, the language section of a source stands for it."""
    from grainmill.llm.quality import classify

    return classify(docs, labels, F.col("source"), F.col("lang"), columns=columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site posteriors, score and decision of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_scores(docs, table(spark, sf_dir, "labels"), ["doc_id"])


DRILL = 97, 5


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica in which the drill has damaged every page of one residue class."""
    from grainmill.llm import warc
    from grainmill.llm.shared import materialize

    archive = materialize(warc.write_records(table(spark, sf_dir, "pages")), "archive")
    broken = F.pmod("page_id", F.lit(DRILL[0])) == DRILL[1]
    size = F.octet_length("record")
    damaged = F.concat(F.substr("record", F.lit(1), size - 5), F.lit(b"\x00"), F.substr("record", size - 3, F.lit(4)))
    replica = archive.withColumn("record", F.when(F.coalesce(broken, F.lit(False)), damaged).otherwise(F.col("record")))
    first = materialize(warc.leaves(archive), "leaves")
    found, _ = warc.audit(first, materialize(warc.leaves(replica), "leaves"))
    states = found.select("volume", F.col("node").alias("seq"), "state")
    return first.join(states, ["volume", "seq"], "left").select("page_id", "length", "sha256", F.coalesce("state", F.lit("same")).alias("state"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    from grainmill.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by format-preserving pseudonyms.

    The key is ``spark.grainmill.pii.key``. Without it every call draws its own: equal values are linked within the result, and
    nobody can invert it.
    """
    from grainmill.llm.pii import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, spark.conf.get("spark.grainmill.pii.key", None) or secrets.token_hex(32))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier line of the corpus matches within one word edit."""
    from grainmill.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints of 3-word shingles differ in two bits at most."""
    from grainmill.llm.simhash import components

    return components(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents of highest score of every benchmark item."""
    from grainmill.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 16 clusters after three rounds."""
    from grainmill.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
