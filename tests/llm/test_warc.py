import hashlib

from pyspark.sql import functions as F

from grainmill.llm import warc
from grainmill.llm.shared import materialize

SCHEMA = "page_id long, url string, html string, volume string"


def pages(spark, n=100, parts=3):
    rows = [(i, f"http://a/{i}", f"<p>é{i}</p>\r\n\r\nx" * (i % 4)) for i in range(n)] + [(None, None, None), (7, "http://a/7", ""), (7, "http://a/7", ""), (8, "u", "long " * 50_000)]
    return spark.createDataFrame([(*r, "v") for r in rows], SCHEMA).repartition(parts)


def test_round_trip(spark):
    src = materialize(pages(spark), "pages")
    back = warc.parse_records(materialize(warc.write_records(src), "records"))
    key = lambda r: repr((r["page_id"], r["url"], r["html"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, src.collect()))
    assert all(r["intact"] for r in back.collect())


def test_offsets_and_hashes_follow_the_bytes(spark):
    records = materialize(warc.write_records(materialize(pages(spark), "pages")), "records")
    at = {}
    bytes_ = {(r["volume"], r["seq"]): bytes(r["record"]) for r in records.collect()}
    for r in sorted(warc.leaves(records).collect(), key=lambda r: (r["volume"], r["seq"])):
        own = bytes_[r["volume"], r["seq"]]
        assert r["offset"] == at.get(r["volume"], 0) and r["length"] == len(own) and r["sha256"] == hashlib.sha256(own).hexdigest()
        at[r["volume"]] = r["offset"] + r["length"]


def states(spark, records, replica, fanout=4):
    found, report = warc.audit(materialize(warc.leaves(records), "a"), materialize(warc.leaves(replica), "b"), fanout)
    return {(r["volume"], r["node"]): r["state"] for r in found.collect()}, report


def test_audit_descends_to_the_damage_only(spark):
    records = materialize(warc.write_records(materialize(pages(spark, 300, 2), "pages")), "records")
    same, report = states(spark, records, records)
    assert same == {} and report["compared"] == [] and report["roots"][0] == report["roots"][1]
    bad = (F.col("volume") == 1) & (F.col("seq") == 21)
    damaged = records.withColumn("record", F.when(bad, F.concat(F.substr("record", F.lit(1), F.octet_length("record") - 1), F.lit(b"!"))).otherwise(F.col("record")))
    got, report = states(spark, records, damaged)
    assert got == {(1, 21): "changed"}
    assert max(report["compared"]) <= 4 and len(report["compared"]) >= 5


def test_lost_and_added_records(spark):
    records = materialize(warc.write_records(materialize(pages(spark, 60, 1), "pages")), "records")
    last = records.agg(F.max("seq")).first()[0]
    shorter = records.where(F.col("seq") < last - 2)
    assert set(states(spark, records, shorter)[0].values()) == {"lost"} and len(states(spark, records, shorter)[0]) == 3
    assert set(states(spark, shorter, records)[0].values()) == {"added"}
    empty = records.limit(0)
    assert states(spark, empty, empty)[0] == {}
    assert len(states(spark, records, empty)[0]) == last + 1
