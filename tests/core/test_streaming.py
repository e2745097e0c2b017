from pyspark.sql import functions as F

from grainmill.streaming import resume as R


def test_resume_retries_errors_only(spark, tmp_path):
    src, log = f"{tmp_path}/in", f"{tmp_path}/log"
    schema = "id long, status string"

    def work(ok):
        return lambda df: df.select("id", F.when((F.col("id") % 2 == 0) | F.lit(ok), "ok").otherwise("error").alias("status"))

    spark.range(6).coalesce(1).write.parquet(src)
    for k, ok in enumerate((False, True)):
        q = R.resume(R.stream_of(spark, src, "id long"), log, work(ok), f"{tmp_path}/c{k}", schema)
        q.awaitTermination(120)
        assert q.exception() is None
    rows = [(r["id"], r["status"]) for r in spark.read.schema(schema).json(log).collect()]
    assert sorted(rows) == [(0, "ok"), (1, "error"), (1, "ok"), (2, "ok"), (3, "error"), (3, "ok"), (4, "ok"), (5, "error"), (5, "ok")]


def test_a_batch_that_runs_again_adds_no_row_twice(spark, tmp_path):
    src, log, checkpoint = f"{tmp_path}/in", f"{tmp_path}/log", tmp_path / "c"
    spark.range(6).coalesce(1).write.parquet(src)
    work = lambda df: df.select("id", F.when(F.col("id") % 2 == 0, "ok").otherwise("error").alias("status"))
    for _ in range(2):
        R.resume(R.stream_of(spark, src, "id long"), log, work, str(checkpoint), "id long, status string").awaitTermination(120)
        for f in (checkpoint / "commits").iterdir():  # as if it had failed before it was committed
            f.unlink()
    rows = [(r["id"], r["status"]) for r in spark.read.schema("id long, status string").json(log).collect()]
    assert sorted(rows) == [(i, "error" if i % 2 else "ok") for i in range(6)]


def test_budget_state_spans_batches(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "user_id long, event_id long, value double, failed boolean"
    rows = [(1, 1, 60.0, False), (1, 2, 60.0, False), (1, 3, 1.0, False), (2, 4, 1.0, True), (2, 5, 1.0, False)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(src)
    q = R.budget_stop(R.stream_of(spark, src, schema, 5), 100.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 4]


def test_windows_run_as_batch_too(spark):
    e = spark.sql("SELECT timestamp'2024-01-01 01:00' + make_interval(0,0,0,0,i) AS ts, 'a' AS event_type, 1.0D AS value, 7L AS user_id FROM (SELECT explode(sequence(0, 29)) i)")
    assert sorted(r["n"] for r in R.windowed_counts(e).collect()) == [7, 23]
    assert [r["n"] for r in R.sessions(e).collect()] == [30]
