import pytest
from pyspark.sql import functions as F

from lodestone.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), df


def drained(spark, stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_quota_equals_its_batch_twin(spark, events, tmp_path):
    stream, batch = events
    got = drained(spark, jobs.daily_counts(stream, "user_id", 3, late="60 days"), "quota", "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.daily_counts(batch, "user_id", 3).collect()))


def test_trailing_equals_its_batch_twin(spark, events, tmp_path):
    stream, batch = events
    got = drained(spark, jobs.trailing_counts(stream, "event_type", late="60 days"), "trailing", "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.trailing_counts(batch, "event_type").collect()))


def test_ingest_resumes_without_repeats(spark, events, tmp_path):
    stream, batch = events
    for _ in range(2):
        jobs.ingest(jobs.once(stream, "event_id", late="60 days"), f"{tmp_path}/sink", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/sink").count() == batch.select("event_id").distinct().count()


def test_failure_pool(spark, tmp_path):
    rows = [("a", False, i) for i in range(6)] + [("b", False, 0), ("b", True, 1), ("c", False, 0), ("c", False, 1)]
    spark.createDataFrame(rows, "key string, ok boolean, order int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ok boolean, order int").parquet(f"{tmp_path}/in")
    got = {r.key: r for r in drained(spark, jobs.failure_pool(stream), "pool", "update", tmp_path).collect()}
    assert got["a"].state == "dead" and got["a"].tries == 5 and got["b"].state == "done" and (got["c"].tries, got["c"].state) == (2, "open")


def test_refresh_and_batch_rules(spark, events, tmp_path):
    stream, batch = events
    seen = []
    jobs.refresh(stream, f"{tmp_path}/r", lambda df, i: seen.append(df.count())).awaitTermination(120)
    assert sum(seen) == batch.count()
    runs = spark.createDataFrame([("x", i, i not in (2, 6)) for i in range(8)], "k string, i int, failed boolean")
    assert [r.i for r in jobs.alerts(runs, "k", F.col("failed"), ["i"]).orderBy("i").collect()] == [5]
    good = {r.b: r.good for r in jobs.good_batches(spark.createDataFrame([("p", 1), ("p", 0), ("q", 1)], "b string, ok int"), "b", F.col("ok") == 1).collect()}
    assert good == {"p": False, "q": True}


def test_streaks_equal_their_batch_twin(spark, tmp_path):
    rows = [(k, not ((i * 7 + len(k)) % 5 == 0), i) for k in ("a", "bb", "ccc") for i in range(40)]
    df = spark.createDataFrame(rows, "key string, failed boolean, order int")
    for part in range(4):  # a file a batch, in order
        df.where(F.col("order").between(part * 10, part * 10 + 9)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{part}")
    alerts = {(r.key, r.order // 10) for r in jobs.alerts(df, "key", F.col("failed"), ["order"]).collect()}
    seen = set()
    for part in range(4):
        spark.read.parquet(f"{tmp_path}/in/p{part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/live")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/live")
        q = jobs.streaks(stream).writeStream.foreachBatch(lambda d, _, part=part: seen.update((r.key, part) for r in d.where("alert").collect()))
        q.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert alerts and seen == alerts


def test_cursor_and_terminal_statuses(spark):
    e = spark.createDataFrame([(i, f"2024-01-{i:02d} 12:00:00") for i in range(1, 11)], "i int, ts string").withColumn("ts", F.to_timestamp("ts"))
    now = F.lit("2024-01-10 18:00:00").cast("timestamp")
    assert sorted(r.i for r in jobs.since_cursor(e, F.lit(None).cast("timestamp"), now).collect()) == [8, 9, 10]
    assert sorted(r.i for r in jobs.since_cursor(e, F.lit("2024-01-05 23:00:00").cast("timestamp"), now).collect()) == [5, 6, 7, 8, 9, 10]
    past = spark.createDataFrame([("a", 1, "started"), ("a", 2, "ok_full"), ("b", 1, "unsupported_no_text"), ("c", 1, "dry_run_error")], "k string, n int, status string")
    left = jobs.pending(spark.createDataFrame([(k,) for k in "abcd"], "k string"), past, "k", ["n"])
    assert sorted(r.k for r in left.collect()) == ["c", "d"]
