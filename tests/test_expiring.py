"""Keyed state with an end: what a stream says equals its batch twin, and rows of state go when their time is over."""

import random
import time

import pytest

from lodestone.streaming import expiring, jobs
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    expiring.with_rocksdb(spark)
    yield
    spark.conf.set(name, before)


class Feed:
    """A stream fed by Parquet files, and a memory table of what it says."""

    def __init__(self, spark, tmp_path, schema, job, name):
        self.spark, self.folder, self.schema, self.n, self.name = spark, str(tmp_path / "in"), schema, 0, name
        spark.createDataFrame([], schema).write.parquet(self.folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(self.folder)
        self.rows, self.seen, self.at = 0, 0, -1
        self.query = job(stream).writeStream.outputMode("update").trigger(processingTime="500 milliseconds").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()

    def put(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        self.rows += len(rows)
        end = time.time() + 90
        while self.seen < self.rows:  # with timers a query runs batches without end, so nothing but its progress tells what it has taken
            assert self.query.exception() is None and time.time() < end, self.query.exception()
            for p in self.query.recentProgress:
                if p["batchId"] > self.at:
                    self.at, self.seen = p["batchId"], self.seen + p["numInputRows"]
            time.sleep(0.1)

    def said(self):
        return self.spark.table(self.name).collect()

    def state_rows(self):
        return sum(o["numRowsTotal"] for o in self.query.lastProgress["stateOperators"])


def test_a_quota_counts_as_its_batch_twin_and_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user string, ts timestamp", lambda s: expiring.quota(s, "user", 3, seconds=25), "quota_said")
    try:
        rng = random.Random(1)
        from datetime import datetime, timedelta

        rows = [(rng.choice("abc"), datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 60))) for _ in range(40)]
        feed.put(*rows[:25])
        feed.put(*rows[25:])
        last = {}
        for r in feed.said():
            last[r.day, r.key] = max(last.get((r.day, r.key), (0,)), (r.used, r.remaining, r.over))
        twin = jobs.daily_counts(spark.createDataFrame(rows, "user string, ts timestamp"), "user", 3)
        assert last == {(r.day, r.user): (r.used, r.remaining, r.over) for r in twin.collect()}
        before = feed.state_rows()
        assert before >= len(last)
        time.sleep(26)
        feed.put(("z", datetime(2024, 2, 1)))
        feed.put(("z", datetime(2024, 2, 1)))
        assert feed.state_rows() < before / 2  # only the new key is left
        feed.put((rows[0][0], rows[0][1]))
        assert [r.used for r in feed.said() if r.key == rows[0][0]][-1] == 1  # its count starts anew
    finally:
        feed.query.stop()


def test_a_pool_escalates_waits_and_forgets(spark, tmp_path):
    feed = Feed(spark, tmp_path, "key string, ok boolean, order int", lambda s: expiring.pool(s, seconds=60, wait=1.0), "pool_said")
    try:
        rng = random.Random(3)
        rows = [(rng.choice("pqrst"), rng.random() < 0.25, k) for k in range(60)] + [("dead", False, k) for k in range(7)] + [("late", False, k) for k in range(3)]
        for low in range(0, len(rows), 20):
            feed.put(*rows[low : low + 20])
        last = {}
        for r in feed.said():
            if r.strategy != "due":
                last[r.key] = (r.tries, r.state)
        twin = {r.key: (r.tries, r.state) for r in expiring.pooled(spark.createDataFrame(rows, "key string, ok boolean, order int")).collect()}
        assert last == twin and last["dead"] == (5, "dead") and last["late"] == (3, "open")
        time.sleep(2)
        feed.put(("other", True, 0))
        assert [(r.tries, r.state) for r in feed.said() if r.key == "late" and r.strategy == "due"] == [(3, "open")]
    finally:
        feed.query.stop()


def test_runs_of_failures_alert_once_and_leave_no_state_when_they_end(spark, tmp_path):
    feed = Feed(spark, tmp_path, "key string, failed boolean, order int", lambda s: expiring.streaks(s, 3, seconds=60), "streaks_said")
    try:
        rng = random.Random(7)
        rows = [(rng.choice("uvw"), rng.random() < 0.6, k) for k in range(50)]
        for low in range(0, 50, 10):
            feed.put(*rows[low : low + 10])
        twin = jobs.alerts(spark.createDataFrame(rows, "key string, failed boolean, order int"), "key", F.col("failed"), ["order"], 3)
        raised = {}
        for r in feed.said():
            raised[r.key] = raised.get(r.key, 0) + r.alert
        assert {k: n for k, n in raised.items() if n} == {r.key: r["count"] for r in twin.groupBy("key").count().collect()}
        feed.put(*[(k, False, 100) for k in "uvw"])
        feed.put(*[(k, False, 101) for k in "uvw"])
        assert feed.state_rows() == 0
    finally:
        feed.query.stop()
