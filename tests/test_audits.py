"""Rules one by one: failures stay alone, a run cut short goes on, differences to the run before; peaks beside a valley in ranges."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import audits, statistics
from lodestone.operators.rules import Rule, run

COLUMNS = "id string, v int, needs_review boolean, review_reason string, admin_decision string"


def rows(spark, values):
    return spark.createDataFrame([(f"m{k:02d}", v, k == 0, "old" if k == 0 else None, "kept" if k == 1 else None) for k, v in enumerate(values)], COLUMNS)


def rules(broken=True):
    bad = Rule("broken", "critical", F.col("no_such_column") > 1)
    late = Rule("raises", "critical", F.raise_error(F.lit("at run time")).cast("boolean"))
    return [
        Rule("high", "critical", F.col("v") > 90), *([bad, late] if broken else []), Rule("middle", "critical", F.col("v") > 50),
        Rule("seen", "warn", F.col("_twice") > 20, lambda d: d.withColumn("_twice", F.col("v") * 2)), Rule("none", "info", F.lit(None).cast("boolean")),
    ]


def told(spark, path, name):
    return {r.rule_name: (r.rows_flagged, r.delta_vs_previous, r.sample_ids) for r in audits.tables(spark, path)[0].read().where(F.col("run") == name).collect()}


def test_a_rule_that_fails_leaves_the_others_alone(spark, tmp_path):
    path = str(tmp_path)
    after = {r.id: (r.needs_review, r.review_reason) for r in audits.audit(rows(spark, [99, 99, 95, 60, 55, 30, 5, None]), rules(), path, "day1").collect()}
    assert after == {"m00": (True, "old"), "m01": (False, None), "m02": (True, "high"), "m03": (True, "middle"), "m04": (True, "middle"), "m05": (False, None), "m06": (False, None), "m07": (False, None)}
    got = told(spark, path, "day1")
    assert got == {"high": (1, None, ["m02"]), "broken": (-1, None, []), "raises": (-1, None, []), "middle": (2, None, ["m03", "m04"]), "seen": (2, None, ["m01", "m05"]), "none": (0, None, [])}
    errors = {r.rule_name: r.error for r in audits.tables(spark, path)[0].read().collect() if r.error}
    assert set(errors) == {"broken", "raises"} and "no_such_column" in errors["broken"]
    audits.audit(rows(spark, [99, 99, 95, 96, 97, 30, 5, None]), rules(), path, "day2")
    assert {k: v[:2] for k, v in told(spark, path, "day2").items()} == {"high": (3, 2), "broken": (-1, None), "raises": (-1, None), "middle": (0, -2), "seen": (2, 0), "none": (0, 0)}
    one_plan = run(rows(spark, [99, 99, 95, 60, 55, 30, 5, None]), rules(False)).select("id", "needs_review", "review_reason").collect()
    assert {r.id: (r.needs_review, r.review_reason) for r in one_plan} == after


def test_a_run_that_was_cut_short_goes_on(spark, tmp_path, monkeypatch):
    path, data = str(tmp_path), rows(spark, [99, 99, 95, 60, 55, 30])
    inner = audits.VersionedTable.upsert

    def dies(self, batch, number, stream="batch", **more):
        if self.path.endswith("reports") and number == 1:
            raise KeyboardInterrupt  # the flags of the second rule are there, its report isn't
        return inner(self, batch, number, stream, **more)

    monkeypatch.setattr(audits.VersionedTable, "upsert", dies)
    with pytest.raises(KeyboardInterrupt):
        audits.audit(data, rules(False), path, "r")
    monkeypatch.setattr(audits.VersionedTable, "upsert", inner)
    assert set(told(spark, path, "r")) == {"high"}
    before = audits.tables(spark, path)[1].commit_of()["version"]
    after = {r.id: r.review_reason for r in audits.audit(data, rules(False), path, "r").collect()}
    assert after == {"m00": "old", "m01": None, "m02": "high", "m03": "middle", "m04": "middle", "m05": None}
    assert {k: v[0] for k, v in told(spark, path, "r").items()} == {"high": 1, "middle": 2, "seen": 2, "none": 0}
    assert audits.tables(spark, path)[1].commit_of()["version"] == before  # nothing was flagged twice


def test_valleys_in_ranges_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    bins = {rng.randint(-400, 4000): rng.randint(1, 99) for _ in range(300)}
    got = statistics.valleys(spark.createDataFrame(list(bins.items()), "bin long, n long"), near=5, far=30)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == len(bins)
    for r in rows:
        left, right = (max((n for b, n in bins.items() if 5 <= s * (b - r.bin) <= 30), default=None) for s in (-1, 1))
        assert (r.left_peak, r.right_peak) == (left, right)
        sides = [s for s in (left, right) if s is not None]  # one side is enough for a depth
        assert r.depth == (round(r.n / min(sides), 4) if sides else None)
