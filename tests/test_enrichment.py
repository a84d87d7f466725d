"""Resumed extraction: failures stay alone, a run that dies goes on, keys are there once; rounds of look-ups."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import enrichment

PAPERS = "id string, source string, doi string, title string, abstract string, said string, date_published date, date_submitted date"
DAY = datetime.date(2020, 5, 1)


def papers(spark):
    return spark.createDataFrame(
        [
            ("p1", "arxiv", "10.1/A", "Superhydride", None, "LaH10:250:170:0.9", DAY, None), ("p2", "aps", None, "About LaH10", None, "broken", None, DAY), ("p3", "arxiv", None, "copper", "oxide", "Hydride of x", None, None),
            ("p4", "arxiv", "10.1/b", "copper", None, None, None, DAY), ("p5", "arxiv", None, None, None, "", None, None), (None, "arxiv", None, "hydride", None, "LaH10:250:170:0.9", DAY, None),
            ("p6", "arxiv", None, "hydride", None, "LaH10:250:170:0.2,LaH10:250:170:0.8,H3S:203:155:2,H3S:900:1:1", DAY, None),
        ],
        PAPERS,
    )


def extract(row):
    if row["said"] == "broken":
        raise ValueError("no text")
    if ":" not in (row["said"] or ""):
        return []
    return [dict(zip(("formula", "tc_kelvin", "pressure_gpa", "confidence"), x.split(":"))) for x in row["said"].split(",")]


def test_candidates(spark):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(enrichment.candidates(papers(spark))) == ["p1", "p2", "p3", "p6"]
    assert ids(enrichment.candidates(papers(spark), "aps")) == ["p2"]
    wanted = spark.createDataFrame([("p5", None), (None, "https://doi.org/10.1/B"), ("p4", None), (None, None)], "id string, doi string")
    assert ids(enrichment.candidates(papers(spark), wanted=wanted)) == ["p4", "p5"]
    assert ids(enrichment.candidates(papers(spark), wanted=wanted.limit(0))) == []


def told(spark, path):
    found, events = enrichment.tables(spark, path)
    return (
        sorted((r.paper_id, r.formula, r.tc_kelvin, r.confidence, r.material_id, r.year) for r in found.read().collect()),
        {r.paper_id: (r.ok, r.error, r.n_records) for r in events.read().collect()},
    )


def test_a_run_that_dies_goes_on(spark, tmp_path):
    path, rows = str(tmp_path), enrichment.candidates(papers(spark))
    materials = spark.createDataFrame([("mat:lah10", "lah10"), ("x", None)], "id string, formula_normalized string")

    def dies(k):
        if k == 1:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        enrichment.run(rows, materials, extract, path, "one", rounds=3, before_events=dies)
    seen = set(told(spark, path)[1])
    enrichment.run(rows, materials, extract, path, "one", rounds=3)
    found, events = told(spark, path)
    assert found == [("p1", "LaH10", 250.0, 0.9, "mat:lah10", 2020), ("p6", "H3S", 203.0, 1.0, None, 2020), ("p6", "LaH10", 250.0, 0.8, "mat:lah10", 2020)]
    assert events == {"p1": (True, None, 1), "p2": (False, "ValueError: no text", 0), "p3": (True, None, 0), "p6": (True, None, 2)} and seen < set(events)
    assert enrichment.pending(rows, enrichment.tables(spark, path)[1].read()).count() == 0
    assert [r.id for r in enrichment.pending(rows, enrichment.tables(spark, path)[1].read(), True).collect()] == ["p2"]
    mended = rows.withColumn("said", F.when(F.col("id") == "p2", "H3S:200:150:0.5").otherwise("broken"))  # who is asked again fails, but for p2
    enrichment.run(mended, materials, extract, path, "two", rounds=2, retry_failed=True)
    found, events = told(spark, path)
    assert len(found) == 4 and ("p2", "H3S", 200.0, 0.5, None, 2020) in found and all(ok for ok, _, _ in events.values())


def test_look_ups(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    m = spark.createDataFrame(
        [("a", "Nb_3Sn", "old", ["old"], None), ("b", "MgB2", "old", ["old"], at(31)), ("c", "a b", "old", ["old"], at(1)), ("d", "V3Si", None, None, at(1)), ("e", None, None, None, None)],
        "id string, formula string, mp_id string, mp_alternate_ids array<string>, mp_synced_at timestamp",
    )
    now = F.lit("2024-02-20").cast("timestamp")
    assert sorted(r.formula for r in enrichment.to_look_up(m, now).collect()) == ["Nb3Sn", "V3Si"]
    assert sorted(r.formula for r in enrichment.to_look_up(m, now, force=True).collect()) == ["MgB2", "Nb3Sn", "V3Si"]
    hits = spark.createDataFrame([("Nb3Sn", "mp-2", 0.1), ("Nb3Sn", "mp-1", None), ("MgB2", "mp-9", 0.0)], "formula string, material_id string, energy_above_hull double")
    got = {r.id: (r.mp_id, r.mp_alternate_ids, str(r.mp_synced_at)[:10]) for r in enrichment.looked_up(m, hits, now).collect()}
    assert got == {"a": ("mp-2", ["mp-2", "mp-1"], "2024-02-20"), "b": ("old", ["old"], "2024-01-31"), "c": (None, [], "2024-02-20"), "d": (None, [], "2024-02-20"), "e": (None, [], "2024-02-20")}
