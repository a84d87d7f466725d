"""What plans on the test tables shuffle and read."""

import datetime

import __spark_entry__ as entry
from lodestone.operators import harvest, rules, summary, tables, timeline
from lodestone.plans import evidence_demo
from lodestone.session import table

SF = "/root/testdata/sf0.001"


def test_lines_are_gathered_before_they_are_records(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = evidence_demo.papers(lambda name: table(spark, SF, name))._jdf.queryExecution().optimizedPlan().toString()
    assert "rho_exponent" in plan and "rho_exponent" not in plan[plan.rindex("collect_list") :].split("\n", 1)[1]


def test_listing_reads_what_was_written(spark):
    assert not [f for f in entry.queries()["material_listing"](spark, SF).inputFiles() if "lineitem" in f]


def test_tiers_are_one_grouping(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    over = spark.createDataFrame([], "canonical string, field string, override_value string, is_cap boolean, source string")
    plan = rules.credibility(evidence_demo.papers(lambda name: table(spark, SF, name)), over, spark.createDataFrame([], "canonical string"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" in plan and "distinct" not in plan


def test_parts_hold_a_bounded_number_of_rows(spark):
    got = tables.spread(spark.range(10_000), "id", rows=100)
    assert got.rdd.getNumPartitions() == 100 and got.count() == 10_000 and tables.spread(spark.range(10), "id").rdd.getNumPartitions() == 4
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert max(sizes) < 200 and sum(sizes) == 10_000
    plan = entry.queries()["countries_per_paper"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_texts_of_an_import_are_read_once(spark):
    rows = [("MgB2", "39 K", "1 GPa", " ", "a"), ("Mg B2", None, "?", "hex", "b"), (None, "4", "0", "x", "c"), ("MgB2", "30-40", None, "hex", " "), ("", "5", "0", "x", "c")]
    out = harvest.import_rows(spark.createDataFrame(rows, "formula string, tc string, pressure string, structure string, reference string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "numbers-" in str(out.inputFiles()) and plan.count("regexp_extract(tc") == 0
    r = out.where("id = 'nims:mgb2'").first()
    assert (r.tc_max, r.tc_ambient, r.ambient_sc, r.crystal_structure, r.pressure_type, r.total_papers, r.records) == (39.0, 35.0, True, "hex", "hydrostatic", 2, 3)
    assert out.count() == 1


def test_records_are_written_once(spark, monkeypatch):
    made = {}

    def spy(df, label, write=evidence_demo.materialised):
        made[label] = df
        return write(df, label)

    monkeypatch.setattr(summary, "materialised", spy)
    monkeypatch.setattr(evidence_demo, "materialised", spy)
    assert entry.queries()["evidence_headline"](spark, SF).count() > 30
    assert list(made) == ["papers", "records", "counts", "votes", "derived"]
    assert "hashpartitioning(key" not in made["records"]._jdf.queryExecution().executedPlan().toString()
    assert made["papers"].where("status = 'retracted' or credibility_tier in ('T4', 'T5') and source <> 'aps'").isEmpty()


def test_only_papers_that_count_get_records(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = summary.counting(evidence_demo.papers(lambda name: table(spark, SF, name)))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert [i < join for i, line in enumerate(plan) if "transform(" in line] == [True]
    assert any("Filter" in line and "o_orderstatus" in line for line in plan[join:])


def test_only_records_without_a_year_meet_their_papers(spark):
    day = lambda y: datetime.date(y, 5, 1)
    m = spark.createDataFrame([("mat:a", "A", "f")], "id string, formula string, family string")
    p = spark.createDataFrame([("p1", day(2001), day(2000)), ("p2", None, day(2003))], "id string, date_published date, date_submitted date")
    said = [("p1", 10.0, 1999), ("p1", 11.0, None), ("p2", 12.0, 0), ("gone", 13.0, None), ("gone", 14.0, 2010), ("p2", 14.02, 2010)]
    rows = [("mat:a", i, paper, tc, None, "dft", None, year) for i, (paper, tc, year) in enumerate(said)]
    r = spark.createDataFrame(rows, "id string, place int, paper_id string, tc_kelvin double, pressure_gpa double, measurement string, paper_type string, year int")
    pts = timeline.points(m, p, 2024, records=r)
    assert sorted((x.tc_kelvin, x.year, x.paper_id) for x in pts.collect()) == [(10.0, 1999, "p1"), (11.0, 2001, "p1"), (12.0, 2003, "p2"), (14.0, 2010, "gone")]
    plan = pts._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(" in plan[plan.index("LeftOuter") :] and "Union" in plan[: plan.index("LeftOuter")]


def test_timeline_writes_papers_that_count(spark, monkeypatch):
    made = {}

    def spy(df, label, write=evidence_demo.materialised):
        made[label] = df
        return write(df, label)

    monkeypatch.setattr(evidence_demo, "materialised", spy)
    assert entry.queries()["timeline_points"](spark, SF).count() > 100
    assert made["papers"].where("status = 'retracted' or credibility_tier in ('T4', 'T5') and source <> 'aps'").isEmpty()


def test_coverage_counts_no_papers_of_materials(spark):
    plan = entry.queries()["timeline_coverage"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [line.count("Aggregate [") for line in plan if "Aggregate" in line] == [1] and "count(distinct" in plan[0]
    plan = entry.queries()["material_listing"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "total_papers" in plan and "paper_id" in plan[plan.index("AS total_papers") :]
