import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import rules, summary, timeline

RECORD = (
    "formula string, paper_type string, tc_kelvin double, pressure_gpa double, measurement string, confidence double, evidence_type string, tc_regime string, family string, "
    "pairing_symmetry string, gap_structure string, crystal_structure string, space_group string, structure_phase string, lattice_a double, lattice_c double, t_cdw_k double, "
    "t_sdw_k double, t_afm_k double, rho_exponent double, competing_order string, hc2_tesla double, hc2_conditions string, lambda_eph double, omega_log_k double, rho_s_mev double, "
    "ambient_sc boolean, sample_form string, substrate string, pressure_type string, doping_type string, doping_level double, is_unconventional boolean, disputed boolean"
)
NAMES = [c.split()[0] for c in RECORD.split(", ")]
PAPER = (
    "id string, source string, status string, credibility_tier string, paper_type string, doi string, date_submitted date, date_published date, categories array<string>, "
    "citation_count int, materials_extracted array<struct<" + ",".join(c.replace(" ", ":") for c in RECORD.split(", ")) + ">>"
)


def rec(formula, tc=None, **more):
    return tuple({"formula": formula, "tc_kelvin": tc, "confidence": 0.9, **more}.get(n) for n in NAMES)


def paper(i, records, source="arxiv", status=None, tier="T2", doi=None, year=2010):
    import datetime

    return (f"{source}:{i}", source, status, tier, None, doi, datetime.date(year, 1, 1), None, None, 0, records)


@pytest.fixture(scope="module")
def papers(spark):
    rows = [paper(i, [rec("MgB2", 39.0, measurement="resistivity", ambient_sc=True, family="mgb2", pairing_symmetry="S-wave" if i else "s-wave", crystal_structure="hex" if i == 3 else None)], year=2001 + i) for i in range(40)]
    rows += [paper(100, [rec("MgB2", 79.0, ambient_sc=True)], year=2000)]
    rows += [paper(200, [rec("LaH10", 255.0, pressure_gpa=170.0), rec("LaH10", 250.0, pressure_gpa=170.0, evidence_type="primary_theoretical")])]
    rows += [paper(300, [rec("YBa2Cu3O6.95", 92.0, ambient_sc=True)]), paper(301, [rec("YBCO", 93.0)]), paper(302, [rec("Sr-Ru-O", 1.0), rec("Nb", 9.2, confidence=0.1), rec("Nb", 9.2, evidence_type="cited"), rec("Nb", 900.0), rec("", 3.0)])]
    rows += [paper(400, [rec("XYCuO", 300.0)], status="retracted"), paper(401, [rec("FeSe", 8.0)], tier="T5"), paper("10.1103/q", [rec("FeSe", 8.5)], source="aps", tier="T5"), paper(402, [rec("FeSe", 9.0, confidence=0.5)], tier="T3")]
    return spark.createDataFrame(rows, PAPER)


def test_summaries(spark, papers):
    flat = summary.records(papers)
    skips = {r.skip: r.n for r in flat.groupBy("skip").agg(F.count("*").alias("n")).collect()}
    assert skips["system_designator_not_compound"] == skips["low_confidence"] == skips["cited"] == skips["tc_out_of_range"] == skips["no_formula"] == 1
    over = spark.createDataFrame([("mgb2", "tc_max", "38.5", True, "book"), ("yba2cu3o7", "space_group", "Pmmm", False, "book")], "canonical string, field string, override_value string, is_cap boolean, source string")
    bad = spark.createDataFrame([("fese", "retracted_claim", 100.0)], "canonical string, claim_type string, claimed_tc double")
    out = summary.summarise(flat.where("skip is null"), over, bad)
    got = {r.formula_normalized: r for r in out.collect()}
    again = summary.summarise(flat.where("skip is null").repartition(7, F.rand(random.randint(0, 99))), over, bad)
    assert {r.formula_normalized: r for r in again.collect()} == got
    m = got["mgb2"]
    assert m.tc_max == 38.5 and m.tc_ambient == 38.5 and m.total_papers == 40 and m.pairing_symmetry == "S-wave" and m.crystal_structure == "hex" and m.family == "mgb2"
    assert m.tc_max_conditions.endswith("confirmed by 40 papers") and "clamped to 38.5" in m.review_reason and m.is_unconventional is False
    h = got["lah10"]
    assert h.family == "hydride" and h.tc_max_theoretical == 250.0 and h.tc_max_experimental is None and h.dominant_evidence == "theoretical"
    y = got["yba2cu3o7"]
    assert y.tc_max == 93.0 and y.family == "cuprate" and y.pairing_symmetry == "d-wave" and y.space_group == "Pmmm"
    f = got["fese"]
    assert f.total_papers == 2 and f.disputed and f.review_reason == "refuted:retracted_claim" and f.best_credibility_tier == "T1" and f.tc_max == 9.0
    linked = {r.formula_normalized: r for r in summary.link_variants(out).collect()}
    assert linked["yba2cu3o6.95"].parent_id == "mat:yba2cu3o7" and linked["yba2cu3o7"].variant_count == 1
    old = spark.createDataFrame([("mat:mgb2", "MgB2", True, "kept", "approved"), ("mat:x-y-o", "X-Y-O", False, None, None), ("nims:1", "odd", False, None, None), ("mat:gaas", "GaAs", False, None, None)], "id string, formula string, needs_review boolean, review_reason string, admin_decision string")
    merged = summary.merge(old, out.select("id", "formula", "needs_review", "review_reason"))
    done = {r.id: r for r in summary.retire_orphans(merged, out.select("id")).collect()}
    assert done["mat:mgb2"].review_reason == "kept" and done["mat:x-y-o"].review_reason == "orphaned_invalid_source; was: (none)" and not done["nims:1"].needs_review and not done["mat:gaas"].needs_review


def test_rules_and_tiers(spark, papers):
    r = "struct<paper_id:string,pressure_gpa:double,tc_kelvin:double,ambient_sc:boolean,year:int,measurement:string,paper_type:string>"
    rows = [
        ("mat:a", "A", "a", "mgb2", 60.0, False, False, 1, 2000, False, None, None, [("p1", 1.0, 60.0, False, 1970, None, None)]),
        ("mat:b", "B", "b", "hydride", 120.0, False, False, 1, 2000, False, None, None, [("p1", 10.0, 120.0, False, 2001, None, None), ("p1", 10.4, 120.04, False, 2001, None, None)]),
        ("mat:c", "C", "c", "cuprate", 90.0, True, False, 2, 1990, False, None, None, [("p2", 0.0, 90.0, True, 2001, "arpes", None)]),
        ("mat:d", "D", "d", "conventional", 9.0, True, True, 2, 2000, False, None, "ok", [("p2", 2.0, 9.0, True, None, None, "theoretical")]),
        ("mat:e", "E", "e", "conventional", 9.0, True, True, 2, 2000, False, None, None, [("gone", None, 9.0, None, None, None, None)]),
    ]
    m = spark.createDataFrame(rows, f"id string, formula string, formula_normalized string, family string, tc_max double, ambient_sc boolean, is_unconventional boolean, total_papers int, arxiv_year int, needs_review boolean, review_reason string, admin_decision string, records array<{r}>")
    over = spark.createDataFrame([], "canonical string, field string, override_value string, is_cap boolean, source string")
    after = rules.run(m, rules.standard(papers, over, 2024))
    got = {x.id: (x.needs_review, x.review_reason, x.counted) for x in after.collect()}
    assert got["mat:a"] == (True, "tc_exceeds_family_cap", []) and got["mat:b"][1] == "hydride_low_pressure_high_tc"
    assert got["mat:c"] == (False, None, ["arxiv_year_mismatch"]) and got["mat:d"][0] is False and got["mat:e"][1] == "family_unconv_contradiction"
    assert {x.rule: x.rows_flagged for x in rules.report(m, after).collect()}["arxiv_year_mismatch"] == 1
    tiers = {x.id: (x.tier, x.reason) for x in rules.credibility(papers, over, spark.createDataFrame([("LaH10",)], "canonical string")).collect()}
    assert tiers["arxiv:400"] == ("T5", "retracted") and tiers["aps:10.1103/q"] == ("T1", "aps_published_article") and tiers["arxiv:200"] == ("T5", "all_formulas_refuted")
    assert tiers["arxiv:100"][0] == "T2" or tiers["arxiv:100"][0] == "T5"
    pts = timeline.points(m, papers, 2024)
    assert {(x.id, x.year, x.is_theoretical) for x in pts.collect()} >= {("mat:b", 2001, False), ("mat:c", 2001, False)} and pts.where("id = 'mat:b'").count() == 1
    assert timeline.coverage(pts).first().total_points == pts.count()
    page = timeline.listing(m.withColumns({"best_credibility_tier": F.lit("T1"), "parent_id": F.lit(None).cast("string")}), families=" cuprate , conventional ", tc_min=5.0, sort="tc_max", limit=2).collect()
    assert [x.id for x in page] == ["mat:c", "mat:d"] and page[0].total == 3
