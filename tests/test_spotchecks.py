"""Checks of summaries without a family, the random sample, and rules on names, one case each."""

from lodestone.operators import rules, spotchecks

ROWS = "id string, formula string, tc_max double, family string, total_papers int, dominant_evidence string, tc_max_experimental double"


def rows(spark, values):
    return spark.createDataFrame([(*v, *(None,) * (7 - len(v))) for v in values], ROWS)


def test_null_family(spark):
    m = rows(spark, [
        ("1", "La0.7Sr0.3MnO3", 1.0, None, 1), ("2", "MgO", 50.0, None, 1), ("3", "GaAs", 41.0, None, 1), ("4", "Ga1.2As", None, None, 1), ("5", "Ga12As", None, None, 1), ("6", "Ga12As", None, None, 1),
        ("7", "YBa2Cu3O7", 90.0, None, 1), ("8", "GaP", 9.0, None, 1), ("9", "GaSb", 9.0, None, 0), ("a", "GaSb", 9.0, "organic", 1), ("b", None, 9.0, None, 1), ("c", "AlB", 9.0, None, 1), ("d", "AlN film", 9.0, None, 1),
    ])
    said = spark.createDataFrame([("8", " Kagome "), ("8", "unknown"), ("8", None), ("c", "other"), ("zz", "kagome"), ("3", "elemental")], "id string, family string")
    got = {r.id: (r.issues, r.tag) for r in spotchecks.null_family(m, said).collect()}
    assert got["1"][1] == "CONTAMINANT" and got["1"][0][0] == "manganite_CMR_not_SC" and got["2"][0][0] == "substrate_or_ferroelectric"
    assert got["3"] == (["implausible_tc_41.0K_on_null"], "TC_IMPLAUSIBLE") and got["8"] == (["NER_says_kagome_verify"], "NER_VERIFY")
    assert got["4"] == (["near_dup(Ga12As)"], "NEAR_DUP") and got["5"] == got["6"] == (["near_dup(Ga1.2As)"], "NEAR_DUP")
    assert got["7"] == (["misclassified_should_be_cuprate"], "FAMILY_MISCLASS") and got["b"] == (["formula_reject_empty"], "FORMULA_ODD") and got["c"] == ([], "correctly_null")
    assert got["d"][0][-1] == "formula_reject_descriptive_word" and set(got) == set("12345678bcd")
    some = [sorted(r.id for r in spotchecks.null_family(m.repartition(k), said, 4).collect()) for k in (1, 7)]
    assert some[0] == some[1] and len(some[0]) == 4


def test_spot_check(spark):
    m = rows(spark, [
        ("mat:1", "cuprates", 10.0, None), ("mat:2", "NbTi", 300.0, "conventional"), ("mat:3", "GaAs", 20.0, "organic", 1, "theoretical", None), ("mat:4", "YBa2Cu3O7", 90.0, "organic"),
        ("mat:5", "Nb3Sn", 18.0, ""), ("mat:6", "Sn Nb3", 18.0, None), ("nims:7", "Nb3 Sn", 18.0, "conventional"), ("mat:8", "GaP", None, None), ("mat:8", "GaP", None, None), ("mat:9", None, None, None),
    ])
    got = {r.id: r.classes for r in spotchecks.spot_check(m, None).collect()}
    assert got["mat:1"] == ["A"] and got["mat:2"] == ["B"] and got["mat:3"] == ["B-soft"] and got["mat:4"] == ["B", "C"] and got["mat:8"] == [] and got["mat:9"] == ["A"]
    assert got["mat:5"] == ["C-miss", "D"] and got["mat:6"][-1] == "D" and got["nims:7"] == ["D-xprov"]
    told = {r["class"]: (r.hard, r.n, r.pct) for r in spotchecks.tally(spotchecks.spot_check(m, None)).collect()}
    assert told["hard"] == (True, 6, 60.0) and told["D-xprov"] == (False, 1, 10.0)
    assert spotchecks.spot_check(m, 3).count() == 3 and spotchecks.spot_check(m.limit(0)).count() == 0
    assert spotchecks.tally(spotchecks.spot_check(m.limit(0))).where("pct is not null").count() == 0


def test_naming(spark):
    named = ["bilayer FeSe", "Ba(x=0.1)", "fese", "Sr-Ru-O", "Fm-3m-CeH10", "YBa2Cu3O7-", "MgB2", None]
    m = spark.createDataFrame([(str(i), f, False, None, None) for i, f in enumerate(named)], "id string, formula string, needs_review boolean, review_reason string, admin_decision string")
    got = [r.review_reason for r in rules.run(m, rules.naming()).orderBy("id").collect()]
    assert got == [*["ner_extracted_descriptive_text"] * 3, "system_designator_not_compound", "phase_prefix_in_formula", "incomplete_or_charged_formula", None, None]
