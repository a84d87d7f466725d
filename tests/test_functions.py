import pytest
from pyspark.sql import functions as F

from lodestone.functions import formulas, numbers, text


def apply(spark, values, f, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.out for r in spark.createDataFrame(rows, f"i int, v {kind}").select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_canonical_keys(spark):
    pairs = {
        "Bi_2Sr_2CaCu_2O_{8+δ}": "bi2sr2cacu2o8", "Bi2Sr2CaCu2O8+delta": "bi2sr2cacu2o8", "Bi_2Sr_2Ca Cu_2 O_8-δ": "bi2sr2cacu2o8", "YBa_2Cu_3O_7-δ": "yba2cu3o7",
        "MgB_2": "mgb2", "MgB₂": "mgb2", "κ-(BEDT-TTF)_2Cu(NCS)_2": "κ-(bedtttf)2cu(ncs)2", "YBCO": "yba2cu3o7", "2H-NbSe2": "nbse2", "(La)(Fe)As": "lafeas",
        "Ba(Fe1−xCox)2As2": "ba(fe1-xcox)2as2", "[[Fe]Se]": "fese", "Na0.35CoO2·1.3H2O": "na0.35coo21.3h2o", "O_{7}^{2-}": "o7", "": "",
    }
    assert dict(zip(pairs, apply(spark, pairs, formulas.canonical))) == pairs


def test_validity(spark):
    good = ["MgB2", "YBa2Cu3O7-δ", "κ-(BEDT-TTF)2Cu[N(CN)2]Br", "LaH10", "La2-xSrxCuO4", "Na"]
    assert apply(spark, good, formulas.invalid_reason) == [None] * len(good)
    bad = {
        None: "empty", " ": "empty", "None": "literal_placeholder", "HOPG": "trade_name_not_compound", "H": "single_element_symbol", "cuprates": "generic_family_name",
        "A" * 101: "too_long", "abc": "no_uppercase_element", "La_2": "forbidden_char", "bilayer FeSe": "descriptive_word", "FeSemonolayer": "descriptive_word",
        "Ba(x=0.1)": "condition_descriptor", "1T-TaS2": "invalid_start", "Sr-Ru-O": "system_designator_not_compound", "Fm-3m-CeH10": "phase_prefix_in_formula",
        "YBa2Cu3O7-": "incomplete_or_charged_formula", "Xabcdefghijklm": "concatenated_prose",
    }
    assert dict(zip(bad, apply(spark, bad, formulas.invalid_reason))) == bad


def test_families(spark):
    want = {
        "MgB2": "mgb2", "LaH10": "hydride", "H3S": "hydride", "K3C60": "fulleride", "CsV3Sb5": "kagome", "LaFeAsO": "iron_based", "FeSe": "iron_based",
        "YBa2Cu3O7": "cuprate", "BSCCO": "cuprate", "La3Ni2O7": "nickelate", "CeCoIn5": "heavy_fermion", "UTe2": "heavy_fermion", "YNi2B2C": "borocarbide",
        "Sr2RuO4": "ruthenate", "NbSe2": "chalcogenide", "Nb": "elemental", "Nb3Sn": "conventional", "Ba0.6K0.4BiO3": "bismuthate", "LaO0.5F0.5BiS2": "bis2_layered",
        "κ-(BEDT-TTF)2Cu(NCS)2": "organic", "CeRu2": None, "Xx9": None,
    }
    assert dict(zip(want, apply(spark, want, formulas.family))) == want
    assert apply(spark, ["cuprate", "mgb2", "hydride", None], formulas.unconventional) == [True, False, None, None]


def test_parents_interfaces_ids(spark):
    want = {
        "yba2cu3o6.95": "yba2cu3o7", "la1.85sr0.15cuo4": "la2-xsrxcuo4", "ba(fe0.92co0.08)2as2": "bafe2as2", "bi2sr2cacu2o8.15": "bi2sr2cacu2o8", "mgb2": "mgb2",
        "(hg0.8re0.2)ba2cuo4": "hgba2cuo4",
    }
    got = dict(zip(want, apply(spark, want, formulas.parent_key)))
    assert got == want
    faces = {"fese/srtio3": ("fese", "srtio3"), "srtio3/fese": ("fese", "srtio3"), "bi2se3/nbse2": ("bi2se3", "nbse2"), "mgb2": None, "li5/6bc": None, "na0.3coo21.4(h/d)2o": None, "a/bb": None}
    got = apply(spark, faces, lambda c: F.array(formulas.interface(c)["overlayer"], formulas.interface(c)["substrate"]))
    assert {k: None if v[0] is None else tuple(v) for k, v in zip(faces, got)} == faces
    ids = apply(spark, ["mgb2", "x" * 91], formulas.entity_id)
    assert ids[0] == "mat:mgb2" and ids[1].startswith("mat:" + "x" * 80 + ":") and len(ids[1]) == 93


def test_numbers(spark):
    got = apply(spark, ["250 K", "80-95 K", "150", "~ 12.5 T", "", None, "none", "-3.5"], numbers.read_number)
    assert got == [250.0, 87.5, 150.0, 12.5, None, None, None, -3.5]
    assert apply(spark, [39.0, 0.5, 1234567.0, 0.0, 92.25, None, 170.0], numbers.short_number, "double") == ["39", "0.5", "1234567", "0", "92.25", None, "170"]
    est = spark.range(1).select(numbers.coupling_estimate(F.lit(2.0), F.lit(0.1), F.lit(100.0)).alias("e"), numbers.coupling_flags(F.lit(200.0), F.lit(2.0), F.lit(0.1), F.lit(100.0)).alias("f")).first()
    assert 0 < est.e < 20 and est.f == ["allen_dynes_mismatch"]
    assert round(spark.range(1).select(numbers.to_kelvin(F.lit(100.0), F.lit("meV")).alias("k")).first().k, 2) == 1160.45


def test_text(spark):
    assert apply(spark, ["arxiv:2301.1", "aps:10.1103/x", "doi:10.1/y", "nims:4", "odd", "", None], text.source_label) == ["arXiv:2301.1", "DOI: 10.1103/x", "DOI: 10.1/y", "NIMS:4", "odd", None, None]
    assert apply(spark, ["DFT and Eliashberg theory", "single crystal XRD synthesis", "a model"], lambda c: text.paper_type(c, F.lit(""))) == ["computational", "experimental", "theoretical"]
    assert apply(spark, ["the YBCO film", "Ruddlesden-Popper n = 2", "none"], text.structure_phase) == ["cuprate_123", "RP_n2", None]
    found = apply(spark, ["Superconducting hydride at high critical temperature", "vortex"], lambda c: F.struct(text.tags(c).alias("t"), text.worth_keeping(text.tags(c)).alias("k"), text.candidate_class(text.tags(c)).alias("c")))
    assert found[0].t == ["hydride", "superconduct", "tc"] and found[0].k and found[0].c == "materials_tc_likely" and not found[1].k
    assert apply(spark, [["Smith, A", "Jones"], ["A", "B", "C"], [], None, ["X"]], text.short_credit, "array<string>") == ["Smith & Jones", "A et al.", "Unknown", "Unknown", "X"]
    assert apply(spark, ["https://doi.org/10.1103%2FPhysRevB.1.", "10.1/x", "see 10.1103/abc)]"], text.doi) == ["10.1103/PhysRevB.1", None, "10.1103/abc"]
    assert apply(spark, [[2020, 2, 30], [2020, 5], [2020], None], text.date_of_parts, "array<int>")[1:3] == [__import__("datetime").date(2020, 5, 1), __import__("datetime").date(2020, 1, 1)]
    assert apply(spark, ["a  b\nc", "x" * 300], text.snippet) == ["a b c", "x" * 280 + "…"]


@pytest.fixture
def record():
    return dict(formula="MgB2", tc_kelvin=39.0, method=None, measurement="resistivity", pressure_gpa=None, pressure_condition_normalized="ambient", tc_regime=None, family="mgb2", crystal_structure=None, sample_form="film", comment="clean", doping_type="hole", doping_level=0.1, evidence_type="primary")


def test_fact_sentences(spark, record):
    types = {k: "double" if k in ("tc_kelvin", "pressure_gpa", "doping_level") else "string" for k in record}
    schema = "records array<struct<" + ",".join(f"{k}:{t}" for k, t in types.items()) + ">>"
    rows = [record | {"evidence_type": "cited", "formula": "Nb"}, record, {k: None for k in record} | {"formula": "X"}]
    got = spark.createDataFrame([([tuple(r.values()) for r in rows],)], schema).select(text.fact_sentences(F.col("records")).alias("s")).first().s
    tail = " has a critical temperature Tc = 39 K (resistivity) at ambient pressure. [mgb2; film; doping: hole x=0.1] Note: clean."
    assert got == ["MgB2" + tail, "Nb" + tail]
