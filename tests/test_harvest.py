import json

from pyspark.sql import functions as F

from lodestone.operators import harvest as H
from lodestone.operators import tables as T
from lodestone.operators import vectors

ITEM = "doi string, title string, abstract string, score double, year int, volume string, issue string, article_number string, page string, query string"


def test_manifest(spark):
    rows = [
        ("https://doi.org/10.1103/PhysRevB.1.2.", "Superconducting hydride", "", 2.0, 2020, "1", "2", "a", None, "q1"),
        ("10.1103/PhysRevB.1.2", "A d-wave cuprate", None, 3.0, 2020, "1", "2", "a", None, "q2"),
        ("10.1103/PhysRev.5.77", "superconductor", None, 1.0, 1999, "5", "1", None, None, "q1"),
        ("10.1103/PhysRevLett.5.077001", "superconductor", None, 1.0, 2010, "5", "1", None, None, "q1"),
        ("10.1103/PhysRevFocus.1.1", "superconductor", None, 1.0, 2010, "5", "1", "1", None, "q1"),
        ("10.1103/PhysRevA.9.1", "a topological insulator", None, 1.0, 2010, "9", "1", "1", None, "q1"),
        (None, "superconductor", None, 1.0, 2010, "5", "1", "1", None, "q1"),
    ]
    got = H.build_manifest(spark.createDataFrame(rows, ITEM), spark.createDataFrame([("10.1103/physrevb.1.2", "arxiv:1")], "doi string, id string")).collect()
    first = next(r for r in got if r.doi == "10.1103/PhysRevB.1.2")
    assert first.tags == ["cuprate", "hydride", "pairing", "superconduct"] and first.score == 3.0 and first.queries == ["q1", "q2"] and first.priority == "P0" and first.known_ids == "arxiv:1" and first.reject is None
    reasons = {r.doi: r.reject for r in got}
    assert reasons["10.1103/PhysRev.5.77"] is None and reasons["10.1103/PhysRevLett.5.077001"] == "missing_locator" and reasons["10.1103/PhysRevFocus.1.1"].startswith("excluded_doi_prefix") and "10.1103/PhysRevA.9.1" not in reasons
    days = spark.createDataFrame([("1985-12-31",), ("1990-01-01",), (None,)], "d string").select(H.in_window(F.col("d").cast("date")).alias("w"))
    assert [r.w for r in days.collect()] == [False, True, False]


def test_enrich_and_types(spark):
    p = spark.createDataFrame([("a", "", None, 5, "x"), ("b", "10.1/k", "J", 5, None)], "id string, doi string, journal string, citation_count int, paper_type string")
    n = spark.createDataFrame([("a", "10.1/n", 0, "N", ["JournalArticle", "Review"]), ("b", "10.1/n", 9, "N", ["?", "Dataset"])], "id string, doi string, citation_count int, journal string, types array<string>")
    assert sorted(map(tuple, H.enrich(p, n).collect())) == [("a", "10.1/n", "N", 5, "review"), ("b", "10.1/k", "J", 9, "computational")]
    bad = ["MgB2", "", "Bi_2Sr_2", "a b", "Y,x", "X0.75O", "O{8}", "abc"]
    got = [r.u for r in spark.createDataFrame([(i, f) for i, f in enumerate(bad)], "i int, f string").orderBy("i").select(H.unsearchable(F.col("f")).alias("u")).collect()]
    assert got == [None, "empty", None, "non_formula_text", "alloy_or_variable_stoichiometry", "decimal_subscript", "variable_subscript", "no_element_symbol"]
    hits = spark.createDataFrame([("k", "m1", None), ("k", "m2", 0.1), ("k", "m3", 0.0)], "k string, material_id string, energy_above_hull double")
    assert tuple(H.best_match(hits, "k").first()) == ("k", "m3", ["m3", "m2", "m1"])


def test_imports_and_hydrides(spark):
    rows = [("MgB2", "39", "0", "hex", "r1"), ("Mg B2", "40-42", "5", "hex", "r2"), ("MgB_2", "30", None, "cub", "r2"), ("LaH10", "250 K", "170 GPa", None, None)]
    got = {r.id: r for r in H.import_rows(spark.createDataFrame(rows, "formula string, tc string, pressure string, structure string, reference string")).collect()}
    m, h = got["nims:mgb2"], got["nims:lah10"]
    assert (m.tc_max, m.tc_ambient, m.ambient_sc, m.crystal_structure, m.pressure_type, m.total_papers, m.tc_max_conditions) == (41.0, 39.0, True, "hex", "hydrostatic", 2, "P=5.0 GPa, hex")
    assert h.ambient_sc is False and h.tc_ambient is None and h.family == "hydride"
    cols = "paper_id formula tc_kelvin pressure_gpa lambda_eph mu_star omega_log_source_value omega_log_source_unit omega_log_k method evidence_type confidence".split()
    raw = [
        ("p", "H3S", "200", "150 GPa", "2.0", "0.1", "100", "meV", None, "m", "Cited", "0.9"), ("p", "H3S", "200", "150", "2", "0.1", "100", "meV", None, "m", None, "2"),
        ("p", "MgB2", "39", "1", None, None, None, None, None, "m", None, None), ("p", "LaH10", "250", "900", None, None, None, None, None, "m", None, None), ("p", "YH9", "200", None, None, None, None, None, None, "m", None, None),
    ]
    out = H.hydrides(spark.createDataFrame(raw, ", ".join(f"{c} string" for c in cols))).collect()
    assert len(out) == 1 and round(out[0].omega_log_k, 2) == 1160.45 and out[0].confidence == 1.0 and out[0].record_key.startswith("hydride:")
    replies = ['```json\n[{"formula": "Nb"}]\n```', '{"materials": [{"formula": "Pb"}]}', "sorry", '{"x": 1}']
    parsed = [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i int, t string").orderBy("i").select(H.llm_reply(F.col("t"), "array<struct<formula:string>>").alias("v")).collect()]
    assert [v and v[0].formula for v in parsed] == ["Nb", "Pb", None, None]
    assert json.loads("[]") == []


def test_consolidation_and_retrieval(spark):
    rows = [("mat:mgb2", "MgB2"), ("mat:MgB_2", "MgB_2"), ("mat:old", "Nb3Sn"), ("nims:fese", "FeSe"), ("mat:z", None)]
    plan = {r.new_id: (r.plan, r.hetero, r.old_ids) for r in H.consolidate(spark.createDataFrame(rows, "id string, formula string")).collect()}
    assert plan["mat:mgb2"][0] == "merge" and not plan["mat:mgb2"][1] and plan["mat:nb3sn"] == ("rekey", False, ["mat:old"]) and plan["nims:fese"][0] == "unchanged" and plan["mat:z"][0] == "unchanged"
    hits = spark.createDataFrame([(1, k, k / 10) for k in range(4)], "query_id int, vec_id int, distance double")
    chunks = spark.createDataFrame([(k, f"p{k % 2}", "s", "text  x") for k in range(4)], "vec_id int, paper_id string, section string, text string")
    papers = spark.createDataFrame([("p0", "T", ["A, B"], 2020, None), ("p1", "U", [], None, "retracted")], "id string, title string, authors array<string>, year int, status string")
    got = H.retrieve(hits, chunks, papers).orderBy("n").collect()
    assert [(r.n, r.vec_id, r.block, r.snippet) for r in got] == [(1, 0, "[1] T — A (2020) · s", "text x"), (2, 2, "[2] T — A (2020) · s", "text x")]
    full = H.completed(spark.createDataFrame([("f", "a"), ("g", "b")], "i string, r string"), spark.createDataFrame([("a",), ("b",)], "r string"), "i", "r")
    assert sorted(map(tuple, full.collect())) == [("f", "a", 1), ("f", "b", 0), ("g", "a", 0), ("g", "b", 1)]
    assert [r.p for r in spark.createDataFrame([("a_b_chunk_003",), ("a_fact_01",), ("a_chunk_b_chunk_1",)], "c string").select(vectors.parent_id(F.col("c")).alias("p")).collect()] == ["a_b", "a", "a_chunk_b"]


def test_nested_records_and_samples(spark):
    rows = [(1, "k", [("p", 1.0), ("p", 1.001)]), (2, "k", [("p", 1.0), ("q", 2.0)])]
    df = spark.createDataFrame(rows, "ord int, key string, records array<struct<p:string,t:double>>")
    got = T.merge_records(df, "key", "records", lambda r: [r["p"].alias("p"), F.round(r["t"], 2).alias("t")]).first()
    assert [tuple(r) for r in got.records] == [("p", 1.0), ("q", 2.0)]
    ids = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert [r.id for r in T.sample(ids, "id", 5).collect()] == [r.id for r in T.sample(ids.repartition(9), "id", 5).collect()]
    assert {r.g: r["count"] for r in T.stratified(ids, "g", "id").groupBy("g").count().collect()} == {0: 33, 1: 33, 2: 33}
    kids = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, v string")
    assert sorted(map(tuple, T.replace_children(kids, spark.createDataFrame([(1, "z")], "p int, v string"), "p").collect())) == [(1, "z"), (2, "c")]


def test_hydride_formulas_are_judged_once_a_spelling(spark):
    rows = [(f"p{i}", "LaH10", "250", "170") for i in range(50)] + [("q", "Sr-Ru-O", "2", "1"), ("q", "La H10", "251", "170"), ("q", None, "3", "1"), ("q", "MgB2", "39", "1")]
    given = ("lambda_eph", "mu_star", "omega_log_k", "omega_log_source_value", "omega_log_source_unit", "method", "evidence_type", "confidence")
    raw = spark.createDataFrame(rows, "paper_id string, formula string, tc_kelvin string, pressure_gpa string")
    out = H.hydrides(raw.selectExpr("*", *[f"cast(null as string) as {c}" for c in given]))
    assert any("spellings-" in f for f in out.inputFiles())
    assert out.count() == 51 and {r.key for r in out.collect()} == {"lah10"}
