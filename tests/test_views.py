"""Pages of summaries: variants, phase points, hydride rows, pages that go on after a row."""

import itertools
import random

from lodestone.operators import views

MATERIALS = "id string, parent_id string, formula string, tc_max double, doping_level double, review_reason string"


def materials(spark):
    return spark.createDataFrame(
        [
            ("a", None, "A", 90.0, 0.1, None), ("b", "a", "B", 50.0, None, None), ("c", "a", "C", None, 0.3, "provenance_quarantine_nims"), ("d", "a", "D", 70.0, None, "odd"),
            ("e", "e", "E", 1.0, None, None), ("f", "gone", "F", 2.0, None, None), (None, "a", "null", 99.0, None, None), ("g", "c", "G", 3.0, None, None),
        ],
        MATERIALS,
    )


def test_detail(spark):
    got = {r.id: (r.variant_count, [v.id for v in r.variants]) for r in views.detail(materials(spark)).collect()}
    assert got == {"a": (3, ["d", "b", "c"]), "b": (0, []), "d": (0, []), "e": (0, []), "f": (0, []), "g": (0, [])}
    few = {r.id: (r.variant_count, [v.id for v in r.variants]) for r in views.detail(materials(spark), spark.createDataFrame([("a",), ("a",), ("c",), ("zz",), (None,)], "id string"), most=1).collect()}
    assert few == {"a": (3, ["d"])}
    assert views.detail(spark.createDataFrame([], MATERIALS)).collect() == []


def test_phase_points(spark):
    records = spark.createDataFrame(
        [("a", 0, 10.0, None, 1.0, "p", 2000), ("b", 0, 20.0, 0.7, None, "q", 2001), ("b", 1, 0.0, 0.7, None, "q", 2001), ("b", 2, None, 0.7, None, "q", 2001), ("c", 0, 5.0, None, None, None, None), ("e", 0, 6.0, None, None, "r", 1999)],
        "id string, place int, tc_kelvin double, doping_level double, pressure_gpa double, paper_id string, year int",
    )
    got = sorted((r.page_id, r.variant, r.formula, r.tc_kelvin, r.doping_level) for r in views.phase_points(materials(spark), records).collect())
    assert got == [("a", False, "A", 10.0, 0.1), ("a", True, "B", 20.0, 0.7), ("a", True, "C", 5.0, 0.3), ("b", False, "B", 20.0, 0.7), ("e", False, "E", 6.0, None)]
    assert {r.page_id for r in views.phase_points(materials(spark), records.drop("doping_level"), spark.createDataFrame([("b",)], "id string")).collect()} == {"b"}


def test_hydride_rows_need_a_page(spark):
    rows = spark.createDataFrame([("a", "k1"), ("c", "k2"), ("none", "k3"), (None, "k4")], "material_id string, record_key string")
    assert [r.record_key for r in views.hydride_rows(materials(spark), rows).collect()] == ["k1"]


def test_pages_join_up_whatever_is_null(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.0, 2.0]), rng.choice([None, 5.0, 6.0]), rng.choice([None, 1999, 2000]), f"k{i:03d}") for i in range(120)]
    df = spark.createDataFrame(rows, "pressure_gpa double, tc_kelvin double, year int, record_key string")
    up, down = lambda v: (v is None, v or 0), lambda v: (v is None, -(v or 0))
    want = [r[3] for r in sorted(rows, key=lambda r: (up(r[0]), down(r[1]), down(r[2]), r[3]))]
    got, last = [], None
    for _ in itertools.count():
        page = views.page_after(df, views.HYDRIDE_ORDER, last, 17).collect()
        if not page:
            break
        got += [r.record_key for r in page]
        last = page[-1].asDict()
    assert got == want
