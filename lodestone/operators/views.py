"""What one summary's page shows: the summary with its variants, the points of its phase diagram, its hydride rows; pages that go on after a row.

Every view is of all summaries at once, or of those whose ids a small table names. materials: (id, parent_id, formula, tc_max, doping_level, review_reason,
needs_review, ...); quarantined ones have no page, those under review have one.

Defined cases: an id that isn't there, or is null, has no rows; a summary without variants has an empty list and a count of 0; a summary that names itself as
its parent is no variant; repeated ids in `ids` count once; empty tables give empty views. Columns are told by name, others are left alone.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T
from .timeline import QUARANTINE

VARIANT = ("id", "formula", "tc_max", "tc_ambient", "total_papers", "doping_level", "pressure_type")
VARIANTS_SHOWN = 100
HYDRIDE_ORDER = (("pressure_gpa", False), ("tc_kelvin", True), ("year", True), ("record_key", False))


def reachable(materials: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Summaries that have a page: not quarantined, and named by `ids` if it is given."""
    rows = materials.where("id is not null").where(~F.col("review_reason").eqNullSafe(F.lit(QUARANTINE)))
    return rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")


def _children(materials: DataFrame) -> DataFrame:
    return materials.where("parent_id is not null and id is not null and parent_id <> id")


def detail(materials: DataFrame, ids: DataFrame | None = None, most: int = VARIANTS_SHOWN) -> DataFrame:
    """Each reachable summary with variant_count, and `variants`: the `most` of highest value, nulls last, ties by id.

    A parent's variants are cut to `most` in each partition before they meet.
    """
    fields = [c for c in VARIANT if c in materials.columns]
    kids = _children(materials).select(F.col("parent_id").alias("_parent"), *fields)
    shown = T.top_k(kids, ["_parent"], [F.col("tc_max").desc_nulls_last(), F.col("id")], most, "_n")
    listed = shown.groupBy("_parent").agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*fields).alias("v"))))["v"].alias("variants"))
    counted = kids.groupBy(F.col("_parent").alias("_of")).agg(F.count("*").alias("variant_count"))
    rows = reachable(materials, ids).drop("variant_count", "variants")
    rows = rows.join(listed, F.col("id") == F.col("_parent"), "left").join(counted, F.col("id") == F.col("_of"), "left").drop("_parent", "_of")
    none = F.array().cast(listed.schema["variants"].dataType)
    return rows.withColumns({"variants": F.coalesce("variants", none), "variant_count": F.coalesce("variant_count", F.lit(0).cast("long"))})


def phase_points(materials: DataFrame, records: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(page_id, variant, formula, place, tc_kelvin, doping_level, pressure_gpa, paper_id, year): the records above 0 K of each reachable summary and of its
    variants. records: (id, place, ...); a record without a doping level has its summary's. A record is in two pages at most, its own and its parent's."""
    pages = reachable(materials, ids).select(F.col("id").alias("page_id")).distinct()
    own = materials.select(F.col("id").alias("page_id"), "id", "formula", F.col("doping_level").alias("_level"), F.lit(False).alias("variant"))
    kids = _children(materials).select(F.col("parent_id").alias("page_id"), "id", "formula", F.col("doping_level").alias("_level"), F.lit(True).alias("variant"))
    members = own.unionByName(kids).join(pages, "page_id", "left_semi")
    told = records.where("tc_kelvin > 0").withColumn("_said", F.col("doping_level") if "doping_level" in records.columns else F.lit(None).cast("double"))
    return members.join(told.select("id", "place", "tc_kelvin", "_said", "pressure_gpa", "paper_id", "year"), "id").select(
        "page_id", "variant", "formula", "place", "tc_kelvin", F.coalesce("_said", "_level").alias("doping_level"), "pressure_gpa", "paper_id", "year"
    )


def hydride_rows(materials: DataFrame, parameters: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Parameter rows (material_id, ...) of the summaries that have a page; HYDRIDE_ORDER is their order there."""
    pages = reachable(materials, ids).select(F.col("id").alias("material_id")).distinct()
    return parameters.join(pages, "material_id", "left_semi")


def beyond(order: tuple[tuple[str, bool], ...], last: dict) -> Column:
    """Whether a row stands after the row `last`; order: (column, descending), nulls last both ways. The columns together have to tell rows apart."""
    steps, same = [], []
    for name, descending in order:
        c, v = F.col(name), last[name]
        if v is not None:  # after a null nothing but nulls comes
            steps.append(reduce(and_, same, ((c < F.lit(v)) if descending else (c > F.lit(v))) | c.isNull()))
        same.append(c.eqNullSafe(F.lit(v)))
    return F.coalesce(reduce(or_, steps, F.lit(False)), F.lit(False))


def page_after(rows: DataFrame, order: tuple[tuple[str, bool], ...], last: dict | None = None, size: int = 50) -> DataFrame:
    """The next `size` rows after `last` (the last row of the page before, or None): a filter and a top-n that each partition takes part in, so that the
    thousandth page costs what the first one does, and rows that come in between are neither shown twice nor lost."""
    rest = rows if last is None else rows.where(beyond(order, last))
    return rest.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]).limit(size)
