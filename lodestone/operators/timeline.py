"""Time-line of values by year, ranked lists and phase tables of summaries with their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import conjunction, flat_records
from .summary import CALCULATED, MEASURED
from .tables import keep_first

QUARANTINE, TC_MOST = "provenance_quarantine_nims", 300.0


def is_theory(measurement: Column, paper_type: Column, pressure: Column) -> Column:
    """The time-line's own rule: a named technique decides, else the paper's type, which counts only under pressure."""
    m = F.lower(F.trim(F.coalesce(measurement, F.lit(""))))
    by_type = F.coalesce(F.lower(F.trim(paper_type)).isin("theoretical", "computational") & (pressure > 0), F.lit(False))
    return F.when(m.isin(*MEASURED), False).when(m.isin(*CALCULATED), True).otherwise(by_type)


def points(materials: DataFrame, papers: DataFrame, last_year: int, only_aps: bool = False, experimental_only: bool = False, records: DataFrame | None = None) -> DataFrame:
    """One point a (material, year, value to 0.1, whole pressure, theory), the first record by position; years missing in a record come
    from its paper. records: (id, place, fields), a row a record; without it the materials carry their records as an array."""
    told = flat_records(materials) if records is None else records
    told = told.select("id", F.col("place").alias("ord"), F.struct(*[c for c in told.columns if c not in ("id", "place")]).alias("r"))
    flat = materials.select("id", "formula", "family").join(told, "id")
    year_of = papers.select(F.col("id").alias("_p"), F.coalesce(F.year("date_published"), F.year("date_submitted")).alias("_y"))
    own = F.coalesce(F.nullif("r.year", F.lit(0)), F.nullif("r.measurement_year", F.lit(0)) if "measurement_year" in flat.select("r.*").columns else F.lit(None))
    flat = flat.withColumn("_own", own)
    undated = flat.where("_own is null").join(year_of, F.col("r.paper_id") == F.col("_p"), "left")  # only records without a year are shuffled to their papers
    rows = flat.where("_own is not null").unionByName(undated.drop("_p"), allowMissingColumns=True)
    year = F.coalesce("_own", "_y")
    rows = rows.select(
        "id", "formula", "family", "ord", F.col("r.tc_kelvin").alias("tc_kelvin"), year.cast("int").alias("year"), F.col("r.pressure_gpa").alias("pressure_gpa"),
        F.col("r.paper_id").alias("paper_id"), is_theory(F.col("r.measurement"), F.col("r.paper_type"), F.col("r.pressure_gpa")).alias("is_theoretical"),
    )
    rows = rows.where((F.col("tc_kelvin") > 0) & (F.col("tc_kelvin") <= TC_MOST) & F.col("year").between(1900, last_year + 1))
    rows = rows.where(conjunction(F.col("paper_id").startswith("aps:") if only_aps else None, ~F.col("is_theoretical") if experimental_only else None))
    keyed = rows.withColumns({"_t": F.bround("tc_kelvin", 1), "_b": F.bround("pressure_gpa", 0)})
    return keep_first(keyed, ["id", "year", "_t", "_b", "is_theoretical"], [F.col("ord")]).drop("_t", "_b", "ord")


def coverage(pts: DataFrame) -> DataFrame:
    """One row: points, materials and the span of years."""
    return pts.agg(
        F.count("*").alias("total_points"), F.count_distinct(F.struct("formula", "family")).alias("total_materials"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"),
    )


def visible(pending: bool = False) -> Column:
    """Quarantined rows never show; rows under review and rows without papers only on demand."""
    open_ = F.col("review_reason").isNull() | (F.col("review_reason") != QUARANTINE)
    return open_ if pending else open_ & ~F.col("needs_review") & (F.col("total_papers") > 0)


def listing(materials: DataFrame, families: str = "", tc_min: float | None = None, min_papers: int | None = None, aps: bool = False,
            max_tier: str | None = None, parents: bool = False, pending: bool = False, sort: str = "tc_max", offset: int = 0, limit: int = 50, records: DataFrame | None = None) -> DataFrame:
    """One page of summaries under optional filters, by one column descending, nulls last, ties by id; every row carries the total.

    records: (id, paper_id, ...), a row a record; without it the materials carry their records as an array.
    """
    wanted = [f.strip() for f in families.split(",") if f.strip()]
    rows = materials.where(conjunction(
        visible(pending),
        F.col("family").isin(wanted) if wanted else None,
        F.col("tc_max") >= tc_min if tc_min is not None else None,
        F.col("total_papers") >= min_papers if min_papers is not None else None,
        F.exists("records", lambda r: r["paper_id"].rlike("^aps:")) if aps and records is None else None,
        F.col("best_credibility_tier") <= max_tier if max_tier else None,
        F.col("parent_id").isNull() if parents else None,
    ))
    if aps and records is not None:
        rows = rows.join(records.where(F.col("paper_id").startswith("aps:")).select("id").distinct(), "id", "left_semi")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.col(sort).desc_nulls_last(), "id").offset(offset).limit(limit).join(total, F.lit(True))


def phase_table(materials: DataFrame, id: str, records: DataFrame | None = None) -> DataFrame:
    """The records of one material by pressure, value and year. records: (id, fields), a row a record, if materials carry no arrays."""
    flat = materials.where(F.col("id") == id).select(F.explode("records").alias("r")).select("r.*") if records is None else records.where(F.col("id") == id)
    return flat.orderBy(F.col("pressure_gpa").asc_nulls_last(), F.col("tc_kelvin").desc_nulls_last(), F.col("year").desc_nulls_last(), "paper_id")
