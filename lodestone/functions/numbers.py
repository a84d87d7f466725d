"""Number columns: reading numbers out of text, short printing, physical checks, vector measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = r"^\s*([-+]?\d*\.?\d+)\s*[-–—]\s*([-+]?\d*\.?\d+)"
NUMBER = r"[-+]?\d*\.?\d+"
# Kelvin in one unit of each.
KELVIN = {"K": 1.0, "meV": 11.6045, "cm^-1": 1.43877, "THz": 47.9924}


def read_number(text: Column) -> Column:
    """A number as such; the middle of a range; else the first number in the text; null if there is none."""
    low, high = (F.regexp_extract(text, RANGE, k).try_cast("double") for k in (1, 2))
    return F.coalesce(text.try_cast("double"), (low + high) / 2, F.regexp_extract(text, NUMBER, 0).try_cast("double"))


def short_number(c: Column) -> Column:
    """Up to six significant digits, no trailing zeros."""
    d = c.cast("double")
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(d)))))
    text = (F.bround(d * scale, 0) / scale).cast("decimal(38,15)").cast("string")
    return F.when(d == 0, "0").otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def to_kelvin(value: Column, unit: Column) -> Column:
    factor = F.try_element_at(F.create_map(*[F.lit(x) for p in KELVIN.items() for x in p]), F.coalesce(unit, F.lit("K")))
    return value * factor


def coupling_estimate(lam: Column, mu: Column, omega: Column) -> Column:
    """Critical temperature from coupling, screening and mean phonon temperature; null where the formula has no value."""
    below = lam - mu * (1 + 0.62 * lam)
    return F.when(below > 0, omega / 1.2 * F.exp(-1.04 * (1 + lam) / below))


def coupling_flags(tc: Column, lam: Column, mu: Column, omega: Column, most: float = 0.6) -> Column:
    """What is wrong with a stated critical temperature against the estimate, as an array of flags."""
    given = lam.isNotNull() & mu.isNotNull() & omega.isNotNull()
    est = coupling_estimate(lam, mu, omega)
    return F.array_compact(F.array(
        F.when(given & (lam - mu * (1 + 0.62 * lam) <= 0), "allen_dynes_denominator_nonpositive"),
        F.when(given & (tc > 0) & (F.abs(est - tc) / F.greatest(tc, F.lit(1.0)) > most), "allen_dynes_mismatch"),
    ))


# What a hydride record may say.
HYDRIDE_RANGES = {"tc_kelvin": (0.01, 400.0), "pressure_gpa": (0.0, 500.0), "lambda_eph": (0.01, 10.0), "mu_star": (0.0, 0.5), "omega_log_k": (1.0, 5000.0)}


def hydride_fit(tc: Column, pressure: Column, lam: Column, mu: Column, omega: Column) -> Column:
    """Whether a record is in range and says more than its critical temperature."""
    cols = dict(zip(HYDRIDE_RANGES, (tc, pressure, lam, mu, omega)))
    inside = tc.between(*HYDRIDE_RANGES["tc_kelvin"])
    for name, c in list(cols.items())[1:]:
        inside &= c.isNull() | c.between(*HYDRIDE_RANGES[name])
    return F.coalesce(inside, F.lit(False)) & (pressure.isNotNull() | lam.isNotNull() | mu.isNotNull() | omega.isNotNull())


def capped_confidence(tc: Column, confidence: Column) -> Column:
    """An implausible critical temperature lowers the confidence to 0.3."""
    return F.when(((tc > 300) | (tc < 0.01)) & (confidence >= 0.3), F.lit(0.3)).otherwise(confidence)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector has no length."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
