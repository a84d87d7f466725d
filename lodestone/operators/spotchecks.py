"""Checks on finished summaries that people read: those without a family, and a random sample of all.

Both take whole tables; a sample is drawn by a hash of the id and so the same whatever the partitions, but what a row is held against (rows of the same
signature) is looked for among all rows. Signatures are counted before they are shuffled, and rows are joined to counts, never to each other.

Defined cases: a null or empty formula has no elements and no signature, is refused as `empty`, and is never a near duplicate; equal formulas are no near
duplicates of each other; repeated ids count once in a signature; nulls in tc_max fail no check of values; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import formulas

from . import tables as T
from .rules import capped
from .summary import FAMILY_CEILING

# Compounds that are named beside superconductors without being any, and the limits of the checks.
MANGANITE_CATIONS = ["La", "Pr", "Nd", "Sm", "Y", "Ca", "Sr", "Ba", "Bi"]
SUBSTRATES = [
    "srtio3", "ktao3", "batio3", "laalo3", "mgo", "al2o3", "sio2", "pbtio3", "catio3", "latio3", "sno2", "tio2", "zno", "ga2o3",
]
NO_MATERIALS = ["o2", "n2", "h2o", "co2", "sio2", "nacl", "kcl"]
TELLS_NOTHING = ["conventional", "other", "elemental", "unknown"]
NOT_FORMULAS = ["descriptive_word", "concatenated_prose", "literal_placeholder", "generic_family_name", "trade_name_not_compound"]
NULL_FAMILY_MOST, ABSOLUTE_MOST, SIBLINGS = 40.0, 250.0, 3


def contaminant(formula: Column, elements: Column) -> Column:
    """What a formula is instead of a superconductor; null if it is nothing of the kind that is known."""
    has, low = lambda e: F.array_contains(elements, e), F.lower(F.trim(formula))
    manganite = has("Mn") & has("O") & F.arrays_overlap(elements, F.array(*map(F.lit, MANGANITE_CATIONS))) & ~has("Cu") & ~has("Fe")
    return F.when(manganite, "manganite_CMR_not_SC").when(low.isin(SUBSTRATES), "substrate_or_ferroelectric").when(low.isin(NO_MATERIALS), "non_material")


def _much_hydrogen(formula: Column) -> Column:
    counts = F.regexp_extract_all(F.regexp_replace(formula, r"[\^_{}$]", ""), F.lit(r"H(?![a-z])([0-9]*\.?[0-9]+)"), F.lit(1))
    return F.exists(counts, lambda c: c.try_cast("double") >= 2)


def _facts(summaries: DataFrame, family: Callable[[Column], Column]) -> DataFrame:
    """summaries with what the checks ask of a formula, worked out once a spelling."""
    return formulas.described(
        summaries, "formula", _elements=formulas.elements, _key=formulas.canonical, _reason=formulas.invalid_reason, _family=family, _hydrogen=_much_hydrogen,
        _letters=lambda c: F.nullif(formulas.signature(c), F.lit("")), _atoms=lambda c: F.nullif(formulas.ordered_elements(c), F.lit("")),
    )


def said_most(said: DataFrame) -> DataFrame:
    """(id, said): the family that most records of a summary name, ties to the first by name. said: (id, family), a row a record."""
    named = said.select("id", F.lower(F.trim("family")).alias("said")).where("said <> '' and said <> 'unknown'")
    n = named.groupBy("id", "said").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.min_by("said", F.struct(-F.col("n"), "said")).alias("said"))


def siblings(facts: DataFrame) -> DataFrame:
    """(_letters, others): the first formulas of each signature whose keys differ, one more than are shown, as a row's own is among them."""
    keys = facts.where("_letters is not null").groupBy("_letters", "_key").agg(F.lit(1).alias("_one")).groupBy("_letters").agg(F.count("*").alias("n")).where("n > 1")
    spelled = facts.join(keys.select("_letters"), "_letters", "left_semi").select("_letters", "formula").distinct()
    first = T.top_k(spelled, ["_letters"], [F.col("formula")], SIBLINGS + 1, "_n")
    return first.groupBy(F.col("_letters").alias("_of")).agg(F.array_sort(F.collect_list("formula")).alias("_others"))


def null_family(summaries: DataFrame, said: DataFrame, n: int | None = None, seed: int = 42, family: Callable[[Column], Column] = formulas.family) -> DataFrame:
    """(id, formula, tc_max, issues, tag) of the summaries that have papers but no family, or of n of them: what speaks against leaving it so.

    family: a rule that judges the formula afresh. The tag is that of the first issue; a row without issues is right as it is.
    """
    facts = _facts(summaries, family)
    rows = facts.where("family is null and total_papers > 0")
    rows = rows if n is None else T.sample(rows, "id", n, seed)
    rows = rows.join(said_most(said), "id", "left").join(siblings(facts), F.col("_letters") == F.col("_of"), "left")
    other = contaminant(F.col("formula"), F.col("_elements"))
    vote = F.when(F.col("_family").isNull() & other.isNull() & ~F.col("said").isin(TELLS_NOTHING), F.col("said"))
    hot = F.col("_family").isNull() & other.isNull() & ~F.coalesce("_hydrogen", F.lit(False)) & (F.col("tc_max") > NULL_FAMILY_MOST)
    near = F.slice(F.array_except("_others", F.array("formula")), 1, SIBLINGS)
    found = [
        ("CONTAMINANT", other), ("FAMILY_MISCLASS", F.concat(F.lit("misclassified_should_be_"), "_family")), ("NER_VERIFY", F.concat(F.lit("NER_says_"), vote, F.lit("_verify"))),
        ("TC_IMPLAUSIBLE", F.when(hot, F.concat(F.lit("implausible_tc_"), F.round("tc_max", 3).cast("string"), F.lit("K_on_null")))),
        ("NEAR_DUP", F.when(F.col("_of").isNotNull(), F.concat(F.lit("near_dup("), F.array_join(near, ","), F.lit(")")))),
        ("FORMULA_ODD", F.concat(F.lit("formula_reject_"), "_reason")),
    ]
    tag = F.coalesce(*[F.when(issue.isNotNull(), F.lit(name)) for name, issue in found], F.lit("correctly_null"))
    return rows.select("id", "formula", "tc_max", F.array_compact(F.array(*[issue for _, issue in found])).alias("issues"), tag.alias("tag"))


CLASSES = {"A": True, "B": True, "B-soft": False, "C": True, "C-miss": False, "D": True, "D-xprov": False}


def spot_check(summaries: DataFrame, n: int | None = 100, seed: int = 42, family: Callable[[Column], Column] = formulas.family) -> DataFrame:
    """(id, formula, classes) of n summaries by a hash of their ids, or of all (n None): A no formula, B an implausible value (soft: a headline from theory
    alone), C another family than the formula's own rule says (miss: none), D the same atoms under another id of the same prefix (xprov: of another)."""
    facts = _facts(summaries, family).withColumn("_prefix", F.split_part("id", F.lit(":"), F.lit(1)))
    pairs = facts.where("_atoms is not null").groupBy("_atoms", "_prefix", "id").agg(F.lit(1).alias("_one")).groupBy("_atoms", "_prefix").agg(F.count("*").alias("_same"))
    every = pairs.groupBy(F.col("_atoms").alias("_a")).agg(F.sum("_same").alias("_every"))
    rows = facts if n is None else T.sample(facts, "id", n, seed)
    own = pairs.select(F.col("_atoms").alias("_b"), F.col("_prefix").alias("_q"), "_same")
    rows = rows.join(every, F.col("_atoms") == F.col("_a"), "left").join(own, (F.col("_atoms") == F.col("_b")) & (F.col("_prefix") == F.col("_q")), "left")
    tc, stored, fresh = F.col("tc_max"), F.nullif("family", F.lit("")), F.col("_family")
    high = (tc > ABSOLUTE_MOST) | F.coalesce(tc > capped(FAMILY_CEILING, stored), F.lit(False))
    theory = (F.col("dominant_evidence") == "theoretical") & F.col("tc_max_experimental").isNull() & tc.isNotNull()
    classes = [
        F.when((F.size("_elements") <= 0) | F.col("formula").isNull() | F.col("_reason").isin(NOT_FORMULAS), "A"), F.when(high, "B").when(theory, "B-soft"),
        F.when(fresh != stored, "C").when(fresh.isNotNull() & stored.isNull(), "C-miss"), F.when(F.col("_same") > 1, "D").when(F.col("_every") > 1, "D-xprov"),
    ]
    return rows.select("id", "formula", F.array_compact(F.array(*classes)).alias("classes"))


def tally(checked: DataFrame) -> DataFrame:
    """(class, hard, n, pct) of a spot check, with all rows that have a hard problem as `hard`; one row without a class is only part of the percentages."""
    some = F.arrays_overlap("classes", F.array(*[F.lit(c) for c, hard in CLASSES.items() if hard]))
    counts = {c: F.count_if(F.array_contains("classes", c)) for c in CLASSES} | {"hard": F.count_if(some)}
    one = T.stack_metrics(checked, counts | {"rows": F.count("*")})
    rows = checked.agg(F.count("*").alias("_all"))
    hard = F.col("metric").isin([c for c, h in CLASSES.items() if h] + ["hard"])
    return one.where("metric <> 'rows'").join(rows, F.lit(True)).select(
        F.col("metric").alias("class"), hard.alias("hard"), F.col("value").cast("long").alias("n"), F.round(F.try_divide(100 * F.col("value"), F.col("_all")), 2).alias("pct")
    )
