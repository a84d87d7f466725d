"""Harvesting and upkeep of the corpus: bibliographic items, imports, hydride records, consolidation, retrieval, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import formulas, numbers, text
from lodestone.session import materialised

from . import tables as T

# Journals by the token of their DOI; what is not harvested; publication types and the paper types they mean.
JOURNALS = {
    "PhysRev": ("Physical Review", "PR"), "PhysRevLett": ("Physical Review Letters", "PRL"), "PhysRevA": ("Physical Review A", "PRA"),
    "PhysRevB": ("Physical Review B", "PRB"), "PhysRevC": ("Physical Review C", "PRC"), "PhysRevD": ("Physical Review D", "PRD"),
    "PhysRevE": ("Physical Review E", "PRE"), "PhysRevX": ("Physical Review X", "PRX"), "RevModPhys": ("Reviews of Modern Physics", "RMP"),
    "PhysRevApplied": ("Physical Review Applied", "PRApplied"), "PhysRevMaterials": ("Physical Review Materials", "PRMaterials"),
    "PhysRevFluids": ("Physical Review Fluids", "PRFluids"), "PhysRevAccelBeams": ("Physical Review Accelerators and Beams", "PRAB"),
    "PhysRevResearch": ("Physical Review Research", "PRResearch"), "PhysRevPhysEducRes": ("Physical Review Physics Education Research", "PRPER"),
    "PRXQuantum": ("PRX Quantum", "PRXQuantum"), "PRXEnergy": ("PRX Energy", "PRXEnergy"), "PRXLife": ("PRX Life", "PRXLife"),
}
FIRST_JOURNALS, SECOND_JOURNALS, EXCLUDED_JOURNALS = ["PRB", "PRL", "PRX", "PRResearch", "PRMaterials"], ["PRApplied", "RMP", "PRXQuantum", "PRA"], [
    "Physics", "PRPER",
]
EXCLUDED_DOI, LEGACY_DOI, LEGACY_YEAR = "10.1103/PhysRevFocus.", r"(?i)^10\.1103/[A-Z][A-Z0-9]*\.\d+\.[A-Z]?\d+[A-Z]?(?:\.\d+)?$", 2001
PUBLICATION_TYPES = {
    "JournalArticle": "experimental", "Conference": "experimental", "Review": "review", "CaseReport": "experimental", "ClinicalTrial": "experimental",
    "Editorial": "review", "LettersAndComments": "experimental", "MetaAnalysis": "review", "Study": "experimental", "Book": "review",
    "BookSection": "review", "Dataset": "computational",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def given(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def journal(doi: Column) -> Column:
    """struct(name, abbrev) of a DOI, both null for a journal that is not known."""
    token = F.regexp_extract(F.trim(doi), r"(?i)^(?:https?://doi\.org/|doi:)?10\.1103/([^.]*)", 1)
    return F.struct(F.try_element_at(_map({k: v[0] for k, v in JOURNALS.items()}), token).alias("name"), F.try_element_at(_map({k: v[1] for k, v in JOURNALS.items()}), token).alias("abbrev"))


def reject_reason() -> Column:
    """Why an item (abbrev, doi, volume, issue, article_number, page, year) is not harvested; null if it is."""
    legacy = (F.col("year") <= LEGACY_YEAR) & F.col("doi").rlike(LEGACY_DOI)
    return F.coalesce(
        F.when(F.col("abbrev").isin(*EXCLUDED_JOURNALS), F.concat(F.lit("excluded_journal:"), F.col("abbrev"))),
        F.when(F.lower("doi").startswith(EXCLUDED_DOI.lower()), F.lit(f"excluded_doi_prefix:{EXCLUDED_DOI}")),
        F.when(~given("volume"), F.lit("missing_volume")),
        F.when(~given("issue"), F.lit("missing_issue")),
        F.when(~given("article_number") & ~given("page") & ~F.coalesce(legacy, F.lit(False)), F.lit("missing_locator")),
    )


def in_window(published: Column, first: str = "1986-01-01", last: str = "2026-12-31") -> Column:
    """Published between two days; without a date it is not."""
    return F.coalesce(published.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))


def priority(abbrev: Column, kind: Column) -> Column:
    return F.when(abbrev.isin(*FIRST_JOURNALS), F.when(kind == "devices_or_theory", "P1").otherwise("P0")).when(abbrev.isin(*SECOND_JOURNALS), "P1").otherwise("P2")


def build_manifest(items: DataFrame, known: DataFrame) -> DataFrame:
    """One row a DOI of items found by several queries: tags united, best score, class, priority, whether `known` (doi, id) has it; in harvest order."""
    rows = items.withColumn("doi", text.doi(F.col("doi"))).where("doi is not null").withColumn("tags", text.tags(F.concat_ws(" ", "title", "abstract")))
    one = rows.groupBy("doi").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.max("score").alias("score"), F.min("year").alias("year"),
        *[F.max(c).alias(c) for c in ("volume", "issue", "article_number", "page")], F.array_sort(F.collect_set("query")).alias("queries"),
    )
    one = one.where(text.worth_keeping(F.col("tags"))).withColumn("abbrev", journal(F.col("doi"))["abbrev"])
    one = one.withColumns({"class": text.candidate_class(F.col("tags")), "reject": reject_reason()})
    have = known.where("doi is not null").groupBy(F.lower("doi").alias("_d")).agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("known_ids"))
    out = one.withColumn("priority", priority(F.col("abbrev"), F.col("class"))).join(have, F.lower("doi") == F.col("_d"), "left").drop("_d")
    return out.orderBy("priority", "class", "year", "abbrev", "doi")


def mapped_type(types: Column) -> Column:
    """Paper type of a list of publication types: a review wins, else the first that is known."""
    known = F.transform(types, lambda t: F.try_element_at(_map(PUBLICATION_TYPES), t))
    return F.when(F.array_contains(types, "Review"), "review").otherwise(F.try_element_at(F.array_compact(known), F.lit(1)))


def enrich(papers: DataFrame, news: DataFrame) -> DataFrame:
    """papers with news (id, doi, citation_count, journal, types): empty fields are filled, counts above 0 and types replace."""
    n = news.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("doi", "citation_count", "journal", "types")])
    j = papers.join(n, F.col("id") == F.col("_id"), "left")
    new = {
        "doi": F.coalesce(F.nullif("doi", F.lit("")), "_doi"), "journal": F.coalesce("journal", "_journal"),
        "citation_count": F.when(F.col("_citation_count") > 0, F.col("_citation_count")).otherwise(F.col("citation_count")),
        "paper_type": F.coalesce(mapped_type(F.col("_types")), "paper_type"),
    }
    return j.withColumns(new).select(*papers.columns)


def stale(stamp: Column, days: int, now: Column, force: bool = False) -> Column:
    """Never synchronised, or longer ago than `days`."""
    return F.lit(True) if force else stamp.isNull() | (stamp < now - F.make_interval(days=F.lit(days)))


def unsearchable(formula: Column) -> Column:
    """Why a formula can't be looked up in a materials table; null if it can."""
    return F.coalesce(
        F.when(formula.isNull() | (formula == ""), "empty"),
        F.when(formula.rlike(r"[\s$/=:;×√]"), "non_formula_text"),
        F.when(formula.rlike(r"[,δ]|\([^)]*[A-Z][a-z]?,"), "alloy_or_variable_stoichiometry"),
        F.when(formula.rlike(r"[A-Z][a-z]?_?\d*\.\d"), "decimal_subscript"),
        F.when(formula.rlike(r"[{}]"), "variable_subscript"),
        F.when(~formula.rlike("[A-Z]"), "no_element_symbol"),
    )


def best_match(hits: DataFrame, key: str) -> DataFrame:
    """(key, primary, alternates): ids of the hits of each key by energy above hull, missing ones last."""
    order = F.struct(F.coalesce(F.col("energy_above_hull"), F.lit(float("inf"))).alias("e"), F.col("material_id").alias("id"))
    one = hits.where("material_id is not null").groupBy(key).agg(F.array_sort(F.collect_list(order))["id"].alias("alternates"))
    return one.select(key, F.try_element_at("alternates", F.lit(1)).alias("primary"), "alternates")


def import_rows(rows: DataFrame) -> DataFrame:
    """Imported rows (formula, tc, pressure, structure, reference as text) -> one summary a formula."""
    said = materialised(rows.select(F.explode(F.array("tc", "pressure")).alias("_said")).distinct().withColumn("_n", numbers.read_number(F.col("_said"))), "numbers")  # each text is read once
    r = formulas.described(rows, "formula", True, key=formulas.canonical)
    for c in ("tc", "pressure"):
        r = r.join(said.withColumnsRenamed({"_said": f"_said_{c}", "_n": f"_{c}"}), F.col(c) == F.col(f"_said_{c}"), "left")
    r = r.select("formula", "key", F.col("_tc").alias("tc"), F.col("_pressure").alias("pressure"), F.nullif(F.trim("structure"), F.lit("")).alias("structure"), F.nullif(F.trim("reference"), F.lit("")).alias("reference"))
    r = r.where("key <> ''")
    spoken = F.concat_ws(", ", F.when(F.col("pressure") != 0, F.concat(F.lit("P="), F.col("pressure").cast("string"), F.lit(" GPa"))), "structure")
    ambient = F.max(F.when(F.coalesce("pressure", F.lit(0.0)) == 0, F.col("tc")))
    s = r.groupBy("key").agg(
        F.min("formula").alias("formula"), F.max("tc").alias("tc_max"), F.max_by(F.nullif(spoken, F.lit("")), F.struct("tc", "reference", "structure")).alias("tc_max_conditions"),
        ambient.alias("tc_ambient"), F.when(ambient.isNotNull(), True).when(F.count("tc") > 0, False).alias("ambient_sc"),
        F.mode("structure", True).alias("crystal_structure"), F.when(F.max(F.col("pressure") > 0), "hydrostatic").alias("pressure_type"),
        F.count_distinct("reference").alias("total_papers"), F.count("*").alias("records"),
    )
    return s.withColumns({"id": formulas.entity_id(F.col("key"), "nims"), "family": formulas.family(F.col("formula"))})


def five_digits(c: Column) -> Column:
    """A number with five significant digits at most, plain form, empty if null."""
    return F.coalesce(numbers.short_number(F.bround(c * F.pow(F.lit(10.0), 4 - F.floor(F.log10(F.abs(F.nullif(c, F.lit(0.0)))))), 0) / F.pow(F.lit(10.0), 4 - F.floor(F.log10(F.abs(F.nullif(c, F.lit(0.0))))))), F.when(c == 0, "0"), F.lit(""))


def record_key(paper: Column, key: Column, method: Column, *values: Column) -> Column:
    parts = [paper, F.coalesce(key, F.lit("")), *map(five_digits, values), F.coalesce(method, F.lit(""))]
    return F.concat(F.lit("hydride:"), F.sha1(F.concat_ws("|", *parts).cast("binary")))


def hydrides(raw: DataFrame) -> DataFrame:
    """Raw hydride records (text fields, paper_id) -> one row a record key, the most confident: cleaned, in range, with flags."""
    n = {c: numbers.read_number(F.col(c)) for c in ("tc_kelvin", "pressure_gpa", "lambda_eph", "mu_star", "omega_log_source_value", "omega_log_k", "confidence")}
    r = raw.withColumn("formula", F.regexp_replace("formula", r"(?U)\s+", "")).withColumns(n)
    r = r.withColumn("omega_log_k", F.coalesce("omega_log_k", numbers.to_kelvin(F.col("omega_log_source_value"), F.col("omega_log_source_unit"))))
    cols = [F.col(c) for c in ("tc_kelvin", "pressure_gpa", "lambda_eph", "mu_star", "omega_log_k")]
    r = formulas.described(r, "formula", True, key=formulas.canonical, _fine=lambda f: formulas.invalid_reason(f).isNull() & f.rlike("[HD](?![a-z])"))
    r = r.where(F.col("_fine") & numbers.hydride_fit(*cols)).drop("_fine")
    r = r.withColumns({
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")),
        "flags": numbers.coupling_flags(cols[0], cols[2], cols[3], cols[4]),
        "evidence_type": text.enum(F.col("evidence_type"), ("primary_theoretical", "primary_experimental", "cited")),
    })
    r = r.withColumn("record_key", record_key(F.col("paper_id"), F.col("key"), F.col("method"), *cols))
    return T.keep_best(r, ["record_key"], "confidence", F.col("paper_id"), F.col("formula"))


def llm_reply(reply: Column, schema: str, field: str = "materials") -> Column:
    """The list in a model's reply: fences off, a bare list or one under `field`; null if it is neither."""
    bare = F.trim(F.regexp_replace(reply, r"(?m)^```(?:json)?\s*|\s*```$", ""))
    listed, wrapped = F.from_json(bare, schema), F.from_json(F.get_json_object(bare, f"$.{field}"), schema)
    return F.when(bare.startswith("["), listed).when(bare.startswith("{"), wrapped)


def consolidate(rows: DataFrame) -> DataFrame:
    """Rows (id, formula) under their present key: unchanged, rekey or merge, and whether a merge holds different sets of elements."""
    prefix = F.when(F.col("id").startswith("nims:"), "nims").otherwise("mat")
    key = formulas.canonical(F.coalesce("formula", F.lit("")))
    new = F.when(key == "", F.col("id")).otherwise(F.when(prefix == "nims", formulas.entity_id(key, "nims")).otherwise(formulas.entity_id(key)))
    els = F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace("formula", r"[δΔ]|[Dd]elta|[±*·⋅(){}\[\]$_]", ""), F.lit("[A-Z][a-z]?"), F.lit(0))))
    g = rows.withColumns({"new_id": new, "els": els}).groupBy("new_id").agg(
        F.array_sort(F.collect_list("id")).alias("old_ids"), F.count_distinct(F.when(F.size("els") > 0, F.col("els"))).alias("kinds")
    )
    plan = F.when(F.size("old_ids") > 1, "merge").when(F.try_element_at("old_ids", F.lit(1)) != F.col("new_id"), "rekey").otherwise("unchanged")
    return g.select("new_id", "old_ids", plan.alias("plan"), (F.col("kinds") > 1).alias("hetero"))


def retrieve(hits: DataFrame, chunks: DataFrame, papers: DataFrame, most: int = 8) -> DataFrame:
    """Hits (query_id, vec_id, distance) with their chunk and paper: retracted papers skipped, numbered 1.. after that, at most `most` a query."""
    live = papers.where("status is null or status <> 'retracted'").select(F.col("id").alias("_p"), "title", "authors", "year")
    j = hits.join(chunks, "vec_id").join(live, F.col("paper_id") == F.col("_p")).drop("_p")
    top = T.top_k(j, ["query_id"], [F.col("distance"), F.col("vec_id")], most, "n")
    return top.withColumns({"block": text.source_block(F.col("n"), F.col("title"), F.col("authors"), F.col("year"), F.col("section")), "snippet": text.snippet(F.col("text"))})


def completed(ratings: DataFrame, raters: DataFrame, item: str, rater: str) -> DataFrame:
    """1 or 0 for every item that anyone names and every rater: the dense matrix that agreement needs, as many rows as items times raters."""
    named = ratings.select(item, rater).distinct().withColumn("_said", F.lit(1))
    grid = ratings.select(item).distinct().join(raters.select(rater).distinct())
    return grid.join(named, [item, rater], "left").select(item, rater, F.coalesce("_said", F.lit(0)).alias("said"))


def dashboard(papers: DataFrame, materials: DataFrame, chunks: DataFrame) -> DataFrame:
    """(metric, value): the numbers of the landing page, a scan a table."""
    counts = [
        T.stack_metrics(papers, {"papers": F.count("*"), "retracted": F.count_if(F.col("status") == "retracted")}),
        T.stack_metrics(materials, {"materials": F.count("*"), "pending": F.count_if("needs_review"), "families": F.count_distinct("family"), "highest_tc": F.max("tc_max")}),
        T.stack_metrics(chunks, {"chunks": F.count("*")}),
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def same_work(papers: DataFrame, preprint: str = "arxiv") -> DataFrame:
    """papers (id, source, doi, title) with related_id: of a work that shares a DOI, or else a title (letters and digits, case folded),
    the least id of the published version; null for that version itself and where there is none. One row a work is shuffled besides."""
    key = F.coalesce(F.nullif(F.lower("doi"), F.lit("")), F.nullif(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", ""), F.lit("")))
    rows = papers.withColumn("_work", key)
    best = rows.where((F.col("source") != preprint) & F.col("_work").isNotNull()).groupBy(F.col("_work").alias("_w")).agg(F.min("id").alias("_best"))
    return rows.join(best, F.col("_work") == F.col("_w"), "left").withColumn("related_id", F.when(F.col("_best") != F.col("id"), F.col("_best"))).drop("_work", "_w", "_best")
