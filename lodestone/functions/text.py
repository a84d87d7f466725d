"""Text columns: labels, keyword and tag classes, author credits, snippets, identifiers, sentences. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import short_number

# Words that count for a paper's type.
CALCULATION_WORDS = (
    "first-principles", "first principles", "dft", "density functional", "eliashberg", "allen-dynes", "allen dynes", "electron-phonon",
    "electron phonon", "mcmillan", "phonon calculation", "ab initio", "ab-initio", "wannier", "epw",
)
EXPERIMENT_WORDS = (
    "single crystal", "thin film", "polycrystal", "polycrystalline", "resistivity measurement", "susceptibility", "specific heat", "musr", "μsr",
    "arpes", "stm", "scanning tunneling", "neutron scattering", "sample preparation", "synthesis", "x-ray diffraction", "xrd",
)
# Structure names, the first that matches counts.
PHASES = (
    (r"\b1212\b", "1212"), (r"\b2222\b", "2222"), (r"\b1313\b", "1313"), (r"infinite[- ]?layer", "infinite_layer"),
    (r"\bRuddlesden[- ]Popper\s*n\s*=\s*1\b", "RP_n1"), (r"\bRuddlesden[- ]Popper\s*n\s*=\s*2\b", "RP_n2"), (r"\bRuddlesden[- ]Popper\s*n\s*=\s*3\b", "RP_n3"),
    (r"(?i)\b(?:La214|LSCO|La2CuO4)\b", "cuprate_214"), (r"(?i)\b(?:YBCO|Y[- ]?123|YBa2Cu3O)\b", "cuprate_123"), (r"(?i)\bBi[- ]?2212\b", "cuprate_2212"),
    (r"(?i)\bBi[- ]?2223\b", "cuprate_2223"), (r"(?i)\bHg12(?:01|12|23)\b", "cuprate_Hg"), (r"(?i)\bTl[- ]?2212\b|\bTl[- ]?2223\b", "cuprate_Tl"),
)
# Tags and what they look like.
TAGS = {
    "superconduct": r"\bsuperconduct\w*\b", "josephson": r"\bjosephson\b", "andreev": r"\bandreev\b", "meissner": r"\bmeissner\b",
    "cooper_pair": r"\bcooper[-\s]?pair\w*\b", "squid": r"\bsquid\b", "transmon": r"\btransmon\w*\b", "cuprate": r"\bcuprate\w*\b|copper[-\s]?oxide",
    "pnictide": r"\bpnictide\w*\b|iron[-\s]?based", "nickelate": r"\bnickelate\w*\b", "hydride": r"\bhydride\w*\b",
    "mgb2": r"\bmg\s*b\s*2\b|\bmgb2\b|magnesium diboride", "heavy_fermion": r"heavy[-\s]?fermion", "organic": r"\borganic\b",
    "topological": r"\btopological\b|\bmajorana\b", "vortex": r"\bvort(?:ex|ices)\b|\babrikosov\b",
    "tc": r"\bT\s*c\b|\bcritical temperature\b|\btransition temperature\b", "pairing": r"\bpairing\b|\bd[-\s]?wave\b|\bs[-\s]?wave\b|\bp[-\s]?wave\b",
    "charge_density_wave": r"charge[-\s]?density[-\s]?wave|\bCDW\b",
}
MATERIAL_TAGS = ["cuprate", "pnictide", "nickelate", "hydride", "mgb2", "heavy_fermion", "organic", "tc", "charge_density_wave"]
DEVICE_TAGS = ["josephson", "andreev", "squid", "transmon", "topological"]
SOURCES = (("arxiv:", "arXiv:"), ("aps:", "DOI: "), ("doi:", "DOI: "), ("nims:", "NIMS:"))
PUBLICATION_TYPES = (("Review", "review"), ("MetaAnalysis", "review"), ("JournalArticle", "experimental"))
DOI = r"(?i)10\.\d{4,9}/[^\s\"<>]+"


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def source_label(paper_id: Column) -> Column:
    """Where a paper comes from, by the prefix of its id."""
    p = F.nullif(F.trim(paper_id), F.lit(""))
    return F.coalesce(*[F.when(p.startswith(a), F.concat(F.lit(b), F.substring(p, len(a) + 1, 1 << 20))) for a, b in SOURCES], p)


def hits(text: Column, words) -> Column:
    """How many of the words occur in text, lower case, as plain substrings."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words])


def keyword_class(text: Column, first, second, names=("computational", "experimental", "theoretical")) -> Column:
    """names[0] with two hits of `first` and no fewer than of `second`; names[1] with two of `second`; else names[2]."""
    a, b = hits(text, first), hits(text, second)
    return F.when((a >= 2) & (a >= b), names[0]).when(b >= 2, names[1]).otherwise(names[2])


def paper_type(title: Column, abstract: Column) -> Column:
    return keyword_class(F.concat_ws(" ", title, abstract), CALCULATION_WORDS, EXPERIMENT_WORDS)


def first_match(text: Column, patterns) -> Column:
    """Name of the first (pattern, name) found in text, null if none is."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for p, name in patterns])


def structure_phase(text: Column) -> Column:
    return first_match(text, PHASES)


def tags(text: Column, patterns: dict[str, str] = TAGS) -> Column:
    """Names of all patterns found, sorted; case does not count."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(name)) for name, p in sorted(patterns.items())]))


def _some(found: Column, *names: str) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, names)))


# Tags of which one makes a candidate; tags that do so only together with one of the second set.
ALWAYS_KEPT = ("superconduct", "josephson", "andreev", "meissner", "cooper_pair", "squid", "transmon", "cuprate", "pnictide", "nickelate", "mgb2")
KEPT_WITH = ((("hydride",), ("tc", "pairing", "vortex")), (("topological",), ("josephson", "andreev", "pairing")))
HOSTS = ("superconduct", "cuprate", "pnictide", "nickelate", "mgb2")


def worth_keeping(found: Column) -> Column:
    """Whether a set of tags makes a paper a candidate."""
    return any_of([_some(found, *ALWAYS_KEPT), *[_some(found, *a) & _some(found, *b) for a, b in KEPT_WITH]])


def candidate_class(found: Column) -> Column:
    likely = _some(found, *MATERIAL_TAGS) & _some(found, *HOSTS)
    return (
        F.when(likely, "materials_tc_likely").when(_some(found, *DEVICE_TAGS), "devices_or_theory")
        .when(_some(found, "superconduct"), "general_superconductivity").otherwise("keyword_candidate")
    )


def enum(value: Column, allowed, underscore: bool = False) -> Column:
    """value in lower case if it is one of the allowed ones, else null."""
    v = F.lower(F.trim(value))
    v = F.translate(v, "- ", "__") if underscore else v
    return F.when(v.isin(*allowed), v)


def author_names(authors: Column) -> Column:
    """Trimmed names of a list of texts, empty ones left out."""
    return F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a.isNotNull() & (a != ""))


def short_credit(authors: Column) -> Column:
    """A; A & B; A et al.; Unknown."""
    every = author_names(authors)
    last = F.filter(F.transform(every, lambda a: F.trim(F.split_part(a, F.lit(","), F.lit(1)))), lambda a: a != "")
    return (
        F.when(F.size(last) == 0, "Unknown").when(F.size(last) == 1, F.try_element_at(last, F.lit(1)))
        .when(F.size(every) > 2, F.concat(F.try_element_at(last, F.lit(1)), F.lit(" et al."))).otherwise(F.array_join(F.slice(last, 1, 2), " & "))
    )


def snippet(text: Column, most: int = 280) -> Column:
    """White space as single spaces, at most `most` characters and an ellipsis."""
    s = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, most)), F.lit("…")))


def doi(text: Column) -> Column:
    """The first DOI in a text or address, trailing punctuation off; null if there is none."""
    plain = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.nullif(F.rtrim(F.regexp_extract(plain, DOI, 0), F.lit(".,;)]}")), F.lit(""))


def shard(paper_id: Column) -> Column:
    """The yymm part of an arXiv id."""
    bare = F.regexp_replace(paper_id, r"^arxiv:", "")
    return F.when(bare.rlike(r"^\d{4}\."), F.substring(bare, 1, 4)).otherwise(F.nullif(F.regexp_extract(bare, r"/(\d{4})", 1), F.lit("")))


def plain_markup(text: Column) -> Column:
    """Tags gone, the five basic entities and numeric ones left to the reader of a page decoded, white space collapsed."""
    s = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def date_of_parts(parts: Column) -> Column:
    """A date from [year, month, day]; missing month or day is 1; no date if the parts make none."""
    at = lambda k, d: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(d).cast("int"))
    written = F.format_string("%04d-%02d-%02d", at(1, None), at(2, 1), at(3, 1))
    return F.when(at(1, None).isNotNull(), F.to_date(F.try_to_timestamp(written, F.lit("yyyy-MM-dd"))))


def geo_union(lists: Column) -> Column:
    """Distinct place names of many lists, case folded, in first spelling by order, sorted."""
    flat = F.filter(F.transform(F.flatten(lists), lambda x: F.trim(x)), lambda x: x != "")
    folded = F.array_distinct(F.transform(flat, lambda x: F.lower(x)))
    return F.array_sort(F.transform(folded, lambda k: F.array_min(F.filter(flat, lambda x: F.lower(x) == k))))


def geo_confidence(explicit: Column, inferred: Column, countries: Column) -> Column:
    return F.when(F.size(explicit) > 0, "high").when(F.size(inferred) > 0, "medium").when(F.size(countries) > 0, "low").otherwise("none")


# Offset and prime of the 32-bit hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def jitter(key: Column) -> Column:
    """A number in [-0.5, 0.5) from the 32-bit FNV-1a hash of the key's code points: marks of equal place on a chart spread alike each time."""
    points = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long"), F.lit(1 << 32))
    return F.aggregate(points, F.lit(FNV_OFFSET).cast("long"), step) / float(1 << 32) - 0.5


def fact_sentence(r: Column) -> Column:
    """One sentence on what a record says; null if it says nothing."""
    val = lambda c: F.nullif(r[c].cast("string"), F.lit(""))
    formula = F.nullif(F.trim(r["formula"]), F.lit(""))
    kind, level = F.when(r["doping_type"] != "none", val("doping_type")), F.concat(F.lit("x="), short_number(r["doping_level"]))
    doping = F.when(kind.isNotNull() | level.isNotNull(), F.concat(F.lit("doping: "), F.concat_ws(" ", kind, level)))
    tc, quals = r["tc_kelvin"], F.concat_ws(", ", val("method"), val("measurement"))
    cond, regime = F.coalesce(r["pressure_condition_normalized"], F.lit("")), F.coalesce(r["tc_regime"], F.lit(""))
    where = (
        F.when(r["pressure_gpa"] > 0, F.concat(F.lit(" at "), short_number(r["pressure_gpa"]), F.lit(" GPa")))
        .when((cond == "ambient") | (regime == "bulk_equilibrium"), " at ambient pressure")
        .when((cond == "high_pressure") | (regime == "high_pressure"), " under high pressure").otherwise("")
    )
    head = F.when(tc.isNotNull(), F.concat(F.lit(" has a critical temperature Tc = "), short_number(tc), F.lit(" K"))).otherwise(" is reported")
    first = F.concat(formula, head, F.when(quals != "", F.concat(F.lit(" ("), quals, F.lit(")"))).otherwise(""), where, F.lit("."))
    marks = F.concat_ws("; ", val("family"), val("crystal_structure"), val("sample_form"), doping)
    rest = F.coalesce(r["pressure_gpa"] != 0, F.lit(False)) | (marks != "") | val("comment").isNotNull()
    note = F.concat(F.lit("Note: "), val("comment"), F.lit("."))
    return F.when(formula.isNotNull() & (tc.isNotNull() | rest), F.concat_ws(" ", first, F.when(marks != "", F.concat(F.lit("["), marks, F.lit("]"))), note))


def fact_sentences(records: Column, most: int = 40) -> Column:
    """Sentences of an array of records, a paper's own before cited ones, at most `most`."""
    cited = lambda r: F.coalesce(r["evidence_type"] == "cited", F.lit(False))
    ordered = F.concat(F.filter(records, lambda r: ~cited(r)), F.filter(records, cited))
    return F.slice(F.array_compact(F.transform(ordered, fact_sentence)), 1, most)


def source_block(n: Column, title: Column, authors: Column, year: Column, section: Column) -> Column:
    """[n] title — authors (year) · section"""
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), title, F.lit(" — "), short_credit(authors), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(") · "), section)
