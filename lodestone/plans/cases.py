"""Cases with known answers: every part is given one of them, and each function must say the known answer for all parts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import formulas, numbers, text
from lodestone.operators import harvest, summary, timeline, vectors

from .registry import register


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def cases(name: str, doc: str, inputs: list, **columns) -> None:
    """Register name: part p gets input p mod n; each column is (function of the input, type, known answers). Rows are counted by input and answers."""
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

    def run(t, spark):
        raw = F.array(*[F.lit(x).cast("string") for x in inputs])
        rows = t("part").select(F.element_at(raw, (F.col("p_partkey") % len(inputs) + 1).cast("int")).alias("raw"))
        said = formulas.described(rows, "raw", **{c: f for c, (f, _, _) in columns.items()})
        return said.groupBy("raw", *columns).agg(F.count("*").alias("n"))

    run.__name__, run.__doc__ = name, doc
    values = ", ".join("(" + ", ".join([str(i), _sql(x), *[_sql(known[i]) for _, _, known in columns.values()]]) + ")" for i, x in enumerate(inputs))
    typed = ", ".join(f"{c}::{kinds[kind]} AS {c}" for c, (_, kind, _) in columns.items())
    register(run, f"SELECT raw::VARCHAR AS raw, {typed}, count(*) AS n FROM part JOIN (VALUES {values}) k(i, raw, {', '.join(columns)}) ON p_partkey % {len(inputs)} = i GROUP BY ALL")


def _part(c: Column, i: int) -> Column:
    """Field i of an input whose fields are parted by bars, an empty one as null."""
    return F.nullif(F.split_part(c, F.lit("|"), F.lit(i)), F.lit(""))


def _number(c: Column, i: int) -> Column:
    return _part(c, i).try_cast("double")


KEYS = {
    "Bi_2Sr_2CaCu_2O_{8+δ}": ("bi2sr2cacu2o8", "Bi2Sr2CaCu2O8+δ", "mat:bi2sr2cacu2o8"),
    "Bi2Sr2CaCu2O8+delta": ("bi2sr2cacu2o8", "Bi2Sr2CaCu2O8+delta", "mat:bi2sr2cacu2o8"),
    "Bi_2Sr_2Ca Cu_2 O_8-δ": ("bi2sr2cacu2o8", "Bi2Sr2Ca Cu2 O8-δ", "mat:bi2sr2cacu2o8"),
    "YBa_2Cu_3O_7-δ": ("yba2cu3o7", "YBa2Cu3O7-δ", "mat:yba2cu3o7"),
    "MgB_2": ("mgb2", "MgB2", "mat:mgb2"),
    "MgB₂": ("mgb2", "MgB₂", "mat:mgb2"),
    "κ-(BEDT-TTF)_2Cu(NCS)_2": ("κ-(bedtttf)2cu(ncs)2", "κ-(BEDT-TTF)2Cu(NCS)2", "mat:κ-(bedtttf)2cu(ncs)2"),
    "YBCO": ("yba2cu3o7", "YBCO", "mat:yba2cu3o7"),
    "2H-NbSe2": ("nbse2", "2H-NbSe2", "mat:nbse2"),
    "(La)(Fe)As": ("lafeas", "(La)(Fe)As", "mat:lafeas"),
    "Ba(Fe1−xCox)2As2": ("ba(fe1-xcox)2as2", "Ba(Fe1−xCox)2As2", "mat:ba(fe1-xcox)2as2"),
    "[[Fe]Se]": ("fese", "[[Fe]Se]", "mat:fese"),
    "(((((((((La)))))))))Fe": ("lafe", "(((((((((La)))))))))Fe", "mat:lafe"),
    "Na0.35CoO2·1.3H2O": ("na0.35coo21.3h2o", "Na0.35CoO2·1.3H2O", "mat:na0.35coo21.3h2o"),
    "O_{7}^{2-}": ("o7", "O7^2-", "mat:o7"),
    "": ("", "", "mat:"),
    "A" * 91: ("a" * 91, "A" * 91, "mat:" + "a" * 80 + ":" + hashlib.sha1(b"a" * 91).hexdigest()[:8]),
}
cases(
    "formula_keys", "T1, T7, T8, T9: key, display form and id of a formula as written.", list(KEYS),
    key=(formulas.canonical, "string", [v[0] for v in KEYS.values()]), shown=(formulas.display, "string", [v[1] for v in KEYS.values()]),
    id=(lambda c: formulas.entity_id(formulas.canonical(c)), "string", [v[2] for v in KEYS.values()]),
)

REASONS = {
    "MgB2": None, "YBa2Cu3O7-δ": None, "κ-(BEDT-TTF)2Cu[N(CN)2]Br": None, "LaH10": None, "La2-xSrxCuO4": None, "Na": None, None: "empty", " ": "empty",
    "None": "literal_placeholder", "HOPG": "trade_name_not_compound", "H": "single_element_symbol", "cuprates": "generic_family_name", "B" * 101: "too_long",
    "abc": "no_uppercase_element", "La_2": "forbidden_char", "bilayer FeSe": "descriptive_word", "FeSemonolayer": "descriptive_word", "Ba(x=0.1)": "condition_descriptor",
    "1T-TaS2": "invalid_start", "Sr-Ru-O": "system_designator_not_compound", "Fm-3m-CeH10": "phase_prefix_in_formula", "YBa2Cu3O7-": "incomplete_or_charged_formula",
    "Xabcdefghijklm": "concatenated_prose",
}
cases("formula_validity", "T6: why a text is no formula.", list(REASONS), reason=(formulas.invalid_reason, "string", list(REASONS.values())))

FAMILIES = {
    "MgB2": ("mgb2", False), "LaH10": ("hydride", None), "H3S": ("hydride", None), "K3C60": ("fulleride", None), "CsV3Sb5": ("kagome", True), "LaFeAsO": ("iron_based", True),
    "FeSe": ("iron_based", True), "YBa2Cu3O7": ("cuprate", True), "BSCCO": ("cuprate", True), "La3Ni2O7": ("nickelate", True), "CeCoIn5": ("heavy_fermion", True),
    "UTe2": ("heavy_fermion", True), "YNi2B2C": ("borocarbide", False), "Sr2RuO4": ("ruthenate", True), "NbSe2": ("chalcogenide", None), "Nb": ("elemental", False),
    "Nb3Sn": ("conventional", False), "Ba0.6K0.4BiO3": ("bismuthate", None), "LaO0.5F0.5BiS2": ("bis2_layered", None), "κ-(BEDT-TTF)2Cu(NCS)2": ("organic", True),
    "CeRu2": (None, None), "Xx9": (None, None),
}
cases(
    "formula_families", "T4, T5: family, and whether its pairing is settled.", list(FAMILIES),
    family=(formulas.family, "string", [v[0] for v in FAMILIES.values()]), unconventional=(lambda c: formulas.unconventional(formulas.family(c)), "boolean", [v[1] for v in FAMILIES.values()]),
)

MARKS = {
    "MgB2": ("Mg,B", "mgb2", "B2Mg"), "2H-NbSe2": ("Nb,Se", "2hnbse2", "H-"), "La2-xSrxCuO4": ("La,Sr,Cu,O", "la2xsrxcuo4", "CuLa2O4Sr"), "LaH10": ("La,H", "lah10", "H10La"),
    "Nb3 Sn": ("Nb,Sn", "nb3sn", "Nb3Sn"), "O8": ("O", "o8", "O8"),
}
MARKS["2H-NbSe2"] = ("Nb,Se", "2hnbse2", "HNbSe2")
cases(
    "formula_marks", "T46, T47: elements, signature and element order.", list(MARKS),
    elements=(lambda c: F.array_join(formulas.elements(c), ","), "string", [v[0] for v in MARKS.values()]),
    signature=(formulas.signature, "string", [v[1] for v in MARKS.values()]), ordered=(formulas.ordered_elements, "string", [v[2] for v in MARKS.values()]),
)

RELATIONS = {
    "yba2cu3o6.95": ("yba2cu3o7", None, None), "la1.85sr0.15cuo4": ("la2-xsrxcuo4", None, None), "ba(fe0.92co0.08)2as2": ("bafe2as2", None, None),
    "bi2sr2cacu2o8.15": ("bi2sr2cacu2o8", None, None), "mgb2": ("mgb2", None, None), "(hg0.8re0.2)ba2cuo4": ("hgba2cuo4", None, None),
    "fese/srtio3": ("fese/srtio3", "fese", "srtio3"), "srtio3/fese": ("srtio3/fese", "fese", "srtio3"), "bi2se3/nbse2": ("bi2se3/nbse2", "bi2se3", "nbse2"),
    "li5/6bc": ("li5/6bc", None, None), "na0.3coo21.4(h/d)2o": ("na0.3coo21.4(h/d)2o", None, None), "a/bb": ("a/bb", None, None),
}
cases(
    "formula_relations", "T2, T3: parent compound, and the sides of an interface.", list(RELATIONS),
    parent=(formulas.parent_key, "string", [v[0] for v in RELATIONS.values()]),
    overlayer=(lambda c: formulas.interface(c)["overlayer"], "string", [v[1] for v in RELATIONS.values()]),
    substrate=(lambda c: formulas.interface(c)["substrate"], "string", [v[2] for v in RELATIONS.values()]),
)

READ = {"250 K": 250.0, "80-95 K": 87.5, "150": 150.0, "~ 12.5 T": 12.5, "": None, None: None, "none": None, "-3.5": -3.5}
cases("number_readings", "T11, T40: numbers as people write them.", list(READ), value=(numbers.read_number, "double", list(READ.values())))

CHECKS = {
    # tc | pressure | lambda | mu | omega | confidence: in range, flags, confidence
    "200|150|2.0|0.1|100|0.9": (True, "allen_dynes_mismatch", 0.9), "12||2.0|0.1|100|0.9": (True, "", 0.9), "250|900||||0.9": (False, "", 0.9), "39|||||0.9": (False, "", 0.9),
    "450|100||||0.9": (False, "", 0.3), "0.005|1||||0.2": (False, "", 0.2), "10||0.05|0.1|100|": (True, "allen_dynes_denominator_nonpositive", None),
}
cases(
    "hydride_checks", "T23, T24, T26: range gates, coupling check, lowered confidence.", list(CHECKS),
    fit=(lambda c: numbers.hydride_fit(*[_number(c, k) for k in range(1, 6)]), "boolean", [v[0] for v in CHECKS.values()]),
    flags=(lambda c: F.array_join(numbers.coupling_flags(_number(c, 1), _number(c, 3), _number(c, 4), _number(c, 5)), ","), "string", [v[1] for v in CHECKS.values()]),
    confidence=(lambda c: numbers.capped_confidence(_number(c, 1), _number(c, 6)), "double", [v[2] for v in CHECKS.values()]),
)

UNITS = {"100|meV": 1160.45, "100|K": 100.0, "10|cm^-1": 14.3877, "2|THz": 95.9848, "7|": 7.0, "7|furlong": None}
cases("unit_conversions", "T25: temperatures in other units.", list(UNITS), kelvin=(lambda c: F.round(numbers.to_kelvin(_number(c, 1), _part(c, 2)), 4), "double", list(UNITS.values())))

IDS = {
    "arxiv:2301.1": ("arXiv:2301.1", None, "2301"), "aps:10.1103/x": ("DOI: 10.1103/x", "10.1103/x", None), "doi:10.1234/y": ("DOI: 10.1234/y", "10.1234/y", None), "nims:4": ("NIMS:4", None, None),
    "odd": ("odd", None, None), "": (None, None, None), None: (None, None, None), "https://doi.org/10.1103%2FPhysRevB.1.": ("https://doi.org/10.1103%2FPhysRevB.1.", "10.1103/PhysRevB.1", None),
    "see 10.1103/abc)]": ("see 10.1103/abc)]", "10.1103/abc", None), "arxiv:cond-mat/0203001": ("arXiv:cond-mat/0203001", None, "0203"),
}
cases(
    "paper_ids", "T19, T33, T51: source labels, DOIs and shards.", list(IDS), label=(text.source_label, "string", [v[0] for v in IDS.values()]),
    doi=(text.doi, "string", [v[1] for v in IDS.values()]), shard=(text.shard, "string", [v[2] for v in IDS.values()]),
)

PHASES = {"the YBCO film": "cuprate_123", "Ruddlesden-Popper n = 2": "RP_n2", "none": None}
cases("structure_phases", "T14: the phase that a text names.", list(PHASES), phase=(text.structure_phase, "string", list(PHASES.values())))

CHECKED = {"cuprate_123|YBa2Cu3O7": "cuprate_123", "cuprate_123|MgB2": None, "123|Nd1.85Ce0.15CuO4": None, "214|HgBa2CuO4": None, "214|La2CuO4": "214", "|MgB2": None}
cases("phase_checks", "T15: phases that contradict the formula.", list(CHECKED), phase=(lambda c: summary.phase_checked(_part(c, 1), _part(c, 2)), "string", list(CHECKED.values())))

KINDS = {
    # evidence | measurement | paper type | pressure: aggregator, audit, time-line
    "primary_theoretical|resistivity||": (True, "theoretical", False), "primary_experimental|dft||": (False, "experimental", True), "|ARPES|theoretical|": (False, "experimental", False),
    "|Eliashberg||": (True, "theoretical", True), "|| Computational |": (True, "theoretical", False), "||theoretical|5": (True, "theoretical", True), "cited|dft||": (True, "cited", True), "|||": (False, "experimental", False),
}
cases(
    "evidence_kinds", "T16, T17, T18: calculated or measured, by the rules of the aggregator, the audit and the time-line.", list(KINDS),
    theory=(lambda c: summary.is_theory(_part(c, 1), _part(c, 2), _part(c, 3)), "boolean", [v[0] for v in KINDS.values()]),
    kind=(lambda c: summary.classification(_part(c, 1), _part(c, 2), _part(c, 3)), "string", [v[1] for v in KINDS.values()]),
    plotted=(lambda c: timeline.is_theory(_part(c, 2), _part(c, 3), _number(c, 4)), "boolean", [v[2] for v in KINDS.values()]),
)

TAGGED = {
    "Superconducting hydride at high critical temperature": ("hydride,superconduct,tc", True, "materials_tc_likely"),
    "vortex": ("vortex", False, "keyword_candidate"),
    "a topological insulator": ("topological", False, "devices_or_theory"),
}
cases(
    "tag_rules", "T35, F21: tags of a text, whether they make a candidate, and of which class.", list(TAGGED),
    tags=(lambda c: F.array_join(text.tags(c), ","), "string", [v[0] for v in TAGGED.values()]), keep=(lambda c: text.worth_keeping(text.tags(c)), "boolean", [v[1] for v in TAGGED.values()]),
    kind=(lambda c: text.candidate_class(text.tags(c)), "string", [v[2] for v in TAGGED.values()]),
)

CREDITS = {"Smith, A|Jones": "Smith & Jones", " Li , B| Wu ": "Li & Wu", "A|B|C": "A et al.", "": "Unknown", None: "Unknown", "X": "X"}
_list = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
cases("author_credits", "T29: short credits.", list(CREDITS), credit=(lambda c: text.short_credit(_list(c)), "string", list(CREDITS.values())))

DATES = {"2020|5|17": "2020-05-17", "2020|5": "2020-05-01", "2020": "2020-01-01", "2020|2|30": None, "": None}
cases(
    "date_parts", "T37, T38: dates of parts; missing ones are 1.", list(DATES),
    day=(lambda c: text.date_of_parts(F.transform(F.when(c != "", F.split(c, r"\|")), lambda x: x.cast("int"))).cast("string"), "string", list(DATES.values())),
    year=(lambda c: F.year(text.date_of_parts(F.transform(F.when(c != "", F.split(c, r"\|")), lambda x: x.cast("int")))).cast("double"), "double", [d and float(d[:4]) for d in DATES.values()]),
)

MARKUP = {"<jats:p>H<sub>3</sub>S &amp; more</jats:p>": "H 3 S & more", "a &lt;b&gt;\n c": "a <b> c", "": "", "plain": "plain"}
cases("markup_cases", "T36: abstracts without markup.", list(MARKUP), plain=(text.plain_markup, "string", list(MARKUP.values())))

PLACES = {"Japan|Tokyo;japan|China": "China,Japan,Tokyo", "": "", "France| france ;": "France"}
cases(
    "place_unions", "T31: place names of many lists, each once.", list(PLACES),
    places=(lambda c: F.array_join(text.geo_union(F.transform(F.split(c, ";"), lambda x: F.split(x, r"\|"))), ","), "string", list(PLACES.values())),
)
SURE = {"JP|x|y": "high", "|x|": "medium", "||y": "low", "||": "none"}
_some = lambda c, i: F.when(_part(c, i).isNotNull(), F.array(_part(c, i))).otherwise(F.array().cast("array<string>"))
cases("place_confidence", "T32: how sure a place is.", list(SURE), sure=(lambda c: text.geo_confidence(_some(c, 1), _some(c, 2), _some(c, 3)), "string", list(SURE.values())))

ENUMS = {"Primary_Experimental": "primary_experimental", " cited ": "cited", "nonsense": None, None: None}
cases("enum_values", "T22: values of a closed list.", list(ENUMS), value=(lambda c: text.enum(c, ("primary_theoretical", "primary_experimental", "cited")), "string", list(ENUMS.values())))

SEARCHED = {
    "MgB2": None, "": "empty", "Bi_2Sr_2": None, "a b": "non_formula_text", "Y,x": "alloy_or_variable_stoichiometry", "X0.75O": "decimal_subscript", "O{8}": "variable_subscript",
    "abc": "no_element_symbol",
}
cases("lookup_preflight", "F18: formulas that can't be looked up.", list(SEARCHED), reason=(harvest.unsearchable, "string", list(SEARCHED.values())))

WINDOWS = {"1985-12-31": False, "1990-01-01": True, "2026-12-31": True, "2027-01-01": False, "": False}
cases("publication_window", "F23: published in the window; without a date it is not.", list(WINDOWS), inside=(lambda c: harvest.in_window(F.to_date(F.nullif(c, F.lit("")))), "boolean", list(WINDOWS.values())))

RANKS = {"PRL|materials_tc_likely": "P0", "PRL|devices_or_theory": "P1", "??|materials_tc_likely": "P2"}
cases("harvest_priority", "L6: the order of harvest.", list(RANKS), priority=(lambda c: harvest.priority(_part(c, 1), _part(c, 2)), "string", list(RANKS.values())))

TYPES = {"JournalArticle|Review": "review", "?|Dataset": "computational", "JournalArticle": "experimental", "?": None}
cases("publication_types", "T49: paper type of a list of publication types.", list(TYPES), kind=(lambda c: harvest.mapped_type(_list(c)), "string", list(TYPES.values())))

JOURNALS = {"10.1103/PhysRevLett.5.077001": "PRL", "https://doi.org/10.1103/PhysRevB.1.2": "PRB", "10.1016/x": None}
cases("journal_names", "T34: journals of DOIs.", list(JOURNALS), abbrev=(lambda c: harvest.journal(c)["abbrev"], "string", list(JOURNALS.values())))

REPLIES = {'```json\n[{"formula": "Nb"}]\n```': "Nb", '{"materials": [{"formula": "Pb"}]}': "Pb", "sorry": None, '{"x": 1}': None}
cases(
    "model_replies", "T21: the list in a model's reply.", list(REPLIES),
    first=(lambda c: F.try_element_at(harvest.llm_reply(c, "array<struct<formula:string>>"), F.lit(1))["formula"], "string", list(REPLIES.values())),
)

CHUNKS = {"a_b_chunk_003": "a_b", "a_fact_01": "a", "a_chunk_b_chunk_1": "a_chunk_b"}
cases("chunk_parents", "V4: the document of a chunk.", list(CHUNKS), parent=(vectors.parent_id, "string", list(CHUNKS.values())))

BLOCKS = {"1|T|A, B|2020|s": "[1] T — A (2020) · s", "2|U||| intro": "[2] U — Unknown (n.d.) ·  intro"}
cases(
    "source_blocks", "T54: how a source is quoted.", list(BLOCKS),
    block=(lambda c: text.source_block(_part(c, 1), _part(c, 2), F.when(_part(c, 3).isNotNull(), F.array(_part(c, 3))), _part(c, 4), _part(c, 5)), "string", list(BLOCKS.values())),
)

FACTS = {
    # formula | tc | measurement | pressure | condition | family | doping type | level | comment
    "MgB2|39|resistivity||ambient|mgb2|hole|0.1|clean": "MgB2 has a critical temperature Tc = 39 K (resistivity) at ambient pressure. [mgb2; doping: hole x=0.1] Note: clean.",
    "H3S|203||155|||||": "H3S has a critical temperature Tc = 203 K at 155 GPa.",
    "X||||||||": None,
}
_fact = lambda c: F.struct(
    _part(c, 1).alias("formula"), _number(c, 2).alias("tc_kelvin"), F.lit(None).cast("string").alias("method"), _part(c, 3).alias("measurement"), _number(c, 4).alias("pressure_gpa"),
    _part(c, 5).alias("pressure_condition_normalized"), F.lit(None).cast("string").alias("tc_regime"), _part(c, 6).alias("family"), F.lit(None).cast("string").alias("crystal_structure"),
    F.lit(None).cast("string").alias("sample_form"), _part(c, 7).alias("doping_type"), _number(c, 8).alias("doping_level"), _part(c, 9).alias("comment"), F.lit(None).cast("string").alias("evidence_type"),
)
cases("fact_sentences", "T27, T28: what a record says, as a sentence.", list(FACTS), said=(lambda c: F.try_element_at(text.fact_sentences(F.array(_fact(c))), F.lit(1)), "string", list(FACTS.values())))

HYDRIDE_KEYS = {"p|h3s|m|200|150.000001": "p|h3s|200|150|m", "p|||12.34567|": "p||12.346||", "q|lah10|dft||": "q|lah10|||dft"}
cases(
    "hydride_keys", "T10: the digest that tells hydride records apart.", list(HYDRIDE_KEYS),
    key=(lambda c: harvest.record_key(_part(c, 1), _part(c, 2), _part(c, 3), _number(c, 4), _number(c, 5)), "string", ["hydride:" + hashlib.sha1(x.encode()).hexdigest() for x in HYDRIDE_KEYS.values()]),
)
