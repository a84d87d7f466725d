r"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the matches of four fixed patterns (email, ip, card, phone), which are spans of their own, and tokens in a form in which
keys and secrets are written (SECRET). What stands around every seed induces lexical patterns: the two words before it, the
word before with the word after, and the last word before with the signs between (`token = "`). Every other token with a digit or
an @ is a candidate, and what stands around it are patterns too. Patterns and values form a bipartite graph, scored in rounds:

    confidence(pattern) = sum of its values' trust / (its distinct values + 1), 0 below SUPPORT or CONFIDENT
    score(value)        = 1 - product over its patterns of (1 - confidence)
    trust(value)        = 1 for a seed, else its score

so a value that a trusted context has named lends trust to its other contexts in the next round. Values that score
CONFIDENT or more and have the shape of an identifier (SHAPE) are found: all their occurrences become spans of kind `id`.
A SECRET token is found like any other: its form alone doesn't make it a span, a trusted context must name it.

Texts are cut once by each pattern, in the scan; only matches with WINDOW characters of the whole text on either side, other
matches among them, are shuffled. Rounds go on until the written scores, looked at every ROUNDS rounds, no longer rise.
Their places are running sums within the document. The graph's edges are distinct (pattern, value) pairs, combined before
every shuffle, so a context or value that a third of all rows share is one node of small sums.

Defined cases: null text counts as empty; offsets are code points, the end is exclusive; a match that fails its kind's test is
dropped without another try; found spans never overlap base ones; repeated rows, also of one doc_id, and rows with a null
doc_id are each treated on their own; a document without spans has the digest of the empty string; an empty table gives an
empty table; extra columns pass through `redact` untouched (n_chars, if there, follows the new text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, discard, free, whole_text, written

KINDS = ("email", "ip", "card", "phone", "id")
#: The patterns in forms that match the same and never go back: a start that follows a character of the same run can't succeed.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![\p{L}\p{N}@._%+/-])[\p{L}._%+/-]*+[\p{N}@][\p{L}\p{N}@._%+/-]*+"
REGEX = (EMAIL, IP, CARD, PHONE, TOKEN)

WINDOW, SUPPORT, CONFIDENT, ROUNDS = 80, 3.0, 0.7, 4
#: Forms of keys and secrets. 128 bits or more in hexadecimal; prefixes that issuers of access tokens use.
SECRET = r"^(?:(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}|akia[0-9a-z]{16}|gh[opsu]_[0-9a-z]{36}|xox[abp]-[0-9a-z-]{10,}|[sr]k_live_[0-9a-z]{16,})$"
#: The last word and the signs after it, one at least.
LABEL = r"(\p{L}[\p{L}\p{N}]*+[^\p{L}\p{N}]*[^\p{L}\p{N}\s][^\p{L}\p{N}]*)$"
#: What a found value looks like: six characters or more, with four digits or an @ among them.
SHAPE = r"^(?=.{6,})(?:(?:[^0-9]*[0-9]){4}|[^@]+@)"


def _cut(docs: DataFrame, text: str, ids: str, out: str) -> DataFrame:
    """docs with `ids`, a number of the row, and `out`: every match of every pattern with its gap and surroundings."""
    has = (F.contains(text, F.lit("@")), F.lit(True), F.lit(True), F.contains(text, F.lit("+")), F.lit(True))
    digits = F.col(text).rlike("[0-9@]")
    none, cols = F.array().cast("array<string>"), {}
    for k, (regex, may) in enumerate(zip(REGEX, has)):
        cols[f"_p{k}"] = F.when(may & digits, F.split(text, regex, -1)).otherwise(none)
        cols[f"_m{k}"] = F.when(may & digits, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(none)
    cutting = docs.withColumn(ids, F.monotonically_increasing_id()).withColumns(cols)

    def ends(k: int) -> Column:
        """Of each match, the last WINDOW characters of it and the gap before, and the first ones of it and the gap after."""
        return F.transform(
            f"_m{k}",
            lambda m, i: F.struct(
                F.substring(F.concat(F.get(f"_p{k}", i), m), -WINDOW, WINDOW).alias("tail"), F.substring(F.concat(m, F.get(f"_p{k}", i + 1)), 1, WINDOW).alias("head")
            ),
        )

    cutting = cutting.withColumns({f"_e{k}": ends(k) for k in range(len(REGEX))})
    near = WINDOW // 2  # matches of a kind and the gaps after them have two characters at least, so no more of them are in reach

    def found(k: int) -> Column:
        def one(m: Column, i: Column) -> Column:
            gap, after = F.get(f"_p{k}", i), F.get(f"_p{k}", i + 1)
            told = F.array_join(F.slice(F.col(f"_e{k}")["tail"], F.greatest(i - near, F.lit(0)) + 1, F.least(i, F.lit(near))), "")
            tells = F.array_join(F.slice(F.col(f"_e{k}")["head"], i + 2, F.lit(near)), "")
            full = lambda c: F.char_length(c) >= WINDOW
            return F.struct(
                F.lit(k).alias("kind"),
                i.alias("i"),
                F.char_length(gap).alias("gap"),
                F.substring(F.when(full(gap), gap).otherwise(F.concat(told, gap)), -WINDOW, WINDOW).alias("before"),
                m.alias("value"),
                F.substring(F.when(full(after), after).otherwise(F.concat(after, tells)), 1, WINDOW).alias("after"),
            )

        return F.transform(f"_m{k}", one)

    return cutting.withColumn(out, F.concat(*map(found, range(len(REGEX))))).drop(*cols, *[f"_e{k}" for k in range(len(REGEX))])


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match passes its kind's test."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    ip = F.forall(F.split(value, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(F.try_to_number(part(p), F.lit("999")), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)

    def doubled(x: Column) -> Column:
        return F.when(x > 4, x * 2 - 9).otherwise(x * 2)

    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    luhn = F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0
    return (
        F.when(kind == 1, ip)
        .when(kind == 2, F.when(n.between(13, 19), luhn).otherwise(False))
        .when(kind == 3, n.between(9, 15))
        .otherwise(True)
    )


def _placed(cut: DataFrame, ids: str, out: str) -> DataFrame:
    """A row a span: row number, kind, start, end, value, before, after. Base spans that pass; candidates clear of them."""
    m = cut.select(F.col(ids).alias("row"), F.explode(out).alias("m")).select("row", "m.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("value")
    m = m.withColumn("end", F.sum(F.col("gap").cast("long") + length).over(upto)).withColumn("start", F.col("end") - length)
    m = m.where(_valid(F.col("kind"), F.col("value")))
    lead = F.when(F.col("kind") == 4, F.char_length(F.regexp_extract("value", r"^[^\p{L}\p{N}]*+", 0))).otherwise(0)
    core = F.when(F.col("kind") == 4, F.regexp_replace(F.regexp_replace("value", r"^[^\p{L}\p{N}]++", ""), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")).otherwise(F.col("value"))
    m = m.withColumns({"start": F.col("start") + lead, "value": core}).withColumn("end", F.col("start") + F.char_length("value"))
    m = m.where("kind < 4 or value rlike '[0-9@]'")
    base = F.col("kind") < 4
    ahead = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start"))
    later = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc()))
    m = m.withColumns({"_ahead": F.coalesce(ahead, F.lit(0)), "_later": F.coalesce(later, F.col("end"))})
    m = m.where(base | ((F.col("_ahead") <= F.col("start")) & (F.col("_later") >= F.col("end"))))
    return m.select("row", "kind", "start", "end", "value", "before", "after")


def patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of one occurrence: lower case, digits as 0."""
    plain = lambda c: F.translate(F.lower(c), "123456789", "000000000")
    left, right = F.regexp_extract_all(plain(before), F.lit(WORD), F.lit(0)), F.regexp_extract_all(plain(after), F.lit(WORD), F.lit(0))
    one, two, next_ = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.try_element_at(right, F.lit(1))
    label = F.regexp_replace(F.nullif(F.regexp_extract(plain(before), LABEL, 1), F.lit("")), r"\s+", " ")
    return F.array_compact(F.array(F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _ "), next_), F.concat(label, F.lit("_"))))


def scores(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, score) of every value that is not a span of its own and scores more than 0, by rounds over the pattern-instance graph.

    Scores never fall from round to round; they are written every `rounds` rounds, until their sum no longer rises.
    """
    value, base = F.lower("value"), F.col("kind") < 4
    seen = spans.select(F.explode(patterns(F.col("before"), F.col("after"))).alias("pattern"), value.alias("value"), base.alias("base"), (base | value.rlike(SECRET)).alias("seed"))
    edges = written(seen.groupBy("pattern", "value").agg(F.max("base").alias("base"), F.max("seed").alias("seed")), "edges")
    state, total = None, 0
    while True:
        before = state
        for _ in range(rounds):
            known = F.when(F.col("seed"), 1.0)
            scored = edges.withColumn("s", known.otherwise(0.0)) if state is None else edges.join(state, "value", "left").withColumn("s", known.otherwise(F.coalesce("score", F.lit(0.0))))
            sums = scored.groupBy("pattern").agg(F.round(F.sum("s"), 6).alias("mass"), F.count("*").alias("n"), F.count_if(~F.col("base")).alias("open"))
            trusted = sums.where((F.col("open") > 0) & (F.col("mass") >= SUPPORT) & (F.col("mass") / (F.col("n") + 1) >= CONFIDENT))
            trusted = trusted.select("pattern", F.log1p(-F.col("mass") / (F.col("n") + 1)).alias("doubt"))
            state = edges.where(~F.col("base")).join(trusted, "pattern").groupBy("value").agg(F.round(1 - F.exp(F.sum("doubt")), 6).alias("score"))
        state = written(state, "scores")
        now = state.agg(F.sum(F.col("score").cast("decimal(20,6)"))).first()[0] or 0
        if now <= total:
            return state
        if before is not None:
            discard(before)
        total = now


def find(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, str, DataFrame]:
    """The rows of docs (written once: columns `keep` and a row number), that column's name, the spans (row, kind, start, end, value)."""
    whole, row, cut = (free(c, docs) for c in ("_pii_text", "_pii_row", "_pii_cut"))
    rows = written(_cut(docs.select(*[F.col(f"`{c}`") for c in keep], whole_text(text).alias(whole)), whole, row, cut).drop(whole), "cut")
    spans = written(_placed(rows, row, cut), "spans")
    named = scores(spans).where((F.col("score") >= CONFIDENT) & F.col("value").rlike(SHAPE)).select(F.col("value").alias("_named"))
    more = spans.where("kind = 4").join(named, F.lower("value") == F.col("_named"), "left_semi")
    return rows.drop(cut), row, spans.where("kind < 4").unionByName(more).select("row", "kind", "start", "end", "value")


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans (all of them) of every document."""
    rows, row, spans = find(docs, ["doc_id"])
    each = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("all"))
    whole = rows.join(each, F.col(row) == F.col("row"), "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    n = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return whole.select(
        "doc_id",
        *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_joined(F.filter("all", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        n(4).alias("n_id"),
        F.size("all").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; spans that overlap become the first one's. Null text stays null."""
    rows, row, spans = find(docs, docs.columns, text)
    at, parts, end = (free(c, docs) for c in ("_pii_at", "_pii_parts", "_pii_end"))
    before = Window.partitionBy("row").orderBy("start", "end", "kind")
    done = F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tag = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)), F.lit("]"))
    cuts = spans.withColumn("done", done).select(
        "row", F.struct("start", "end", "done", F.when(F.col("start") >= F.col("done"), tag).otherwise("").alias("tag")).alias("c")
    )
    each = cuts.groupBy(F.col("row").alias(at)).agg(F.array_sort(F.collect_list("c")).alias(parts), F.max("c.end").alias(end))
    whole = rows.join(each, F.col(row) == F.col(at), "left")
    t = F.col(f"`{text}`")
    kept = lambda c: t.substr((c["done"] + 1).cast("int"), F.greatest(c["start"] - c["done"], F.lit(0)).cast("int"))
    new = F.concat(
        F.array_join(F.transform(parts, lambda c: F.concat(kept(c), c["tag"])), ""),
        t.substr((F.col(end) + 1).cast("int"), F.char_length(t)),
    )
    out = whole.withColumn(text, F.when(F.col(parts).isNull(), t).otherwise(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(parts).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
