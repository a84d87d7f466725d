r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes one example: all turns before it as context, then that reply, the only part under
the loss mask. A conversation whose last turn is not an assistant's gets a closing example without any loss span,
so that no turn is lost.

A turn is written as

    <|turn|>ROLE\n<|text|>\nTEXT\n<|end|>\n

A control string inside a role or text gets one more backslash in front (`<|end|>` -> `\<|end|>`, `\<|end|>` ->
`\\<|end|>`), and reading takes one off again. A written marker stands at the start or after a newline, never
after a backslash, so the two cannot be confused.

Defined cases: null text or role counts as empty; rows of one conversation with equal turn numbers are ordered by
role, then text, repeated rows all kept; a null turn number comes first; a null conv_id is a conversation of its
own; columns other than conv_id, turn, role, text are ignored; an empty table gives no examples. Each example
repeats its context, as the method asks, so a conversation's output grows with the square of its turns; rows of
the input are only ever gathered by conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings: the template's own markers and the common ones of other templates.
CONTROL = r"<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>"
ESCAPE = rf"(\\*(?:{CONTROL}))"
UNESCAPE = rf"\\(\\*(?:{CONTROL}))"


def escaped(c):
    return F.regexp_replace(c, ESCAPE, r"\\$1")


def unescaped(c):
    return F.regexp_replace(c, UNESCAPE, "$1")


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, target (1-based place of the example's last turn), formatted, loss_start, loss_chars.

    The loss span is in code points of `formatted`, from 0; loss_chars is 0 and loss_start null in a closing example.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.concat(F.lit("<|turn|>"), escaped(role), F.lit("\n<|text|>\n")).alias("head"),
            escaped(text).alias("body"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit("\n<|end|>\n"))).alias("segments"),
        F.transform("ts", lambda t: t["role"] == "assistant").alias("trains"),
        F.transform("ts", lambda t: F.char_length(t["head"])).alias("heads"),
        F.transform("ts", lambda t: F.char_length(t["body"])).alias("bodies"),
    )
    n = F.size("segments")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.element_at("trains", i))
    one = whole.withColumn("target", F.explode(targets)).withColumn("loss", F.element_at("trains", F.col("target")))
    context = F.array_join(F.slice("segments", 1, F.col("target") - 1), "")
    return one.select(
        "conv_id",
        "target",
        F.concat(context, F.element_at("segments", F.col("target"))).alias("formatted"),
        F.when(F.col("loss"), F.char_length(context) + F.element_at("heads", F.col("target"))).alias("loss_start"),
        F.when(F.col("loss"), F.element_at("bodies", F.col("target"))).otherwise(0).alias("loss_chars"),
    )


def read_turns(formatted):
    """The turns of one formatted example, as an array of (role, text)."""
    parts = F.split(formatted, r"(?<!\\)<\|turn\|>")
    parts = F.slice(parts, 2, F.size(parts) - 1)  # the first is what stands before the first marker: nothing
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, r"(?s)^(.*?)\n(?<!\\)<\|text\|>\n", 1)).alias("role"),
            unescaped(F.regexp_extract(p, r"(?s)^.*?\n(?<!\\)<\|text\|>\n(.*)\n<\|end\|>\n$", 1)).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted examples alone."""
    loss = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    each = examples.select(
        "conv_id", "target", "formatted", F.struct("target", F.coalesce(loss, F.lit("")).alias("loss")).alias("part")
    )
    one = each.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("last"),
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    turns, trained = read_turns(F.col("last")), F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    one = one.select("conv_id", "formatted_chars", turns.alias("turns"), trained.alias("trained"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return one.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: The same digests without the operator: escaping and the layout are recomputed from the rows.
ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(role, '(\\*(?:<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>))', '\\\1', 'g'))
    + length(regexp_replace(text, '(\\*(?:<\|[a-z_]+\|>|</?s>|\[/?INST\]|<</?SYS>>))', '\\\1', 'g')) + 27 AS chars
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
