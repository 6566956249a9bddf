"""Chat formatting with typed content parts, in DataFrame operations only.

Each turn's content is an ordered list of parts. A visitor over the parts turns
text into escaped text, and images, audio and documents into placeholders in
their place, recording a reference and an expanded token count for each. The
template is::

    <|turn|>ROLE<|text|>BODY<|end|>

In texts, every ``<``, ``[`` and backslash gets a backslash behind it, so that no
control string of this or the common bracketed templates (``<|...|>``, ``</s>``,
``[INST]``) can appear there; the step back is exact. The loss mask covers the
bodies of assistant turns as (start, length) in code points of the output.

Defined cases: a null text is an empty text, a null role an empty role; a turn
without parts has an empty body; equal turn numbers are ordered by role, then
body; repeated rows are repeated turns; an empty table gives no conversations;
other columns are not read. One output row holds one conversation, so a
conversation must fit into one row (as any consumer of it requires).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that a placeholder expands to: per image tile, second of audio, document page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:double>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def text_part(text: Column) -> Column:
    """One text part, in the shape that :func:`format_conversations` reads."""
    none = F.lit(None).cast("string")
    return F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("ref"), F.lit(None).cast("double").alias("units"))


def _visit_text(p: Column) -> Column:
    placeholder = F.when(p["type"].isin(*TOKENS_PER_UNIT), F.concat(F.lit("<|"), p["type"], F.lit("|>")))
    return F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.coalesce(placeholder, F.lit("<|unknown|>")))


def _visit_attachment(p: Column) -> Column:
    rate = F.lit(None).cast("long")
    for kind, n in TOKENS_PER_UNIT.items():
        rate = F.when(p["type"] == kind, F.lit(n)).otherwise(rate)
    units = F.greatest(F.ceil(F.coalesce(p["units"], F.lit(1.0))), F.lit(1))
    return F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(rate * units, F.lit(0)).cast("long").alias("tokens"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """From (conv_id, turn, role, parts array<PART>) to one row per conversation:
    conv_id, formatted, mask array<struct<start,length>>, attachments in order
    with references and token counts, n_attachment_tokens."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, _visit_text), "").alias("body"),
        F.transform(F.filter(parts, lambda p: ~p["type"].eqNullSafe(F.lit("text"))), _visit_attachment).alias("attachments"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.select("conv_id", "turn", "role", "body", "attachments", head.alias("head"), F.concat(head, F.col("body"), F.lit(END)).alias("rendered"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum(F.length("rendered").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.length("rendered") + F.length("head")
    masked = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "rendered", masked.alias("masked"), "attachments"))).alias("t"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["masked"]), lambda m: m.isNotNull()).alias("mask"),
        F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"),
    ).withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> out of a formatted conversation; placeholders of
    attachments are left out of the texts."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(t: Column) -> Column:
        body = F.regexp_replace(F.regexp_extract(t, r"(?s)<\|text\|>(.*)$", 1), r"<\|[a-z]+\|>", "")
        return F.struct(unescape(F.regexp_extract(t, r"(?s)^<\|turn\|>(.*?)<\|text\|>", 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    pieces = F.transform(mask, lambda m: F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))
    return F.array_join(F.transform(pieces, lambda x: unescape(F.regexp_replace(x, r"<\|[a-z]+\|>", ""))), "")


PROBE = r"values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts are control strings."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.unionByName(spark.sql(f"select * from {PROBE}"))


def digest(conversations: DataFrame) -> DataFrame:
    """The query contract: everything but conv_id is read back from the output."""
    turns = conversations.select("conv_id", "turn", "role", F.array(text_part(F.col("text"))).alias("parts"))
    out = format_conversations(turns).withColumn("back", read_turns(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("mask")))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(23 + length(regexp_replace(role, '([<\[\\])', '\1\1', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\1', 'g'))) as bigint) as formatted_chars
from c group by conv_id
"""
