"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
become one block; the blocks are written one after the other::

    [TURN]role[TEXT]text[NEXT]text of the next turn of the same role</s>[TURN]...

The marks are control strings, and so are [INST], [/INST] and <s>. Where a role or text holds a
control string, its first character is written as ~1 or ~2, and ~ itself as ~0, so no text can
end a turn and reading back gives each text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, sums_before, table

CONTROL = r"\[(/?(?:INST|TURN|TEXT|NEXT)\])"
ENDS = r"<(/?s>)"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(c, CONTROL, "~1$1"), ENDS, "~2$1")


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("~1"), F.lit("[")), F.lit("~2"), F.lit("<"))
    return F.replace(c, F.lit("~0"), F.lit("~"))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end in code points).

    turns: conv_id, turn, role, text; other columns are not used. Null roles and texts count as
    empty, null turns come first; ties on turn go by role and text, and repeated rows stay repeated.
    An empty table gives no rows; the rows with a null conv_id make one conversation. Each
    conversation is one output value, so its turns meet in one task.
    """
    t = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    got = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        same = F.coalesce(F.get("turns", i - 1).role == x.role, F.lit(False))
        head = F.when(same, F.lit("[NEXT]")).otherwise(F.concat(F.when(i > 0, F.lit("</s>")).otherwise(F.lit("")), F.lit("[TURN]"), escape(x.role), F.lit("[TEXT]")))
        return F.struct(head.alias("head"), escape(x.text).alias("body"), x.role.isin(*loss_roles).alias("loss"))

    got = got.select("conv_id", F.transform("turns", piece).alias("parts"))
    got = got.select("conv_id", "parts", F.transform("parts", lambda p: F.length(p.head) + F.length(p.body)).alias("lens"))
    spans = let(sums_before(F.col("lens")), lambda before: F.transform("parts", lambda p, i: F.struct((F.get(before, i) + F.length(p.head)).alias("start"), F.length(p.body).alias("size"), p.loss.alias("loss"))))
    spans = F.transform(F.filter(spans, lambda s: s.loss), lambda s: F.struct(s.start.alias("start"), (s.start + s["size"]).alias("end")))
    return got.select("conv_id", F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body)), ""), F.lit("</s>")).alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """The inverse of format_chats: conv_id, turns (role, text), loss_texts, formatted."""
    blocks = F.filter(F.split("formatted", "</s>", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substring(b, 7, 1 << 30), "[TEXT]", 1)
        texts = F.split(F.substring(b, F.length(role) + 13, F.length(b)), r"\[NEXT\]", -1)
        return F.transform(texts, lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.end - s.start)))
    return chats.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), under.alias("loss_texts"), "formatted")


def digest(chats: DataFrame) -> DataFrame:
    back = read_chats(chats).select("conv_id", "turns", F.array_join("loss_texts", "").alias("loss"), "formatted")
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(format_chats(rows.unionByName(own)))


def _escaped(x: str) -> str:
    return f"regexp_replace(regexp_replace(replace({x}, '~', '~0'), '\\[(/?(?:INST|TURN|TEXT|NEXT)\\])', '~1\\1', 'g'), '<(/?s>)', '~2\\1', 'g')"


OP9_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(length({_escaped("text")}) + CASE WHEN before = role THEN 6 ELSE 12 + length({_escaped("role")}) + CASE WHEN i > 1 THEN 4 ELSE 0 END END) + 4)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
