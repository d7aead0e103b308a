"""Chat formatting with a grammar round trip, in DataFrame expressions only.

    conversation := turn ("\\n" turn)*
    turn         := "<turn>### " role ": " text "</turn>"

Control strings (``<turn>``, ``</turn>``, ``###``) never stand inside a role or
a text.  Every turn is first rendered as it is and parsed again; where the
parser does not give back the very same role and text, the text is escaped and
the turn rendered anew, until both agree.  Escapes are two characters, a
backslash and a letter that is no backslash, so undoing them is unambiguous.
Finally the whole conversation is parsed and compared with its source; ``exact``
tells the outcome.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.llm import common

OPEN, SEP, CLOSE, GLUE = "<turn>### ", ": ", "</turn>", "\n"
#: What an escape stands for; the backslash comes first when escaping, last when undoing.
ESCAPES = [("\\", "\\s"), ("<turn>", "\\o"), ("</turn>", "\\c"), ("###", "\\h")]
_ROLE = [*ESCAPES, (":", "\\d")]


def escape(c: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), table, c)


def unescape(c: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(table), c)


def render(role: Column, body: Column) -> Column:
    """A turn; body is a text that is escaped as far as need be."""
    return F.concat(F.lit(OPEN), escape(role, _ROLE), F.lit(SEP), body, F.lit(CLOSE))


def _turn(piece: Column) -> Column:
    """(role, text) of a turn without its close; null if it breaks the grammar."""
    rest = F.substring(piece, len(OPEN) + 1, 2**31 - 1)
    at = F.instr(rest, SEP)
    role, body = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(SEP))
    legal = piece.startswith(OPEN) & (at > 0) & ~F.contains(rest, F.lit("<turn>")) & ~F.contains(rest, F.lit("###"))
    return F.when(legal, F.struct(unescape(role, _ROLE).alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a conversation, array<struct<role, text>>; an entry is null where the grammar is broken."""
    pieces = F.split(formatted, CLOSE, -1)
    closed = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = F.transform(closed, lambda p, i: _turn(F.when(i == 0, p).when(p.startswith(GLUE), F.substring(p, len(GLUE) + 1, 2**31 - 1))))
    return F.when(F.element_at(pieces, -1) == "", turns)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """Per conversation: id, formatted, turns (read back), loss_spans, exact.

    loss_spans are (start, stop) offsets in code points of the texts, as
    escaped, whose role is ``learn``: what a model is trained on.  exact tells
    whether the conversation reads back as its source; the escapes see to it
    that all do, and one that did not would be a row with exact false.

    Turns come by number, null first; ties by role, then text; repeated rows are
    turns of their own.  Null roles and texts are empty strings; rows with a null
    id form one conversation.  Conversations without rows don't exist, so an
    empty table gives none.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), text.alias("text"))
    source = F.struct("role", "text")

    def good(body: Column) -> Column:
        back = parse(render(F.col("role"), body))
        return (F.size(back) == 1) & back[0].eqNullSafe(source)

    body = F.when(good(F.col("text")), F.col("text")).otherwise(escape(F.col("text")))
    told = own.withColumn("body", body).withColumn("made", render(F.col("role"), F.col("body")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    end = F.sum(F.length("made") + len(GLUE)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - len(GLUE)
    placed = told.withColumns({"n": F.row_number().over(order), "stop": end - len(CLOSE)})
    span = F.when(F.col("role") == learn, F.struct((F.col("stop") - F.length("body")).alias("start"), F.col("stop").alias("stop")))
    packed = placed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("n", "made", F.struct("role", "text").alias("source"), span.alias("span")))).alias("all"))
    done = packed.select("conv", F.array_join(F.col("all.made"), GLUE).alias("formatted"), F.col("all.source").alias("source"), F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss_spans"))
    read = done.withColumn("turns", parse(F.col("formatted")))
    return read.select(F.col("conv").alias(conv_col), "formatted", "turns", "loss_spans", F.col("turns").eqNullSafe(F.col("source")).alias("exact"))


def learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    told = format_chats(rows).withColumn("loss", learned(F.col("formatted"), F.col("loss_spans")))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return told.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(replace(text, chr(92), chr(92) || 's'), '<turn>', chr(92) || 'o'), '</turn>', chr(92) || 'c'), '###', chr(92) || 'h') AS esc,
         contains(text, '<turn>') OR contains(text, '</turn>') OR contains(text, '###') OR contains(text, chr(92) || 's')
         OR contains(text, chr(92) || 'o') OR contains(text, chr(92) || 'c') OR contains(text, chr(92) || 'h') AS hard FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(10 + length(role) + 2 + length(CASE WHEN hard THEN esc ELSE text END) + 7) + count(*) - 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
