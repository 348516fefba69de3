"""Operator 1: chat formatting with Spark expressions.

``format_chats`` collects the turns of a conversation as structs, sorts them, merges
adjacent turns of one role into a block and joins the blocks to one text::

    [INST]role[/INST]text<s>text</s>[INST]role[/INST]text</s>

Control strings inside roles and texts are escaped reversibly: a backslash is doubled, and
a backslash goes behind the first character of each control string. So no control string
occurs in an escaped text, and removing one backslash before each character restores it.

Defined cases: rows are ordered by (turn, role, text), nulls first; repeated rows stay
repeated turns; a null text or role is empty; a null conv_id is a conversation of its own;
an empty table gives an empty result; other columns of the input are ignored. A formatted
conversation is one row, so its length is bound by what a Spark row holds (2 GB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import table


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings; they must hold no backslash and none may lie inside another."""

    open: str = "[INST]"
    header_end: str = "[/INST]"
    join: str = "<s>"
    close: str = "</s>"
    loss_role: str = "assistant"

    def escape(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        controls = (self.open, self.header_end, self.join, self.close)
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)
        return F.regexp_replace(doubled, starts, r"$0\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: conv_id, n_blocks, formatted, loss_spans.

    ``loss_spans`` lists [start, end) in code points of ``formatted`` for each text of
    the loss role, in order.
    """
    t = template
    piece = F.struct(
        F.col("turn"),
        t.escape(F.coalesce("role", F.lit(""))).alias("role"),
        t.escape(F.coalesce("text", F.lit(""))).alias("text"),
    )
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    begins = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    rows = rows.withColumn("begins", begins)
    block = lambda s, k: F.struct(
        F.get("turns", s)["role"].alias("role"),
        F.transform(
            F.slice("turns", s + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - s), lambda x: x["text"]
        ).alias("texts"),
    )
    rows = rows.withColumn("blocks", F.transform("begins", block))
    written = lambda b: F.concat(
        F.lit(t.open), b["role"], F.lit(t.header_end), F.array_join(b["texts"], t.join), F.lit(t.close)
    )
    head, sep, tail = len(t.open) + len(t.header_end), len(t.join), len(t.close)
    # for each text: characters since the end of the last one, its own, and whether it is learnt
    part = lambda b, k: F.transform(
        b["texts"],
        lambda x, i: F.struct(
            F.when(i > 0, F.lit(sep)).otherwise(F.length(b["role"]) + F.when(k > 0, head + tail).otherwise(head)).alias("lead"),
            F.length(x).alias("own"),
            (b["role"] == t.loss_role).alias("learnt"),
        ),
    )
    rows = rows.withColumns({
        "formatted": F.array_join(F.transform("blocks", written), ""),
        "parts": F.flatten(F.transform("blocks", part)),
    })
    spans = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda acc, p: F.struct(
        (acc["at"] + p["lead"] + p["own"]).alias("at"),
        F.when(
            p["learnt"],
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["lead"]).alias("start"), (acc["at"] + p["lead"] + p["own"]).alias("end")))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), spans.alias("spans"))
    return rows.select(
        "conv_id",
        F.size("blocks").alias("n_blocks"),
        "formatted",
        F.aggregate("parts", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_back(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Parse ``formatted``: adds ``turns`` (role, text; unescaped) and ``loss_texts`` (by span)."""
    t = template
    ended = F.split("formatted", re.escape(t.close))
    chats = chats.withColumn("_blocks", F.slice(ended, 1, F.size(ended) - 1))
    turns = lambda b: F.transform(
        F.split(F.get(F.split(b, re.escape(t.header_end)), F.lit(1)), re.escape(t.join)),
        lambda x: F.struct(
            t.unescape(F.substring(F.get(F.split(b, re.escape(t.header_end)), F.lit(0)), len(t.open) + 1, 2**31 - 1)).alias("role"),
            t.unescape(x).alias("text"),
        ),
    )
    learnt = lambda s: t.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    return chats.withColumns({
        "turns": F.flatten(F.transform("_blocks", turns)),
        "loss_texts": F.transform("loss_spans", learnt),
    }).drop("_blocks")


def with_probe(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, whose two texts consist of control strings."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_back(format_chats(with_probe(table(spark, sf_dir, "conversations"))))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"regexp_replace(replace({0}, '\', '\\'), '(\[)(INST\]|/INST\])|(<)(s>|/s>)', '\1\3\\\2\4', 'g')"

OP1_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS begins, row_number() OVER w AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length({_ESC.format('text')})) + coalesce(sum(17 + length({_ESC.format('role')})) FILTER (begins), 0)
   + 3 * count(*) FILTER (NOT begins))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
