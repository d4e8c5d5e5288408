"""Chat formatting: the same dialogue from the point of view of each of its participants.

For every participant the dialogue is rendered with that speaker as the assistant and the others as named users; the
masks are the spans of what the speaker says, on which a model would be trained. DataFrame operations only: the turns of
a dialogue are gathered once, the participants beside them, and each rendering is an expression over the gathered turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Turn numbers of one part: a dialogue that goes on beyond them continues in further rows, so no row is unbounded.
PART_TURNS = 1024
#: The role that takes no part in a dialogue, and the marks around a turn.
SYSTEM = "system"
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"


def _head(role: Column, speaker: Column) -> Column:
    """What stands before a turn: the assistant for the speaker's own, a named user for others'."""
    named = F.when(role == F.lit(SYSTEM), F.lit(SYSTEM)).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), named, F.lit(f"{CLOSE}\n"))


def rotate_perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, speaker, n_turns, n_own, text, masks) for each dialogue, part of it and participant.

    A part holds the turns numbered part * part_turns up to the next part's; nearly all dialogues have the part 0 only.
    Turns go by number, then role, then text; repeated rows are repeated turns. A null turn number counts as -1 (part -1,
    before the others), a null or empty role as "unknown", a null text as empty; rows of a null dialogue are one dialogue
    with a null id. The system role speaks but is no participant, so a dialogue of system turns alone has no rows. masks:
    (start, end) in code points of text, end exclusive, of the speaker's words with their end mark, in order: what the
    speaker is to say and where to stop. An empty table gives no rows; columns other than the four named are not looked at.
    """
    role = F.when(F.coalesce(F.col(f"`{role_col}`"), F.lit("")) == "", "unknown").otherwise(F.col(f"`{role_col}`"))
    turn = F.coalesce(F.col(f"`{turn_col}`").cast("long"), F.lit(-1))
    said = conversations.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.floor(turn / F.lit(part_turns)).cast("long").alias("part"),
        F.struct(turn.alias("turn"), role.cast("string").alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).alias("said"),
    )
    # a part's turns and who is in it meet in one row; whoever speaks only in other parts comes from the whole dialogue
    parts = said.groupBy("conv", "part").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    who = said.where(F.col("said.role") != SYSTEM).select("conv", F.col("said.role").alias("speaker")).distinct()
    both = parts.join(who, parts.conv.eqNullSafe(who.conv)).select(parts.conv.alias("conv_id"), "part", "speaker", "turns")
    speaker = F.col("speaker")
    shown = F.transform("turns", lambda t: F.struct((t.role == speaker).alias("own"), _head(t.role, speaker).alias("head"), F.concat(t.text, F.lit(END)).alias("body")))
    both = both.withColumn("shown", shown)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))

    def step(acc, t):
        begin = acc["at"] + F.char_length(t["head"])
        end = (begin + F.char_length(t["body"])).cast("long")
        masks = F.when(t["own"], F.concat(acc["masks"], F.array(F.struct(begin.cast("long").alias("start"), end.alias("end"))))).otherwise(acc["masks"])
        return F.struct(end.alias("at"), masks.alias("masks"))

    return both.select(
        "conv_id",
        "part",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("shown", lambda t: t["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        F.aggregate("shown", start, step)["masks"].alias("masks"),
    )


def op5_chat_formatting(spark, sf_dir):
    done = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))), ",")
    return done.withColumn("masks", spans)


OP5_SQL = f"""
WITH said AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS role, coalesce(text, '') AS text FROM conversations
), who AS (
  SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> '{SYSTEM}'
), shown AS (
  SELECT s.conv_id, CAST(floor(s.turn / {PART_TURNS}.0) AS BIGINT) AS part, w.speaker, s.turn, s.role, s.text, s.role = w.speaker AS own,
    '{OPEN}' || CASE WHEN s.role = '{SYSTEM}' THEN '{SYSTEM}' WHEN s.role = w.speaker THEN 'assistant' ELSE 'user name=' || s.role END || '{CLOSE}' || chr(10) AS head,
    s.text || '<|end|>' || chr(10) AS body
  FROM said s JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS until,
    row_number() OVER (PARTITION BY conv_id, part, speaker ORDER BY turn, role, text) AS k
  FROM shown
)
SELECT conv_id, part, speaker, count(*) AS n_turns, CAST(sum(CAST(own AS BIGINT)) AS BIGINT) AS n_own, string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(until - length(body) AS BIGINT) || ':' || CAST(until AS BIGINT), ',' ORDER BY k) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, part, speaker
"""
