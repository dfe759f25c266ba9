"""Chat formatting by perspective rotation: every participant's view of a conversation as training segments.

For each participant (a speaker that isn't the system) the whole conversation is rendered with that speaker as the assistant,
all others as named users and system turns as such. A row is one rendered turn of one view: its text, where it begins in
the view (so that views can be cut or joined without being held in one task), and whether its body is trained on. A long
conversation's offsets come from sums over blocks of its turns, so no task holds all of it.

Defined results: turns are in the order of turn (null last), then of speaker and text; a null or empty role is the speaker
"unknown"; a null text is empty; a null conv_id is a conversation of its own; repeated rows are turns of their own; a
conversation of system turns alone has no participant and no view; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The speaker whose turns are instructions and not a participant's; turns of one block.
SYSTEM, BLOCK = "system", 512
#: What a turn is rendered with: head of the role line, its end, end of the turn.
HEAD, BREAK, TAIL = "<|", "|>\n", "<|end|>\n"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), speaker, body and block; places are counted within blocks of turn numbers and then added up."""
    clean = turns.select("conv_id", "turn", F.when(F.coalesce(F.col("role"), F.lit("")) == "", "unknown").otherwise(F.col("role")).alias("speaker"), F.coalesce("text", F.lit("")).alias("body"))
    # Blocks are ranges of turn numbers: null ones come last.
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit((1 << 62)))
    clean = clean.withColumn("block", block)
    inner = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "speaker", "body")) - 1
    before = clean.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("_n")).withColumnsRenamed({"conv_id": "_c", "block": "_b"}).drop("_n")
    placed = clean.withColumn("_inner", inner).join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    return placed.select("conv_id", (F.col("_inner") + F.col("_before")).alias("place"), "speaker", "body", "block")


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, place, role, name, segment, start (code points before it in the view), trained, body_start and
    body_end (the trained span, in the view; null if the turn isn't trained on)."""
    placed = ordered_turns(turns)
    who = turns.select("conv_id", F.when(F.coalesce(F.col("role"), F.lit("")) == "", "unknown").otherwise(F.col("role")).alias("perspective")).filter(F.col("perspective") != SYSTEM).distinct()
    # Participants meet a conversation's blocks first, so that a long conversation's turns are spread over many keys.
    blocks = placed.select("conv_id", "block").distinct().withColumnsRenamed({"conv_id": "_c", "block": "_b"})
    who = blocks.join(who, F.col("_c").eqNullSafe(F.col("conv_id"))).select("_c", "_b", "perspective")
    views = placed.join(who, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(mine, "assistant").otherwise("user")
    name = F.when((F.col("speaker") != SYSTEM) & ~mine, F.col("speaker"))
    head = F.concat(F.lit(HEAD), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit(BREAK))
    views = views.withColumns({"role": role, "name": name, "_head": F.length(head), "segment": F.concat(head, F.col("body"), F.lit(TAIL)), "trained": mine})
    size = F.length("segment")
    sums = views.groupBy("conv_id", "perspective", "block").agg(F.sum(size).alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("conv_id", "perspective").orderBy("block")) - F.col("_n")).withColumnsRenamed({"conv_id": "_c", "perspective": "_p", "block": "_b"}).drop("_n")
    inner = F.sum(size).over(Window.partitionBy("conv_id", "perspective", "block").orderBy("place")) - size
    views = views.withColumn("_inner", inner).join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("block") == F.col("_b")))
    views = views.withColumn("start", F.col("_inner") + F.col("_before"))
    at = F.col("start") + F.col("_head")
    return views.select("conv_id", "perspective", "place", "role", "name", "segment", "start", "trained", F.when(mine, at).alias("body_start"), F.when(mine, at + F.length("body")).alias("body_end"))


PERSPECTIVES_SQL = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker, coalesce(text, '') AS body FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, body) - 1 AS place FROM t),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (
  SELECT p.conv_id, perspective, place, speaker, body,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id),
s AS (SELECT *, '<|' || role || CASE WHEN name IS NULL THEN '' ELSE ' name=' || name END || '|>' || chr(10) AS head FROM v),
r AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM s),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY place) - length(segment) AS BIGINT) AS start FROM r)
SELECT conv_id, perspective, place, role, name, segment, start, speaker = perspective AS trained,
  CASE WHEN speaker = perspective THEN start + length(head) END AS body_start,
  CASE WHEN speaker = perspective THEN start + length(head) + length(body) END AS body_end
FROM o
"""
