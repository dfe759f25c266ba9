"""Q5: the plan of a performance. A take's notes get their gestures, the chord under them, pitch and time targets, words and a score."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from beatlake.functions.scalars import rounded
from beatlake.operators import joins, planning, sequences
from beatlake.plans.music import _SETS, _chords_in_key
from beatlake.plans.registry import query
from beatlake.plans.sequence import _SPANS, bar_lines, note_spans
from beatlake.sources.catalog_io import score_rows
from beatlake.sources.fixtures import as_cte, events
from beatlake.sources.lineage import stored

_FIRST = as_cte("chords", "takes")
_PLAN = as_cte("chords", "takes", "notes", "onsets", "sections") + _SETS[len(_FIRST) :] + f""", {_SPANS},
nt AS (SELECT *, CASE WHEN spread_cents > 70 OR coalesce(bg < 0.06 AND step > 2, false) THEN 'slide' WHEN coalesce(bg < 0.08 AND step < -2.5 AND end_s - start_s < 0.2, false) THEN 'fall' END AS gesture, end_s - start_s < 0.16 AND coalesce(bg < 0.05 AND ag < 0.05, false) AS is_melisma
  FROM (SELECT *, start_s - lag(end_s) OVER w AS bg, lead(start_s) OVER w - end_s AS ag, midi - lag(midi) OVER w AS step, row_number() OVER (PARTITION BY take_id ORDER BY start_s) AS note_id FROM sn WINDOW w AS (PARTITION BY take_id ORDER BY start_s, end_s))),
hc AS (SELECT nt.*, y.* EXCLUDE (entity_id), take_id % 3 = 0 AS blues, end_s - start_s >= 0.3 AS exposed, 0.5::DOUBLE + (idx % 4) / 2.0::DOUBLE AS sal FROM nt ASOF LEFT JOIN y ON nt.take_id = y.entity_id AND nt.start_s >= y.bar * 4.0::DOUBLE),
he AS (SELECT *, list_concat(list_concat(tones, CASE WHEN exposed THEN tens ELSE pcs END), CASE WHEN blues THEN blue ELSE [] END) AS every FROM hc),
hk AS (SELECT *, list_distinct([x for x in every if NOT list_contains(avoid, x) OR (blues AND list_contains(blue, x))]) AS cand, CAST(round_even(midi, 0) AS INT) AS base FROM he),
ht AS (SELECT *, list_sort([struct_pack(a := abs(midi - x), x := x) for x in range(base - 3, base + 4) if list_contains(cand, x % 12)])[1] AS b FROM hk),
hf AS (SELECT *, CASE WHEN gesture IS NOT NULL OR is_melisma THEN 'keep' WHEN root IS NULL AND key_pc IS NULL THEN 'no_target' WHEN b IS NULL OR b.a > 1.2 THEN 'too_far' WHEN b.a * 100 < 4 THEN 'in_tune' ELSE 'move' END AS decision FROM ht),
gr AS (SELECT entity_id, seq * 4.0::DOUBLE + k * 0.25 AS t FROM sections, range(16) r(k)), h0 AS (SELECT hf.*, gr.t AS t0 FROM hf ASOF LEFT JOIN gr ON hf.take_id = gr.entity_id AND hf.start_s >= gr.t), h1 AS (SELECT h0.*, gr.t AS t1 FROM h0 ASOF LEFT JOIN gr ON h0.take_id = gr.entity_id AND h0.start_s <= gr.t),
h2 AS (SELECT *, start_s - CASE WHEN t0 IS NULL OR t1 - start_s < start_s - t0 THEN coalesce(t1, t0) ELSE t0 END AS e, least(greatest(0.6::DOUBLE * sal, 0), 0.95::DOUBLE) AS pull FROM h1),
h3 AS (SELECT *, CASE WHEN abs(e) <= 0.12 THEN -e * pull ELSE 0 END AS shift_s, CASE WHEN decision = 'move' THEN midi + (b.x - midi) * pull ELSE midi END AS target FROM h2),
wd AS (SELECT take_id, event_id, element, time_s - 0.06::DOUBLE AS a, greatest(time_s + 0.2::DOUBLE, time_s + 0.05::DOUBLE) + 0.06::DOUBLE AS z FROM onsets),
wo AS (SELECT wd.take_id, event_id, element, a, note_id, start_s AS b, round(least(z, end_s) - greatest(a, start_s), 9) AS o FROM wd JOIN nt ON wd.take_id = nt.take_id AND z > start_s AND a < end_s), wr AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o DESC, b, note_id DESC) AS n FROM wo),
wl AS (SELECT take_id, note_id, string_agg(element, ' ' ORDER BY a, element) AS lyric FROM wr WHERE n = 1 GROUP BY 1, 2),
plan AS (SELECT h3.*, lyric, takes.bpm FROM h3 LEFT JOIN wl USING (take_id, note_id) JOIN takes USING (take_id))"""


def performance(spark, d):
    """A row for each note, with its plan. All of it is by take and time; notes meet chords, slots and words
    by as-of joins and overlaps in spans of time. Each of these reads its notes several times, so they are written between, with what
    later steps need; notes are numbered where they stand in order anyway."""
    number = F.row_number().over(Window.partitionBy("take_id").orderBy("start_s", "end_s")).cast("long")
    notes = stored(sequences.gestures(note_spans(spark, d), "take_id").withColumn("note_id", number).select("take_id", "order_key", "idx", "note_id", "start_s", "end_s", "midi", "gesture", "is_melisma"))
    chords = _chords_in_key(spark, d).select(F.col("entity_id").alias("take_id"), (F.col("bar") * 4.0).alias("start_s"), "root", "quality", "key_pc", "key_mode")
    under = joins.asof_backward(notes, chords, "take_id", "start_s", ["root", "quality", "key_pc", "key_mode"])
    placed = stored(under.select("*", *(F.col(f"grid.{c}").alias(c) for c in ("root", "quality", "key_pc", "key_mode"))).drop("grid").withColumns({
        "genre": F.when(F.col("take_id") % 3 == 0, "Hip Hop").when(F.col("take_id") % 3 == 1, "pop"), "exposed": F.col("end_s") - F.col("start_s") >= 0.3, "salience": 0.5 + F.col("idx") % 4 / F.lit(2.0),
    }))
    slots = bar_lines(spark, d).select("take_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.col("time_s") + k * 0.25)).alias("time_s"))
    tuned = stored(planning.pitch_targets(placed).select("take_id", "order_key", "idx", "note_id", "start_s", "end_s", "midi", "salience", "decision", "target"))
    timed = planning.time_targets(tuned, slots, "take_id").drop("salience")
    words = events(spark, d, "onsets").select("take_id", F.col("event_id").alias("word_id"), F.col("element").alias("text"), F.col("time_s").alias("a_start"), (F.col("time_s") + 0.2).alias("a_end"))
    sung = planning.assign_words(words, notes.select("take_id", "note_id", F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end")), "take_id").select("take_id", "note_id", F.when(F.col("lyric") != "-", F.col("lyric")).alias("lyric"))
    return timed.join(sung, ["take_id", "note_id"], "left").join(events(spark, d, "takes").select("take_id", "bpm"), "take_id")


@query(_PLAN + """ SELECT take_id, order_key, idx, decision, round(target + 1e-9, 6) AS target, round(start_s + shift_s + 1e-9, 6) AS new_start_s, lyric FROM plan""")
def q05_performance_notes(spark, d):
    """Q5: decisions, targets and words of all notes."""
    return performance(spark, d).select("take_id", "order_key", "idx", "decision", rounded("target", 6).alias("target"), rounded("new_start_s", 6).alias("new_start_s"), "lyric")


@query(_PLAN + """ SELECT take_id, CAST(round_even((start_s + shift_s) * bpm / 60 * 480, 0) AS BIGINT) AS tick, CAST(greatest(1, round_even((end_s + shift_s) * bpm / 60 * 480, 0) - round_even((start_s + shift_s) * bpm / 60 * 480, 0)) AS BIGINT) AS length, CAST(round_even(target, 0) AS INT) AS pitch FROM plan""")
def q05_performance_score(spark, d):
    """The planned notes as a score."""
    return score_rows(performance(spark, d).select("take_id", "bpm", F.col("new_start_s").alias("start_s"), F.col("new_end_s").alias("end_s"), F.col("target").alias("midi")))


@query(_PLAN + """ SELECT take_id, count(*) AS n, count(*) FILTER (decision = 'move') AS moved, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'too_far') AS too_far, count(lyric) AS worded, round(avg(abs(target - midi) * 100) + 1e-9, 4) AS cents, round(avg(abs(shift_s)) + 1e-9, 6) AS shift_s FROM plan GROUP BY 1""")
def q05_performance_summary(spark, d):
    """What the plan does to each take."""
    x = performance(spark, d)
    count = lambda v: F.count_if(F.col("decision") == v)
    got = x.groupBy("take_id").agg(F.count(F.lit(1)).alias("n"), count("move").alias("moved"), count("keep").alias("kept"), count("too_far").alias("too_far"), F.count("lyric").alias("worded"), F.avg(F.abs(F.col("target") - F.col("midi")) * 100).alias("cents"), F.avg(F.abs(F.col("new_start_s") - F.col("start_s"))).alias("shift_s"))
    return got.withColumns({"cents": rounded("cents", 4), "shift_s": rounded("shift_s", 6)})
