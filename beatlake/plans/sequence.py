"""Queries of the time joins and the sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.functions.scalars import rounded
from beatlake.operators import joins, sequences
from beatlake.plans.music import _CK, _FUNCTION, _chords_in_key
from beatlake.plans.registry import query
from beatlake.sources.fixtures import as_cte, events

# Sections of four seconds, of which the last is a gap; their starts serve as bar lines.
_TSEC = "tsec AS (SELECT entity_id, seq, label, CAST(seq * 4 AS DOUBLE) AS start_s, CAST(seq * 4 + 3 AS DOUBLE) AS end_s FROM sections)"


def timed_sections(spark, d):
    s = events(spark, d, "sections")
    return s.select("entity_id", "seq", "label", (F.col("seq") * 4).cast("double").alias("start_s"), (F.col("seq") * 4 + 3).cast("double").alias("end_s"))


def bar_lines(spark, d):
    return timed_sections(spark, d).select(F.col("entity_id").alias("take_id"), "seq", F.col("start_s").alias("time_s"))


@query(as_cte("onsets", "sections") + f", {_TSEC} SELECT event_id, seq, label FROM onsets JOIN tsec ON take_id = entity_id AND time_s >= start_s AND time_s < end_s")
def j06_interval_join(spark, d):
    return joins.interval_join(events(spark, d, "onsets"), timed_sections(spark, d).withColumnRenamed("entity_id", "take_id"), "take_id").select("event_id", "seq", "label")


@query(as_cte("onsets", "sections") + f""", {_TSEC}, n AS (SELECT take_id, event_id, time_s AS a, time_s + 0.1 + strength / 10 AS b FROM onsets)
SELECT event_id, seq FROM n JOIN tsec ON take_id = entity_id AND b > start_s AND a < end_s""")
def j07_interval_overlap(spark, d):
    notes = events(spark, d, "onsets").select("take_id", "event_id", F.col("time_s").alias("a_start"), (F.col("time_s") + 0.1 + F.col("strength") / 10).alias("a_end"))
    sections = timed_sections(spark, d).select(F.col("entity_id").alias("take_id"), "seq", F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"))
    return joins.overlap_join(notes, sections, "take_id").select("event_id", "seq")


@query(as_cte("onsets", "sections") + f", {_TSEC} SELECT event_id, seq AS bar, time_s - start_s AS into_s FROM onsets o ASOF LEFT JOIN tsec s ON o.take_id = s.entity_id AND o.time_s >= s.start_s")
def j08_asof_backward(spark, d):
    got = joins.asof_backward(events(spark, d, "onsets"), bar_lines(spark, d), "take_id", keep=["seq"])
    return got.select("event_id", F.col("grid.seq").alias("bar"), (F.col("time_s") - F.col("grid.time")).alias("into_s"))


_NEAR = f"""{_TSEC}, b AS (SELECT o.take_id, event_id, time_s, start_s AS before FROM onsets o ASOF LEFT JOIN tsec s ON o.take_id = s.entity_id AND o.time_s >= s.start_s),
n AS (SELECT b.*, start_s AS after FROM b ASOF LEFT JOIN tsec s ON b.take_id = s.entity_id AND b.time_s <= s.start_s),
near AS (SELECT *, CASE WHEN before IS NULL OR after - time_s < time_s - before THEN coalesce(after, before) ELSE before END AS slot FROM n)"""


@query(as_cte("onsets", "sections") + f", {_NEAR} SELECT event_id, slot, time_s - slot AS error_s FROM near")
def j09_asof_nearest(spark, d):
    return joins.asof_nearest(events(spark, d, "onsets"), bar_lines(spark, d), "take_id").select("event_id", F.col("grid.time").alias("slot"), "error_s")


@query(as_cte("onsets", "sections") + f", {_NEAR} SELECT event_id FROM near WHERE abs(time_s - slot) <= 0.25")
def j10_proximity_semi(spark, d):
    return joins.proximity_semi(events(spark, d, "onsets"), bar_lines(spark, d), "take_id").select("event_id")


@query(as_cte("onsets", "sections") + f""", {_NEAR}, p AS (SELECT take_id, 2 * pi() * (time_s - slot) / 4 AS a FROM near WHERE slot IS NOT NULL), m AS (SELECT take_id, avg(sin(a)) AS s, avg(cos(a)) AS c FROM p GROUP BY 1)
SELECT take_id, round(-atan2(s, c) * 4 / (2 * pi()) + 1e-9, 5) AS shift_s, round(sqrt(s * s + c * c) + 1e-9, 5) AS confidence FROM m""")
def j25_grid_shift(spark, d):
    from beatlake.operators.planning import grid_shift

    got = grid_shift(events(spark, d, "onsets").select("take_id", "time_s"), bar_lines(spark, d), "take_id", 4.0)
    return got.select("take_id", rounded("shift_s", 5).alias("shift_s"), rounded("confidence", 5).alias("confidence"))


@query(as_cte("onsets", "sections") + f""", {_NEAR}, s AS (SELECT take_id, avg(CASE WHEN abs(time_s - slot) <= 0.05 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM near GROUP BY 1),
g AS (SELECT entity_id, start_s - lag(start_s) OVER (PARTITION BY entity_id ORDER BY start_s) AS gap FROM tsec), c AS (SELECT entity_id, sum(least(0.1, coalesce(gap, 0.1))) AS covered FROM g GROUP BY 1)
SELECT take_id, round(share / least(1.0, covered / 31.0) + 1e-9, 5) AS lift, share / least(1.0, covered / 31.0) >= 1.3 AND n >= 15 AS reliable FROM s JOIN c ON take_id = entity_id""")
def j29_timing_check(spark, d):
    """Onsets as word starts against bar lines; takes last 31 seconds."""
    words = events(spark, d, "onsets").select("take_id", "time_s")
    length = words.select("take_id").distinct().withColumn("duration_s", F.lit(31.0))
    return joins.timing_check(words, bar_lines(spark, d), "take_id", length).select("take_id", rounded("lift", 5).alias("lift"), "reliable")


@query(as_cte("onsets", "sections") + f""", {_TSEC}, i AS (SELECT DISTINCT event_id, take_id FROM onsets JOIN tsec ON take_id = entity_id AND time_s >= start_s AND time_s <= end_s), a AS (SELECT take_id, count(*) AS n FROM i GROUP BY 1),
s AS (SELECT entity_id, sum(end_s - start_s) AS sung FROM tsec GROUP BY 1), e AS (SELECT take_id, count(*) AS every FROM onsets GROUP BY 1)
SELECT take_id, coalesce(n, 0) AS n_inside, round(CASE WHEN sung > 0 THEN coalesce(n, 0) / sung ELSE every / 31.0 END + 1e-9, 6) AS syllable_rate FROM e LEFT JOIN a USING (take_id) LEFT JOIN s ON take_id = entity_id""")
def j31_onsets_in_phrases(spark, d):
    onsets = events(spark, d, "onsets").select("take_id", "event_id", "time_s")
    phrases = timed_sections(spark, d).select(F.col("entity_id").alias("take_id"), "start_s", "end_s")
    got = joins.onsets_in_phrases(onsets, phrases, "take_id", onsets.select("take_id").distinct().withColumn("duration_s", F.lit(31.0)))
    return got.select("take_id", F.coalesce("n_inside", F.lit(0)).alias("n_inside"), rounded("syllable_rate", 6).alias("syllable_rate"))


@query(as_cte("onsets") + " SELECT event_id, time_s - lag(time_s) OVER (PARTITION BY take_id ORDER BY time_s, event_id) AS ioi_s FROM onsets")
def w01_ioi(spark, d):
    return sequences.ioi(events(spark, d, "onsets"), "take_id", "event_id").select("event_id", "ioi_s")


@query(as_cte("onsets") + """, b AS (SELECT DISTINCT take_id, time_s FROM onsets), n AS (SELECT *, lead(time_s) OVER (PARTITION BY take_id ORDER BY time_s) AS x FROM b)
SELECT take_id, round((time_s + x) / 2 + 1e-9, 6) AS time_s, round(60 / (x - time_s) + 1e-9, 4) AS bpm FROM n WHERE x > time_s""")
def w02_tempo_curve(spark, d):
    got = sequences.tempo_curve(events(spark, d, "onsets").select("take_id", "time_s").distinct(), "take_id")
    return got.select("take_id", rounded("time_s", 6).alias("time_s"), rounded("bpm", 4).alias("bpm"))


_ACTIVE = """m AS (SELECT *, CASE WHEN rms_db >= -40 THEN 1 WHEN rms_db < -46 THEN 0 END AS k FROM level_frames),
act AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY take_id ORDER BY time_s, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS active FROM m)"""


def active_frames(spark, d):
    frames = events(spark, d, "level_frames")
    w = sequences.in_time("take_id", "time_s", "event_id")
    return frames.withColumn("active", sequences.hysteresis(F.col("rms_db"), F.lit(-40.0), F.lit(-46.0), w))


@query(as_cte("level_frames") + f", {_ACTIVE} SELECT event_id, active FROM act")
def w05_hysteresis(spark, d):
    return active_frames(spark, d).select("event_id", "active")


_PHRASES = f"""{_ACTIVE}, o AS (SELECT * FROM act WHERE active), r AS (SELECT *, CASE WHEN coalesce(time_s - lag(time_s) OVER (PARTITION BY take_id ORDER BY time_s, event_id) > 0.35, true) THEN 1 ELSE 0 END AS new FROM o),
u AS (SELECT *, sum(new) OVER (PARTITION BY take_id ORDER BY time_s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r), g AS (SELECT take_id, run, min(time_s) AS s, max(time_s) AS e, count(*) AS n FROM u GROUP BY 1, 2),
ph AS (SELECT take_id, greatest(0, s - 0.03) AS start_s, e + 0.03 AS end_s, n FROM g WHERE e - s >= 0.25)"""


@query(as_cte("level_frames") + f", {_PHRASES} SELECT take_id, round(start_s + 1e-9, 6) AS start_s, round(end_s + 1e-9, 6) AS end_s, n AS n_frames FROM ph")
def w06_phrases(spark, d):
    got = sequences.regions(active_frames(spark, d), "take_id", "active", 0.35, 0.25, 0.03, "event_id")
    return got.select("take_id", rounded("start_s", 6).alias("start_s"), rounded("end_s", 6).alias("end_s"), "n_frames")


@query(as_cte("level_frames") + f""", {_PHRASES}, w AS (SELECT *, CASE WHEN coalesce(start_s - max(end_s) OVER (PARTITION BY take_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2, true) THEN 1 ELSE 0 END AS nw FROM ph),
v AS (SELECT *, sum(nw) OVER (PARTITION BY take_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS rn FROM w), rr AS (SELECT take_id, rn, min(start_s) AS s, max(end_s) AS e FROM v GROUP BY 1, 2),
x AS (SELECT take_id, min(s) FILTER (e - s >= 6) AS a, max(e) FILTER (e - s >= 6) AS b, arg_max(s, struct_pack(d := e - s, n := -s)) AS ls, arg_max(e, struct_pack(d := e - s, n := -s)) AS le FROM rr GROUP BY 1)
SELECT take_id, round(coalesce(a, ls) + 1e-9, 6) AS start_s, round(coalesce(b, le) + 1e-9, 6) AS end_s FROM x""")
def w08_performance_span(spark, d):
    got = sequences.performance_span(sequences.regions(active_frames(spark, d), "take_id", "active", 0.35, 0.25, 0.03, "event_id"), "take_id")
    return got.select("take_id", rounded("start_s", 6).alias("start_s"), rounded("end_s", 6).alias("end_s"))


_SPANS = """sp AS (SELECT take_id, order_key, idx, midi, CAST((row_number() OVER (PARTITION BY take_id ORDER BY order_key, idx, midi, duration_s) - 1) AS DOUBLE) * 0.25 AS start_s, duration_s, CAST((order_key * 13 + idx * 7) % 100 AS DOUBLE) AS spread_cents FROM notes),
sn AS (SELECT *, start_s + duration_s AS end_s FROM sp)"""


def note_spans(spark, d):
    w = sequences.in_time("take_id", "order_key", "idx", "midi", "duration_s")
    n = events(spark, d, "notes").withColumn("start_s", (F.row_number().over(w) - 1).cast("double") * 0.25)
    return n.withColumn("end_s", F.col("start_s") + F.col("duration_s")).withColumn("spread_cents", ((F.col("order_key") * 13 + F.col("idx") * 7) % 100).cast("double"))


@query(as_cte("notes") + f""", {_SPANS}, l AS (SELECT *, start_s - lag(end_s) OVER w AS bg, lead(start_s) OVER w - end_s AS ag, midi - lag(midi) OVER w AS step FROM sn WINDOW w AS (PARTITION BY take_id ORDER BY start_s, end_s))
SELECT take_id, order_key, idx, CASE WHEN spread_cents > 70 OR coalesce(bg < 0.06 AND step > 2, false) THEN 'slide' WHEN coalesce(bg < 0.08 AND step < -2.5 AND end_s - start_s < 0.2, false) THEN 'fall' END AS gesture,
  end_s - start_s < 0.16 AND coalesce(bg < 0.05 AND ag < 0.05, false) AS is_melisma FROM l""")
def w09_gestures(spark, d):
    return sequences.gestures(note_spans(spark, d), "take_id").select("take_id", "order_key", "idx", "gesture", "is_melisma")


@query(_CK + f""", f AS (SELECT *, {_FUNCTION} AS fn FROM deg), g AS (SELECT *, lead(degree) OVER w AS nd, lead(fn) OVER w AS nf, lead(bar) OVER w AS nb FROM f WINDOW w AS (PARTITION BY entity_id ORDER BY bar)),
k AS (SELECT entity_id, nb AS bar, CASE WHEN fn = 'D' AND nd = 0 THEN 'authentic' WHEN degree = 3 AND nd = 0 THEN 'plagal' WHEN degree = 4 AND nd = 5 THEN 'deceptive' WHEN nf = 'D' AND fn <> 'D' THEN 'half' END AS kind FROM g)
SELECT entity_id, bar, kind, CAST(CASE kind WHEN 'authentic' THEN 1.0 WHEN 'plagal' THEN 0.7 WHEN 'deceptive' THEN 0.6 ELSE 0.45 END AS DOUBLE) AS strength FROM k WHERE kind IS NOT NULL""")
def w10_cadences(spark, d):
    return sequences.cadences(_chords_in_key(spark, d), "entity_id").select("entity_id", "bar", "kind", "strength")


@query(_CK + """
, near AS (SELECT *, list_sort([struct_pack(a := abs(s - rel), i := list_position(steps, s) - 1) for s in steps])[1].i AS n FROM deg),
num AS (SELECT *, CASE WHEN degree IS NULL THEN 'b' ELSE '' END || list_extract(['I','II','III','IV','V','VI','VII'], CAST(coalesce(degree, n) + 1 AS INT)) AS x FROM near),
nn AS (SELECT entity_id, bar, CASE WHEN quality IN ('min', 'dim') THEN lower(x) ELSE x END || CASE quality WHEN 'dim' THEN 'o' ELSE '' END AS numeral FROM num),
pp AS (SELECT *, lag(numeral) OVER (PARTITION BY entity_id ORDER BY bar) AS before FROM nn)
SELECT entity_id, string_agg(numeral, ' ' ORDER BY bar) AS progression FROM pp WHERE before IS NULL OR before <> numeral GROUP BY 1""")
def w11_progression_fingerprint(spark, d):
    return sequences.progression_fingerprint(_chords_in_key(spark, d), "entity_id")


@query(as_cte("sections") + f""", {_TSEC}, n AS (SELECT entity_id, start_s, lead(start_s) OVER (PARTITION BY entity_id ORDER BY start_s) AS x FROM tsec), e AS (SELECT *, unnest(CASE WHEN x IS NULL THEN [0] ELSE range(16) END) AS slot FROM n)
SELECT entity_id AS take_id, CAST(slot AS INT) AS slot, CASE WHEN slot = 0 THEN start_s ELSE start_s + (x - start_s) * slot / 16 END AS time_s FROM e""")
def w12_subdivide(spark, d):
    return sequences.subdivide(bar_lines(spark, d), "take_id", 16)


@query(as_cte("onsets", "sections") + f""", {_TSEC}, an AS (SELECT entity_id, start_s AS time_s, start_s * 1.01 + (seq % 3) * 0.05 AS to_s FROM tsec),
b AS (SELECT o.take_id, event_id, o.time_s, a.time_s AS t0, a.to_s AS y0 FROM onsets o ASOF LEFT JOIN an a ON o.take_id = a.entity_id AND o.time_s >= a.time_s),
c AS (SELECT b.*, a.time_s AS t1, a.to_s AS y1 FROM b ASOF LEFT JOIN an a ON b.take_id = a.entity_id AND b.time_s <= a.time_s)
SELECT event_id, round(CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL OR t0 = t1 THEN y0 ELSE y0 + (time_s - t0) * (y1 - y0) / (t1 - t0) END + 1e-9, 6) AS mapped_s FROM c""")
def w15_map_times(spark, d):
    anchors = bar_lines(spark, d).withColumn("to_s", F.col("time_s") * 1.01 + (F.col("seq") % 3) * 0.05)
    return sequences.map_times(events(spark, d, "onsets"), anchors, "take_id").select("event_id", rounded("mapped_s", 6).alias("mapped_s"))


_ENERGY = "CAST((entity_id * 31 + seq * 17) % 100 AS DOUBLE) / 100"


@query(as_cte("sections") + f""", e AS (SELECT entity_id, seq, {_ENERGY} AS energy FROM sections), c AS (SELECT *, quantile_cont(energy, 0.7) OVER p AS hi, quantile_cont(energy, 0.3) OVER p AS lo, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS n, count(*) OVER p AS t FROM e WINDOW p AS (PARTITION BY entity_id))
SELECT entity_id, seq, CASE WHEN n = 1 AND energy < hi THEN 'intro' WHEN n = t AND energy < hi AND t > 1 THEN 'outro' WHEN energy >= hi THEN 'chorus' WHEN energy <= lo THEN 'break' ELSE 'verse' END AS label FROM c""")
def w18_label_sections(spark, d):
    s = events(spark, d, "sections").withColumn("energy", ((F.col("entity_id") * 31 + F.col("seq") * 17) % 100).cast("double") / 100)
    return sequences.label_sections(s.drop("label"), "entity_id").select("entity_id", "seq", "label")


@query(as_cte("catalog") + """, t AS (SELECT beat_id AS entity_id, 240.0 / bpm AS bar_s, CAST(60 + beat_id % 200 AS DOUBLE) AS duration_s FROM catalog), s AS (SELECT *, unnest(range(CAST(ceil(duration_s / (bar_s * 8)) AS BIGINT))) AS seq FROM t)
SELECT entity_id, CAST(seq AS INT) AS seq, round(seq * bar_s * 8 + 1e-9, 6) AS start_s, round(least(seq * bar_s * 8 + bar_s * 8, duration_s) + 1e-9, 6) AS end_s FROM s""")
def w19_fallback_sections(spark, d):
    tracks = events(spark, d, "catalog").select(F.col("beat_id").alias("entity_id"), (240.0 / F.col("bpm")).alias("bar_s"), (60 + F.col("beat_id") % 200).cast("double").alias("duration_s"))
    return sequences.fallback_sections(tracks).select("entity_id", "seq", rounded("start_s", 6).alias("start_s"), rounded("end_s", 6).alias("end_s"))


_LEVELS = """nn AS (SELECT *, row_number() OVER (PARTITION BY entity_id, label ORDER BY seq) - 1 AS nth, lead(label) OVER w AS nl, lag(label) OVER w AS pl FROM sections WINDOW w AS (PARTITION BY entity_id ORDER BY seq)),
bb AS (SELECT *, CAST(CASE label WHEN 'intro' THEN 0.30 WHEN 'verse' THEN 0.52 WHEN 'prehook' THEN 0.68 WHEN 'hook' THEN 0.86 ELSE 0.42 END AS DOUBLE) + CASE WHEN label = 'hook' THEN least(0.06::DOUBLE * nth, 0.12::DOUBLE) WHEN label = 'verse' THEN least(0.07::DOUBLE * nth, 0.14::DOUBLE) ELSE 0 END
  + CASE WHEN coalesce(nl = 'hook', false) AND label <> 'hook' THEN 0.08::DOUBLE ELSE 0 END AS r0 FROM nn),
rr AS (SELECT *, CASE WHEN coalesce(pl = 'bridge', false) AND label = 'hook' THEN least(r0 + 0.08::DOUBLE, 1) ELSE r0 END AS raw FROM bb),
mm AS (SELECT *, avg(raw) OVER (PARTITION BY entity_id) AS mean, CASE WHEN entity_id % 2 = 0 THEN 1.15::DOUBLE ELSE 0.65::DOUBLE END AS k FROM rr),
levels AS (SELECT *, least(greatest(mean + (raw - mean) * k, 0.05::DOUBLE), 1) AS energy FROM mm)"""


def levels(spark, d):
    s = timed_sections(spark, d).withColumn("genre", F.when(F.col("entity_id") % 2 == 0, "trap").otherwise("lofi"))
    return sequences.energy_levels(s, "entity_id", "genre")


@query(as_cte("sections") + f", {_LEVELS} SELECT entity_id, seq, round(energy + 1e-9, 6) AS energy FROM levels")
def w22_energy_contour(spark, d):
    return levels(spark, d).select("entity_id", "seq", rounded("energy", 6).alias("energy"))


@query(as_cte("sections") + f""", {_LEVELS}, j AS (SELECT *, energy - lag(energy) OVER (PARTITION BY entity_id ORDER BY seq) AS jump FROM levels)
SELECT entity_id, seq, round(jump + 1e-9, 6) AS jump, CAST(CASE WHEN jump >= 0.12 THEN 1 ELSE 0 END + CASE WHEN jump >= 0.2 THEN 2 ELSE 0 END + CASE WHEN jump >= 0.3 THEN 1 ELSE 0 END + CASE WHEN jump >= 0.3 AND label = 'hook' THEN 1 ELSE 0 END AS INT) AS n_effects FROM j WHERE jump IS NOT NULL""")
def w24_transitions(spark, d):
    return sequences.transitions(levels(spark, d), "entity_id").select("entity_id", "seq", rounded("jump", 6).alias("jump"), F.size("effects").alias("n_effects"))


@query(as_cte("sections") + f""", {_LEVELS}, c AS (SELECT entity_id, count(*) * 2 + 2 AS n, sum(energy) * 2 + arg_min(energy, seq) + arg_max(energy, seq) AS total, max(energy) - min(energy) AS contrast FROM levels GROUP BY 1)
SELECT entity_id, n, round(total + 1e-9, 5) AS total, round(contrast + 1e-9, 5) AS contrast FROM c""")
def w22_a46_contour_points(spark, d):
    """Points of the contour and its contrast."""
    p = sequences.contour_points(levels(spark, d), "entity_id")
    return p.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 5).alias("total"), rounded(F.max("value") - F.min("value"), 5).alias("contrast"))


@query(as_cte("level_frames") + """, x AS (SELECT *, rms_db * 3 AS r FROM level_frames), l AS (SELECT *, r >= quantile_cont(r, 0.95) OVER (PARTITION BY take_id) - 45 AS loud FROM x),
u AS (SELECT *, sum(CASE WHEN loud THEN 1 ELSE 0 END) OVER (PARTITION BY take_id ORDER BY time_s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l), m AS (SELECT *, max(run) OVER (PARTITION BY take_id) AS last FROM u),
c AS (SELECT take_id, run, count(*) AS n FROM m WHERE run > 0 AND run < last AND NOT loud GROUP BY 1, 2), t AS (SELECT DISTINCT take_id FROM level_frames)
SELECT take_id, coalesce(max(n), 0) AS silent_frames FROM t LEFT JOIN c USING (take_id) GROUP BY 1""")
def w26_longest_silence(spark, d):
    frames = events(spark, d, "level_frames").withColumn("rms_db", F.col("rms_db") * 3)
    return sequences.longest_silence(frames, "take_id", "event_id")


@query(as_cte("level_frames") + """, s AS (SELECT take_id, time_s, round(sum(rms_db) OVER (PARTITION BY take_id ORDER BY time_s, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 6) AS t, row_number() OVER (PARTITION BY take_id ORDER BY time_s, event_id) AS n, count(*) OVER (PARTITION BY take_id) AS c FROM level_frames)
SELECT take_id, arg_max(time_s, struct_pack(t := t, n := -time_s)) AS start_s, round(max(t), 4) AS level_sum FROM s WHERE n <= greatest(1, c - 9) GROUP BY 1""")
def w27_loudest_excerpt(spark, d):
    return sequences.loudest_excerpt(events(spark, d, "level_frames"), "take_id", 10, "event_id").select("take_id", "start_s", F.round("level_sum", 4).alias("level_sum"))


@query(as_cte("chords") + """, t AS (SELECT entity_id, (root + 3) % 12 AS root, quality, CAST(bar AS DOUBLE) * 2 AS start_s FROM chords)
SELECT *, coalesce(lead(start_s) OVER (PARTITION BY entity_id ORDER BY start_s), start_s + 4) AS end_s FROM t""")
def w32_chord_spans(spark, d):
    c = events(spark, d, "chords").withColumn("time_s", F.col("bar").cast("double") * 2)
    return sequences.chord_spans(c, "entity_id", 3)


@query(as_cte("phrases") + """, n AS (SELECT take_id, idx, row_number() OVER (PARTITION BY take_id ORDER BY idx) AS n, count(*) OVER (PARTITION BY take_id) AS c FROM phrases) SELECT take_id, idx FROM n WHERE c < 4 OR n > c // 2""")
def w33_fallback_hook_regions(spark, d):
    return sequences.fallback_hook_regions(events(spark, d, "phrases"), "take_id").select("take_id", "idx")


@query()
def w13_limit_by_neighbours(spark, d):
    """Onsets moved towards the nearest bar line, then limited by their neighbours."""
    near = joins.asof_nearest(events(spark, d, "onsets").select("take_id", "event_id", "time_s"), bar_lines(spark, d), "take_id")
    targets = near.select("take_id", "event_id", "time_s", (F.col("time_s") - 0.5 * F.coalesce("error_s", F.lit(0.0))).alias("target_s"))
    return sequences.limit_by_neighbours(targets, "take_id").select("event_id", F.round("limited_s", 6).alias("limited_s"))


@query(as_cte("onsets").replace("WITH", "WITH RECURSIVE", 1) + """, v AS (SELECT take_id, time_s, time_s * 1.02::DOUBLE AS to_s, row_number() OVER (PARTITION BY take_id ORDER BY time_s) AS n FROM onsets), f AS (SELECT take_id, n, time_s, to_s, true AS kept FROM v WHERE n = 1
UNION ALL SELECT take_id, n, CASE WHEN k THEN t ELSE t0 END, CASE WHEN k THEN y ELSE y0 END, k FROM (SELECT v.take_id, v.n, v.time_s AS t, v.to_s AS y, f.time_s AS t0, f.to_s AS y0, coalesce(v.time_s - f.time_s >= 0.045 AND (v.to_s - f.to_s) / (v.time_s - f.time_s) >= 0.8 AND (v.to_s - f.to_s) / (v.time_s - f.time_s) <= 1.25, false) AS k FROM f JOIN v ON v.take_id = f.take_id AND v.n = f.n + 1))
SELECT take_id, time_s, to_s FROM f WHERE kept""")
def w14_sanitise_anchors(spark, d):
    anchors = events(spark, d, "onsets").select("take_id", "time_s", (F.col("time_s") * 1.02).alias("to_s"))
    return sequences.sanitised_anchors(anchors, "take_id")


@query()
def w03_segment_notes(spark, d):
    """Onsets read as pitch frames: their strength as pitch, all but views voiced."""
    f0 = events(spark, d, "onsets").select("take_id", "time_s", (48 + F.col("strength") / 10).alias("midi"), (F.col("element") != "view").alias("voiced"))
    return sequences.segment_notes(f0, "take_id")


@query()
def w07_split_overlong(spark, d):
    """The span of each take, split at its quietest frames into regions of 12 seconds at most."""
    frames = events(spark, d, "level_frames").select("take_id", "time_s", "rms_db")
    spans = frames.groupBy("take_id").agg(F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"))
    return sequences.split_overlong(spans, frames, "take_id")
