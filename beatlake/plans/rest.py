"""Queries of acoustics and harmony."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.functions.scalars import rounded
from beatlake.operators import acoustics, harmony, sequences
from beatlake.plans.music import _SETS, _chords_in_key
from beatlake.plans.profile import _PROFILES, chroma
from beatlake.plans.registry import query
from beatlake.plans.sequence import _LEVELS, _SPANS, _TSEC, bar_lines, levels, note_spans
from beatlake.sources.fixtures import as_cte, events, table


@query(as_cte("level_frames") + """, p AS (SELECT take_id, greatest(quantile_cont(rms_db, 0.01), -75) AS lo, quantile_cont(rms_db, 0.99) AS hi FROM level_frames GROUP BY 1),
h AS (SELECT f.take_id, lo, hi, CAST(least(63, greatest(0, floor((rms_db - lo) / (hi - lo) * 64))) AS INT) AS bin, count(*) AS n FROM level_frames f JOIN p USING (take_id) WHERE hi > lo GROUP BY 1, 2, 3, 4),
x AS (SELECT *, sum(n) OVER w AS n0, sum(n * bin) OVER w AS s0, sum(n) OVER a AS na, sum(n * bin) OVER a AS sa FROM h WINDOW w AS (PARTITION BY take_id ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY take_id)),
v AS (SELECT *, round(n0 * (na - n0) * (s0 / n0 - (sa - s0) / (na - n0)) * (s0 / n0 - (sa - s0) / (na - n0)), 6) AS v FROM x WHERE n0 < na), o AS (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY v DESC, bin) AS k FROM v)
SELECT take_id, round(lo + (bin + 1) * (hi - lo) / 64 + 1e-9, 4) AS open_db, round(lo + (bin + 1) * (hi - lo) / 64 - 6 + 1e-9, 4) AS close_db FROM o WHERE k = 1""")
def w04_voice_activity(spark, d):
    return acoustics.voice_activity(events(spark, d, "level_frames"), "take_id").select("take_id", rounded("open_db", 4).alias("open_db"), rounded("close_db", 4).alias("close_db"))


@query(as_cte("chords") + """, x AS (SELECT entity_id, bar % 4 AS phase, round(avg(root), 9) AS m FROM chords GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY m DESC, phase) AS n FROM x)
SELECT entity_id, phase, m AS low_db FROM o WHERE n = 1""")
def a13_downbeat_phase(spark, d):
    """Chords as beats, their roots as the low band's level."""
    beats = events(spark, d, "chords").select("entity_id", F.col("bar").alias("idx"), F.col("root").cast("double").alias("low_db"))
    return acoustics.downbeat_phase(beats, "entity_id")


@query(as_cte("onsets") + """, x AS (SELECT take_id, 60 + strength / 100 AS midi, time_s - min(time_s) OVER (PARTITION BY take_id) AS t FROM onsets), l AS (SELECT *, max(t) OVER w AS d, regr_slope(midi, t) OVER w AS b, regr_intercept(midi, t) OVER w AS a FROM x WINDOW w AS (PARTITION BY take_id)),
y AS (SELECT take_id, t, (midi - a - b * t) * (0.5 - 0.5 * cos(2 * pi() * t / d)) AS y FROM l WHERE d >= 0.25), s AS (SELECT take_id, k / 2 AS f, sqrt(pow(sum(y * cos(pi() * k * t)), 2) + pow(sum(y * sin(pi() * k * t)), 2)) * 4 / count(*) * 100 AS p FROM y, range(2, 31) r(k) GROUP BY 1, 2),
m AS (SELECT take_id, max(p) FILTER (f BETWEEN 4 AND 8) AS p, arg_max(f, p) FILTER (f BETWEEN 4 AND 8) AS f, quantile_cont(p, 0.5) AS m FROM s GROUP BY 1)
SELECT take_id, 0 AS note, CASE WHEN p >= 5 * m AND p >= 12 THEN f END AS rate_hz, round(CASE WHEN p >= 5 * m AND p >= 12 THEN p END + 1e-9, 4) AS depth_cents FROM m""")
def a28_vibrato(spark, d):
    """Each take's onsets as the pitch frames of one note."""
    f = events(spark, d, "onsets").select("take_id", F.lit(0).alias("note"), "time_s", (60 + F.col("strength") / 100).alias("midi"))
    return acoustics.note_vibrato(f, ["take_id", "note"]).withColumn("depth_cents", rounded("depth_cents", 4))


@query(as_cte("notes") + f""", {_SPANS}, l AS (SELECT *, start_s - lag(end_s) OVER w AS bg, lead(start_s) OVER w - end_s AS ag, midi - lag(midi) OVER w AS step, (midi - round_even(midi, 0)) * 100 AS c FROM sn WINDOW w AS (PARTITION BY take_id ORDER BY start_s, end_s))
SELECT take_id, round(avg(spread_cents) + 1e-9, 5) AS vibrato_cents, round(avg(CASE WHEN spread_cents > 70 OR coalesce(bg < 0.06 AND step > 2, false) THEN 1 ELSE 0 END) + 1e-9, 6) AS scoop_share,
  round(avg(CASE WHEN end_s - start_s < 0.16 AND coalesce(bg < 0.05 AND ag < 0.05, false) THEN 1 ELSE 0 END) + 1e-9, 6) AS melisma_share, round(avg(c) + 1e-9, 5) AS intonation_cents, round(stddev_pop(c) + 1e-9, 5) AS intonation_spread FROM l GROUP BY 1""")
def a29_expression_profile(spark, d):
    n = sequences.gestures(note_spans(spark, d), "take_id").withColumn("vibrato_depth_cents", F.col("spread_cents"))
    got = acoustics.expression_profile(n, "take_id")
    return got.select("take_id", *(rounded(k, p).alias(k) for k, p in (("vibrato_cents", 5), ("scoop_share", 6), ("melisma_share", 6), ("intonation_cents", 5), ("intonation_spread", 5))))


@query(as_cte("level_frames", "sections") + f""", {_TSEC}, a AS (SELECT f.take_id, time_s, rms_db AS db, start_s AS onset FROM level_frames f ASOF JOIN tsec s ON f.take_id = s.entity_id AND f.time_s >= s.start_s), t AS (SELECT *, max(db) OVER (PARTITION BY take_id, onset) AS top FROM a),
s AS (SELECT take_id, onset, regr_slope(db, time_s) AS s, count(*) AS n FROM t WHERE db <= top - 5 AND db >= top - 35 GROUP BY 1, 2), r AS (SELECT take_id, -60 / s AS t FROM s WHERE n >= 3 AND s < 0), m AS (SELECT take_id, quantile_cont(t, 0.5) AS r, stddev_pop(t) AS d FROM r WHERE t >= 0.08 AND t <= 3 GROUP BY 1)
SELECT take_id, band, round(r + 1e-9, 6) AS rt60_s, band = 500 AS measured FROM m, (VALUES (125), (250), (500), (1000), (2000), (4000)) b(band) WHERE least(greatest(1 - d / r, 0), 1) >= 0.3""")
def a37_a38_rt60(spark, d):
    """Level frames as the envelope of one band, missing bands filled."""
    f = events(spark, d, "level_frames").select("take_id", "time_s", F.lit(500).alias("band"), F.col("rms_db").alias("db"))
    return acoustics.fill_bands(acoustics.rt60(f, bar_lines(spark, d), "take_id"), "take_id").withColumn("rt60_s", rounded("rt60_s", 6))


@query()
def a39_modulations(spark, d):
    return harmony.modulations(events(spark, d, "chords").select("entity_id", "bar", "root", "quality", F.lit(2.0).alias("duration_s")), "entity_id")


@query(f"""WITH p(key_pc, key_mode, t) AS ({_PROFILES}), c AS (SELECT label AS entity_id, unnest(range(12)) AS pc, unnest([abs(x)::DOUBLE for x in embedding[1:12]]) AS x FROM embeddings), f AS (SELECT entity_id, pc, avg(x) AS d FROM c GROUP BY 1, 2), r AS (SELECT entity_id, key_pc, key_mode, round(corr(d, t[pc + 1]), 9) AS r FROM f, p GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY r DESC, key_pc, key_mode DESC) AS n, key_pc = entity_id % 12 AND key_mode = 'minor' AS tag FROM r), b AS (SELECT entity_id, min(CASE n WHEN 1 THEN r END) AS r1, min(CASE n WHEN 2 THEN r END) AS r2, min(CASE n WHEN 1 THEN key_pc END) AS pc, min(CASE n WHEN 1 THEN key_mode END) AS mode, bool_or(n = 1 AND tag) AS eq, bool_or(n <= 4 AND tag) AS listed FROM o GROUP BY 1),
g AS (SELECT *, least(greatest((r1 - r2) / 0.06::DOUBLE * 0.5 + r1 * 0.5, 0), 1) AS conf FROM b), k AS (SELECT *, NOT eq AND listed AND conf < 0.75 AS adopt FROM g)
SELECT entity_id, CASE WHEN adopt THEN CAST(entity_id % 12 AS INT) ELSE pc END AS key_pc, CASE WHEN adopt THEN 'minor' ELSE mode END AS key_mode, round(r1 + 1e-9, 6) AS correlation, round(CASE WHEN adopt THEN greatest(conf, 0.55) WHEN eq THEN least(1, conf + 0.2) ELSE conf END::DOUBLE + 1e-9, 5) AS confidence FROM k""")
def a02_key_from_chroma(spark, d):
    tags = table(spark, d, "embeddings").select(F.col("label").alias("entity_id")).distinct().select("entity_id", (F.col("entity_id") % 12).cast("int").alias("tag_pc"), F.lit("minor").alias("tag_mode"))
    got = harmony.key_from_chroma(chroma(spark, d).select("entity_id", "chroma"), "entity_id", tags)
    return got.select("entity_id", "key_pc", "key_mode", rounded("correlation", 6).alias("correlation"), rounded("confidence", 5).alias("confidence"))


@query(as_cte("onsets", "sections") + """, b AS (SELECT take_id, count(*) AS n, count(*) FILTER (element = 'click') AS hats FROM onsets GROUP BY 1), g AS (SELECT entity_id, seq * 4.0::DOUBLE AS t FROM sections), e AS (SELECT *, t - lag(t) OVER (PARTITION BY entity_id ORDER BY t) AS d FROM g),
s AS (SELECT entity_id, max(t) - min(t) AS span, quantile_cont(d, 0.5) AS beat FROM e GROUP BY 1)
SELECT take_id, round(CASE WHEN span > 0 AND n >= 4 THEN n / span * beat END + 1e-9, 6) AS onset_rate, round(CASE WHEN span > 0 AND n >= 4 THEN hats / span * beat END + 1e-9, 6) AS hat_density FROM b JOIN s ON take_id = entity_id""")
def a43_onset_rate(spark, d):
    o = events(spark, d, "onsets").withColumn("element", F.when(F.col("element") == "click", "hat").otherwise(F.col("element")))
    return acoustics.event_rates(o, bar_lines(spark, d), "take_id").select("take_id", rounded("onset_rate", 6).alias("onset_rate"), rounded("hat_density", 6).alias("hat_density"))


@query(as_cte("onsets") + """, b AS (SELECT DISTINCT take_id, time_s FROM onsets), x AS (SELECT *, lead(time_s) OVER (PARTITION BY take_id ORDER BY time_s) - time_s AS d FROM b), y AS (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY take_id) AS m FROM x), z AS (SELECT *, coalesce(abs(d - m) > 0.1 * m, false) AS off FROM y),
u AS (SELECT *, sum(CASE WHEN off THEN 0 ELSE 1 END) OVER (PARTITION BY take_id ORDER BY time_s ROWS UNBOUNDED PRECEDING) AS run FROM z), s AS (SELECT take_id, run, min(time_s) AS s, max(time_s + d) AS e, abs(sum(d - m)) / max(m) AS b FROM u WHERE off GROUP BY 1, 2)
SELECT take_id, round(s + 1e-9, 6) AS start_s, round(e + 1e-9, 6) AS end_s, round(b + 1e-9, 5) AS beats_off FROM s WHERE b >= 0.5""")
def w16_bar_slips(spark, d):
    got = acoustics.bar_slips(events(spark, d, "onsets").select("take_id", "time_s").distinct(), "take_id")
    return got.select("take_id", rounded("start_s", 6).alias("start_s"), rounded("end_s", 6).alias("end_s"), rounded("beats_off", 5).alias("beats_off"))


@query(as_cte("sections") + """, g AS (SELECT entity_id AS take_id, seq * 4.0::DOUBLE AS time_s FROM sections), m AS (SELECT take_id, max(time_s) AS last, count(*) AS n FROM g GROUP BY 1)
SELECT * FROM g UNION ALL SELECT take_id, unnest([last + k * 4.0::DOUBLE for k in range(1, 1 + CAST(ceil((200 - last) / 4) AS BIGINT))]) FROM m WHERE n > 1 AND last < 200""")
def w17_extend_lattice(spark, d):
    bars = bar_lines(spark, d).select("take_id", "time_s")
    return acoustics.extend_lattice(bars, "take_id", bars.select("take_id").distinct().withColumn("end_s", F.lit(200.0)))


@query(as_cte("sections") + f""", {_LEVELS} SELECT entity_id, seq, round(energy + 1e-9, 6) AS energy FROM levels""")
def w23_annotate_sections(spark, d):
    """The contour at a section's middle is the section's own level."""
    x = levels(spark, d)
    got = harmony.annotate_sections(x.select("entity_id", "seq", "start_s", "end_s"), sequences.contour_points(x, "entity_id"), "entity_id")
    return got.select("entity_id", "seq", rounded("energy", 6).alias("energy"))


@query(as_cte("onsets").replace("WITH", "WITH RECURSIVE", 1) + """, x AS (SELECT take_id, time_s, 48 + strength / 4 AS midi, element <> 'view' AS voiced FROM onsets), u AS (SELECT *, sum(CASE WHEN voiced THEN 0 ELSE 1 END) OVER (PARTITION BY take_id ORDER BY time_s, midi ROWS UNBOUNDED PRECEDING) AS run FROM x),
v AS (SELECT *, row_number() OVER (PARTITION BY take_id, run ORDER BY time_s, midi) AS n FROM u WHERE voiced), f AS (SELECT take_id, run, n, time_s, midi FROM v WHERE n = 1
UNION ALL SELECT v.take_id, v.run, v.n, v.time_s, (v.midi - CASE WHEN abs(abs(v.midi - f.midi) - 12) < 1 THEN 12 * sign(v.midi - f.midi) WHEN abs(abs(v.midi - f.midi) - 24) < 1 THEN 24 * sign(v.midi - f.midi) ELSE 0 END) * (1 - 0.35::DOUBLE) + f.midi * 0.35::DOUBLE FROM f JOIN v ON v.take_id = f.take_id AND v.run = f.run AND v.n = f.n + 1)
SELECT take_id, time_s, round(midi + 1e-9, 6) AS midi FROM f""")
def w28_octave_repair(spark, d):
    f = events(spark, d, "onsets").select("take_id", "time_s", (48 + F.col("strength") / 4).alias("midi"), (F.col("element") != "view").alias("voiced"))
    return acoustics.octave_repair(f, "take_id").withColumn("midi", rounded("midi", 6))


@query(_SETS + """, b AS (SELECT *, CAST(60 + bar % 12 AS INT) AS base FROM y), t AS (SELECT *, [p for p in range(base + 1, base + 25) if list_contains(pcs, p % 12)][2:6] AS tried FROM b),
g AS (SELECT *, [p for p in tried if NOT list_contains(avoid, p % 12) AND p - base >= 2.5 AND (p - base) % 12 <> 6] AS good FROM t), n AS (SELECT *, coalesce(good[1], tried[5]) AS note FROM g)
SELECT entity_id, bar, CAST(note - greatest(0, ceil((note - 84) / 12)) * 12 AS DOUBLE) AS harmony FROM n""")
def p19_harmony_line(spark, d):
    lead = (60 + F.col("bar") % 12).cast("double")
    note = harmony.harmony_note(lead, *map(F.col, ("root", "quality", "key_pc", "key_mode")))
    return _chords_in_key(spark, d).select("entity_id", "bar", note.alias("harmony"))


@query()
def j13_timing_plan(spark, d):
    grid = bar_lines(spark, d).select("take_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.col("time_s") + k * 0.25)).alias("time_s"))
    return harmony.timing_plan(events(spark, d, "onsets").select("take_id", "event_id", "time_s", "strength"), grid, "take_id", 0.25).select("take_id", "event_id", F.round("limited_s", 6).alias("limited_s"))


@query("""
WITH e AS (SELECT vec_id, 0.5::DOUBLE + embedding[1]::DOUBLE / 5 AS swing, [x::DOUBLE for x in embedding[1:16]] AS o FROM embeddings), p AS (SELECT a.vec_id, abs(a.swing - b.swing) AS s, unnest(a.o) AS x, unnest(b.o) AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
g AS (SELECT vec_id, least(greatest(1 - any_value(s) / 0.12::DOUBLE, 0), 1) AS s, corr(x, y) AS r FROM p GROUP BY 1) SELECT vec_id, round(0.6 * s + 0.4 * (r + 1) / 2 + 1e-9, 6) AS compatibility FROM g""")
def j16_groove_compat(spark, d):
    """Vectors of one label against the next one's: 16 numbers as offsets, the first as swing."""
    e = table(spark, d, "embeddings").select("vec_id", (0.5 + F.col("embedding")[0] / 5).cast("double").alias("swing"), F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")).alias("offsets"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("swing").alias("b_swing"), F.col("offsets").alias("b_offsets"))
    return harmony.groove_compat(e.withColumnsRenamed({"swing": "a_swing", "offsets": "a_offsets"}).join(after, "vec_id")).select("vec_id", rounded("compatibility", 6).alias("compatibility"))


@query(as_cte("onsets", "sections") + """, f AS (SELECT take_id, min(time_s) AS first_s FROM onsets GROUP BY 1), x AS (SELECT take_id, first_s, seq * 4.0::DOUBLE AS bar FROM f JOIN sections ON take_id = entity_id WHERE abs(seq * 4.0::DOUBLE - first_s) <= 4), o AS (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY round(abs(bar - first_s), 9), bar) AS n FROM x)
SELECT take_id, bar AS bar_s, round(bar - first_s + 1e-9, 6) AS offset_s FROM o WHERE n = 1""")
def j26_placement(spark, d):
    first = events(spark, d, "onsets").groupBy("take_id").agg(F.min("time_s").alias("first_s"))
    return harmony.placement(first, bar_lines(spark, d), "take_id").select("take_id", "bar_s", rounded("offset_s", 6).alias("offset_s"))


@query(as_cte("takes") + """, x AS (SELECT take_id, CASE WHEN take_id % 3 = 0 THEN 1 + (take_id % 7 - 3) * 0.0005::DOUBLE END AS g, 1 + (take_id % 11 - 5) * 0.01::DOUBLE AS m, take_id % 9 AS n, 0.01::DOUBLE * (take_id % 5) AS p, 0.02::DOUBLE AS s FROM takes)
SELECT take_id, round(CASE WHEN g IS NOT NULL THEN CASE WHEN abs(g - 1) <= 0.001 THEN 1 ELSE g END WHEN abs(m - 1) > 0.002 AND n >= 6 AND p < 0.85::DOUBLE * s THEN 1 ELSE m END + 1e-9, 6) AS stretch FROM x""")
def j32_stretch_decision(spark, d):
    n = F.col("take_id")
    pairs = events(spark, d, "takes").select("take_id", F.when(n % 3 == 0, 1 + (n % 7 - 3) * 0.0005).alias("grid_ratio"), (1 + (n % 11 - 5) * 0.01).alias("match_ratio"), (n % 9).alias("n_onsets"), (0.01 * (n % 5)).alias("plain_error_s"), F.lit(0.02).alias("stretched_error_s"))
    return harmony.stretch_decision(pairs).select("take_id", rounded("stretch", 6).alias("stretch"))


@query()
def j28_dtw_pairs(spark, d):
    """Vectors of a label as chroma frames, in two orders of time."""
    c = chroma(spark, d).select("entity_id", F.col("vec_id"), "chroma").filter("entity_id is not null")
    a = c.select("entity_id", (F.col("vec_id") * 0.05).alias("time_s"), "chroma")
    return harmony.dtw_pairs(a, a.withColumn("time_s", F.col("time_s") * 1.1 + 0.3), "entity_id")


@query(as_cte("takes") + """, x AS (SELECT take_id, (take_id % 9) / 10.0::DOUBLE AS rt, -60 + take_id % 25 AS fl, (take_id % 4) / 8.0::DOUBLE AS oo FROM takes)
SELECT take_id, 'room' AS cue, CASE WHEN rt > 0.6 THEN 'fatal' ELSE 'warn' END AS severity FROM x WHERE rt > 0.35 UNION ALL SELECT take_id, 'floor', 'warn' FROM x WHERE fl > -45 UNION ALL SELECT take_id, 'range', 'warn' FROM x WHERE oo >= 0.25 UNION ALL SELECT take_id, 'tempo', 'info' FROM x""")
def p48_preroll_guidance(spark, d):
    n = F.col("take_id")
    t = events(spark, d, "takes").select("take_id", "bpm", (n % 9 / F.lit(10.0)).alias("rt60_s"), (-60 + n % 25).alias("floor_db"), (n % 4 / F.lit(8.0)).alias("out_of_range"))
    return acoustics.preroll_guidance(t)
