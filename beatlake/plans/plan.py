"""Queries of planning, grading, arrangement, documents and live takes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from beatlake.functions.scalars import rounded
from beatlake.operators import arrangement, grading, planning
from beatlake.plans.music import _GENRE, _SETS, _chords_in_key, _genre
from beatlake.plans.profile import _RANKED
from beatlake.plans.registry import query
from beatlake.plans.sequence import _SPANS, _TSEC, bar_lines, note_spans, timed_sections
from beatlake.sources.catalog_io import score_rows
from beatlake.sources.fixtures import as_cte, events, table
from beatlake.streaming import live

_GATES = """g AS (
  SELECT *, -10.5 - lufs AS under, abs(-10.5 - lufs) <= 1.5 AS near, -10.5 - lufs > 0 AND true_peak_db >= -1.5 AND -10.5 - lufs <= 3.5 AS pol FROM renders),
gl AS (SELECT render_id, unnest([struct_pack(gate := 'true_peak', passed := true_peak_db <= -0.9, severity := 'error'), struct_pack(gate := 'loudness', passed := near OR pol, severity := CASE WHEN near THEN 'warning' WHEN pol THEN 'info' ELSE 'warning' END),
  struct_pack(gate := 'mono_compatibility', passed := mono_loss_db <= 3, severity := 'error'), struct_pack(gate := 'clipping', passed := clip_pct < 0.01, severity := 'error'), struct_pack(gate := 'continuity', passed := gap_s <= 3, severity := 'warning')]) AS x FROM g),
gates AS (SELECT render_id, x.gate AS gate, x.passed AS passed, x.severity AS severity FROM gl)"""


@query(as_cte("renders") + f", {_GATES} SELECT * FROM gates")
def a30_gates(spark, d):
    return grading.gates(events(spark, d, "renders")).select("render_id", "gate", "passed", "severity")


_GRADED = f"""{_GATES}, c AS (SELECT render_id, count(*) FILTER (NOT passed AND severity = 'error') AS errors, count(*) FILTER (NOT passed AND severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM gates GROUP BY 1),
sc AS (SELECT g.render_id, errors, warnings, 0.4::DOUBLE * round(least(greatest(1 - errors * 0.35::DOUBLE - warnings * 0.08::DOUBLE, 0), 1) + 1e-9, 4) + 0.25::DOUBLE * 0.7::DOUBLE + 0.15::DOUBLE * round(least(greatest(1 - CASE WHEN infos > 0 THEN greatest(0, -under) ELSE abs(under) END / 6, 0), 1) + 1e-9, 4) AS score, errors = 0 AS passed FROM g JOIN c USING (render_id))"""


@query(as_cte("renders") + f", {_GRADED} SELECT render_id, errors, warnings, round(score + 1e-9, 5) AS score, passed FROM sc")
def a30_graded(spark, d):
    """Q7: A30, A49."""
    return grading.graded(events(spark, d, "renders")).select("render_id", "errors", "warnings", rounded("score", 5).alias("score"), "passed")


@query(as_cte("renders") + f""", {_GATES}, r(gate, parameter, x) AS (VALUES ('true_peak', 'lufs_target', -1.0), ('mono_compatibility', 'double_gain_db', -4.0), ('clipping', 'lufs_target', -1.5))
SELECT render_id, parameter, CAST(sum(x) AS DOUBLE) AS amount FROM gates JOIN r USING (gate) WHERE NOT passed GROUP BY 1, 2""")
def a31_collect_repairs(spark, d):
    return grading.collect_repairs(grading.gates(events(spark, d, "renders")))


@query(as_cte("renders") + f", {_GRADED} SELECT render_id, row_number() OVER (PARTITION BY render_id % 50 ORDER BY passed DESC, round(score, 9) DESC, render_id) AS place FROM sc")
def k04_rank_renders(spark, d):
    """Fifty groups of renders."""
    scores = grading.graded(events(spark, d, "renders")).withColumns({"g": F.col("render_id") % 50, "score": F.round("score", 9)})
    return grading.ranked_renders(scores, "g").select("render_id", "place")


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS render_id, l_linenumber AS attempt FROM lineitem), s AS (SELECT *, (render_id + attempt) % 2 = 0 AS passed, ((render_id * 7 + attempt * 31) % 100) / 100.0::DOUBLE AS score FROM a WHERE attempt <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY render_id ORDER BY passed DESC, score DESC, attempt) AS n FROM s)
SELECT render_id, attempt, passed, score FROM o WHERE n = 1""")
def k05_best_attempt(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("render_id"), F.col("l_linenumber").alias("attempt")).distinct()
    a = a.withColumns({"passed": (F.col("render_id") + F.col("attempt")) % 2 == 0, "score": ((F.col("render_id") * 7 + F.col("attempt") * 31) % 100) / F.lit(100.0)})
    return grading.best_attempt(a, "render_id")


@query(as_cte("notes", "takes") + """, n AS (SELECT take_id, midi, CAST(round_even(midi, 0) AS INT) AS base, [(x + key_pc) % 12 for x in CASE WHEN key_mode = 'major' THEN [0,2,4,5,7,9,11] ELSE [0,2,3,5,7,8,10] END] AS pcs FROM notes JOIN takes USING (take_id) WHERE duration_s >= 0.15)
SELECT take_id, round(quantile_cont(list_min([abs(midi - x) for x in range(base - 2, base + 3) if list_contains(pcs, x % 12)]) * 100, 0.5) + 1e-9, 4) AS tuning_cents, count(*) AS n FROM n GROUP BY 1""")
def a33_tuning_error(spark, d):
    notes = events(spark, d, "notes").join(events(spark, d, "takes").select("take_id", "key_pc", "key_mode"), "take_id")
    return grading.tuning_error(notes, "take_id").select("take_id", rounded("tuning_cents", 4).alias("tuning_cents"), "n")


def asked_takes(spark, d):
    t, n = events(spark, d, "takes"), F.col("take_id")
    return t.select("take_id", (n % 20).cast("double").alias("duration_s"), F.when(n % 50 == 0, "no_voice").otherwise("voice").alias("voice"), F.element_at(F.array(*map(F.lit, ("clean", "light", "heavy", "severe"))), (n % 4 + 1).cast("int")).alias("noise"), (n % 5).cast("double").alias("lead_in_s"),
                    "key_confidence", (n % 10 / F.lit(10.0)).alias("bpm_confidence"), (n % 7 / F.lit(7.0)).alias("performance_confidence"), F.when(n % 3 == 0, "default").otherwise("declared").alias("language_source"), (n % 12).alias("entry_bar"))


_ASKED = """a AS (SELECT take_id, take_id AS n, key_confidence FROM takes),
q AS (SELECT take_id, unnest(list_concat(list_concat(list_concat(CASE WHEN n % 20 < 6 THEN ['block length'] ELSE [] END, CASE WHEN n % 50 = 0 THEN ['block voice'] ELSE [] END), list_concat(CASE WHEN n % 4 = 3 THEN ['block noise'] ELSE [] END, CASE WHEN n % 4 = 2 THEN ['warn noise'] ELSE [] END)),
  list_concat(list_concat(list_concat(CASE WHEN n % 5 >= 3 THEN ['info lead_in'] ELSE [] END, CASE WHEN (n % 7) / 7.0::DOUBLE < 0.7::DOUBLE THEN ['warn performance'] ELSE [] END), list_concat(CASE WHEN n % 3 = 0 THEN ['info language'] ELSE [] END, CASE WHEN key_confidence < 0.5 THEN ['warn key'] ELSE [] END)),
    list_concat(CASE WHEN (n % 10) / 10.0::DOUBLE < 0.4::DOUBLE THEN ['warn bpm'] ELSE [] END, CASE WHEN n % 12 > 8 THEN ['info entry'] ELSE [] END)))) AS x FROM a),
questions AS (SELECT take_id, split_part(x, ' ', 1) AS severity, split_part(x, ' ', 2) AS question FROM q)"""


@query(as_cte("takes") + f", {_ASKED} SELECT * FROM questions")
def p45_questions(spark, d):
    return planning.questions(asked_takes(spark, d)).select("take_id", "severity", "question")


@query(as_cte("takes") + f", {_ASKED}, i AS (SELECT take_id, 'length' AS question FROM takes WHERE take_id % 3 = 1) SELECT q.take_id, q.question FROM questions q LEFT JOIN i USING (take_id, question) WHERE severity = 'block' AND i.take_id IS NULL")
def p46_unanswered_blocks(spark, d):
    """A third of the takes answer the question on length, a third refuse."""
    intents = events(spark, d, "takes").select("take_id", F.lit("length").alias("question"), F.when(F.col("take_id") % 3 == 1, "keep it").when(F.col("take_id") % 3 == 2, " No ").alias("answer"))
    return planning.unanswered_blocks(planning.questions(asked_takes(spark, d)), intents).select("take_id", "question")


@query(as_cte("takes") + """, i AS (SELECT take_id, CASE take_id % 5 WHEN 0 THEN 'auto' WHEN 1 THEN ' Rap ' WHEN 2 THEN 'opera' END AS performance, CASE take_id % 4 WHEN 0 THEN 'off' WHEN 1 THEN '0.5' WHEN 2 THEN '1.5' END AS tuning, CASE take_id % 7 WHEN 0 THEN '300' WHEN 1 THEN 'fast' WHEN 2 THEN '120' END AS bpm FROM takes),
v AS (SELECT *, CASE WHEN performance = 'opera' THEN 1 ELSE 0 END + CASE WHEN tuning = '1.5' THEN 1 ELSE 0 END + CASE WHEN bpm IN ('300', 'fast') THEN 1 ELSE 0 END AS bad FROM i)
SELECT take_id, bad AS faults, CASE WHEN bad = 0 AND performance = ' Rap ' THEN 'rap' END AS performance, CASE WHEN bad = 0 THEN CASE tuning WHEN 'off' THEN 0.0::DOUBLE WHEN '0.5' THEN 0.5::DOUBLE END END AS tuning, CASE WHEN bad = 0 AND bpm = '120' THEN 120.0::DOUBLE END AS bpm FROM v""")
def p47_validate_intents(spark, d):
    n = F.col("take_id")
    none = F.lit(None).cast("string")
    rows = events(spark, d, "takes").select("take_id", F.when(n % 5 == 0, "auto").when(n % 5 == 1, " Rap ").when(n % 5 == 2, "opera").alias("performance"), F.when(n % 4 == 0, "off").when(n % 4 == 1, "0.5").when(n % 4 == 2, "1.5").alias("tuning"),
                                            F.when(n % 7 == 0, "300").when(n % 7 == 1, "fast").when(n % 7 == 2, "120").alias("bpm"), none.alias("timing"), none.alias("loudness"), none.alias("nudge"))
    good, bad = planning.validated_intents(rows)
    return good.select("take_id", F.lit(0).alias("faults"), "performance", "tuning", "bpm").unionByName(bad.select("take_id", F.size("faults").alias("faults"), none.alias("performance"), F.lit(None).cast("double").alias("tuning"), F.lit(None).cast("double").alias("bpm")))


@query(as_cte("takes") + """, x AS (SELECT take_id AS n, bpm, key_confidence AS c, CASE WHEN take_id % 3 = 0 THEN 140.0::DOUBLE ELSE 0 END AS b, take_id % 6 = 0 AS st, take_id % 9 = 0 AS bl, CASE WHEN take_id % 4 = 0 THEN 99.0::DOUBLE END AS u FROM takes)
SELECT n AS take_id, CASE WHEN b > 0 AND (st OR bl) THEN b WHEN u > 0 THEN u WHEN c >= 0.25 THEN bpm END AS bpm, CASE WHEN b > 0 AND (st OR bl) THEN 'beat' WHEN u > 0 THEN 'user' WHEN c >= 0.25 THEN 'detected' END AS source, CASE WHEN u IS NOT NULL AND b > 0 THEN 1 ELSE 0 END AS warnings FROM x""")
def p58_resolve_tempo(spark, d):
    n = F.col("take_id")
    rows = events(spark, d, "takes").select("take_id", "bpm", F.col("key_confidence").alias("bpm_confidence"), F.when(n % 3 == 0, 140.0).otherwise(0.0).alias("beat_bpm"), (n % 6 == 0).alias("beat_stated"), (n % 9 == 0).alias("bleed_removed"), F.when(n % 4 == 0, 99.0).alias("user_bpm"), F.lit(0.01).alias("grid_error_s"))
    return planning.resolve_tempo(rows).select("take_id", "tempo.bpm", "tempo.source", F.size("tempo_warnings").alias("warnings"))


def planned_pairs(spark, d):
    n = F.col("take_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    return events(spark, d, "takes").select("take_id", "performance_type", "key_confidence", pick("locked", "free", "free").alias("relationship"), pick("raw", "tuned", "finished", "raw").alias("state"), pick("clean", "heavy", "light").alias("noise"), (n % 10 / F.lit(10.0)).alias("bpm_confidence"),
                                            (n % 3 - 1).alias("shift"), F.when(n % 11 == 0, 0.0).alias("intent_tuning"), F.lit(None).cast("double").alias("intent_timing"), (n % 8 / F.lit(10.0)).alias("rt60_s"), F.lit("trap").alias("genre"), F.lit(0.9).alias("grid_consistency"))


@query(as_cte("takes") + """, x AS (SELECT *, take_id AS n, take_id % 3 = 0 AS locked, list_extract(['raw','tuned','finished','raw'], CAST(take_id % 4 + 1 AS INT)) AS state FROM takes)
SELECT take_id, CASE WHEN n % 3 = 1 THEN 'denoise' ELSE 'none' END AS denoise, CASE WHEN locked THEN 'measured_lag' ELSE 'downbeat' END AS placement, CASE WHEN locked OR (n % 10) / 10.0::DOUBLE < 0.4::DOUBLE THEN 'none' ELSE 'stretch' END AS stretch,
  CASE WHEN key_confidence < 0.5 OR n % 3 = 1 THEN 'none' ELSE 'shift' END AS shift, CASE WHEN n % 11 = 0 THEN 'off' WHEN state <> 'raw' OR key_confidence < 0.5 OR performance_type = 'rap' THEN 'off' ELSE 'tune' END AS tuning, CASE WHEN locked THEN 'single_offset' ELSE 'grid_align' END AS timing,
  round(CASE WHEN locked THEN 0 ELSE 0.45 * CASE performance_type WHEN 'rap' THEN 1.25 WHEN 'melodic_rap' THEN 1.1 WHEN 'spoken' THEN 0 ELSE 0.75 END * 0.9 END::DOUBLE + 1e-9, 6) AS timing_strength FROM x""")
def p44_render_policy(spark, d):
    got = planning.render_policy(planned_pairs(spark, d))
    return got.select("take_id", *(F.col(f"{k}.method").alias(k) for k in ("denoise", "placement", "stretch", "shift", "tuning", "timing")), rounded("timing_strength", 6).alias("timing_strength"))


@query(as_cte("takes") + """, x AS (SELECT take_id, take_id % 40 / 10.0::DOUBLE AS dd, (take_id % 7) / 4.0::DOUBLE AS db, 1 + (take_id % 11) / 10.0::DOUBLE AS r, take_id % 13 - 6.0::DOUBLE AS lag FROM takes), y AS (SELECT *, dd <= 0.25 AND db <= 0.5 AS same FROM x), z AS (SELECT *, same OR (r >= 1.6 AND dd <= 4) AS locked FROM y)
SELECT take_id, CASE WHEN locked THEN 'locked' ELSE 'free' END AS relationship, CASE WHEN locked THEN CASE WHEN same AND r < 1.35 THEN 0 ELSE lag END END AS offset_s FROM z""")
def j18_relationship(spark, d):
    n = F.col("take_id")
    rows = events(spark, d, "takes").select("take_id", F.lit(100.0).alias("t_duration"), (100.0 + n % 40 / F.lit(10.0)).alias("b_duration"), F.lit(90.0).alias("t_bpm"), (90.0 + n % 7 / F.lit(4.0)).alias("b_bpm"), (n % 13 - 6).cast("double").alias("lag_s"), (1 + n % 11 / F.lit(10.0)).alias("lag_ratio"))
    rows = rows.withColumns({"t_duration": F.lit(0.0), "b_duration": n % 40 / F.lit(10.0), "t_bpm": F.lit(0.0), "b_bpm": n % 7 / F.lit(4.0)})
    return planning.relationships(rows).select("take_id", "relationship", "offset_s")


@query(as_cte("notes", "catalog") + f"""{_RANKED}, g AS (SELECT a.take_id, least(greatest((a.r - b.r) * 4 + a.r * 0.4, 0), 1) AS t_conf FROM o a JOIN o b ON a.take_id = b.take_id AND a.n = 1 AND b.n = 2),
x AS (SELECT o.take_id, round(o.r * b.key_confidence, 9) AS p, o.key_pc AS pc, o.key_mode AS mode, b.key_pc AS b_pc, b.key_confidence AS b_conf, abs(7 * (o.key_pc + CASE o.key_mode WHEN 'minor' THEN 3 ELSE 0 END) % 12 - 7 * (b.key_pc + CASE b.key_mode WHEN 'minor' THEN 3 ELSE 0 END) % 12) AS d FROM o JOIN catalog b ON o.take_id = b.beat_id WHERE o.n <= 2),
y AS (SELECT *, pc = b_pc OR least(d, 12 - d) <= 1 AS related FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY related DESC, p DESC, pc, b_pc, mode DESC) AS k FROM y)
SELECT take_id, CASE WHEN take_id % 10 = 0 THEN 5 WHEN related THEN pc END AS key_pc, CASE WHEN take_id % 10 = 0 THEN 'minor' WHEN related THEN mode END AS key_mode, CASE WHEN take_id % 10 = 0 THEN 'stated' WHEN related THEN 'related' WHEN t_conf >= 0.55 AND b_conf >= 0.55 THEN 'shift' ELSE 'shared_scale' END AS action FROM z JOIN g USING (take_id) WHERE k = 1""")
def j17_decide_key(spark, d):
    """Takes' two best keys against the catalog's key of the same number."""
    from beatlake.operators.profiles import key_profile

    cand = key_profile(events(spark, d, "notes")).select("take_id", "candidates", "confidence")
    beats = events(spark, d, "catalog").select(F.col("beat_id").alias("take_id"), F.array(F.struct(F.col("key_pc").alias("pc"), F.col("key_mode").alias("mode"), F.col("key_confidence").alias("score"))).alias("b_candidates"), F.col("key_confidence").alias("b_conf"))
    pairs = cand.join(beats, "take_id").select("take_id", F.slice("candidates", 1, 2).alias("t_candidates"), "b_candidates", F.col("confidence").alias("t_conf"), "b_conf", F.when(F.col("take_id") % 10 == 0, 5).alias("stated_pc"), F.when(F.col("take_id") % 10 == 0, "minor").alias("stated_mode"))
    return planning.decide_keys(pairs).select("take_id", "key_pc", "key_mode", "action")


@query(as_cte("onsets") + """, v AS (SELECT a.take_id, CAST(round((b.time_s + 0.7::DOUBLE - a.time_s) / 0.01::DOUBLE) AS INT) AS bin, count(*) AS n FROM onsets a JOIN onsets b ON a.take_id = b.take_id AND abs(b.time_s + 0.7::DOUBLE - a.time_s) <= 20 GROUP BY 1, 2), s AS (SELECT take_id, bin + j AS bin, CAST(sum(n) AS BIGINT) AS n FROM v, (VALUES (-1), (0), (1)) t(j) GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY n DESC, abs(bin), bin) AS k FROM s), b AS (SELECT take_id, bin AS best, n AS top FROM p WHERE k = 1), r AS (SELECT take_id, max(n) AS next FROM s JOIN b USING (take_id) WHERE abs(bin - best) * 0.01::DOUBLE > 0.15 GROUP BY 1)
SELECT take_id, round(best * 0.01::DOUBLE + 1e-9, 6) AS lag_s, round(CASE WHEN next > 0 THEN top / next END + 1e-9, 6) AS lag_ratio FROM b LEFT JOIN r USING (take_id)""")
def j19_best_lag(spark, d):
    """Each take against itself 0.7 s later."""
    a = events(spark, d, "onsets").select("take_id", "time_s")
    return planning.best_lag(a, a.withColumn("time_s", F.col("time_s") + 0.7), "take_id").select("take_id", rounded("lag_s", 6).alias("lag_s"), rounded("lag_ratio", 6).alias("lag_ratio"))


@query(as_cte("onsets") + """, h AS (SELECT a.take_id, CAST(floor((b.time_s - a.time_s) / 0.01::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM onsets a JOIN onsets b ON a.take_id = b.take_id AND b.time_s > a.time_s AND b.time_s - a.time_s <= 2 GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY n DESC, bin) AS k FROM h), a1 AS (SELECT * FROM a WHERE k = 1), b AS (SELECT h.*, row_number() OVER (PARTITION BY h.take_id ORDER BY h.n DESC, h.bin) AS k FROM h JOIN a1 USING (take_id) WHERE abs(h.bin - a1.bin) >= 12), b1 AS (SELECT * FROM b WHERE k = 1),
c AS (SELECT b.take_id, b.bin, b.n, row_number() OVER (PARTITION BY b.take_id ORDER BY b.n DESC, b.bin) AS k FROM b JOIN b1 USING (take_id) WHERE abs(b.bin - b1.bin) >= 12)
SELECT take_id, 0 AS place, bin, n FROM a1 UNION ALL SELECT take_id, 1, bin, n FROM b1 UNION ALL SELECT take_id, 2, bin, n FROM c WHERE k = 1""")
def j20_offset_candidates(spark, d):
    from beatlake.operators.profiles import lag_histogram

    return planning.offset_candidates(lag_histogram(events(spark, d, "onsets"), "take_id", 2.0, 0.01), "take_id")


@query()
def j12_assign_onsets(spark, d):
    """Onsets to slots of a quarter second."""
    grid = bar_lines(spark, d).select("take_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.col("time_s") + k * 0.25)).alias("time_s"))
    return planning.assign_onsets(events(spark, d, "onsets").select("take_id", "event_id", "time_s", "strength"), grid, "take_id", 0.25)


@query(as_cte("sections") + f""", {_TSEC}, m AS (SELECT entity_id, seq, start_s + ((entity_id + seq) % 5) * 0.7 AS s FROM tsec), e AS (SELECT entity_id, start_s AS t FROM tsec UNION SELECT entity_id, end_s FROM tsec),
b AS (SELECT m.*, e.t AS t0 FROM m ASOF LEFT JOIN e ON m.entity_id = e.entity_id AND m.s >= e.t), c AS (SELECT b.*, e.t AS t1 FROM b ASOF LEFT JOIN e ON b.entity_id = e.entity_id AND b.s <= e.t),
n AS (SELECT *, CASE WHEN t0 IS NULL OR t1 - s < s - t0 THEN coalesce(t1, t0) ELSE t0 END AS near FROM c), o AS (SELECT *, CASE WHEN abs(s - near) <= 1.6 THEN near ELSE s END AS too FROM n)
SELECT entity_id, seq, round(max(too) OVER (PARTITION BY entity_id ORDER BY s ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS snapped_s FROM o""")
def j23_snap_sections(spark, d):
    """Sections moved by up to 2.8 s, against those in place."""
    base = timed_sections(spark, d)
    moved = base.select("entity_id", "seq", (F.col("start_s") + (F.col("entity_id") + F.col("seq")) % 5 * 0.7).alias("start_s"))
    return planning.snap_sections(moved, base, "entity_id").select("entity_id", "seq", rounded("snapped_s", 6).alias("snapped_s"))


@query(as_cte("sections") + """, b AS (SELECT entity_id, seq * 4.0::DOUBLE AS t FROM sections), e AS (SELECT s.entity_id, s.t, turn, min(abs(s.t + s.entity_id % 4 - b.t - turn)) AS e FROM b s CROSS JOIN range(4) r(turn) JOIN b ON s.entity_id = b.entity_id GROUP BY 1, 2, 3),
c AS (SELECT entity_id, turn, round(avg(least(e, 2.0) / 4.0), 9) AS cost FROM e GROUP BY 1, 2), m AS (SELECT entity_id, min(struct_pack(cost := cost, turn := turn)) AS m, max(cost) FILTER (turn = 0) AS plain FROM c GROUP BY 1), g AS (SELECT *, m.cost <= 0.12 AND m.cost <= 0.5 * plain AS good FROM m)
SELECT entity_id AS take_id, CAST(CASE WHEN good THEN m.turn ELSE 0 END AS INT) AS turn, round(CASE WHEN good THEN m.cost ELSE plain END + 1e-9, 6) AS cost FROM g""")
def j24_bar_phase(spark, d):
    starts = bar_lines(spark, d).withColumn("time_s", F.col("time_s") + F.col("take_id") % 4)
    return planning.bar_phase(starts, bar_lines(spark, d), "take_id", 4.0).withColumn("cost", rounded("cost", 6))


@query(as_cte("takes") + """, x AS (SELECT take_id, CAST(20 + take_id % 60 AS DOUBLE) AS v, CAST(30 + take_id % 37 AS DOUBLE) AS b, 2.0::DOUBLE AS bar, CASE WHEN take_id % 2 = 0 THEN 8.0 END AS ch, CAST(take_id % 9 AS DOUBLE) AS ve FROM takes)
SELECT take_id, CASE WHEN abs(v - b) <= bar THEN 'none' WHEN v < b THEN 'trim' WHEN v - b <= 2 * bar THEN 'pad' WHEN ch IS NOT NULL THEN 'loop_chorus' WHEN ve > 4 THEN 'loop_verse' ELSE 'loop_last_8_bars' END AS fit, CASE WHEN v < b THEN ceil(v / bar) * bar ELSE greatest(v, b) END AS target_s FROM x""")
def j27_beat_fit(spark, d):
    n = F.col("take_id")
    rows = events(spark, d, "takes").select("take_id", (20 + n % 60).cast("double").alias("vocal_end_s"), (30 + n % 37).cast("double").alias("beat_s"), F.lit(2.0).alias("bar_s"), F.when(n % 2 == 0, 8.0).alias("chorus_s"), (n % 9).cast("double").alias("verse_s"))
    return planning.beat_fit(rows).select("take_id", "fit", "target_s")


@query(_SETS + f""", g AS (SELECT *, coalesce({_GENRE}, '') = 'Hip Hop' AS blues, bar % 2 = 0 AS exposed, CAST(48 + (bar * 7 + root) % 24 AS DOUBLE) + ((entity_id + bar) % 21 - 10) / 10.0::DOUBLE AS midi, 0.5::DOUBLE + (bar % 4) / 2.0::DOUBLE AS sal FROM y),
h AS (SELECT *, list_concat(list_concat(tones, CASE WHEN exposed THEN tens ELSE pcs END), CASE WHEN blues THEN blue ELSE [] END) AS every FROM g), k AS (SELECT *, list_distinct([x for x in every if NOT list_contains(avoid, x) OR (blues AND list_contains(blue, x))]) AS cand, CAST(round_even(midi, 0) AS INT) AS base FROM h),
t AS (SELECT *, list_sort([struct_pack(a := abs(midi - x), x := x) for x in range(base - 3, base + 4) if list_contains(cand, x % 12)])[1] AS b FROM k),
fin AS (SELECT *, CASE WHEN bar % 10 = 0 THEN 'keep' WHEN b IS NULL OR b.a > 1.2 THEN 'too_far' WHEN b.a * 100 < 4 THEN 'in_tune' ELSE 'move' END AS decision FROM t)
SELECT entity_id, bar, decision, round(CASE WHEN decision = 'move' THEN midi + (b.x - midi) * least(greatest(0.6::DOUBLE * sal, 0), 0.95::DOUBLE) ELSE midi END + 1e-9, 6) AS target FROM fin""")
def w30_pitch_targets(spark, d):
    """One note over each chord."""
    notes = _chords_in_key(spark, d).withColumns({
        "genre": _genre(), "exposed": F.col("bar") % 2 == 0, "midi": (48 + (F.col("bar") * 7 + F.col("root")) % 24).cast("double") + ((F.col("entity_id") + F.col("bar")) % 21 - 10) / F.lit(10.0), "salience": 0.5 + F.col("bar") % 4 / F.lit(2.0),
        "gesture": F.when(F.col("bar") % 10 == 0, "slide"), "is_melisma": F.lit(False),
    })
    return planning.pitch_targets(notes).select("entity_id", "bar", "decision", rounded("target", 6).alias("target"))


@query(as_cte("notes", "sections") + f""", {_SPANS}, g AS (SELECT entity_id, seq * 4.0::DOUBLE + k * 0.25 + 0.03::DOUBLE * (k % 3) AS t FROM sections, range(16) r(k)), b AS (SELECT sn.*, g.t AS t0 FROM sn ASOF LEFT JOIN g ON sn.take_id = g.entity_id AND sn.start_s >= g.t),
c AS (SELECT b.*, g.t AS t1 FROM b ASOF LEFT JOIN g ON b.take_id = g.entity_id AND b.start_s <= g.t), e AS (SELECT *, start_s - CASE WHEN t0 IS NULL OR t1 - start_s < start_s - t0 THEN coalesce(t1, t0) ELSE t0 END AS e FROM c)
SELECT take_id, order_key, idx, round(start_s + CASE WHEN abs(e) <= 0.12 THEN -e * 0.6 ELSE 0 END + 1e-9, 6) AS new_start_s FROM e""")
def w31_time_targets(spark, d):
    """Slots of a quarter second, of which two in three are late by 30 and 60 ms."""
    grid = bar_lines(spark, d).select("take_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.col("time_s") + k * 0.25 + 0.03 * (k % 3))).alias("time_s"))
    notes = note_spans(spark, d).select("take_id", "order_key", "idx", "start_s", "end_s", F.lit(1.0).alias("salience"))  # whole rows go with the slots
    return planning.time_targets(notes, grid, "take_id").select("take_id", "order_key", "idx", rounded("new_start_s", 6).alias("new_start_s"))


@query(as_cte("onsets", "notes") + f""", {_SPANS}, nn AS (SELECT take_id, row_number() OVER (PARTITION BY take_id ORDER BY start_s) AS note_id, start_s AS b, end_s AS e FROM sn), w AS (SELECT take_id, event_id, element, time_s - 0.06::DOUBLE AS a, greatest(time_s + 0.2::DOUBLE, time_s + 0.05::DOUBLE) + 0.06::DOUBLE AS z FROM onsets),
o AS (SELECT w.take_id, event_id, element, a, note_id, b, round(least(z, e) - greatest(a, b), 9) AS o FROM w JOIN nn ON w.take_id = nn.take_id AND z > b AND a < e), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o DESC, b, note_id DESC) AS n FROM o)
SELECT take_id, note_id, string_agg(element, ' ' ORDER BY a, element) AS lyric FROM r WHERE n = 1 GROUP BY 1, 2""")
def j11_assign_words(spark, d):
    """Onsets as words of 0.2 s, named by their kind; notes that got a word."""
    words = events(spark, d, "onsets").select("take_id", F.col("event_id").alias("word_id"), F.col("element").alias("text"), F.col("time_s").alias("a_start"), (F.col("time_s") + 0.2).alias("a_end"))
    notes = note_spans(spark, d).select("take_id", F.row_number().over(Window.partitionBy("take_id").orderBy("start_s")).cast("long").alias("note_id"), F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"))
    return planning.assign_words(words, notes, "take_id").filter("lyric is not null and lyric <> '-'").select("take_id", "note_id", "lyric")


@query(as_cte("sections") + """ SELECT entity_id, label AS layer, count(*) FILTER (seq % 3 = 0) AS yes, count(*) AS n, count(*) FILTER (seq % 3 = 0) >= 2 OR 2 * count(*) FILTER (seq % 3 = 0) >= count(*) AS keep FROM sections GROUP BY 1, 2""")
def a41_layer_votes(spark, d):
    return arrangement.layer_votes(events(spark, d, "sections").select("entity_id", F.col("label").alias("layer"), (F.col("seq") % 3 == 0).alias("wanted")), "entity_id")


@query()
def j14_phrase_similarity(spark, d):
    """By text and length."""
    p = events(spark, d, "phrases").withColumn("duration_s", F.length("text").cast("double"))
    return arrangement.phrase_similarity(p, "take_id", 0.1)


@query()
def j15_w20_structure(spark, d):
    """Q6: J14, J15, A42, W20, W21: repeats, the hook, labels and sections of conversations read as songs."""
    p = events(spark, d, "phrases").withColumns({"duration_s": (1 + F.length("text") % 7).cast("double"), "rate": (2 + F.col("idx") % 2).cast("double")}).drop("text", "role")
    w = Window.partitionBy("take_id").orderBy("idx")
    p = p.withColumn("end_s", F.sum("duration_s").over(w) + F.col("idx") * 0.5).withColumn("start_s", F.col("end_s") - F.col("duration_s"))
    groups = arrangement.repeat_groups(p, arrangement.phrase_similarity(p, "take_id", 0.9), "take_id", 0.95)
    rows = p.join(groups, ["take_id", "idx"]).withColumns({"midi": (60 + F.col("idx") % 5).cast("double"), "level": F.lit(-20.0)})
    hook = arrangement.pick_hook(rows, "take_id")
    rows = rows.join(hook, "take_id", "left").withColumns({"is_hook": F.coalesce(F.col("group_id") == F.col("hook_group"), F.lit(False)), "group_size": F.count(F.lit(1)).over(Window.partitionBy("take_id", "group_id"))})
    return arrangement.sections_from_labels(arrangement.label_phrases(rows, "take_id"), "take_id")


@query(as_cte("notes") + f", {_SPANS} SELECT take_id, CAST(round_even(start_s * 90 / 60 * 480, 0) AS BIGINT) AS tick, CAST(greatest(1, round_even(end_s * 90 / 60 * 480, 0) - round_even(start_s * 90 / 60 * 480, 0)) AS BIGINT) AS length, CAST(round_even(midi, 0) AS INT) AS pitch FROM sn")
def s11_score_rows(spark, d):
    return score_rows(note_spans(spark, d).withColumn("bpm", F.lit(90)))


@query("""SELECT substr(sha256('2.2.0' || text), 1, 24) AS content_key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1""")
def s04_content_key(spark, d):
    """Documents as contents: equal ones are one row."""
    from beatlake.sources.catalog_io import content_key

    return table(spark, d, "documents").groupBy(content_key(F.encode("text", "utf-8")).alias("content_key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT p_partkey AS id, 1 AS v FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS id, 2 AS v FROM part WHERE p_partkey % 2 = 0)
SELECT id, v FROM n UNION ALL SELECT id, v FROM c WHERE id NOT IN (SELECT id FROM n)""")
def u06_catalog_update(spark, d):
    from beatlake.sources.catalog_io import catalog_update

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return catalog_update(parts.filter("id % 3 <> 0").withColumn("v", F.lit(1)), parts.filter("id % 2 = 0").withColumn("v", F.lit(2)), "id")


def live_frames(spark, d):
    f = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    base = events(spark, d, "level_frames").join(f.select("event_id", ts.alias("ts")), "event_id")
    return base.select("take_id", "event_id", "ts", "time_s", "rms_db", (F.col("rms_db") * 0.5).alias("peak_db"), "clipped", "is_voice", (0.5 + F.col("event_id") % 7 / F.lit(4.0)).alias("low_mid_ratio"), (F.col("event_id") % 40 == 0).alias("is_plosive"))


@query()
def t04_batch_cues(spark, d):
    """T4-T10 over a table, as a replay gives them."""
    return live.batch_cues(live_frames(spark, d))


@query(as_cte("level_frames") + """, w AS (SELECT event_id, rms_db, count(*) OVER o AS n, quantile_cont(rms_db, 0.1) OVER o AS q FROM level_frames WINDOW o AS (PARTITION BY take_id ORDER BY time_s, event_id ROWS BETWEEN 399 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n >= 20 THEN q ELSE -70 END + 1e-9, 5) AS floor_db, rms_db > greatest(-55, CASE WHEN n >= 20 THEN q ELSE -70 END + 10) AS is_voice FROM w""")
def t02_voice_gate(spark, d):
    """T2, T3."""
    return live.voice_gate(events(spark, d, "level_frames")).select("event_id", rounded("floor_db", 5).alias("floor_db"), "is_voice")


@query("""
WITH f AS (SELECT user_id AS take_id, date_trunc('day', ts) AS start, -60.0 + value / 3.0 AS r, event_type FROM events)
SELECT take_id, epoch_us(start) AS start_us, count(*) AS n, round(avg(r) + 1e-9, 5) AS rms_db, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS clipped FROM f GROUP BY 1, 2""")
def t11_live_metrics(spark, d):
    """One day of the table is one second of music, so windows of a day."""
    got = live.live_metrics(live_frames(spark, d), "1 day")
    return got.select("take_id", F.unix_micros("start").alias("start_us"), "n", rounded("rms_db", 5).alias("rms_db"), "clipped")


@query("""
WITH f AS (SELECT user_id AS take_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY take_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT take_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 172800000000 AS end_us, count(*) AS n FROM r GROUP BY take_id, run""")
def t12_take_sessions(spark, d):
    return live.take_sessions(live_frames(spark, d), "2 days").select("take_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
