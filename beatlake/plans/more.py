"""Queries of columns and reports: tempo and key decisions, loudness, lyrics, documents, listings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from beatlake.functions import music, scalars
from beatlake.functions.scalars import joined, rounded
from beatlake.operators import acoustics, grading, matching, profiles, sequences
from beatlake.plans.profile import chroma
from beatlake.plans.registry import ORACLE_SQL, query
from beatlake.sources import catalog_io
from beatlake.sources.fixtures import as_cte, events, table


def _lines(spark, d):
    """Documents as lyrics, a row for each: each line's words with times and chances by rule."""
    words = lambda line: F.filter(F.split(line, " "), lambda w: w != "")
    made = lambda line, at: F.transform(words(line), lambda w, k: F.struct(w.alias("text"), (at * 4 + k * 0.25).cast("double").alias("start"), (at * 4 + k * 0.25 + 0.2).cast("double").alias("end"), ((F.length(w) % 10) / F.lit(10.0)).alias("probability")))
    return events(spark, d, "lines").filter("lines IS NOT NULL").select("entity_id", F.transform("lines", lambda line, at: F.struct(made(line, at).alias("words"))).alias("lines"))


_WORDS = """
WITH l AS (SELECT doc_id AS entity_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), r AS (SELECT entity_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ln FROM l),
s AS (SELECT entity_id, ln, [x for x in string_split(line, ' ') if x <> ''] AS ws FROM r), w AS (SELECT entity_id, ln, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS k FROM s),
v AS (SELECT entity_id, ln, k, text, ln * 4 + k * 0.25::DOUBLE AS start, (length(text) % 10) / 10.0::DOUBLE AS p FROM w)"""


@query(_WORDS + ", e AS (SELECT DISTINCT entity_id FROM r), n AS (SELECT entity_id, count(*) AS n, sum(start) AS s, min(start) AS f, max(start) AS l FROM v WHERE p >= 0.4 GROUP BY 1) SELECT entity_id, coalesce(n, 0) AS n_words, round(coalesce(s, 0) + 1e-9, 4) AS starts, f AS first_s, l AS last_s FROM e LEFT JOIN n USING (entity_id)")
def f11_words_of(spark, d):
    """words and their onsets."""
    t = music.word_onsets(F.col("lines"))
    x = _lines(spark, d).select("entity_id", t.alias("t")).select("entity_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0.0), lambda s, v: s + v).alias("s"), F.array_min("t").alias("f"), F.array_max("t").alias("l"))
    # Sums are exact, as all times are quarters; rows of one id are one entity.
    return x.groupBy("entity_id").agg(F.sum("n").alias("n_words"), rounded(F.sum("s"), 4).alias("starts"), F.min("f").alias("first_s"), F.max("l").alias("last_s"))


@query(_WORDS + ", e AS (SELECT DISTINCT entity_id FROM r), n AS (SELECT entity_id, ln, min(start) AS t FROM v WHERE p >= 0.4 AND trim(text) <> '' GROUP BY 1, 2), m AS (SELECT entity_id, count(*) AS n, sum(t) AS s FROM n GROUP BY 1) SELECT entity_id, coalesce(n, 0) AS n_lines, round(coalesce(s, 0) + 1e-9, 4) AS starts FROM e LEFT JOIN m USING (entity_id)")
def f11_line_starts(spark, d):
    x = _lines(spark, d).select("entity_id", music.line_starts(F.col("lines")).alias("t"))
    x = x.select("entity_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0.0), lambda s, v: s + v).alias("s"))
    return x.groupBy("entity_id").agg(F.sum("n").alias("n_lines"), rounded(F.sum("s"), 4).alias("starts"))


@query(as_cte("sections") + """, b AS (SELECT entity_id, seq, CASE label WHEN 'hook' THEN 'chorus' ELSE label END AS label, seq * 4 AS a, seq * 4 + CASE WHEN seq % 5 = 0 THEN 0 ELSE 4 END AS z FROM sections)
SELECT entity_id, count(*) AS n, sum(a) AS starts, sum(z) AS ends FROM b WHERE label IN ('verse', 'chorus') AND z > a GROUP BY 1""")
def p49_loop_points(spark, d):
    s = events(spark, d, "sections").select("entity_id", F.struct("seq", F.when(F.col("label") == "hook", "chorus").otherwise(F.col("label")).alias("label"), (F.col("seq") * 4).alias("start_bar"), (F.col("seq") * 4 + F.when(F.col("seq") % 5 == 0, 0).otherwise(4)).alias("end_bar")).alias("s"))
    x = s.groupBy("entity_id").agg(music.loop_points(F.sort_array(F.collect_list("s"))).alias("p")).filter(F.size("p") > 0).select("entity_id", F.explode("p").alias("p"))
    return x.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p")[0]).alias("starts"), F.sum(F.col("p")[1]).alias("ends"))


@query(as_cte("renders") + """, x AS (SELECT *, lufs + 3 AS l, gap_s * 2 AS r, mono_loss_db / 5 AS t FROM renders)
SELECT render_id, l > -11 AND r < 6 AS is_mastered, round(true_peak_db - lufs + 1e-9, 5) AS crest_db, t < 0.25 AS is_dry, t < 0.6 AS is_usable FROM x""")
def p52_loudness_and_space(spark, d):
    x = events(spark, d, "renders").withColumns({"l": F.col("lufs").cast("double") + 3, "r": F.col("gap_s") * 2, "t": F.col("mono_loss_db").cast("double") / 5})
    return x.select("render_id", music.is_mastered(F.col("l"), F.col("r")).alias("is_mastered"), rounded(music.crest_db(F.col("true_peak_db").cast("double"), F.col("lufs").cast("double")), 5).alias("crest_db"), music.is_dry(F.col("t")).alias("is_dry"), music.is_usable_space(F.col("t")).alias("is_usable"))


@query(as_cte("takes") + """, x AS (SELECT take_id, CASE WHEN take_id % 3 = 0 THEN CAST(take_id % 12 AS INT) END AS u, key_pc, key_mode, key_confidence FROM takes)
SELECT take_id, coalesce(u, key_pc) AS pc, CASE WHEN u IS NULL THEN key_mode ELSE 'minor' END AS mode, CASE WHEN u IS NULL THEN key_confidence ELSE 0.95::DOUBLE END AS confidence, CASE WHEN u IS NULL THEN 'detected' ELSE 'user' END AS source FROM x""")
def p59_resolve_key(spark, d):
    t = events(spark, d, "takes").withColumn("stated", F.when(F.col("take_id") % 3 == 0, F.struct((F.col("take_id") % 12).cast("int").alias("pc"), F.lit("minor").alias("mode"))))
    return t.select("take_id", music.resolved_key(F.col("stated"), F.struct(F.col("key_pc").alias("pc"), F.col("key_mode").alias("mode")), F.col("key_confidence")).alias("k")).select("take_id", "k.*")


@query(as_cte("takes") + """, x AS (SELECT take_id, take_id % 9 AS n, CASE WHEN take_id % 5 = 0 THEN 0 ELSE bpm END AS h, (take_id % 10) / 12.0::DOUBLE AS hc, CASE WHEN take_id % 7 = 0 THEN 0 WHEN take_id % 2 = 0 THEN bpm * 2 ELSE bpm * 1.3::DOUBLE END AS a, (take_id % 4) / 4.0::DOUBLE AS s FROM takes),
y AS (SELECT *, abs(log2(h / nullif(a, 0)) - round_even(log2(nullif(h, 0) / nullif(a, 0)), 0)) <= 0.05 AND abs(round_even(log2(nullif(h, 0) / nullif(a, 0)), 0)) <= 2 AS oct FROM (SELECT x.* REPLACE (CASE WHEN h = 0 THEN NULL ELSE h END AS h) FROM x)),
z AS (SELECT *, CASE WHEN n < 6 OR (h IS NULL AND a = 0) THEN 'none' WHEN h IS NULL OR a = 0 THEN 'single' WHEN oct THEN CASE WHEN abs(h - a) / h < 0.05 THEN 'exact' ELSE 'octave' END ELSE 'disagree' END AS agreement FROM y)
SELECT take_id, agreement, round(CASE WHEN agreement = 'none' THEN 0 ELSE coalesce(h, a) END, 2) AS bpm, round(CASE WHEN agreement = 'none' THEN 0 WHEN agreement = 'single' THEN CASE WHEN h IS NOT NULL THEN least(hc, 0.45) ELSE least(s * 0.6, 0.45) END WHEN agreement = 'disagree' THEN least(greatest(hc * 0.5, 0), 0.35) ELSE least(greatest(greatest(hc, 0.3) + 0.25 * s + 0.15, 0), 0.9) END + 1e-9, 2) AS confidence FROM z""")
def a08_tempo_rule(spark, d):
    """A8's rule on given readings."""
    n = F.col("take_id")
    x = events(spark, d, "takes").select("take_id", (n % 9).alias("n"), F.when(n % 5 == 0, 0.0).otherwise(F.col("bpm")).alias("h"), (n % 10 / F.lit(12.0)).alias("hc"), F.when(n % 7 == 0, 0.0).when(n % 2 == 0, F.col("bpm") * 2).otherwise(F.col("bpm") * 1.3).alias("a"), (n % 4 / F.lit(4.0)).alias("s"))
    got = x.select("take_id", music.reconciled_tempo(*map(F.col, ("h", "hc", "a", "s", "n"))).alias("t"))
    return got.select("take_id", "t.agreement", F.col("t.bpm").alias("bpm"), rounded("t.confidence", 2).alias("confidence"))


def _unrounded(name: str) -> str:
    """Another query's SQL with its results as they are."""
    return re.sub(r"\+ 1e-9, \d\)", "+ 0, 13)", ORACLE_SQL[name])


@query(f"""WITH h AS ({_unrounded('a06_tempo_histogram')}), a AS ({_unrounded('a07_tempo_autocorr')}), n AS (SELECT user_id AS take_id, count(*) AS n FROM events GROUP BY 1),
x AS (SELECT n.take_id, n.n, h.bpm AS h, coalesce(h.confidence, 0) AS hc, coalesce(a.bpm, 0) AS a, coalesce(a.strength, 0) AS s FROM n LEFT JOIN h USING (take_id) LEFT JOIN a USING (take_id)),
y AS (SELECT *, abs(log2(h / nullif(a, 0)) - round_even(log2(h / nullif(a, 0)), 0)) <= 0.05 AND abs(round_even(log2(h / nullif(a, 0)), 0)) <= 2 AS oct FROM x),
z AS (SELECT *, CASE WHEN n < 6 OR (h IS NULL AND a = 0) THEN 'none' WHEN h IS NULL OR a = 0 THEN 'single' WHEN oct THEN CASE WHEN abs(h - a) / h < 0.05 THEN 'exact' ELSE 'octave' END ELSE 'disagree' END AS agreement FROM y)
SELECT take_id, agreement, round(CASE WHEN agreement = 'none' THEN 0 ELSE coalesce(h, a) END + 1e-9, 2) AS bpm, round(CASE WHEN agreement = 'none' THEN 0 WHEN agreement = 'single' THEN CASE WHEN h IS NOT NULL THEN least(hc, 0.45) ELSE least(s * 0.6, 0.45) END WHEN agreement = 'disagree' THEN least(greatest(hc * 0.5, 0), 0.35) ELSE least(greatest(greatest(hc, 0.3) + 0.25 * s + 0.15, 0), 0.9) END + 1e-9, 3) AS confidence FROM z""")
def a08_tempo(spark, d):
    """A6 and A7 of all takes, reconciled."""
    return profiles.tempo(events(spark, d, "onsets"), "take_id", "event_id").select("take_id", "tempo.bpm", "tempo.confidence", "tempo.agreement")


@query("""
WITH f AS (SELECT label, vec_id, [abs(x)::DOUBLE for x in embedding[1:12]] AS c, vec_id % 16 AS beat FROM embeddings), b AS (SELECT label AS entity_id, beat, k, avg(c[k + 1]) AS v FROM f, range(12) r(k) GROUP BY 1, 2, 3)
SELECT entity_id, CAST(beat AS BIGINT) AS beat, CAST(k AS INT) AS pc, round(v + 1e-9, 6) AS value FROM b""")
def a03_beat_sync_chroma(spark, d):
    """A3: frames of a label averaged over beats (16 of them, by number)."""
    f = chroma(spark, d).select("entity_id", (F.col("vec_id") % 16).alias("beat"), F.posexplode("chroma").alias("pc", "x"))
    return f.groupBy("entity_id", "beat", "pc").agg(rounded(F.avg("x"), 6).alias("value"))


@query(as_cte("phrases") + ", w AS (SELECT take_id, (length(text) % 10) / 10.0::DOUBLE AS p FROM phrases), x AS (SELECT take_id, avg(CASE WHEN p >= 0.4 THEN 1.0 ELSE 0.0 END) AS c, count(*) AS n FROM w GROUP BY 1) SELECT take_id, round(c + 1e-9, 6) AS confident, n AS n_words, CASE WHEN c >= 0.8 THEN 'clear' WHEN c >= 0.5 THEN 'muddy' ELSE 'unclear' END AS verdict FROM x")
def a23_intelligibility(spark, d):
    w = events(spark, d, "phrases").select("take_id", (F.length("text") % 10 / F.lit(10.0)).alias("probability"))
    return profiles.intelligibility(w.withColumn("probability", F.coalesce("probability", F.lit(0.0))), "take_id").select("take_id", rounded("confident", 6).alias("confident"), "n_words", "verdict")


@query(as_cte("renders") + ", x AS (SELECT render_id, lufs AS v, lufs - 2 AS m, CASE WHEN render_id % 4 <> 0 THEN gap_s END AS g FROM renders) SELECT render_id, round(v + g - m + 1e-9, 5) AS presence_db, g IS NOT NULL AS gain_known FROM x")
def a48_vocal_presence(spark, d):
    x = events(spark, d, "renders").select("render_id", F.col("lufs").cast("double").alias("vocal_db"), (F.col("lufs").cast("double") - 2).alias("mix_db"), F.when(F.col("render_id") % 4 != 0, F.col("gap_s")).alias("master_gain_db"))
    return grading.vocal_presence(x).select("render_id", rounded("presence_db", 5).alias("presence_db"), "gain_known")


@query(as_cte("takes") + ", x AS (SELECT take_id, -40.0::DOUBLE - take_id % 20 AS b, -40.0::DOUBLE - take_id % 20 - take_id % 7 AS a FROM takes) SELECT take_id, CASE WHEN b > -50 THEN 'heavy' ELSE 'light' END AS before_verdict, CASE WHEN a > -50 THEN 'heavy' ELSE 'light' END AS after_verdict, b - a AS removed_db FROM x")
def a50_noise_change(spark, d):
    t = events(spark, d, "takes").select("take_id", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("stage"))
    floor = (F.lit(-40.0) - F.col("take_id") % 20 - F.when(F.col("stage") == "after", F.col("take_id") % 7).otherwise(0)).cast("double")
    v = t.withColumn("floor_db", floor).withColumn("verdict", F.when(F.col("floor_db") > -50, "heavy").otherwise("light"))
    return acoustics.noise_change(v, "take_id").select("take_id", "before_verdict", "after_verdict", "removed_db")


@query(as_cte("takes", "notes") + """, r AS (SELECT take_id, take_id % 4 <> 0 AS usable, CASE take_id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'ok' ELSE 'rough' END AS grade, CASE WHEN take_id % 5 <> 0 THEN CAST(take_id % 17 AS DOUBLE) END AS snr_db, (take_id % 11) / 10.0::DOUBLE AS clipped_pct, performance_type AS g FROM takes)
SELECT take_id, CAST(row_number() OVER (PARTITION BY g ORDER BY usable DESC, CASE grade WHEN 'good' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END, snr_db DESC NULLS LAST, clipped_pct, take_id) AS INT) AS place FROM r""")
def k03_rank_takes(spark, d):
    """Takes of one kind of performance as attempts at it."""
    n = F.col("take_id")
    r = events(spark, d, "takes").select("take_id", (n % 4 != 0).alias("usable"), F.when(n % 3 == 0, "good").when(n % 3 == 1, "ok").otherwise("rough").alias("grade"), F.when(n % 5 != 0, (n % 17).cast("double")).alias("snr_db"), (n % 11 / F.lit(10.0)).alias("clipped_pct"), F.col("performance_type").alias("g"))
    return profiles.rank_takes(r, "g").select("take_id", "place")


@query(as_cte("onsets") + " SELECT event_id, round(avg(strength) OVER (PARTITION BY take_id ORDER BY CAST(round(time_s * 1e6) AS BIGINT) RANGE BETWEEN 500000 PRECEDING AND 500000 FOLLOWING) + 1e-9, 5) AS strength FROM onsets")
def w29_smooth(spark, d):
    return sequences.smooth(events(spark, d, "onsets"), "take_id", "strength", 0.5).select("event_id", rounded("strength", 5).alias("strength"))


@query(as_cte("catalog") + """, x AS (SELECT beat_id, CASE WHEN bpm BETWEEN 90 AND 110 THEN 1 ELSE greatest(0, 1 - (CASE WHEN bpm < 90 THEN 90 - bpm ELSE bpm - 110 END) / 20) END AS r FROM catalog)
SELECT x.beat_id, round(r + 1e-9, 6) AS range_score, round(bpm * 1.5::DOUBLE + 0.25::DOUBLE, 3) AS shifted, least(greatest(bpm, 80), 120) AS clipped, CASE WHEN play_count % 10 <> 0 THEN bpm END AS finite FROM x JOIN catalog USING (beat_id)""")
def f04_f07_f13_f14_scalars(spark, d):
    c = events(spark, d, "catalog")
    odd = F.when(F.col("play_count") % 10 != 0, F.col("bpm")).when(F.col("play_count") % 20 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return c.select("beat_id", rounded(scalars.range_score(F.col("bpm"), F.lit(90.0), F.lit(110.0), F.lit(20.0)), 6).alias("range_score"), scalars.shift_times(F.col("bpm"), 1.5, 0.25).alias("shifted"), scalars.clip(F.col("bpm"), 80.0, 120.0).alias("clipped"), scalars.finite_or_null(odd).alias("finite"))


@query(as_cte("onsets") + " SELECT take_id, count(*) FILTER (element = 'click') AS sibilants, coalesce(round(sum(time_s) FILTER (element = 'click') + 1e-9, 4), 0) AS starts FROM onsets GROUP BY 1")
def f16_spans(spark, d):
    """Onsets as phonemes of a kind."""
    x = events(spark, d, "onsets").groupBy("take_id").agg(F.sort_array(F.collect_list(F.struct("time_s", F.col("element").alias("kind")))).alias("p"))
    found = scalars.spans_of(F.col("p"), "click")
    return x.select("take_id", F.size(found).cast("long").alias("sibilants"), rounded(F.aggregate(found, F.lit(0.0), lambda s, v: s + v["time_s"]), 4).alias("starts"))


@query("""
WITH o AS (SELECT vec_id, [x::DOUBLE for x in embedding[1:16]] AS o FROM embeddings) SELECT vec_id, round((o[5] + o[13]) / 2 + 1e-9, 6) AS backbeat, round(list_sum(o) * 0.5::DOUBLE + 1e-9, 4) AS scaled FROM o""")
def p39_groove(spark, d):
    """Vectors as offsets of 16 slots."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")).alias("o"))
    return e.select("vec_id", rounded(music.backbeat_offset(F.col("o")), 6).alias("backbeat"), rounded(F.aggregate(music.groove_scaled(F.col("o"), 0.5), F.lit(0.0), lambda s, v: s + v), 4).alias("scaled"))


@query(as_cte("takes") + """, x AS (SELECT take_id, (take_id % 10) / 10.0::DOUBLE AS c, take_id % 30 AS s, 10000 + take_id % 7 * 1000 AS b, (take_id % 9) / 10.0::DOUBLE AS r, (take_id % 5 - 2) / 100.0::DOUBLE AS dc FROM takes)
SELECT take_id, array_to_string([v FOR v IN [CASE WHEN c > 0.5 THEN 'clipping' END, CASE WHEN s < 12 THEN 'noise' END, CASE WHEN b < 13000 THEN 'bandwidth' END, CASE WHEN r > 0.55 THEN 'reverb' END, CASE WHEN abs(dc) > 0.01 THEN 'dc_offset' END] IF v IS NOT NULL], ',') AS warnings FROM x""")
def p50_quality_warnings(spark, d):
    n = F.col("take_id")
    w = music.quality_warnings(n % 10 / F.lit(10.0), n % 30, 10_000 + n % 7 * 1000, n % 9 / F.lit(10.0), (n % 5 - 2) / F.lit(100.0))
    return events(spark, d, "takes").select("take_id", joined(w).alias("warnings"))


@query(as_cte("catalog") + ", x AS (SELECT beat_id, bpm, CAST(beat_id % 50 - 5 AS DOUBLE) AS s FROM catalog) SELECT beat_id, greatest(s, 0) AS end_s, bpm AS end_bpm FROM x")
def p56_constant_tempo(spark, d):
    curve = music.constant_tempo(F.col("bpm"), (F.col("beat_id") % 50 - 5).cast("double"))
    return events(spark, d, "catalog").select("beat_id", F.element_at(curve, 2)["time_s"].alias("end_s"), F.element_at(curve, 2)["bpm"].alias("end_bpm"))


@query(as_cte("takes") + """, x AS (SELECT take_id, CASE take_id % 4 WHEN 0 THEN 'severe' WHEN 1 THEN 'heavy' ELSE 'light' END AS noise, CASE WHEN take_id % 5 = 0 THEN 1.5 ELSE 0 END AS lead, CASE WHEN take_id % 6 = 0 THEN 'no_voice' ELSE 'voice' END AS voice, take_id % 7 = 0 AS conflict FROM takes)
SELECT take_id, array_to_string([v FOR v IN [CASE noise WHEN 'severe' THEN 'noise is too strong to remove' END, CASE noise WHEN 'heavy' THEN 'noise will be heard after cleaning' END, CASE WHEN lead > 0 THEN '1.5 s before the first phrase were cut' END, CASE voice WHEN 'no_voice' THEN 'no voice was found' END, CASE WHEN conflict THEN 'the stated tempo and the measured one differ' END] IF v IS NOT NULL], ',') AS warnings FROM x""")
def p62_take_warnings(spark, d):
    n = F.col("take_id")
    t = events(spark, d, "takes").select("take_id", F.when(n % 4 == 0, "severe").when(n % 4 == 1, "heavy").otherwise("light").alias("noise"), F.when(n % 5 == 0, 1.5).otherwise(0.0).alias("lead_in_s"), F.when(n % 6 == 0, "no_voice").otherwise("voice").alias("voice"), (n % 7 == 0).alias("tempo_conflict"))
    return t.select("take_id", joined(acoustics.take_warnings(t)).alias("warnings"))


@query(as_cte("catalog") + ", x AS (SELECT beat_id, CASE beat_id % 3 WHEN 0 THEN ['Dark', 'calm'] WHEN 1 THEN ['happy'] ELSE ['CALM', 'happy'] END AS a, CASE beat_id % 2 WHEN 0 THEN ['calm'] ELSE ['dark', 'loud'] END AS b FROM catalog) SELECT beat_id, list_has_any([lower(v) for v in a], b) AS shared FROM x")
def u05_mood_overlap(spark, d):
    n, a = F.col("beat_id"), lambda *xs: F.array(*map(F.lit, xs))
    left = F.when(n % 3 == 0, a("Dark", "calm")).when(n % 3 == 1, a("happy")).otherwise(a("CALM", "happy"))
    return events(spark, d, "catalog").select("beat_id", matching.mood_overlap(left, F.when(n % 2 == 0, a("calm")).otherwise(a("dark", "loud"))).alias("shared"))


def _documents(spark, d):
    """The catalog as track documents with arrays."""
    c = events(spark, d, "catalog")
    return c.select(
        F.col("beat_id").cast("string").alias("beat_id"), "title", "owner", "genre", "bpm", F.struct(F.col("key_pc").alias("pc"), F.col("key_mode").alias("mode")).alias("key"), (F.col("beat_id") % 200).cast("double").alias("duration_s"), "pocket_score",
        F.transform(F.sequence(F.lit(0), (F.col("beat_id") % 90).cast("int")), lambda k: (k * 0.5).cast("double")).alias("beats"), F.transform(F.sequence(F.lit(0), (F.col("beat_id") % 90).cast("int")), lambda k: (k * 2.0).cast("double")).alias("downbeats"),
        F.array(F.struct(F.lit(0.0).alias("time"), F.col("key_pc").alias("root"), F.lit("maj").alias("quality"))).alias("chords"), F.array().cast("array<struct<start:double,end:double,label:string,energy:double>>").alias("sections"),
    )


@query(as_cte("catalog") + " SELECT CAST(beat_id AS VARCHAR) AS beat_id, genre, CAST(beat_id % 90 + 1 AS INT) AS n_beats, 1 AS n_chords, 0 AS n_sections FROM catalog")
def s10_catalog_summary(spark, d):
    return catalog_io.catalog_summary(_documents(spark, d)).select("beat_id", "genre", "n_beats", "n_chords", "n_sections")


@query(as_cte("catalog") + " SELECT CAST(beat_id AS VARCHAR) AS beat_id, bpm, CAST(least(beat_id % 90 + 1, 64) AS INT) AS n_downbeats FROM catalog")
def s10_brief(spark, d):
    return catalog_io.brief(_documents(spark, d)).select("beat_id", "bpm", F.size("downbeats").alias("n_downbeats"))


@query(as_cte("catalog") + " SELECT CAST(beat_id AS VARCHAR) AS beat_id, CAST(unnest(range(beat_id % 90 + 1)) AS INT) AS idx, CAST(unnest(range(beat_id % 90 + 1)) * 0.5::DOUBLE AS DOUBLE) AS value FROM catalog")
def s03_explode_documents(spark, d):
    """S3: arrays of documents as a table; there and back."""
    rows = catalog_io.explode_documents(_documents(spark, d), "beat_id", "beats")
    return catalog_io.explode_documents(catalog_io.implode(rows, "beat_id", "beats"), "beat_id", "beats")


@query(as_cte("catalog") + """, a AS (SELECT beat_id, CASE WHEN beat_id % 3 = 0 THEN 'k' || beat_id ELSE NULL END AS m FROM catalog)
SELECT '/a/' || beat_id || '.wav' AS path, CASE WHEN beat_id % 3 = 0 THEN 'name ' || beat_id WHEN beat_id % 3 = 1 THEN 'stem ' || beat_id END AS title, CASE WHEN beat_id % 4 = 0 THEN 'beat-' || beat_id ELSE CAST(beat_id AS VARCHAR) END AS id FROM catalog""")
def s06_s07_metadata_and_ids(spark, d):
    """Sidecar rows by file name or stem; ids by serial, else by file."""
    c = events(spark, d, "catalog").select(F.col("beat_id").cast("string").alias("b"), "beat_id")
    assets = c.select(F.concat(F.lit("/a/"), "b", F.lit(".wav")).alias("path"))
    side = c.select(F.when(F.col("beat_id") % 3 == 0, F.concat("b", F.lit(".wav"))).otherwise(F.col("b")).alias("file"), F.when(F.col("beat_id") % 3 == 0, F.concat(F.lit("name "), "b")).when(F.col("beat_id") % 3 == 1, F.concat(F.lit("stem "), "b")).alias("title"), F.when(F.col("beat_id") % 4 == 0, F.col("b")).otherwise(F.lit(" ")).alias("serial")).filter("title is not null or serial <> ' '")
    found = catalog_io.join_metadata(assets, side)
    return found.select("path", "title", catalog_io.derive_id(found).alias("id"))


@query(as_cte("catalog") + """, x AS (SELECT beat_id, CASE WHEN beat_id % 7 = 0 THEN 'missing' WHEN beat_id % 5 = 0 THEN 'version' WHEN beat_id % 3 = 0 THEN 'bar_anchor' WHEN beat_id % 2 = 0 THEN 'rhythm' END AS reason FROM catalog)
SELECT CAST(beat_id AS VARCHAR) AS content_key, reason FROM x WHERE reason IS NOT NULL""")
def s08_refresh_plan(spark, d):
    n = F.col("beat_id")
    c = events(spark, d, "catalog")
    documents = c.filter(n % 7 != 0).select(n.cast("string").alias("content_key"), F.when(n % 5 == 0, "1.0.0").otherwise(catalog_io.VERSION).alias("version"), F.when(n % 3 != 0, "kick").alias("bar_anchor"), F.create_map(F.lit("rhythm"), F.when(n % 2 == 0, "basic").otherwise("neural")).alias("backends"))
    return catalog_io.refresh_plan(c.select(n.cast("string").alias("content_key")), documents, {"rhythm": "library", "separation": "neural"})


@query(as_cte("catalog") + " SELECT beat_id AS entity_id, 'profile' AS stage, 'rule' AS method FROM catalog")
def s12_lineage(spark, d):
    return catalog_io.lineage(events(spark, d, "catalog"), "beat_id", "profile", "rule").drop("at")
