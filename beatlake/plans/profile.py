"""Queries of the profiles of takes, beats and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake import constants as C
from beatlake.functions.scalars import rounded
from beatlake.operators import joins, profiles
from beatlake.plans.registry import query
from beatlake.plans.sequence import _NEAR, _TSEC, bar_lines, timed_sections
from beatlake.sources.fixtures import as_cte, events, table

_PROFILES = "VALUES " + ", ".join(f"({pc}, '{mode}', {[profile[(k - pc) % 12] for k in range(12)]}::DOUBLE[])" for mode, profile in (("major", C.KK_MAJOR), ("minor", C.KK_MINOR)) for pc in range(12))


# The 24 keys of each take, best first.
_RANKED = f""", p(key_pc, key_mode, t) AS ({_PROFILES}), s AS (SELECT take_id, CAST(round_even(midi, 0) AS INT) % 12 AS pc, sum(duration_s) AS d FROM notes GROUP BY 1, 2),
f AS (SELECT take_id, pc, coalesce(d, 0) AS d FROM (SELECT DISTINCT take_id FROM s) CROSS JOIN (SELECT unnest(range(12)) AS pc) LEFT JOIN s USING (take_id, pc)),
r AS (SELECT take_id, key_pc, key_mode, round(corr(d, t[pc + 1]), 9) AS r FROM f, p GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY r DESC, key_pc, key_mode DESC) AS n FROM r)"""


@query(as_cte("notes") + f"""{_RANKED}
SELECT a.take_id, a.key_pc, a.key_mode, round(a.r + 1e-9, 5) AS correlation, round(least(greatest((a.r - b.r) * 4 + a.r * 0.4, 0), 1) + 1e-9, 4) AS confidence FROM o a JOIN o b ON a.take_id = b.take_id AND a.n = 1 AND b.n = 2""")
def a01_key_profile(spark, d):
    """A1, K6."""
    got = profiles.key_profile(events(spark, d, "notes"))
    return got.select("take_id", "key_pc", "key_mode", rounded("correlation", 5).alias("correlation"), rounded("confidence", 4).alias("confidence"))


def chroma(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("entity_id"), "vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x).cast("double")).alias("chroma"))


@query("""
WITH c AS (SELECT label AS entity_id, [abs(x)::DOUBLE for x in embedding[1:12]] AS c FROM embeddings), s AS (SELECT entity_id, list_sum(list_sort(c, 'DESC')[1:3]) / list_sum(c) AS s FROM c), m AS (SELECT entity_id, quantile_cont(s, 0.5) AS m FROM s GROUP BY 1)
SELECT entity_id, round(m + 1e-9, 5) AS concentration, 0.55 * (1 - least(greatest((m - 0.25) / 0.5, 0), 1)) + 0.45 * 0.5 >= 0.62 AS is_atonal FROM m""")
def a05_atonality(spark, d):
    return profiles.atonality(chroma(spark, d), "entity_id").select("entity_id", rounded("concentration", 5).alias("concentration"), "is_atonal")


@query(as_cte("onsets") + """, i AS (SELECT take_id, time_s - lag(time_s) OVER (PARTITION BY take_id ORDER BY time_s, event_id) AS i FROM onsets), t AS (SELECT take_id, 60 / i AS t, least(59, CAST(floor((60 / i - 30) / 5) AS INT)) AS bin FROM i WHERE i > 0.08 AND i < 2),
c AS (SELECT take_id, bin, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT take_id, arg_max(bin, struct_pack(n := n, m := -bin)) AS peak, max(n) AS top, sum(n) AS total FROM c GROUP BY 1),
m AS (SELECT take_id, peak, top, total, quantile_cont(t, 0.5) AS med, count(*) AS k FROM t JOIN b USING (take_id) WHERE bin >= peak - 1 AND bin < peak + 2 GROUP BY 1, 2, 3, 4), r AS (SELECT *, CASE WHEN k >= 3 THEN med ELSE 30 + 5 * peak + 2.5 END AS raw FROM m)
SELECT take_id, round(CASE WHEN raw < 50 THEN raw * 2 WHEN raw > 210 THEN raw / 2 ELSE raw END + 1e-9, 4) AS bpm, round(least(2.2 * top / total, 0.75) + 1e-9, 5) AS confidence FROM r""")
def a06_tempo_histogram(spark, d):
    got = profiles.tempo_histogram(events(spark, d, "onsets"), "take_id", "event_id")
    return got.select("take_id", rounded("bpm", 4).alias("bpm"), rounded("confidence", 5).alias("confidence"))


@query(as_cte("onsets") + """, p AS (SELECT a.take_id, CAST(floor((b.time_s - a.time_s) / 0.005) AS BIGINT) AS bin FROM onsets a JOIN onsets b ON a.take_id = b.take_id AND b.time_s > a.time_s AND b.time_s - a.time_s <= 2)
SELECT take_id, bin, count(*) AS n FROM p GROUP BY 1, 2""")
def j19_lag_histogram(spark, d):
    """Votes of all pairs of onsets within two seconds."""
    return profiles.lag_histogram(events(spark, d, "onsets"), "take_id")


@query(as_cte("onsets") + """, p AS (SELECT a.take_id, CAST(floor((b.time_s - a.time_s) / 0.005) AS BIGINT) AS bin FROM onsets a JOIN onsets b ON a.take_id = b.take_id AND b.time_s > a.time_s AND b.time_s - a.time_s <= 2), h AS (SELECT take_id, bin, count(*) AS n FROM p GROUP BY 1, 2),
k(j, kw) AS (VALUES (0, 1.0::DOUBLE), (1, 0.8825), (-1, 0.8825), (2, 0.6065), (-2, 0.6065), (3, 0.3247), (-3, 0.3247), (4, 0.1353), (-4, 0.1353)), s AS (SELECT take_id, bin + j AS bin, round(sum(n * kw), 4) AS w FROM h, k GROUP BY 1, 2),
f AS (SELECT * FROM s WHERE bin * 0.005::DOUBLE >= 60 / 210 AND bin * 0.005::DOUBLE <= 2), n AS (SELECT *, CASE WHEN lag(bin) OVER o = bin - 1 THEN lag(w) OVER o ELSE 0 END AS l, CASE WHEN lead(bin) OVER o = bin + 1 THEN lead(w) OVER o ELSE 0 END AS r, max(w) OVER (PARTITION BY take_id) AS top FROM f WINDOW o AS (PARTITION BY take_id ORDER BY bin)),
m AS (SELECT take_id, min(bin) AS bin, arg_min(w / top, bin) AS strength FROM n WHERE w >= 0.6::DOUBLE * top AND w >= l AND w > r GROUP BY 1)
SELECT take_id, round((bin + 0.5) * 0.005 + 1e-9, 6) AS period_s, round(60 / ((bin + 0.5) * 0.005) + 1e-9, 4) AS bpm, round(strength + 1e-9, 6) AS strength FROM m""")
def a07_tempo_autocorr(spark, d):
    got = profiles.tempo_autocorr(events(spark, d, "onsets"), "take_id")
    return got.select("take_id", rounded("period_s", 6).alias("period_s"), rounded("bpm", 4).alias("bpm"), rounded("strength", 6).alias("strength"))


@query(as_cte("onsets", "sections") + f""", {_TSEC}, h AS (SELECT 1.0::DOUBLE AS ratio UNION ALL SELECT 2.0 UNION ALL SELECT 0.5), g AS (SELECT entity_id, ratio, start_s * ratio AS t FROM tsec, h),
b AS (SELECT o.take_id, o.event_id, o.time_s, o.ratio, g.t AS t0 FROM (SELECT onsets.*, ratio FROM onsets, h) o ASOF LEFT JOIN g ON o.take_id = g.entity_id AND o.ratio = g.ratio AND o.time_s >= g.t),
c AS (SELECT b.*, g.t AS t1 FROM b ASOF LEFT JOIN g ON b.take_id = g.entity_id AND b.ratio = g.ratio AND b.time_s <= g.t), e AS (SELECT take_id, ratio, CASE WHEN t0 IS NULL THEN t1 - time_s WHEN t1 IS NULL THEN time_s - t0 ELSE least(t1 - time_s, time_s - t0) END AS e FROM c)
SELECT take_id, ratio, round(quantile_cont(e, 0.5) + 1e-9, 6) AS fit_error_s, count(*) AS n FROM e WHERE e IS NOT NULL GROUP BY 1, 2""")
def a09_grid_fit(spark, d):
    """Bar lines as they are, at double and at half distance."""
    ratio = F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5))).alias("ratio")
    grids = bar_lines(spark, d).select("take_id", ratio, "time_s").withColumn("time_s", F.col("time_s") * F.col("ratio"))
    onsets = events(spark, d, "onsets").select("take_id", "time_s", ratio)
    got = profiles.grid_fit(onsets, grids, ["take_id", "ratio"])
    return got.select("take_id", "ratio", rounded("fit_error_s", 6).alias("fit_error_s"), "n")


@query(as_cte("onsets") + """, r AS (SELECT round(0.96::DOUBLE + 0.08::DOUBLE * k / 800, 6) AS ratio FROM range(801) t(k)), a AS (SELECT take_id, ratio, time_s * ratio / 0.125::DOUBLE AS a FROM onsets, r),
c AS (SELECT take_id, ratio, round(avg(abs(a - round_even(a, 0)) * 0.125::DOUBLE) + 0.0001::DOUBLE * abs(ratio - 1), 9) AS cost FROM a GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY cost, ratio) AS n FROM c)
SELECT take_id, ratio, round(cost + 1e-9, 6) AS cost FROM o WHERE n = 1""")
def a10_tempo_ratio_search(spark, d):
    pairs = events(spark, d, "onsets").select("take_id", "time_s", F.lit(0.125).alias("slot_s"))
    return profiles.tempo_ratio_search(pairs, "take_id").select("take_id", "ratio", rounded("cost", 6).alias("cost"))


@query(as_cte("onsets", "sections") + f", {_NEAR} SELECT take_id, round(regr_slope(time_s - slot, time_s) + 1e-9, 6) AS slope, round(regr_intercept(time_s - slot, time_s) + 1e-9, 5) AS intercept FROM near WHERE slot IS NOT NULL GROUP BY 1")
def a11_residual_drift(spark, d):
    near = joins.asof_nearest(events(spark, d, "onsets").select("take_id", "time_s"), bar_lines(spark, d), "take_id").filter("error_s is not null")
    return profiles.residual_drift(near, "take_id").select("take_id", rounded("slope", 6).alias("slope"), rounded("intercept", 5).alias("intercept"))


@query(as_cte("onsets") + """, i AS (SELECT take_id, time_s - lag(time_s) OVER (PARTITION BY take_id ORDER BY time_s, event_id) AS i FROM onsets)
SELECT take_id, round(least(greatest(1 - 4 * stddev_pop(i) / avg(i), 0), 1) + 1e-9, 6) AS stability, round(quantile_cont(60 / i, 0.5) + 1e-9, 4) AS median_bpm FROM i WHERE i > 0 GROUP BY 1""")
def a12_grid_stability(spark, d):
    got = profiles.grid_stability(events(spark, d, "onsets"), "take_id", "event_id")
    return got.select("take_id", rounded("stability", 6).alias("stability"), rounded("median_bpm", 4).alias("median_bpm"))


_BARS = f"{_TSEC}, bars AS (SELECT entity_id, start_s, lead(start_s) OVER (PARTITION BY entity_id ORDER BY start_s) - start_s AS len FROM tsec)"


def _groove_sql(element):
    key = "take_id, element, slot" if element else "take_id, slot"
    return as_cte("onsets", "sections") + f""", {_BARS}, ok AS (SELECT * FROM (SELECT *, quantile_cont(len, 0.5) OVER (PARTITION BY entity_id) AS m FROM bars) WHERE len >= 0.5 * m AND len <= 2 * m),
s AS (SELECT o.take_id, element, strength AS v, time_s, start_s, len, CAST(round_even((time_s - start_s) / len * 16, 0) AS INT) % 16 AS slot FROM onsets o ASOF JOIN ok ON o.take_id = ok.entity_id AND o.time_s >= ok.start_s),
o AS (SELECT {key}, v, (time_s - start_s - slot * len / 16) * 1000 AS off, len FROM s WHERE time_s < start_s + len), b AS (SELECT * FROM o WHERE abs(off) <= 90 AND abs(off) <= 0.4 * len / 16 * 1000), m AS (SELECT {key}, quantile_cont(off, 0.5) AS med FROM b GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT b.*, abs(off - med) AS d FROM b JOIN m USING ({key})), g AS (SELECT {key}, quantile_cont(d, 0.5) AS mad FROM e GROUP BY ALL), h AS (SELECT {key}, sum(off * greatest(v, 1e-6)) / sum(greatest(v, 1e-6)) AS offset_ms, avg(v) AS v, count(*) AS n FROM e JOIN g USING ({key}) WHERE d <= greatest(15.0::DOUBLE, 2.5::DOUBLE * 1.4826::DOUBLE * mad) GROUP BY ALL)
SELECT {key}, round(offset_ms + 1e-9, 5) AS offset_ms, round(v / max(v) OVER (PARTITION BY {key.removesuffix(', slot')}) + 1e-9, 6) AS velocity, n FROM h"""


@query(as_cte("onsets", "sections") + f""", {_BARS}, a AS (SELECT o.take_id, (time_s - start_s) / len AS phase FROM onsets o ASOF JOIN bars b ON o.take_id = b.entity_id AND o.time_s >= b.start_s),
x AS (SELECT take_id, CAST(floor((phase - 0.42::DOUBLE) / (0.31::DOUBLE / 24)) AS INT) AS bin, count(*) AS n, sum(phase) AS p FROM a WHERE phase >= 0.42 AND phase < 0.73 GROUP BY 1, 2), k AS (SELECT *, first_value(bin) OVER (PARTITION BY take_id ORDER BY n DESC, bin) AS peak, sum(n) OVER (PARTITION BY take_id) AS total FROM x),
c AS (SELECT take_id, total, sum(p) / sum(n) AS c FROM k WHERE abs(bin - peak) <= 1 GROUP BY 1, 2)
SELECT e.entity_id AS take_id, round(CASE WHEN total >= 4 THEN least(greatest(c, 0.3), 0.78) ELSE 0.5 END::DOUBLE + 1e-9, 6) AS swing FROM (SELECT DISTINCT entity_id FROM sections) e LEFT JOIN c ON take_id = entity_id""")
def a14_swing(spark, d):
    return profiles.swing(events(spark, d, "onsets"), bar_lines(spark, d).select("take_id", "time_s"), "take_id").select("take_id", rounded("swing", 6).alias("swing"))


@query(_groove_sql(""))
def a15_groove(spark, d):
    got = profiles.groove(events(spark, d, "onsets"), bar_lines(spark, d).select("take_id", "time_s"), "take_id")
    return got.select("take_id", "slot", rounded("offset_ms", 5).alias("offset_ms"), rounded("velocity", 6).alias("velocity"), "n")


@query(_groove_sql("element"))
def a16_groove_per_element(spark, d):
    got = profiles.groove(events(spark, d, "onsets"), bar_lines(spark, d).select("take_id", "time_s"), "take_id", extra=("element",))
    return got.select("take_id", "element", "slot", rounded("offset_ms", 5).alias("offset_ms"), rounded("velocity", 6).alias("velocity"), "n")


@query(as_cte("onsets", "sections") + f", {_NEAR} SELECT take_id, round(quantile_cont(time_s - slot, 0.5) + 1e-9, 6) AS bias_s, round(stddev_pop(time_s - slot) + 1e-9, 6) AS spread_s, count(*) AS n FROM near WHERE abs(time_s - slot) <= 0.09 GROUP BY 1")
def a17_timing_bias(spark, d):
    got = profiles.timing_bias(events(spark, d, "onsets").select("take_id", "time_s"), bar_lines(spark, d), "take_id")
    return got.select("take_id", rounded("bias_s", 6).alias("bias_s"), rounded("spread_s", 6).alias("spread_s"), "n")


@query(as_cte("notes", "takes") + """, c AS (SELECT take_id, abs(midi - round_even(midi, 0)) * 100 AS c, duration_s FROM notes),
x AS (SELECT take_id, sum(CASE WHEN c <= 20 THEN duration_s ELSE 0 END) / sum(duration_s) AS t, quantile_cont(c, 0.5) AS dev, count(*) AS n FROM c GROUP BY 1),
y AS (SELECT x.*, t >= 0.55 OR (dev > 0 AND dev <= 22 AND n >= 12) AS tuned, coalesce(key_confidence * 3 > 0 AND key_confidence * 3 <= 1.5, false) AS even FROM x LEFT JOIN takes USING (take_id))
SELECT take_id, round(t + 1e-9, 6) AS in_tune, CASE WHEN tuned AND even THEN 'finished' WHEN tuned THEN 'tuned' ELSE 'raw' END AS state FROM y""")
def a18_vocal_state(spark, d):
    levels = events(spark, d, "takes").select("take_id", (F.col("key_confidence") * 3).alias("spread_db"))
    return profiles.vocal_state(events(spark, d, "notes", at=True), levels).select("take_id", rounded("in_tune", 6).alias("in_tune"), "state")


_INSIDE = f"""{_TSEC}, fi AS (SELECT f.*, exists(SELECT 1 FROM tsec s WHERE s.entity_id = f.take_id AND f.time_s >= s.start_s AND f.time_s < s.end_s) AS inside FROM level_frames f)"""


@query(as_cte("level_frames", "sections") + f""", {_INSIDE}, x AS (SELECT take_id, count(*) AS n, count(*) FILTER (inside) AS k, quantile_cont(rms_db, 0.5) FILTER (inside) AS a, quantile_cont(rms_db, 0.5) FILTER (NOT inside) AS b, quantile_cont(rms_db, 0.85) AS hi, quantile_cont(rms_db, 0.15) AS lo, quantile_cont(rms_db, 0.08) AS fl FROM fi GROUP BY 1),
y AS (SELECT *, CASE WHEN n >= 8 THEN CASE WHEN k >= 4 AND n - k >= 4 THEN a - b ELSE hi - lo END END AS snr FROM x)
SELECT take_id, round(snr + 1e-9, 5) AS snr_db, CASE WHEN snr IS NULL THEN 'unknown' WHEN snr >= 30 THEN 'clean' WHEN snr >= 20 THEN 'light' WHEN snr >= 14 THEN 'heavy' ELSE 'severe' END AS verdict, round(fl + 1e-9, 5) AS floor_db FROM y""")
def a19_noise_verdict(spark, d):
    """A19, A20."""
    frames = events(spark, d, "level_frames")
    hit = joins.interval_join(frames.select("take_id", "event_id", "time_s"), timed_sections(spark, d).select(F.col("entity_id").alias("take_id"), "start_s", "end_s"), "take_id", how="left_semi").select("event_id", F.lit(True).alias("inside"))
    marked = frames.join(hit, "event_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return profiles.noise_verdict(marked, "take_id", "inside").select("take_id", rounded("snr_db", 5).alias("snr_db"), "verdict", rounded("floor_db", 5).alias("floor_db"))


@query(as_cte("level_frames") + """, r AS (SELECT take_id, max(time_s) AS duration_s, count(*) FILTER (is_voice) AS n_voiced, max(rms_db * 0.5) AS peak_db, 100 * avg(CASE WHEN clipped AND event_id % 50 = 0 THEN 1.0 ELSE 0.0 END) AS clipped_pct, quantile_cont(rms_db, 0.5) FILTER (is_voice) AS rms,
  CASE WHEN count(*) FILTER (NOT is_voice) >= 10 THEN quantile_cont(rms_db - 9, 0.5) FILTER (NOT is_voice) END AS fl, quantile_cont(rms_db, 0.9) FILTER (is_voice) - quantile_cont(rms_db, 0.1) FILTER (is_voice) AS spread FROM level_frames GROUP BY 1),
q AS (SELECT *, rms - fl AS snr FROM r), z AS (SELECT *, n_voiced = 0 OR clipped_pct > 0.5 OR coalesce(snr < 6, false) AS fatal, CASE WHEN clipped_pct > 0.02 AND clipped_pct <= 0.5 THEN 1 ELSE 0 END + CASE WHEN snr < 12 AND snr >= 6 THEN 1 ELSE 0 END + CASE WHEN peak_db < -20 THEN 1 ELSE 0 END AS w FROM q)
SELECT take_id, round(duration_s + 1e-9, 5) AS duration_s, n_voiced, round(peak_db + 1e-9, 5) AS peak_db, round(clipped_pct + 1e-9, 5) AS clipped_pct, round(snr + 1e-9, 5) AS snr_db, round(spread + 1e-9, 5) AS level_spread_db, NOT fatal AS usable, CASE WHEN fatal THEN 'unusable' WHEN w > 1 THEN 'rough' WHEN w = 1 THEN 'ok' ELSE 'good' END AS grade FROM z""")
def a22_take_report(spark, d):
    frames = events(spark, d, "level_frames").withColumn("peak_db", F.col("rms_db") * 0.5).withColumn("clipped", F.col("clipped") & (F.col("event_id") % 50 == 0)).withColumn("rms_db", F.when(F.col("is_voice"), F.col("rms_db")).otherwise(F.col("rms_db") - 9))
    got = profiles.take_report(frames)
    return got.select("take_id", rounded("duration_s", 5).alias("duration_s"), "n_voiced", rounded("peak_db", 5).alias("peak_db"), rounded("clipped_pct", 5).alias("clipped_pct"), rounded("snr_db", 5).alias("snr_db"), rounded("level_spread_db", 5).alias("level_spread_db"), "usable", "grade")


@query("""
WITH b AS (SELECT vec_id, unnest(embedding)::DOUBLE * 60 AS m, 100 * generate_subscripts(embedding, 1) AS hz FROM embeddings), p AS (SELECT *, power(10, m / 10) AS p FROM b)
SELECT vec_id, round(sum(CASE WHEN hz >= 60 AND hz < 250 THEN p ELSE 0 END) / sum(p) + 1e-9, 6) AS low, round(sum(CASE WHEN hz >= 800 AND hz < 4000 THEN p ELSE 0 END) / sum(p) + 1e-9, 6) AS mid,
  round(least(greatest(1 - (sum(CASE WHEN hz >= 220 AND hz < 4000 THEN p ELSE 0 END) / sum(p) - 0.1) / 0.38, 0), 1) + 1e-9, 6) AS pocket, round(least(greatest(sum(CASE WHEN hz >= 1000 AND hz < 4000 THEN p ELSE 0 END) / sum(CASE WHEN hz >= 150 AND hz < 500 THEN p ELSE 0 END), 0), 2) + 1e-9, 6) AS clarity FROM p GROUP BY 1""")
def a24_spectral_bands(spark, d):
    """A24, A25."""
    bins = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", (100 * (F.col("i") + 1)).alias("freq_hz"), (F.col("x").cast("double") * 60).alias("mag_db"))
    return profiles.spectral_bands(bins, "vec_id").select("vec_id", *(rounded(k, 6).alias(k) for k in ("low", "mid", "pocket", "clarity")))


@query("""
WITH b AS (SELECT vec_id, unnest(embedding)::DOUBLE * 60 AS m, 100 * generate_subscripts(embedding, 1) AS hz FROM embeddings), w AS (SELECT *, avg(m) OVER (PARTITION BY vec_id ORDER BY hz ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS t, lag(m) OVER o AS l, lead(m) OVER o AS r FROM b WINDOW o AS (PARTITION BY vec_id ORDER BY hz)),
p AS (SELECT vec_id, hz, round(m - t, 9) AS prominence FROM w WHERE m > l AND m >= r AND hz BETWEEN 150 AND 6000), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prominence DESC, hz) AS place FROM p WHERE prominence > 0)
SELECT vec_id, CAST(place AS INT) AS place, CAST(hz AS INT) AS freq_hz, round(prominence + 1e-9, 6) AS prominence FROM o WHERE place <= 5""")
def a36_resonances(spark, d):
    bins = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", (100 * (F.col("i") + 1)).alias("freq_hz"), (F.col("x").cast("double") * 60).alias("mag_db"))
    return profiles.resonances(bins, "vec_id").select("vec_id", "place", "freq_hz", rounded("prominence", 6).alias("prominence"))


@query(as_cte("notes") + """, p AS (SELECT take_id, quantile_cont(midi, [0.05, 0.5, 0.95]) AS p FROM notes GROUP BY 1), h AS (SELECT *, 440 * power(2, (p[2] - 69) / 12) AS hz FROM p)
SELECT take_id, round(p[1] + 1e-9, 5) AS low, round(p[2] + 1e-9, 5) AS median, round(p[3] + 1e-9, 5) AS high, CASE WHEN hz < 110 THEN 'bass' WHEN hz < 165 THEN 'baritone' WHEN hz < 220 THEN 'tenor' WHEN hz < 330 THEN 'alto' ELSE 'soprano' END AS voice FROM h""")
def a26_voice_profile(spark, d):
    """Notes as voiced pitch."""
    got = profiles.voice_profile(events(spark, d, "notes").select("take_id", "midi", F.lit(True).alias("voiced")), "take_id")
    return got.select("take_id", rounded("low", 5).alias("low"), rounded("median", 5).alias("median"), rounded("high", 5).alias("high"), "voice")


@query(as_cte("level_frames") + """, m AS (SELECT *, quantile_cont(rms_db, 0.5) OVER (PARTITION BY take_id) AS m, count(*) OVER (PARTITION BY take_id) AS n FROM level_frames)
SELECT event_id, round(CASE WHEN n < 6 THEN 0.7 ELSE least(greatest(0.7 + (rms_db - m) / 30, 0), 1) END + 1e-9, 6) AS velocity, round(least(greatest((m - rms_db) * 0.5, -6), 6) + 1e-9, 6) AS gain_db FROM m""")
def a27_a35_velocity_and_ride(spark, d):
    """Frames as notes and as phrases."""
    rows = profiles.note_velocity(events(spark, d, "level_frames").withColumn("level_db", F.col("rms_db")), "take_id")
    rows = profiles.ride_gains(rows.withColumn("w", F.lit(0.5)), "take_id", "rms_db", "w")
    return rows.select("event_id", rounded("velocity", 6).alias("velocity"), rounded("gain_db", 6).alias("gain_db"))


@query(as_cte("takes", "notes") + """, n AS (SELECT take_id, quantile_cont(duration_s, 0.5) AS m, stddev_pop(midi) AS sp, avg(CASE WHEN duration_s > 0.3 THEN 1.0 ELSE 0.0 END) AS h, count(*) AS n FROM notes GROUP BY 1), x AS (SELECT take_id, syllable_rate AS r, n.* EXCLUDE take_id FROM takes LEFT JOIN n USING (take_id))
SELECT take_id, CASE WHEN n IS NULL THEN CASE WHEN r >= 2 THEN 'rap' ELSE 'spoken' END WHEN r > 3.6 AND m < 0.16 THEN CASE WHEN sp < 2.6 THEN 'rap' ELSE 'melodic_rap' END WHEN h > 0.34 AND sp > 2 THEN 'sung' WHEN r > 2.6 THEN 'melodic_rap' ELSE 'sung' END AS performance_type,
  CAST(CASE WHEN n IS NULL THEN 0.3 WHEN r > 3.6 AND m < 0.16 THEN 0.85 WHEN h > 0.34 AND sp > 2 THEN 0.85 WHEN r > 2.6 THEN 0.5 ELSE 0.45 END AS DOUBLE) AS confidence FROM x""")
def p29_classify_performance(spark, d):
    return profiles.classify_performance(events(spark, d, "notes"), events(spark, d, "takes").select("take_id", "syllable_rate"))


_T = C.TEMPLATES


def _range_sql(x, lo, hi, tol):
    return f"CASE WHEN {x} >= {float(lo)}::DOUBLE AND {x} <= {float(hi)}::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (CASE WHEN {x} < {float(lo)}::DOUBLE THEN {float(lo)}::DOUBLE - {x} ELSE {x} - {float(hi)}::DOUBLE END) / {tol}::DOUBLE) END"


def _score_sql(t):
    lo, hi = t["bpm"]
    tol = (hi - lo) * 0.5 + 6.0
    bpm = f"greatest({', '.join(_range_sql(f'(bpm * {m}::DOUBLE)', lo, hi, tol) for m in (1.0, 2.0, 0.5))})" if t["half"] else _range_sql("bpm", lo, hi, tol)
    parts = [f"({bpm}) * 3.0::DOUBLE"] + [f"({_range_sql(f, *t[f], tol_)}) * {w}::DOUBLE" for f, (tol_, w) in C.GENRE_FEATURES.items()]
    rhythm = [f"CASE WHEN {f} > 0 THEN ({_range_sql(f, *t[f], tol_)}) * {w}::DOUBLE ELSE 0 END" for f, (tol_, w) in C.GENRE_RHYTHM.items()]
    weight = " + ".join(["3.0::DOUBLE"] + [f"{w}::DOUBLE" for _, w in C.GENRE_FEATURES.values()] + [f"CASE WHEN {f} > 0 THEN {w}::DOUBLE ELSE 0 END" for f, (_, w) in C.GENRE_RHYTHM.items()])
    return f"round(least(greatest(({' + '.join(parts + rhythm)}) / ({weight}) * {t['prior']}::DOUBLE, 0), 1), 9)"


_FEATURES = "bpm, (beat_id % 40) / 100.0::DOUBLE AS sub, (beat_id % 55) / 100.0::DOUBLE AS air, CAST(800 + beat_id * 13 % 5000 AS DOUBLE) AS centroid, (beat_id % 12) / 100.0::DOUBLE AS flatness, CAST(5 + beat_id % 20 AS DOUBLE) AS dynamic_range, 0.4::DOUBLE + (beat_id % 30) / 100.0::DOUBLE AS swing, CAST(beat_id % 15 AS DOUBLE) AS hat_density, CAST(beat_id % 9 AS DOUBLE) AS onset_rate"


@query(as_cte("catalog") + f""", f AS (SELECT beat_id, {_FEATURES} FROM catalog), s AS (SELECT beat_id, unnest([{', '.join(f"struct_pack(score := {_score_sql(t)}, o := {-k}, genre := '{n}')" for k, (n, t) in enumerate(_T.items()))}]) AS x FROM f),
r AS (SELECT beat_id, x, row_number() OVER (PARTITION BY beat_id ORDER BY x.score DESC, x.o DESC) AS n FROM s)
SELECT a.beat_id, a.x.genre AS genre, round(a.x.score + 1e-9, 5) AS score, round(a.x.score - b.x.score + 1e-9, 5) AS margin, b.x.genre AS runner_up FROM r a JOIN r b ON a.beat_id = b.beat_id AND a.n = 1 AND b.n = 2""")
def j21_genre_scores(spark, d):
    n = F.col("beat_id")
    tracks = events(spark, d, "catalog").select(
        "beat_id", "bpm", (n % 40 / F.lit(100.0)).alias("sub"), (n % 55 / F.lit(100.0)).alias("air"), (800 + n * 13 % 5000).cast("double").alias("centroid"), (n % 12 / F.lit(100.0)).alias("flatness"), (5 + n % 20).cast("double").alias("dynamic_range"),
        (0.4 + n % 30 / F.lit(100.0)).alias("swing"), (n % 15).cast("double").alias("hat_density"), (n % 9).cast("double").alias("onset_rate"), F.lit(None).cast("string").alias("tag"),
    )
    return profiles.genre_scores(tracks, "beat_id").select("beat_id", "genre", rounded("score", 5).alias("score"), rounded("margin", 5).alias("margin"), "runner_up")


@query("""
WITH b AS (SELECT vec_id, [abs(x)::DOUBLE for x in embedding[1:12]] AS c FROM embeddings), t AS (SELECT q, r, [CASE WHEN list_contains(CASE q WHEN 'maj' THEN [0, 4, 7] ELSE [0, 3, 7] END, (k - r + 12) % 12) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for k in range(12)] AS v FROM (VALUES ('maj'), ('min')) a(q), range(12) b(r)),
s AS (SELECT vec_id, q, r, round(list_dot_product(c, v) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(v, v))), 9) AS c FROM b, t), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, q = 'maj' DESC, r) AS n FROM s)
SELECT vec_id AS entity_id, CAST(r AS INT) AS root, q AS quality, round(c + 1e-9, 6) AS confidence FROM o WHERE n = 1""")
def a04_bar_chords(spark, d):
    bins = chroma(spark, d).select(F.col("vec_id").alias("entity_id"), F.lit(0).alias("bar"), F.col("chroma").alias("bins"))
    return profiles.bar_chords(bins, "entity_id").select("entity_id", "root", "quality", rounded("confidence", 6).alias("confidence"))


@query(as_cte("notes") + """ SELECT take_id, round(sum(abs(midi - 60) * greatest(duration_s, 1e-6)) / sum(greatest(duration_s, 1e-6)) + 1e-9, 5) AS weighted_error, round(corr(midi, duration_s) + 1e-9, 5) AS corr FROM notes GROUP BY 1""")
def a34_a44_weighted_error_and_corr(spark, d):
    """A34, A44."""
    notes = events(spark, d, "notes").withColumn("e", F.col("midi") - 60)
    errors = profiles.weighted_error(notes, "take_id", "e", "duration_s")
    corr = profiles.channel_check(notes.select("take_id", F.col("midi").alias("left"), F.col("duration_s").alias("right")), "take_id")
    return errors.join(corr, "take_id").select("take_id", rounded("weighted_error", 5).alias("weighted_error"), rounded("corr", 5).alias("corr"))


@query(as_cte("chords") + """, x AS (SELECT entity_id, root AS key_pc, quality AS key_mode, round(sum(1 + bar % 3), 6) AS s FROM chords GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, key_pc, key_mode DESC) AS n FROM x)
SELECT entity_id, key_pc, key_mode, CAST(s AS DOUBLE) AS total_s FROM o WHERE n = 1""")
def a47_dominant_key(spark, d):
    regions = events(spark, d, "chords").select("entity_id", F.col("root").alias("key_pc"), F.col("quality").alias("key_mode"), (1 + F.col("bar") % 3).cast("double").alias("duration_s"))
    return profiles.dominant_key(regions, "entity_id")
