"""T2-T10 and Q8 over tables: plosives, and live coaching as a replay, each with the SQL that says what it must tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.functions.scalars import rounded
from beatlake.plans.registry import ORACLE_SQL, query
from beatlake.sources.fixtures import DUCK_ADAPTERS, table
from beatlake.streaming import coaching, live

#: Events as measured frames of sixteen microphones; a day is four seconds.
_FRAMES = """SELECT user_id % 16 AS take_id, event_id, {ts} AS ts, ({micros} - 1704067200000000) / CAST(21600000000 AS DOUBLE) AS time_s, -70 + value * CAST(0.7 AS DOUBLE) AS rms_db, -64 + value * CAST(0.7 AS DOUBLE) AS peak_db,
  event_type = 'error' AS clipped, (event_id * 37 % 100) / CAST(100 AS DOUBLE) AS low, (event_id * 53 % 60) / CAST(100 AS DOUBLE) AS mid, CASE WHEN event_id % 3 <> 0 THEN 48 + (event_id * 7 % 53) / CAST(2 AS DOUBLE) END AS midi FROM """
_DUCK = _FRAMES.format(ts="ts", micros="epoch_us(ts)") + "events"


def frames(spark, d):
    return spark.sql(_FRAMES.format(ts="CAST(ts AS TIMESTAMP)", micros="unix_micros(CAST(ts AS TIMESTAMP))") + "{events}", events=table(spark, d, "events"))


#: Frames in order with floor, gate and plosive.
_GATED = f"""f AS ({_DUCK}), w AS (SELECT *, row_number() OVER o AS n, CASE WHEN count(*) OVER r >= 20 THEN quantile_cont(rms_db, 0.1) OVER r ELSE -70 END AS floor_db FROM f WINDOW o AS (PARTITION BY take_id ORDER BY time_s, event_id), r AS (PARTITION BY take_id ORDER BY time_s, event_id ROWS BETWEEN 399 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, rms_db > greatest(-55, floor_db + 10) AS voice FROM w), g AS (SELECT *, voice AND low > 0.45 AND mid < 0.12 AND low > 2 * CASE WHEN lag(voice, 1, false) OVER o THEN lag(low) OVER o ELSE 0 END AS plosive, CASE WHEN voice THEN low / greatest(mid, 0.000001::DOUBLE) ELSE 0::DOUBLE END AS ratio FROM v WINDOW o AS (PARTITION BY take_id ORDER BY n))"""


@query(f"WITH {_GATED} SELECT event_id, voice AS is_voice, plosive AS is_plosive FROM g")
def t04_plosive(spark, d):
    """T4 from band columns, on frames that T2 and T3 gate."""
    return coaching.plosives(live.voice_gate(frames(spark, d))).select("event_id", "is_voice", "is_plosive")


_CUES = {"clipping": ("fatal", "peak_db"), "no_signal": ("warn", "rms_db"), "too_quiet": ("warn", "rms_db"), "too_hot": ("warn", "rms_db"), "too_close": ("warn", "ratio"), "too_far": ("info", "ratio"), "plosive": ("info", "ratio")}
_SINCE = ("quiet", "hot", "close", "far")


#: When a take without frames is told of its silence.
_DUE = "CASE WHEN voice_at IS NOT NULL THEN greatest(coalesce(silent, voice_at + 4) + 0.8::DOUBLE, voice_at + 4) + 1 END"


def _coach_sql(gated: str, stalls: str = "coalesce(due < t, false)") -> str:
    """A frame of every take at a time: a recursive query whose rows (s) are the state after a frame, with what was told at it,
    and h, the same with the frames."""
    state = {"last_cue": "-1e9::DOUBLE", "recent": "[]::DOUBLE[]", **{f"told_{c}": "-1e9::DOUBLE" for c in _CUES}, "clips": "0", "silent": "NULL::DOUBLE", **{f"since_{c}": "NULL::DOUBLE" for c in _SINCE},
             "voice_at": "NULL::DOUBLE", "voiced_s": "0::DOUBLE", "last_t": "NULL::DOUBLE", "samples": "[]::DOUBLE[]", "baseline": "NULL::DOUBLE", "note": "NULL::DOUBLE"}
    told = {"stall_at": "NULL::DOUBLE", "stall_db": "NULL::DOUBLE", "cue": "NULL::VARCHAR", "was_db": "NULL::DOUBLE"}
    budget = lambda t, own: f"({t} - last_cue >= 6 AND len(list_filter(recent, lambda x: {t} - x < 60)) < 4 AND {t} - {own} >= 20)"
    levels = [
        f"*, {_DUE} AS due",
        f"*, {stalls} AS stalls, coalesce({stalls} AND {budget('due', 'told_no_signal')}, false) AS stall",
        "* REPLACE (CASE WHEN stalls THEN coalesce(silent, voice_at + 4) ELSE silent END AS silent, CASE WHEN stall THEN due ELSE last_cue END AS last_cue, CASE WHEN stall THEN list_append(recent, due) ELSE recent END AS recent, CASE WHEN stall THEN due ELSE told_no_signal END AS told_no_signal)",
        "*, baseline IS NULL AND voice AND ratio > 0 AS samples_it, CASE WHEN last_t IS NULL THEN 0 ELSE greatest(0, t - last_t) END AS step, CASE WHEN clipped THEN clips + 1 ELSE 0 END AS clips_",
        "* REPLACE (CASE WHEN samples_it THEN list_append(samples, ratio) ELSE samples END AS samples, CASE WHEN samples_it THEN voiced_s + step ELSE voiced_s END AS voiced_s, CASE WHEN baseline IS NULL THEN t ELSE last_t END AS last_t, clips_ AS clips, CASE WHEN clips_ < 3 AND voice THEN t ELSE voice_at END AS voice_at)",
        "* REPLACE (CASE WHEN samples_it AND voiced_s >= 4 AND len(samples) >= 20 THEN list_median(samples) ELSE baseline END AS baseline)",
        "* REPLACE (CASE WHEN baseline IS NULL THEN samples ELSE [] END AS samples), clips < 3 AND coalesce(t - voice_at > 4, false) AS is_silent, CASE WHEN coalesce(baseline, 0) <> 0 THEN ratio > baseline * 2 ELSE ratio > 2.8 END AS is_close, CASE WHEN coalesce(baseline, 0) <> 0 THEN ratio < baseline * 0.5::DOUBLE ELSE ratio > 0 AND ratio < 0.2 END AS is_far, rms_db < -38 AS is_quiet, rms_db > -9 AND NOT clipped AS is_hot",
        "* REPLACE (CASE WHEN is_silent THEN coalesce(silent, t) ELSE silent END AS silent)",
        "*, is_silent AND t - silent >= 0.8::DOUBLE AS held_silent",
        "*, clips < 3 AND NOT held_silent AND voice AS at_quiet",
    ]
    for k, c in enumerate(_SINCE):
        after = _SINCE[k + 1] if k + 1 < len(_SINCE) else "plosive"
        levels += [f"* REPLACE (CASE WHEN NOT at_{c} THEN since_{c} WHEN is_{c} THEN coalesce(since_{c}, t) END AS since_{c})", f"*, at_{c} AND is_{c} AND coalesce(t - since_{c} >= 0.8::DOUBLE, false) AS held_{c}", f"*, at_{c} AND NOT held_{c} AS at_{after}"]
    wants = {"clipping": "clips >= 3", "no_signal": "held_silent", "too_quiet": "held_quiet", "too_hot": "held_hot", "too_close": "held_close", "too_far": "held_far", "plosive": "at_plosive AND plosive"}
    levels.append("*, CASE " + " ".join(f"WHEN {w} THEN '{c}'" for c, w in wants.items()) + " END AS wanted")
    speaks = " ".join(f"WHEN '{c}' THEN " + (f"t - told_{c} > 3" if _CUES[c][0] == "fatal" else budget("t", f"told_{c}")) for c in _CUES)
    levels.append(f"*, CASE WHEN CASE wanted {speaks} ELSE false END THEN wanted END AS says")
    levels.append("* REPLACE (coalesce(CASE WHEN says IS NOT NULL THEN t END, last_cue) AS last_cue, CASE WHEN says IS NOT NULL THEN list_append(recent, t) ELSE recent END AS recent, " + ", ".join(f"CASE WHEN says = '{c}' THEN t ELSE told_{c} END AS told_{c}" for c in _CUES) + ")")
    jump = "CASE WHEN abs(abs(midi - note) - 12) < 1 THEN 12 * sign(midi - note) WHEN abs(abs(midi - note) - 24) < 1 THEN 24 * sign(midi - note) ELSE 0 END"
    levels.append(f"* REPLACE (CASE WHEN NOT voice THEN NULL WHEN midi IS NULL THEN note WHEN note IS NULL THEN midi ELSE (midi - {jump}) * (1 - 0.35::DOUBLE) + note * 0.35::DOUBLE END AS note)")
    inner = "SELECT s.* EXCLUDE (n, stall_at, stall_db, cue, was_db), s.was_db AS before_db, g.* EXCLUDE (take_id), g.time_s AS t FROM s JOIN g ON g.take_id = s.take_id AND g.n = s.n + 1"
    for level in levels:
        inner = f"SELECT {level} FROM ({inner})"
    step = f"SELECT take_id, n, {', '.join(state)}, CASE WHEN stall THEN due END AS stall_at, before_db AS stall_db, says AS cue, rms_db AS was_db FROM ({inner})"
    start = f"SELECT DISTINCT take_id, 0::BIGINT AS n, {', '.join(f'{v} AS {k}' for k, v in (state | told).items())} FROM g"
    gated = gated.replace("g AS (", "g AS MATERIALIZED (")
    return f"WITH RECURSIVE {gated}, s AS ({start} UNION ALL {step}), h AS MATERIALIZED (SELECT s.* EXCLUDE (n), g.* EXCLUDE (take_id), count(*) OVER (PARTITION BY take_id) AS frames FROM s JOIN g USING (take_id, n))"


_VALUE = "CASE cue " + " ".join(f"WHEN '{c}' THEN {v}" for c, (_, v) in _CUES.items()) + " END"
_SEVERITY = "CASE cue " + " ".join(f"WHEN '{c}' THEN '{x}'" for c, (x, _) in _CUES.items()) + " END"
_BLANK = "NULL::DOUBLE AS floor_db, NULL::BOOLEAN AS is_voice, NULL::BOOLEAN AS is_plosive, NULL::DOUBLE AS midi"
_LIVE = f"""{_coach_sql(_GATED)}, e AS (SELECT *, {_DUE} AS due FROM h WHERE n = frames)
SELECT take_id, 'frame' AS kind, event_id, round(time_s + 1e-9, 5) AS at_s, round(floor_db + 1e-9, 5) AS floor_db, voice AS is_voice, plosive AS is_plosive, round(CASE WHEN midi IS NOT NULL THEN note END + 1e-9, 5) AS midi, NULL AS cue, NULL AS severity, NULL::DOUBLE AS value FROM h
UNION ALL SELECT take_id, 'cue', event_id, round(time_s, 2), {_BLANK}, cue, {_SEVERITY}, round({_VALUE} + 1e-9, 5) FROM h WHERE cue IS NOT NULL
UNION ALL SELECT take_id, 'cue', NULL, round(stall_at, 2), {_BLANK}, 'no_signal', 'warn', round(stall_db + 1e-9, 5) FROM h WHERE stall_at IS NOT NULL
UNION ALL SELECT take_id, 'cue', NULL, round(due, 2), {_BLANK}, 'no_signal', 'warn', round(was_db + 1e-9, 5) FROM e WHERE due IS NOT NULL AND due - last_cue >= 6 AND len(list_filter(recent, lambda x: due - x < 60)) < 4 AND due - told_no_signal >= 20"""


@query(_LIVE)
def q08_live_coaching(spark, d):
    """Q8: gate, plosives, octaves and cues of all frames, as their stream tells them."""
    got = coaching.replay(frames(spark, d))
    at = F.when(F.col("kind") == "frame", rounded("at_s", 5)).otherwise(F.col("at_s"))
    return got.select("take_id", "kind", "event_id", at.alias("at_s"), rounded("floor_db", 5).alias("floor_db"), "is_voice", "is_plosive", rounded("midi", 5).alias("midi"), "cue", "severity", rounded("value", 5).alias("value"))


_BATCH = f"""f AS ({DUCK_ADAPTERS['level_frames'][1].format(events='events')}), g AS (SELECT take_id, event_id, time_s, rms_db, rms_db * 0.5::DOUBLE AS peak_db, clipped, is_voice AS voice, 0.5::DOUBLE + event_id % 7 / 4.0::DOUBLE AS ratio, event_id % 40 = 0 AS plosive, NULL::DOUBLE AS midi, row_number() OVER (PARTITION BY take_id ORDER BY time_s, event_id) AS n FROM f)"""
#: T4-T10 with voice and plosives given, and no timers.
ORACLE_SQL["t04_batch_cues"] = f"{_coach_sql(_BATCH, 'false')} SELECT take_id, cue, {_SEVERITY} AS severity, round(time_s, 2) AS at_s, {_VALUE} AS value FROM h WHERE cue IS NOT NULL"
