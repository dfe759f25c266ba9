"""Whole jobs, each a table of what several operators tell of one take or section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from beatlake.functions.music import render_notes
from beatlake.plans import extra, match, more, plan, profile, rest, sequence  # noqa: F401
from beatlake.plans.registry import ORACLE_SQL, QUERIES, query
from beatlake.sources.fixtures import as_cte, events
from beatlake.sources.lineage import stored


def _sql(base: str, by: tuple[str, ...], parts: dict[str, dict[str, str]], id_of: dict[str, str] | None = None) -> str:
    names = ", ".join(["x." + k for k in by] + [f"p{k}.{c} AS {n}" for k, columns in enumerate(parts.values()) for c, n in columns.items()])
    joins = " ".join(f"LEFT JOIN ({ORACLE_SQL[name]}) p{k} ON " + " AND ".join(f"x.{b} = p{k}.{(id_of or {}).get(name, b)}" for b in by) for k, name in enumerate(parts))
    return f"SELECT {names} FROM ({base}) x {joins}"


def _joined(spark, d, base, by: tuple[str, ...], parts: dict[str, dict[str, str]], id_of: dict[str, str] | None = None):
    """Left joins on one key. id_of names a part's own column for it. Parts are written first: as all of them end on the key, a stage
    of all of them would hold the sorts and windows of each at once."""
    sides = [stored(QUERIES[name](spark, d).selectExpr(*(f"{(id_of or {}).get(name, b)} AS {b}" for b in by), *(f"{c} AS {n}" for c, n in columns.items()))) for name, columns in parts.items()]
    return reduce(lambda a, b: a.join(b, list(by), "left"), sides, base.select(*by))


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_BEATS = {"j21_genre_scores": {"genre": "genre", "score": "genre_score"}, "a47_dominant_key": {"key_pc": "key_pc", "key_mode": "key_mode"}, "a05_atonality": _same("is_atonal"), "p49_loop_points": {"n": "n_loops"},
          "a12_grid_stability": {"stability": "grid_stability", "median_bpm": "median_bpm"}, "a14_swing": {"swing": "swing"}, "a43_onset_rate": _same("onset_rate", "hat_density"),
          "a13_downbeat_phase": {"phase": "downbeat_phase"}, "p24_reconcile_tags": {"source": "bpm_source", "bpm": "bpm"}, "w11_progression_fingerprint": _same("progression")}
#: By what those know a beat.
_ID_OF = {"a47_dominant_key": "entity_id", "a05_atonality": "entity_id", "p49_loop_points": "entity_id", "a12_grid_stability": "take_id", "a14_swing": "take_id", "a43_onset_rate": "take_id", "a13_downbeat_phase": "entity_id", "w11_progression_fingerprint": "entity_id"}
_TAKES = {"a22_take_report": _same("duration_s", "peak_db", "snr_db", "usable", "grade"), "a26_voice_profile": {"low": "voice_low", "median": "voice_median", "high": "voice_high", "voice": "voice"}, "a18_vocal_state": _same("in_tune", "state"),
          "p29_classify_performance": {"performance_type": "performance_type", "confidence": "performance_confidence"}, "a01_key_profile": {"key_pc": "key_pc", "key_mode": "key_mode", "confidence": "key_confidence"}, "a06_tempo_histogram": {"bpm": "bpm", "confidence": "bpm_confidence"},
          "a07_tempo_autocorr": {"bpm": "pulse_bpm", "strength": "pulse_strength"}, "w04_voice_activity": _same("open_db", "close_db"), "w08_performance_span": _same("start_s", "end_s"), "a19_noise_verdict": {"verdict": "noise", "floor_db": "floor_db"}, "a21_voice_presence": _same("presence"), "a28_vibrato": _same("rate_hz", "depth_cents"),
          "a29_expression_profile": _same("scoop_share", "melisma_share", "intonation_cents", "intonation_spread"), "p25_build_requirements": {"low": "tempo_low", "high": "tempo_high", "genres": "genres", "min_pocket": "min_pocket"}}
_PAIRS = {"j18_relationship": _same("relationship", "offset_s"), "j17_decide_key": {"key_pc": "key_pc", "key_mode": "key_mode", "action": "key_action"}, "p44_render_policy": _same("denoise", "placement", "stretch", "shift", "tuning", "timing"),
          "j19_best_lag": _same("lag_s", "lag_ratio"), "j24_bar_phase": {"turn": "bar_turn"}, "j25_grid_shift": {"shift_s": "grid_shift_s"}, "j26_placement": {"bar_s": "bar_s"}, "j27_beat_fit": _same("fit", "target_s"), "p60_p61_strengths_and_nudge": _same("tuning_strength", "timing_strength")}
_PERFORMANCE = {"a17_timing_bias": {"bias_s": "bias_s", "spread_s": "spread_s"}, "j26_placement": {"bar_s": "bar_s", "offset_s": "offset_s"}, "j32_stretch_decision": {"stretch": "stretch"}, "a14_swing": {"swing": "swing"}}
_ARRANGEMENT = {"w22_energy_contour": {"energy": "energy"}, "w18_label_sections": {"label": "label"}, "w24_transitions": {"jump": "jump", "n_effects": "n_effects"}}
_GRADES = {"a30_graded": _same("errors", "warnings", "score", "passed"), "k04_rank_renders": {"place": "place"}, "k05_best_attempt": {"attempt": "best_attempt", "score": "best_score"}}
_REVIEW = {"a22_take_report": _same("usable", "grade", "snr_db", "level_spread_db"), "a19_noise_verdict": {"verdict": "noise", "floor_db": "floor_db"}, "a33_tuning_error": {"tuning_cents": "tuning_cents"}, "w26_longest_silence": _same("silent_frames"), "k03_rank_takes": {"place": "place"}}


@query(_sql(as_cte("catalog") + " SELECT beat_id FROM catalog", ("beat_id",), _BEATS, _ID_OF))
def q01_profile_catalog(spark, d):
    """The tables know a beat's chords, sections and onsets by the number of the beat."""
    return _joined(spark, d, events(spark, d, "catalog"), ("beat_id",), _BEATS, _ID_OF)


@query(_sql(as_cte("takes") + " SELECT take_id FROM takes", ("take_id",), _TAKES))
def q02_profile_takes(spark, d):
    return _joined(spark, d, events(spark, d, "takes"), ("take_id",), _TAKES)


@query(_sql(as_cte("takes") + " SELECT take_id FROM takes", ("take_id",), _PAIRS))
def q04_plan_pairs(spark, d):
    return _joined(spark, d, events(spark, d, "takes"), ("take_id",), _PAIRS)


@query(_sql(as_cte("takes") + " SELECT take_id FROM takes", ("take_id",), _PERFORMANCE))
def q05_plan_performance(spark, d):
    return _joined(spark, d, events(spark, d, "takes"), ("take_id",), _PERFORMANCE)


@query(_sql(as_cte("sections") + " SELECT entity_id, seq FROM sections", ("entity_id", "seq"), _ARRANGEMENT))
def q06_plan_arrangement(spark, d):
    return _joined(spark, d, events(spark, d, "sections"), ("entity_id", "seq"), _ARRANGEMENT)


@query(_sql(as_cte("renders") + " SELECT render_id FROM renders", ("render_id",), _GRADES))
def q07_grade_renders(spark, d):
    return _joined(spark, d, events(spark, d, "renders"), ("render_id",), _GRADES)


@query(as_cte("takes") + """ SELECT take_id, array_to_string([x for x in [
  CASE WHEN performance_type = 'spoken' THEN 'background noise was reduced under the vocal' END,
  CASE WHEN take_id % 13 <> 6 THEN 'the take was ' || CASE WHEN take_id % 13 > 6 THEN 'raised' ELSE 'lowered' END || ' by ' || abs(take_id % 13 - 6) || ' dB to a working level' END,
  CASE WHEN take_id % 41 <> 20 THEN 'the vocal was ' || CASE WHEN take_id % 41 > 20 THEN 'slowed' ELSE 'sped up' END || ' by ' || abs(take_id % 41 - 20) || '.00% to sit on the beat''s tempo' END,
  'treated as ' || replace(performance_type, '_', ' ') || ', as you said'] if x IS NOT NULL], '; ') AS notes FROM takes""")
def p54_render_notes(spark, d):
    """P54 over takes whose plan comes from their numbers."""
    plan = {"denoised": F.col("performance_type") == "spoken", "gain_db": F.col("take_id") % 13 - 6, "ratio": 1 + (F.col("take_id") % 41 - 20) / 100, "stated_type": F.col("performance_type")}
    return events(spark, d, "takes").select("take_id", F.array_join(render_notes(plan), "; ").alias("notes"))


@query(_sql(as_cte("takes") + " SELECT take_id FROM takes", ("take_id",), _REVIEW))
def q09_review_takes(spark, d):
    return _joined(spark, d, events(spark, d, "takes"), ("take_id",), _REVIEW)
