"""Queries of matching: candidates, scores, top matches, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake import constants as C
from beatlake.functions.scalars import rounded
from beatlake.operators import matching
from beatlake.plans.music import _SHIFT_SQL
from beatlake.plans.registry import query
from beatlake.sources.fixtures import as_cte, events, table


def _spread(base):
    return list(dict.fromkeys([*base, *(n for g in base for n in C.GENRE_NEIGHBOURS.get(g, ()))]))[:8]


_GENRES = "CASE performance_type " + " ".join(f"WHEN '{p}' THEN {_spread(b)}" for p, b in C.GENRES_BY_PERFORMANCE.items()) + " END"
_WIDE = "CASE performance_type " + " ".join(f"WHEN '{p}' THEN {list(dict.fromkeys([*_spread(b), *(n for g in _spread(b) for n in C.GENRE_NEIGHBOURS.get(g, ()))]))}" for p, b in C.GENRES_BY_PERFORMANCE.items()) + " END"

_PAIRS = as_cte("catalog", "takes") + "," + _SHIFT_SQL + f""",
req AS (SELECT *, {_GENRES} AS genres, {_WIDE} AS wide, CAST(CASE WHEN syllable_rate > 3.5 THEN 0.62 WHEN syllable_rate > 2 THEN 0.52 ELSE 0.42 END AS DOUBLE) AS min_pocket FROM takes),
cross_ AS (
  SELECT t.take_id, t.bpm AS t_bpm, t.key_confidence AS t_conf, performance_type, syllable_rate, genres, wide, min_pocket, t.key_pc AS t_pc, t.key_mode AS t_mode, b.* EXCLUDE (bpm), b.bpm AS b_bpm,
    least(abs(b.bpm / t.bpm - 1), abs(b.bpm * 2 / t.bpm - 1), abs(b.bpm * 0.5::DOUBLE / t.bpm - 1)) AS err FROM req t, catalog b),
withq AS (
  SELECT c.*, s0.quality AS q0, s1.quality AS q1, s2.quality AS q2, s2.shift AS s2 FROM cross_ c
  JOIN shifts s0 ON s0.v_pc = t_pc AND s0.v_mode = t_mode AND s0.b_pc = key_pc AND s0.b_mode = key_mode AND s0.most = 0
  JOIN shifts s1 ON s1.v_pc = t_pc AND s1.v_mode = t_mode AND s1.b_pc = key_pc AND s1.b_mode = key_mode AND s1.most = 1
  JOIN shifts s2 ON s2.v_pc = t_pc AND s2.v_mode = t_mode AND s2.b_pc = key_pc AND s2.b_mode = key_mode AND s2.most = 2
  WHERE err <= 2 * 0.15::DOUBLE),
leveled AS (
  SELECT *, CASE WHEN err <= 2 * 0.06::DOUBLE THEN 0 WHEN err <= 2 * 0.1::DOUBLE THEN 1 ELSE 2 END AS lt, CASE WHEN is_atonal OR q0 >= 0.8::DOUBLE THEN 0 WHEN q1 >= 0.62::DOUBLE THEN 2 WHEN q2 >= 0.4::DOUBLE THEN 4 END AS lk,
    CASE WHEN list_contains(genres, genre) THEN 0 WHEN list_contains(wide, genre) THEN 1 ELSE 5 END AS lg, CASE WHEN pocket_score >= min_pocket THEN 0 WHEN pocket_score >= least(min_pocket, 0.45::DOUBLE) THEN 3 ELSE 4 END AS lp FROM withq),
pairs AS (SELECT *, greatest(lt, lk, lg, lp) AS first_level FROM leveled WHERE lk IS NOT NULL),
n AS (SELECT take_id, level, count(*) FILTER (first_level <= level) AS n FROM pairs, range(6) r(level) GROUP BY 1, 2),
pick AS (SELECT take_id, CAST(coalesce(min(level) FILTER (n >= 15 OR (level >= 2 AND n >= 5)), 5) AS INT) AS level FROM n GROUP BY 1),
cand AS (SELECT p.*, pick.level FROM pairs p JOIN pick USING (take_id) WHERE first_level <= pick.level)"""


@query(as_cte("takes") + f"""
, r AS (SELECT *, {_GENRES} AS genres FROM takes)
SELECT take_id, round(bpm * 0.94::DOUBLE + 1e-9, 1) AS low, round(bpm * 1.06::DOUBLE + 1e-9, 1) AS high, round(bpm * 0.5 * 0.94::DOUBLE + 1e-9, 1) AS half_low, array_to_string(genres, ',') AS genres,
  CAST(CASE WHEN syllable_rate > 3.5 THEN 0.62 WHEN syllable_rate > 2 THEN 0.52 ELSE 0.42 END AS DOUBLE) AS min_pocket, CAST(CASE WHEN performance_type IN ('rap', 'melodic_rap') THEN 0.8 ELSE 0 END AS DOUBLE) AS min_stability FROM r""")
def p25_build_requirements(spark, d):
    r = matching.requirements(events(spark, d, "takes"))
    return r.select("take_id", F.col("tempo_range")[0].alias("low"), F.col("tempo_range")[1].alias("high"), F.col("tempo_half")[0].alias("half_low"), F.array_join("genres", ",").alias("genres"), "min_pocket", "min_stability")


@query(_PAIRS + " SELECT take_id, first_level, count(*) AS n, sum(beat_id) AS beats FROM pairs GROUP BY 1, 2")
def p26_passes_filter(spark, d):
    """Pairs by the first level that lets them through."""
    return matching.level_counts(events(spark, d, "takes"), events(spark, d, "catalog")).select("take_id", "first_level", "n", "beats")


@query(_PAIRS + " SELECT take_id, beat_id, level, first_level FROM cand")
def j01_candidates(spark, d):
    kinds, members = matching.alike(events(spark, d, "takes"))
    return matching.for_all_takes(matching.candidates(kinds, events(spark, d, "catalog")).select("take_id", "beat_id", "level", "first_level"), members)


_SCORED = _PAIRS + f""",
a AS (SELECT *, least(t_conf, key_confidence) AS conf, CASE WHEN level = 0 THEN 0.06::DOUBLE WHEN level = 1 THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END AS win FROM cand),
b AS (SELECT *, conf < 0.55::DOUBLE AND s2 <> 0 AS held, least(greatest(conf / 0.55::DOUBLE, 0), 1) AS trust,
  CASE WHEN err > win * 2.5::DOUBLE THEN b_bpm / t_bpm WHEN abs(b_bpm / t_bpm - 1) = err THEN b_bpm / t_bpm WHEN abs(b_bpm * 2 / t_bpm - 1) = err THEN b_bpm * 2 / t_bpm ELSE b_bpm * 0.5::DOUBLE / t_bpm END AS ratio FROM a),
c AS (SELECT *, CASE WHEN is_atonal OR held THEN 0 ELSE s2 END AS shift, abs(ratio - 1) AS st,
  CASE WHEN is_atonal THEN 0.85::DOUBLE ELSE (CASE WHEN held THEN q0 ELSE q2 END) * trust + 0.5::DOUBLE * (1 - trust) END AS harmonic, syllable_rate / (b_bpm / 60) AS pb FROM b),
e AS (SELECT *, least(greatest(1 - (0.55::DOUBLE * abs(shift) / 2 + 0.45::DOUBLE * least(st / 0.12::DOUBLE, 1)), 0), 1) * CASE WHEN st > 0.12::DOUBLE THEN least(greatest(1 - (st - 0.12::DOUBLE) / 0.12::DOUBLE * 0.85::DOUBLE, 0.05::DOUBLE), 1) ELSE 1 END AS transform,
  CASE WHEN syllable_rate > 0 THEN CASE WHEN pb < 0.4::DOUBLE OR pb > 4.5::DOUBLE THEN 0.35::DOUBLE WHEN pb >= 0.8::DOUBLE AND pb <= 2.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
    * CASE WHEN performance_type IN ('rap', 'melodic_rap') THEN least(greatest(0.65::DOUBLE + CASE WHEN grid_stability = 0 THEN 0.5::DOUBLE ELSE grid_stability END * 0.35::DOUBLE, 0.6::DOUBLE), 1) ELSE 1 END ELSE 0.55::DOUBLE END AS rhythmic,
  least(greatest(CASE WHEN pocket_score = 0 THEN 0.5::DOUBLE ELSE pocket_score END / CASE WHEN syllable_rate > 3.5 THEN 0.62::DOUBLE ELSE 0.45::DOUBLE END, 0), 1.2::DOUBLE) / 1.2::DOUBLE AS pocket,
  CASE WHEN list_contains(genres[1:4], genre) THEN 1.0::DOUBLE WHEN list_contains(genres, genre) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS metadata,
  least(greatest(0.6::DOUBLE * (ln(1 + play_count) / ln(5001)) + 0.4::DOUBLE * least(playlist_count / 4.0::DOUBLE, 1), 0), 1) AS popularity,
  CASE WHEN has_vocal_content THEN round(least(vocal_content_ratio, 1) * 0.15::DOUBLE + 1e-9, 4) ELSE 0 END AS collision FROM c),
scored AS (SELECT *, least(greatest(0.3::DOUBLE * round(harmonic + 1e-9, 4) + 0.2::DOUBLE * round(transform + 1e-9, 4) + 0.15::DOUBLE * round(rhythmic + 1e-9, 4) + 0.15::DOUBLE * round(pocket + 1e-9, 4) + 0.1::DOUBLE * 0.5::DOUBLE + 0.05::DOUBLE * round(metadata + 1e-9, 4) + 0.05::DOUBLE * round(popularity + 1e-9, 4) - collision, 0), 1) AS score FROM e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY round(score + 1e-9, 6) DESC, beat_id) AS rank FROM scored)"""


def scored_kinds(spark, d):
    """Scored pairs of kinds of takes and beats, and the takes of each kind (matching.alike)."""
    kinds, members = matching.alike(events(spark, d, "takes"))
    found = matching.scored(matching.candidates(kinds, events(spark, d, "catalog")))
    return found.withColumn("score", matching.quick_rounded(F.col("score"), 6)), members


def quick(name, places):
    """rounded, for values of each pair."""
    return matching.quick_rounded(F.col(name), places)


def _sub_scores(got):
    return got.select("take_id", "beat_id", F.col("shift").cast("int").alias("shift"), quick("ratio", 6).alias("ratio"), quick("sub_harmonic", 3).alias("harmonic"), quick("sub_transform", 3).alias("transform"), quick("score", 3).alias("score"))


@query(_SCORED + " SELECT take_id, beat_id, round(round(rhythmic + 1e-9, 4) + 1e-9, 3) AS rhythmic, round(round(pocket + 1e-9, 4) + 1e-9, 3) AS pocket, round(metadata, 3) AS metadata, round(round(popularity + 1e-9, 4) + 1e-9, 3) AS popularity, round(collision, 3) AS collision, round(round(score + 1e-9, 6) + 1e-9, 3) AS score FROM scored")
def j02_score_pairs(spark, d):
    """The sub-scores of all scored pairs that don't depend on their keys and tempos."""
    got, members = scored_kinds(spark, d)
    got = got.select("take_id", "beat_id", *(quick(f"sub_{k}", 3).alias(k) for k in ("rhythmic", "pocket")), F.col("sub_metadata").alias("metadata"), quick("sub_popularity", 3).alias("popularity"), quick("penalty_collision", 3).alias("collision"), quick("score", 3).alias("score"))
    return matching.for_all_takes(got, members)


@query(_SCORED + " SELECT take_id, beat_id, shift, round(ratio + 1e-9, 6) AS ratio, round(round(harmonic + 1e-9, 4) + 1e-9, 3) AS harmonic, round(round(transform + 1e-9, 4) + 1e-9, 3) AS transform, round(round(score + 1e-9, 6) + 1e-9, 3) AS score FROM scored")
def j02_all_pairs(spark, d):
    """The sub-scores of all scored pairs."""
    got, members = scored_kinds(spark, d)
    return matching.for_all_takes(_sub_scores(got), members)


@query(_SCORED + " SELECT take_id, beat_id, rank, round(score + 1e-9, 4) AS score FROM ranked WHERE rank <= 5")
def k01_top_matches(spark, d):
    found, members = scored_kinds(spark, d)
    got = matching.top_of_many(found.select("take_id", "beat_id", "score"))
    return matching.of_takes(got.select("take_id", "beat_id", "rank", rounded("score", 4).alias("score")), members)


@query("WITH RECURSIVE " + _SCORED[len("WITH "):] + """,
g AS (
  SELECT DISTINCT take_id, 0 AS r, CAST([] AS VARCHAR[]) AS owners, CAST([] AS VARCHAR[]) AS kinds, CAST([] AS BIGINT[]) AS ranks FROM ranked
  UNION ALL
  SELECT g.take_id, g.r + 1, CASE WHEN ok THEN list_append(owners, owner) ELSE owners END, CASE WHEN ok THEN list_append(kinds, genre) ELSE kinds END, CASE WHEN ok THEN list_append(ranks, rank) ELSE ranks END
  FROM (SELECT g.*, s.owner, s.genre, s.rank, NOT list_contains(owners, s.owner) AND len([k for k in kinds if k = s.genre]) < 2 AS ok FROM g JOIN ranked s ON s.take_id = g.take_id AND s.rank = g.r + 1 WHERE len(ranks) < 5) g),
last AS (SELECT take_id, arg_max(ranks, r) AS ranks FROM g GROUP BY 1),
chosen AS (SELECT r.*, coalesce(list_position(ranks, r.rank), 1000 + r.rank) AS o FROM ranked r JOIN last USING (take_id)),
final AS (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY o) AS position FROM chosen)
SELECT take_id, beat_id, CAST(position AS INT) AS position, level, round(score + 1e-9, 4) AS score FROM final WHERE position <= 5""")
def j01_k02_match(spark, d):
    """Q3: all takes matched to the catalog, diversified."""
    # What is returned alone passes through the windows of all pairs.
    found, members = scored_kinds(spark, d)
    got = matching.diversified(found.select("take_id", "beat_id", "owner", "genre", "level", "score"))
    return matching.of_takes(got.select("take_id", "beat_id", "position", "level", rounded("score", 4).alias("score")), members)


@query(_SCORED + """
, s AS (SELECT take_id, max(score) AS best FROM scored GROUP BY 1) SELECT take_id FROM takes LEFT JOIN s USING (take_id) WHERE coalesce(round(best + 1e-9, 6), 0) < 0.8""")
def j30_unmatched(spark, d):
    """Takes without a match of 0.8 (the adapters' takes all have viable ones)."""
    found, members = scored_kinds(spark, d)
    best = found.groupBy("take_id").agg(F.max("score").alias("score"))
    return matching.unmatched(events(spark, d, "takes"), matching.of_takes(best, members), 0.8).select("take_id")


@query(_PAIRS + """
, x AS (SELECT genre, CAST((7 * CASE WHEN key_mode = 'minor' THEN (key_pc + 3) % 12 ELSE key_pc END + 7) % 12 + 1 AS VARCHAR) || CASE WHEN key_mode = 'minor' THEN 'A' ELSE 'B' END AS camelot, level FROM cand)
SELECT genre, camelot, level, count(*) AS n, grouping(genre, camelot, level) AS "grouping" FROM x GROUP BY CUBE (genre, camelot, level)""")
def a45_catalog_gaps(spark, d):
    return matching.catalog_gaps(matching.candidate_counts(events(spark, d, "takes"), events(spark, d, "catalog"))).select("genre", "camelot", "level", "n", "grouping")


@query(as_cte("catalog") + """
, n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT beat_id, CAST(beat_id % n AS BIGINT) AS a, CAST((beat_id * 7 + 1) % n AS BIGINT) AS b FROM catalog, n),
v AS (SELECT beat_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b FROM p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b)
SELECT beat_id, round((list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) + 1) / 2 + 1e-9, 5) AS vibe FROM v""")
def j04_vibe_similarity(spark, d):
    """Each beat's vector with that of another beat."""
    e = table(spark, d, "embeddings")
    n = e.count()
    p = events(spark, d, "catalog").select("beat_id", (F.col("beat_id") % n).alias("a"), ((F.col("beat_id") * 7 + 1) % n).alias("b"))
    both = p.join(e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    return both.select("beat_id", rounded(matching.vibe_similarity(F.col("x"), F.col("y")), 5).alias("vibe"))


@query(as_cte("notes", "chords") + """
, c AS (SELECT entity_id, root, CASE WHEN quality = 'maj' THEN 4 ELSE 3 END AS third, x.shift FROM chords, (VALUES (0), (2)) x(shift) WHERE bar < 64),
u AS (SELECT entity_id, shift, list_distinct(flatten(list([(root + shift) % 12, (root + third + shift) % 12, (root + 7 + shift) % 12]))) AS tones FROM c GROUP BY 1, 2),
h AS (SELECT take_id, CAST(round_even(midi, 0) AS INT) % 12 AS pc, duration_s FROM notes WHERE duration_s >= 0.22)
SELECT take_id, shift, round(sum(CASE WHEN list_contains(tones, pc) THEN 0 ELSE duration_s END) / sum(duration_s) + 1e-9, 6) AS dissonance FROM h JOIN u ON entity_id = take_id GROUP BY 1, 2""")
def j05_dissonance(spark, d):
    """Each take against the chords of the same number, as they are and two semitones up."""
    notes = events(spark, d, "notes")
    wanted = notes.filter(F.col("duration_s") >= 0.22).select("take_id").distinct().select("take_id", F.col("take_id").alias("entity_id"), F.explode(F.array(F.lit(0), F.lit(2))).alias("shift"))
    masks = matching.chord_masks(events(spark, d, "chords"))
    return matching.dissonance(notes, masks, wanted.join(masks.select("entity_id"), "entity_id", "left_semi")).select("take_id", "shift", rounded("dissonance", 6).alias("dissonance"))
