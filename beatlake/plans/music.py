"""Queries of the column functions: keys, theory, tempo, salience, energy, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatlake import constants as C
from beatlake.functions import keys, music, scalars, theory
from beatlake.plans.registry import query
from beatlake.sources.fixtures import as_cte, events, table

_NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
_FAM = "CASE WHEN key_mode = 'minor' THEN (key_pc + 3) % 12 ELSE key_pc END"
_TAG = f"""CASE beat_id % 6 WHEN 0 THEN replace(lower(list_extract({_NAMES}, key_pc + 1)), '#', '♯') || '_' || key_mode WHEN 1 THEN list_extract({_NAMES}, key_pc + 1) || ' ' || upper(key_mode)
  WHEN 2 THEN lower(list_extract({_NAMES}, key_pc + 1)) || CASE WHEN key_mode = 'minor' THEN 'm' ELSE 'maj' END WHEN 3 THEN ' ' || CAST((7 * ({_FAM}) + 7) % 12 + 1 AS VARCHAR) || CASE WHEN key_mode = 'minor' THEN 'a' ELSE 'B' END
  WHEN 4 THEN list_extract({_NAMES}, key_pc + 1) ELSE 'unknown ' || title END"""


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "catalog")


@query(as_cte("catalog") + f"""
SELECT beat_id, CASE WHEN beat_id % 6 = 5 THEN NULL ELSE key_pc END AS pc, CASE beat_id % 6 WHEN 5 THEN NULL WHEN 4 THEN 'major' ELSE key_mode END AS mode FROM catalog""")
def p01_normalise_keys(spark, d):
    """Tags in five spellings are made from known keys, and one that can't be read."""
    name = F.element_at(F.array(*map(F.lit, C.NOTE_NAMES)), F.col("key_pc") + 1)
    code = keys.camelot(F.col("key_pc"), F.col("key_mode"))
    styles = [
        F.concat(F.replace(F.lower(name), F.lit("#"), F.lit("♯")), F.lit("_"), F.col("key_mode")), F.concat(name, F.lit(" "), F.upper("key_mode")),
        F.concat(F.lower(name), F.when(F.col("key_mode") == "minor", "m").otherwise("maj")), F.concat(F.lit(" "), F.lower(code)), name, F.concat(F.lit("unknown "), "title"),
    ]
    tag = F.element_at(F.array(*styles), (F.col("beat_id") % 6 + 1).cast("int"))
    parsed, _ = keys.normalise_keys(_catalog(spark, d).withColumn("tag", tag), "tag")
    return parsed.select("beat_id", F.col("key.pc").alias("pc"), F.col("key.mode").alias("mode"))


@query(as_cte("catalog") + f"""
, c AS (SELECT *, CAST((7 * ({_FAM}) + 7) % 12 + 1 AS VARCHAR) || CASE WHEN key_mode = 'minor' THEN 'A' ELSE 'B' END AS code FROM catalog)
SELECT beat_id, code AS camelot, key_pc AS back_pc, key_mode AS back_mode, list_extract({_NAMES}, key_pc + 1) || ' ' || CASE WHEN key_mode = 'minor' THEN 'Minor' ELSE 'Major' END AS name FROM c""")
def p02_camelot(spark, d):
    code = keys.camelot(F.col("key_pc"), F.col("key_mode"))
    back = keys.key_from_camelot(code)
    return _catalog(spark, d).select("beat_id", code.alias("camelot"), back["pc"].alias("back_pc"), back["mode"].alias("back_mode"), keys.key_name(F.col("key_pc"), F.col("key_mode")).alias("name"))


@query(as_cte("catalog") + f"""
SELECT beat_id, (key_pc + 12 - 3) % 12 AS down, (key_pc + 5) % 12 AS up, {_FAM} AS family FROM catalog""")
def p03_p04_transpose_family(spark, d):
    pc, mode = F.col("key_pc"), F.col("key_mode")
    return _catalog(spark, d).select("beat_id", keys.transpose(pc, -3).alias("down"), keys.transpose(pc, 5).alias("up"), keys.family_root(pc, mode).alias("family"))


_SCALES = "CASE m " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in C.SCALES.items()) + " END"


@query(as_cte("catalog") + f"""
, m AS (SELECT beat_id, key_pc, list_extract({list(C.SCALES)}, CAST(beat_id % 12 + 1 AS INT)) AS m FROM catalog)
SELECT beat_id, m AS mode, array_to_string([(x + key_pc) % 12 for x in {_SCALES}], ',') AS pcs FROM m""")
def p05_scale_pcs(spark, d):
    mode = F.element_at(F.array(*map(F.lit, C.SCALES)), (F.col("beat_id") % 12 + 1).cast("int"))
    return _catalog(spark, d).select("beat_id", mode.alias("mode"), scalars.joined(keys.scale_pcs(F.col("key_pc"), mode)).alias("pcs"))


@query(as_cte("catalog") + """
, x AS (SELECT beat_id, abs((7 * key_pc) % 12 - (7 * ((beat_id * 5) % 12)) % 12) AS a FROM catalog)
SELECT beat_id, least(a, 12 - a) AS fifths FROM x""")
def p06_circle_distance(spark, d):
    return _catalog(spark, d).select("beat_id", keys.circle_distance(F.col("key_pc"), (F.col("beat_id") * 5) % 12).alias("fifths"))


_SHIFT_SQL = """
k AS (SELECT CAST(i % 12 AS INT) AS pc, CASE WHEN i < 12 THEN 'major' ELSE 'minor' END AS mode, CAST(CASE WHEN i < 12 THEN i ELSE (i + 3) % 12 END AS INT) AS fam FROM range(24) r(i)),
tries AS (SELECT m AS most, s FROM range(3) a(m), range(-2, 3) b(s) WHERE abs(s) <= m),
q AS (
  SELECT v.pc AS v_pc, v.mode AS v_mode, b.pc AS b_pc, b.mode AS b_mode, most, s,
    abs((7 * v.fam) % 12 - (7 * ((b.fam + s + 12) % 12)) % 12) AS a, v.mode = b.mode AS same FROM k v, k b, tries),
w AS (SELECT *, (1 - least(a, 12 - a) / CAST(6 AS DOUBLE)) + CASE WHEN same THEN 0.08::DOUBLE ELSE 0 END - 0.11::DOUBLE * abs(s) AS quality FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY v_pc, v_mode, b_pc, b_mode, most ORDER BY round(quality, 9) DESC, s) AS n FROM w),
shifts AS (SELECT v_pc, v_mode, b_pc, b_mode, CAST(most AS INT) AS most, CAST(s AS INT) AS shift, least(greatest(quality, 0.0::DOUBLE), 1.0::DOUBLE) AS quality FROM r WHERE n = 1)"""


@query(as_cte("catalog") + "," + _SHIFT_SQL + """
SELECT beat_id, most, shift, round(quality, 6) AS quality FROM catalog c JOIN shifts s ON s.b_pc = c.key_pc AND s.b_mode = c.key_mode AND v_pc = 4 AND v_mode = 'minor'""")
def p07_best_shift(spark, d):
    """Every beat against a take in E minor."""
    found = keys.shift_table(spark).filter("v_pc = 4 and v_mode = 'minor'")
    return _catalog(spark, d).join(F.broadcast(found), (F.col("b_pc") == F.col("key_pc")) & (F.col("b_mode") == F.col("key_mode"))).select("beat_id", "most", "shift", F.round("quality", 6).alias("quality"))


@query(as_cte("catalog") + f"""
, c AS (SELECT beat_id, key_pc, key_mode FROM catalog), s AS (SELECT c.*, x.s FROM c, (VALUES (-1), (0), (1)) x(s)),
n AS (SELECT beat_id, s, (7 * CASE WHEN key_mode = 'minor' THEN (key_pc + s + 15) % 12 ELSE (key_pc + s + 12) % 12 END + 7) % 12 + 1 AS num, CASE WHEN key_mode = 'minor' THEN 'A' ELSE 'B' END AS l FROM s),
e AS (SELECT beat_id, s, unnest([num || l, num || CASE l WHEN 'A' THEN 'B' ELSE 'A' END, (num % 12 + 1) || l, ((num + 10) % 12 + 1) || l]) AS code, unnest([1, 2, 3, 4]) AS p FROM n),
f AS (SELECT beat_id, code, min((s + 1) * 4 + p) AS o FROM e GROUP BY 1, 2)
SELECT beat_id, string_agg(code, ',' ORDER BY o) AS codes FROM f GROUP BY 1""")
def p08_compatible_set(spark, d):
    return _catalog(spark, d).select("beat_id", scalars.joined(keys.compatible_set(F.col("key_pc"), F.col("key_mode"), 1)).alias("codes"))


@query(as_cte("takes", "notes") + """
, n AS (SELECT notes.take_id, ((CAST(round_even(midi, 0) AS INT) - key_pc) % 12 + 12) % 12 AS s, key_mode FROM notes JOIN takes USING (take_id))
SELECT take_id, round(avg(CASE WHEN list_contains(CASE WHEN key_mode = 'major' THEN [0,2,4,5,7,9,11] ELSE [0,2,3,5,7,8,10] END, s) THEN 1.0 ELSE 0.0 END), 6) AS in_key FROM n GROUP BY 1""")
def p09_notes_in_key(spark, d):
    both = events(spark, d, "notes").join(events(spark, d, "takes").select("take_id", "key_pc", "key_mode"), "take_id")
    hit = F.array_contains(keys.scale_pcs(F.col("key_pc"), F.col("key_mode")), scalars.pitch_class(F.col("midi")))
    return both.groupBy("take_id").agg(F.round(F.avg(hit.cast("double")), 6).alias("in_key"))


# Chords with the key of the take of the same number.
_CK = as_cte("chords", "takes") + """
, ck AS (SELECT entity_id, bar, root, quality, key_pc, key_mode, CASE WHEN key_mode = 'major' THEN [0,2,4,5,7,9,11] ELSE [0,2,3,5,7,8,10] END AS steps FROM chords JOIN takes ON entity_id = take_id),
cd AS (SELECT *, [(x + key_pc) % 12 for x in steps] AS pcs, (root - key_pc + 12) % 12 AS rel FROM ck),
deg AS (SELECT *, list_position(pcs, root) - 1 AS degree FROM cd)"""


def _chords_in_key(spark, d):
    return events(spark, d, "chords").join(events(spark, d, "takes").select(F.col("take_id").alias("entity_id"), "key_pc", "key_mode"), "entity_id")


@query(_CK + " SELECT entity_id, bar, degree FROM deg")
def p10_degree_of(spark, d):
    return _chords_in_key(spark, d).select("entity_id", "bar", theory.degree_of(F.col("root"), F.col("key_pc"), F.col("key_mode")).alias("degree"))


@query(_CK + """
, near AS (SELECT *, list_sort([struct_pack(a := abs(s - rel), i := list_position(steps, s) - 1) for s in steps])[1].i AS n FROM deg),
num AS (SELECT *, CASE WHEN degree IS NULL THEN 'b' ELSE '' END || list_extract(['I','II','III','IV','V','VI','VII'], CAST(coalesce(degree, n) + 1 AS INT)) AS x FROM near)
SELECT entity_id, bar, CASE WHEN quality IN ('min', 'dim') THEN lower(x) ELSE x END || CASE quality WHEN 'dim' THEN 'o' ELSE '' END AS numeral FROM num""")
def p11_roman_numeral(spark, d):
    return _chords_in_key(spark, d).select("entity_id", "bar", theory.roman_numeral(F.col("root"), F.col("quality"), F.col("key_pc"), F.col("key_mode")).alias("numeral"))


_FUNCTION = """CASE WHEN degree IS NULL THEN CASE WHEN quality = 'maj' AND list_contains(pcs, (root + 5) % 12) THEN 'applied' ELSE 'chromatic' END
  WHEN key_mode = 'minor' AND degree = 4 AND quality = 'maj' THEN 'D' WHEN key_mode = 'major' THEN list_extract(['T','S','T','S','D','T','D'], CAST(degree + 1 AS INT)) ELSE list_extract(['T','S','T','S','D','S','D'], CAST(degree + 1 AS INT)) END"""


@query(_CK + f" SELECT entity_id, bar, {_FUNCTION} AS function FROM deg")
def p12_harmonic_function(spark, d):
    return _chords_in_key(spark, d).select("entity_id", "bar", theory.harmonic_function(F.col("root"), F.col("quality"), F.col("key_pc"), F.col("key_mode")).alias("function"))


_SETS = _CK + """
, q AS (SELECT *, CASE quality WHEN 'maj' THEN [0,4,7] WHEN 'min' THEN [0,3,7] ELSE [0,3,6] END AS t, CASE quality WHEN 'maj' THEN [2,9,11] WHEN 'min' THEN [2,5,9,10] ELSE [9] END AS n FROM deg),
z AS (SELECT *, [(x + root) % 12 for x in t] AS tones, [(x + root) % 12 for x in n] AS wide FROM q),
y AS (SELECT *, list_sort([x for x in wide if list_contains(pcs, x) AND NOT list_contains(tones, x)]) AS tens, list_sort([(x + 1) % 12 for x in tones if NOT list_contains(tones, (x + 1) % 12)]) AS avoid, [(x + key_pc) % 12 for x in [3, 6, 10]] AS blue FROM z)"""


@query(_SETS + " SELECT entity_id, bar, array_to_string(tones, ',') AS tones, array_to_string(tens, ',') AS tensions, array_to_string(avoid, ',') AS avoid, array_to_string(blue, ',') AS blue FROM y")
def p13_p15_chord_sets(spark, d):
    """Chord tones, tensions, notes to avoid and blue notes."""
    root, quality, pc, mode = map(F.col, ("root", "quality", "key_pc", "key_mode"))
    sets = {"tones": theory.chord_tones(root, quality), "tensions": theory.tensions(root, quality, pc, mode), "avoid": theory.avoid_notes(root, quality), "blue": theory.blue_notes(pc)}
    return _chords_in_key(spark, d).select("entity_id", "bar", *(scalars.joined(v).alias(k) for k, v in sets.items()))


_GENRE = "CASE WHEN entity_id % 3 = 0 THEN 'Hip Hop' WHEN entity_id % 3 = 1 THEN 'pop' END"


def _genre():
    return F.when(F.col("entity_id") % 3 == 0, "Hip Hop").when(F.col("entity_id") % 3 == 1, "pop")


@query(_SETS + f"""
, g AS (SELECT *, coalesce({_GENRE}, '') = 'Hip Hop' AS blues, CAST((bar * 5 + root) % 12 AS INT) AS pc FROM y)
SELECT entity_id, bar, CAST(CASE WHEN list_contains(tones, pc) THEN 1.0 WHEN list_contains(avoid, pc) THEN CASE WHEN blues AND list_contains(blue, pc) THEN 0.6 ELSE 0.05 END
  WHEN list_contains(tens, pc) THEN 0.85 WHEN blues AND list_contains(blue, pc) THEN 0.7 WHEN list_contains(pcs, pc) THEN 0.6 ELSE 0.2 END AS DOUBLE) AS consonance FROM g""")
def p16_consonance(spark, d):
    pc = ((F.col("bar") * 5 + F.col("root")) % 12).cast("int")
    return _chords_in_key(spark, d).select("entity_id", "bar", theory.consonance(pc, *map(F.col, ("root", "quality", "key_pc", "key_mode")), _genre()).alias("consonance"))


@query(_SETS + f"""
, g AS (SELECT *, coalesce({_GENRE}, '') = 'Hip Hop' AS blues, bar % 2 = 0 AS exposed FROM y),
h AS (SELECT *, list_concat(list_concat(tones, CASE WHEN exposed THEN tens ELSE pcs END), CASE WHEN blues THEN blue ELSE [] END) AS every FROM g)
SELECT entity_id, bar, array_to_string(list_sort(list_distinct([x for x in every if NOT list_contains(avoid, x) OR (blues AND list_contains(blue, x))])), ',') AS candidates FROM h""")
def p17_tuning_candidates(spark, d):
    found = theory.tuning_candidates(*map(F.col, ("root", "quality", "key_pc", "key_mode")), _genre(), F.col("bar") % 2 == 0)
    return _chords_in_key(spark, d).select("entity_id", "bar", scalars.joined(found).alias("candidates"))


@query(as_cte("notes") + """
, b AS (SELECT *, CAST(round_even(midi, 0) AS INT) AS base FROM notes),
c AS (SELECT *, [x for x in range(base - 3, base + 4) if list_contains([0, 4, 7], x % 12)] AS near FROM b),
e AS (SELECT *, list_sort([struct_pack(a := abs(midi - x), x := x) for x in near])[1] AS best FROM c)
SELECT take_id, order_key, idx, CAST(CASE WHEN best.a <= 1.2 THEN best.x END AS DOUBLE) AS target FROM e""")
def p18_nearest_target(spark, d):
    target = theory.nearest_target(F.col("midi"), F.array(F.lit(0), F.lit(4), F.lit(7)), 1.2)
    return events(spark, d, "notes").select("take_id", "order_key", "idx", target.alias("target"))


@query(as_cte("catalog") + """
, o AS (SELECT beat_id, bpm, 97.0 AS v FROM catalog),
e AS (SELECT beat_id, bpm, unnest([struct_pack(err := abs(bpm / v - 1), rank := 0, ratio := bpm / v, name := 'direct'), struct_pack(err := abs(bpm * 2 / v - 1), rank := 1, ratio := bpm * 2 / v, name := 'halftime'),
  struct_pack(err := abs(bpm * 0.5 / v - 1), rank := 2, ratio := bpm * 0.5 / v, name := 'doubletime')]) AS x FROM o),
r AS (SELECT beat_id, x, row_number() OVER (PARTITION BY beat_id ORDER BY x.err > 0.25, CASE WHEN x.err > 0.25 THEN x.rank ELSE x.err END, x.rank) AS n FROM e)
SELECT beat_id, round(x.ratio, 6) AS ratio, x.name AS reading FROM r WHERE n = 1""")
def p20_tempo_options(spark, d):
    """The best reading of every beat for a take at 97 BPM in a window of 0.1."""
    best = F.element_at(music.tempo_options(F.lit(97.0), F.col("bpm"), F.lit(0.1)), 1)
    return _catalog(spark, d).select("beat_id", F.round(best["ratio"], 6).alias("ratio"), best["reading"].alias("reading"))


@query(as_cte("catalog") + """
SELECT beat_id, array_to_string([CAST(round(x * 10) AS INT) for x in [bpm * 0.5, bpm * 2, bpm * (CAST(2 AS DOUBLE) / 3), bpm * 1.5] if x >= 35 AND x <= 273], ',') AS alternates FROM catalog""")
def p21_tempo_alternates(spark, d):
    return _catalog(spark, d).select("beat_id", scalars.joined(F.transform(music.tempo_alternates(F.col("bpm")), lambda x: F.round(x * 10).cast("int"))).alias("alternates"))


@query(as_cte("catalog") + """
, x AS (SELECT beat_id, bpm AS a, CAST(70 + beat_id % 23 AS DOUBLE) AS b FROM catalog), y AS (SELECT *, log2(a / b) AS o FROM x)
SELECT beat_id, abs(o - round_even(o, 0)) <= 0.05 AND abs(round_even(o, 0)) <= 2 AS related,
  abs(a * 0.5 - b) <= greatest(2.0, b * 0.04) OR abs(a - b) <= greatest(2.0, b * 0.04) OR abs(a * 2 - b) <= greatest(2.0, b * 0.04) AS agrees,
  abs(a * 0.5 - b) <= 0.5 OR abs(a - b) <= 0.5 OR abs(a * 2 - b) <= 0.5 AS matches FROM y""")
def p22_tempo_relations(spark, d):
    a, b = F.col("bpm"), (F.lit(70) + F.col("beat_id") % 23).cast("double")
    return _catalog(spark, d).select("beat_id", music.octave_related(a, b).alias("related"), music.tempo_agrees(a, b).alias("agrees"), music.tempo_matches(a, b).alias("matches"))


@query(as_cte("catalog") + """
, x AS (SELECT beat_id, [CASE WHEN beat_id % 5 = 0 THEN 0.0 ELSE 71.0 END, CAST(60 + beat_id % 7 AS DOUBLE), bpm / 2] AS c, bpm FROM catalog)
SELECT beat_id, CAST(coalesce([y for y in c if y > 0 AND (abs(y * 0.5 - bpm) <= 0.5 OR abs(y - bpm) <= 0.5 OR abs(y * 2 - bpm) <= 0.5)][1], [y for y in c if y > 0][1]) AS DOUBLE) AS tempo FROM x""")
def p23_vocal_tempo(spark, d):
    found = F.array(F.when(F.col("beat_id") % 5 == 0, 0.0).otherwise(71.0), (60 + F.col("beat_id") % 7).cast("double"), F.col("bpm") / 2)
    return _catalog(spark, d).select("beat_id", music.vocal_tempo(found, F.col("bpm")).alias("tempo"))


@query(as_cte("catalog") + """
, x AS (SELECT beat_id, bpm, key_confidence AS c, CASE WHEN beat_id % 4 = 0 THEN NULL ELSE CAST(62 + (beat_id * 37) % 118 AS DOUBLE) END AS tag FROM catalog)
SELECT beat_id, CASE WHEN abs(bpm - tag) <= 0.04 * tag THEN 'verified' WHEN tag IS NULL OR c >= 0.55 THEN 'detected' ELSE 'tag' END AS source,
  CASE WHEN abs(bpm - tag) <= 0.04 * tag THEN tag WHEN tag IS NULL OR c >= 0.55 THEN bpm ELSE tag END AS bpm FROM x""")
def p24_reconcile_tags(spark, d):
    tag = F.when(F.col("beat_id") % 4 != 0, (62 + (F.col("beat_id") * 37) % 118).cast("double"))
    found = keys.reconcile_bpm(F.col("bpm"), F.col("key_confidence"), tag)
    return _catalog(spark, d).select("beat_id", found["source"].alias("source"), found["bpm"].alias("bpm"))


_PROFILE_ROWS = ", ".join("('" + k + "', " + ", ".join(str(x) for x in v) + ")" for k, v in C.GENRE_PROFILES.items())


@query(as_cte("catalog") + f"""
, p(genre, {', '.join(C.PROFILE_FIELDS)}) AS (VALUES {_PROFILE_ROWS}), c AS (SELECT beat_id, CASE WHEN beat_id % 9 = 0 THEN 'polka' ELSE genre END AS g FROM catalog)
SELECT beat_id, CAST(coalesce(a.lufs_target, b.lufs_target) AS DOUBLE) AS lufs_target, CAST(coalesce(a.tune_strength, b.tune_strength) AS DOUBLE) AS tune_strength, coalesce(a.stereo_double, b.stereo_double) AS stereo_double
FROM c LEFT JOIN p a ON a.genre = g CROSS JOIN (SELECT * FROM p WHERE genre = 'default') b""")
def p27_genre_profile(spark, d):
    from beatlake.operators.planning import genre_profiles

    got = genre_profiles(_catalog(spark, d).withColumn("genre", F.when(F.col("beat_id") % 9 == 0, "polka").otherwise(F.col("genre"))))
    return got.select("beat_id", "profile.lufs_target", "profile.tune_strength", "profile.stereo_double")


_OVERRIDES = ", ".join(f"('{v}', '{k}', {x})" for v, o in C.VARIANTS.items() for k, x in o.items())


@query(as_cte("catalog") + f"""
, o(variant, k, x) AS (VALUES {_OVERRIDES}), v(variant) AS (VALUES {', '.join(f"('{x}')" for x in C.VARIANTS)}), s AS (SELECT variant, count(k) AS n, CAST(coalesce(sum(x), 0) AS DOUBLE) AS total FROM v LEFT JOIN o USING (variant) GROUP BY 1)
SELECT beat_id, variant, n, round(total, 6) AS total FROM catalog, s""")
def p28_expand_variants(spark, d):
    from beatlake.operators.planning import expand_variants

    sum_of = F.aggregate(F.map_values("overrides"), F.lit(0.0), lambda a, b: a + b)
    return expand_variants(_catalog(spark, d)).select("beat_id", "variant", F.size("overrides").cast("long").alias("n"), F.round(sum_of, 6).alias("total"))


_POSITION = "(beat_id * 37 % 997) / CAST(997 AS DOUBLE)"


def _position():
    return (F.col("beat_id") * 37 % 997) / F.lit(997.0)


@query(as_cte("catalog") + f"""
, x AS (SELECT beat_id, {_POSITION} * 16 AS slot FROM catalog), y AS (SELECT *, CAST(round_even(slot, 0) AS INT) % 16 AS near, abs(slot - round_even(slot, 0)) AS off FROM x)
SELECT beat_id, round(CASE WHEN near = 0 THEN 2.0 WHEN near % 4 = 0 THEN 1.4 WHEN near % 2 = 0 THEN 0.9 ELSE 0.6 END * (1 - 0.4 * least(off * 2, 1.0)) + 1e-9, 6) AS weight FROM y""")
def p31_metrical_weight(spark, d):
    return _catalog(spark, d).select("beat_id", scalars.rounded(music.metrical_weight(_position()), 6).alias("weight"))


_LABEL = "list_extract(['hook','verse','bridge','intro','outro','prehook','solo','other'], CAST(beat_id % 8 + 1 AS INT))"
_WEIGHT = "CASE " + _LABEL + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SECTION_WEIGHT.items()) + " ELSE 1.0 END"


def _label():
    return F.element_at(F.array(*map(F.lit, ("hook", "verse", "bridge", "intro", "outro", "prehook", "solo", "other"))), (F.col("beat_id") % 8 + 1).cast("int"))


@query(as_cte("catalog") + f"""
SELECT beat_id, round(least(greatest((0.6 + beat_id % 15 / CAST(10 AS DOUBLE)) * CASE WHEN beat_id % 3 = 0 THEN 1.6 WHEN beat_id % 3 = 1 THEN 1.15 ELSE 1 END * CASE WHEN beat_id % 5 = 0 THEN 1.35 ELSE 1 END * (0.85 + 0.45 * pocket_score) * {_WEIGHT}, 0.25), 3.5) + 1e-9, 4) AS timing,
  round(least(greatest(CASE WHEN grid_stability < 0.12 THEN 0.35 WHEN grid_stability < 0.25 THEN 0.7 ELSE 1 + 0.6 * least(grid_stability - 0.25, 1) END * CASE WHEN bpm >= 118 THEN 1.25 ELSE 1 END * CASE WHEN beat_id % 40 > 25 THEN 0.8 ELSE 1 END
    * CASE WHEN beat_id % 7 = 0 THEN 0.6 ELSE 1 END * CASE WHEN beat_id % 5 = 0 THEN 1.4 ELSE 1 END * CASE WHEN is_atonal THEN 1.3 ELSE 1 END * (0.9 + 0.3 * pocket_score) * {_WEIGHT}, 0.2), 3.5) + 1e-9, 4) AS pitch,
  round(CASE WHEN beat_id % 2 = 0 THEN 0.15 ELSE least(greatest((1 + least(greatest((pocket_score - 0.5) * 2, 0), 1)) * ({_WEIGHT} * 0.5 + 0.5), 0.2), 2.5) END + 1e-9, 4) AS deess,
  round(least(greatest(CASE WHEN grid_stability > 0.85 THEN 0.7 ELSE 1 END * (0.9 + 0.2 * pocket_score) * ({_WEIGHT} * 0.4 + 0.6), 0.3), 2.0) + 1e-9, 4) AS level FROM catalog""")
def p32_p34_salience(spark, d):
    """P32-P34 over synthetic places of every beat."""
    n, x, y = F.col("beat_id"), F.col("pocket_score"), F.col("grid_stability")
    timing = music.timing_salience(0.6 + n % 15 / F.lit(10.0), n % 3 == 0, n % 3 == 1, n % 5 == 0, x, _label())
    pitch = music.pitch_salience(y, F.col("bpm"), F.lit(120.0), n % 40, n % 7 == 0, n % 5 == 0, F.col("is_atonal"), x, _label())
    made = {"timing": timing, "pitch": pitch, "deess": music.deess_salience(n % 2 == 1, x, _label()), "level": music.level_salience(y, x, _label())}
    return _catalog(spark, d).select("beat_id", *(scalars.rounded(v, 4).alias(k) for k, v in made.items()))


_QUANT = "CASE genre " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.QUANTISE.items()) + " ELSE 0.35 END"


@query(as_cte("catalog") + f"""
SELECT beat_id, round(least(greatest({_QUANT} * CASE beat_id % 5 WHEN 0 THEN 1.25 WHEN 1 THEN 1.1 WHEN 2 THEN 0 WHEN 3 THEN 0.75 ELSE 1 END * grid_stability, 0), 0.85), 6) AS strength,
  round(CAST(least(greatest(0.12 * (100 + beat_id % 200), 12), 30) AS DOUBLE), 6) AS threshold_ms, CASE WHEN abs(0.4 + beat_id % 20 / CAST(100 AS DOUBLE) - 0.5) > 0.055 THEN 12 ELSE 16 END AS subdivision FROM catalog""")
def p35_p38_groove_strength(spark, d):
    n = F.col("beat_id")
    performance = F.element_at(F.array(*map(F.lit, ("rap", "melodic_rap", "spoken", "sung", "other"))), (n % 5 + 1).cast("int"))
    return _catalog(spark, d).select(
        "beat_id", F.round(music.quantise_strength(F.col("genre"), performance, F.col("grid_stability")), 6).alias("strength"), F.round(music.perceptible_ms(100 + n % 200), 6).alias("threshold_ms"), music.choose_subdivision(0.4 + n % 20 / F.lit(100.0)).alias("subdivision")
    )


@query(as_cte("catalog") + """
, x AS (SELECT beat_id, genre IN ('rnb', 'lofi') AS mellow, beat_id % 2 = 0 AS rap, (pocket_score - 0.6) / 0.4 AS d FROM catalog)
SELECT beat_id, round((least(greatest(d * 1.2, -2), 1.2) + CASE WHEN rap THEN 0.3 ELSE 0 END) * CASE WHEN mellow THEN 0.7 ELSE 1 END, 6) AS vir_db, round(least(greatest(d * 0.035, -0.04), 0.045) * CASE WHEN rap THEN 0.55 ELSE 1 END, 6) AS reverb_wet,
  round(least(greatest(d * 0.18, -0.15), 0.22) * CASE WHEN mellow THEN 0.6 ELSE 1 END, 6) AS saturation, round(least(greatest(d * 2.5, -6), 2.5), 6) AS double_gain_db FROM x""")
def p40_mix_targets(spark, d):
    made = music.mix_targets(F.col("pocket_score"), F.when(F.col("beat_id") % 2 == 0, "rap").otherwise("sung"), F.col("genre"))
    return _catalog(spark, d).select("beat_id", *(F.round(made[k], 6).alias(k) for k in ("vir_db", "reverb_wet", "saturation", "double_gain_db")))


@query(as_cte("catalog") + f"""
, x AS (SELECT beat_id, pocket_score AS e, {_LABEL} AS label, grid_stability AS j FROM catalog)
SELECT beat_id, 1 + {' + '.join(f'CASE WHEN e > {v} THEN 1 ELSE 0 END' for v in C.LAYERS.values())} AS layers, array_to_string(list_concat(list_concat(CASE WHEN j >= 0.12 THEN ['reverse_vocal_tail'] ELSE [] END, CASE WHEN j >= 0.2 THEN ['riser', 'drum_fill'] ELSE [] END),
  list_concat(CASE WHEN j >= 0.3 THEN ['impact'] ELSE [] END, CASE WHEN j >= 0.3 AND label IN ('hook', 'chorus') THEN ['beat_dropout_1bar'] ELSE [] END)), ',') AS effects FROM x""")
def p41_p42_density_and_transitions(spark, d):
    layers = F.size(F.filter(F.map_values(music.arrangement_density(F.col("pocket_score"))), lambda x: x))
    return _catalog(spark, d).select("beat_id", layers.alias("layers"), F.array_join(music.transition_before(_label(), F.col("grid_stability")), ",").alias("effects"))


@query(as_cte("catalog") + """
, x AS (SELECT beat_id, CAST(beat_id % 13 - 6 AS INT) AS n, beat_id % 2 = 0 AS s FROM catalog)
SELECT beat_id, CASE WHEN n = 0 THEN 'none' WHEN s AND abs(n) <= 2 THEN 'stems' WHEN abs(n) <= 2 THEN 'vocal' WHEN s AND abs(n) <= 4 THEN 'split' ELSE 'refuse' END AS method FROM x""")
def p43_pitch_shift_plan(spark, d):
    return _catalog(spark, d).select("beat_id", music.plan_pitch_shift((F.col("beat_id") % 13 - 6).cast("int"), F.col("beat_id") % 2 == 0)["method"].alias("method"))


@query(as_cte("level_frames") + """
, x AS (SELECT event_id, rms_db, 0.3 * rms_db AS peak FROM level_frames), g AS (SELECT event_id, rms_db, least(greatest(least(-20 - rms_db, -1 - peak), -60), 60) AS gain FROM x)
SELECT event_id, round(CASE WHEN abs(gain) < 3 THEN 0 ELSE gain END, 6) AS gain_db, round(power(10, rms_db / 20), 6) AS linear FROM g""")
def p53_f01_stage_gain(spark, d):
    """P53, F1."""
    return events(spark, d, "level_frames").select("event_id", F.round(music.stage_gain(F.col("rms_db"), 0.3 * F.col("rms_db")), 6).alias("gain_db"), F.round(scalars.db_to_lin(F.col("rms_db")), 6).alias("linear"))


@query(as_cte("notes") + """
SELECT take_id, order_key, idx, ((CAST(round_even(midi, 0) AS INT)) % 12) AS pc, round((midi - round_even(midi, 0)) * 100, 4) AS cents, round(440 * power(2, (midi - 69) / 12), 4) AS hz, round(69 + 12 * log2((440 * power(2, (midi - 69) / 12)) / 440), 6) AS back FROM notes""")
def f02_f03_pitch(spark, d):
    midi = F.col("midi")
    return events(spark, d, "notes").select("take_id", "order_key", "idx", scalars.pitch_class(midi).alias("pc"), F.round(scalars.cents_off(midi), 4).alias("cents"), F.round(scalars.midi_to_hz(midi), 4).alias("hz"), F.round(scalars.hz_to_midi(scalars.midi_to_hz(midi)), 6).alias("back"))


@query(as_cte("lines") + """
, l AS (SELECT entity_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS idx FROM lines)
SELECT entity_id, idx, len([x for x in string_split_regex(regexp_replace(lower(line), '[^\\p{L}\\p{N}_\\s'']+', ' ', 'g'), '\\s+') if x <> '']) AS n,
  array_to_string([x for x in string_split_regex(regexp_replace(lower(line), '[^\\p{L}\\p{N}_\\s'']+', ' ', 'g'), '\\s+') if x <> ''], ' ') AS words FROM l""")
def f05_normalise_text(spark, d):
    lines = events(spark, d, "lines").select("entity_id", F.posexplode("lines").alias("idx", "line"))
    words = scalars.normalised_tokens(F.col("line"))
    return lines.select("entity_id", "idx", F.size(words).cast("long").alias("n"), F.array_join(words, " ").alias("words"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'hi' WHEN doc_id % 4 = 1 AND lang <> 'en' THEN lang WHEN doc_id % 4 = 2 THEN lang ELSE 'en' END AS language,
  CASE WHEN doc_id % 4 = 0 THEN 'declared' WHEN doc_id % 4 = 1 AND lang <> 'en' THEN 'detected' WHEN doc_id % 4 = 2 THEN 'declared' ELSE 'default' END AS source,
  CASE WHEN doc_id % 4 = 0 THEN 'small' ELSE 'base' END AS model FROM documents""")
def f08_f10_language(spark, d):
    """Declared tags of four kinds (ur-PK, auto, the language, none)."""
    n = F.col("doc_id") % 4
    declared = scalars.normalise_language(F.when(n == 0, "UR-pk").when(n == 1, "auto").when(n == 2, F.concat(F.upper("lang"), F.lit("-x"))))
    found = scalars.resolve_language(declared, F.when((n == 1) & (F.col("lang") != "en"), F.col("lang")), F.when(n == 1, 0.9).otherwise(0.1))
    return table(spark, d, "documents").select("doc_id", found["language"].alias("language"), found["source"].alias("source"), scalars.model_for(found["language"]).alias("model"))


@query("""
WITH e AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_dot_product(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a AS DOUBLE[]), CAST(a AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b AS DOUBLE[]), CAST(b AS DOUBLE[])))), 6) AS cosine
FROM e WHERE b IS NOT NULL""")
def f15_cosine(spark, d):
    """Each vector with the one of the next id (ids are consecutive)."""
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(scalars.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query(as_cte("chords", "takes") + """
, k AS (SELECT entity_id, bar, [(x + root) % 12 for x in [0,2,4,5,7,9,11]] AS a, [(x + key_pc) % 12 for x in CASE WHEN key_mode = 'major' THEN [0,2,4,5,7,9,11] ELSE [0,2,3,5,7,8,10] END] AS b FROM chords JOIN takes ON entity_id = take_id)
SELECT entity_id, bar, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS scale, len(list_intersect(a, b)) AS common FROM k""")
def u03_shared_scale(spark, d):
    """The union of two scales, sorted."""
    a, b = keys.scale_pcs(F.col("root"), F.lit("major")), keys.scale_pcs(F.col("key_pc"), F.col("key_mode"))
    return _chords_in_key(spark, d).select("entity_id", "bar", scalars.joined(F.array_sort(F.array_union(a, b))).alias("scale"), F.size(F.array_intersect(a, b)).cast("long").alias("common"))
