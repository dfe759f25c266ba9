"""Chords and scales as columns. A chord is its root and quality, a key its pitch class and mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatlake.constants import BLUE_DEGREES, BLUES_FAMILY, CHORDS, MAJOR_FUNCTIONS, MAJOR_TRIADS, MINOR_FUNCTIONS, MINOR_TRIADS, ROMAN, TENSIONS
from beatlake.functions.keys import scale_pcs


def _steps(table: dict, quality: Column, default: tuple) -> Column:
    made = F.create_map(*(x for name, values in table.items() for x in (F.lit(name), F.array(*map(F.lit, values)))))
    return F.coalesce(made[quality], F.array(*map(F.lit, default)))


def _above(root: Column, steps: Column) -> Column:
    return F.transform(steps, lambda s: F.pmod(s + root, F.lit(12)).cast("int"))


def _of(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at)


def degree_of(pc: Column, key_pc: Column, mode: Column) -> Column:
    """P10: 0-6, or null off the scale."""
    at = F.array_position(scale_pcs(key_pc, mode), F.pmod(pc, F.lit(12)).cast("int"))
    return F.when(at > 0, (at - 1).cast("int"))


def diatonic_triad(key_pc: Column, mode: Column, degree: Column) -> Column:
    """P10."""
    at = (F.pmod(degree, F.lit(7)) + 1).cast("int")
    return F.struct(F.element_at(scale_pcs(key_pc, mode), at).alias("root"), F.when(mode == "major", _of(MAJOR_TRIADS, at)).otherwise(_of(MINOR_TRIADS, at)).alias("quality"))


def roman_numeral(root: Column, quality: Column, key_pc: Column, mode: Column) -> Column:
    """Flats name roots off the scale by the nearest degree (the lower one of equals)."""
    semis = F.pmod(root - key_pc, F.lit(12))
    nearest = F.array_min(F.transform(scale_pcs(key_pc, mode), lambda p, i: F.struct(F.abs(F.pmod(p - key_pc, F.lit(12)) - semis).alias("apart"), i.alias("at"))))["at"]
    degree = degree_of(root, key_pc, mode)
    numeral = F.concat(F.when(degree.isNull(), "b").otherwise(""), _of(ROMAN, (F.coalesce(degree, nearest) + 1).cast("int")))
    low = F.when(quality.isin("min", "dim"), F.lower(numeral)).otherwise(numeral)
    return F.concat(low, F.when(quality == "dim", "o").when(quality == "aug", "+").when(quality.isin("sus2", "sus4"), quality).otherwise(""))


def harmonic_function(root: Column, quality: Column, key_pc: Column, mode: Column) -> Column:
    """P12."""
    degree = degree_of(root, key_pc, mode)
    at = (degree + 1).cast("int")
    applied = (quality == "maj") & degree_of(root + 5, key_pc, mode).isNotNull()
    return F.when(degree.isNull(), F.when(applied, "applied").otherwise("chromatic")).when((mode == "minor") & (degree == 4) & (quality == "maj"), "D").when(mode == "major", _of(MAJOR_FUNCTIONS, at)).otherwise(_of(MINOR_FUNCTIONS, at))


def chord_tones(root: Column, quality: Column) -> Column:
    """Unknown qualities read as major."""
    return _above(root, _steps(CHORDS, quality, CHORDS["maj"]))


def tensions(root: Column, quality: Column, key_pc: Column | None = None, mode: Column | None = None) -> Column:
    """Within the key, if one is given."""
    found = _above(root, _steps(TENSIONS, quality, (2, 9)))
    found = found if key_pc is None else F.array_intersect(found, scale_pcs(key_pc, mode))
    return F.array_sort(F.array_except(found, chord_tones(root, quality)))


def avoid_notes(root: Column, quality: Column) -> Column:
    """A semitone above a chord tone and no chord tone."""
    tones = chord_tones(root, quality)
    return F.array_sort(F.array_except(F.transform(tones, lambda t: F.pmod(t + 1, F.lit(12)).cast("int")), tones))


def blue_notes(key_pc: Column) -> Column:
    """P15."""
    return _above(key_pc, F.array(*map(F.lit, BLUE_DEGREES)))


def sings_blues(genre: Column) -> Column:
    """Whether a genre belongs to the blues family."""
    return F.coalesce(F.replace(F.lower(genre), F.lit(" "), F.lit("_")).isin(*BLUES_FAMILY), F.lit(False))


def consonance(pc: Column, root: Column, quality: Column, key_pc: Column, mode: Column, genre: Column) -> Column:
    """P16."""
    p = F.pmod(pc, F.lit(12)).cast("int")
    blue = sings_blues(genre) & F.array_contains(blue_notes(key_pc), p)
    return (
        F.when(F.array_contains(chord_tones(root, quality), p), 1.0)
        .when(F.array_contains(avoid_notes(root, quality), p), F.when(blue, 0.6).otherwise(0.05))
        .when(F.array_contains(tensions(root, quality, key_pc, mode), p), 0.85)
        .when(blue, 0.7)
        .when(degree_of(p, key_pc, mode).isNotNull(), 0.6)
        .otherwise(0.2)
    )


def tuning_candidates(root: Column, quality: Column, key_pc: Column, mode: Column, genre: Column, exposed: Column) -> Column:
    """Pitch classes that a note may be moved to; a null root is no chord."""
    none = F.array().cast("array<int>")
    chord = root.isNotNull()
    blue = F.when(sings_blues(genre), blue_notes(key_pc)).otherwise(none)
    tones = F.when(chord, chord_tones(root, quality)).otherwise(none)
    colour = F.when(chord & exposed, tensions(root, quality, key_pc, mode)).otherwise(none)
    scale = F.when(~exposed | ~chord, scale_pcs(key_pc, mode)).otherwise(none)
    bad = F.when(chord, F.array_except(avoid_notes(root, quality), blue)).otherwise(none)
    found = F.array_except(F.array_union(F.array_union(tones, colour), F.array_union(scale, blue)), bad)
    return F.array_sort(F.when(F.size(found) > 0, found).otherwise(F.sequence(F.lit(0), F.lit(11))))


def nearest_target(midi: Column, candidates: Column, most: float = 1.5) -> Column:
    """The nearest allowed integer pitch, the lower one of equals; null beyond the limit."""
    base = F.bround(midi).cast("int")
    near = F.filter(F.sequence(base - 3, base + 3), lambda c: F.array_contains(candidates, F.pmod(c, F.lit(12)).cast("int")))
    best = F.array_min(F.transform(near, lambda c: F.struct(F.abs(midi - c).alias("apart"), c.alias("to"))))
    return F.when(best["apart"] <= most, best["to"].cast("double"))
