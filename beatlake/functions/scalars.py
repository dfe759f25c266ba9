"""Scalar helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mapped(values: dict) -> Column:
    """A map literal."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def clip(x: Column, lo: float, hi: float) -> Column:
    """F14."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def rounded(x: Column | str, places: int) -> Column:
    """Rounding that binary noise just below a tie doesn't change."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, places)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a x b + c, rounded once: the rounding errors of the product (Dekker) and of the sum (Knuth) are added last."""
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    p, a1, b1 = a * b, high(a), high(b)
    a2, b2 = a - a1, b - b1
    lost = a2 * b2 - (((p - a1 * b1) - a2 * b1) - a1 * b2)
    s = p + c
    back = s - p
    return s + (((p - (s - back)) + (c - back)) + lost)


def interpolated(lo: Column, hi: Column, share: Column) -> Column:
    """A quantile between its two neighbours, to the last bit as the checking database has it; F.percentile rounds both products, so
    that a level just at a threshold may fall on the other side."""
    return fused(lo, 1 - share, hi * share)


def db_to_lin(db: Column) -> Column:
    """F1."""
    return F.pow(F.lit(10.0), db / 20)


def lin_to_db(x: Column) -> Column:
    """with a floor at 1e-10."""
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)))


def hz_to_midi(hz: Column) -> Column:
    """F2."""
    return 69 + 12 * F.log2(hz / 440)


def midi_to_hz(midi: Column) -> Column:
    """F2."""
    return 440 * F.pow(F.lit(2.0), (midi - 69) / 12)


def cents_between(a: Column, b: Column) -> Column:
    """from frequency b up to a."""
    return 1200 * F.log2(a / b)


def pitch_class(midi: Column) -> Column:
    """rounds halves to even."""
    return F.pmod(F.bround(midi).cast("int"), F.lit(12))


def cents_off(midi: Column) -> Column:
    """cents from the nearest semitone."""
    return (midi - F.bround(midi)) * 100


def range_score(x: Column, lo: Column, hi: Column, tolerance: Column) -> Column:
    """1 inside, falling to 0 over the tolerance."""
    apart = F.when(x < lo, lo - x).otherwise(x - hi)
    return F.when((x >= lo) & (x <= hi), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / F.greatest(tolerance, F.lit(1e-9))))


def normalised_tokens(text: Column, keep_marks: bool = False) -> Column:
    """lower case words of letters, digits, underscores and apostrophes; combining marks split words unless kept."""
    other = r"[^\p{L}\p{N}_\s'" + (r"\p{M}" if keep_marks else "") + "]+"
    return F.filter(F.split(F.regexp_replace(F.lower(text), other, " "), r"\s+"), lambda x: x != "")


def shift_times(t: Column, scale: float | Column = 1.0, offset: float | Column = 0.0) -> Column:
    """an affine map to 3 decimals; non-finite times are null."""
    return F.round(finite_or_null(t) * scale + offset, 3)


def normalise_language(tag: Column) -> Column:
    """F8: the part before a dash, lower case; Urdu reads as Hindi; auto and empty are unknown."""
    base = F.lower(F.trim(F.split(tag, "-")[0]))
    return F.when(base.isin("", "auto"), None).when(base == "ur", "hi").otherwise(base)


def resolve_language(declared: Column, detected: Column, chance: Column) -> Column:
    """declared, else detected at 0.7 or more, else English; with its source."""
    return F.when(declared.isNotNull(), F.struct(declared.alias("language"), F.lit("declared").alias("source"))).when(
        detected.isNotNull() & (chance >= 0.7), F.struct(detected.alias("language"), F.lit("detected").alias("source"))
    ).otherwise(F.struct(F.lit("en").alias("language"), F.lit("default").alias("source")))


def model_for(language: Column) -> Column:
    """F10."""
    return F.when(language.isin("hi", "pa"), "small").otherwise("base")


def finite_or_null(x: Column) -> Column:
    """F13."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """null where a length differs or a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def spans_of(phonemes: Column, kind: str) -> Column:
    """F16: phonemes of a kind."""
    return F.filter(phonemes, lambda p: p["kind"] == kind)


def joined(items: Column) -> Column:
    """An array as text, for reports."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


def product(*columns: Column) -> Column:
    return reduce(lambda a, b: a * b, columns)
