"""Keys as pitch class (0-11) and mode (major or minor)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatlake.constants import NOTE_NAMES, SCALES
from beatlake.functions.scalars import mapped

# Note names as they are spelt in tags.
NOTE_SPELLINGS = {
    "c": 0, "b#": 0, "c#": 1, "db": 1, "d": 2, "d#": 3, "eb": 3, "e": 4, "fb": 4, "e#": 5, "f": 5, "f#": 6, "gb": 6, "g": 7, "g#": 8, "ab": 8, "a": 9, "a#": 10, "bb": 10, "b": 11, "cb": 11,
}


def transpose(pc: Column, n) -> Column:
    """P3."""
    return F.pmod(pc + n, F.lit(12)).cast("int")


def family_root(pc: Column, mode: Column) -> Column:
    """The relative major of a minor key."""
    return F.when(mode == "minor", transpose(pc, 3)).otherwise(F.pmod(pc, F.lit(12)))


def camelot(pc: Column, mode: Column) -> Column:
    """Fifths from the wheel's first code; A is minor."""
    return F.concat((F.pmod(7 * family_root(pc, mode) + 7, F.lit(12)) + 1).cast("string"), F.when(mode == "minor", "A").otherwise("B"))


def key_from_camelot(code: Column) -> Column:
    """Struct of pc and mode, or null."""
    number, letter = F.regexp_extract(code, r"^(1[0-2]|[1-9])[AB]$", 1), F.right(code, F.lit(1))
    major = F.pmod((number.cast("int") - 8) * 7, F.lit(12))
    return F.when(number != "", F.struct(F.when(letter == "A", F.pmod(major + 9, F.lit(12))).otherwise(major).cast("int").alias("pc"), F.when(letter == "A", "minor").otherwise("major").alias("mode")))


def key_name(pc: Column, mode: Column) -> Column:
    """P55."""
    return F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), (pc + 1).cast("int")), F.lit(" "), F.initcap(mode))


def parse_key(tag: Column) -> Column:
    """A key from eb_minor, F# Minor, ebm, Camelot 2A, with sharp and flat signs; a bare note is major; else null."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), "♯", "#"), "♭", "b")
    code = key_from_camelot(F.upper(F.replace(x, F.lit(" "), F.lit(""))))
    plain = F.trim(F.regexp_replace(x, r"[-_/\s]+", " "))
    apart, together = r"^([a-g][#b]?) (\S+)( .*)?$", r"^([a-g][#b]?)(m|min\S*|minor|maj\S*|major)?$"
    note = F.when(plain.rlike(apart), F.regexp_extract(plain, apart, 1)).when(plain.rlike(together), F.regexp_extract(plain, together, 1))
    word = F.when(plain.rlike(apart), F.regexp_extract(plain, apart, 2)).otherwise(F.regexp_extract(plain, together, 2))
    mode = F.when((word == "m") | word.startswith("min"), "minor").otherwise("major")
    pc = mapped(NOTE_SPELLINGS)[note]
    return F.coalesce(code, F.when(pc.isNotNull(), F.struct(pc.cast("int").alias("pc"), mode.alias("mode"))))


def normalise_keys(catalog: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The catalog with a parsed `key`, and the rows whose tag isn't empty but can't be read."""
    parsed = catalog.withColumn("key", parse_key(F.col(column)))
    return parsed, parsed.filter(F.col("key").isNull() & (F.trim(F.coalesce(F.col(column), F.lit(""))) != "")).drop("key")


def scale_pcs(pc: Column, mode: Column) -> Column:
    """P5: pitch classes of a scale (unknown ones read as major)."""
    steps = F.create_map(*(x for name, values in SCALES.items() for x in (F.lit(name), F.array(*map(F.lit, values)))))
    return F.transform(F.coalesce(steps[mode], F.array(*map(F.lit, SCALES["major"]))), lambda s: F.pmod(s + pc, F.lit(12)).cast("int"))


def circle_distance(a: Column, b: Column) -> Column:
    """Steps on the circle of fifths."""
    apart = F.abs(F.pmod(7 * a, F.lit(12)) - F.pmod(7 * b, F.lit(12)))
    return F.least(apart, 12 - apart)


def shift_table(spark: SparkSession) -> DataFrame:
    """v_pc, v_mode, b_pc, b_mode, most -> shift, quality for all pairs of keys: 1,728 rows, made by rule."""
    keys = spark.range(24).select((F.col("id") % 12).cast("int").alias("pc"), F.when(F.col("id") < 12, "major").otherwise("minor").alias("mode"))
    v, b = keys.selectExpr("pc v_pc", "mode v_mode"), keys.selectExpr("pc b_pc", "mode b_mode")
    tries = spark.range(3).select(F.col("id").cast("int").alias("most")).withColumn("s", F.explode(F.sequence(-F.col("most"), F.col("most"))))
    pairs = v.crossJoin(b).crossJoin(tries)
    apart = circle_distance(family_root(F.col("v_pc"), F.col("v_mode")), family_root(transpose(F.col("b_pc"), F.col("s")), F.col("b_mode")))
    quality = (1 - apart / F.lit(6.0)) + F.when(F.col("v_mode") == F.col("b_mode"), 0.08).otherwise(0.0) - 0.11 * F.abs("s")
    best = pairs.withColumn("q", quality).groupBy("v_pc", "v_mode", "b_pc", "b_mode", "most").agg(F.max(F.struct("q", (-F.col("s")).alias("n"))).alias("m"))
    return best.select("v_pc", "v_mode", "b_pc", "b_mode", "most", (-F.col("m.n")).alias("shift"), F.least(F.greatest(F.col("m.q"), F.lit(0.0)), F.lit(1.0)).alias("quality"))


def camelot_neighbours(code: Column) -> Column:
    """The code itself, its relative, and one step either way."""
    number, letter = F.regexp_extract(code, r"^\d+", 0).cast("int"), F.right(code, F.lit(1))
    one = lambda n, x: F.concat(n.cast("string"), x)
    return F.array(code, one(number, F.when(letter == "A", "B").otherwise("A")), one(F.pmod(number, F.lit(12)) + 1, letter), one(F.pmod(number - 2, F.lit(12)) + 1, letter))


def compatible_set(pc: Column, mode: Column, most: int) -> Column:
    """Codes within so many semitones, in order of first sight."""
    return F.array_distinct(F.flatten(F.array(*(camelot_neighbours(camelot(transpose(pc, s), mode)) for s in range(-most, most + 1)))))


def reconcile_bpm(detected: Column, confidence: Column, tag: Column) -> Column:
    """A tag within 4 % is verified; else the detected tempo if sure enough or untagged; else the tag."""
    near = tag.isNotNull() & (detected > 0) & (F.abs(detected - tag) <= 0.04 * tag)
    return F.when(near, F.struct(tag.alias("bpm"), F.lit("verified").alias("source"))).when(tag.isNull() | (confidence >= 0.55), F.struct(detected.alias("bpm"), F.lit("detected").alias("source"))).otherwise(F.struct(tag.alias("bpm"), F.lit("tag").alias("source")))
