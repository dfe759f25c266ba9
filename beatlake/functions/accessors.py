"""What is read off keys, chords, grooves, sections and matches, and what is said of them in a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatlake.constants import NOTE_NAMES
from beatlake.functions.keys import key_name
from beatlake.functions.scalars import rounded


def known_bpm(bpm: Column) -> Column:
    """Whether a tempo is known: 0 and null aren't."""
    return F.coalesce(bpm > 0, F.lit(False))


def key_slug(pc: Column, mode: Column) -> Column:
    """A key as its documents spell it: d#_minor."""
    return F.concat(F.lower(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), (pc + 1).cast("int"))), F.lit("_"), mode)


def tonic_triad(pc: Column, mode: Column) -> Column:
    """Pitch classes of a key's first chord, from the tonic."""
    return F.transform(F.array(F.lit(0), F.when(mode == "major", 4).otherwise(3), F.lit(7)), lambda step: F.pmod(pc + step, F.lit(12)).cast("int"))


def chord_third(root: Column, quality: Column) -> Column:
    """A chord's third; null for those that have none."""
    step = F.when(quality.isin("maj", "aug"), 4).when(quality.isin("min", "dim"), 3)
    return F.pmod(root + step, F.lit(12)).cast("int")


def section_bars(start_bar: Column, end_bar: Column) -> Column:
    return F.greatest(F.lit(0), end_bar - start_bar)


def straight_groove(subdivision: int = 16) -> Column:
    """The groove of an even grid: nothing late, all equally loud."""
    zeros, ones = F.array_repeat(F.lit(0.0), subdivision), F.array_repeat(F.lit(1.0), subdivision)
    return F.struct(F.lit(subdivision).alias("subdivision"), zeros.alias("offsets_ms"), ones.alias("accents"), F.lit(0.5).alias("swing"), F.lit(1.0).alias("consistency"))


def at_slot(values: Column, slot: Column, default: float) -> Column:
    """A groove's offset (default 0) or accent (default 1) at a slot; slots go on round its end."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.pmod(slot, n).cast("int"))).otherwise(default)


def widest_offset(offsets: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(offsets, F.abs)), F.lit(0.0))


def confidence_of(confidences: Column, stage: str) -> Column:
    """A stage's entry of a map of confidences; 0 where it has none."""
    return F.coalesce(F.try_element_at(confidences, F.lit(stage)), F.lit(0.0))


def signed(x: Column) -> Column:
    return F.concat(F.when(x > 0, "+").otherwise(""), x.cast("string"))


def transform_text(shift: Column, ratio: Column, reading: Column) -> Column:
    """what a beat has to undergo for a take."""
    percent = (ratio - 1) * 100
    said = F.concat_ws(
        ", ", F.when(shift != 0, F.concat(signed(shift.cast("int")), F.when(F.abs(shift) == 1, " semitone").otherwise(" semitones"))),
        F.when(F.abs(percent) > 0.5, F.concat(F.lit("tempo "), signed(rounded(percent, 1)), F.lit("%"))), F.when(reading != "direct", F.concat(F.lit("read as "), reading)),
    )
    return F.when(said == "", "plays as it is").otherwise(said)


def take_text(pc: Column, mode: Column, bpm: Column, performance: Column, genres: Column, stated: Column) -> Column:
    """a take in a line: key, tempo, delivery, and what suits it."""
    key = F.coalesce(key_name(pc, mode), F.lit("key unknown"))
    tempo = F.when(known_bpm(bpm), F.concat(rounded(bpm, 0).cast("int").cast("string"), F.lit(" bpm"), F.when(stated, " as stated").otherwise(""))).otherwise("tempo unknown")
    head = F.concat_ws(", ", key, tempo, F.replace(performance, F.lit("_"), F.lit(" ")))
    return F.concat(head, F.lit("; suits "), F.array_join(F.slice(genres, 1, 3), ", "))


def beat_text(title: Column, atonal: Column, pc: Column, mode: Column, bpm: Column, swing: Column, n_chords: Column, n_sections: Column) -> Column:
    """a beat in a line; parts that aren't known are left out."""
    key = F.when(atonal, "no key").otherwise(key_name(pc, mode))
    tempo = F.when(known_bpm(bpm), F.concat(rounded(bpm, 0).cast("int").cast("string"), F.lit(" bpm"))).otherwise("tempo unknown")
    count = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))
    return F.concat_ws("; ", title, key, tempo, F.concat(F.lit("swing "), rounded(swing, 2).cast("string")), count(n_chords, " chords"), count(n_sections, " sections"))
