"""Tempo, salience, groove strength, energy and mix columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatlake.constants import LAYERS, MIX_TARGETS, QUANTISE, QUANTISE_BY_PERFORMANCE, QUANTISE_DEFAULT, SECTION_WEIGHT
from beatlake.functions.scalars import clip, mapped, product


def genre_slug(genre: Column) -> Column:
    return F.replace(F.lower(F.coalesce(genre, F.lit(""))), F.lit(" "), F.lit("_"))


def tempo_options(v: Column, b: Column, window: Column) -> Column:
    """P20: (err, rank, ratio, reading) of the readings within 2.5 windows, nearest first; none: the direct one."""
    reading = lambda mult, rank, name: F.struct(F.abs(b * mult / v - 1).alias("err"), F.lit(rank).alias("rank"), (b * mult / v).alias("ratio"), F.lit(name).alias("reading"))
    every = F.array(reading(1.0, 0, "direct"), reading(2.0, 1, "halftime"), reading(0.5, 2, "doubletime"))
    near = F.array_sort(F.filter(every, lambda x: x["err"] <= window * 2.5))
    unknown = F.array(F.struct(F.lit(0.0).alias("err"), F.lit(0).alias("rank"), F.lit(1.0).alias("ratio"), F.lit("unknown").alias("reading")))
    return F.when((v > 0) & (b > 0), F.when(F.size(near) > 0, near).otherwise(F.slice(every, 1, 1))).otherwise(unknown)


def tempo_alternates(bpm: Column) -> Column:
    """Half, double, two thirds and three halves within 0.7 x 50 to 1.3 x 210."""
    return F.filter(F.array(bpm * 0.5, bpm * 2.0, bpm * F.lit(2.0 / 3.0), bpm * 1.5), lambda x: (x >= 35.0) & (x <= 273.0))


def octave_related(a: Column, b: Column) -> Column:
    """A ratio within 0.05 octaves of a whole number of octaves, two at most."""
    octaves = F.log2(a / b)
    return F.coalesce((a > 0) & (b > 0) & (F.abs(octaves - F.bround(octaves)) <= 0.05) & (F.abs(F.bround(octaves)) <= 2), F.lit(False))


def tempo_agrees(a: Column, b: Column) -> Column:
    """Within the larger of 2 BPM and 4 % at half, single or double time."""
    near = lambda m: F.abs(a * m - b) <= F.greatest(F.lit(2.0), b * 0.04)
    return F.coalesce((a > 0) & (b > 0) & (near(0.5) | near(1.0) | near(2.0)), F.lit(False))


def tempo_matches(a: Column, b: Column) -> Column:
    """Within half a BPM at half, single or double time."""
    near = lambda m: F.abs(a * m - b) <= 0.5
    return F.coalesce((a > 0) & (b > 0) & (near(0.5) | near(1.0) | near(2.0)), F.lit(False))


def vocal_tempo(candidates: Column, beat_bpm: Column) -> Column:
    """The first candidate that matches the beat, else the first positive one."""
    return F.coalesce(F.get(F.filter(candidates, lambda x: tempo_matches(x, beat_bpm)), F.lit(0)), F.get(F.filter(candidates, lambda x: x > 0), F.lit(0)))


def voice_type(f0: Column) -> Column:
    """By median fundamental in Hz."""
    return F.when(f0 < 110, "bass").when(f0 < 165, "baritone").when(f0 < 220, "tenor").when(f0 < 330, "alto").otherwise("soprano")


def metrical_weight(position: Column, subdivision: int = 16, beats: int = 4) -> Column:
    """Weight of a place in the bar (0 to 1)."""
    slot = F.pmod(position, F.lit(1.0)) * subdivision
    nearest = F.pmod(F.bround(slot).cast("int"), F.lit(subdivision))
    per_beat = max(1, subdivision // max(beats, 1))
    level = F.when(nearest == 0, 2.0).when(nearest % per_beat == 0, 1.4).when(nearest % max(per_beat // 2, 1) == 0, 0.9).otherwise(0.6)
    return level * (1 - 0.4 * F.least(F.abs(slot - F.bround(slot)) * 2, F.lit(1.0)))


def section_weight(label: Column) -> Column:
    return F.coalesce(mapped(SECTION_WEIGHT)[label], F.lit(1.0))


def timing_salience(metrical: Column, at_anchor: Column, at_end: Column, cadence: Column, stress: Column, label: Column) -> Column:
    """P32."""
    near = F.when(at_anchor, 1.6).when(at_end, 1.15).otherwise(1.0)
    return clip(product(metrical, near, F.when(cadence, 1.35).otherwise(1.0), 0.85 + 0.45 * clip(stress, 0.0, 1.0), section_weight(label)), 0.25, 3.5)


def pitch_salience(duration: Column, midi: Column, high: Column, vibrato: Column, melisma: Column, cadence: Column, exposed: Column, velocity: Column, label: Column) -> Column:
    """P33."""
    base = F.when(duration < 0.12, 0.35).when(duration < 0.25, 0.7).otherwise(1.0 + 0.6 * clip(duration - 0.25, 0.0, 1.0))
    when = lambda condition, factor: F.when(condition, factor).otherwise(1.0)
    return clip(
        product(base, when((high > 0) & (midi >= high - 2), 1.25), when(vibrato > 25, 0.8), when(melisma, 0.6), when(cadence, 1.4), when(exposed, 1.3), 0.9 + 0.3 * clip(velocity, 0.0, 1.0), section_weight(label)), 0.2, 3.5
    )


def deess_salience(sibilant: Column, brightness: Column, label: Column) -> Column:
    """P34."""
    return F.when(~sibilant, 0.15).otherwise(clip((1 + clip((brightness - 0.5) * 2, 0.0, 1.0)) * (section_weight(label) * 0.5 + 0.5), 0.2, 2.5))


def level_salience(position: Column, stress: Column, label: Column) -> Column:
    """Position in the phrase, 0 to 1."""
    return clip(F.when(position > 0.85, 0.7).otherwise(1.0) * (0.9 + 0.2 * clip(stress, 0.0, 1.0)) * (section_weight(label) * 0.4 + 0.6), 0.3, 2.0)


def perceptible_ms(slot_ms: Column) -> Column:
    """P35."""
    return clip(0.12 * slot_ms, 12.0, 30.0)


def quantise_strength(genre: Column, performance: Column, consistency: Column) -> Column:
    """P36."""
    base = F.coalesce(mapped(QUANTISE)[genre_slug(genre)], F.lit(QUANTISE_DEFAULT))
    return clip(base * F.coalesce(mapped(QUANTISE_BY_PERFORMANCE)[performance], F.lit(1.0)) * clip(consistency, 0.0, 1.0), 0.0, 0.85)


def slot_weights(subdivision: int = 16, beats: int = 4, velocities: Column | None = None) -> Column:
    """P37."""
    per_beat = max(1, subdivision // max(beats, 1))
    plain = F.array(*(F.lit(1.0 if s == 0 else 0.75 if s % per_beat == 0 else 0.5 if s % max(per_beat // 2, 1) == 0 else 0.25) for s in range(subdivision)))
    return plain if velocities is None else F.when(F.size(velocities) == subdivision, F.zip_with(plain, velocities, lambda w, v: w * (0.6 + 0.4 * v))).otherwise(plain)


def choose_subdivision(swing: Column, compound: Column | None = None) -> Column:
    """12 for compound metres and clear swing, else 16."""
    swung = F.abs(swing - 0.5) > 0.055
    return F.when(swung if compound is None else swung | compound, 12).otherwise(16)


def backbeat_offset(offsets: Column, subdivision: int = 16) -> Column:
    """Mean of the slots of beats two and four."""
    return (F.element_at(offsets, subdivision // 4 + 1) + F.element_at(offsets, 3 * subdivision // 4 + 1)) / 2


def groove_scaled(offsets: Column, amount: float) -> Column:
    """P39."""
    return F.transform(offsets, lambda x: x * amount)


def mix_targets(energy: Column, performance: Column, genre: Column) -> Column:
    """Offsets by parameter."""
    d = (clip(energy, 0.0, 1.0) - 0.6) / 0.4
    x = {name: clip(d * slope, lo, hi) for name, (slope, lo, hi) in MIX_TARGETS.items()}
    rap, mellow = performance.isin("rap", "melodic_rap"), genre_slug(genre).isin("rnb", "soul", "lofi", "jazz")
    x["reverb_wet"] *= F.when(rap, 0.55).otherwise(1.0)
    x["delay_wet"] *= F.when(rap, 0.8).otherwise(1.0)
    x["vir_db"] = (x["vir_db"] + F.when(rap, 0.3).otherwise(0.0)) * F.when(mellow, 0.7).otherwise(1.0)
    x["saturation"] *= F.when(mellow, 0.6).otherwise(1.0)
    return F.struct(*(v.alias(k) for k, v in x.items()))


def arrangement_density(energy: Column) -> Column:
    """Which layers play."""
    e = clip(energy, 0.0, 1.0)
    return F.create_map(F.lit("lead_vocal"), F.lit(True), *(x for name, least in LAYERS.items() for x in (F.lit(name), e > least)))


def transition_before(label: Column, jump: Column) -> Column:
    """Effects that a rise in energy calls for."""
    every = F.array(F.when(jump >= 0.12, "reverse_vocal_tail"), F.when(jump >= 0.2, "riser"), F.when(jump >= 0.2, "drum_fill"), F.when(jump >= 0.3, "impact"), F.when((jump >= 0.3) & label.isin("chorus", "hook"), "beat_dropout_1bar"))
    return F.filter(every, lambda x: x.isNotNull())


def plan_pitch_shift(n: Column, has_stems: Column) -> Column:
    """What is moved: stems up to 2, the vocal up to 2, both up to 4, else nothing."""
    size = F.abs(n)
    made = lambda method, stems, vocal: F.struct(F.lit(method).alias("method"), stems.alias("stems"), vocal.alias("vocal"))
    none, half = F.lit(0), F.signum(n).cast("int") * F.ceil(size / 2).cast("int")
    return F.when(n == 0, made("none", none, none)).when(has_stems & (size <= 2), made("stems", n, none)).when(size <= 2, made("vocal", none, -n)).when(has_stems & (size <= 4), made("split", half, half - n)).otherwise(made("refuse", none, none))


def quality_warnings(clipping: Column, snr: Column, bandwidth: Column, rt60: Column, dc: Column) -> Column:
    """P50: of measured columns; an unknown measure warns of nothing."""
    every = F.array(F.when(clipping > 0.5, "clipping"), F.when(snr < 12, "noise"), F.when(bandwidth < 13_000, "bandwidth"), F.when(rt60 > 0.55, "reverb"), F.when(F.abs(dc) > 0.01, "dc_offset"))
    return F.filter(every, lambda x: x.isNotNull())


def stage_gain(level: Column, peak: Column) -> Column:
    """Gain towards -20 dB that keeps the peak under -1 dB; none inside 3 dB."""
    gain = clip(F.least(-20 - level, -1 - peak), -60.0, 60.0)
    return F.when(F.abs(gain) < 3, 0.0).otherwise(gain)


def constant_tempo(bpm: Column, duration: Column) -> Column:
    """A curve of two points."""
    return F.array(F.struct(F.lit(0.0).alias("time_s"), bpm.alias("bpm")), F.struct(F.greatest(duration, F.lit(0.0)).alias("time_s"), bpm.alias("bpm")))


def loop_points(sections: Column) -> Column:
    """Bar ranges of verses and choruses, of an array of sections with label, start_bar and end_bar."""
    long = F.filter(sections, lambda s: s["label"].isin("verse", "chorus") & (s["end_bar"] > s["start_bar"]))
    return F.transform(long, lambda s: F.array(s["start_bar"], s["end_bar"]))


def is_mastered(lufs: Column, loudness_range: Column) -> Column:
    """Loud and narrow enough to be left as it is; an unknown or infinite loudness isn't."""
    return F.coalesce((F.abs(lufs) < float("inf")) & (lufs > -11.0) & (loudness_range < 6.0), F.lit(False))


def crest_db(peak_db: Column, rms_db: Column) -> Column:
    """Peak over level; 0 where one isn't finite."""
    finite = (F.abs(peak_db) < float("inf")) & (F.abs(rms_db) < float("inf"))
    return F.when(finite, peak_db - rms_db).otherwise(0.0)


def is_dry(rt60_s: Column) -> Column:
    """P52."""
    return rt60_s < 0.25


def is_usable_space(rt60_s: Column) -> Column:
    """Whether a room can be taken out again."""
    return rt60_s < 0.6


def resolved_key(stated: Column, detected: Column, confidence: Column) -> Column:
    """A stated key wins with a confidence of .95; keys are structs of pc and mode."""
    said = F.struct(stated["pc"].alias("pc"), stated["mode"].alias("mode"), F.lit(0.95).alias("confidence"), F.lit("user").alias("source"))
    heard = F.struct(detected["pc"].alias("pc"), detected["mode"].alias("mode"), confidence.alias("confidence"), F.lit("detected").alias("source"))
    return F.when(stated["pc"].isNotNull(), said).otherwise(heard)


def reconciled_tempo(h_bpm: Column, h_conf: Column, a_bpm: Column, a_strength: Column, n_onsets: Column) -> Column:
    """The histogram's tempo (A6) and the autocorrelation's (A7) as one: bpm, confidence, agreement and alternates. Octave
    agreement raises the confidence, disagreement halves it and puts the other reading first among the alternates; one reading
    alone is worth .45 at most; fewer than six onsets give none."""
    h, a = F.coalesce(h_bpm, F.lit(0.0)), F.coalesce(a_bpm, F.lit(0.0))
    none = F.array().cast("array<double>")
    made = lambda bpm, conf, how, other: F.struct(F.round(bpm, 2).alias("bpm"), F.round(conf, 3).alias("confidence"), F.lit(how).alias("agreement") if isinstance(how, str) else how.alias("agreement"), other.alias("alternates"))
    short = lambda x: F.transform(x, lambda t: F.round(t, 2))
    single = made(F.when(h > 0, h).otherwise(a), F.when(h > 0, F.least(h_conf, F.lit(0.45))).otherwise(F.least(a_strength * 0.6, F.lit(0.45))), "single", short(tempo_alternates(F.when(h > 0, h).otherwise(a))))
    agree = made(h, clip(F.greatest(h_conf, F.lit(0.3)) + 0.25 * a_strength + 0.15, 0.0, 0.9), F.when(F.abs(h - a) / h < 0.05, "exact").otherwise("octave"), short(tempo_alternates(h)))
    others = F.concat(F.array(F.round(a, 2)), short(F.filter(tempo_alternates(h), lambda x: ~octave_related(x, a))))
    apart = made(h, clip(h_conf * 0.5, 0.0, 0.35), "disagree", others)
    nothing = made(F.lit(0.0), F.lit(0.0), "none", none)
    return F.when((n_onsets < 6) | ((h <= 0) & (a <= 0)), nothing).when((h <= 0) | (a <= 0), single).when(octave_related(h, a), agree).otherwise(apart)


def words_of(lines: Column, least: float = 0.4) -> Column:
    """the words of lines (arrays of structs with text, start, end, probability) that are sure enough, in time order."""
    every = F.filter(F.flatten(F.transform(lines, lambda ln: ln["words"])), lambda w: (w["probability"] >= least) & (w["text"] != ""))
    timed = F.array_sort(F.transform(every, lambda w, k: F.struct(w["start"].alias("start"), k.alias("k"), w["text"].alias("text"), w["end"].alias("end"), w["probability"].alias("probability"))))
    return F.transform(timed, lambda w: F.struct(w["text"].alias("text"), w["start"].alias("start"), w["end"].alias("end"), w["probability"].alias("probability")))


def word_onsets(lines: Column, usable: Column | None = None, least: float = 0.4) -> Column:
    """their start times; none where the timing can't be used."""
    found = F.transform(words_of(lines, least), lambda w: w["start"])
    return found if usable is None else F.when(usable, found).otherwise(F.array().cast("array<double>"))


def line_starts(lines: Column, usable: Column | None = None, least: float = 0.4) -> Column:
    """the start of each line's first sure word, in order."""
    first = F.transform(lines, lambda ln: F.get(F.filter(ln["words"], lambda w: (w["probability"] >= least) & (F.trim(w["text"]) != "")), F.lit(0))["start"])
    found = F.array_sort(F.filter(first, lambda t: t.isNotNull()))
    return found if usable is None else F.when(usable, found).otherwise(F.array().cast("array<double>"))


# The sentences that tell what was done to a take, by what they need.
NOTES = {
    "bleed": "the beat was playing in the room when this was recorded and came through the microphone; it was cancelled out of the vocal by %.0f dB",
    "hum": "a hum at %s Hz was notched out of the vocal",
    "separated": "the voice was separated from the background noise under it",
    "denoised": "background noise was reduced under the vocal",
    "dereverb": "room reverb was reduced on the vocal",
    "gated": "the gaps between lines were muted",
    "gain": "the take was %s by %.0f dB to a working level",
    "span": "the vocal was %s",
    "stretch": "the vocal was %s by %.2f%% to sit on the beat's tempo",
    "moved": "the vocal was moved %+.2f s so its first bar lands where the beat's %s arrives (%.1f s)",
    "looped": "the beat (%.0f s) was shorter than the take; its %.0f-%.0f s section was looped to cover %.0f s",
    "trimmed": "the beat was trimmed on a bar line from %.0f s to %.0f s to fit the take",
    "padded": "the beat was padded with silence from %.0f s to %.0f s for the vocal's tail",
    "tuned": "the vocal was tuned: %s",
    "untuned": "the pitch was left exactly as sung: %s",
    "stated": "treated as %s, as you said",
}


def render_notes(plan: dict[str, Column]) -> Column:
    """What a plan changes, as an array of sentences in a fixed order. plan names columns; those that it lacks say nothing.

    bleed_db, hum_hz (array), separated, denoised, dereverb, gated, gain_db, span_note, ratio, moved_s with section and entry_s,
    fit (looped, trimmed_to_bar, padded) with beat_s, loop_from_s, loop_to_s, result_s and target_s, n_tuned with tuned_how,
    untuned_why, stated_type. A null column says nothing.
    """
    col = lambda name: plan.get(name, F.lit(None))
    number = lambda name: F.coalesce(col(name).cast("double"), F.lit(0.0))
    yes = lambda name: col(name).cast("boolean")
    tell = lambda name, *x: F.format_string(NOTES[name], *x)
    ratio, gain, fit = F.coalesce(col("ratio").cast("double"), F.lit(1.0)), number("gain_db"), col("fit").cast("string")
    hum = F.transform(col("hum_hz").cast("array<double>"), lambda x: F.format_string("%.0f", x))
    rows = [
        F.when(col("bleed_db").isNotNull(), tell("bleed", number("bleed_db"))),
        F.when(F.size(hum) > 0, tell("hum", F.array_join(hum, ", "))),
        F.when(yes("separated"), F.lit(NOTES["separated"])).when(yes("denoised"), F.lit(NOTES["denoised"])),
        *(F.when(yes(name), F.lit(NOTES[name])) for name in ("dereverb", "gated")),
        F.when(gain != 0, tell("gain", F.when(gain > 0, "raised").otherwise("lowered"), F.abs(gain))),
        F.when(col("span_note").cast("string") != "", tell("span", col("span_note").cast("string"))),
        F.when(F.abs(ratio - 1) >= 0.0005, tell("stretch", F.when(ratio > 1, "slowed").otherwise("sped up"), F.abs(ratio - 1) * 100)),
        F.when(col("section").cast("string") != "", tell("moved", number("moved_s"), col("section").cast("string"), number("entry_s"))),
        F.when((fit == "looped") & col("loop_from_s").isNotNull(), tell("looped", *map(number, ("beat_s", "loop_from_s", "loop_to_s", "result_s"))))
        .when(fit == "trimmed_to_bar", tell("trimmed", number("beat_s"), number("result_s")))
        .when(fit == "padded", tell("padded", number("beat_s"), number("target_s"))),
        F.when(number("n_tuned") > 0, tell("tuned", F.coalesce(col("tuned_how").cast("string"), F.lit("")))).when(col("untuned_why").cast("string") != "", tell("untuned", col("untuned_why").cast("string"))),
        F.when(col("stated_type").isNotNull(), tell("stated", F.translate(col("stated_type").cast("string"), "_", " "))),
    ]
    return F.array_compact(F.array(*rows))
