"""Gates and scores of renders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatlake import constants as C
from beatlake.functions.scalars import clip, rounded

#: Gates of which a failure is repaired by these overrides.
REPAIRS = {
    "true_peak": {"lufs_target": -1.0}, "mono_compatibility": {"double_gain_db": -4.0}, "clipping": {"lufs_target": -1.5}, "tuning": {"tune_strength": 0.25},
    "vocal_presence": {"vir_db": 1.5, "duck_depth_db": 1.0}, "clarity": {"mask_strength": 0.15, "duck_depth_db": 1.0},
}


def gates(renders: DataFrame, by: str = "render_id", target: float = -10.5) -> DataFrame:
    """A row per gate: name, passed, value, severity, repair. A measure that a render doesn't have gives no gate; one that is
    shorter than a second has that gate alone."""
    has = set(renders.columns)
    lufs, peak = F.col("lufs"), F.col("true_peak_db")
    goal = F.col("lufs_target") if "lufs_target" in has else F.lit(target)
    under = goal - lufs
    by_policy = (under > 0) & (peak >= C.TRUE_PEAK - C.LUFS_WINDOW) & (under <= C.LUFS_TOLERANCE + C.LUFS_GRACE)
    near = F.abs(under) <= C.LUFS_TOLERANCE
    rules = [
        ("true_peak", "true_peak_db", peak <= C.TRUE_PEAK, F.lit("error")), ("loudness", "lufs", near | by_policy, F.when(near, "warning").when(by_policy, "info").otherwise("warning")),
        ("mono_compatibility", "mono_loss_db", F.col("mono_loss_db") <= C.MONO_LOSS if "mono_loss_db" in has else None, F.lit("error")), ("clipping", "clip_pct", F.col("clip_pct") < C.CLIP if "clip_pct" in has else None, F.lit("error")),
        ("continuity", "gap_s", F.col("gap_s") <= C.GAP if "gap_s" in has else None, F.lit("warning")), ("sync", "sync_ms", F.col("sync_ms") <= C.SYNC_MS if "sync_ms" in has else None, F.lit("warning")),
        ("tuning", "tuning_cents", F.col("tuning_cents") <= C.TUNING_CENTS if "tuning_cents" in has else None, F.lit("warning")), ("vocal_presence", "presence_db", F.col("presence_db") >= C.PRESENCE if "presence_db" in has else None, F.lit("error")),
        ("clarity", "clarity", F.col("clarity") > C.CLARITY if "clarity" in has else None, F.lit("warning")),
    ]
    empty = F.create_map().cast("map<string,double>")
    repair = lambda name: F.create_map(*(F.lit(x) for kv in REPAIRS[name].items() for x in kv)) if name in REPAIRS else empty
    made = [F.when(F.col(m).isNotNull(), F.struct(F.lit(n).alias("gate"), ok.alias("passed"), F.col(m).cast("double").alias("value"), s.alias("severity"), repair(n).alias("repair"))) for n, m, ok, s in rules if m in has and ok is not None]
    every = F.filter(F.array(*made), lambda x: x.isNotNull())
    if "duration_s" in has:
        short = F.array(F.struct(F.lit("length").alias("gate"), F.lit(False).alias("passed"), F.col("duration_s").cast("double").alias("value"), F.lit("error").alias("severity"), empty.alias("repair")))
        every = F.when(F.col("duration_s") < 1, short).otherwise(every)
    return renders.select(by, F.explode(every).alias("g")).select(by, "g.*")


def graded(renders: DataFrame, by: str = "render_id", target: float = -10.5) -> DataFrame:
    """Errors, warnings, sub-scores, score and passed for each render."""
    has = set(renders.columns)
    counts = gates(renders, by, target).groupBy(by).agg(F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("errors"), F.count_if(~F.col("passed") & (F.col("severity") == "warning")).alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos"))
    x = renders.join(counts, by)
    goal = F.col("lufs_target") if "lufs_target" in has else F.lit(target)
    under = goal - F.col("lufs")
    miss = F.when(F.col("infos") > 0, F.greatest(F.lit(0.0), -under)).otherwise(F.abs(under))
    harmonic = F.coalesce(clip(1 - F.col("tuning_cents") / 100, 0.0, 1.0), F.lit(0.7)) if "tuning_cents" in has else F.lit(0.7)
    clear = clip(F.col("clarity") / 0.6, 0.0, 1.0) if "clarity" in has else F.lit(0.0)
    sub = {"sub_gates": clip(1 - F.col("errors") * 0.35 - F.col("warnings") * 0.08, 0.0, 1.0), "sub_harmonic": harmonic, "sub_clarity": clear, "sub_loudness": F.coalesce(clip(1 - miss / 6, 0.0, 1.0), F.lit(1.0))}
    x = x.withColumns({k: rounded(v, 4) for k, v in sub.items()})
    return x.withColumn("score", 0.40 * F.col("sub_gates") + 0.25 * F.col("sub_harmonic") + 0.20 * F.col("sub_clarity") + 0.15 * F.col("sub_loudness")).withColumn("passed", F.col("errors") == 0)


def collect_repairs(found: DataFrame, by: str = "render_id") -> DataFrame:
    """Overrides of failed gates, summed by parameter."""
    rows = found.filter(~F.col("passed")).select(by, F.explode("repair").alias("parameter", "x"))
    return rows.groupBy(by, "parameter").agg(F.round(F.sum("x"), 3).alias("amount"))


def ranked_renders(scores: DataFrame, group: str, by: str = "render_id") -> DataFrame:
    """K4: passing ones first, then by score."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("passed"), F.desc("score"), by)))


def best_attempt(attempts: DataFrame, by: str) -> DataFrame:
    """K5: a passing attempt beats a failing one, then the score decides, then the first; two repairs at most."""
    few = attempts.filter(F.col("attempt") <= 3)
    return few.groupBy(by).agg(F.max(F.struct("passed", "score", (-F.col("attempt")).alias("n"))).alias("m")).select(by, (-F.col("m.n")).alias("attempt"), "m.passed", "m.score")


def vocal_presence(levels: DataFrame) -> DataFrame:
    """The voice's level over the mix's, with the master's gain added; a missing gain is reported, not read as 0."""
    return levels.withColumn("presence_db", F.col("vocal_db") + F.col("master_gain_db") - F.col("mix_db")).withColumn("gain_known", F.col("master_gain_db").isNotNull())


def tuning_error(notes: DataFrame, by: str) -> DataFrame:
    """Median cents from the nearest tone of the scale (key_pc, key_mode), over notes of .15 s and more."""
    from beatlake.functions.keys import scale_pcs

    scale = scale_pcs(F.col("key_pc"), F.col("key_mode"))
    base = F.bround("midi").cast("int")
    near = F.filter(F.sequence(base - 2, base + 2), lambda c: F.array_contains(scale, F.pmod(c, F.lit(12)).cast("int")))
    off = F.array_min(F.transform(near, lambda c: F.abs(F.col("midi") - c))) * 100
    return notes.filter("duration_s >= 0.15").groupBy(by).agg(F.percentile(off, 0.5).alias("tuning_cents"), F.count(F.lit(1)).alias("n"))
