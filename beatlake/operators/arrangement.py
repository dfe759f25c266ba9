"""The structure of a song from its phrases."""

from __future__ import annotations

import difflib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.functions.scalars import dot, normalised_tokens
from beatlake.sources.lineage import materialised

SIMILAR = 0.82
#: Pairs whose tokens line_similarity holds as Python objects at once.
SOME = 256


@F.arrow_udf(T.DoubleType())
def line_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio of token lists; not symmetric. Tokens are compared by their numbers, some pairs at a time, as the
    Python strings of a batch take many times its bytes."""
    out = np.zeros(len(a))
    for at in range(0, len(a), SOME):
        x, y = a.slice(at, SOME), b.slice(at, SOME)
        codes = pa.concat_arrays([x.flatten(), y.flatten()]).dictionary_encode("encode").indices.to_numpy()
        ends = np.cumsum([n or 0 for side in (x, y) for n in pc.list_value_length(side).to_pylist()])
        lists = [some.tolist() for some in np.split(codes, ends[:-1])]
        for k, (one, other) in enumerate(zip(lists, lists[len(x) :])):
            if one and other:
                out[at + k] = difflib.SequenceMatcher(None, one, other, autojunk=False).ratio()
    return pa.array(out)


def token_overlap(a: Column, b: Column) -> Column:
    """Share of distinct tokens that two lists have in common: the prefilter of line_similarity."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


#: Weights of J14's parts.
PARTS = {"chroma": 0.5, "contour": 0.3, "duration_s": 0.1, "rate": 0.1, "text": 0.6}


def phrase_pairs(phrases: DataFrame, by: str, least: float) -> DataFrame:
    """by, i and j: all pairs i < j of a take's phrases whose similarity can reach `least`, whatever their other parts are.

    With both texts of two tokens or more, their ratio 2 M / (a + b) must be at least x, as all other parts are 1 at most: then
    the shorter one has x / (2 - x) of the longer one's tokens, and the two share one of each one's rarest a (1 - x / (2 - x)) + 1
    tokens (counted with repeats), so pairs meet on these alone. Without both texts, durations must be within a ratio, and
    pairs meet on bands of its width. Where the threshold rules nothing out, all pairs of a take are candidates.
    """
    has = [c for c in PARTS if c in phrases.columns]
    rest = sum(PARTS[c] for c in has if c != "text")
    x = 1 - (rest + PARTS["text"]) * (1 - least) / PARTS["text"]
    ratio = 1 - rest * (1 - least) / PARTS["duration_s"] if "duration_s" in has else 0.0
    rows = phrases.select(by, "idx", *(["_tokens"] if "text" in has else []), *(["duration_s"] if "duration_s" in has else []))
    rows = rows.withColumn("_worded", F.coalesce(F.size("_tokens") >= 2, F.lit(False)) if "text" in has else F.lit(False))

    def met(side: DataFrame, on: list[str], other: DataFrame | None = None) -> DataFrame:
        a = side.select(*on, F.col("idx").alias("_i"), F.col("_worded").alias("_wi"), *(["n"] if "n" in side.columns else []))
        b = (side if other is None else other).select(*on, F.col("idx").alias("_j"), F.col("_worded").alias("_wj"), *([F.col("n").alias("m")] if "n" in side.columns else []))
        return a.join(b, on).filter("_i <> _j").withColumns({"i": F.least("_i", "_j"), "j": F.greatest("_i", "_j")})

    both = F.col("_wi") & F.col("_wj")
    pairs = []
    if "text" in has and x > 0:
        # Tokens with their number among equal ones, the rarest in the take first.
        token = rows.filter("_worded").select(by, "idx", F.size("_tokens").alias("n"), F.explode("_tokens").alias("_t"))
        token = token.withColumn("_k", F.row_number().over(Window.partitionBy(by, "idx", "_t").orderBy("_t")))
        seen = token.groupBy(by, "_t", "_k").agg(F.count(F.lit(1)).alias("_seen"))
        token = token.join(seen, [by, "_t", "_k"]).withColumn("_place", F.row_number().over(Window.partitionBy(by, "idx").orderBy("_seen", "_t", "_k")))
        share = x / (2 - x)
        rare = token.filter(F.col("_place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).withColumn("_worded", F.lit(True))
        pairs.append(met(rare, [by, "_t", "_k"]).filter(F.least("n", "m") >= F.greatest("n", "m") * share - 1e-9))
    elif "text" in has:
        pairs.append(met(rows.filter("_worded"), [by]))
    if ratio > 0:
        width = -math.log(ratio) if ratio < 1 else 1e-9
        known = rows.filter("duration_s > 0").withColumn("_band", F.floor(F.log("duration_s") / width))
        near = known.withColumn("_band", F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1)))
        pairs.append(met(known, [by, "_band"], near).filter(~both))
        unknown = rows.filter(~F.coalesce(F.col("duration_s") > 0, F.lit(False)))  # these may be alike in all else
        pairs.append(met(unknown, [by], rows).filter(~both))
    else:
        pairs.append(met(rows.filter("NOT _worded"), [by], rows))
    return reduce(DataFrame.unionByName, (p.select(by, "i", "j") for p in pairs)).distinct()


def phrase_similarity(phrases: DataFrame, by: str = "take_id", least: float = 0.5) -> DataFrame:
    """Pairs i < j of a take's phrases with a weighted mean of what both have: chroma cosine .5, contour exp(-mad / 1.5) .3
    (the best of one slide either way), duration ratio .1, rate ratio .1, tokens .6 (both of two tokens or more), if it is at
    least `least`. Phrases have idx, once in a take, and any of chroma, contour, duration_s, rate, text. Only pairs that can
    reach the threshold meet (phrase_pairs)."""
    has = set(phrases.columns)
    rows = phrases.withColumn("_tokens", normalised_tokens(F.col("text"))) if "text" in has else phrases
    of = [c for c in rows.columns if c in (*PARTS, "_tokens") and c != "text"]
    left = rows.select(by, F.col("idx").alias("i"), *(F.col(c).alias(f"a_{c}") for c in of))
    right = rows.select(by, F.col("idx").alias("j"), *(F.col(c).alias(f"b_{c}") for c in of))
    pairs = phrase_pairs(rows, by, least).join(left, [by, "i"]).join(right, [by, "j"])
    parts: list[tuple[Column, float]] = []
    if "chroma" in has:
        norm = F.sqrt(dot(F.col("a_chroma"), F.col("a_chroma"))) * F.sqrt(dot(F.col("b_chroma"), F.col("b_chroma")))
        parts.append((F.when(norm > 0, dot(F.col("a_chroma"), F.col("b_chroma")) / norm), PARTS["chroma"]))
    if "contour" in has:
        def mad(a: Column, b: Column) -> Column:
            both = F.zip_with(a, b, lambda x, y: F.abs(x - y))
            kept = F.filter(both, lambda x: x.isNotNull())
            return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)

        a, b = F.col("a_contour"), F.col("b_contour")
        n = F.least(F.size(a), F.size(b)) - 1
        parts.append((F.exp(-F.least(mad(a, b), mad(F.slice(a, F.lit(2), n), F.slice(b, F.lit(1), n)), mad(F.slice(a, F.lit(1), n), F.slice(b, F.lit(2), n))) / 1.5), PARTS["contour"]))
    for name in ("duration_s", "rate"):
        if name in has:
            known = F.col(f"a_{name}").isNotNull() & F.col(f"b_{name}").isNotNull()
            parts.append((F.when(known, F.least(f"a_{name}", f"b_{name}") / F.greatest(f"a_{name}", f"b_{name}", F.lit(1e-9))), PARTS[name]))
    if "text" in has:
        words = (F.size("a__tokens") >= 2) & (F.size("b__tokens") >= 2)
        # Only what is compared goes to Python: F.when doesn't keep a UDF from rows.
        alike = words & (token_overlap(F.col("a__tokens"), F.col("b__tokens")) > 0)
        pairs = pairs.withColumn("_text", F.when(words, line_similarity(F.when(alike, F.col("a__tokens")), F.when(alike, F.col("b__tokens")))))
        parts.append((F.col("_text"), PARTS["text"]))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    out = pairs.withColumn("similarity", F.when(weight > 0, total / weight))
    return out.filter(F.col("similarity") >= least).select(by, "i", "j", "similarity")


def repeat_groups(phrases: DataFrame, similar: DataFrame, by: str = "take_id", least: float = SIMILAR) -> DataFrame:
    """Single-link groups inside a take, numbered in the order of their first phrase. Least labels spread over links and
    then over labels of labels, so the number of rounds grows with the logarithm of a chain's length; each round is written."""
    links = similar.filter(F.col("similarity") >= least).select(by, "i", "j")
    both = links.union(links.select(by, "j", "i")).toDF(by, "node", "other")
    labels = phrases.select(by, F.col("idx").alias("node"), F.col("idx").alias("label"))
    while True:
        near = both.join(labels.select(by, F.col("node").alias("other"), F.col("label").alias("_l")), [by, "other"]).groupBy(by, "node").agg(F.min("_l").alias("_l"))
        step = labels.join(near, [by, "node"], "left").select(by, "node", F.least("label", F.coalesce("_l", "label")).alias("label"), F.col("label").alias("_was"))
        jump = step.join(step.select(by, F.col("node").alias("label"), F.col("label").alias("_r")), [by, "label"]).select(by, "node", F.least("label", "_r").alias("label"), "_was")
        now = materialised(jump)
        if not now.filter(F.col("label") != F.col("_was")).limit(1).count():
            break
        labels = now.drop("_was")
    return now.select(by, F.col("node").alias("idx"), (F.dense_rank().over(Window.partitionBy(by).orderBy("label")) - 1).alias("group_id"))


def pick_hook(groups: DataFrame, by: str = "take_id", rap: bool = False) -> DataFrame:
    """groups' phrases (group_id, duration_s, midi, level): .55 min(n / 4, 1) + w pitch lift + .15 loudness lift among groups
    of two repeats and .8 s; the best one over 0."""
    w = Window.partitionBy(by)
    rows = groups.withColumns({"_m": F.avg("midi").over(w), "_l": F.avg("level").over(w)})
    x = rows.groupBy(by, "group_id").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_s").alias("d"), (F.avg("midi") - F.max("_m")).alias("lift"), (F.avg("level") - F.max("_l")).alias("loud"))
    unit = lambda c, s: F.least(F.greatest(F.col(c) / s, F.lit(0.0)), F.lit(1.0))
    x = x.filter("n >= 2 and d >= 0.8").withColumn("score", F.round(0.55 * F.least(F.col("n") / 4.0, F.lit(1.0)) + (0.20 if rap else 0.30) * unit("lift", 6.0) + 0.15 * unit("loud", 6.0), 9)).filter("score > 0")
    return x.groupBy(by).agg(F.max(F.struct("score", (-F.col("group_id")).alias("g"))).alias("m")).select(by, (-F.col("m.g")).alias("hook_group"), F.col("m.score").alias("score"))


def label_phrases(phrases: DataFrame, by: str = "take_id") -> DataFrame:
    """Phrases (idx, start_s, end_s, group_id, is_hook, group_size) -> label. Each rule sees the labels of those before it:
    hook; ad-lib (single, at most min(1.4 s, .55 of the median), within a second of a neighbour); intro before the first hook;
    prehook right before a hook; the first single between hooks, later than the first repeat, is the bridge; else verse."""
    w, whole = Window.partitionBy(by).orderBy("start_s", "idx"), Window.partitionBy(by)
    d = F.col("end_s") - F.col("start_s")
    rows = phrases.withColumns({"_d": d, "_med": F.percentile(d, 0.5).over(whole), "_gap": F.least(F.coalesce(F.col("start_s") - F.lag("end_s").over(w), F.lit(1e9)), F.coalesce(F.lead("start_s").over(w) - F.col("end_s"), F.lit(1e9)))})
    single = F.col("group_size") == 1
    adlib = single & (F.col("_d") <= F.least(F.lit(1.4), 0.55 * F.col("_med"))) & (F.col("_gap") <= 1)
    rows = rows.withColumn("label", F.when(F.col("is_hook"), "hook").when(adlib, "adlib").otherwise("verse"))
    hooks = F.sum(F.col("is_hook").cast("int"))
    rows = rows.withColumns({"_before": hooks.over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": hooks.over(whole), "_next": F.lead("label").over(w)})
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("label", F.when((F.col("label") == "verse") & first & (F.col("_before") == 0) & (F.col("_all") > 0), "intro").when((F.col("label") == "verse") & (F.col("_next") == "hook") & (F.col("_before") > 0), "prehook").otherwise(F.col("label")))
    late = (F.col("label").isin("verse", "prehook")) & single & (F.col("_before") >= 2) & (F.col("_before") < F.col("_all"))
    nth = F.sum(late.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("label", F.when(late & (nth == 1), "bridge").otherwise(F.col("label"))).drop("_d", "_med", "_gap", "_before", "_all", "_next")


def sections_from_labels(phrases: DataFrame, by: str = "take_id") -> DataFrame:
    """Neighbours with one label merge; a boundary is the middle of the gap between them; sections under .3 s go."""
    w = Window.partitionBy(by).orderBy("start_s", "idx")
    rows = phrases.withColumn("_new", F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(by, "_run").agg(F.first("label").alias("label"), F.min("start_s").alias("s"), F.max("end_s").alias("e"))
    r = Window.partitionBy(by).orderBy("_run")
    runs = runs.withColumns({"start_s": F.coalesce((F.lag("e").over(r) + F.col("s")) / 2, "s"), "end_s": F.coalesce((F.col("e") + F.lead("s").over(r)) / 2, "e")})
    return runs.filter(F.col("end_s") - F.col("start_s") >= 0.3).select(by, (F.col("_run") - 1).alias("seq"), "label", "start_s", "end_s")


def layer_votes(votes: DataFrame, by: str) -> DataFrame:
    """A layer stays if half of its phrases, or two, want it. votes: layer, wanted."""
    x = votes.groupBy(by, "layer").agg(F.count_if("wanted").alias("yes"), F.count(F.lit(1)).alias("n"))
    return x.withColumn("keep", (F.col("yes") >= 2) | (2 * F.col("yes") >= F.col("n")))


def automation(points: DataFrame, by: str) -> DataFrame:
    """Mix targets at the contour's points in long form: parameter, time_s, value."""
    from beatlake.constants import MIX_TARGETS
    from beatlake.functions.music import mix_targets

    rows = points.withColumn("_t", mix_targets(F.col("value"), F.col("performance_type"), F.col("genre")))
    every = F.array(*(F.struct(F.lit(k).alias("parameter"), F.col(f"_t.{k}").alias("x")) for k in MIX_TARGETS))
    return rows.select(by, "time_s", F.explode(every).alias("p")).select(by, "time_s", "p.parameter", F.col("p.x").alias("value"))
