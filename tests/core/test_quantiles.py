"""Quantiles at thresholds are those of the SQL to the last bit: products are added up with one rounding."""

import math
import random

from pyspark.sql import functions as F

from beatlake.functions.scalars import fused
from beatlake.operators import profiles, sequences
from beatlake.streaming import coaching, live


def plain(values, p):
    x, at = sorted(values), (len(values) - 1) * p
    lo, hi, share = x[math.floor(at)], x[math.ceil(at)], at - math.floor(at)
    return math.fma(lo, 1 - share, hi * share)


def frames(spark, n=120):
    rng = random.Random(4)
    rows = [(1, k, float(k), -60.0 + rng.randrange(9000) / 100 / 3.0, k % 3 == 0) for k in range(n)]
    return spark.createDataFrame(rows, "take_id long, event_id long, time_s double, rms_db double, inside boolean"), [r[3] for r in rows]


def test_fused(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-80, 80), rng.random(), rng.uniform(-80, 80)) for _ in range(2000)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", fused(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert all(r["x"] == math.fma(r["a"], r["b"], r["c"]) for r in got)


def test_gate_floor(spark):
    df, levels = frames(spark)
    want = [-70.0 if k < 19 else plain(levels[max(0, k - 399) : k + 1], 0.1) for k in range(len(levels))]
    assert [r["floor_db"] for r in live.voice_gate(df).orderBy("event_id").collect()] == want
    floor = coaching.Floor()
    assert [floor.after(x) for x in levels] == want


def test_gate_of_takes_without_levels(spark):
    df = spark.range(25).selectExpr("1L AS take_id", "id AS event_id", "double(id) AS time_s", "if(id = 24, -50D, null) AS rms_db")
    assert [(r["floor_db"], r["is_voice"]) for r in live.voice_gate(df).orderBy("event_id").collect()][22:] == [(None, None), (None, None), (-50.0, False)]


def test_noise_verdict(spark):
    df, levels = frames(spark)
    df = df.withColumn("inside", F.lit(False))
    got = profiles.noise_verdict(df, "take_id", "inside").first()
    assert got["floor_db"] == plain(levels, 0.08) and got["snr_db"] == plain(levels, 0.85) - plain(levels, 0.15)


def test_longest_silence_at_the_threshold(spark):
    # The last bit of the quantile decides whether the sixth frame is loud, and so the length of the silence.
    for lo, hi in ((-29.27, -23.27), (-27.17, -20.97)):
        edge = plain([-99.0] * 10 + [lo, hi], 0.95) - 45
        for level, silent in ((edge, 5), (math.nextafter(edge, -math.inf), 10)):
            levels = [lo, *[-99.0] * 4, level, *[-99.0] * 5, hi]
            df = spark.createDataFrame([(t, k, float(k), x) for t in (1, None) for k, x in enumerate(levels)], "take_id long, event_id long, time_s double, rms_db double")
            got = {r["take_id"]: r["silent_frames"] for r in sequences.longest_silence(df, "take_id", "event_id").collect()}
            assert got[1] == silent, (lo, hi, level)


def test_gate_keeps_its_levels_sorted(spark):
    rng = random.Random(8)
    level = lambda: rng.choice([None, math.nan, 0.0, rng.uniform(-90, 0), rng.uniform(-90, 0), rng.uniform(-90, 0)])
    rows = [(take, k, k / 8, level()) for take in (1, 2, None) for k in range(900)]
    df = live.voice_gate(spark.createDataFrame(rows, "take_id long, event_id long, time_s double, rms_db double").repartition(3))
    assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()  # 400 levels were gathered and sorted for each frame
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = {(r["take_id"], r["event_id"]): r["floor_db"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for take in (1, 2, None):
        levels = [r[3] for r in rows if r[0] == take]
        for k in range(19, 900):
            near = sorted((x for x in levels[max(0, k - 399) : k + 1] if x is not None), key=lambda x: (x != x, x))
            assert got[take, k] == plain(near, 0.1)
