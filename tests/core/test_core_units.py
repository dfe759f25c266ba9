"""Planted truth on tiny tables, for what SQL doesn't tell."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from beatlake.functions import keys, music, theory
from beatlake.operators import acoustics, arrangement, planning, profiles, sequences
from beatlake.sources import catalog_io
from beatlake.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("tag, want", [("eb_minor", (3, "minor")), ("F# Minor", (6, "minor")), ("ebm", (3, "minor")), ("2A", (3, "minor")), ("B♭ major", (10, "major")), ("c", (0, "major")), ("banana", None), ("", None)])
def test_keys_are_parsed(spark, tag, want):
    got = one(spark, keys.parse_key(F.lit(tag)))
    assert (got and (got["pc"], got["mode"])) == want


def test_relative_keys_need_no_shift(spark):
    row = keys.shift_table(spark).filter("v_pc = 4 and v_mode = 'minor' and b_pc = 7 and b_mode = 'major' and most = 2").first()
    assert row["shift"] == 0 and row["quality"] == 1.0


def test_candidates_keep_blue_notes(spark):
    got = one(spark, theory.tuning_candidates(F.lit(0), F.lit("maj"), F.lit(0), F.lit("major"), F.lit("trap"), F.lit(True)))
    assert {0, 4, 7, 3, 6, 10} <= set(got) and 1 not in got


def test_tempo_needs_two_positive_sides(spark):
    assert one(spark, F.element_at(music.tempo_options(F.lit(0.0), F.lit(90.0), F.lit(0.1)), 1)["reading"]) == "unknown"


def test_segment_notes_splits_at_jumps(spark):
    rows = [(1, k * 0.01, 60.0 + (4 if k >= 20 else 0) + 0.01 * (k % 3), k not in (40, 41)) for k in range(80)]
    got = sequences.segment_notes(spark.createDataFrame(rows, "take_id long, time_s double, midi double, voiced boolean"), "take_id").orderBy("start_s").collect()
    assert [round(r["midi"]) for r in got] == [60, 64, 64]


def test_limits_hold_after_clamping(spark):
    rng = random.Random(1)
    t = [k * 0.3 for k in range(40)]
    rows = [(1, x, x + rng.uniform(-0.2, 0.2)) for x in t]
    got = sequences.limit_by_neighbours(spark.createDataFrame(rows, "take_id long, time_s double, target_s double"), "take_id").orderBy("time_s").collect()
    ratios = [(b["limited_s"] - a["limited_s"]) / (b["time_s"] - a["time_s"]) for a, b in zip(got, got[1:])]
    assert all(0.8 - 1e-9 <= r <= 1.25 + 1e-9 for r in ratios)


def test_anchors_are_judged_against_the_last_kept_one(spark):
    rows = [(1, 0.0, 0.0), (1, 0.01, 0.01), (1, 1.0, 2.0), (1, 2.0, 2.1)]
    got = sequences.sanitised_anchors(spark.createDataFrame(rows, "take_id long, time_s double, to_s double"), "take_id").orderBy("time_s").collect()
    assert [r["time_s"] for r in got] == [0.0, 2.0]


def test_overlong_regions_are_cut_at_quiet_frames(spark):
    frames = spark.createDataFrame([(1, k * 0.1, -20.0 if k != 130 else -60.0) for k in range(260)], "take_id long, time_s double, rms_db double")
    regions = spark.createDataFrame([(1, 0.0, 25.9), (2, 0.0, 3.0)], "take_id long, start_s double, end_s double")
    got = sequences.split_overlong(regions, frames, "take_id").collect()
    assert all(r["end_s"] - r["start_s"] <= 12.0 for r in got) and any(abs(r["end_s"] - 13.0) < 1e-9 for r in got) and sum(r["take_id"] == 2 for r in got) == 1


def test_onsets_take_one_slot_each_in_order(spark):
    grid = spark.createDataFrame([(1, k * 0.25) for k in range(40)], "take_id long, time_s double")
    rows = [(1, k, k * 0.25 + (0.03 if k % 2 else -0.03), 50.0) for k in range(40)]
    got = planning.assign_onsets(spark.createDataFrame(rows, "take_id long, event_id long, time_s double, strength double"), grid, "take_id", 0.25).orderBy("event_id").collect()
    assert [r["slot_at"] for r in got] == [k * 0.25 for k in range(40)]


def test_lag_is_recovered(spark):
    rng = random.Random(2)
    t = sorted(rng.uniform(0, 60) for _ in range(120))
    a, b = spark.createDataFrame([(1, x) for x in t], "take_id long, time_s double"), spark.createDataFrame([(1, x + 0.7) for x in t], "take_id long, time_s double")
    got = planning.best_lag(a, b, "take_id").first()
    assert abs(got["lag_s"] - 0.7) <= 0.011 and got["lag_ratio"] > 1.6


def test_tempo_is_recovered(spark):
    onsets = spark.createDataFrame([(1, k * 0.5, 1.0) for k in range(60)], "take_id long, time_s double, strength double")
    assert abs(profiles.tempo_histogram(onsets, "take_id").first()["bpm"] - 120) < 1
    assert abs(profiles.tempo_autocorr(onsets, "take_id").first()["bpm"] - 120) < 3


def test_structure_finds_the_hook(spark):
    parts = [("a", 4.0), ("h", 3.0), ("b", 4.0), ("h", 3.0), ("c", 4.0), ("h", 3.0)]
    rows, t = [], 0.0
    for k, (name, d) in enumerate(parts):
        rows.append((1, k, t, t + d, d, {"a": "one two three", "b": "four five six", "c": "seven eight nine", "h": "sing it again now"}[name], 60.0 + (5 if name == "h" else 0), -20.0))
        t += d + 0.5
    p = spark.createDataFrame(rows, "take_id long, idx long, start_s double, end_s double, duration_s double, text string, midi double, level double")
    groups = arrangement.repeat_groups(p.select("take_id", "idx"), arrangement.phrase_similarity(p.select("take_id", "idx", "text"), "take_id"), "take_id")
    found = p.join(groups, ["take_id", "idx"])
    hook = arrangement.pick_hook(found, "take_id").first()["hook_group"]
    labelled = arrangement.label_phrases(found.withColumn("is_hook", F.col("group_id") == hook).withColumn("group_size", F.when(F.col("is_hook"), 3).otherwise(1)), "take_id").orderBy("idx").collect()
    assert [r["label"] for r in labelled] == ["intro", "hook", "prehook", "hook", "bridge", "hook"]


def test_documents_are_read_keyed_and_refreshed(spark, tmp_path):
    docs = [{"beat_id": "b1", "bpm": 0, "status": "ok", "version": "2.2.0", "downbeats": [0.0, 2.0], "key": {"pc": 3, "mode": "minor"}}, {"beat_id": "b2", "bpm": 90.5, "status": "ok", "version": "1.0.0"}, {"beat_id": "b3", "status": "failed"}]
    (tmp_path / "docs.json").write_text("\n".join(map(json.dumps, docs)))
    current, stale = catalog_io.read_catalog(spark, str(tmp_path / "docs.json"))
    assert [(r["beat_id"], r["bpm"]) for r in current.collect()] == [("b1", None)] and sum(r["count"] for r in stale.collect()) == 2
    bars = catalog_io.explode_documents(current, "beat_id", "downbeats")
    assert catalog_io.implode(bars, "beat_id", "downbeats").first()["downbeats"] == [0.0, 2.0]
    for name, body in (("a.wav", b"x"), ("copy.WAV", b"x"), ("b.mp3", b"y"), ("note.txt", b"z")):
        (tmp_path / "audio").mkdir(exist_ok=True)
        (tmp_path / "audio" / name).write_bytes(body)
    assert catalog_io.keyed_assets(spark, str(tmp_path / "audio")).count() == 3
    assets = catalog_io.list_assets(spark, str(tmp_path / "audio"))
    assert [r["path"].rsplit("/", 1)[1] for r in assets.collect()] == ["a.wav", "b.mp3", "copy.WAV"]
    side = spark.createDataFrame([("a.wav", "7"), ("b", "8")], "file string, serial string")
    with_side = catalog_io.join_metadata(assets, side)
    assert sorted(r["x"] for r in with_side.select(catalog_io.derive_id(with_side).alias("x")).collect()) == ["beat-7", "beat-8", "copy"]
    have = spark.createDataFrame([("k1", "2.2.0", "drop", {"rhythm": "neural"}), ("k2", "2.2.0", "drop", {"rhythm": "basic"}), ("k3", "1", "drop", {})], "content_key string, version string, bar_anchor string, backends map<string,string>")
    todo = catalog_io.refresh_plan(spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",)], "content_key string"), have, {"rhythm": "library", "separation": "neural"})
    assert {r["content_key"]: r["reason"] for r in todo.collect()} == {"k2": "rhythm", "k3": "version", "k4": "missing"}
    catalog_io.write_documents(spark.createDataFrame([("x", None), ("y", "broken")], "id string, error string"), str(tmp_path / "out"))
    assert {r["id"]: r["status"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"x": "ok", "y": "failed"}


def frames(n=2000, clip=None):
    rng = random.Random(3)
    return [(1, k, (pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=50 * k)).to_pydatetime(), k * 0.05, -18.0 + rng.uniform(-1, 1), -6.0, clip is not None and clip <= k < clip + 5, True, 0.5, False) for k in range(n)]


def test_good_takes_are_left_alone_and_clipping_speaks(spark):
    assert live.batch_cues(spark.createDataFrame(frames(), live.FRAMES)).count() == 0
    cues = live.batch_cues(spark.createDataFrame(frames(clip=100), live.FRAMES)).collect()
    assert [(r["cue"], r["severity"]) for r in cues] == [("clipping", "fatal")]


def test_cues_and_modulations_stream_a_long_take(spark):
    """No group of a whole take: state goes on from batch to batch, whatever their size, and starts anew with each take."""
    from beatlake.operators import harmony

    rows = [(take, *r[1:]) for take in (1, 2, None) for r in frames(400, clip=100 if take != 2 else 300)]
    chords = [(e, bar, 0 if bar < 40 else 6, "maj", 2.0) for e in ("a", "b") for bar in range(80)]
    data = spark.createDataFrame(rows, live.FRAMES), spark.createDataFrame(chords, "entity_id string, bar long, root int, quality string, duration_s double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cues, keys = live.batch_cues(data[0]), harmony.modulations(data[1], "entity_id")
        assert not any("FlatMapGroups" in x._jdf.queryExecution().toString() for x in (cues, keys))
        got = [tuple(r) for r in cues.collect()]
        regions = sorted(tuple(r) for r in keys.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = pd.DataFrame(rows[:400], columns="take_id event_id ts time_s rms_db peak_db clipped is_voice low_mid_ratio is_plosive".split())
    want = live.coach_frames(whole, live.Coach())
    assert want and [r[1:] for r in got if r[0] == 1] == [r[1:] for r in got if r[0] is None] == want
    assert [r[1] for r in got if r[0] == 2] == ["clipping"]
    assert [r[0] for r in regions] == ["a", "a", "b", "b"] and [r[1:] for r in regions[:2]] == [r[1:] for r in regions[2:]]
    assert regions[0][1] == 0 and regions[0][2] == regions[1][1] and regions[1][2] == 80 and (regions[0][3], regions[1][3]) == (0, 6)


def test_stream_gives_the_replays_cues(spark, tmp_path):
    rows = frames(600, clip=100)
    for k in range(4):
        spark.createDataFrame(rows[k * 150 : (k + 1) * 150], live.FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    stream = live.live_cues(live.read_frames(spark, str(tmp_path / "in" / "*"), per_trigger=1))
    query = stream.writeStream.format("memory").queryName("cues").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r["cue"], r["at_s"]) for r in spark.sql("SELECT * FROM cues").collect()]
    assert got == [(r["cue"], r["at_s"]) for r in live.batch_cues(spark.createDataFrame(rows, live.FRAMES)).collect()]


def test_ingest_keeps_one_document_per_content(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("a", k), ("b" if k else "c", k)], "content_key string, v int").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("content_key string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = live.ingest_catalog(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["content_key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    # A trigger reads the folders of its own keys alone, and a batch that comes again reads what others have stored.
    files = live.stored_keys(spark, str(tmp_path / "out"), ["a", "x"], 7).inputFiles()
    assert files and all("prefix=a/" in f for f in files)
    assert live.stored_keys(spark, str(tmp_path / "out"), ["a"], 0).count() == 0 and live.stored_keys(spark, str(tmp_path / "out"), ["x"], 0) is None


def test_sql_functions(spark):
    from beatlake.functions.sql import register

    register(spark)
    row = spark.sql("SELECT camelot(9, 'minor') a, circle_distance(0, 7) b, family_root(4, 'minor') c, transpose_pc(1, -3) d, pitch_class(60.5) e").first()
    assert tuple(row) == ("8A", 1, 7, 10, 0)
    assert {tuple(r) for r in spark.sql("SELECT * FROM explode_questions(3.0D, 'no_voice', 'heavy')").collect()} == {("block", "length"), ("block", "voice"), ("warn", "noise")}


def test_sql_functions_of_keys_equal_the_columns(spark):
    from pyspark.sql import functions as F

    from beatlake.functions import keys
    from beatlake.functions.sql import register

    register(spark)
    tags = ["eb_minor", "F# Minor", "ebm", "2A", " 12b", "C♯ maj", "a", "B♭ / minor", "Gmin7", "h minor", "13A", "", None, "d  dorian", "e#", "Abmaj", "fb-m"]
    spark.createDataFrame([(t,) for t in tags], "tag string").withColumn("want", keys.parse_key(F.col("tag"))).createOrReplaceTempView("tags")
    for r in spark.sql("SELECT tag, want, normalise_key(tag) AS got FROM tags").collect():
        assert r["got"] == r["want"], r["tag"]
    two = [(a, m, b, n) for a in range(12) for m in ("major", "minor") for b in range(0, 12, 5) for n in ("major", "minor")]
    k, mode = F.col("a"), F.col("m")
    frame = spark.createDataFrame(two, "a int, m string, b int, n string").withColumns({"code": keys.camelot(k, mode), "scale": keys.scale_pcs(k, mode), "near": keys.camelot_neighbours(keys.camelot(k, mode)), "set1": keys.compatible_set(k, mode, 1)})
    frame.createOrReplaceTempView("two")
    keys.shift_table(spark).createOrReplaceTempView("shifts")
    got = spark.sql("""SELECT count(*) AS n, count_if(camelot(a, m) = code AND scale_pcs(a, m) = scale AND camelot_neighbours(code) = near AND compatible_set(a, m, 1) = set1 AND key_from_camelot(code) = named_struct('pc', a, 'mode', m)
      AND best_shift(a, m, b, n, 2).shift = s.shift AND abs(best_shift(a, m, b, n, 2).quality - s.quality) < 1e-9 AND in_key(a, a, m)) AS same
      FROM two JOIN shifts s ON s.v_pc = a AND s.v_mode = m AND s.b_pc = b AND s.b_mode = n AND most = 2""").first()
    assert got["n"] == got["same"] == len(two)


def test_asof_joins_do_not_depend_on_spans(spark):
    from beatlake.operators import joins

    rng = random.Random(6)
    points = [(k % 2, round(rng.uniform(-50, 50), 3)) for k in range(80)]
    lines = [(0, round(rng.uniform(-50, 50), 3)) for _ in range(12)] + [(1, 44.0)]
    p, g = (spark.createDataFrame(x, "take_id long, time_s double") for x in (points, lines))
    for span in (0.5, 7.0, 3600.0):
        near = {(r["take_id"], r["time_s"]): r["grid"]["time"] for r in joins.asof_nearest(p, g, "take_id", span=span).collect()}
        last = {(r["take_id"], r["time_s"]): r["grid"] and r["grid"]["time"] for r in joins.asof_backward(p, g, "take_id", span=span).collect()}
        for take, t in points:
            own = [x for k, x in lines if k == take]
            assert near[take, t] == min(own, key=lambda x: (round(abs(x - t), 9), x))
            assert last[take, t] == max((x for x in own if x <= t), default=None)


def test_a_take_that_nothing_passes_for_meets_the_whole_catalog(spark):
    from beatlake.operators import matching
    from beatlake.sources.fixtures import events

    sf = "/root/testdata/sf0.001"
    beats = events(spark, sf, "catalog").filter("bpm = 100")
    takes = spark.createDataFrame([(1, 74.0, 0, "major", 0.9, "rap", 3.0), (2, 100.0, 0, "major", 0.9, "sung", 3.0)], "take_id long, bpm double, key_pc int, key_mode string, key_confidence double, performance_type string, syllable_rate double")
    got = matching.candidates(takes, beats).groupBy("take_id").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n")).collect()
    by = {r["take_id"]: (r["level"], r["n"]) for r in got}
    assert by[1] == (6, beats.count()) and by[2][0] < 6
    assert matching.scored(matching.candidates(takes, beats)).filter("score is null").count() == 0


def test_tempo_readings_are_reconciled(spark):
    def got(*x):
        r = one(spark, music.reconciled_tempo(*map(F.lit, x)))
        return r["bpm"], r["confidence"], r["agreement"], r["alternates"]

    assert got(90.0, 0.5, 180.0, 0.8, 20)[:3] == (90.0, 0.85, "octave")
    assert got(90.0, 0.5, 91.0, 0.8, 20)[2] == "exact"
    assert got(90.0, 0.6, 117.0, 0.8, 20)[:3] == (90.0, 0.3, "disagree") and got(90.0, 0.6, 117.0, 0.8, 20)[3][0] == 117.0
    assert got(90.0, 0.6, 0.0, 0.0, 20)[:3] == (90.0, 0.45, "single")
    assert got(90.0, 0.6, 117.0, 0.8, 5)[:3] == (0.0, 0.0, "none")


def test_vibrato_is_measured(spark):
    import math

    note = lambda n, cents: [(1, n, k * 0.01, 60 + cents / 100 * math.sin(2 * math.pi * 5.5 * k * 0.01)) for k in range(200)]
    got = acoustics.note_vibrato(spark.createDataFrame(note(1, 50) + note(2, 3), "take_id long, note int, time_s double, midi double"), ["take_id", "note"]).orderBy("note").collect()
    assert got[0]["rate_hz"] == 5.5 and 40 < got[0]["depth_cents"] < 60
    assert got[1]["rate_hz"] is None and got[1]["depth_cents"] is None


def test_octave_jumps_are_undone(spark):
    rows = [(1, 0.0, 60.0, True), (1, 0.1, 72.0, True), (1, 0.2, 36.0, True), (1, 0.3, None, True), (1, 0.4, 0.0, False), (1, 0.5, 72.0, True), (2, 0.0, 48.0, True)]
    got = acoustics.octave_repair(spark.createDataFrame(rows, "take_id long, time_s double, midi double, voiced boolean"), "take_id").orderBy("take_id", "time_s").collect()
    assert [(r["take_id"], r["midi"]) for r in got] == [(1, 60.0), (1, 60.0), (1, 60.0), (1, 72.0), (2, 48.0)]


def test_folds_keep_keys_apart(spark):
    rows = spark.createDataFrame([(k % 3 if k % 3 else None, float(k)) for k in range(300)] + [(1, None)], "k long, x double")

    def add(state, x):
        total = (state or 0.0) + x
        return total, (total,)

    got = sequences.folded(rows, ["k"], add, "total").groupBy("k").agg(F.count("*").alias("n"), F.max("total").alias("total")).collect()
    assert {r["k"]: (r["n"], r["total"]) for r in got} == {i or None: (100, float(sum(range(i, 300, 3)))) for i in range(3)}
    assert sequences.folded(rows.filter("x < 0"), ["k"], add, "total").count() == 0


def test_octaves_are_continued_over_triggers(spark, tmp_path):
    """T5: a stream gives what W28 gives, also where a trigger ends within a voiced run."""
    rows = [(1 + k % 2, 1_700_000_000 + k, k / 10, None if k == 31 else 60.0 + 12 * (k % 5 == 0) + k % 3, k % 17 != 16) for k in range(80)]
    schema = "take_id long, at long, time_s double, midi double, voiced boolean"
    for k in range(4):
        spark.createDataFrame(rows[k * 20 : (k + 1) * 20], schema).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withWatermark("ts", "10 seconds")
    query = live.octave_continuity(stream).writeStream.format("memory").queryName("octaves").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = acoustics.octave_repair(spark.createDataFrame(rows, schema), "take_id")
    as_rows = lambda df: sorted((r["take_id"], r["time_s"], round(r["midi"], 9)) for r in df.collect())
    assert as_rows(spark.sql("SELECT take_id, time_s, midi FROM octaves")) == as_rows(want)


def test_late_frames_go_aside(spark, tmp_path):
    """A trigger's frames behind what earlier triggers saw, less the delay."""
    for k, seconds in enumerate([[100, 101], [95, 85, 130], [119, 121, None]]):
        frame = spark.createDataFrame([(1, s) for s in seconds], "take_id long, s long").select("take_id", F.timestamp_seconds("s").alias("ts")).coalesce(1)
        frame.write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("take_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = live.store_with_late(stream, str(tmp_path / "out"), 10.0).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    seconds = lambda name: sorted(str(r[0]) for r in spark.read.parquet(str(tmp_path / "out" / name)).select(F.unix_seconds("ts")).collect())
    assert seconds("late") == ["119", "85"] and seconds("in_time") == ["100", "101", "121", "130", "95", "None"]


def test_takes_of_a_stream_are_matched(spark, tmp_path):
    """Each trigger's takes get the matches that they get as a table."""
    from beatlake.operators import matching
    from beatlake.sources.fixtures import events

    takes, catalog = (events(spark, "/root/testdata/sf0.001", name) for name in ("takes", "catalog"))
    some = takes.filter("take_id <= 20").cache()
    for k in range(2):
        some.filter(F.col("take_id") % 2 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    found = []
    stream = spark.readStream.schema(some.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = live.live_match(stream, catalog, lambda df, batch_id: found.extend((r["take_id"], r["beat_id"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    want = matching.diversified(matching.scored(matching.candidates(some, catalog, 5)), 5)
    assert found and sorted(found) == sorted((r["take_id"], r["beat_id"]) for r in want.collect())


def test_render_notes_tell_each_change(spark):
    plan = {"bleed_db": F.lit(12.4), "hum_hz": F.array(F.lit(50.0), F.lit(100.0)), "separated": F.lit(True), "denoised": F.lit(True), "gain_db": F.lit(-3.0), "ratio": F.lit(0.98), "moved_s": F.lit(1.5), "section": F.lit("hook"), "entry_s": F.lit(8.04), "fit": F.lit("padded"), "beat_s": F.lit(60), "target_s": F.lit(72), "n_tuned": F.lit(0), "untuned_why": F.lit("spoken")}
    got = spark.range(1).select(music.render_notes(plan).alias("n"), music.render_notes({}).alias("none")).first()
    assert got["none"] == [] and [x.split(" by ")[-1] for x in got["n"][:1]] == ["12 dB"]
    assert got["n"][1:] == [
        "a hum at 50, 100 Hz was notched out of the vocal", "the voice was separated from the background noise under it", "the take was lowered by 3 dB to a working level",
        "the vocal was sped up by 2.00% to sit on the beat's tempo", "the vocal was moved +1.50 s so its first bar lands where the beat's hook arrives (8.0 s)",
        "the beat was padded with silence from 60 s to 72 s for the vocal's tail", "the pitch was left exactly as sung: spoken",
    ]


def test_best_with_evidence_is_exact_and_scores_kinds_once(spark, monkeypatch):
    """The best of all pairs by the whole score, for takes of one kind whose evidence differs; candidates are made for kinds alone."""
    from pyspark.sql import functions as F

    from beatlake.operators import matching
    from beatlake.sources.fixtures import events

    d = "/root/testdata/sf0.001"
    one = events(spark, d, "takes").filter("take_id = 7")
    takes = one.drop("take_id").crossJoin(spark.range(6).withColumnRenamed("id", "take_id")).select(*one.columns)
    catalog = events(spark, d, "catalog")
    vibes = (takes.select("take_id", F.when(F.col("take_id") > 0, F.array((F.col("take_id") - 3).cast("double"), F.lit(1.0))).alias("vibe")), catalog.select("beat_id", F.array((F.col("beat_id") % 7 - 3).cast("double"), F.lit(0.5)).alias("vibe")))
    words = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    moods = (takes.select("take_id", F.when(F.col("take_id") % 2 == 0, words("Dark")).otherwise(words()).alias("mood")), catalog.select("beat_id", F.when(F.col("beat_id") % 2 == 0, words("dark")).otherwise(words("calm")).alias("mood")))
    notes = takes.filter("take_id <> 5").select("take_id", (60 + F.col("take_id")).cast("double").alias("midi"), F.lit(0.5).alias("duration_s"))
    chords = catalog.filter("beat_id % 3 > 0").select(F.col("beat_id").alias("entity_id"), F.lit(0).alias("bar"), (F.col("beat_id") % 12).cast("int").alias("root"), F.lit("maj").alias("quality"))
    plain = matching.scored(matching.with_evidence(matching.candidates(takes, catalog), vibes, moods, notes, chords)).withColumn("score", matching.rounded("score", 6))
    keep = ["take_id", "beat_id", "rank", "score", "sub_vibe", "sub_metadata", "penalty_dissonance"]
    want = sorted(map(tuple, matching.top_matches(plain).select(*keep).collect()))
    asked, made = [], matching.candidates
    monkeypatch.setattr(matching, "candidates", lambda t, c, *a: asked.append(t.count()) or made(t, c, *a))
    got = sorted(map(tuple, matching.best_with_evidence(takes, catalog, vibes, moods, notes, chords).select(*keep).collect()))
    assert got == want and len({r[3] for r in got}) > 6
    assert asked == [1]
