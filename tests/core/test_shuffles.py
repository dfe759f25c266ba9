"""Steps whose rows outgrow Spark's estimates: what is exploded never goes through the driver, and what is read again is written once."""

import re

from pyspark.sql import functions as F

from beatlake.operators import harmony, joins, planning, sequences


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_sides_are_not_broadcast(spark, monkeypatch):
    onsets = spark.range(40).selectExpr("id % 2 AS take_id", "id AS event_id", "id / 8D AS time_s", "50 AS strength")
    grid = spark.range(40).selectExpr("id % 2 AS take_id", "id / 4D AS time_s")
    seen = []

    def parts(rows, *_):
        seen.append(rows)
        return rows.withColumn("_part", F.lit(0.0))

    monkeypatch.setattr(joins, "parts", parts)
    planning.assign_onsets(onsets, grid, "take_id", 0.25)
    spans = spark.range(4).selectExpr("id % 2 AS take_id", "id * 2D AS start_s", "id * 2D + 2 AS end_s")
    a, b = (spans.withColumnsRenamed({"start_s": f"{x}_start", "end_s": f"{x}_end"}) for x in "ab")
    for df in (seen[0], joins.interval_join(onsets, spans, "take_id"), joins.overlap_join(a, b, "take_id")):
        assert "Broadcast" not in plan(df)


def sorts(df, *of):
    return [x for x in plan(df).splitlines() if " Sort [" in x and all(o in x for o in of)]


def test_rows_around_a_point_take_one_sort(spark):
    points = spark.range(8).selectExpr("id % 2 AS take_id", "id / 2D AS time_s")
    grid = spark.range(8).selectExpr("id % 2 AS take_id", "double(id) AS time_s")
    got = joins.between(points, grid, "take_id", "time_s", [])
    assert len(sorts(got, "_kind")) == 1
    rows = {(r["take_id"], r["time_s"]): (r["_before"] and r["_before"]["time"], r["_after"] and r["_after"]["time"]) for r in got.filter("_kind = 1").collect()}
    assert rows[0, 2.0] == (2.0, 2.0) and rows[0, 1.0] == (0.0, 2.0) and rows[1, 0.5] == (None, 1.0) and rows[1, 3.5] == (3.0, 5.0)


def test_levels_take_one_sort(spark):
    labels = ["hook", "verse", "verse", None, "hook", "chorus", "bridge", "verse", "hook"]
    songs = spark.createDataFrame([(1, k, x) for k, x in enumerate(labels)], "entity_id long, seq long, label string")
    got = sequences.energy_levels(songs, "entity_id")
    assert len(sorts(got)) == 1
    energy = [r["energy"] for r in got.orderBy("seq").collect()]
    assert energy[0] < energy[4] < energy[8] and energy[1] < energy[7]


def test_performance_reads_its_notes_from_what_it_wrote(spark):
    from beatlake.plans import QUERIES

    got = plan(QUERIES["q05_performance_notes"](spark, "/root/testdata/sf0.001"))
    assert "lineitem.parquet" not in got and "/stored-" in got


def test_votes_of_lags_are_shuffled_once(spark):
    onsets = spark.range(40).selectExpr("id % 2 AS take_id", "id * 0.37D AS time_s")
    got = planning.best_lag(onsets, onsets.withColumn("time_s", F.col("time_s") + 0.7), "take_id")
    assert not re.search(r"hashpartitioning\([^)]*bin", plan(got))
    assert {r["take_id"]: round(r["lag_s"], 2) for r in got.collect()} == {0: 0.69, 1: 0.69}  # the least of three equal bins


def test_votes_of_lags_are_counted_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(planning, "BLOCK", 64)
    dice = random.Random(5)
    rows = [(k, x, dice.uniform(0, 90) if dice.random() < 0.7 else dice.randrange(180) / 2 + 0.005) for k in (1, 2, None) for x in range(60)] + [(1, 98, None), (1, 99, float("nan")), (3, 0, 5.0)]
    a = spark.createDataFrame(rows, "take_id long, event_id long, time_s double").drop("event_id")
    b = a.withColumn("time_s", F.col("time_s") + 0.7)
    df = planning.best_lag(a, b, "take_id")
    assert not [x for x in plan(df).splitlines() if "bin" in x and ("Aggregate" in x or "Generate" in x)]  # neither bins nor pairs are rows
    a.createOrReplaceTempView("lag_a")
    votes = spark.sql("SELECT x.take_id, int(round((y.time_s + 0.7D - x.time_s) / 0.01D)) AS bin, count(*) AS n FROM lag_a x JOIN lag_a y ON x.take_id = y.take_id AND abs(y.time_s + 0.7D - x.time_s) <= 20 GROUP BY 1, 2").collect()
    want = {}
    for take in {v["take_id"] for v in votes}:
        n = {}
        for v in votes:
            for j in (-1, 0, 1):
                if v["take_id"] == take:
                    n[v["bin"] + j] = n.get(v["bin"] + j, 0) + v["n"]
        best = min(n, key=lambda k: (-n[k], abs(k), k))
        rest = [n[k] for k in n if abs(k - best) * 0.01 > 0.15]
        want[take] = (best * 0.01, n[best] / max(rest) if rest else None)
    assert {r["take_id"]: (r["lag_s"], r["lag_ratio"]) for r in df.collect()} == want and len(want) == 3


def test_scores_of_keys_are_no_rows(spark):
    chords = [(1, bar, 0 if bar < 20 else 6, "maj" if bar % 2 else "?", 2.0) for bar in range(40)] + [(1, 40, None, "maj", 2.0), (1, 41, 6, None, None), (2, 0, None, None, 1.0), (None, 0, 3, "min", 0.0)]
    df = harmony.modulations(spark.createDataFrame(chords, "song long, bar long, root int, quality string, duration_s double"), "song")
    assert "Join" not in plan(df) and "Window" not in plan(df)  # chords were multiplied by 24 keys before
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert [r[3] for r in got if r[0] == 1] == [0, 6]
    assert [r[:3] for r in got if r[0] != 1] == [(2, 0, 1), (None, 0, 1)]


def test_documents_by_status_are_not_sorted(spark, tmp_path):
    from beatlake.sources import catalog_io

    def written(n):
        rows = spark.range(100).selectExpr("string(id) AS beat_id", f"concat('s', id % {n}) AS status")
        catalog_io.write_documents(rows, str(tmp_path / f"by{n}"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        said = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
        got = spark.read.json(str(tmp_path / f"by{n}"))
        assert sorted((r["beat_id"], r["status"]) for r in got.collect()) == sorted((r["beat_id"], r["status"]) for r in rows.collect())
        return said

    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    said = written(3)
    assert "InsertIntoHadoopFsRelationCommand" in said and "Sort" not in said
    written(catalog_io.OPEN_FILES + 5)  # more statuses than files held open
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_composed_queries_join_parts_that_are_written(spark):
    from beatlake.plans import jobs

    base = spark.range(3).withColumnRenamed("id", "take_id")
    got = plan(jobs._joined(spark, "/root/testdata/sf0.001", base, ("take_id",), {"a22_take_report": {"grade": "grade"}, "w08_performance_span": {"start_s": "start_s"}}))
    assert "Window" not in got and "events.parquet" not in got and got.count("/stored-") == 2


def test_lyrics_go_through_no_shuffle(spark, tmp_path):
    from beatlake.plans import QUERIES

    rows = [(1, "aaaaa bbbbb\n\nccccccc dd", "en"), (2, None, "en"), (3, "", "en"), (4, "a " * 30 + "eeeee\nffffff", "en"), (1, "ggggg", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    words, starts = (QUERIES[q](spark, str(tmp_path)) for q in ("f11_words_of", "f11_line_starts"))
    for df in (words, starts):
        before = plan(df).split("Exchange")[-1]  # what is below the shuffle
        assert "Generate" not in plan(df) and "collect_list" not in plan(df) and "partial_sum" in before
    assert sorted(tuple(r) for r in words.collect()) == [(1, 4, 8.25, 0.0, 8.0), (3, 0, 0.0, None, None), (4, 2, 11.5, 4.0, 7.5)]
    assert sorted(tuple(r) for r in starts.collect()) == [(1, 3, 8.0), (3, 0, 0.0), (4, 2, 11.5)]


def test_starts_go_to_slots_without_the_rest_of_their_notes(spark):
    from beatlake.plans import QUERIES

    asked = QUERIES["w31_time_targets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    points = [x for x in asked.splitlines() if "AS _point" in x and "order_key" in x and "null AS _point" not in x]
    assert points and not any("midi" in x or "spread_cents" in x or "time_s, time_s" in x for x in points)
