"""Pairs of takes and beats: little work for each of them, none of it sorted or shuffled in vain, and the same results."""

import pytest
from pyspark.sql import functions as F

from beatlake.operators import matching
from beatlake.plans import QUERIES, match

SF = "/root/testdata/sf0.001"
#: Java doesn't compile methods of more bytes, so that each row of them costs some thirty times as much.
COMPILED = 8000


@pytest.fixture
def fixed_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_what_is_made_for_each_pair_is_compiled(spark, fixed_plans):
    found, _ = match.scored_kinds(spark, SF)
    code = found.select("take_id", "beat_id", "score")._jdf.queryExecution().debug().codegenToSeq()
    sizes = [code.apply(k)._3().maxMethodCodeSize() for k in range(code.size())]
    assert sizes and max(sizes) < COMPILED


@pytest.mark.parametrize("name", ["j02_all_pairs", "j02_score_pairs", "j01_candidates"])
def test_pairs_of_all_takes_are_not_shuffled(spark, fixed_plans, name):
    lines = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(k for k, x in enumerate(lines) if "Generate explode" in x)
    joins = [k for k, x in enumerate(lines) if k > at and "Join" in x]
    assert "BroadcastHashJoin [_kind" in lines[joins[0]]
    assert not [x for x in lines[: joins[1]] if "Exchange hashpartitioning" in x and "REPARTITION" not in x and "_part" not in x]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_rows_of_kinds_are_those_of_all_takes(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "BROADCAST_BYTES", most)
    by_kind = spark.range(12).selectExpr("id % 3 AS take_id", "id AS beat_id", "id / 4D AS score")
    members = spark.range(40).selectExpr("id AS take_id", "id % 4 AS _kind")
    want = sorted((t, b, b / 4) for t in range(40) for b in range(12) if t % 4 == b % 3)
    assert sorted(map(tuple, matching.for_all_takes(by_kind, members).collect())) == want


def test_the_best_of_many_are_the_best_of_all(spark):
    """With ties, and with takes of few beats."""
    rows = spark.range(3000).selectExpr("id % 7 AS take_id", "id AS beat_id", "(id * 37 % 11) / 10D AS score")
    rows = rows.union(spark.range(8).selectExpr("7 + id % 4", "id", "0.5D"))
    for n in (1, 5):
        got, want = matching.top_of_many(rows, n), matching.top_matches(rows, n)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_quick_rounding_is_rounding(spark):
    x = spark.range(200_001).select((F.col("id") * 5 / F.lit(1e6)).alias("x"))
    for places in (3, 4, 6):
        assert x.filter(matching.quick_rounded(F.col("x"), places) != matching.rounded("x", places)).count() == 0


def test_pairs_that_cannot_be_among_the_best_meet_no_vectors(spark, fixed_plans, monkeypatch):
    from beatlake.plans.extra import best_full_scores
    from beatlake.sources.fixtures import events

    monkeypatch.setattr(matching, "SEEDS", 8)
    met = []
    monkeypatch.setattr(matching, "top_of_many", lambda found, n: met.append(n) or matching.top_matches(found, n))
    got = best_full_scores(spark, SF)
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(k for k, x in enumerate(lines) if "CoGroups" in x)
    assert met == [8] and [x for x in lines[at:] if "_least" in x and "Filter" in x]
    best = got.groupBy("take_id").agg(F.count("rank").alias("n"), F.countDistinct("beat_id").alias("m")).filter("n = 5 AND m = 5").count()
    assert best == events(spark, SF, "takes").count()


def test_a_kind_scores_at_least_what_its_worst_take_does():
    import pyarrow as pa

    takes = pa.table({"_kind": [3, 3], "take_id": [1, 2], "vibe": pa.array([[1.0, 0.0], [0.0, 1.0]], pa.list_(pa.float32())), "mood": pa.array([[], []], pa.list_(pa.string())), "held": pa.array([None, [1.0] + [0.0] * 11], pa.list_(pa.float64()))})
    beats = pa.table({"_plain": [0.5, 0.6, 0.2], "_genre": [1.0, 1.0, 0.0], "is_atonal": [False, False, True], "shift": [0, 0, 0], "mask": pa.array([2, None, None], pa.int32()), "vibe": pa.array([[1.0, 0.0], [1.0, 0.0], None], pa.list_(pa.float32())), "mood": pa.array([[], [], []], pa.list_(pa.string()))})
    # The first take has 0.65, 0.75, 0.25; the second's note clashes with the first beat: 0.35, 0.70, 0.25.
    for n, want in ((1, 0.70), (2, 0.35), (3, 0.25), (4, float("-inf"))):
        got = matching._least(takes, beats, n).to_pylist()
        assert [r["take_id"] for r in got] == [3] and (got[0]["_least"] == want or abs(got[0]["_least"] - want) < 1e-9)
