"""Every registered query with SQL gives what the SQL gives, on the smallest tables; the others run; plans don't depend on partitions."""

import duckdb
import pytest

import __spark_entry__ as entry
from beatlake.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 4)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_its_sql(spark, con, name):
    rel = con.sql(ORACLE_SQL[name])
    cols = sorted(rel.columns)
    want = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_all_scored_pairs_are_returned(spark):
    from beatlake.operators import matching
    from beatlake.sources.fixtures import events

    want = {tuple(r) for r in matching.candidates(events(spark, SF, "takes"), events(spark, SF, "catalog")).select("take_id", "beat_id").collect()}
    got = [tuple(r) for r in QUERIES["j02_all_pairs"](spark, SF).select("take_id", "beat_id").collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(a % 10 != b % 10 for a, b in got)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["j09_asof_nearest", "w06_phrases", "a22_take_report"])
def test_partitions_do_not_matter(spark, name):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            return sorted(map(repr, QUERIES[name](spark, SF).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert rows(1) == rows(8)
