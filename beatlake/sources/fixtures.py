"""Adapters that read the star-schema tables as tables of musical events (all rows of them).

Each adapter is one SELECT in the dialect that Spark and the checking database share, with a few names filled in for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GENRES = ("trap", "drill", "hip_hop", "rnb", "pop", "afrobeats", "drum_and_bass", "lofi")

_LIST = ", ".join(f"'{g}'" for g in GENRES)
_SPARK = {"genre": lambda at: f"element_at(array({_LIST}), CAST({at} AS INT))", "micros": lambda ts: f"unix_micros(CAST({ts} AS TIMESTAMP))", "lines": "split(text, '\\n')",
          # Sums of doubles depend on the order of rows, so means are those of the file's order, whatever the partitions: running sums of a spillable window.
          "lines_of": "(SELECT *, " + ", ".join(f"sum({c}) OVER w AS {c}_sum" for c in ("l_discount", "l_quantity", "l_tax")) + " FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey ORDER BY _at ROWS UNBOUNDED PRECEDING))",
          "mean": lambda c: f"max_by({c}_sum, _at) / count({c})", "at": ", _at"}
_DUCK = {"genre": lambda at: f"list_extract([{_LIST}], CAST({at} AS INT))", "micros": lambda ts: f"epoch_us({ts})", "lines": "string_split(text, chr(10))",
         "lines_of": "{lineitem}", "mean": lambda c: f"avg({c})", "at": ""}


def _adapters(x: dict) -> dict[str, tuple[tuple[str, ...], str]]:
    return {
        "catalog": (("part",), f"""
SELECT p_partkey AS beat_id, p_name AS title, p_brand AS owner, {x['genre']('p_size % 8 + 1')} AS genre, CAST(60 + (p_partkey * 37) % 120 AS DOUBLE) AS bpm,
  CAST(p_partkey % 12 AS INT) AS key_pc, CASE WHEN p_size % 2 = 0 THEN 'major' ELSE 'minor' END AS key_mode, ((p_partkey * 13) % 100) / CAST(100 AS DOUBLE) AS key_confidence,
  p_partkey % 17 = 0 AS is_atonal, ((p_partkey * 29) % 100) / CAST(100 AS DOUBLE) AS pocket_score, ((p_partkey * 31) % 100) / CAST(100 AS DOUBLE) AS grid_stability,
  (p_partkey * 7) % 5000 AS play_count, p_size % 6 AS playlist_count, p_partkey % 11 = 0 AS has_vocal_content, (p_partkey % 40) / CAST(100 AS DOUBLE) AS vocal_content_ratio
FROM {{part}}"""),
        "takes": (("customer",), """
SELECT c_custkey AS take_id, CAST(60 + (c_custkey * 53) % 120 AS DOUBLE) AS bpm, CAST((c_custkey * 5) % 12 AS INT) AS key_pc, CASE WHEN c_nationkey % 2 = 0 THEN 'major' ELSE 'minor' END AS key_mode,
  ((c_custkey * 17) % 100) / CAST(100 AS DOUBLE) AS key_confidence,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'rap' WHEN 'MACHINERY' THEN 'melodic_rap' WHEN 'FURNITURE' THEN 'spoken' ELSE 'sung' END AS performance_type, ((c_custkey * 19) % 60) / CAST(10 AS DOUBLE) AS syllable_rate
FROM {customer}"""),
        "notes": (("lineitem", "orders"), f"""
SELECT o_custkey AS take_id, l_orderkey AS order_key, l_linenumber AS idx, CAST(48 + l_quantity / 2.0 + (l_discount - 0.05) * 4.0 AS DOUBLE) AS midi, CAST(0.05 + l_tax * 10.0 AS DOUBLE) AS duration_s{x['at']}
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"""),
        "onsets": (("events",), f"""
SELECT user_id AS take_id, event_id, ({x['micros']('ts')} - 1704067200000000) / CAST(86400000000 AS DOUBLE) AS time_s, value AS strength, event_type AS element FROM {{events}}"""),
        "level_frames": (("events",), f"""
SELECT user_id AS take_id, event_id, ({x['micros']('ts')} - 1704067200000000) / CAST(86400000000 AS DOUBLE) AS time_s, -60.0 + value / 3.0 AS rms_db, event_type = 'error' AS clipped, event_type <> 'view' AS is_voice FROM {{events}}"""),
        "chords": (("orders",), """
SELECT o_custkey AS entity_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS bar, CAST(o_orderkey % 12 AS INT) AS root,
  CASE o_orderstatus WHEN 'F' THEN 'maj' WHEN 'O' THEN 'min' ELSE 'dim' END AS quality FROM {orders}"""),
        "sections": (("orders",), """
SELECT o_custkey AS entity_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'hook' WHEN '2' THEN 'verse' WHEN '3' THEN 'bridge' WHEN '4' THEN 'prehook' ELSE 'intro' END AS label FROM {orders}"""),
        "lines": (("documents",), f"SELECT doc_id AS entity_id, lang, {x['lines']} AS lines FROM {{documents}}"),
        "phrases": (("conversations",), "SELECT conv_id AS take_id, turn AS idx, role, text FROM {conversations}"),
        "renders": (("lineitem",), f"""
SELECT l_orderkey AS render_id, -2 + 20 * {x['mean']('l_discount')} AS true_peak_db, -8 - {x['mean']('l_quantity')} / 10 AS lufs, max(l_tax) * 50 AS mono_loss_db, {x['mean']('l_tax')} / 4 AS clip_pct,
  max(l_linenumber) / CAST(2 AS DOUBLE) AS gap_s, count(*) AS n_attempts FROM {x['lines_of']} GROUP BY l_orderkey"""),
    }


SPARK_ADAPTERS, DUCK_ADAPTERS = _adapters(_SPARK), _adapters(_DUCK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place of each row in its files, `_at`."""
    return table(spark, sf_dir, name).selectExpr("*", "struct(_metadata.file_name AS file, _metadata.row_index AS row) AS _at")


def events(spark: SparkSession, sf_dir: str, name: str, at: bool = False) -> DataFrame:
    """A table of musical events; notes also have `_at`, their place in the file, if that is asked for."""
    tables, sql = SPARK_ADAPTERS[name]
    found = spark.sql(sql, **{t: placed(spark, sf_dir, t) if t == "lineitem" else table(spark, sf_dir, t) for t in tables})
    return found if at else found.drop("_at")


def as_cte(*names: str) -> str:
    """WITH clauses of the same adapters for the checking database."""
    made = ", ".join(f"{n} AS ({DUCK_ADAPTERS[n][1].format(**{t: t for t in DUCK_ADAPTERS[n][0]})})" for n in names)
    return f"WITH {made}"
