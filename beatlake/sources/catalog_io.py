"""Reading, keying, refreshing and writing documents of tracks and takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "2.2.0"
#: Files that a task may hold open when it writes documents by status.
OPEN_FILES = 8
AUDIO = ("aac", "aif", "aiff", "flac", "m4a", "mp3", "ogg", "opus", "wav")

DOCUMENT = (
    "beat_id string, serial string, _id struct<`$oid`:string>, title string, owner string, genre string, mood array<string>, bpm double, bpm_confidence double, key struct<pc:int,mode:string>, key_confidence double, "
    "is_atonal boolean, pocket_score double, grid_stability double, swing_ratio double, duration_s double, has_vocal_content boolean, vocal_content_ratio double, play_count long, playlist_count long, active boolean, sale_status string, "
    "status string, version string, bar_anchor string, backends map<string,string>, beats array<double>, downbeats array<double>, chords array<struct<time:double,root:int,quality:string>>, sections array<struct<start:double,end:double,label:string,energy:double>>, analyzed_at string"
)
TAKE = (
    "take_id string, bpm double, bpm_confidence double, key struct<pc:int,mode:string>, key_confidence double, key_candidates array<struct<pc:int,mode:string,score:double>>, performance_type string, syllable_rate double, duration_s double, status string, version string, "
    "onsets array<double>, notes array<struct<start:double,end:double,midi:double,spread_cents:double>>, phrases array<struct<start:double,end:double>>, backends map<string,string>, _corrupt_record string"
)
#: Ranks of analysis backends by stage, in the order in which stages are asked; one that isn't recorded has rank -1.
RANKS = {"rhythm": {"basic": 0, "library": 1, "neural": 2}, "pitch": {"basic": 0, "library": 1, "neural": 2}, "separation": {"none": 0, "basic": 1, "neural": 2}}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Track documents as they are; tempo 0 is unknown."""
    return spark.read.schema(DOCUMENT).json(path).withColumn("bpm", F.when(F.col("bpm") > 0, F.col("bpm")))


def read_catalog(spark: SparkSession, path: str, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """Current documents, and counts of stale and failed ones."""
    every = read_documents(spark, path)
    current = (F.col("status") == "ok") & (F.col("version") == version)
    return every.filter(current), every.filter(~F.coalesce(current, F.lit(False))).groupBy("status", "version").count()


def read_takes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Readable take documents, and the others' text."""
    every = spark.read.schema(TAKE).option("mode", "PERMISSIVE").json(path)
    return every.filter("take_id is not null").drop("_corrupt_record"), every.filter("take_id is null").select("_corrupt_record")


def explode_documents(documents: DataFrame, by: str, field: str) -> DataFrame:
    """S3: one array of a document as a table: by, idx and the fields of its items (or `value`)."""
    rows = documents.select(by, F.posexplode(field).alias("idx", "x"))
    return rows.select(by, "idx", "x.*") if "struct" in rows.schema["x"].dataType.simpleString()[:6] else rows.select(by, "idx", F.col("x").alias("value"))


def implode(table: DataFrame, by: str, name: str) -> DataFrame:
    """S3: such a table as an array of each entity again, in order."""
    fields = [c for c in table.columns if c not in (by, "idx")]
    items = F.sort_array(F.collect_list(F.struct("idx", *fields)))
    return table.groupBy(by).agg(F.transform(items, lambda x: x[fields[0]] if fields == ["value"] else F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def content_key(content: Column, version: str = VERSION) -> Column:
    """24 digits of the digest of version and bytes."""
    return F.substring(F.sha2(F.concat(F.encode(F.lit(version), "utf-8"), content), 256), 1, 24)


def keyed_assets(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """Files by content; equal ones are one row, under the least path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", content_key(F.col("content"), version).alias("content_key")).groupBy("content_key").agg(F.min("path").alias("path"))


def list_assets(spark: SparkSession, path: str, extensions: tuple[str, ...] = AUDIO) -> DataFrame:
    """Audio files of a folder, in order of path; contents aren't read."""
    name = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").filter(name.isin(*extensions)).orderBy("path")


def join_metadata(assets: DataFrame, sidecar: DataFrame) -> DataFrame:
    """A sidecar row by file name, else by stem. sidecar: file and other columns."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    fields = [c for c in sidecar.columns if c != "file"]
    packed = sidecar.groupBy("file").agg(F.min(F.struct(*fields)).alias("_m"))
    a = assets.withColumns({"file_name": name, "_stem": stem})
    a = a.join(packed.withColumnsRenamed({"file": "file_name", "_m": "_by_name"}), "file_name", "left").join(packed.withColumnsRenamed({"file": "_stem", "_m": "_by_stem"}), "_stem", "left")
    return a.withColumn("_m", F.coalesce("_by_name", "_by_stem")).select(*assets.columns, "file_name", *(F.col(f"_m.{f}").alias(f) for f in fields))


def derive_id(df: DataFrame) -> Column:
    """Beat-serial, else the database id, else the stem of file_name."""
    has = set(df.columns)
    col = lambda name: F.col(name) if name in has else F.lit(None).cast("string")
    database = F.col("_id.$oid") if "_id" in has else F.lit(None).cast("string")
    return F.coalesce(F.concat(F.lit("beat-"), F.nullif(F.trim(col("serial")), F.lit(""))), database, F.regexp_replace(col("file_name"), r"\.[^.]*$", ""))


def refresh_plan(assets: DataFrame, documents: DataFrame, now: dict[str, str], separate: bool = False, version: str = VERSION) -> DataFrame:
    """content_key and why its document must be redone: missing, version, bar_anchor, or a stage whose backend now outranks
    the recorded one (separation only if wanted). Never a downgrade."""
    recorded = documents.select("content_key", "version", "bar_anchor", "backends", F.lit(True).alias("_has"))
    x = assets.join(recorded, "content_key", "left")
    reason = F.when(F.col("_has").isNull(), "missing").when(~F.col("version").eqNullSafe(F.lit(version)), "version").when(F.col("bar_anchor").isNull(), "bar_anchor")
    for stage, ranks in RANKS.items():
        if stage in now and (stage != "separation" or separate):
            table = F.create_map(*(F.lit(v) for kv in ranks.items() for v in kv))
            reason = reason.when(F.lit(ranks.get(now[stage], -1)) > F.coalesce(table[F.col("backends")[stage]], F.lit(-1)), stage)
    return x.select(*assets.columns, reason.alias("reason")).filter("reason is not null")


def write_documents(df: DataFrame, path: str, kind: str = "json") -> None:
    """One document per entity, by status; failed ones keep their reason and never stop the others."""
    rows = df if "status" in df.columns else df.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
    # With a file open for each of a few statuses, tasks don't sort their documents by status; more statuses than that are sorted.
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    was = conf.get(name)
    conf.set(name, max(int(was), OPEN_FILES))
    try:
        rows.write.mode("overwrite").partitionBy("status").format(kind).save(path)
    finally:
        conf.set(name, was)


def catalog_summary(documents: DataFrame) -> DataFrame:
    """The listing: no heavy arrays, only their sizes."""
    return documents.select("beat_id", "title", "owner", "genre", "bpm", "key", "duration_s", "pocket_score", F.size("beats").alias("n_beats"), F.size("chords").alias("n_chords"), F.size("sections").alias("n_sections"))


def brief(documents: DataFrame, downbeats: int = 64) -> DataFrame:
    """A beat's brief, with its first bar lines."""
    return documents.select("beat_id", "title", "bpm", "key", F.slice("downbeats", 1, downbeats).alias("downbeats"))


def score_rows(targets: DataFrame, per_quarter: int = 480) -> DataFrame:
    """Notes as ticks: take_id, bpm, start_s, end_s, midi."""
    ticks = lambda name: F.bround(F.col(name) * F.col("bpm") / 60 * per_quarter).cast("long")
    return targets.filter("bpm > 0").select("take_id", ticks("start_s").alias("tick"), F.greatest(F.lit(1), ticks("end_s") - ticks("start_s")).alias("length"), F.bround("midi").cast("int").alias("pitch"))


def lineage(df: DataFrame, by: str, stage: str, method: str) -> DataFrame:
    """Rows of the processing log."""
    return df.select(F.col(by).alias("entity_id"), F.lit(stage).alias("stage"), F.lit(method).alias("method"), F.current_timestamp().alias("at"))


def catalog_update(current: DataFrame, new: DataFrame, by: str = "content_key") -> DataFrame:
    """Current documents with new ones in their place."""
    return current.join(new.select(by), by, "left_anti").unionByName(new)
