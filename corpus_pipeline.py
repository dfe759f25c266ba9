"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents.

quality -> near duplicates -> repeated passages -> source mix -> packed sequences. Part of beatlake.llm.

In all stages a null text is an empty one, rows that share an id (or have none) are documents of their own, an empty table gives an
empty result, and columns other than COLUMNS are left out; no stage holds more than a document's text and a batch.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatlake.llm import jaccard, mixing, packing, quality, repeats
from beatlake.llm._shared import Scratch, lean

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good. It learns from all labels of these documents outside the
    fold that op3_quality holds out. Empty texts are scored like others; without any labels all scores are a half, and none is good.
    Equal texts have equal scores, so copies stay or go together."""
    model = quality.fitted(docs, lean(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_only(docs.select(COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id, a null one last) of each class of near duplicates; of repeated rows one. Texts without words
    have no copies and stay."""
    lean(spark)
    return jaccard.one_of_each(docs.select(COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their passages of over 50 words that start elsewhere too. A document of which no word is left goes; one that had
    none stays as it is. Of equal passages none is kept, as the pipeline's input has no near copies left."""
    lean(spark)
    cut = repeats.without_passages(docs.select(COLUMNS))
    left, touched = F.col("repeats.kept"), F.col("repeats.n_removed") > 0
    kept = cut.filter(~touched | (F.col("repeats.n_removed") < F.col("repeats.n_words")))
    return kept.withColumns({"text": F.when(touched, left).otherwise(F.col("text")), "n_chars": F.when(touched, F.length(left).cast("long")).otherwise(F.col("n_chars"))}).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, once, or up to three times. A null source is one of its own; texts
    without words are never taken. Ties fall by hashes of ids and rows, so reruns agree."""
    lean(spark)
    mixed = mixing.mixed(docs.select(*COLUMNS, mixing.word_count().alias("size")))
    return mixed.withColumn("_copy", F.explode(F.expr("sequence(1, int(mix.copies))"))).filter("_copy <= mix.copies and mix.copies > 0").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 1024 tokens. An empty text is one piece, its end token; copies
    are packed each."""
    lean(spark)
    placed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality", keep_good), ("near duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("mix", mix), ("packing", pack)]

#: Learned scores, a random mix and tokens can't be told in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
