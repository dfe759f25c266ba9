"""The registered queries of this subpackage: thin views of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatlake.llm import ann, audit, chat, digests, hmm, jaccard, licenses, mixing, packing, quality, repeats, resampling, warc
from beatlake.llm._shared import Scratch, is_fold, lean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return lean(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fitted(documents, table(spark, sf_dir, "labels"))
    scored = quality.scored(documents, model, keep=["doc_id"])
    return scored.select("doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    placed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sized = Scratch(spark, "sizes").table(documents.select("doc_id", "source", mixing.word_count().alias("size")))
    mix = mixing.mixed(sized)
    return mix.select("doc_id", "size", "mix.source_size", "mix.target", "mix.taken")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = f"{Scratch(spark, 'archives').root}/pages"
    warc.write_archives(table(spark, sf_dir, "pages"), archives, "page_id", "url", "html")
    read = warc.read_records(spark, archives)
    return read.select(F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_neighbours, op2_perspectives, op3_quality, op4_fingerprints, op5_packing, op6_licenses, op7_jaccard, op8_mixing, op9_repeats, op10_hmm, op11_resampling, op12_warc, op13_audit, pipeline)}
ORACLE_SQL = {"op2_perspectives": chat.PERSPECTIVES_SQL, "op6_licenses": licenses.SCAN_SQL, "op11_resampling": resampling.RESAMPLING_SQL, "op12_warc": warc.WARC_SQL, "op13_audit": audit.AUDIT_SQL}
