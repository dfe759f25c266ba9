"""Document fingerprints: a quartile bucket digest and its bounded difference score.

Every window of five bytes gives the byte triplets that hold its newest byte; each is hashed to one of 256 buckets. A
fingerprint is hexadecimal text: a length code (a logarithm), two ratios of the quartiles of the bucket counts, and for each
bucket in two bits the quartile that its count is in. The likeness of two fingerprints is 1 less their difference, which is
measured against that of unrelated texts and bounded by it.

Defined results: null is the empty text, whose fingerprint has length code 0 and all buckets in the lowest quartile; texts
of fewer than three bytes differ in their length code only; equal texts have equal fingerprints; rows with one id are taken in
the order of a hash of their texts, and null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm._shared import mix64, slices, text_or_empty, utf8_block

BUCKETS = 256
#: The triplets of a window, as bytes before its newest.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Base of the logarithm of the length code.
LENGTH_BASE = 1.1
#: Difference of bucket codes that unrelated texts have on the average: 1.25 of 3 for each bucket.
UNRELATED = 1.25 * BUCKETS
#: What one step of the length code and of a ratio count for, in bucket steps; and the most that each may count.
LENGTH_STEP, RATIO_STEP, HEADER_MOST = 1.0, 2.0, 24.0

_TABLES = (mix64(np.arange(len(TRIPLETS) * 3 * 256, dtype=np.uint64)) >> np.uint64(56)).astype(np.uint8).reshape(len(TRIPLETS), 3, 256)


def bucket_codes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Codes of all documents of a block: length code, two ratios, then a quartile for each bucket (uint8)."""
    n = len(offsets) - 1
    counts = np.zeros((n + 1) * BUCKETS, dtype=np.int64)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int32), lengths) * BUCKETS
    for (i, j), (a, b, c) in zip(TRIPLETS, _TABLES):
        if len(data) <= j:
            continue
        where = row[j:] + (a[data[j:]] ^ b[data[j - i : len(data) - i]] ^ c[data[: len(data) - j]])
        for k in range(j):  # windows don't begin before the document
            early = offsets[:-1][lengths > k] + k
            where[early[early >= j] - j] = n * BUCKETS
        counts += np.bincount(where, minlength=len(counts))
    counts = counts[: n * BUCKETS].reshape(n, BUCKETS)
    q = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1), axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    out = np.zeros((n, BUCKETS + 3), dtype=np.uint8)
    out[:, 0] = np.minimum(255, np.floor(np.log1p(lengths) / np.log(LENGTH_BASE)))
    top = np.maximum(q[:, 2], 1)
    out[:, 1], out[:, 2] = q[:, 0] * 15 // top, q[:, 1] * 15 // top
    for k in range(3):
        out[:, 3:] += counts > q[:, k : k + 1]
    return out


def as_text(codes: np.ndarray) -> list[str]:
    """Hexadecimal fingerprints of codes."""
    body = codes[:, 3:].reshape(len(codes), -1, 4)
    packed = (body[:, :, 0] << 6 | body[:, :, 1] << 4 | body[:, :, 2] << 2 | body[:, :, 3]).astype(np.uint8)
    whole = np.hstack([codes[:, :1], (codes[:, 1:2] << 4 | codes[:, 2:3]).astype(np.uint8), packed])
    return [x.tobytes().hex() for x in whole]


def from_text(fingerprints: list[str]) -> np.ndarray:
    """Codes of hexadecimal fingerprints."""
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint8).reshape(len(fingerprints), -1)
    body = np.stack([raw[:, 2:] >> 6, raw[:, 2:] >> 4 & 3, raw[:, 2:] >> 2 & 3, raw[:, 2:] & 3], axis=2).reshape(len(raw), -1)
    return np.hstack([raw[:, :1], raw[:, 1:2] >> 4, raw[:, 1:2] & 15, body])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the bounded difference of codes, row by row; 1 for equal ones, about 0 for unrelated ones."""
    apart = np.abs(a.astype(np.int16) - b)
    header = np.minimum(HEADER_MOST, LENGTH_STEP * apart[:, 0]) + np.minimum(HEADER_MOST, RATIO_STEP * (apart[:, 1] + apart[:, 2]))
    return 1.0 - np.minimum(1.0, (apart[:, 3:].sum(axis=1) + header) / (UNRELATED + 2 * HEADER_MOST))


def codes_of(texts: list[str]) -> np.ndarray:
    """Codes of Python texts."""
    return bucket_codes(*utf8_block(pa.array(texts, pa.large_string())))


def fingerprints(documents: DataFrame, text_column: str = "text", name: str = "fingerprint") -> DataFrame:
    """documents with a fingerprint column (any column of that name is replaced)."""
    kept = [c for c in documents.columns if c.lower() != name.lower()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, 2 << 20):
            column = batch.column(batch.schema.names.index(text_column))
            yield batch.append_column(name, pa.array(as_text(bucket_codes(*utf8_block(column))), pa.string()))

    slim = documents.select(*kept)
    return slim.mapInArrow(digest, T.StructType([*slim.schema.fields, T.StructField(name, T.StringType())]))


def with_next(documents: DataFrame) -> DataFrame:
    """_bucket, _extra, doc_id and text dealt so that every document can be read beside the next one, descending doc_id.

    Ids are cut into ranges; each range also gets the first document of the range that follows it, the last one that of
    the first. The cuts and these first ids are as many as the ranges, whatever the number of documents. Ids must be of an
    integral type, as ranges are cut between numbers; rows that share an id follow each other by a hash of their texts.
    """
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be of an integral type: documents follow each other by its numbers")
    spark = documents.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [int(x) for x in documents.select(key.alias("_key")).approxQuantile("_key", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))]
    # An id that many rows share (or lack) fills whole ranges: its rows are dealt by the hash that orders them.
    often = {x: n for x in set(cuts) if (n := cuts.count(x)) > 1}
    hashed = F.when(key.isin(*often), F.xxhash64(text_or_empty())).otherwise(F.lit(0)) if often else F.lit(0).cast("long")
    edges = [(x, step) for x in sorted(set(cuts)) for step in range(often.get(x, 1))]
    # Ranges in ascending order of (id, descending hash): an id's own ranges are equal steps of the hash.
    steps = F.create_map(*(F.lit(v) for x, n in often.items() for v in (x, n))) if often else None
    first_of = np.array([k for k, (_, step) in enumerate(edges) if step == 0], dtype=np.int64)
    shared = spark.sparkContext.broadcast((np.array(sorted(set(cuts)), dtype=np.int64), first_of, len(edges)))

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        values, starts, n = shared.value
        at = np.searchsorted(values, ids.to_numpy(), side="left")
        return pd.Series(np.append(starts, n)[at]).astype("int32")

    bucket = F.lit(len(edges)) - range_of("_key")
    if often:
        # Hashes ascend, so of an id's n ranges the least hashes have the last (the bucket read first).
        within = F.floor((F.col("_hash") / F.lit(2.0**64) + 0.5) * steps[F.col("_key")]).cast("int")
        last = steps[F.col("_key")] - 1
        bucket = bucket - F.coalesce(last - F.least(within, last), F.lit(0))
    placed = documents.select("doc_id", text_or_empty().alias("text"), key.alias("_key"), hashed.alias("_hash")).withColumn("_bucket", bucket.cast("int"))
    head = F.max(F.struct("_key", F.bitwise_not("_hash").alias("_not")))
    heads = [(r["_bucket"], r["_head"]["_key"], ~r["_head"]["_not"]) for r in placed.groupBy("_bucket").agg(head.alias("_head")).orderBy("_bucket").collect()]
    to = [(heads[k - 1][0], x, h) for k, (_, x, h) in enumerate(heads)]  # the first range's head goes to the last range
    extra = spark.createDataFrame(to, "_to int, _head long, _least long")
    met = placed.join(F.broadcast(extra), (F.col("_key") == F.col("_head")) & (F.col("_hash") == F.col("_least")))
    # Of rows that share an id the one with the least hash follows; rows beyond the first of a range say nothing.
    first = met.select(F.col("_to").alias("_bucket"), F.lit(1).alias("_extra"), "_key", "doc_id", "text")
    own = placed.select("_bucket", F.lit(0).alias("_extra"), "_key", "doc_id", "text")
    return own.unionByName(first).repartition("_bucket").sortWithinPartitions("_bucket", "_extra", F.desc("_key"), F.xxhash64("text"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text (its later half replaced by the beginning of the next document), and
    how like the fingerprint is to the edited text's and to the next document's. Null texts are empty; ids are integers, a null
    one comes last; an empty table gives no rows."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in slices(batches, "text", 2 << 20):
            for bucket, extra, _, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None:
                    yield *held, text
                held = None if extra else (doc_id, text)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        kind_ = None

        def made() -> pa.RecordBatch:
            texts, own = [], []
            for _, text, following in rows:  # a document that follows is most often the next row's own
                if not texts or texts[-1] is not text:
                    texts.append(text)
                own.append(len(texts) - 1)
                texts.append(following)
            own = np.array(own)
            edited = [text[: len(text) - len(text) // 2] + following[: len(text) // 2] for _, text, following in rows]
            codes, after = codes_of(texts), codes_of(edited)
            mine = codes[own]
            digests = as_text(codes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], kind_), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array([digests[k] for k in own]), pa.array(as_text(after)), pa.array(likeness(mine, after)), pa.array(likeness(mine, codes[own + 1])),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind_
            for batch in batches:
                kind_ = batch.schema.field("doc_id").type
                yield batch

        for row in pairs(watched()):
            rows.append(row)
            size += len(row[1])
            if size > 2 << 20:
                yield made()
                rows, size = [], 0
        if rows:
            yield made()

    return with_next(documents).mapInArrow(compare, schema)
