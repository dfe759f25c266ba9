"""Importance resampling of documents towards a target: bucket gains, Gumbel scores, and ranks by a distributed radix sort.

Words are counted by hashed bucket in the documents and in the target texts; a bucket's gain is the log ratio of its two
smoothed rates. A document's weight is the mean gain of its words; a Gumbel term drawn from a hash of its id makes the greatest
scores a sample without replacement in proportion to exp(weight). Ranks come from an LSD radix sort over Spark: each pass
counts a digit by block, turns the counts into global prefix offsets, and sends every row to the place that its block's offset
and its order among the block's equal digits give it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from beatlake.llm._shared import Scratch, collect_model, cut_between_words, cut_model, free_name, model_rows, slices, sum_models, text_or_empty, trim, utf8_block, word_spans

#: Hashed buckets, the seed of the draw, the least words of a document that can be drawn, and the share drawn in hundredths.
BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bits of a digit, and rows of a block: a pass has at most rows / BLOCK x 2 ** DIGIT_BITS counts, a sixteenth of the rows.
DIGIT_BITS, BLOCK = 10, 1 << 14

#: Bytes of words: digits, letters, and all of what isn't ASCII; and every byte with A-Z lowered.
IN_FEATURE = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
#: Words of more bytes are hashed one by one.
LONG_WORD = 32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each data[start:end], a byte of all words at a time."""
    lengths = ends - starts
    short = np.minimum(lengths, LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(LONG_WORD + 1 - short, kind="stable")
    at, state = starts[order], np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    longer = len(short) - np.cumsum(np.bincount(short, minlength=LONG_WORD + 2))  # words of more than k bytes
    for k in range(LONG_WORD):
        n = int(longer[k])
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(starts), dtype=np.uint32)
    out[order] = ~state
    for k in np.flatnonzero(lengths > LONG_WORD):
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


def buckets_of(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all words of some texts, block by block, with each text's first word in the block (texts + 1)."""
    offsets, data = utf8_block(column)
    for at, some in cut_between_words(offsets, data, IN_FEATURE):
        some = LOWER[some]
        starts, ends, first = word_spans(at, some, IN_FEATURE)
        yield crc32_of(some, starts, ends) % buckets, first


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many words of all texts fall into each bucket (counts that tasks add up first; null texts have no words)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets)
        for batch in slices(batches, "text"):
            for found, _ in buckets_of(batch.column(0), buckets):
                total += np.bincount(found, minlength=buckets)
        yield model_rows(cut_model(total, buckets))

    return collect_model(sum_models(texts.select(text_or_empty(text).alias("text")).mapInArrow(count, "slice int, body binary"), 1), buckets, buckets)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the floored log ratio of its smoothed rates in the target and in the source."""
    n, of_source, of_target = len(source), source.sum(), target.sum()
    return np.floor(1000 * np.log((target + 1) * (of_source + n) / ((source + 1) * (of_target + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every document with n_features and weight (longs): its number of words and the floored mean of their
    buckets' gains, 0 without words."""
    name = free_name(docs.select(keep), "_text")
    kept = docs.select(*keep, text_or_empty(text).alias(name))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != name)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name):
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for found, first in buckets_of(batch.column(len(keep)), len(gain)):
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                n += np.diff(first)
                total += np.diff(sums[first])
            columns = batch.columns[: len(keep)] + [pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_features", "weight"])
        trim()

    return kept.mapInArrow(weigh, f"{schema}, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The Gumbel term of an id in thousandths, from the first 32 bits of a digest of seed and id (null: no id's text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def radix_places(rows: DataFrame, keys: list[tuple[str, int]], scratch: Scratch, digit_bits: int | None = None, block: int | None = None) -> DataFrame:
    """rows with `place` (long, from 0): their order by the keys, most significant first; key columns hold longs of so many
    bits, read as unsigned. Rows with equal keys follow each other in any order.

    Pass by pass, from the least significant digit: count the digit by block, sum the counts up over (digit, block) into
    offsets, and add each row's order among its block's equal digits. Only the totals of a digit's 2 ** digit_bits values come
    to the driver. A pass shuffles rows by (block, digit), of which none has more rows than a block, whatever the keys.
    """
    bits, size = digit_bits or DIGIT_BITS, block or BLOCK
    place, digit, first, after, k = (free_name(rows, x) for x in ("place", "_digit", "_first", "_after", "_block"))
    # Any start will do, if it is written: blocks are runs of a task's rows.
    start = F.monotonically_increasing_id()
    now = scratch.table(rows.withColumn(place, start).withColumn(k, F.floor(F.col(place) / size)))
    for name, width in reversed(keys):
        for shift in range(0, width, bits):
            marked = now.withColumn(digit, F.shiftrightunsigned(name, shift).bitwiseAND((1 << bits) - 1).cast("int"))
            counts = scratch.table(marked.groupBy(digit, k).agg(F.count(F.lit(1)).alias(first)))
            totals = counts.groupBy(digit).agg(F.sum(first).alias("n")).orderBy(digit).collect()
            if len(totals) == 1 and shift + bits < width:  # one value: a stable pass would move nothing
                scratch.drop(counts)
                continue
            base, before = [], 0
            for r in totals:
                base.append((r[0], before))
                before += r["n"]
            bases = now.sparkSession.createDataFrame(base, f"{digit} int, {after} long")
            earlier = F.sum(first).over(Window.partitionBy(digit).orderBy(k).rowsBetween(Window.unboundedPreceding, -1))
            offsets = counts.join(F.broadcast(bases), digit).select(digit, k, (F.col(after) + F.coalesce(earlier, F.lit(0))).alias(first))
            order = F.row_number().over(Window.partitionBy(k, digit).orderBy(place))
            moved = marked.join(offsets, [k, digit]).withColumn(place, F.col(first) + order - 1).withColumn(k, F.floor(F.col(place) / size))
            moved = scratch.table(moved.drop(digit, first))
            scratch.drop(now, counts)
            now = moved
    return now.drop(k)


def _key_of_ids(doc_id: Column, least: int, greatest: int) -> tuple[Column, int]:
    """An id as an unsigned key of as few bits as do, and their number."""
    if greatest - least < 1 << 63:
        return doc_id - least, max(1, (greatest - least).bit_length())
    return doc_id.bitwiseXOR(F.lit(-(1 << 63))), 64


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's id with n_features, weight, score and rank (longs); floor(percent * N / 100) of the N documents with at
    least `least_words` words have ranks, 1 for the highest score, ties to smaller ids.

    Null texts have no words and weight 0. A null id counts as the empty text in its hash and comes after all others among
    ties; rows with equal ids and scores (repeated rows) take ranks in any order. Ids must be of an integral type. An empty
    table gives no rows; an empty target gives gains against no words. Other columns aren't read. Two passes over the texts;
    only the ids and four numbers of a row are sorted.
    """
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must be of an integral type, as ties go to the smaller number")
    scratch = Scratch(docs.sparkSession, "resampling")
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    found = weighed(docs, gain, [doc_id], text).toDF("id", "n_features", "weight").withColumn("id", F.col("id").cast("long"))
    scored = scratch.table(found.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    able = scored.filter(F.col("n_features") >= least_words)
    seen = able.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("known"), F.min("id").alias("least"), F.max("id").alias("greatest"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    if seen["n"]:
        ids, bits = _key_of_ids(F.col("id"), seen["least"] or 0, seen["greatest"] or 0)
        keyed = able.withColumns({"a": seen["high"] - F.col("score"), "b": F.col("id").isNull().cast("long"), "c": F.coalesce(ids, F.lit(0))})
        keys = [("a", max(1, (seen["high"] - seen["low"]).bit_length())), ("b", 1 if seen["known"] < seen["n"] else 0), ("c", bits)]
        placed = radix_places(keyed, keys, scratch)
        rank = F.when(F.col("place") < percent * seen["n"] // 100, F.col("place") + 1)
        able = placed.withColumn("rank", rank)
    else:
        able = able.withColumn("rank", F.lit(None).cast("long"))
    rest = scored.filter(F.col("n_features") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["id", "n_features", "weight", "score", "rank"]
    return able.select(columns).unionByName(rest.select(columns)).withColumnRenamed("id", doc_id)


def drawn(docs: DataFrame, ranks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents, whole rows, whose ids have a rank in a result of resampled()."""
    ids = ranks.filter("rank IS NOT NULL").select(F.col(doc_id).alias(name := free_name(docs, "_drawn"))).distinct()
    return docs.join(ids, F.col(doc_id).eqNullSafe(F.col(name)), "left_semi")


#: crc32 by SQL: a table made by the polynomial's rule, and a fold over the bytes of each different word.
RESAMPLING_SQL = f"""
WITH w AS (SELECT true AS d, doc_id AS id, rowid_ AS r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
  UNION ALL SELECT false, NULL, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
u AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w),
c AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT) for k in range(length(h) // 2)]), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % {BUCKETS} AS b FROM u, t),
n AS (SELECT b, count(*) FILTER (d) AS s, count(*) FILTER (NOT d) AS t FROM w JOIN c USING (word) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM n),
f AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM w JOIN c USING (word) JOIN g USING (b) WHERE d GROUP BY r),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, row_number() OVER () AS r FROM documents) LEFT JOIN f USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND k <= {PERCENT} * n // 100 THEN k END AS rank FROM z"""
