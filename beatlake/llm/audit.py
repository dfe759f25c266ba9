"""Audit of filters that act on each other: what each of them removes in every order of application, and its Shapley share.

All removals of filters in some order follow from how many documents fail at least one filter of a coalition, which is
tabulated for all 32 coalitions of each part. Shapley values solve the kernel-weighted least squares problem over these counts,
constrained so that they add up to what all filters remove. Its normal equations are solved once in rationals, for any counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatlake.llm._shared import Scratch, slices, text_or_empty

#: The filters, each with what fails it. E is told from the whole table, the others from a text alone.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SPECIAL = 200, 50, 3, b"#$%&*|"

CAPITALS = bytes(range(0x41, 0x5B))
CONTINUING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
#: Runs of about a MB of a text that end with a word, so a long text is counted piece by piece.
PIECES = re.compile(rb"(?s).{1,1048576}[^\x20\x09-\x0D]*")


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails: too few words, too few different ones, too many capitals, special characters."""
    words, different, capitals, points, special = 0, set(), 0, 0, False
    for piece in PIECES.findall(text) if len(text) > 1 << 20 else (text,):
        found = piece.split()  # of bytes, at space and tab to carriage return
        words += len(found)
        different.update(found)
        capitals += len(piece) - len(piece.translate(None, CAPITALS))
        points += len(piece.translate(None, CONTINUING))
        special = special or len(piece.translate(None, SPECIAL)) < len(piece)
    fails = (words < LEAST_WORDS, 100 * len(different) < DISTINCT_PERCENT * words, 100 * capitals > CAPITALS_PERCENT * points, special)
    return sum(fail << k for k, fail in enumerate(fails))


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id, part (null: empty), digest (SHA-256 of the whole text, null: empty) and fails (bits of A to D) of every document."""
    kept = docs.select(text_or_empty(text).cast("binary").alias("text"), F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests, fails = [], []
            for x in batch.column(0):
                body = x.as_py()
                digests.append(hashlib.sha256(body).digest())
                fails.append(failures(body))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(digests, pa.binary()), pa.array(fails, pa.int32())], names=["id", "part", "digest", "fails"])

    return kept.mapInArrow(mark, f"id {docs.schema[doc_id].dataType.simpleString()}, part string, digest binary, fails int")


def labelled(marks: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """marks, repeated rows as one with their number n, with good and toxic (booleans; of several labels of an id, any). They are
    written once, as rows with and without an id are read from them."""
    once = Scratch(marks.sparkSession, "audit").table(marks.groupBy("id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n")))
    of = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = once.filter("id IS NOT NULL").join(of, F.col("id") == F.col("of"), "left").drop("of")
    none = once.filter("id IS NULL").withColumns({"good": F.lit(None).cast("boolean"), "toxic": F.lit(None).cast("boolean")})
    false = F.lit(False)
    return known.unionByName(none).withColumns({"good": F.coalesce("good", false), "toxic": F.coalesce("toxic", false)})


def cells(rows: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), n, good and toxic: documents by the filters that they fail.

    A text's copies first become a row for each part and labels, with the least id and how many have it, so that the least id of
    all copies is sought among few rows however many copies there are.
    """
    group = ["digest", "fails", "part", "good", "toxic"]
    groups = rows.groupBy(*group).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    passes = F.when(F.col("least") == F.col("first"), F.col("n_least")).when(F.col("first").isNull(), F.col("n")).otherwise(0)
    both = F.array(F.struct(F.col("fails").alias("fails"), passes.alias("n")), F.struct(F.col("fails").bitwiseOR(16).alias("fails"), (F.col("n") - passes).alias("n")))
    split = groups.withColumn("first", first).select("part", "good", "toxic", F.inline(both))
    sums = {name: F.sum(F.when(F.col(name), F.col("n")).otherwise(0)).alias(name) for name in ("good", "toxic")}
    return split.groupBy("part", "fails").agg(F.sum("n").alias("n"), *sums.values())


def coalitions(cells_: DataFrame, m: int = len(FILTERS)) -> DataFrame:
    """part, with the number of documents, and arrays over the coalitions 0 to 2 ** m - 1 of how many documents, good and toxic
    ones fail a filter of the coalition."""
    by_part = cells_.groupBy("part").agg(F.sum("n").alias("documents"), F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))  # 2 ** m cells at most

    def removed(measure: str) -> Column:
        hit = lambda s, total, c: F.when(c["fails"].bitwiseAND(s) != 0, total + c[measure]).otherwise(total)
        return F.transform(F.sequence(F.lit(0), F.lit(2**m - 1)), lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda total, c: hit(s, total, c)))

    return by_part.select("part", "documents", *(removed(x).alias(x) for x in ("n", "good", "toxic")))


def shapley_weights(m: int = len(FILTERS)) -> list[list[int]]:
    """For each filter what a coalition's count adds to m! times its Shapley value.

    They solve the least squares problem min sum k(S) (v(S) - sum of shares in S)^2 over the coalitions but the empty and the
    whole one, with k(S) = (m - 1) / (C(m, |S|) |S| (m - |S|)), and shares that add up to v of all: the normal equations, bordered
    by the constraint and its multiplier, are brought to the unit matrix by exact elimination, with a right side for each v(S).
    """
    full = 2**m - 1
    system = [[Fraction(0)] * (m + 1 + full + 1) for _ in range(m + 1)]
    for s in range(1, full):
        members = [i for i in range(m) if s >> i & 1]
        kernel = Fraction(m - 1, math.comb(m, len(members)) * len(members) * (m - len(members)))
        for i in members:
            for j in members:
                system[i][j] += kernel
            system[i][m + 1 + s] += kernel
    for i in range(m):
        system[i][m] = system[m][i] = Fraction(1)
    system[m][m + 1 + full] = Fraction(1)
    for k in range(m + 1):
        pivot = next(r for r in range(k, m + 1) if system[r][k])
        system[k], system[pivot] = system[pivot], system[k]
        system[k] = [x / system[k][k] for x in system[k]]
        for r in range(m + 1):
            if r != k and system[r][k]:
                system[r] = [x - system[r][k] * y for x, y in zip(system[r], system[k])]
    scaled = [[x * math.factorial(m) for x in row[m + 1 :]] for row in system[:m]]
    assert all(x.denominator == 1 for row in scaled for x in row)
    return [[int(x) for x in row] for row in scaled]


def steps(tabulated: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from a table of coalitions()."""
    m = len(filters)
    orders = ["".join(x) for x in permutations(filters)]
    rows = tabulated.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(m))))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(filters)), F.lit(0))

    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before, own = bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)), bits(letter)
    at = lambda measure, s: F.get(measure, s)
    here = lambda measure: at(measure, F.col("_before") + F.col("_own")) - at(measure, F.col("_before"))
    weights = F.element_at(F.lit(shapley_weights(m)), F.instr(F.lit(filters), letter))
    share = F.aggregate(F.zip_with("n", weights, lambda v, w: v * w), F.lit(0).cast("long"), lambda total, x: total + x)
    return rows.withColumns({"_before": before, "_own": own}).select(
        "part", "filter_order", "step",
        (F.col("documents") - at("n", F.col("_before") + F.col("_own"))).alias("kept"),
        here("n").alias("removed"),
        (at("n", F.col("_own")) - here("n")).alias("redundant"),
        (at("n", F.lit(2**m - 1)) - at("n", F.lit(2**m - 1) - F.col("_own"))).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """For every part (values of a column, null: empty), each of the 120 orders of the five filters and each step, long counts of
    documents: kept after the step, removed by it, redundant (failing its filter, but removed before), unique_fails (failing its
    filter alone), good_lost and toxic_lost (removed here with such labels), and shapley (what its filter removes, summed over
    all orders).

    Null texts are empty. A document fails E if its text is that of any smaller id in the table: of rows with a null id, those whose text has
    some id, of rows that share the least id none. Repeated rows count each; an id with several label rows is good (toxic) if any
    says so. An empty table gives no rows. Only id, text and part are read of docs; extra columns don't matter.
    """
    return steps(coalitions(cells(labelled(marked(docs, doc_id, text, part), labels, doc_id))))


#: The filters applied document by document, without coalitions.
AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(min(d.doc_id) OVER (PARTITION BY sha256(text)) < d.doc_id, false) AS e FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT o AS filter_order, CAST(step AS INT) AS step, substr(o, step, 1) AS own, substr(o, 1, step - 1) AS earlier FROM o, range(1, 6) r(step)),
y AS (SELECT part, filter_order, step, own, contains(fails, own) AS fail, fails = own AS alone, length(translate(fails, earlier, '')) < length(fails) AS gone, n, good, toxic FROM m, s),
z AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed, coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z"""
