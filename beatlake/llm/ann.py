"""Approximate nearest neighbours by largest inner product: inverted lists of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (SAMPLE vectors); every vector is indexed: its list is that of the
nearest centroid, its code holds the nearest codeword of each part of the residual. A query probes the lists whose centroids
have the largest inner products with it; tables of inner products with all codewords score a list's vectors without their
originals (the asymmetric distance). The SHORT best scored are ranked again by exact inner products in double precision.

How many lists are probed is measured, not set: on queries of the sample, against their exact neighbours in the sample, the
least number that keeps RECALL of them; on data without clusters that is a large part of the lists.

Index entries are dealt to shards of about SHARD entries (a long list to several); queries go to the shards of their lists, and
each shard sends one row per query. Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do those whose length isn't the commonest one; of rows that repeat a vec_id the least vector counts; ties go to
the smaller vec_id; a query with fewer than k candidates gets all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatlake.llm._shared import Scratch

SAMPLE, SHARD = 16_384, 8192
#: Recall that the number of probes is measured for, candidates ranked again at least, codewords per part, components per part.
RECALL, SHORT, WORDS, PART = 0.97, 200, 256, 2
#: Share of the sample's queries whose neighbours the list of candidates must hold.
PLACED = 0.99
ROUNDS = 12


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    real = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    lengths = real.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = lengths["n"] if lengths else 0
    return real.filter(F.size("vector") == width).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centroids (Lloyd's rounds; an empty one moves to a random point)."""
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(points, centres)
        n = np.bincount(own, minlength=k)
        for j in range(points.shape[1]):
            centres[:, j] = np.bincount(own, weights=points[:, j], minlength=k) / np.maximum(n, 1)
        if (n == 0).any():
            centres[n == 0] = points[rng.choice(len(points), int((n == 0).sum()))]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x @ centres.T - half, axis=1) for x in np.array_split(points, max(1, len(points) // 4096))]) if len(points) else np.zeros(0, np.int64)


@dataclass
class Index:
    """Coarse centroids, codebooks (parts x words x components), the number of lists that a query probes at least, and the
    number of candidates that are ranked again by exact scores."""

    coarse: np.ndarray
    books: np.ndarray
    probes: int
    short: int = SHORT

    def split(self, x: np.ndarray) -> np.ndarray:
        """Vectors in parts, with zeros after the last component if the width isn't a multiple."""
        parts, _, size = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * size - x.shape[1]))).reshape(len(x), parts, size)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector."""
        own = nearest(x, self.coarse)
        rest = self.split(x - self.coarse[own])
        return own, np.stack([nearest(rest[:, j], self.books[j]) for j in range(self.books.shape[0])], axis=1).astype(np.uint8)

    def approximate(self, queries: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products of queries and vectors as the vectors' codes tell them (queries x vectors)."""
        own, codes = self.encode(x)
        out = (queries @ self.coarse.T)[:, own].astype(np.float32)
        tables = self.tables(queries)
        for j in range(codes.shape[1]):
            out += tables[:, j][:, codes[:, j]]
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codewords (queries x parts x words)."""
        return np.einsum("qpc,pwc->qpw", self.split(queries), self.books).astype(np.float32)


def fitted(sample: np.ndarray, lists: int, k: int = 20, seed: int = 1, of: int = 0, short: int = SHORT) -> Index:
    """The index of a sample of `of` vectors.

    The list of candidates is as long as the sample shows to be needed, so that codes which tell neighbours less well in a
    denser table cost time and not recall: a table's k nearest are as far out as the sample's k * sample / of nearest, and
    what codes rank before those in the sample comes of / sample times as often in the table.
    """
    rng = np.random.default_rng(seed)
    coarse = means(sample, lists, rng)
    rest = sample - coarse[nearest(sample, coarse)]
    parts = -(-sample.shape[1] // PART)
    rest = np.pad(rest, ((0, 0), (0, parts * PART - sample.shape[1]))).reshape(len(sample), parts, PART)
    books = np.stack([_filled(means(rest[:, j], WORDS, rng)) for j in range(parts)])
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    own = nearest(sample, coarse)
    rank = np.argsort(np.argsort(-(sample[asked] @ coarse.T), axis=1), axis=1)
    needed = np.sort(rank[np.arange(len(asked))[:, None], own[best]].ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1 if len(needed) else len(coarse)
    index = Index(coarse, books, min(probes, len(coarse)), short)
    if len(asked) and len(sample) > 1:
        more = max(1.0, of / len(sample))
        by_codes = index.approximate(sample[asked], sample)
        by_codes[np.arange(len(asked)), asked] = -np.inf
        extreme = best[:, : max(1, min(best.shape[1], int(k / more)))]
        place = [np.count_nonzero(row > row[nearest_].min()) + 1 for row, nearest_ in zip(by_codes, extreme)]
        index.short = max(short, int(np.ceil(np.quantile(place, PLACED) * more)))
    return index


def _filled(book: np.ndarray) -> np.ndarray:
    """A codebook of WORDS words; a small sample's last word is repeated."""
    return np.concatenate([book, np.repeat(book[-1:], WORDS - len(book), axis=0)])


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores (not minus infinity), largest first, ties by smaller id."""
    real = np.flatnonzero(scores > -np.inf)
    if len(real) > n:
        least = np.partition(scores[real], len(real) - n)[len(real) - n]
        real = real[scores[real] >= least]
    return real[np.lexsort((ids[real], -scores[real]))][:n]


def neighbours(vectors: DataFrame, divisor: int = 20, k: int = 20, short: int = SHORT) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for every vector whose id is divisible by divisor."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    real = scratch.table(usable(vectors))
    n = real.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    take = real.filter(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(1 << 20)) < min(1 << 20, -(-(SAMPLE << 20) // n))).limit(SAMPLE + SAMPLE // 8).toArrow()
    if not take.num_rows:
        take = real.limit(SAMPLE).toArrow()
    take = take.sort_by("vec_id")
    index = fitted(matrix(take.column("vector").combine_chunks()), max(8, min(4096, int(np.sqrt(n) / 4))), k, of=n, short=short)
    short = index.short
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, code = shared.value.encode(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "list", "code"])

    coded = scratch.table(real.mapInArrow(encode, "vec_id long, list int, code binary"))
    sizes = np.zeros(len(index.coarse), dtype=np.int64)
    for r in coded.groupBy("list").count().collect():  # as many rows as there are lists
        sizes[r["list"]] = r["count"]
    pieces = -(-sizes // (SHARD // 2))  # a long list lies in several shards
    shards = -(-n // SHARD)
    first = np.cumsum(pieces) - pieces  # piece p of list l is piece number first[l] + p; pieces go to shards in order
    per = max(1, -(-int(pieces.sum()) // shards))
    where = spark.sparkContext.broadcast((sizes, pieces, first, per))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces_, first_, per_ = where.value
        for batch in batches:
            own, ids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            shard = ((first_[own] + (ids * 2654435761 >> 8) % pieces_[own]) // per_).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(ids), np.int32)), batch.column(0), batch.column(1), batch.column(2)], names=["shard", "kind", "id", "list", "body"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes_, pieces_, first_, per_ = where.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            order = np.argsort(-(x @ m.coarse.T), axis=1, kind="stable")
            held = np.cumsum(sizes_[order], axis=1)
            probes = np.maximum(m.probes, (held < 4 * short).sum(axis=1) + 1)  # lists until enough vectors are in sight
            rows: list[tuple] = []
            for query, row, lists, count in zip(batch.column(0).to_pylist(), x, order, probes):
                by: dict[int, list[int]] = {}
                for one in lists[:count]:
                    for s in range(first_[one] // per_, (first_[one] + pieces_[one] - 1) // per_ + 1 if pieces_[one] else 0):
                        by.setdefault(int(s), []).append(one)
                rows += [(s, query, row.tobytes() + np.array(some, dtype="<i4").tobytes()) for s, some in by.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(np.ones(len(rows), np.int32)), pa.array([r[1] for r in rows], pa.int64()), pa.array(np.zeros(len(rows), np.int32)), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "kind", "id", "list", "body"])

    width = index.coarse.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, entries before queries."""
        m = shared.value
        state: dict = {"shard": None, "ids": [], "lists": [], "codes": [], "waiting": []}

        def answer() -> Iterator[pa.RecordBatch]:
            waiting, state["waiting"] = state["waiting"], []
            if not waiting or not len(state["ids"]):
                return
            if isinstance(state["codes"], list):
                lists = np.array(state["lists"])
                order = np.argsort(lists, kind="stable")
                state.update(ids=np.array(state["ids"])[order], lists=lists[order], codes=np.frombuffer(b"".join(state["codes"]), np.uint8).reshape(len(lists), -1)[order])
            x = np.array([np.frombuffer(w[1][: 8 * width], "<f8") for w in waiting])
            tables = m.tables(x)
            scores = np.full((len(waiting), len(state["ids"])), -np.inf, dtype=np.float32)
            wanted: dict[int, list[int]] = {}
            for k, w in enumerate(waiting):
                for one in np.frombuffer(w[1][8 * width :], "<i4").tolist():
                    wanted.setdefault(one, []).append(k)
            for one, some in wanted.items():
                a, b = np.searchsorted(state["lists"], [one, one + 1])
                if a == b:
                    continue
                own = np.repeat((x[some] @ m.coarse[one]).astype(np.float32)[:, None], b - a, axis=1)
                for j in range(tables.shape[1]):
                    own += tables[some, j][:, state["codes"][a:b, j]]
                scores[some, a:b] = own
            out = []
            for k, w in enumerate(waiting):
                scores[k, state["ids"] == w[0]] = -np.inf
                at = best(scores[k], state["ids"], short)
                out.append((w[0], state["ids"][at].astype("<i8").tobytes(), scores[k, at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["query_id", "ids", "scores"])

        for batch in batches:
            for shard, kind, id_, one, body in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != state["shard"]:
                    yield from answer()
                    state.update(shard=shard, ids=[], lists=[], codes=[], waiting=[])
                if kind == 0:
                    state["ids"].append(id_)
                    state["lists"].append(one)
                    state["codes"].append(body)
                else:
                    state["waiting"].append((id_, body))
                    if len(state["waiting"]) == 256:
                        yield from answer()
        yield from answer()

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One query's rows on end: the best of all shards."""
        last, ids, scores = None, [], []

        def made() -> pa.RecordBatch:
            all_ids, all_scores = np.concatenate(ids), np.concatenate(scores)
            at = best(all_scores, all_ids, short)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), last)), pa.array(all_ids[at])], names=["query_id", "vec_id"])

        for batch in batches:
            for query, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if query != last and last is not None:
                    yield made()
                    ids, scores = [], []
                last = query
                ids.append(np.frombuffer(a, "<i8"))
                scores.append(np.frombuffer(b, "<f4"))
        if last is not None:
            yield made()

    kinds = "shard int, kind int, id long, list int, body binary"
    queries = real.filter(F.pmod("vec_id", F.lit(divisor)) == 0)
    both = coded.mapInArrow(entries, kinds).unionByName(queries.mapInArrow(asked, kinds))
    found = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(search, "query_id long, ids binary, scores binary")
    chosen = found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(shortest, "query_id long, vec_id long")
    exact = chosen.join(real.withColumnRenamed("vector", "_v"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("_q")), "query_id")
    score = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    ranked = exact.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
