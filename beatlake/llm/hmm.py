"""Hidden Markov language model: Baum-Welch counts summed over partitions, and exact sequence likelihood.

Hidden states emit classes. A frequent word (OWN of them at most, chosen by a threshold on counts) is a class of its own; all
other words, unseen ones too, belong to one of ENDINGS classes by their last three bytes, within which a word has the
probability (c + 1) / (tokens of the class + words of the class + 1). So the model's size is fixed by parameters while the
word counts, over all training texts, grow with the corpus: they stay a distributed table. Frequent words' counts (HEAD at
most, by another threshold) are broadcast, the others meet their documents in a join on the word.

Training runs Baum-Welch over every training text in each iteration, scoring the forward recursion over every text, scaled. Both
are exact for whole texts: stretches of STRETCH tokens of long texts become transfer matrices, so that all texts of a block
advance in step and what one stretch needs of those before and after it passes over the cuts.

Defined results: a null or empty text is the end token alone; null ids count as the empty text for the folds; repeated rows
are counted and scored each; without training texts all counts are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatlake.llm._shared import IN_WORD, Scratch, collect_model, cut_model, is_fold, mix64, model_rows, slices, sum_models, utf8_block, word_spans

STATES, ITERATIONS = 8, 4
#: Words with a class of their own, classes of the other words, and words whose counts are broadcast: at most so many.
OWN, ENDINGS, HEAD = 16_384, 2048, 262_144
#: Bytes of the longest word that is broadcast; longer ones meet their documents in the join on the word.
WORD_BYTES = 64
STRETCH = 1024
#: Weight, in tokens, of the corpus's class frequencies in each state's emissions.
PRIOR = 200.0
SLICE = 1 << 14
#: The end token's key; no word holds a space.
END = " "

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a block (A-Z lowered), each token's place among them, and each text's first token (texts + 1)."""
    offsets, data = utf8_block(texts)
    data = _LOWER[data]
    starts, ends, first = word_spans(offsets, data)
    body = data[IN_WORD[data]]
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(body)))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first


def endings(words: pa.Array) -> np.ndarray:
    """The class, by the last three bytes, of each word."""
    edges, data = utf8_block(words)
    padded = np.concatenate([np.zeros(3, np.uint8), data]).astype(np.uint64)
    size = np.diff(edges)
    key = padded[edges[1:] + 2] if len(size) else np.zeros(0, np.uint64)
    for back in (1, 2):
        key = key << np.uint64(8) | np.where(size > back, padded[edges[1:] + 2 - back], np.uint64(0))
    return (mix64(key) % np.uint64(ENDINGS)).astype(np.int32)


def vocabulary(training: DataFrame) -> DataFrame:
    """word, ending and c, the number of training tokens, over all training texts (the end token too)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = 0
        for batch in slices(batches, "text", 6 << 20):
            texts += batch.num_rows
            words, at, _ = words_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(endings(words)), pa.array(np.bincount(at, minlength=len(words)))], names=["word", "ending", "c"])
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([-1], pa.int32()), pa.array([texts], pa.int64())], names=["word", "ending", "c"])

    return training.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, ending int, c long").groupBy("word", "ending").agg(F.sum("c").alias("c"))


def frequent(vocab: DataFrame, most: int) -> pa.Table:
    """word and c of the words at or above the lowest threshold that at most `most` words reach; so its size is bounded."""
    step = F.floor(F.log2("c") * 8)
    levels = {r["step"]: r["n"] for r in vocab.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}  # some hundred rows
    total, lowest = 0, None
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        lowest = level
    rows = vocab.filter(step >= lowest) if lowest is not None else vocab.limit(0)
    return rows.select("word", "c").orderBy(F.desc("c"), "word").toArrow()


@dataclass
class Model:
    """Parameters of the hidden Markov model over classes, and what is known of words (all of bounded size)."""

    own: pa.Array
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    tokens: int
    types: int
    class_tokens: np.ndarray
    class_types: np.ndarray
    head: pa.Array
    head_counts: np.ndarray
    end_count: int

    def classes(self, words: pa.Array) -> np.ndarray:
        """Class of each word: its own, or its ending's."""
        own = pc.index_in(words.cast(pa.string()), value_set=self.own).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(own >= 0, own, len(self.own) + endings(words))

    @property
    def end(self) -> int:
        return len(self.own) + ENDINGS


def forward(flat: np.ndarray, at: np.ndarray, lengths: np.ndarray, begin: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State distribution after each sequence, and the logarithm of its likelihood.

    flat: class ids; at, lengths: where sequences lie in it; begin (states, sequences): what the first emission is weighed by.
    """
    order = np.argsort(-lengths, kind="stable")
    at, n = at[order], lengths[order]
    alpha = begin[:, order].copy()
    log = np.zeros(len(at))
    active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")  # sequences longer than t
    turned = np.ascontiguousarray(move.T)
    for t, m in enumerate(active):
        a = alpha[:, :m] if t == 0 else turned @ alpha[:, :m]
        a = a * emit[:, flat[at[:m] + t]]
        if t % 8 == 7 or t + 1 == len(active) or active[t + 1] < m:
            total = a.sum(axis=0)
            a /= total
            log[:m] += np.log(total)
        alpha[:, :m] = a
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return alpha[:, back], log[back]


def log_likelihood(flat: np.ndarray, edges: np.ndarray, model: Model) -> np.ndarray:
    """Exact natural logarithm of the probability of each text's classes; edges: each text's first token (texts + 1)."""
    n = np.diff(edges)
    stretches = -(-n // STRETCH)
    text = np.repeat(np.arange(len(n)), stretches)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    at = edges[:-1][text] + nth * STRETCH
    size = np.minimum(STRETCH, edges[1:][text] - at)
    k = len(model.start)
    opening = nth == 0
    alpha, log = forward(flat, at[opening], size[opening], np.repeat(model.start[:, None], opening.sum(), axis=1), model.move, model.emit)
    later = np.flatnonzero(~opening)
    if len(later):
        # A later stretch as a matrix: one run for each state that the stretch may be entered from.
        ends, logs = stretch_matrices(flat, at[later], size[later], model)
        order = np.argsort(nth[later], kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(nth[later][order])) + 1):
            who = text[later[some]]
            most = logs[some].max(axis=1)
            weight = alpha[:, who].T * np.exp(logs[some] - most[:, None])
            after = np.einsum("nk,nkj->nj", weight, ends[some])
            total = after.sum(axis=1)
            alpha[:, who] = (after / total[:, None]).T
            log[who] += most + np.log(total)
    return log


def stretch_matrices(flat: np.ndarray, at: np.ndarray, size: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch as a matrix (entered from, left in), whose rows are scaled, and the logarithms of the scales."""
    order = np.argsort(-size, kind="stable")
    at, n, k = at[order], size[order], len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    out, log = np.empty((len(at), k, k)), np.zeros((len(at), k))
    active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")
    for t, m in enumerate(active):
        x = (model.move[None] if t == 0 else (out[:m].reshape(-1, k) @ model.move).reshape(m, k, k)) * emit[flat[at[:m] + t]][:, None, :]
        if t % 8 == 7 or t + 1 == len(active) or active[t + 1] < m:
            total = x.sum(axis=2)
            x /= total[:, :, None]
            log[:m] += np.log(total)
        out[:m] = x
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back], log[back]


def boundaries(flat: np.ndarray, at: np.ndarray, size: np.ndarray, text: np.ndarray, nth: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch (a text's in order), the state distribution after the stretch before it (None's is start) and the
    backward weights of what follows it (1 after the last), both scaled to sum to 1."""
    k, n = len(model.start), len(at)
    entry, after = np.full((n, k), np.nan), np.full((n, k), 1.0 / k)
    several = np.flatnonzero((nth > 0) | (np.append(nth[1:], 0) > 0)) if n else np.zeros(0, np.int64)
    if not len(several):
        return entry, after
    opening = several[nth[several] == 0]
    first, _ = forward(flat, at[opening], size[opening], np.repeat(model.start[:, None], len(opening), axis=1), model.move, model.emit)
    later = several[nth[several] > 0]
    matrix = np.zeros((n, k, k))
    made, logs = stretch_matrices(flat, at[later], size[later], model)
    matrix[later] = made * np.exp(logs - logs.max(axis=1, keepdims=True))[:, :, None]
    entry[opening + 1] = first.T
    by_place = np.argsort(nth[later], kind="stable")
    steps = np.split(later[by_place], np.flatnonzero(np.diff(nth[later][by_place])) + 1)
    for some in steps:
        x = np.einsum("nk,nkj->nj", entry[some], matrix[some])
        go = (some + 1 < n) & (nth[np.minimum(some + 1, n - 1)] > 0)
        entry[some[go] + 1] = (x / x.sum(axis=1, keepdims=True))[go]
    for some in steps[::-1]:
        x = np.einsum("nkj,nj->nk", matrix[some], after[some])
        after[some - 1] = x / x.sum(axis=1, keepdims=True)
    return entry, after


def expected_counts(flat: np.ndarray, edges: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the logarithm of the likelihood: those of whole texts. Stretches
    of a text advance in step; what they need of the text before and after them comes from the stretches' matrices."""
    n = np.diff(edges)
    stretches = -(-n // STRETCH)
    text = np.repeat(np.arange(len(n)), stretches)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    at = edges[:-1][text] + nth * STRETCH
    size = np.minimum(STRETCH, edges[1:][text] - at)
    entry, after = boundaries(flat, at, size, text, nth, model)
    order = np.argsort(-size, kind="stable")
    at, size, nth, entry, after = at[order], size[order], nth[order], entry[order].T, after[order].T
    k = len(model.start)
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    alphas, scales, seen = [], [], []
    turned = np.ascontiguousarray(model.move.T)
    alpha = np.where(nth == 0, model.start[:, None], turned @ np.nan_to_num(entry))
    for t, m in enumerate(active):
        ids = flat[at[:m] + t]
        a = (alpha[:, :m] if t == 0 else turned @ alpha[:, :m]) * model.emit[:, ids]
        total = a.sum(axis=0)
        a /= total
        alpha = a
        alphas.append(a)
        scales.append(total)
        seen.append(ids)
    moves, starts = np.zeros((k, k)), np.zeros(k)
    beta, gammas = np.ones((k, 0)), []
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        grown = np.empty((k, m))
        next_m = active[t + 1] if t + 1 < len(active) else 0
        # A stretch that ends here: its weights are those of what follows, scaled so that they and alpha sum to 1.
        own = after[:, next_m:m]
        grown[:, next_m:] = own / (alphas[t][:, next_m:] * own).sum(axis=0)
        if next_m:
            ahead = model.emit[:, seen[t + 1]] * beta / scales[t + 1]
            moves += alphas[t][:, :next_m] @ ahead.T
            grown[:, :next_m] = model.move @ ahead
        beta = grown
        gammas.append(alphas[t] * beta)
    if gammas:
        starts = gammas[-1][:, nth == 0].sum(axis=1)
        cut = np.flatnonzero(nth > 0)  # the move into a stretch from the one before it
        if len(cut):
            ahead = model.emit[:, seen[0][cut]] * beta[:, cut] / scales[0][cut]
            moves += entry[:, cut] @ ahead.T
    moves *= model.move
    ids = np.concatenate([*seen[::-1], np.zeros(0, np.int64)]).astype(np.int64)
    gamma = np.concatenate([*gammas, np.zeros((k, 0))], axis=1)
    emits = np.stack([np.bincount(ids, weights=gamma[j], minlength=model.emit.shape[1]) for j in range(k)])
    return starts, moves, emits, float(sum(np.log(s).sum() for s in scales))


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class ids with the end after each text, and the new edges."""
    return np.insert(ids, first[1:], end), first + np.arange(len(first))


def trained(documents: DataFrame, vocab: DataFrame, held_out, states: int = STATES, iterations: int = ITERATIONS, seed: int = 10) -> Model:
    """The model after Baum-Welch over all training texts; vocab is their (written) vocabulary."""
    spark = documents.sparkSession
    tokens, types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = vocab.filter(F.col("ending") >= 0)
    short = words.filter(F.octet_length("word") <= WORD_BYTES)
    own, head = frequent(short, OWN), frequent(short, HEAD)
    own_words = own.column("word").combine_chunks()
    ends = vocab.filter(F.col("ending") < 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    per = {r["ending"]: (r["n"], r["v"]) for r in words.groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # ENDINGS rows at most
    class_tokens, class_types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for k, (n, v) in per.items():
        class_tokens[k], class_types[k] = n, v
    own_counts = own.column("c").to_numpy().astype(float)
    own_endings = endings(own_words.cast(pa.large_string()))
    class_tokens -= np.bincount(own_endings, weights=own_counts, minlength=ENDINGS)
    class_types -= np.bincount(own_endings, minlength=ENDINGS)
    share = np.concatenate([own_counts, class_tokens, [ends]]) + 1
    share /= share.sum()
    rng = np.random.default_rng(seed)
    emit = share * np.exp(rng.normal(0, 0.5, (states, len(share))))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    model = Model(own_words, np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True), int(tokens), int(types), class_tokens, class_types, head.column("word").combine_chunks(), head.column("c").to_numpy().astype(np.int64), int(ends))
    training = documents.filter(~held_out).select(F.col("text").cast("string").alias("text"))
    c = len(share)
    size = states + states * states + states * c
    for _ in range(iterations if tokens else 0):
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value  # noqa: B023
            total = np.zeros(size)
            for batch in slices(batches, "text", 2 << 20):
                distinct, at, first = words_of(batch.column(0))
                starts, moves, emits, _ = expected_counts(*with_end(m.classes(distinct)[at], first, m.end), m)
                total += np.concatenate([starts, moves.ravel(), emits.ravel()])
            yield model_rows(cut_model(total, SLICE))

        got = collect_model(sum_models(training.mapInArrow(count, "slice int, body binary"), -(-size // SLICE)), size, SLICE)
        start, move, emit = got[:states] + 0.1, got[states : states + states * states].reshape(states, states) + 0.1, got[states + states * states :].reshape(states, c) + PRIOR * share
        model = replace(model, start=start / start.sum(), move=move / move.sum(axis=1, keepdims=True), emit=emit / emit.sum(axis=1, keepdims=True))
        shared.unpersist()
    return model


def scored(documents: DataFrame, divisor: int = 7, remainder: int = 2, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "hmm")
    held_out = is_fold("doc_id", divisor, remainder)
    vocab = scratch.table(vocabulary(documents.filter(~held_out)))
    model = trained(documents, vocab, held_out, states, iterations)
    shared = spark.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        base = np.log10(m.tokens + m.types + 1)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", 2 << 20):
            words, at, first = words_of(batch.column(2))
            ids = m.classes(words)
            found = pc.index_in(words.cast(pa.string()), value_set=m.head).fill_null(-1).to_numpy(zero_copy_only=False)
            c = np.where(found >= 0, m.head_counts[np.maximum(found, 0)] if len(m.head_counts) else 0, 0)
            tail, shared_class = found < 0, ids >= len(m.own)
            within = np.where(shared_class, np.log10(c + 1) - np.log10(m.class_tokens + m.class_types + 1)[np.maximum(ids - len(m.own), 0)], 0.0)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at])])[first])  # noqa: E731,B023
            n = np.diff(first) + 1
            flat, edges = with_end(ids[at], first, m.end)
            hmm = log_likelihood(flat, edges, m) / np.log(10) + sums(within)
            plain = sums(np.log10(c + 1)) + np.log10(m.end_count + 1) - n * base
            known = sums((c > 0).astype(np.int64)) + (m.end_count > 0)
            # Tokens whose counts aren't broadcast, by text: distinct words with their numbers.
            rare = np.flatnonzero(tail[at])
            pair = (np.searchsorted(first, rare, side="right") - 1) * np.int64(len(words) + 1) + at[rare]
            pair, times = np.unique(pair, return_counts=True)
            text, word = pair // (len(words) + 1), pair % (len(words) + 1)
            cuts = pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(len(n))), batch.column(0), batch.column(1), pa.array(n), pa.array(known), pa.array(plain), pa.array(hmm),
                    pa.ListArray.from_arrays(cuts, words.take(pa.array(word)).cast(pa.string())), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
            )
            row += len(n)

    slim = documents.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = scratch.table(slim.mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>, times array<int>"))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    counts = vocab.select("word", "c")
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_more"))
    more, seen = F.coalesce("_more", F.lit(0.0)), F.coalesce("_known", F.lit(0))
    return rows.drop("rare", "times").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )
