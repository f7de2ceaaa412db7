"""Language-model scoring by subword lattice likelihood.

A text is its words in order (A-Z lower-cased) and one end. Its probability is the sum over all
its segmentations into pieces of an existing vocabulary, found by a forward recursion in log
space: each piece, and the end, by its weight. No piece crosses a word's start, so it is the
product over the words, times that of the end. The weights of pieces are the existing scores of the vocabulary
(the file at hand is a BPE model whose scores are merge ranks: see lattice.log_scores); the end has its
share of the training tokens, the pieces share the rest, and a character without a piece is spelled in bytes, which
share a fixed BYTES of the mass. That is ``score``. Beside it, ``fitted_score`` is the same sum with weights
fitted to all training words by ROUNDS of expectation maximisation over all segmentations, the existing ones as prior, and
``word_score`` gives each training word one more edge over the whole word, which weighs its count less a discount (from the
counts of counts, as in modified Kneser-Ney) over all tokens; what the discounts save goes to the fitted segmentations.

At scale: words are counted in each task, then by a shuffle on the word; the lattice runs once
for each distinct word. The most frequent words, at most FREQUENT of them, are broadcast as
(hash, count, scores); each text adds those up where it is read, and only the occurrences of
rarer words are shuffled to theirs and back. No key in that shuffle is hot: a word that is not
among the FREQUENT most frequent has at most 1 / FREQUENT of all occurrences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lattice
from .common import Hasher, chunks, texts, written
from .sentpiece import MODEL

ROUNDS = 3
#: Pseudo-count of the prior weights, in pieces.
PRIOR = 1000.0
BYTES = 1e-5
#: Words that are broadcast, at most (40 bytes each).
FREQUENT = 400_000
_MARK = lattice.MARK.encode()
_SEED = 7


def prior(vocabulary: lattice.Vocabulary) -> np.ndarray:
    """Starting probability of each piece from the vocabulary's scores; unusable pieces 0."""
    return np.exp(lattice.log_scores(vocabulary))


def _logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-300))


def _lattice(vocabulary: lattice.Vocabulary, words: list[str]) -> tuple[lattice.Lattice, np.ndarray]:
    # A literal marker inside a word would pass for a word start; spell it in bytes.
    g = lattice.build(vocabulary, [_MARK + w.replace(lattice.MARK, "").encode() for w in words])
    return g, (g.target - g.source) * np.log(BYTES / 256)


def word_logs(vocabulary: lattice.Vocabulary, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log of each word's probability, summed over its segmentations."""
    if not words:
        return np.zeros(0)
    g, unknown = _lattice(vocabulary, words)
    return lattice.forward(g, _logs(p), unknown)[g.last]


def count_words(docs: DataFrame, learn: str, text: str) -> DataFrame:
    """(word, n, m): every distinct word of docs, its count where ``learn`` holds, and its count in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = [*counts, *(other.keys() - counts.keys())]
            n = [counts[w] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array([c + other[w] for w, c in zip(words, n, strict=True)], pa.int64())], names=["word", "n", "m"])

        for batch in batches:
            for yes, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (raw := t.as_py()) is not None:
                    (counts if yes else other).update(raw.encode().lower().split())
            if len(counts) + len(other) > 1_000_000:
                yield from out()
                counts.clear()
                other.clear()
        if counts or other:
            yield from out()

    return docs.select(learn, text).mapInArrow(run, "word string, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def discounts(of_counts: dict[int, int]) -> np.ndarray:
    """What a count of 0, 1, 2, and 3 or more gives up, from the numbers of words counted 1 to 4 times."""
    n = [0, *(of_counts.get(i, 0) for i in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    return np.array([0.0] + [min(max(c - (c + 1) * y * n[c + 1] / n[c] if n[c] else 0.5 * c, 0.1), c - 0.1) for c in (1, 2, 3)])


def fit(words: DataFrame, ends: int, model: str = MODEL, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(probability of each piece, that of the end) from (word, n), over all rows; they and BYTES add up to 1."""
    source = words.sparkSession.sparkContext.broadcast(lattice.read(model))
    start = prior(lattice.parsed(source.value))
    p, end = start * (1 - BYTES) / 2, 0.5
    size, spark = len(start), words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, total = lattice.parsed(source.value), np.zeros(size)
            logs = _logs(shared.value)
            for batch in batches:
                if len(batch):
                    g, unknown = _lattice(v, batch.column(0).to_pylist())
                    total += lattice.expected(g, logs, unknown, batch.column(1).to_numpy().astype(float), size)[0]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "count"])

        counts = np.zeros(size)
        for r in words.where("n > 0").select("word", "n").mapInArrow(run, "piece int, count double").groupBy("piece").agg(F.sum("count").alias("count")).collect():
            counts[r["piece"]] = r["count"]
        counts += PRIOR * start
        end = (ends + 0.5) / (counts.sum() + ends + 0.5) * (1 - BYTES)
        p = counts / (counts.sum() + ends + 0.5) * (1 - BYTES)
        shared.unpersist()
    return p, end


#: Counts up to EXACT are told apart one by one, greater ones by factors of 1.002.
EXACT = 1000


def _least(logs: DataFrame, frequent: int) -> int:
    """The least count of a word, over all texts, such that at most ``frequent`` words have it or more."""
    size = F.when(F.col("m") <= EXACT, F.col("m")).otherwise(EXACT + F.ceil(F.log(F.col("m") / EXACT) * 500))
    least, total = 1 << 62, 0
    for r in sorted(logs.groupBy(size.cast("long").alias("bin")).agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["bin"]):
        total += r["k"]
        if total > frequent:
            break
        least = r["least"]
    return least


SUMS = ("__known", "__base", "__lp", "__pp", "__wp")


def scored(docs: DataFrame, held_out: Column, text: str = "text", model: str = MODEL, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """docs (without the text) with held_out, n_tokens, n_known, train_tokens, base_score, score, fitted_score, word_score.

    A null text is empty: one token, the end. Each row is scored, repeated rows alike and each
    counted in training. With nothing to learn from, counts are 0 and the base and the model
    keep their priors. An empty table stays empty. Columns with the new names are replaced.
    """
    spark = docs.sparkSession
    new = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "fitted_score", "word_score"]
    names = [c for c in docs.columns if c != text and c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], held_out.alias("__held"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    words = written(count_words(rows.withColumn("__learn", ~F.col("__held")), "__learn", "__text"), "words")
    ends = rows.where(~F.col("__held")).count()
    n, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    train_tokens, distinct = n + ends, distinct + (ends > 0)
    of_counts = dict(map(tuple, words.where("n between 1 and 4").groupBy("n").count().collect()))
    discount = discounts(of_counts)
    saved = float(words.agg(F.coalesce(F.sum(F.element_at(F.array(*map(F.lit, discount.tolist())), (F.least("n", F.lit(3)) + 1).cast("int"))), F.lit(0.0))).first()[0])
    # One more token than there are: the end and the pieces keep some weight even when nothing is learned.
    tokens = train_tokens + 1.0
    gamma = (saved + 0.5) / tokens
    p, end = fit(words, ends, model, rounds)
    closing = (ends + 0.5) / tokens * (1 - BYTES)
    source = spark.sparkContext.broadcast(lattice.read(model))
    weights = spark.sparkContext.broadcast(p)
    norm = float(np.log10(train_tokens + distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hasher = lattice.parsed(source.value), Hasher(_SEED)
        first = prior(v) * (1 - BYTES - closing)
        for batch in batches:
            if len(batch):
                raw, offsets = texts(batch.column(0))
                h = hasher.of_words(raw, offsets, lower=False)[0]
                count = batch.column(1).to_numpy()
                g, unknown = _lattice(v, batch.column(0).to_pylist())
                lp, pp = (lattice.forward(g, _logs(x), unknown)[g.last] for x in (weights.value, first))
                whole = _logs((count - discount[np.minimum(count, 3)]) / tokens)
                cols = [lp, pp, np.logaddexp(whole, np.log(gamma) + lp)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1), batch.column(2), *[pa.array(x / np.log(10)) for x in cols]], names=["h", "n", "m", "lp", "pp", "wp"])

    logs = written(words.mapInArrow(score, "h long, n long, m long, lp double, pp double, wp double"), "logs")
    least = _least(logs, frequent)
    top = logs.where(F.col("m") >= least).select("h", "n", "lp", "pp", "wp").toPandas().sort_values("h")
    table = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64), *[top[c].to_numpy(float) for c in ("lp", "pp", "wp")]))
    schema = rows.drop("__text").withColumns({"__uid": F.lit(0).cast("long"), "__size": F.lit(0).cast("long"), "__known": F.lit(0).cast("long")} | {c: F.lit(0.0) for c in SUMS[1:]} | {"__rare": F.lit(None).cast("array<bigint>")}).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(_SEED)
        keys, counts, *lps = table.value
        values = [(counts > 0).astype(float), np.log10(counts + 1.0), *lps]
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            parts: list[tuple] = []
            for _, _, data, offsets in chunks(*texts(batch.column(len(names) + 1))):
                h, at, _, _ = hasher.of_words(data, offsets, lower=True)
                h = h.view(np.int64)
                k = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[k] == h if len(keys) else np.zeros(len(h), bool)
                sums = [np.diff(np.concatenate([[0], np.cumsum(np.where(hit, x[k], 0) if len(keys) else np.zeros(len(h)))])[at]) for x in values]
                parts.append((np.diff(at), *sums, h[~hit], np.diff(np.concatenate([[0], np.cumsum(~hit)])[at])))
            if not parts:
                continue
            size, known, base, lp, pp, wp, rare, rares = (np.concatenate(x) for x in zip(*parts, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rares)]).astype(np.int32)), pa.array(rare))
            cols = [pa.array(uid + np.arange(len(size))), pa.array(size + 1), pa.array(known.astype(np.int64)), *map(pa.array, (base, lp, pp, wp)), lists]
            uid += len(size)
            fields = [batch.schema.field(i) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names) + 1)], *cols], schema=pa.schema([*fields, *[(x, c.type) for x, c in zip(("__uid", "__size", *SUMS, "__rare"), cols, strict=True)]]))

    partial = written(rows.mapInArrow(read, schema), "partial")
    times = lambda x: F.sum(F.col("__times") * x)
    rest = partial.select("__uid", F.explode("__rare").alias("h")).groupBy("__uid", "h").agg(F.count(F.lit(1)).alias("__times"))
    rest = rest.join(logs.where(F.col("m") < least).dropDuplicates(["h"]), "h").groupBy("__uid").agg(
        times((F.col("n") > 0).cast("long")).alias("more__known"), times(F.log10(F.col("n") + 1.0)).alias("more__base"), *[times(F.col(c)).alias(f"more__{c}") for c in ("lp", "pp", "wp")]
    )
    out = partial.drop("__rare").join(rest, "__uid", "left")
    plus = lambda c: F.col(c) + F.coalesce(F.col(f"more{c}"), F.lit(0))
    log = lambda x: F.lit(float(np.log10(x)))
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("__held").alias("held_out"),
        F.col("__size").alias("n_tokens"),
        (plus("__known") + int(ends > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (plus("__base") - F.col("__size") * F.lit(norm) + log(ends + 1)).alias("base_score"),
        (plus("__pp") + log(closing)).alias("score"),
        (plus("__lp") + log(end)).alias("fitted_score"),
        (plus("__wp") + log((ends + 0.5) / tokens)).alias("word_score"),
    )
