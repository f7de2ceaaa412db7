"""Language identification: averaged embeddings of hashed subwords, a linear softmax, stochastic gradient descent in numpy, calibrated rejection.

A subword is a run of 3 or 4 bytes of the lower-cased text inside a word or over one of its
ends. The hidden vector of a text is the mean of its subwords' embeddings; the softmax is linear
in it. As both are linear, prediction needs only one row of class scores per bucket, and a text
costs a few numpy operations a byte. It is fitted on the driver from a bounded sample of
labelled rows (FIT whole texts a language, the least by hash), with short excerpts of them
beside, so that short texts are learned too. CALIBRATE other rows a language then fix a
temperature. The rejection threshold is split conformal over every distinct labelled text that
wasn't fitted on, which are scored where they lie and only counted: with n of them, it is the
score of the right language that is the floor(ALPHA * (n + 1))th from below, so at most about
ALPHA of texts in a learned language are rejected. With fewer than 1 / ALPHA - 1 of them (999)
no threshold keeps to ALPHA, so only texts without a letter are rejected (``und``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts

BITS = 16
DIM = 16
#: Rows a language, at most, that the model is fitted on, and that its temperature is.
FIT = 300
CALIBRATE = 400
#: Share of texts in a learned language that may be rejected.
ALPHA = 0.001
#: Parts of the probability scale in which calibration scores are counted.
BINS = 1 << 16
LETTER = r"\p{L}"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (buckets, languages): embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    calibrated: int = 0  # texts that the threshold comes from

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of each text; data holds each text between two blanks."""
        bucket, row = subwords(data, offsets)
        n, k = len(offsets) - 1, len(self.langs)
        cuts = np.searchsorted(row, np.arange(n + 1))
        count = np.diff(cuts)
        total = np.zeros((n, k))
        some = count > 0
        if some.any():
            total[some] = np.add.reduceat(self.scores[bucket], cuts[:-1][some], axis=0, dtype=np.float64)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every subword, in order of row."""
    x = _FOLD[data]
    inner = x != 32
    u = x.astype(np.uint32)
    three = ((u[:-2] * np.uint32(0x01000193) ^ u[1:-1]) * np.uint32(0x01000193) ^ u[2:]) * np.uint32(0x9E3779B1) if len(x) > 2 else np.zeros(0, np.uint32)
    four = ((three[:-1] ^ np.uint32(0x55555555)) + u[3:] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) if len(x) > 3 else np.zeros(0, np.uint32)
    at3 = np.flatnonzero(inner[1:-1]) if len(three) else np.zeros(0, np.int64)
    at4 = np.flatnonzero(inner[1:-2] & inner[2:-1]) if len(four) else np.zeros(0, np.int64)
    at = np.concatenate([at3, at4])
    bucket = np.concatenate([three[at3], four[at4]]) >> np.uint32(32 - BITS)
    row = np.searchsorted(offsets, at, "right") - 1
    order = np.argsort(row, kind="stable")
    return bucket[order], row[order]


def padded(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join([b" " + t + b" " for t in some]), np.uint8), np.concatenate([[0], np.cumsum([len(t) + 2 for t in some])])


def _features(some: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their shares."""
    out = []
    for t in some:
        bucket, _ = subwords(*padded([t]))
        ids, n = np.unique(bucket.astype(np.uint16), return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(rows: list[tuple[bytes, str]], calibrate: list[tuple[bytes, str]], epochs: int = 4, rate: float = 2.0, seed: int = 7) -> Model:
    """Train on rows, fix the temperature on the others (on rows if there are none); the threshold is 0."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    rng, index = np.random.default_rng(seed), {x: i for i, x in enumerate(langs)}
    some, labels = [], []
    for t, lang in rows:
        words = t.split()
        cuts = [t]
        for size in (1, 3, 8, 25):
            if len(words) > size:
                i = int(rng.integers(0, len(words) - size))
                cuts.append(b" ".join(words[i : i + size]))
        some += cuts
        labels += [index[lang]] * len(cuts)
    features = _features(some)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weight, bias = np.zeros((len(langs), DIM)), np.zeros(len(langs))
    share = len(langs) / len(some) * np.bincount(labels, minlength=len(langs))
    steps = epochs * len(some)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(some)):
            ids, part = features[i]
            if len(ids):
                hidden = part @ embed[ids]
                z = weight @ hidden + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                # No step goes further than the text's own curvature allows: short texts and rare languages else run away.
                step = rate * (1 - done / steps) / share[labels[i]]
                p *= step / max(1.0, step * (hidden @ hidden + (part @ part) * len(ids) ** 0.5 * (weight * weight).sum()))
                back = p @ weight
                weight -= np.outer(p, hidden)
                bias -= 0.01 * p
                embed[ids] -= np.outer(part * len(ids) ** 0.5, back)
            done += 1
    model = Model(langs, (embed @ weight.T).astype(np.float32), bias)
    del features
    held = [(t, index[lang]) for t, lang in calibrate or rows if lang in index]

    def probabilities() -> np.ndarray:
        """One text at a time, so that the driver holds the subwords of one."""
        return np.concatenate([model.probabilities(*padded([t])) for t, _ in held])

    p = probabilities()
    logits, truth = np.log(np.maximum(p, 1e-300)), np.array([k for _, k in held])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    model.temperature = min(np.geomspace(0.2, 20, 60), key=loss)
    return model


def threshold(counts: dict[int, int], alpha: float = ALPHA) -> float:
    """Split conformal threshold from counts of scores by their part of BINS: the lower edge of the part that holds the floor(alpha * (n + 1))th score from below; 0 where that is none."""
    rank = int(alpha * (sum(counts.values()) + 1) + 1e-9)
    if rank < 1:
        return 0.0
    for part in sorted(counts):
        rank -= counts[part]
        if rank <= 0:
            return part / BINS
    return 0.0


def calibrated(rows: DataFrame, model: Model, fitted: dict[str, int], alpha: float = ALPHA) -> Model:
    """model with the threshold of the distinct texts of rows (t, l, h) whose h is above that of the last fitted text of their language."""
    index, shared = {x: i for i, x in enumerate(model.langs)}, rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truth, score = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64), np.zeros(len(batch))
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), batch.column(0).cast(pa.large_string()), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
            for a, b, data, offsets in chunks(*texts(spaced)):
                score[a:b] = shared.value.probabilities(data, offsets)[np.arange(b - a), truth[a:b]]
            part = np.minimum((score * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(part)], names=["l", "h", "part"])

    last = F.create_map(*[x for name, h in fitted.items() for x in (F.lit(name), F.lit(h))])
    # A text without a letter is und whatever its score.
    others = rows.where((F.col("h") > last[F.col("l")]) & F.col("t").rlike(LETTER)).select("t", "l", "h")
    once = others.mapInArrow(run, "l string, h long, part int").groupBy("l", "h").agg(F.min("part").alias("part"))
    counts = {r["part"]: r["count"] for r in once.groupBy("part").count().collect()}
    model.threshold, model.calibrated = threshold(counts, alpha), sum(counts.values())
    return model


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_lang: int = FIT, calibrate: int = CALIBRATE, alpha: float = ALPHA) -> Model:
    """Fit on the rows where ``learn`` holds and text and lang are there: per_lang + calibrate rows a language, at most, the least by a hash of the text; then set the threshold by all that weren't fitted on."""
    rows = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    bound, ring = per_lang + calibrate, 1 << 40
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("t"), F.lit(ring)))
    # The cut is set by distinct texts, so that copies take no text's place.
    counts = hashed.select("l", "h").distinct().groupBy("l").count().collect()
    if not counts:
        return fit([], [])
    cut = F.create_map(*[x for r in counts for x in (F.lit(r["l"]), F.lit(int(ring * min(1.0, 1.3 * (bound + 20) / r["count"]))))])
    # Each text once: copies of a text that falls below the cut are added up where they are read.
    once = hashed.where(F.col("h") < cut[F.col("l")]).dropDuplicates(["l", "h"])
    sample: dict[str, list[tuple[int, bytes]]] = {}
    for r in once.toLocalIterator():
        sample.setdefault(r["l"], []).append((r["h"], r["t"].encode()))
    fitted, held, last = [], [], {}
    for name, found in sorted(sample.items()):
        found = sorted(found)[:bound]
        to = min(per_lang, max(1, len(found) * 2 // 3))
        fitted += [(t, name) for _, t in found[:to]]
        held += [(t, name) for _, t in found[to:]]
        last[name] = found[to - 1][0]
    model = fit(fitted, held)
    return calibrated(hashed, model, last, alpha) if model.langs else model


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (calibrated probability, 0 to 1) and rejected.

    A null text and one without a letter get ``und``, score 0, rejected; so does every text when
    nothing was learned. Equally probable languages: the first of the learned ones in order. Repeated rows fare alike. Empty tables stay empty;
    columns of those names are replaced. Long texts are read whole.
    """
    new = ["lang_pred", "score", "rejected"]
    names = [c for c in docs.columns if c not in new]
    base = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("__letter", F.coalesce(F.col(text).rlike(LETTER), F.lit(False)))
    schema = base.drop("__letter").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = np.array([*m.langs, "und"], object)
        for batch in batches:
            letter = batch.column(len(names)).to_numpy(zero_copy_only=False)
            best, score = np.full(len(letter), len(m.langs)), np.zeros(len(letter))
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), batch.column(at).cast(pa.large_string()).fill_null(""), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
            if m.langs:
                for a, b, data, offsets in chunks(*texts(spaced)):
                    p = m.probabilities(data, offsets)
                    best[a:b], score[a:b] = p.argmax(axis=1), p.max(axis=1)
            best[~letter], score[~letter] = len(m.langs), 0.0
            rejected = (best == len(m.langs)) | (score < m.threshold)
            cols = [pa.array(known[best].tolist(), pa.string()), pa.array(score), pa.array(rejected)]
            fields = [batch.schema.field(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *cols], schema=pa.schema([*fields, *[(n, c.type) for n, c in zip(new, cols, strict=True)]]))

    return base.mapInArrow(run, schema)
