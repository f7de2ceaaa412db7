"""Substring dedup with a count-min prefilter: words covered by a window of ``length`` words that also stands elsewhere are removed.

1. Sketch. A window's key is its minimizer, the least hash among its GRAM-word runs: equal
   windows have equal keys, at different places, so counts of selected runs never fall below
   counts of windows. Each task counts the runs it selects in a count-min sketch (two rows,
   counts saturating at 2) and writes its non-zero cells in slices; slices are merged as a
   stream. The merged sketch is a bit per cell, "twice or more", of at most 2**MOST_BITS cells
   a row: 64 MB whatever the input. It is the only thing broadcast. On inputs that fill it, it
   lets more windows through and stays right.
2. Exact grouping. Only windows whose key is estimated at two or more are grouped, by a 128-bit
   hash, each task adding up its own first. The groups of one are the sketch's false alarms;
   they keep their row and position.
3. Removal. Each text joins its false alarms (broadcast while they are few); its other estimated windows are repeated.

Windows are judged on the input. Results depend on texts alone, so repeated rows are copies of
each other and lose their windows like any copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Powers, chunks, mixed, parts, texts, written

GRAM = 16
ROWS = 2
MOST_BITS = 28
SLICE_BITS = 18
#: False alarms (20 bytes each) that are broadcast to the texts; with more, the texts are shuffled to theirs.
FEW = 300_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every ``width`` neighbours; the result is width - 1 shorter."""
    step, out = 1, x
    while 2 * step <= width:
        out = op(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return op(out[:-rest], out[rest:]) if rest else out


class Windows:
    """Windows of the texts of one chunk: hashes, minimizers and where they are."""

    def __init__(self, length: int, seed: int = 11):
        self.length, self.gram = length, min(GRAM, length)
        self.hasher, self.second = Hasher(seed), Powers(0xD6E8FEB86659FD93)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.words, self.row_words, _, _ = self.hasher.of_words(data, offsets, lower=False)
        n, length = len(self.words), self.length
        self.valid = np.zeros(max(0, n - length + 1), bool)
        counts = np.diff(self.row_words)
        long = np.flatnonzero(counts >= length)
        if len(self.valid):
            marks = np.zeros(len(self.valid) + 1, np.int64)
            marks[self.row_words[long]] += 1
            marks[self.row_words[long] + counts[long] - length + 1] -= 1
            self.valid = np.cumsum(marks[:-1]) > 0
            self.grams = self.hasher.of_runs(self.words, self.gram) | np.uint64(1)
            self.least = _slide(self.grams, length - self.gram + 1, np.minimum)
        else:
            self.grams = self.least = np.zeros(0, np.uint64)

    def selected(self) -> np.ndarray:
        """Hashes of the runs that are the minimizer of some window, once for each place."""
        if not self.valid.any():
            return np.zeros(0, np.uint64)
        width = self.length - self.gram + 1
        of_window = np.where(self.valid, self.least, np.uint64(0))
        pad = np.zeros(width - 1, np.uint64)
        most = _slide(np.concatenate([pad, of_window, pad]), width, np.maximum)
        return self.grams[most == self.grams]

    def repeated(self, sketch: np.ndarray, bits: int) -> np.ndarray:
        """Indices of the valid windows that the sketch takes for repeated."""
        if not self.valid.any():
            return np.zeros(0, np.int64)
        heads = np.concatenate([[0], np.flatnonzero(np.diff(self.least)) + 1])
        key = self.least[heads]
        good = np.ones(len(heads), bool)
        for r in range(ROWS):
            cell = _cells(key, r, bits)
            good &= (sketch[r][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return np.flatnonzero(np.repeat(good, np.diff(np.append(heads, len(self.least)))) & self.valid)

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.hasher.of_runs(self.words, self.length)[at]
        self.second.to(len(self.words) + 1)
        sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(mixed(self.words + _ODD[1]) * self.second.up[: len(self.words)], out=sums[1:])
        return first, mixed((sums[at + self.length] - sums[at]) * self.second.down[at])


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(keys * _ODD[row]) >> np.uint64(64 - bits)


def _sketch(docs: DataFrame, text: str, length: int, bits: int) -> np.ndarray:
    """The merged sketch: for each row the bitmap of cells counted twice or more."""
    slice_bits = min(SLICE_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held, size = Windows(length), [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(*texts(batch.column(0))):
                w.read(data, offsets)
                held.append(w.selected())
                size += len(held[-1])
            if size > 4_000_000:
                yield from cells(held)
                held, size = [], 0
        if size:
            yield from cells(held)

    def cells(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held)
        for r in range(ROWS):
            cell, n = np.unique(_cells(keys, r, bits), return_counts=True)
            which = (cell >> np.uint64(slice_bits)).astype(np.int64)
            heads = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1])
            ends = np.append(heads[1:], len(cell))
            inner = ((cell & np.uint64((1 << slice_bits) - 1)) << np.uint64(1) | (n > 1).astype(np.uint64)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array((which[heads] * ROWS + r).astype(np.int32)), pa.array([zlib.compress(inner[a:b].tobytes(), 1) for a, b in zip(heads, ends, strict=True)], pa.binary())], names=["slice", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary())], names=["slice", "cells"])

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != now:
                    if now is not None:
                        yield out()
                    now, once, twice = s, np.zeros(1 << slice_bits, bool), np.zeros(1 << slice_bits, bool)
                x = np.frombuffer(zlib.decompress(blob), "<u4")
                cell = x >> 1
                twice[cell] |= once[cell] | ((x & 1) == 1)
                once[cell] = True
        if now is not None:
            yield out()

    sliced = docs.select(text).mapInArrow(count, "slice int, cells binary").repartition(parts(docs.sparkSession), "slice").sortWithinPartitions("slice")
    out = np.zeros((ROWS, max(1, (1 << bits) >> 3)), np.uint8)
    step = max(1, (1 << slice_bits) >> 3)
    for s, blob in sliced.mapInArrow(merge, "slice int, cells binary").toLocalIterator():
        part = np.frombuffer(zlib.decompress(bytes(blob)), np.uint8)
        out[s % ROWS, (s // ROWS) * step : (s // ROWS) * step + len(part)] = part
    return out


def removals(docs: DataFrame, text: str = "text", length: int = 35, keep_text: bool = False) -> DataFrame:
    """docs (without the text) with n_words, n_removed, kept_sha256 and, if keep_text, ``kept_text``.

    kept_text is the kept words joined by one blank. Null and empty texts have no words, and the
    digest of no bytes. Texts of fewer than ``length`` words have no window and stay whole; longer ones are
    treated whole, whatever their length. Repeated rows are copies of each other. New columns replace columns of those names.
    """
    spark = docs.sparkSession
    new = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    names = [c for c in docs.columns if c != text and c not in new]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(10, int(np.ceil(np.log2(max(1, size) / 60 * 8)))))
    sketch = _sketch(docs, text, length, bits)
    shared = spark.sparkContext.broadcast(zlib.compress(sketch.tobytes(), 1))

    def opened() -> np.ndarray:
        return np.frombuffer(zlib.decompress(shared.value), np.uint8).reshape(ROWS, -1)

    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("__text")).withColumn("__uid", F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if c in names and "map" not in t], "__text"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bitmap, held, n = Windows(length), opened(), [], 0
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for first, _, data, offsets in chunks(*texts(batch.column(1))):
                w.read(data, offsets)
                at = w.repeated(bitmap, bits)
                row = np.searchsorted(w.row_words, at, "right") - 1
                held.append((*w.hashes(at), uid[first + row], at - w.row_words[row]))
                n += len(at)
            if n > 1_500_000:
                yield added(held)
                held, n = [], 0
        if n:
            yield added(held)

    def added(held: list[tuple]) -> pa.RecordBatch:
        h1, h2, uid, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        heads = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        n = np.diff(np.append(heads, len(h1)))
        return pa.RecordBatch.from_arrays([pa.array(h1[heads].view(np.int64)), pa.array(h2[heads].view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8)), pa.array(uid[order][heads]), pa.array(pos[order][heads].astype(np.int32))], names=["h1", "h2", "n", "uid", "pos"])

    windows = rows.select("__uid", "__text").mapInArrow(group, "h1 long, h2 long, n byte, uid long, pos int")
    single = written(windows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("uid").alias("__uid"), F.min("pos").alias("pos")).where("n = 1").select("__uid", "pos", "h1"), "alarms")
    alarms = single.groupBy("__uid").agg(F.collect_list(F.struct("pos", "h1")).alias("__false"))
    few = single.limit(FEW + 1).count() <= FEW
    joined = rows.join(F.broadcast(alarms) if few else alarms, "__uid", "left").select(*[F.col(f"`{c}`") for c in names], "__text", "__false")
    schema = joined.drop("__text", "__false").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_sha256": F.lit("")} | ({"kept_text": F.lit("")} if keep_text else {})).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bitmap = Windows(length), opened()
        for batch in batches:
            false = batch.column(len(names) + 1)
            counts, gone, digests, kept_texts = [], [], [], []
            for first, end, data, offsets in chunks(*texts(batch.column(len(names)))):
                w.read(data, offsets)
                at = w.repeated(bitmap, bits)
                h1 = w.hashes(at)[0].view(np.int64)
                row = np.searchsorted(w.row_words, at, "right") - 1
                drop = np.zeros(len(at), bool)
                for i in np.unique(row).tolist():
                    if (alarm := false[first + i].as_py()) is not None:
                        lo, hi = np.searchsorted(row, [i, i + 1])
                        where = dict(zip((at[lo:hi] - w.row_words[i]).tolist(), range(lo, hi), strict=True))
                        for x in alarm:
                            if (k := where.get(x["pos"])) is not None and h1[k] == x["h1"]:
                                drop[k] = True
                at = at[~drop]
                marks = np.zeros(len(w.words) + 1, np.int64)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + length, -1)
                covered = np.cumsum(marks)[:-1] > 0
                raw = data.tobytes()
                for i in range(end - first):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    hit = covered[w.row_words[i] : w.row_words[i + 1]]
                    n = int(hit.sum())
                    if n:
                        words = [x for x, h in zip(words, hit.tolist(), strict=True) if not h]
                    kept = b" ".join(words)
                    counts.append(len(hit))
                    gone.append(n)
                    digests.append(sha256(kept).hexdigest())
                    if keep_text:
                        kept_texts.append(kept.decode())
            more = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())] + ([pa.array(kept_texts, pa.string())] if keep_text else [])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *more], schema=pa.schema([*[batch.schema.field(i) for i in range(len(names))], *[(n, a.type) for n, a in zip(new, more, strict=False)]]))

    return joined.mapInArrow(remove, schema)
