"""Sum-of-squares packing of tokenized documents into sequences.

A document is its ids and one end id; only one longer than a sequence is cut, into pieces as long as a
sequence and a last one. With N(g) open sequences of gap g, each piece goes where the sum of N(g)^2
becomes smallest: into an open sequence or a new one (ties: the smallest gap, then an open one). Every
task packs the pieces of its own part. What its sequences leave open at the end is taken out and packed
once more, longest piece first into the smallest gap, if that takes fewer sequences. The open sequences
that are left (at most OPEN a task, those of the greatest gaps) go on in groups of FAN tasks,
to be packed together in the same way, until one group is left; so no task ever holds more than FAN * OPEN
open sequences, and no row but those passes a shuffle.

Ids are made word by word: the tokenizer drops white space and no token crosses it, so a text's ids are
those of its words in a row (words are cut at ASCII white space). A worker keeps the ids of the words
it has seen in a bounded memo.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .sentpiece import groups

SIZE = 2048
END = 0
#: Open sequences that a task hands on at most, and tasks whose open sequences are packed together.
OPEN = 4096
FAN = 16
#: Pieces packed before closed sequences are handed out, and words whose ids a worker keeps.
BLOCK = 50_000
MEMO = 1_200_000


def vocabulary(path: str | None = None) -> str:
    """The tokenizer's file as text, read on the driver; tasks get it by broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


_ENDS = b".,;:!?"
_OPEN = b"<|"


class _Words:
    """Ids of words, kept from task to task of a worker.

    The tokenizer lowers case and takes runs of letters, single digits and runs of the rest apart, so A-Z may be lowered
    first, and marks behind an ASCII letter or digit make a run of their own. Words that could hold a special token stay as they are.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_str(source), {}

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each text; null has none."""
        raw = [(t or "").encode() for t in texts]
        split = [(x if _OPEN in x else x.lower()).split() for x in raw]
        memo = self.memo
        new = set().union(*split).difference(memo)
        parts, plain = [], set()
        for w in new:
            base = w.rstrip(_ENDS)
            if len(base) < len(w) and base[-1:].isalnum() and _OPEN not in w:
                parts.append((w, base, w[len(base) :]))
                plain.update((base, w[len(base) :]))
            else:
                plain.add(w)
        known = len(memo)
        words = list(plain.difference(memo))
        memo.update(zip(words, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)), strict=True))
        memo.update([(w, memo[base] + memo[tail]) for w, base, tail in parts])
        out = [b"".join([memo[w] for w in s]) for s in split]
        if len(memo) > MEMO and known > MEMO // 2:  # full: the words that came first stay, rare ones are made again
            for w in [*words, *(w for w, _, _ in parts)]:
                memo.pop(w, None)
        return out


#: The tokenizers of a worker, by the digest of their file.
_KNOWN: dict[int, _Words] = {}


def _words(source: str) -> _Words:
    key = zlib.crc32(source.encode())
    if key not in _KNOWN:
        _KNOWN[key] = _Words(source)
    return _KNOWN[key]


def pieces(docs: DataFrame, text: str = "text", size: int = SIZE, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of at most ``size`` ids: doc_id, piece, start, length, ids_crc32 and, if keep_ids, ``ids``.

    Null text counts as empty: one piece of the end id alone. doc_id may be of any type, null or repeated.
    """
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    new = {"piece": ("int", pa.int32()), "start": ("long", pa.int64()), "length": ("long", pa.int64()), "ids_crc32": ("long", pa.int64())} | ({"ids": ("array<int>", pa.list_(pa.int32()))} if keep_ids else {})
    rows = docs.select("doc_id", F.col(text).alias("__text"))
    schema = rows.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, (t, _) in new.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(source.value), np.array([END], "<u4").tobytes()
        for batch in batches:
            row = 0
            for some in groups(batch.column(1).to_pylist(), 1 << 22):
                out: list[tuple] = []
                which = []
                for raw in words.ids(some):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[a : a + 4 * size]
                        out.append((k, k * size, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if keep_ids else [])))
                        which.append(row)
                    row += 1
                arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *arrays], schema=pa.schema([batch.schema.field(0), *[pa.field(c, t) for c, (_, t) in new.items()]]))

    return rows.mapInArrow(run, schema)


class Packer:
    """Open sequences by gap; ``held`` lists the pieces of each by number, in order."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.counts = np.zeros(self.size, np.int64)
        self.stacks: list[list[list[int]]] = [[] for _ in range(self.size)]
        self.closed: list[list[int]] = []

    def open(self) -> list[tuple[int, list[int]]]:
        """(gap, pieces) of the open sequences, the greatest gap first."""
        return [(g, b) for g in range(self.size - 1, 0, -1) for b in self.stacks[g]]

    def _put(self, gap: int, held: list[int]) -> None:
        if gap:
            self.counts[gap] += 1
            self.stacks[gap].append(held)
        else:
            self.closed.append(held)

    def _take(self, gap: int) -> list[int]:
        self.counts[gap] -= 1
        return self.stacks[gap].pop()

    def add(self, piece: int, length: int) -> None:
        """Into the sequence, open or new, after which the sum of squared counts is smallest."""
        if length == self.size:
            self.closed.append([piece])
            return
        before = self.counts[length:]
        change = 2 * (self.counts[: self.size - length] - before) + 2
        change[0] = 1 - 2 * before[0]  # the sequence is full and no longer counted
        change[before == 0] = 1 << 60
        k = int(change.argmin())
        if change[k] <= 2 * self.counts[self.size - length] + 1:
            held = self._take(length + k)
            held.append(piece)
            self._put(k, held)
        else:
            self._put(self.size - length, [piece])

    def tighten(self, lengths: np.ndarray) -> None:
        """Pack what the open sequences hold anew, longest piece first into the smallest gap, if that takes fewer."""
        old = self.open()
        inside = sorted((p for _, b in old for p in b), key=lambda p: (-lengths[p], p))
        other = Packer(self.size)
        for p in inside:
            n = int(lengths[p])
            fits = np.flatnonzero(other.counts[n:])
            other._put(*((int(fits[0]), other._take(n + int(fits[0])) + [p]) if len(fits) else (self.size - n, [p])))
        if len(other.closed) + int(other.counts.sum()) < len(old):
            self.counts, self.stacks = other.counts, other.stacks
            self.closed += other.closed


class _Rows:
    """Packs rows as they come and hands them out with sequence_id, offset and group (of what goes on to be packed with others)."""

    def __init__(self, size: int, first: int, group: int | None):
        self.packer, self.next, self.group = Packer(size), first, group
        self.rows: pa.Table | None = None

    def add(self, rows: pa.Table) -> Iterator[pa.Table]:
        for at in range(0, rows.num_rows, BLOCK):
            part = rows.slice(at, BLOCK)
            old = 0 if self.rows is None else self.rows.num_rows
            self.rows = part if self.rows is None else pa.concat_tables([self.rows, part])
            for k, n in enumerate(part["length"].to_pylist(), old):
                self.packer.add(k, n)
            left = self.packer.open()
            yield self._given(self.packer.closed + [b for _, b in left[OPEN:]], None)
            left = left[:OPEN]
            inside = [p for _, b in left for p in b]
            number = {p: k for k, p in enumerate(inside)}
            self.packer.clear()
            for g, b in reversed(left):
                self.packer._put(g, [number[p] for p in b])
            self.rows = self.rows.take(pa.array(inside, pa.int64())).combine_chunks()

    def end(self) -> Iterator[pa.Table]:
        if self.rows is None:
            return
        self.packer.tighten(self.rows["length"].to_numpy())
        yield self._given(self.packer.closed, None)
        yield self._given([b for _, b in self.packer.open()], self.group)

    def _given(self, bins: list[list[int]], group: int | None) -> pa.Table:
        order = [p for b in bins for p in b]
        sizes = np.array([len(b) for b in bins], np.int64)
        out = self.rows.take(pa.array(order, pa.int64()))
        lengths = out["length"].to_numpy().astype(np.int64)
        ends = np.cumsum(lengths)
        heads = np.cumsum(sizes) - sizes
        offsets = ends - lengths - np.repeat((ends - lengths)[heads] if len(heads) else heads, sizes)
        ids = np.repeat(self.next + np.arange(len(bins)), sizes)
        self.next += len(bins)
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).append_column("__group", pa.array([group] * len(order), pa.int64()))


def _together(size: int, level: int, last: bool, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Packs what FAN tasks left open, in an order that doesn't hang on how it arrives; of the last level nothing goes on."""

    def run(t: pa.Table) -> pa.Table:
        group = t["__to"][0].as_py()
        state = _Rows(size, level << 57 | group << 32, None if last else group)
        t = t.sort_by([(c, "ascending") for c in ("__group", "sequence_id", "offset")]).select(names[:-3])
        mixed = np.random.default_rng(len(t)).permutation(len(t))
        return pa.concat_tables([*state.add(t.take(pa.array(mixed))), *state.end()])

    return run


def packed(docs: DataFrame, text: str = "text", size: int = SIZE, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id (any number) and offset: where each lies; sequences hold at most ``size`` ids.

    Null text counts as empty (the end id alone); repeated rows are packed each; a text of any length is
    cut as said, never shortened; ties are broken as said above; no rows give no pieces. Columns but doc_id and text are left out.
    """
    rows = written(pieces(docs, text, size, path, keep_ids), "pieces")
    schema = rows.select("*", *[F.lit(None).cast("long").alias(c) for c in ("sequence_id", "offset", "__group")]).schema
    names = schema.names

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = _Rows(size, part << 32, part)
        for batch in batches:
            for t in state.add(pa.Table.from_batches([batch])):
                yield from t.combine_chunks().to_batches()
        for t in state.end():
            yield from t.combine_chunks().to_batches()

    level, out = 0, []
    now = written(rows.mapInArrow(first, schema), "packed")
    groups = [r[0] for r in now.select("__group").distinct().where("__group IS NOT NULL").collect()]
    while groups:
        out.append(now.where(F.col("__group").isNull()))
        level, last = level + 1, len({g // FAN for g in groups}) == 1

        together = now.where(F.col("__group").isNotNull()).withColumn("__to", F.floor(F.col("__group") / FAN))
        now = written(together.groupBy("__to").applyInArrow(_together(size, level, last, names), schema), "packed")
        groups = [] if last else sorted({g // FAN for g in groups})
    out.append(now)
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0].drop("__group")


def sequences(packed_rows: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids and starts (of each piece in it) of packed(keep_ids=True): the sequences to train on."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed_rows.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
