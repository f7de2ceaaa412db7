"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space marker.

The vocabulary is read, never trained. A unigram model's scores are log scores as they stand; a
BPE model's are merge ranks, and its pieces get the log scores of those ranks under Zipf's law. No
piece has the marker after another character or holds a newline, so the best path of a text is
the best paths of its runs "spaces, then word" one after another; Codec checks that.
Runs are segmented once for each task and kept in a bounded memo. Text is not normalised: a
blank is put in front, blanks become the marker, and a marker in the text itself, like any
character without a piece, falls to the pieces of its bytes; so decode(encode(x)) is x.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lattice
from .common import CHUNK

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MARK = lattice.MARK.encode()
_RUNS = re.compile(rb"\n|\xe2\x96\x81| *(?:(?!\xe2\x96\x81)[^ \n])+| +")
#: Distinct runs kept by a task; beyond it the memo starts anew.
MEMO = 400_000


class Codec:
    def __init__(self, vocabulary: lattice.Vocabulary):
        self.vocabulary = v = vocabulary
        usable = [v.pieces[i] for i in np.flatnonzero(v.usable)]
        if any(b"\n" in p or b" " in p.replace(_MARK, b" ").lstrip(b" ") for p in usable):
            raise ValueError("a piece crosses a word start or a newline; runs can't be cut there")
        self.scores = lattice.log_scores(v)
        self.unknown = float(self.scores[v.usable].min()) - 10.0
        plain = [p.replace(_MARK, b" ") for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            plain[i] = bytes([b])
        self.plain = plain
        self.is_byte = np.zeros(len(plain), bool)
        self.is_byte[v.byte_ids[v.byte_ids >= 0]] = True
        self.memo: dict[bytes, bytes] = {}

    def learn(self, runs: set[bytes]) -> None:
        """Segment runs that the memo hasn't got; ids are kept as little-endian int32 bytes."""
        v, todo = self.vocabulary, []
        for run in runs:
            if run in (b"\n", _MARK):
                self.memo[run] = v.byte_ids[np.frombuffer(run, np.uint8)].astype("<i4").tobytes()
            else:
                todo.append(run)
        for at in range(0, len(todo), 50_000):
            some = todo[at : at + 50_000]
            marked = [r.replace(b" ", _MARK) for r in some]
            g = lattice.build(v, marked)
            paths, _ = lattice.viterbi(g, self.scores, self.unknown)
            data = b"".join(marked)
            for run, path in zip(some, paths, strict=True):
                ids = g.piece[path]
                if (ids < 0).any():
                    out: list[int] = []
                    for e in path.tolist():
                        if g.piece[e] >= 0:
                            out.append(int(g.piece[e]))
                        else:
                            w = int(g.word[e])
                            out += v.byte_ids[np.frombuffer(data[int(g.source[e]) - w : int(g.target[e]) - w], np.uint8)].tolist()
                    ids = np.array(out)
                self.memo[run] = ids.astype("<i4").tobytes()

    def encode(self, some: list[str | None]) -> list[bytes | None]:
        """Ids of each text as little-endian int32 bytes; null gives null, the empty text no ids."""
        split = [None if t is None else _RUNS.findall(b" " + t.encode()) if t else [] for t in some]
        new = set().union(*[s for s in split if s]) - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*[s for s in split if s])
        self.learn(new)
        return [None if s is None else b"".join([self.memo[r] for r in s]) for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a text from its ids."""
        return b"".join([self.plain[i] for i in ids.tolist()])[1:]


def groups(some: list[str | None], most: int = CHUNK) -> Iterator[list[str | None]]:
    out, size = [], 0
    for t in some:
        out.append(t)
        size += len(t or "")
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def encoded(docs: DataFrame, text: str = "text", model: str = MODEL, pieces: str = "pieces", decoded: str = "decoded") -> DataFrame:
    """docs with ``pieces`` (array of ids) and ``decoded`` (the text made of them again).

    Null text: both null. Empty text: no ids and the empty text. Columns of those names are replaced.
    """
    keep = [c for c in docs.columns if c not in (pieces, decoded)]
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = base.select("*", F.lit(None).cast("array<int>").alias(pieces), F.lit(None).cast("string").alias(decoded)).schema
    at, source = keep.index(text), docs.sparkSession.sparkContext.broadcast(lattice.read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lattice.parsed(source.value))
        for batch in batches:
            row = 0
            for some in groups(batch.column(at).to_pylist()):
                ids = codec.encode(some)
                lists = [None if x is None else np.frombuffer(x, "<i4") for x in ids]
                back = [None if x is None else codec.decode(x).decode() for x in lists]
                flat = np.concatenate([x for x in lists if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists])]).astype(np.int32)
                array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in lists]))
                part = batch.slice(row, len(some))
                row += len(some)
                yield pa.RecordBatch.from_arrays([*part.columns, array, pa.array(back, pa.string())], names=[*keep, pieces, decoded])

    return base.mapInArrow(run, schema)


def byte_pieces(ids: Column, model: str = MODEL) -> Column:
    """How many of the ids are byte pieces (their ids are a contiguous range)."""
    at = lattice.load(model).byte_ids
    lo, hi = int(at.min()), int(at.max())
    assert hi - lo == 255
    return F.size(F.filter(ids, lambda x: (x >= lo) & (x <= hi)))


def digests(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_sha256 (of little-endian int32 ids), decoded_sha256, exact: digests of what encoded() returns, made where the ids are.

    A null text has nulls beside its id, the empty text no ids; each row stands alone, repeated
    ones alike; an empty table stays empty. doc_id may be of any type.
    """
    rows = docs.select("doc_id", F.col(text).alias("text"))
    new = {"n_pieces": "long", "n_byte_pieces": "long", "ids_sha256": "string", "decoded_sha256": "string", "exact": "boolean"}
    schema = rows.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema
    source = docs.sparkSession.sparkContext.broadcast(lattice.read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        codec = Codec(lattice.parsed(source.value))
        for batch in batches:
            out: list[tuple] = []
            for some in groups(batch.column(1).to_pylist()):
                for t, raw in zip(some, codec.encode(some), strict=True):
                    if raw is None:
                        out.append((None,) * 5)
                        continue
                    ids = np.frombuffer(raw, "<i4")
                    back = codec.decode(ids)
                    out.append((len(ids), int(codec.is_byte[ids].sum()), sha256(raw).hexdigest(), sha256(back).hexdigest(), back == t.encode()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], schema=pa.schema([batch.schema.field(0), *zip(new, kinds, strict=True)]))

    return rows.mapInArrow(run, schema)
