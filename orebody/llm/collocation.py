"""Phrase collocations: word ids from a merged dictionary, n-grams as fixed-width keys, sorted in ranges and counted by runs.

A piece is what stands between `.,;:!?` and line ends, a word what stands between blanks and tabs in
it, A-Z in lower case. Texts are read once: a task gives each word of a chunk (some million words of
one language, cut between pieces) a number of its own, and beside the numbered chunk a row for each
distinct word with its count. Those rows, not the words of the texts, are summed to the dictionary of
words that are frequent enough and joined back, so a word stands at most once a chunk on the wire and
no dictionary is broadcast. Rare words and the ends of pieces become breaks.

An n-gram's key is its ids, four big-endian bytes each. For n = 2, 3, 4 the keys of each task are
counted, dealt by ranges of the key, sorted and summed over runs of equal keys. A longer phrase is
never more frequent than its parts, so 3- and 4-grams are only counted where both their parts pass
a bitmap of the frequent ones; it never loses a key (it may let rare ones through, whose count then
drops them).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_unique, mixed, parts, written

#: Words of a numbered chunk, and the distinct keys that a task holds before it passes them on.
CHUNK_WORDS = 1_000_000
HELD = 2_000_000
MOST_BITS = 27
LONGEST = 4
#: Rows of a language that one window sorts, about.
SORTED = 200_000
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class _Numbers(dict):
    """Numbers words from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


_NUMBERED = "chunk long, lang string, codes binary, word binary, code int, n long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows as chunks: a row with the codes (0: end of a piece), and one for each distinct word."""
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("word", pa.binary()), ("code", pa.int32()), ("n", pa.int64())])
    chunk, held = TaskContext.get().partitionId() << 32, {}

    def closed(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal chunk
        numbers, codes = held.pop(lang)
        counts = np.bincount(np.frombuffer(codes, np.int32), minlength=len(numbers) + 1)
        yield pa.RecordBatch.from_pydict({"chunk": [chunk], "lang": [lang], "codes": [codes.tobytes()], "word": [None], "code": [None], "n": [int(counts[1:].sum())]}, schema=schema)
        words, size = list(numbers), len(numbers)
        for at in range(0, size, 50_000):
            some = words[at : at + 50_000]
            m = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, chunk)), pa.array([lang] * m, pa.string()), pa.nulls(m, pa.binary()), pa.array(some, pa.binary()), pa.array(np.arange(at + 1, at + m + 1, dtype=np.int32)), pa.array(counts[at + 1 : at + m + 1])], schema=schema
            )
        chunk += 1

    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            if lang not in held:
                held[lang] = (_Numbers(), array("i"))
            numbers, codes = held[lang]
            for piece in text.encode().translate(_TABLE).split(b"\n"):
                words = piece.split()
                if not words:
                    continue
                codes.extend(map(numbers.__getitem__, words))
                codes.append(0)
                if len(codes) >= CHUNK_WORDS:
                    total -= len(codes)
                    yield from closed(lang)
                    held[lang] = numbers, codes = _Numbers(), array("i")
        total = sum(len(c) for _, c in held.values())
        if total >= 2 * CHUNK_WORDS:
            for lang in list(held):
                yield from closed(lang)
    for lang in list(held):
        yield from closed(lang)


def _gapless(df: DataFrame, name: str) -> DataFrame:
    """df (a written table) with numbers from 1 in the order of its files."""
    at = df.withColumn("__m", F.monotonically_increasing_id())
    counts = sorted((r[0], r[1]) for r in at.groupBy(F.shiftright("__m", 33).alias("p")).count().collect())
    starts, n = [], 1
    for p, c in counts:
        starts.append((p, n))
        n += c
    where = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 1)], "__p long, __s long"))
    return at.withColumn("__p", F.shiftright("__m", 33)).join(where, "__p").withColumn(name, F.col("__s") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__s")


def _coded(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks with dictionary ids for codes (little-endian uint32; 0 for rare words and ends of pieces)."""

    def mapped(words: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for codes in rows["codes"]:
            codes = np.frombuffer(codes, np.int32)
            table = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
            table[words["code"].to_numpy()] = words["id"].to_numpy()
            found = table[codes]
            keep = np.ones(len(found), bool)
            keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
            out.append(found[keep].astype("<u4").tobytes())
        return pd.DataFrame({"ids": out})

    return ids.groupBy("chunk").cogroup(chunks.groupBy("of")).applyInPandas(mapped, "ids binary")


def _hashed(grams: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row of ids."""
    h = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + grams[:, j].astype(np.uint64) + np.uint64(1))
    return h


def _cells(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = _hashed(grams)
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64), (h >> np.uint64(64 - bits)).astype(np.int64)


def _passes(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 64).bit_length() - 1
    ok = np.ones(len(grams), bool)
    for cell in _cells(grams, bits):
        ok &= (bitmap[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _keys(batch: pa.RecordBatch, column: int, n: int) -> np.ndarray:
    """A binary column of keys of n ids as rows of ids."""
    col = batch.column(column)
    _, _, data = col.buffers()
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(">u4").reshape(-1, n) if len(col) else np.zeros((0, n), ">u4")


def _bitmap(frequent: DataFrame, n: int) -> np.ndarray:
    """Bits of the frequent n-grams, two each; at least 16 bits a key up to 2**27 bits (16 MB), which bounds what is collected and broadcast."""
    bits = min(MOST_BITS, max(12, (16 * max(1, frequent.count()) - 1).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.concatenate(_cells(_keys(batch, 0, n), bits))
            yield pa.RecordBatch.from_arrays([pa.array(cell >> 6), pa.array((np.uint64(1) << (cell & 63).astype(np.uint64)).view(np.int64))], names=["w", "b"])

    rows = frequent.select("key").mapInArrow(marks, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _binary(grams: np.ndarray) -> pa.Array:
    n, width = len(grams), 4 * grams.shape[1]
    data = np.ascontiguousarray(grams, ">u4")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, width * n + 1, width, dtype=np.int32)), pa.py_buffer(data)])


def _unique(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in the order of their keys, and their summed counts."""
    if not len(grams):
        return grams, counts
    high = grams[:, 0].astype(np.uint64) << np.uint64(32) | grams[:, 1]
    if grams.shape[1] == 2:
        order = np.argsort(high, kind="stable")
    else:
        low = grams[:, 2].astype(np.uint64) << np.uint64(32) | (grams[:, 3] if grams.shape[1] == 4 else np.uint64(0))
        order = np.lexsort((low, high))
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)]))
    return grams[first], np.add.reduceat(counts[order], first)


def _grams(coded: DataFrame, n: int, bitmap: np.ndarray | None) -> DataFrame:
    """key, c: n-grams that each task has counted; those of a part that the bitmap (of the frequent (n-1)-grams) doesn't hold are left out."""
    sc = coded.sparkSession.sparkContext
    sent = None if bitmap is None else sc.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def given() -> Iterator[pa.RecordBatch]:
            grams, counts = _unique(np.concatenate([g for g, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            for at in range(0, len(grams), 100_000):
                yield pa.RecordBatch.from_arrays([_binary(grams[at : at + 100_000]), pa.array(counts[at : at + 100_000])], names=["key", "c"])

        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                if len(ids) < n:
                    continue
                ok = ids[: len(ids) - n + 1] != 0
                for j in range(1, n):
                    ok &= ids[j : len(ids) - n + 1 + j] != 0
                if sent is not None:
                    at = np.flatnonzero(ok)
                    whole = np.zeros(len(ids) - n + 2, bool)
                    near = np.unique(np.concatenate([at, at + 1]))
                    part = np.stack([ids[near + j] for j in range(n - 1)], axis=1)
                    whole[near] = _passes(sent.value, part)
                    ok &= whole[:-1] & whole[1:]
                at = np.flatnonzero(ok)
                if len(at):
                    held.append(_unique(np.stack([ids[at + j] for j in range(n)], axis=1), np.ones(len(at), np.int64)))
                if sum(len(g) for g, _ in held) >= HELD:
                    yield from given()
        if held:
            yield from given()

    return coded.mapInArrow(run, "key binary, c long")


def _counted(keys: DataFrame, n: int, least: int) -> DataFrame:
    """key, f of the n-grams found ``least`` times or more: keys in ranges, sorted, equal ones in runs."""
    width = 4 * n

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, counts = _keys(batch, 0, n), batch.column(1).to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)]))
            sums = np.add.reduceat(counts, heads)
            grams = grams[heads]
            if last is not None and (grams[0] == last).all():
                sums[0] += total
            elif last is not None:
                grams, sums = np.concatenate([last[None], grams]), np.concatenate([[total], sums])
            last, total = grams[-1].copy(), int(sums[-1])
            keep = np.flatnonzero(sums[:-1] >= least)
            if len(keep):
                yield pa.RecordBatch.from_arrays([_binary(grams[keep]), pa.array(sums[keep])], names=["key", "f"])
        if last is not None and total >= least:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(last, ">u4").tobytes()[:width]], pa.binary()), pa.array([total])], names=["key", "f"])

    return keys.repartitionByRange(parts(keys.sparkSession), "key").sortWithinPartitions("key").mapInArrow(runs, "key binary, f long")


def _part(key: Column | str, start: int | Column, words: int | Column) -> Column:
    return F.substring(key, F.lit(1) + 4 * F.lit(start), 4 * F.lit(words))


def phrases(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dictionary: lang, word, id, f; words: lang, n; frequent: key, f for 1 to 4 words), written tables.

    Null text counts as empty, null lang as `und`; repeated rows count each. Only lang and text are read.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    numbered = written(rows.mapInArrow(_numbered, _NUMBERED), "numbered")
    chunks = numbered.where(F.col("word").isNull())
    words = numbered.where(F.col("word").isNotNull())
    totals = written(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    common = written(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "words")
    dictionary = written(_gapless(common, "id"), "dictionary")
    ids = words.select("chunk", "lang", "word", "code").join(dictionary.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "code", "id")
    coded = written(_coded(ids, chunks.select(F.col("chunk").alias("of"), "codes")), "coded")
    found, bitmap = [], None
    for n in range(2, LONGEST + 1):
        frequent = written(_counted(written(_grams(coded, n, bitmap), f"grams{n}"), n, least), f"frequent{n}")
        found.append(frequent)
        if n < LONGEST:
            bitmap = _bitmap(frequent, n)
    single = dictionary.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f")
    return dictionary, totals, written(single.unionByName(found[0]).unionByName(found[1]).unionByName(found[2]), "frequent")


def scored(frequent: DataFrame) -> DataFrame:
    """key, a, l, r, score of the candidates that stay: the lowest-scoring cut of each phrase of 2 words or more; those held in a longer phrase at 80 % of their count or more go."""
    many = frequent.where(F.length("key") > 4)
    cuts = many.select("key", F.col("f").alias("a"), F.explode(F.expr("sequence(1, CAST(length(key) DIV 4 - 1 AS INT))")).alias("k"))
    cuts = cuts.select("key", "a", "k", _part("key", 0, F.col("k")).alias("first"), F.expr("substring(key, 1 + 4 * k)").alias("rest"))
    part = lambda name, count: frequent.select(F.col("key").alias(name), F.col("f").alias(count))
    cuts = join_unique(written(cuts, "cuts"), part("first", "l"), "first")
    cuts = join_unique(written(cuts.drop("first"), "cuts"), part("rest", "r"), "rest")
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = cuts.withColumn("score", score).groupBy("key").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = many.where(F.length("key") > 8).select("key", "f", (F.length("key") / 4).cast("int").alias("n"))
    inner = inner.select("key", "f", "n", F.explode(F.expr("sequence(2, n - 1)")).alias("m")).select("f", "key", "m", F.explode(F.expr("sequence(0, n - m)")).alias("s"))
    inner = inner.select(_part("key", F.col("s"), F.col("m")).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    out = best.join(inner, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 80 * F.col("a")))
    return out.select("key", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))


def _decoded(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows with phrase, the words of their key."""
    each = rows.select("key", F.posexplode(F.expr("transform(sequence(0, CAST(length(key) DIV 4 - 1 AS INT)), i -> CAST(conv(hex(substring(key, 1 + 4 * i, 4)), 16, 10) AS BIGINT))")).alias("i", "id"))
    words = join_unique(written(each, "ids"), dictionary.select("id", F.col("word").cast("string").alias("word")), "id")
    names = words.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return rows.join(names, "key")


def collocations(docs: DataFrame, most: int = 2000, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's ``most`` best phrases: lang, rank, phrase, a, l, r, n, score.

    Null text counts as empty, null lang as `und`; repeated rows count each; texts of any length are
    read whole. Ties in score go by a, then by phrase in byte order, so ranks are definite. Other
    columns are not read, whatever their names. No rows: no phrases. A language's rows are first
    ranked in salted parts of about 200,000, of which the best go on.
    """
    dictionary, totals, frequent = phrases(docs, least, text, lang)
    rows = written(scored(frequent).withColumn("first", F.conv(F.hex(_part("key", 0, 1)), 16, 10).cast("long")), "scored")
    rows = join_unique(rows, dictionary.select(F.col("id").alias("first"), "lang"), "first").drop("first")
    salts = max(1, rows.count() // SORTED)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    by = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    near = written(rows.withColumn("rank", F.rank().over(by)).where(F.col("rank") <= most).drop("rank"), "near")
    named = _decoded(near, dictionary)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for w in (Window.partitionBy("lang", "salt").orderBy(*order), Window.partitionBy("lang").orderBy(*order)):
        named = named.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)
    return named.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
