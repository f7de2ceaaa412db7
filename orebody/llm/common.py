"""What the corpus operators share: tables, the shared folder, text chunks, hashes of words.

Words are runs of bytes outside ASCII white space (0x20, 0x09-0x0D); in UTF-8 no other
character holds such a byte, so ``bytes.split()`` and the numpy code below cut alike.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of the separators between words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the numpy kernels treat at once; one longer text is a chunk of its own.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orebody-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orebody-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left (a table that is cheap to read again) joined with right (one row a key), where a few keys may hold much of left.

    A key is heavy if it holds more than 1 / (4 * partitions) of left's rows; there are at most
    4 * partitions of those, whose rows of right are broadcast. The others' are shuffled.
    """
    spark, most = left.sparkSession, 4 * parts(left.sparkSession)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    rows = left.count()
    heavy = [r[0] for r in counts.where(F.col("__n") > max(1, rows // most)).collect()]
    if not heavy:
        return left.join(right, key, how)
    keys = F.broadcast(spark.createDataFrame([(x,) for x in heavy], left.select(key).schema))
    hot = left.join(keys, key, "left_semi").join(F.broadcast(right.join(keys, key, "left_semi")), key, how)
    return hot.unionByName(left.join(keys, key, "left_anti").join(right, key, how))


def text_keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text: 128 bits name a distinct text."""
    return [F.xxhash64(text).alias("tk1"), F.xxhash64(F.lit("second"), text).alias("tk2")]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) with whole texts, about ``most`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(self.n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


class Hasher:
    """Hashes of words and of runs of words, without a Python step per word."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bytes = Powers(int(rng.integers(1, 1 << 62)) * 4 + 3)
        self.words = Powers(int(rng.integers(1, 1 << 62)) * 4 + 3)

    def of_words(self, data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, words up to each row, start byte, end byte of each word)."""
        if not len(data):
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
        if lower:
            data = _LOWER[data]
        full = ~_BLANK[data]
        begins, ends = full.copy(), full.copy()
        begins[1:] &= ~full[:-1]
        ends[:-1] &= ~full[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = full[inner]
        ends[inner - 1] = full[inner - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bytes.to(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.bytes.up[: len(data)], out=sums[1:])
        hashes = mixed((sums[stops] - sums[starts]) * self.bytes.down[starts])
        return hashes, np.searchsorted(starts, offsets), starts, stops

    def of_runs(self, words: np.ndarray, length: int) -> np.ndarray:
        """Hash of the run of ``length`` words that starts at each word (the last ones are left out)."""
        n = len(words)
        if n < length:
            return np.zeros(0, np.uint64)
        self.words.to(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.words.up[:n], out=sums[1:])
        return mixed((sums[length:] - sums[:-length]) * self.words.down[: n - length + 1])
