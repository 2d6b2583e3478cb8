"""Array kernels and shared-folder helpers of the operators that read whole texts.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z. They are hashed
to 64 bits with polynomial prefix sums, so a batch of texts costs a few numpy
passes over its bytes and no Python loop per word.
"""

from __future__ import annotations

import ctypes
import re
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
SHINGLE = 5
#: Bytes of text whose prefix sums are held at a time; a longer word is taken whole.
PART = 1 << 17
#: Bytes of an Arrow batch of rows on its way to or from Python.
BATCH = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return mix(low.astype(U64) + U64(1)), space


class Hasher:
    """Holds the power tables; one per task."""

    def __init__(self):
        self.byte, self.space = _byte_tables()
        self.pow = self.inv = np.zeros(0, U64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 2 * len(self.pow), 1 << 16)
            for name, base in (("pow", _P), ("inv", _PINV)):
                a = np.full(n, base, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def words(self, data: np.ndarray, offs: np.ndarray):
        """Byte starts and ends of all words, their hashes, and each text's first word's index."""
        n = len(data)
        if n == 0:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(U64), np.zeros(len(offs), np.int64)
        space = self.space[data]
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        before, after = cut[:-1].copy(), cut[1:].copy()
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        before[0] = after[-1] = True
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        h, at = np.empty(len(starts), U64), 0
        while at < len(starts):  # sums take 8 bytes a byte, so they are formed for a part of the words at a time
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + PART, "right")))
            h[at:to] = self._hashes(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low)
            at = to
        return starts, ends, mix(h ^ (ends - starts).astype(U64)), np.searchsorted(starts, offs)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self.byte[data] * self.pow[: len(data)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.inv[starts]


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k words; callers drop those that cross texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    s = np.zeros(n, U64)
    for j in range(k):
        s = s * U64(_P) + h[j : j + n]
    return mix(s)


def hash_all(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence."""
    s = 0x51_7CC1B7
    for x in h.tolist():
        s = ((s ^ x) * _P + 0x2545F491) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([s], U64))[0]


def shingle_sets(hasher: Hasher, data, offs, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    _, _, h, w = hasher.words(data, offs)
    s = shingles(h, k)
    out = []
    for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        else:
            out.append(np.array([hash_all(h[a:b])], U64) if b > a else h[:0])
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    body = column.buffers()[2] if n else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Returns freed memory to the system. Spark's Python workers serve one task after another, and would hold the most that any took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # looked up here: the functions of this module are shipped by value
    if trim:
        trim(0)


def giving_back(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """f for ``applyInPandas``, with its memory given back after each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        give_back()
        return out

    return run


def text_chunks(batches, names: list[str], text: str = "text", size: int = 1 << 20):
    """Arrow record batches as (columns, bytes, offsets), at most about ``size`` bytes of text at a time."""
    for batch in batches:
        data, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
        rest = [batch.column(batch.schema.get_field_index(n)) for n in names]
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            yield [c.slice(at, to - at) for c in rest], data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
        give_back()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; set to a local one only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file:///tmp/tidemark-checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_TABLES = threading.local()


@contextmanager
def collecting(tables: list):
    """Within it, every ``written`` table of this thread is added to the list, so that its user can forget them all later."""
    before = getattr(_TABLES, "now", None)
    _TABLES.now = tables
    try:
        yield tables
    finally:
        _TABLES.now = before


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, Python gets rows in Arrow batches of at most about ``BATCH`` bytes; Spark's own limit is of rows, however long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(BATCH, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (tables := getattr(_TABLES, "now", None)) is not None:
        tables.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table behind a ``written`` DataFrame once all that was read from it is written too."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


BLOOM_BITS, BLOOM_HASHES, BLOOM_WORDS = 10, 4, 1 << 17


def _bloom_places(key, words: int) -> list:
    return [F.pmod(F.xxhash64(key, F.lit(j)), F.lit(words * 64)) for j in range(BLOOM_HASHES)]


def parted(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df that a Bloom filter of ``keys`` (one column of the same name) lets through, and those whose key is surely not among them.

    So a join that decides about few rows deals out only those. The filter has
    at most 1 MB; for more keys than that serves it lets more rows through, and
    the join that follows is exact in any case.
    """
    spark = df.sparkSession
    words = min(BLOOM_WORDS, max(1, -(-keys.count() * BLOOM_BITS // 64)))
    at = keys.select(F.explode(F.array(*_bloom_places(F.col(key), words))).alias("at"))
    found = at.select(F.shiftright("at", 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("w"))
    whole = found.union(spark.range(words).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))).groupBy("i").agg(F.bit_or("w").alias("w"))
    level = whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words")).scalar()
    passed = reduce(Column.__and__, [F.getbit(F.get(level, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in _bloom_places(F.col(key), words)])
    return df.filter(passed), df.filter(~passed)


def maybe_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The first part of ``parted``, for a join that keeps only rows whose key is among them."""
    return parted(df, key, keys)[0]
