"""Shared plumbing of the training-data operators: scratch tables, tables of a scale factor, Arrow text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a folder of our own only where it is unset, and then
    only in local mode: executors elsewhere could not read it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return f"file://{_OWN_DIR[0]}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back: lineage ends, lost executors cost nothing."""
    path = f"{scratch_dir(df.sparkSession)}/quillspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._scratch = path
    _WRITTEN.append(path)
    return made


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends at most ``rows`` rows at once to Python: a batch of texts stands in memory four times, in the JVM
    where its buffer grows by doubling and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete materialized steps that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def written() -> list[str]:
    """Paths of all steps that are still there."""
    return list(_WRITTEN)


class Slots:
    """Which 64-bit hashes may be among those of ``keys`` (a table of one column): a bit a slot, 16 slots a key up to
    2^``MOST_BITS``, so 4 MB at most are broadcast, however many keys there are. No key is ever denied. With more keys than
    slots most hashes may match, and the join behind it decides about nearly every row, as it would without."""

    MOST_BITS = 25

    def __init__(self, keys: DataFrame):
        self.bits = min(self.MOST_BITS, max(15, (16 * keys.count()).bit_length()))
        slot = self._slot(F.col(keys.columns[0]))
        maps = keys.select(F.bitmap_bucket_number(slot).alias("_map"), F.bitmap_bit_position(slot).alias("_at"))
        self.maps = maps.groupBy("_map").agg(F.bitmap_construct_agg("_at").alias("_bits"))

    def _slot(self, key: Column) -> Column:
        return F.pmod(key, F.lit(1 << self.bits)) + 1

    def mark(self, rows: DataFrame, key: Column) -> DataFrame:
        """``rows`` with ``_may``, for a hash ``key`` made of their columns."""
        slot = self._slot(key)
        rows = rows.withColumn("_map", F.bitmap_bucket_number(slot)).withColumn("_at", F.bitmap_bit_position(slot).cast("int"))
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_at", 3) + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.expr("shiftright(_byte, _at & 7) & 1") == 1
        out = rows.join(F.broadcast(self.maps), "_map", "left").withColumn("_byte", byte).withColumn("_may", F.coalesce(bit, F.lit(False)))
        return out.drop("_map", "_at", "_byte", "_bits")


def rows_without(docs: DataFrame, key: dict[str, Column], gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``key`` (name to expression over ``docs``; nulls are equal) is a row of ``gone``, which has
    columns of these names. Only rows that may be gone are shuffled; the others, with their texts, stay where they are."""
    gone = materialize(gone.select(*key).distinct(), "gone")
    packed = docs.select(F.struct("*").alias("_row"), *[c.alias(k) for k, c in key.items()])
    marked = Slots(gone.select(F.xxhash64(*key).alias("h"))).mark(packed, F.xxhash64(*key))
    right = gone.select(*[F.col(k).alias(f"_gone_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in key]
    unsure = marked.where("_may").join(right, functools.reduce(lambda a, b: a & b, same), "left_anti")
    return marked.where("NOT _may").select("_row.*").unionByName(unsure.select("_row.*"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets (rows + 1); a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    col = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw, offs - (offs[0] if len(offs) else 0)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def tidy(run):
    """A function over Arrow batches that, once done, gives its freed memory back: Python workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _POW.clear()  # made again in milliseconds; else the worker keeps it through later stages
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


# -- hashing of words, vectorised over a buffer ---------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: list[np.ndarray] = []
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _INV):
            col = np.full(size, base, np.uint64)
            col[0] = 1
            out.append(np.multiply.accumulate(col))
        _POW[:] = out
    return _POW[0][:n], _POW[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


class SpanHasher:
    """64-bit hashes of any spans of one buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        power, self._inverse = _powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._inverse[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased: digits, letters, and every byte above 127.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = ALNUM, lower: bool = True):
    """Words of all texts in the buffer: lower-cased bytes, starts, ends, row of each word."""
    low = _LOWER[data] if lower else data
    n = len(low)
    inside = is_word[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return low, start, end, row


def shingle_hashes(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words, sorted by row and hash; a text of fewer words gives its words as one."""
    data, offsets = flat_bytes(texts)
    low, start, end, row = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = SpanHasher(low)(start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    rank = np.arange(len(row)) - first[row]
    left = count[row] - rank
    n = len(word)
    total = np.zeros(n, np.uint64)
    padded = np.concatenate((word, np.zeros(size, np.uint64)))
    for j in range(size):
        part = padded[j : j + n] * np.uint64(0x9FB21C651E98DF25 + 2 * 0x1000003 * j)
        total = mix64(total) + np.where(left > j, part, np.uint64(0))
    keep = (left >= size) | ((rank == 0) & (count[row] < size))
    row, key = row[keep], mix64(total[keep])
    order = np.lexsort((key, row))
    return row[order], key[order]


def distinct_counts(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) of sorted pairs and how often each occurs."""
    if not len(row):
        return row, key, np.zeros(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(row)))
