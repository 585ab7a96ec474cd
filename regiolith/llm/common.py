"""What the text operators share: the session, tables, and flat byte arrays of Arrow batches.

Every operator reads a text column as UTF-8 bytes plus offsets, so that NumPy
works on a whole slice of documents at once.  A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that reach a Python worker at once.
BATCH_BYTES = 8 << 20
#: Bytes of text that NumPy works on at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
U64 = np.uint64


#: Makes Python workers give large arrays back to the machine as soon as they are freed; they stay for later tasks, next to the JVM's heap.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, lets workers import this package, and sees to a checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="regiolith-"))  # one machine: tests
    return spark


#: Makes Spark delete the shuffle files of a query when the query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder, deleted by Spark's cleaner when nothing refers to it; df's shuffle files go at once.

    A checkpoint keeps the optimizer's size estimate of its plan.  In a loop of
    joins that is a product of products, numbers of millions of digits that fill
    the driver; so the rows are taken up again as a table of unknown size.
    """
    spark = prepare(df.sparkSession)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint(eager=True)._jdf  # a query of its own, as the setting is read when one is made
    finally:
        spark.conf.set(CLEANUP, was)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and checkpoints of tables that are gone; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join whatever the sizes: in loops, tables broadcast one after the other would pile up on the driver."""
    return left.join(right.hint("merge"), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def row_key(*cols: str) -> Column:
    """A key of a row's content in 128 bits: rows that repeat all these columns share it."""
    return F.concat(F.hex(F.xxhash64(*cols)), F.lit("-"), F.hex(F.xxhash64(F.lit("other"), *cols)))


def parts_for(df: DataFrame, each_bytes: int = 2 << 20) -> int:
    """How many groups the work on df is dealt to: by the optimizer's size of its files, at least the shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(max(least, size // each_bytes), 1 << 20))


# ---------------------------------------------------------------- Arrow and NumPy


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """function over a partition's batches; at its end the worker, which stays for later tasks, gives free memory back to the machine."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """(lo, hi) ranges of documents of at most so many bytes together, one document at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit keys (xor-shift and multiply, three rounds)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed * 7919 + 1))


BASE = U64(0x5851F42D4C957F2D)
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_BYTE = random_words(256, 1)
_powers = {BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        out = np.multiply.accumulate(p)
        if n > 4 * SLICE_BYTES:
            return out
        _powers[base] = out
    return _powers[base][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbol[i] * BASE^i modulo 2^64, from which any substring's hash follows."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _power(BASE, len(symbols)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end], equal for equal contents wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start])


def gram_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive symbols."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(symbols)
    return mix((sums[k:] - sums[:-k]) * _power(_INVERSE, n))


#: The white space of the word rule [^\x20\x09-\x0D]+.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A-Z lower-cased, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and the n + 1 word offsets of the documents."""
    inside = ~WHITE[data]
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        start[cut] = inside[cut]  # a word ends with its document
        end[cut - 1] = inside[cut - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(_BYTE[data]), s, e)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays that pack() joined: all as long as each other, of these kinds."""
    dts = [np.dtype(k) for k in kinds]
    n, out, at = len(blob) // sum(d.itemsize for d in dts), [], 0
    for d in dts:
        out.append(np.frombuffer(blob, d, n, at))
        at += n * d.itemsize
    return out

