"""Helpers that the corpus operators share: shared storage, table access and vectorised word hashing."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).  Where it is unset, a local session gets a temporary
    one, as its executors are this process; a cluster is refused, as they would write to folders of their own."""
    context = spark.sparkContext
    set_to = context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not set_to and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_to = set_to or "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        context.setCheckpointDir(set_to)
    return set_to or context._jsc.sc().getCheckpointDir().get()


#: Spark's setting that an execution's shuffle files go when it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept on shared storage: a lost executor costs a read, not the job before it.

    What was shuffled for it is not needed again, as all that follows reads the kept table, and goes at once.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        return df.select("*").checkpoint()  # a plan made under the setting
    finally:
        spark.conf.set(TIDY, before)


# ---------------------------------------------------------------- words of Arrow text, without Python strings

_SEED = np.random.default_rng(20240607)
_BYTE_CODES = _SEED.integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES_LOWER = _BYTE_CODES[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, size: int = 1 << 18):
    """Ranges of rows of about that many bytes; a longer row stands alone, whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte behind the last) of each word; at: offsets of the rows in part."""
    ink = ~_SPACE[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[at] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, its row), in order; A-Z are lower-cased first."""
    part, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends = word_bounds(part, at)
    up, down = _powers(len(part))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((_BYTE_CODES_LOWER if lower else _BYTE_CODES)[part] * up[: len(part)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(at, starts, "right") - 1
