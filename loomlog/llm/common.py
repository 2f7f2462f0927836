"""Small pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java and Python character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as ``spark.checkpoint.dir`` names it; one of our own only on a single machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return where or "/tmp/loomlog-checkpoints"


def trim() -> None:
    """Give back what this Python process has freed; idle workers live on beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back:
        back(0)


def settle(spark: SparkSession) -> None:
    """Free in the driver what earlier steps left there: models, their broadcasts, plans and generated classes."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow or mapInPandas, with ``trim`` when a task is through."""

    def through(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return through


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the shared folder of the cluster."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """``durable(df)`` whose shuffle files go at once, not when the driver's next collection of garbage finds them unused."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return durable(df.select("*"))  # the setting counts where a DataFrame is made
    finally:
        conf.set(name, before)


def crc_mod(column: Column, divisor: int) -> Column:
    """crc32 of the column's text, modulo ``divisor``."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        ups = np.full(size, _P, dtype=np.uint64)
        ups[0] = 1
        downs = np.full(size, _P_INV, dtype=np.uint64)
        downs[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[0] = np.multiply.accumulate(ups)
            _POWERS[1] = np.multiply.accumulate(downs)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def word_hashes(text: str | None, fold: bool) -> np.ndarray:
    """One 64-bit hash for each word of the whole text, from prefix sums of its UTF-8."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    inside = np.concatenate(([False], ~_BLANK[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    if fold:
        raw = _FOLD[raw]
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
        own = (sums[ends] - sums[starts]) * down[starts]
        return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words_: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of each window of ``width`` words; with fewer words, of the whole sequence."""
    n = len(words_)
    if n == 0:
        return words_
    width = min(width, n)
    with np.errstate(over="ignore"):
        total = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + words_[k : n - width + 1 + k]
        return mix(total + np.uint64(width))
