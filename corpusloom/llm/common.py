"""What the operators of this subpackage share: words, and the library's written tables and checked broadcasts."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage
from ..operators.storage import save_parts, scratch_dir, small_enough

__all__ = ["GAP", "WORD", "hold_batches", "n_words", "save", "save_parts", "scratch_dir", "small_enough", "tidy", "unused", "words"]

#: Words are runs of anything but ASCII white space (fixed by the queries' contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: What lies between words.
GAP = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: texts are large, and a batch is in memory on both sides.
BATCH_ROWS = 1000


def hold_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_ROWS rows at most, so that memory doesn't hang on its settings."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The library's save(), with bounded batches."""
    hold_batches(df.sparkSession)
    return storage.save(df, name, compression)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null and for texts without words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def tidy() -> None:
    """At a Python task's end: what it freed goes back to the system, for workers stay while others work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        return


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df hasn't, whatever its own are called; Spark tells no case apart."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
