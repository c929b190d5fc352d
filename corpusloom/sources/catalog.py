"""The registry of corpus sources, and what fetching them takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, label, family, rows, GB, quota, held out, the labels that its rows must have (empty: any).
SOURCES = (
    ("SDXL", 1, "sdxl", 8978, 12.5, 2000, False, []),
    ("Mobius", 1, "sdxl-derivative", 8842, 13.5, 2000, False, []),
    ("RealVisXL-V4.0", 1, "sdxl-derivative", 8860, 12.6, 2000, False, []),
    ("Aura", 1, "aura", 12860, 6.5, 2000, False, []),
    ("MidJourney", 1, "midjourney", 670368, 503.5, 2000, True, []),
    ("Gemini-nano-banana", 1, "gemini", 9457, 14.9, 2000, True, []),
    ("FLUX.1-dev", 1, "flux", 30022, 17.0, 800, True, [1]),
    ("OpenImagesV7", 0, "openimages", 30022, 17.0, 1800, False, [0]),
    ("Megalith-Flickr", 0, "flickr", 10000, 1.94, 1800, False, []),
    ("Unsplash", 0, "unsplash", 5000, 0.65, 1800, False, []),
)
SCHEMA = "name string, label int, family string, n_rows bigint, total_gb double, quota bigint, holdout boolean, label_values array<int>"
#: Bytes of a normalised item, and the share of fetched rows that survive.
NORMALISED_BYTES, YIELD = 95_000, 0.85


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SCHEMA)


def trainable(sources: DataFrame) -> DataFrame:
    return sources.filter(~F.col("holdout"))


def held_out(sources: DataFrame) -> DataFrame:
    return sources.filter("holdout")


def denied(sources: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Sources whose name holds one of the words, in either case."""
    return sources.filter(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(column), w)))


def footprint(sources: DataFrame, yield_rate: float = YIELD) -> DataFrame:
    """Per source: rows to fetch, MB per item, GB to transfer and to keep."""
    fetched = F.col("quota") / max(yield_rate, 0.01)
    per = F.col("total_gb") * 1e9 / F.greatest("n_rows", F.lit(1))
    return sources.select(
        "name", "label", "quota", F.round(fetched).cast("bigint").alias("rows_fetched"), F.round(per / 1e6, 3).alias("mb_per_item"), F.round(fetched * per / 1e9, 2).alias("transfer_gb"), F.round(F.col("quota") * NORMALISED_BYTES / 1e9, 3).alias("normalised_gb")
    )


def footprint_total(per_source: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Sums of the rounded values; the peak adds what is in flight."""
    t, n = F.sum("transfer_gb"), F.sum("normalised_gb")
    return per_source.agg(F.round(t, 2).alias("transfer_gb"), F.round(n, 2).alias("normalised_gb"), F.round(n + (t if keep_raw else F.lit(0.2)), 2).alias("peak_gb"), F.sum("quota").alias("n_items"))
