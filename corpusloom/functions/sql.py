"""Functions for SQL texts: registered once for a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import rasters

#: Plain SQL, which the optimiser sees through.
SQL_FUNCTIONS = (
    "hamming64(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
    "verdict(score DOUBLE) RETURNS STRING RETURN CASE WHEN score IS NULL THEN 'unable' WHEN score >= 0.7 THEN 'likely' WHEN score >= 0.4 THEN 'unsure' ELSE 'unlikely' END",
    "auroc_null_sd(p BIGINT, n BIGINT) RETURNS DOUBLE RETURN sqrt(try_divide(p + n + 1, CAST(12 * p * n AS DOUBLE)))",
    "seeded_uniform(seed STRING, key STRING) RETURNS DOUBLE RETURN CAST(conv(substring(md5(concat_ws('|', seed, key)), 1, 8), 16, 10) AS BIGINT) / 4294967296.0D",
)


def _raster_function(f, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, w, data in batches:
            yield pd.Series([f(np.frombuffer(x, np.uint8).reshape(a, b, 3)) for a, b, x in zip(h, w, data)])

    return run


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to spark.sql(); their names."""
    for text in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    kernels = {"raster_phash": (rasters.phash, "bigint"), "raster_brightness": (rasters.brightness_score, "double"), "raster_unlike_photo": (lambda a: rasters.domain_guard(a)[2], "boolean")}
    for name, (f, kind) in kernels.items():
        spark.udf.register(name, _raster_function(f, kind))
    return [t.partition("(")[0] for t in SQL_FUNCTIONS] + list(kernels)
