"""Ingest: class filters, rejection reasons, content-hash deduplication and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_hash(rows: DataFrame, content: str = "text", name: str = "sha") -> DataFrame:
    return rows.withColumn(name, F.sha2(F.col(content).cast("binary"), 256))


def reasons(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with reason: the first rule that rejects the row, or null."""
    out = None
    for name, rejects in rules:
        hit = F.coalesce(rejects, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return rows.withColumn("reason", out)


def rejection_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by, F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def first_by_hash(rows: DataFrame, sha: str, *order: str) -> DataFrame:
    """The first row of each content; a hot content only costs its sort, as Spark keeps one row of it per task."""
    w = Window.partitionBy(sha).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def new_only(rows: DataFrame, ledger: DataFrame, sha: str = "sha") -> DataFrame:
    """Rows whose content the ledger lacks."""
    return rows.join(ledger.select(sha).distinct(), sha, "left_anti")


def within_quota(rows: DataFrame, source: str, quota: Column, *order: Column | str) -> DataFrame:
    """The first rows of each source, up to its quota."""
    w = Window.partitionBy(source).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= quota).drop("_r")


def upload_list(files: DataFrame, extensions: tuple[str, ...], most: int = 50, most_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """Files (pos, name, size) that an upload takes: the first of each name and size with a known extension, up to so
    many; each with a problem if it is too large."""
    known = files.filter(F.lower(F.substring_index("name", ".", -1)).isin(*extensions))
    first = Window.partitionBy("name", "size").orderBy("pos")
    one = known.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    return one.orderBy("pos").limit(most).withColumn("problem", F.when(F.col("size") > most_bytes, "too large"))


def ingest(rows: DataFrame, ledger: DataFrame | None, *, key: str, source: str, rules: list[tuple[str, Column]], quota: Column, order: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, counts of reasons by source): rules, then content seen before, then the quota."""
    checked = reasons(with_hash(rows), rules)
    fine = first_by_hash(checked.filter("reason IS NULL"), "sha", key)
    if ledger is not None:
        fine = new_only(fine, ledger)
    return within_quota(fine, source, quota, order, key), rejection_counts(checked, source)
