"""What the registered queries run on: the driver's tables, seen as a labelled corpus with scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sql_uniform, uniform
from ..operators import cells

#: How hard a cell is on the stand-in scorer, by family.
STRENGTH = {"clean": 0.0, "jpeg": 0.2, "blur": 0.3, "resize": 0.4, "noise": 0.5, "jitter": 0.3, "center_crop": 0.6, "composed": 0.8}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, generator, family_of, n_chars): labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("source").alias("generator"), F.col("lang").alias("group"), "n_chars", "toxic")


ITEMS = "items AS (SELECT d.doc_id AS id, l.quality AS label, d.source AS generator, d.lang AS \"group\", d.n_chars, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def scores(spark: SparkSession, sf_dir: str, run: str = "a") -> DataFrame:
    """(id, label, generator, group, cell, kind, family, severity, score): the stand-in scorer on every cell.

    A pure function of item, cell and run; some items can't be scored and have null.
    """
    grid = cells.expand(items(spark, sf_dir), cells.cell_table(spark))
    u = uniform(run, F.col("id"), F.col("cell"))
    strength = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])[F.col("family")]
    raw = 0.5 + (F.col("label") - 0.5) * 0.6 * (1 - 0.7 * strength) + (u - 0.5) * 0.9
    ok = F.floor(u * 1000000) % 53 != 0
    return grid.withColumn("score", F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.floor(raw * 200) / 200.0)))).drop("n_chars", "toxic")


def _cells_sql() -> str:
    rows = [(c.name, c.kind, c.family, "NULL" if c.severity is None else repr(c.severity), c.chain, STRENGTH[c.family]) for c in cells.grid()]
    return "cells(ord, cell, kind, family, severity, chain, strength) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}', CAST({d} AS DOUBLE), '{e}', {f}e0)" for i, (a, b, c, d, e, f) in enumerate(rows)) + ")"


CELLS = _cells_sql()


def scores_sql(run: str = "a", name: str = "scores") -> str:
    u = sql_uniform(f"'{run}|' || CAST(i.id AS VARCHAR) || '|' || c.cell")
    return (
        f"{name} AS (SELECT id, label, generator, \"group\", cell, kind, family, severity, CASE WHEN CAST(floor(u * 1000000) AS BIGINT) % 53 <> 0 THEN "
        f"greatest(0.0e0, least(1.0e0, floor((0.5e0 + (label - 0.5e0) * 0.6e0 * (1 - 0.7e0 * strength) + (u - 0.5e0) * 0.9e0) * 200) / 200.0e0)) END AS score FROM (SELECT i.*, c.cell, c.kind, c.family, c.severity, c.strength, {u} AS u FROM items i CROSS JOIN cells c))"
    )


SCORES = f"{ITEMS}, {CELLS}, {scores_sql()}"


def roc_sql(source: str, keys: str, weight: str = "1", name: str = "roc") -> str:
    """The roc relation by plain windows."""
    return (
        f"{name}_0 AS (SELECT {keys}, score, sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END) AS p, sum(CASE WHEN label = 1 THEN 0 ELSE {weight} END) AS n FROM {source} WHERE score IS NOT NULL GROUP BY {keys}, score), "
        f"{name} AS (SELECT *, sum(p) OVER (PARTITION BY {keys}) AS pos, sum(n) OVER (PARTITION BY {keys}) AS neg, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM {name}_0 WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC))"
    )


AUROC = "CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN CAST(sum(n * (tp - p / 2.0e0)) AS DOUBLE) / CAST(max(pos) * max(neg) AS DOUBLE) END"
AP = "CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(CAST(p AS DOUBLE) / CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) END"


def tpr_sql(fpr: float) -> str:
    return f"CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN coalesce(max(CASE WHEN CAST(fp AS DOUBLE) / CAST(nullif(neg, 0) AS DOUBLE) <= {fpr}e0 + 1e-12 THEN CAST(tp AS DOUBLE) / CAST(nullif(pos, 0) AS DOUBLE) END), 0.0e0) END"
