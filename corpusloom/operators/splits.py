"""Leak-free splits: clusters stay together, strata keep their shares, held-out generators go to test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash_key
from .ranges import ranked
from .storage import bounded, save

SPLITS, SHARES = ("train", "val", "test"), (0.70, 0.15, 0.15)


def quotas(n: Column, shares: tuple[float, ...] = SHARES) -> list[Column]:
    """Whole numbers that sum to n: floors, and one more for the largest remainders; ties in order."""
    exact = [n * F.lit(s) for s in shares]
    floors = [F.floor(x) for x in exact]
    left = n - sum(floors, F.lit(0))
    rests = [x - f for x, f in zip(exact, floors)]
    out = []
    for i, r in enumerate(rests):
        ahead = sum(((q > r) | ((q == r) & F.lit(j < i))).cast("int") for j, q in enumerate(rests) if j != i)
        out.append((floors[i] + (ahead < left).cast("int")).cast("bigint"))
    return out


def assign(rows: DataFrame, *, key: str, holdout: Column, blocked: Column, seed: int = 0, strict: bool = False) -> DataFrame:
    """rows (key, label, generator, cluster) with split.

    Clusters are dealt by strata of (label of the first row, most frequent generator, the smaller name on ties) in
    the order of a seeded hash. Held-out rows go to test each by itself, and blocked ones from train to test;
    strict takes their whole clusters along, so that none straddles.
    """
    flagged = rows.withColumn("_h", holdout).withColumn("_x", blocked)
    if strict:
        every = Window.partitionBy("cluster")
        flagged = flagged.withColumn("_h", F.max(F.col("_h")).over(every)).withColumn("_x", F.max(F.col("_x")).over(every))
    pool = flagged.filter(~F.col("_h"))
    clusters = pool.groupBy("cluster").agg(F.min_by("label", key).alias("_label"), F.mode("generator", True).alias("_gen"))
    clusters = clusters.withColumn("_key", hash_key(seed, F.col("cluster")))
    clusters = save(clusters, "split-clusters")
    n = clusters.count()
    dealt = ranked(clusters, ["_label", "_gen"], "_key", ["cluster"], most=n)
    q = quotas(F.col("total"))
    dealt = dealt.select("cluster", F.when(F.col("before") < q[0], "train").when(F.col("before") < q[0] + q[1], "val").otherwise("test").alias("_s"))
    placed = flagged.join(bounded(dealt, n), "cluster", "left")
    split = F.when(F.col("_h"), "test").when(F.col("_x") & (F.col("_s") == "train"), "test").otherwise(F.col("_s"))
    if strict:
        split = F.when(F.col("_h") | (F.col("_x") & (F.col("_s") == "train")), "test").otherwise(F.col("_s"))
    return placed.select(*rows.columns, split.alias("split"))


def contingency(rows: DataFrame, by: str) -> DataFrame:
    """Rows by split, a missing split being 0, and their total; a last row sums all."""
    n = rows.rollup(by).agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.count("*").alias("total"))
    return n.select(F.coalesce(F.col(by).cast("string"), F.lit("all")).alias(by), *SPLITS, "total")


def violations(rows: DataFrame, key: str) -> DataFrame:
    """(rule, n): breaches of what a split promises."""
    rows = save(rows.select(key, "cluster", "label", "split"), "split-rows")  # read five times
    keys = rows.groupBy(key).agg(F.count_distinct("split").alias("s"), F.count("*").alias("n"))
    straddling = rows.groupBy("cluster").agg(F.count_distinct("split").alias("s"))
    parts = [
        keys.agg(F.count_if(F.col("s") > 1).alias("n")).select(F.lit("row in several splits").alias("rule"), "n"),
        straddling.agg(F.count_if(F.col("s") > 1).alias("n")).select(F.lit("cluster straddles splits").alias("rule"), "n"),
        rows.agg(F.count_if(F.col("split").isNull()).alias("n")).select(F.lit("row without a split").alias("rule"), "n"),
        rows.agg((F.lit(len(SPLITS)) - F.count_distinct("split")).cast("bigint").alias("n")).select(F.lit("empty splits").alias("rule"), "n"),
        rows.agg(F.coalesce((~F.avg(F.col("label").cast("double")).between(0.25, 0.75)).cast("bigint"), F.lit(0)).alias("n")).select(F.lit("labels out of balance").alias("rule"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stratified_limit(rows: DataFrame, label: str, limit: int, key: str, seed: int = 0) -> DataFrame:
    """limit // 2 rows of each class, drawn by a seeded hash; fewer where a class has fewer."""
    w = Window.partitionBy(label).orderBy(hash_key(seed, F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit // 2).drop("_r")


def head_per_class(rows: DataFrame, klass: str, n: int, *order: str) -> DataFrame:
    w = Window.partitionBy(klass).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
