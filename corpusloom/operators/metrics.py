"""Exact rank metrics from one relation: per group and distinct score, positives and negatives.

Scores lie in [0, 1]; null scores can't be ranked, and are counted. Running sums go by score bucket first and within
buckets then, so that a group with most of the rows spreads over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DECISION, EPSILON, BUCKETS = 0.5, 1e-12, 1024


def minimum_negatives(fpr: float) -> int:
    """So many negatives are needed for that false-positive rate to mean anything."""
    return math.ceil(1 / fpr)


def auroc_null_sd(p: Column, n: Column) -> Column:
    """The standard deviation of AUROC if scores say nothing."""
    return F.sqrt(F.try_divide(p + n + 1, (12 * p * n).cast("double")))


def final_score(clean: Column, robust: Column) -> Column:
    return 0.5 * clean + 0.5 * robust


def roc(scores: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, score, p, n, pos, neg, tp, fp): counts at each distinct score, in all, and at or over the score."""
    w = F.lit(1) if weight is None else weight
    at = (
        scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
        .groupBy(*keys, F.col("score").cast("double").alias("score"))
        .agg(F.sum(F.when(F.col("label") == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 1, 0).otherwise(w)).alias("n"))
        .withColumn("_b", F.floor(F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)) * BUCKETS).cast("int"))
    )
    over = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    buckets = at.groupBy(*keys, "_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    buckets = buckets.select(*keys, "_b", F.coalesce(F.sum("_p").over(over), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_fp"), F.sum("_p").over(every).alias("pos"), F.sum("_n").over(every).alias("neg"))
    own = Window.partitionBy(*keys, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return at.join(buckets, [*keys, "_b"]).select(*keys, "score", "p", "n", "pos", "neg", (F.col("_tp") + F.sum("p").over(own)).alias("tp"), (F.col("_fp") + F.sum("n").over(own)).alias("fp"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def auroc() -> Column:
    """Over the rows of roc(): negatives beaten by positives over them, ties by half."""
    return ratio(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.max("pos") * F.max("neg"))


def average_precision() -> Column:
    some = (F.max("pos") > 0) & (F.max("neg") > 0)
    return F.when(some, F.sum(ratio(F.col("p"), F.col("pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))))


def tpr_at(fpr: float) -> Column:
    """The best rate of true positives over all thresholds within the rate of false ones; none flagged is one, too."""
    some = (F.max("pos") > 0) & (F.max("neg") > 0)
    return F.when(some, F.coalesce(F.max(F.when(ratio(F.col("fp"), F.col("neg")) <= fpr + EPSILON, ratio(F.col("tp"), F.col("pos")))), F.lit(0.0)))


def tpr_over_negative(fpr: float) -> Column:
    """The rate of positives strictly over the negative at place max(ceil(fpr * n) - 1, 0), from 0, downwards."""
    place = F.greatest(F.ceil(F.lit(fpr) * F.col("neg")) - 1, F.lit(0))
    return F.when((F.max("pos") > 0) & (F.max("neg") > 0), ratio(F.max(F.when(F.col("fp") - F.col("n") <= place, F.when(F.col("fp") > place, F.col("tp") - F.col("p")))), F.max("pos")))


def counts() -> list[Column]:
    """Over score rows: how many, by class, and how many can't be ranked."""
    ok = F.col("score").isNotNull() & ~F.isnan(F.coalesce("score", F.lit(0.0)))
    return [
        F.count_if(ok).alias("n"),
        F.count_if(ok & (F.col("label") == 0)).alias("n_real"),
        F.count_if(ok & (F.col("label") == 1)).alias("n_fake"),
        F.count_if(~ok).alias("n_failed"),
        F.avg(F.when(ok, ((F.col("score") >= DECISION) == (F.col("label") == 1)).cast("double"))).alias("acc"),
        F.min(F.when(ok, F.col("score"))).alias("_lo"),
        F.max(F.when(ok, F.col("score"))).alias("_hi"),
    ]


def cell_metrics(scores: DataFrame, keys: list[str], fpr: float = 0.01) -> DataFrame:
    """(keys, n, n_real, n_fake, n_failed, auroc, ap, acc, tpr_at_fpr, notes): a row per group.

    Groups of one class have no rank metrics; accuracy they have. Notes tell that, that all scores are equal, and
    how many can't be ranked.
    """
    base = scores.groupBy(*keys).agg(*counts())
    ranks = roc(scores, keys).groupBy(*keys).agg(auroc().alias("auroc"), average_precision().alias("ap"), tpr_at(fpr).alias("tpr_at_fpr"))
    notes = F.concat_ws(
        "; ",
        F.when((F.col("n_real") == 0) | (F.col("n_fake") == 0), "single-class"),
        F.when((F.col("n") > 1) & (F.col("_lo") == F.col("_hi")), "degenerate"),
        F.when(F.col("n_failed") > 0, F.concat(F.col("n_failed").cast("string"), F.lit(" unscorable"))),
    )
    return base.join(ranks, keys, "left").select(*keys, "n", "n_real", "n_fake", "n_failed", "auroc", "ap", "acc", "tpr_at_fpr", notes.alias("notes"))


def family_table(cells: DataFrame, metric: str = "auroc") -> DataFrame:
    """(family, n_cells, n_defined, mean, least) of a metric over degraded cells."""
    return cells.filter("family <> 'clean'").groupBy("family").agg(F.count("*").alias("n_cells"), F.count(metric).alias("n_defined"), F.avg(metric).alias("mean"), F.min(metric).alias("least"))


def grid_summary(cells: DataFrame, metric: str = "auroc") -> DataFrame:
    """One row over the grid's cells (cell, kind, family, metric): clean, robust by families, gaps, worst cell.

    Each family counts once, all composed cells being one; families without any defined cell are left out of the
    mean and counted. The worst cell is sought among all, clean as well; a tie goes to the first by name.
    """
    m = F.col(metric)
    means = family_table(cells, metric).agg(F.avg("mean").alias("robust"), F.count("*").alias("n_families"), F.sort_array(F.collect_list(F.concat("family", F.lit("="), F.coalesce(F.round("mean", 6).cast("string"), F.lit("undefined"))))).alias("family_means"))
    base = cells.agg(
        F.max(F.when(F.col("kind") == "clean", m)).alias("clean"),
        F.avg(F.when(F.col("kind") != "clean", m)).alias("flat_mean"),
        F.avg(F.when(F.col("kind") == "single", m)).alias("single_mean"),
        F.avg(F.when(F.col("kind") == "composed", m)).alias("composed_mean"),
        F.min(m).alias("worst"),
        F.min(F.when(m.isNotNull(), F.struct(m, "cell")))["cell"].alias("worst_cell"),
        F.count("*").alias("n_cells"),
        F.count_if(F.col("kind") != "clean").alias("n_transformed"),
        F.count_if(m.isNull()).alias("n_undefined"),
    )
    # two frames of one row each
    one = base.withColumn("_k", F.lit(1)).join(means.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumns({"gap": F.col("clean") - F.col("robust"), "flat_gap": F.col("clean") - F.col("flat_mean"), "final": final_score(F.col("clean"), F.col("robust"))})


def per_generator(scores: DataFrame, group: str = "generator") -> DataFrame:
    """The score rows for one-against-the-negatives views: each generator's positives, and all negatives for each.

    Generators come from the positives; their number, not that of rows, multiplies the negatives.
    """
    pos = scores.filter("label = 1")
    names = pos.agg(F.sort_array(F.collect_set(group)).alias("_g"))
    neg = scores.filter("label = 0").drop(group).withColumn("_k", F.lit(1)).join(F.broadcast(names.withColumn("_k", F.lit(1))), "_k").withColumn(group, F.explode("_g")).drop("_k", "_g")
    return pos.unionByName(neg)


def worst_errors(scores: DataFrame, label: int, n: int, by: list[str]) -> DataFrame:
    """The n rows of that class that are most wrong: negatives from the highest score, positives from the lowest."""
    order = F.desc("score") if label == 0 else F.asc("score")
    return scores.filter((F.col("label") == label) & F.col("score").isNotNull()).orderBy(order, *by).limit(n)


def verdict(score: Column) -> Column:
    return F.when(score.isNull(), "unable").when(score >= 0.7, "likely").when(score >= 0.4, "unsure").otherwise("unlikely")


def aligned(a: DataFrame, b: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Rows in which two runs differ: missing on a side, or other values. Empty if the runs can be compared."""
    a, b = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in same], F.lit(True).alias("_a")), b.select(key, *[F.col(c).alias(f"_b_{c}") for c in same], F.lit(True).alias("_b"))
    j = a.join(b, key, "full")
    differ = F.lit(False)
    for c in same:
        differ = differ | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    why = F.when(F.col("_b").isNull(), "only in first").when(F.col("_a").isNull(), "only in second").when(differ, "differs")
    return j.select(key, why.alias("problem")).filter("problem IS NOT NULL")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, repeats counted; two ways to compute the same leave none."""
    a = a.select(b.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))
