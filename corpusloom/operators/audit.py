"""Leakage audits: how well single features tell classes apart, and what a corpus' channels hold."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import auroc, ratio, roc

#: Signatures at the start of files, and of the tag that tells WEBP from other RIFF files.
MAGIC = (("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("gif", "47494638"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A"))


def container(content: Column) -> Column:
    """A file's kind by its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for name, magic in MAGIC:
        out = out.when(head.startswith(magic), name)
    return out.otherwise("unknown")


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def segment(path: Column, at: int) -> Column:
    """A path's part by its place from 0; null if it has fewer."""
    return F.get(F.split(path, "/"), F.lit(at))


def geometry(rows: DataFrame) -> DataFrame:
    """Derived columns of (width, height, n_bytes)."""
    w, h = F.col("width"), F.col("height")
    return rows.withColumns({"megapixels": w * h / 1e6, "is_1024sq": (w == 1024) & (h == 1024), "is_square": w == h, "bytes_per_pixel": F.col("n_bytes") / F.greatest(w * h, F.lit(1)), "short_side": F.least(w, h)})


def text_probe(docs: DataFrame) -> DataFrame:
    """Metadata-like features of each text: lengths, lines, and shares of kinds of characters."""
    t = F.col("text")
    n = F.length(t)
    share = lambda p: ratio(n - F.length(F.regexp_replace(t, p, "")), n)
    return docs.withColumns(
        {"n_chars_real": n.cast("double"), "n_bytes": F.octet_length(t).cast("double"), "n_lines": (n - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("double"), "upper_share": share("[A-Z]+"), "digit_share": share("[0-9]+"), "space_share": share("[ \\n\\t]+"), "symbol_share": share("[#*$%&|<>]+")}
    )


PROBES = ("n_chars_real", "n_bytes", "n_lines", "upper_share", "digit_share", "space_share", "symbol_share")


def min_max(value: Column, by: list[str]) -> Column:
    """To [0, 1] within the group; constants become a half."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(lo == hi, 0.5).otherwise((value - lo) / (hi - lo))


def long_features(rows: DataFrame, features: tuple[str, ...], keep: list[str]) -> DataFrame:
    """(keep, feature, value): a row for each feature that isn't null or NaN."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.feature", "x.value").filter("value IS NOT NULL AND NOT isnan(value)")


def leak_auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, feature, n, leak) from (by, feature, value, label): the AUROC of the scaled value, or of its reverse if
    that is larger. Null with fewer than four rows or one class; a constant can't tell classes apart."""
    keys = [*by, "feature"]
    span = rows.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("n"), F.count_distinct("label").alias("_classes"))
    scaled = rows.join(span, keys).withColumn("score", F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    a = roc(scaled, keys).groupBy(*keys).agg(auroc().alias("a"))
    return span.join(a, keys).select(*keys, "n", F.when((F.col("n") >= 4) & (F.col("_classes") == 2), F.greatest("a", 1 - F.col("a"))).alias("leak"))


def class_views(rows: DataFrame, klass: str, base: str) -> DataFrame:
    """Each row in its views: base against all others, and base against each other class."""
    names = [r[0] for r in rows.filter(F.col(klass) != base).select(klass).distinct().orderBy(klass).collect()]  # classes, not rows
    views = F.when(F.col(klass) == base, F.array(F.lit("binary"), *[F.lit(f"{base}_vs_{x}") for x in names])).otherwise(F.array(F.lit("binary"), F.concat(F.lit(f"{base}_vs_"), F.col(klass))))
    return rows.withColumn("view", F.explode(views)).withColumn("label", F.when(F.col(klass) == base, 0).otherwise(1))


def one_vs_rest(rows: DataFrame, klass: str) -> DataFrame:
    """Each row once for every class: label 1 where it is its own. Multiplies rows by the number of classes."""
    names = rows.agg(F.sort_array(F.collect_set(klass)).alias("_c"))
    every = rows.withColumn("_k", F.lit(1)).join(F.broadcast(names.withColumn("_k", F.lit(1))), "_k").withColumn("target", F.explode("_c"))
    return every.withColumn("label", (F.col(klass) == F.col("target")).cast("int")).drop("_k", "_c")


def crosstab(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Counts of b's values by a, row totals, and percentages of the row."""
    wide = rows.groupBy(a).pivot(b, values).count().fillna(0, values)
    total = reduce(lambda x, y: x + y, [F.col(v) for v in values])
    return wide.withColumn("total", total).withColumns({f"{v}_pct": F.round(ratio(100 * F.col(v), F.col("total")), 4) for v in values})


def rule_accuracy(rows: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg((predicted == truth).cast("double")).alias("accuracy"))


def profile(rows: DataFrame, by: str, value: str, special: Column, shape: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.median(value).alias("median"), F.avg(special.cast("double")).alias("special_share"), F.count_distinct(*shape).alias("n_shapes"))


def top_shares(rows: DataFrame, by: str, what: list[str], k: int) -> DataFrame:
    """The k most frequent combinations in each class, with their share; ties by value."""
    n = rows.groupBy(by, *what).agg(F.count("*").alias("n"))
    totals = n.groupBy(by).agg(F.sum("n").alias("_t"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), *what))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k).join(totals, by).select(by, "rank", *what, "n", ratio(F.col("n"), F.col("_t")).alias("share"))


def top_tokens(rows: DataFrame, tokens: Column, k: int) -> DataFrame:
    return rows.select(F.explode(tokens).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def presence(rows: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Shares of rows with each flag, by class."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(v, F.lit(False)).cast("double")).alias(k) for k, v in flags.items()])


def channel_status(leaks: DataFrame, distinct: DataFrame, bound: float = 0.6) -> DataFrame:
    """(feature, n_values, leak, status): constant, ok under the bound, or LEAK."""
    return distinct.join(leaks, "feature", "left").select("feature", "n_values", "leak", F.when(F.col("n_values") <= 1, "constant").when(F.col("leak") < bound, "ok").otherwise("LEAK").alias("status"))


def position_deciles(rows: DataFrame, frac: Column, label: str) -> DataFrame:
    """Class share by decile of a row's place in its source: a bias of order shows as a slope."""
    return rows.withColumn("decile", F.least(F.floor(frac * 10), F.lit(9)).cast("int")).groupBy("decile").agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("share"))


def rank_correlation(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's correlation over one row per group: Pearson's of average ranks. Null under three rows, or if a side
    is constant."""
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    ranked = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(rank(x).alias("_x"), rank(y).alias("_y"))
    return ranked.agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("r")).select("n", F.when(F.col("n") >= 3, F.col("r")).alias("rho"))


def leak_ranking(leaks: DataFrame) -> DataFrame:
    """Features by their largest leak over all views, the largest first; without one, a feature isn't listed."""
    top = leaks.groupBy("feature").agg(F.max("n").alias("n"), F.max("leak").alias("leak"))
    return top.filter(F.col("leak").isNotNull()).orderBy(F.desc("leak"), "feature")


def mean_features(rows: DataFrame, klass: str, features: Iterable[str]) -> DataFrame:
    """Each feature's mean by class; a null value counts for none."""
    return rows.groupBy(klass).agg(*[F.avg(f).alias(f) for f in features])


def prefix_counts(rows: DataFrame, path: str, expected: dict[str, int]) -> DataFrame:
    """(prefix, n, expected, as_expected): how many paths start with each prefix."""
    names = list(expected)
    one = rows.agg(*[F.count_if(F.startswith(F.col(path), F.lit(p))).alias(f"p{k}") for k, p in enumerate(names)])
    each = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"p{k}").alias("n"), F.lit(expected[p]).cast("bigint").alias("expected")) for k, p in enumerate(names)])
    return one.select(F.explode(each).alias("x")).select("x.*").withColumn("as_expected", F.col("n") == F.col("expected"))


def correlation_p(rho: float | None, n: int) -> float | None:
    """The two-sided p value of a rank correlation of n pairs, by Student's distribution with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    # the tail is an incomplete beta integral of x = cos(theta)^2; Simpson's rule over theta
    nu, top, steps = n - 2, math.pi / 2, 2000
    start = math.atan(abs(rho) * math.sqrt(nu / (1 - rho * rho)) / math.sqrt(nu))

    def area(a: float, b: float) -> float:
        h = (b - a) / steps
        f = [math.cos(a + k * h) ** (nu - 1) if nu > 1 else 1.0 for k in range(steps + 1)]
        return h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))

    return area(start, top) / area(0.0, top)
