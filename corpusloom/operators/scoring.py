"""Scorers: a registry of models, linear heads in expressions, and training of heads."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import auroc, per_generator, roc, tpr_at


class Scorer(Protocol):
    def score(self, batch: pd.Series) -> pd.Series:
        """A probability or null for each item."""
        ...


_registry: dict[str, Callable[..., Scorer]] = {}


def register(name: str) -> Callable:
    """A decorator that makes a scorer's factory known by name."""

    def put(factory: Callable[..., Scorer]) -> Callable[..., Scorer]:
        _registry[name] = factory
        return factory

    return put


def load(name: str, **options) -> Scorer:
    """A scorer by name; options that its factory doesn't take are left out."""
    if name not in _registry:
        raise KeyError(f"unknown scorer {name!r}; known: {', '.join(sorted(_registry))}")
    factory = _registry[name]
    names = inspect.signature(factory).parameters
    return factory(**{k: v for k, v in options.items() if k in names})


def score_with(rows: DataFrame, column: str, scorer: Scorer) -> DataFrame:
    """rows with score; rows that the scorer can't judge stay, with null. Scores out of [0, 1] are an error."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series(scorer.score(batch))
            if len(out) != len(batch):
                raise ValueError("a scorer must return one score for each item")
            if ((out < 0) | (out > 1)).any():
                raise ValueError("scores must lie in [0, 1]")
            yield out

    return rows.withColumn("score", run(column))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """Null for a vector of length 0."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear_head(v: Column, weights: list[float], bias: float) -> Column:
    """The head's probability; a vector of another length is an error."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.when(F.size(v) == len(weights), sigmoid(dot(v, w) + F.lit(float(bias)))).otherwise(F.raise_error(F.lit(f"the head takes vectors of {len(weights)}")).cast("double"))


def fused(a: Column, b: Column, scale: list[float]) -> Column:
    """One vector of a and of b over its fixed scales."""
    return F.concat(F.transform(a, lambda x: x.cast("double")), F.zip_with(b, F.array(*[F.lit(float(s)) for s in scale]), lambda x, s: x / s))


def train_head(rows: DataFrame, validation: DataFrame, features: str = "features", grid: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1)) -> tuple[list[float], float, float]:
    """(weights, bias, AUROC on validation) of the regularised logistic head that does best there."""
    best = None
    train = rows.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
    held = validation.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"), "label")
    for reg in grid:
        model = LogisticRegression(regParam=reg, maxIter=100, standardization=False).fit(train)
        scored = model.transform(held).select("label", vector_to_array("probability")[1].alias("score"))
        a = roc(scored.withColumn("_k", F.lit(1)), ["_k"]).groupBy("_k").agg(auroc().alias("a")).first()
        a = a["a"] if a and a["a"] is not None else 0.0
        if best is None or a > best[2]:
            best = ([float(x) for x in model.coefficients], float(model.intercept), a)
    return best


def two_feature_probe(train: DataFrame, test: DataFrame, features: list[str], by: str) -> tuple[dict, DataFrame]:
    """What a few plain features tell: a logistic head over standardised features, its AUROC and TPR on test, and the same
    by group, the best first.

    Features are scaled by the population's deviation; the penalty is that of one unit over all training rows.
    """
    moments = train.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = lambda rows: rows.withColumn("_x", F.array(*[(F.col(c).cast("double") - F.lit(moments[f"m{i}"])) / F.lit(moments[f"s{i}"] or 1.0) for i, c in enumerate(features)]))
    ready = scaled(train).select(array_to_vector("_x").alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(regParam=1.0 / max(1, moments["n"]), maxIter=1000, standardization=False).fit(ready)
    weights, bias = [float(x) for x in model.coefficients], float(model.intercept)
    scored = scaled(test).withColumn("score", linear_head(F.col("_x"), weights, bias)).drop("_x")
    every = roc(scored.withColumn("_k", F.lit(1)), ["_k"]).groupBy("_k").agg(auroc().alias("auroc"), tpr_at(0.01).alias("tpr_at_fpr1")).first()
    groups = roc(per_generator(scored.select("label", F.col(by).alias("generator"), "score")), ["generator"]).groupBy("generator").agg(auroc().alias("auroc"), tpr_at(0.01).alias("tpr_at_fpr1")).withColumnRenamed("generator", by).orderBy(F.desc("auroc"), by)
    return {"weights": weights, "bias": bias, "auroc": every["auroc"], "tpr_at_fpr1": every["tpr_at_fpr1"], "n_train": moments["n"]}, groups
