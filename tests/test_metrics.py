from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bootstrap, cells, metrics

SCHEMA = "id string, label int, score double, g string"


def frame(spark, labels, scores, g="g"):
    return spark.createDataFrame([(str(i), y, s, g) for i, (y, s) in enumerate(zip(labels, scores))], SCHEMA)


def brute_auroc(y, s):
    pos, neg = [x for x, k in zip(s, y) if k], [x for x, k in zip(s, y) if not k]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_tpr(y, s, t):
    pos, neg = [x for x, k in zip(s, y) if k], [x for x, k in zip(s, y) if not k]
    best = 0.0
    for cut in set(s):
        if sum(x >= cut for x in neg) / len(neg) <= t + 1e-12:
            best = max(best, sum(x >= cut for x in pos) / len(pos))
    return best


def brute_ap(y, s):
    out = before = 0.0
    for cut in sorted(set(s), reverse=True):
        tp, fp = (sum(x >= cut and k == want for x, k in zip(s, y)) for want in (1, 0))
        out += (tp / sum(y) - before) * tp / (tp + fp)
        before = tp / sum(y)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_metrics_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    y = [rng.randint(0, 1) for _ in range(120)] + [0, 1]
    s = [round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * k, 0.2))), 2) for k in y]  # ties abound
    row = metrics.cell_metrics(frame(spark, y, s), ["g"], 0.05).first()
    assert row["auroc"] == pytest.approx(brute_auroc(y, s))
    assert row["ap"] == pytest.approx(brute_ap(y, s))
    assert row["tpr_at_fpr"] == pytest.approx(brute_tpr(y, s, 0.05))
    assert row["acc"] == pytest.approx(sum((x >= 0.5) == (k == 1) for x, k in zip(s, y)) / len(y))
    strict = metrics.roc(frame(spark, y, s), ["g"]).groupBy("g").agg(metrics.tpr_over_negative(0.05).alias("t")).first()["t"]
    neg = sorted((x for x, k in zip(s, y) if not k), reverse=True)
    cut = neg[max(math.ceil(0.05 * len(neg)) - 1, 0)]
    assert strict == pytest.approx(sum(x > cut for x, k in zip(s, y) if k) / sum(y))


def test_perfect_inverted_constant(spark):
    y = [0] * 10 + [1] * 10
    assert metrics.cell_metrics(frame(spark, y, [k * 1.0 for k in y]), ["g"]).first()["auroc"] == 1
    assert metrics.cell_metrics(frame(spark, y, [1.0 - k for k in y]), ["g"]).first()["auroc"] == 0
    row = metrics.cell_metrics(frame(spark, y, [0.5] * 20), ["g"]).first()
    assert (row["auroc"], row["acc"], row["notes"]) == (0.5, 0.5, "degenerate")


def test_unscorable_single_class_and_empty(spark):
    row = metrics.cell_metrics(frame(spark, [1, 1, 0], [0.9, 0.8, None]), ["g"]).first()
    assert (row["n"], row["n_failed"], row["auroc"], row["ap"], row["acc"]) == (2, 1, None, None, 1.0)
    assert row["notes"] == "single-class; 1 unscorable"
    nan = metrics.cell_metrics(frame(spark, [1, 0], [0.9, float("nan")]), ["g"]).first()
    assert (nan["n"], nan["n_failed"]) == (1, 1)
    assert metrics.cell_metrics(frame(spark, [], []), ["g"]).count() == 0


def test_partitions_do_not_matter(spark):
    rng = random.Random(5)
    df = frame(spark, [rng.randint(0, 1) for _ in range(300)], [rng.random() for _ in range(300)])
    a, b = (metrics.cell_metrics(df.repartition(n), ["g"]).first() for n in (1, 7))
    assert a == b


def grid_of(spark, values):
    by = {c.name: c for c in cells.grid()}
    return spark.createDataFrame([(n, by[n].kind, by[n].family, v) for n, v in values.items()], "cell string, kind string, family string, auroc double")


def test_summary_balances_families(spark):
    base = {"clean": 0.9, "jpeg_90": 0.8, "blur_0.5": 0.6}
    a = metrics.grid_summary(grid_of(spark, base)).first()
    b = metrics.grid_summary(grid_of(spark, base | {"jpeg_70": 0.8, "jpeg_50": 0.8, "jpeg_30": 0.8})).first()
    assert a["robust"] == b["robust"] == pytest.approx(0.7)  # more cells of one family don't help
    assert b["flat_mean"] == pytest.approx(0.76)
    assert a["worst_cell"] == "blur_0.5" and a["gap"] == pytest.approx(0.2) and a["final"] == pytest.approx(0.8)


def test_summary_worst_may_be_clean_and_undefined_is_skipped(spark):
    row = metrics.grid_summary(grid_of(spark, {"clean": 0.5, "jpeg_90": 0.8, "blur_0.5": None})).first()
    assert row["worst_cell"] == "clean" and row["robust"] == pytest.approx(0.8)
    assert (row["n_undefined"], row["n_families"]) == (1, 2)
    assert "blur=undefined" in row["family_means"]


def test_grid_has_19_cells():
    names = [c.name for c in cells.grid()]
    assert len(names) == 19 and names[0] == "clean" and "composed_resize0.25+blur0.5+jpeg30" in names and "blur_2.0" in names and "jpeg_90" in names
    assert [c.name for c in cells.select_cells(["noise", "noise_0.05", "clean"])] == ["clean", "noise_0.02", "noise_0.05", "noise_0.1"]
    with pytest.raises(ValueError):
        cells.select_cells(["nothing"])


def test_null_sd_by_simulation(spark):
    rng = random.Random(1)
    got = []
    for _ in range(300):
        s = [rng.random() for _ in range(60)]
        got.append(brute_auroc([0] * 30 + [1] * 30, s))
    mean = sum(got) / len(got)
    sd = math.sqrt(sum((x - mean) ** 2 for x in got) / len(got))
    want = spark.range(1).select(metrics.auroc_null_sd(F.lit(30), F.lit(30)).alias("x")).first()["x"]
    assert abs(sd - want) < 0.015


def test_per_generator_shares_negatives(spark):
    df = spark.createDataFrame([("a", 1, 0.9, "x"), ("b", 1, 0.2, "y"), ("c", 0, 0.5, "z")], "id string, label int, score double, generator string")
    rows = {r["generator"]: r["auroc"] for r in metrics.roc(metrics.per_generator(df), ["generator"]).groupBy("generator").agg(metrics.auroc().alias("auroc")).collect()}
    assert rows == {"x": 1.0, "y": 0.0}


def test_bootstrap_weights_keep_strata_and_seed(spark):
    items = spark.createDataFrame([(str(i), i % 2) for i in range(40)], "id string, label int")
    d = bootstrap.draws(items, ["label"], 5)
    assert {(r["b"], r["label"]): r["n"] for r in d.groupBy("b", "label").agg(F.sum("w").alias("n")).collect()} == {(b, y): 20 for b in range(5) for y in (0, 1)}
    assert sorted(d.collect()) == sorted(bootstrap.draws(items.repartition(3), ["label"], 5).collect())
    assert sorted(d.collect()) != sorted(bootstrap.draws(items, ["label"], 5, seed=1).collect())


def test_weighted_metric_equals_copies(spark):
    rng = random.Random(3)
    y, s = [0, 1] * 15, [round(rng.random(), 1) for _ in range(30)]
    scores = frame(spark, y, s).withColumn("cell", F.lit("c"))
    drawn = bootstrap.draws(scores.select("id", "label"), ["label"], 3)
    got = {r["b"]: r["tpr"] for r in bootstrap.replicate_tpr(scores, drawn, ["cell"], 0.2).collect()}
    for b in range(3):
        rows = [(y[int(r["id"])], s[int(r["id"])]) for r in drawn.filter(F.col("b") == b).collect() for _ in range(r["w"])]
        assert got[b] == pytest.approx(brute_tpr([a for a, _ in rows], [c for _, c in rows], 0.2))


def test_alignment_reports_each_fault(spark):
    a = spark.createDataFrame([("1", 0), ("2", 1), ("3", 1)], "id string, label int")
    b = spark.createDataFrame([("2", 0), ("3", 1), ("4", 1)], "id string, label int")
    assert sorted(map(tuple, metrics.aligned(a, b, "id", ["label"]).collect())) == [("1", "only in first"), ("2", "differs"), ("4", "only in second")]


def test_errors_and_verdicts(spark):
    df = frame(spark, [0, 0, 1, 1], [0.9, 0.1, 0.05, None])
    assert [r["id"] for r in metrics.worst_errors(df, 0, 1, ["id"]).collect()] == ["0"]
    assert [r["id"] for r in metrics.worst_errors(df, 1, 9, ["id"]).collect()] == ["2"]
    assert [r["v"] for r in df.orderBy("id").select(metrics.verdict(F.col("score")).alias("v")).collect()] == ["likely", "unlikely", "unlikely", "unable"]
