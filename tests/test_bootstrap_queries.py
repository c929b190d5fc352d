"""The registered bootstrap queries against brute force, with as many replicates as the reference takes."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from corpusloom.plans import registry
from corpusloom.plans.tables import items, scores

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def weights(ids, strata, replicates):
    """How often each replicate (row) draws each item (column)."""
    w = np.zeros((replicates, len(ids)))
    members = defaultdict(list)
    for k, (i, s) in enumerate(zip(ids, strata)):
        members[s].append((md5("place", i), i, k))
    for s, m in members.items():
        m.sort()
        for b in range(replicates):
            for at in range(len(m)):
                w[b, m[int(int(md5(0, b, s, at)[:8], 16) / 2**32 * len(m))][2]] += 1
    return w


def tprs(rows, w, at):
    """Of each replicate: the most positives flagged by a threshold that flags 5% of the negatives at most."""
    rows = sorted((r for r in rows if r["score"] is not None), key=lambda r: -r["score"])
    own = w[:, [at[r["id"]] for r in rows]]
    label = np.array([r["label"] for r in rows])
    ends = [k for k in range(len(rows)) if k + 1 == len(rows) or rows[k + 1]["score"] != rows[k]["score"]]
    tp, fp = np.cumsum(own * label, 1), np.cumsum(own * (1 - label), 1)
    with np.errstate(invalid="ignore"):
        best = np.where(fp / fp[:, -1:] <= 0.05 + 1e-12, tp / tp[:, -1:], 0)[:, ends].max(1)
    return np.where((tp[:, -1] > 0) & (fp[:, -1] > 0), best, np.nan)


def interval(x):
    return [float(np.percentile(x[~np.isnan(x)], q)) for q in (50, 2.5, 97.5)]


@pytest.fixture(scope="module")
def runs(spark):
    its = items(spark, str(DATA)).collect()
    by = {}
    for run in "ab":
        by[run] = defaultdict(list)
        for r in scores(spark, str(DATA), run).select("id", "label", "generator", "cell", "family", "score").collect():
            by[run][r["cell"], r["family"]].append(r)
    return its, by, {r["id"]: k for k, r in enumerate(its)}


def test_bootstrap_ci(spark, runs):
    its, by, at = runs
    w = weights(list(at), [r["label"] for r in its], 800)
    got = {r["cell"]: [r["median"], r["lo"], r["hi"]] for r in registry.QUERIES["bootstrap_ci"](spark, str(DATA)).collect()}
    assert set(got) == {c for c, _ in by["a"]}
    assert all(got[c] == pytest.approx(interval(tprs(rows, w, at)), abs=2e-6) for (c, _), rows in by["a"].items())


def test_paired_bootstrap_diff(spark, runs):
    its, by, at = runs
    w = weights(list(at), [r["label"] for r in its], 2000)

    def gaps(run):
        families = defaultdict(list)
        for (_, family), rows in by[run].items():
            families[family].append(tprs(rows, w, at))
        means = {f: np.nanmean(t, 0) for f, t in families.items()}
        return means.pop("clean") - np.nanmean(list(means.values()), 0)

    want = interval(gaps("b") - gaps("a"))
    got = registry.QUERIES["paired_bootstrap_diff"](spark, str(DATA)).first()
    assert [got["median"], got["lo"], got["hi"]] == pytest.approx(want, abs=2e-6)
    assert got["verdict"] == ("excludes zero" if want[1] * want[2] > 0 else "includes zero")


def test_paired_spread_bootstrap(spark, runs):
    its, by, at = runs
    w = weights(list(at), ["real" if r["label"] == 0 else r["generator"] for r in its], 2000)

    def spread(run):
        clean = by[run]["clean", "clean"]
        each = [tprs([r for r in clean if r["label"] == 0 or r["generator"] == g], w, at) for g in {r["generator"] for r in clean if r["label"] == 1}]
        return np.nanmax(each, 0) - np.nanmin(each, 0)

    want = interval(spread("b") - spread("a"))
    got = registry.QUERIES["paired_spread_bootstrap"](spark, str(DATA)).first()
    assert [got["median"], got["lo"], got["hi"]] == pytest.approx(want, abs=2e-6)
    assert got["verdict"] == ("excludes zero" if want[1] * want[2] > 0 else "includes zero")


def test_both_ways_agree(spark, monkeypatch):
    """Few items by sorted scores, many by the relation of each replicate."""
    from corpusloom.operators import bootstrap

    rows = scores(spark, str(DATA)).filter("cell IN ('clean', 'jpeg_30')")
    drawn = bootstrap.draws(items(spark, str(DATA)), ["label"], 7)
    found = []
    for most in (100_000, 0):
        monkeypatch.setattr(bootstrap, "SMALL_ITEMS", most)
        found.append({(r["b"], r["cell"]): r["tpr"] for r in bootstrap.replicate_tpr(rows, drawn, ["cell"], 0.05).collect()})
    assert found[0].keys() == found[1].keys() and all(found[0][k] == pytest.approx(found[1][k]) for k in found[0])


def test_numbered_hashes_equal_md5():
    from corpusloom.functions.hashing import hash32_numbers

    for head in ("0|7|1", "0|1999|réel/x", "0|3|" + "n" * 60, "x" * 48):
        for start, stop in ((0, 12000), (99990, 100020), (5, 5)):
            assert hash32_numbers(head, start, stop).tolist() == [int(md5(head, x)[:8], 16) for x in range(start, stop)]


def test_resampling_equals_draws(spark, monkeypatch):
    """Chunks that split strata, parts that split replicates; and scores of too many levels."""
    from corpusloom.operators import bootstrap

    its, rows = items(spark, str(DATA)), scores(spark, str(DATA)).filter("cell IN ('clean', 'jpeg_30')")
    want = {(r["b"], r["cell"]): r["tpr"] for r in bootstrap.replicate_tpr(rows, bootstrap.draws(its, ["label"], 7), ["cell"], 0.05).collect()}
    monkeypatch.setattr(bootstrap, "CHUNK", 64)
    for most in (4096, 3):
        monkeypatch.setattr(bootstrap, "LEVELS", most)
        got = {(r["b"], r["cell"]): r["tpr"] for r in bootstrap.resampling(its, ["label"], 7)(rows, ["cell"], 0.05).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("name", ["paired_bootstrap_diff", "paired_spread_bootstrap"])
def test_many_items_draw_no_rows(spark, monkeypatch, name):
    """The paired queries with many items never make a row for each draw."""
    from corpusloom.operators import bootstrap

    monkeypatch.setattr(bootstrap, "SMALL_ITEMS", 0)
    monkeypatch.setattr(bootstrap, "draws", None)
    assert registry.QUERIES[name](spark, str(DATA)).count() == 1
