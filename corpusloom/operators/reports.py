"""Reports: audits, gaps of runs, statistics of a corpus, probes and stress tests, as tables and single files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from . import audit, bootstrap, cells, metrics, scoring


def _write(path: Path, title: str, parts: dict[str, DataFrame | str]) -> None:
    """A page of tables, each of few rows."""
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n\n".join(f"## {name}\n\n{part if isinstance(part, str) else sinks.markdown(part)}" for name, part in parts.items())
    path.write_text(f"# {title}\n\n{text}\n")


def audit_report(out: str | Path, rows: DataFrame, features: tuple[str, ...], klass: str) -> DataFrame:
    """report.md with leaks by feature, mean features, metadata and shapes by class, and per_image.csv with all rows.

    rows: one per file, with label, klass, and what probes() found. Returns the ranking of features.
    """
    out = Path(out)
    views = audit.class_views(rows, klass, rows.agg(F.min(klass)).first()[0])
    ranking = audit.leak_ranking(audit.leak_auroc(audit.long_features(views, features, ["view", "label"]), ["view"]))
    flags = {"has_exif": F.col("has_exif"), "has_icc": F.col("has_icc"), "has_text": F.col("n_text_chunks") > 0, "generator_marker": F.col("generator_marker") != ""}
    _write(
        out / "report.md",
        "Audit",
        {
            "Features by their largest leak": ranking,
            "Mean features by class": audit.mean_features(rows, klass, features).orderBy(klass),
            "Metadata by class": audit.presence(rows, klass, flags).orderBy(klass),
            "Shapes by class": audit.top_shares(rows, klass, ["width", "height"], 6).orderBy(klass, "rank"),
            "Status": rows.groupBy(klass, "status").agg(F.count("*").alias("n")).orderBy(klass, "status"),
        },
    )
    rows.drop("phash").write.mode("overwrite").option("header", "true").csv(str(out / "per_image.csv"))
    return ranking


def gap_report(out: str | Path, label: str, scores: DataFrame, replicates: int, seed: int = 0) -> dict:
    """Of a run (id, label, generator, cell, family, score): TPR at 1% and 5% by cell and by generator with 95% intervals, as
    two CSV files named by the run's label, and a report. Returns the gaps with their intervals and verdicts."""
    out, name = Path(out), sinks.slug(label)
    out.mkdir(parents=True, exist_ok=True)
    drawn = bootstrap.draws(scores.select("id", "label").distinct(), ["label"], replicates, seed)
    found, by_cell, by_generator = {}, None, None
    clean = metrics.per_generator(scores.filter("cell = 'clean'").select("id", "label", "generator", "score"))
    for budget, k in ((0.01, "tpr1"), (0.05, "tpr5")):
        t = bootstrap.replicate_tpr(scores, drawn, ["cell", "family"], budget)
        own = metrics.roc(scores, ["cell", "family"]).groupBy("cell", "family").agg(metrics.tpr_at(budget).alias(k))
        bounds = t.groupBy("cell").agg(*[x.alias(f"{k}_{n}") for x, n in zip(bootstrap.interval("tpr")[1:], ("ci_lo", "ci_hi"))])
        table = own.join(bounds, "cell")
        by_cell = table if by_cell is None else by_cell.join(table.drop("family"), "cell")
        g = bootstrap.gap(t, ["b"]).agg(*bootstrap.interval("gap")).withColumn("verdict", bootstrap.excludes_zero(F.col("lo"), F.col("hi"))).first()
        found[k] = g.asDict()
        each = metrics.roc(clean, ["generator"]).groupBy("generator").agg(F.max("pos").alias("n"), metrics.tpr_at(budget).alias(f"clean_{k}"))
        by_generator = each if by_generator is None else by_generator.join(each.drop("n"), "generator")
    # a row for each cell, and for each generator: few, whatever the run's size
    by_cell.orderBy("cell").toPandas().to_csv(out / f"{name}_cells.csv", index=False)
    by_generator.orderBy("generator").toPandas().to_csv(out / f"{name}_generators.csv", index=False)
    gaps = "\n".join(f"{k}: median {v['median']}, 95% from {v['lo']} to {v['hi']}, {v['verdict']}" for k, v in found.items())
    _write(out / f"{name}_report.md", f"Gaps of {label}", {"Gap of clean and degraded": gaps, "Cells": by_cell.orderBy("cell"), "Generators": by_generator.orderBy("generator")})
    return found


def corpus_report(path: str | Path, rows: DataFrame) -> None:
    """Statistics of a built corpus (label, generator, source_dataset, split, and width, height, n_bytes if known)."""
    parts = {
        "Rows by split and label": rows.groupBy("split", "label").agg(F.count("*").alias("n")).orderBy("split", "label"),
        "Rows by source and split": rows.groupBy("source_dataset").pivot("split", ["train", "val", "test"]).count().orderBy("source_dataset"),
        "Rows by generator": rows.groupBy("generator", "label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "generator"),
    }
    if {"width", "height", "n_bytes"} <= set(rows.columns):
        known = audit.geometry(rows)
        medians = [F.median(c).alias(f"median_{c}") for c in ("width", "height", "n_bytes", "megapixels", "bytes_per_pixel", "short_side")]
        parts["Geometry by source"] = known.groupBy("source_dataset").agg(F.count("*").alias("n"), *medians, F.avg(F.col("is_square").cast("double")).alias("square_share")).orderBy("source_dataset")
    _write(Path(path), "Corpus", parts)


def probe_report(out: str | Path, train: DataFrame, test: DataFrame, features: list[str], by: str, head: DataFrame | None = None) -> dict:
    """probe.json and probe.md of a head over a few plain features; with another head's (by, auroc), how their ranks of
    groups go together."""
    out = Path(out)
    found, groups = scoring.two_feature_probe(train, test, features, by)
    if head is not None:
        pairs = groups.select(by, F.col("auroc").alias("x")).join(head.select(by, F.col("auroc").alias("y")), by)
        r = audit.rank_correlation(pairs, "x", "y").first()
        found |= {"spearman": r["rho"], "spearman_p": audit.correlation_p(r["rho"], r["n"]), "spearman_n": r["n"]}
    sinks.write_json(out / "probe.json", found)
    _write(out / "probe.md", "Probe", {"All": "\n".join(f"{k}: {sinks.cell_text(v)}" for k, v in found.items()), f"By {by}": groups})
    return found


def stress(a: DataFrame, b: DataFrame, family: str = "jpeg") -> DataFrame:
    """(cell, severity, first, second, difference): AUROC of two runs in the cells of one family, mildest first."""
    names = {c.name: c.severity for c in cells.grid() if c.family == family}
    one = lambda rows, name: metrics.roc(rows.filter(F.col("cell").isin(list(names))), ["cell"]).groupBy("cell").agg(metrics.auroc().alias(name))
    severity = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("cell")]
    both = one(a, "first").join(one(b, "second"), "cell").withColumn("severity", severity).withColumn("difference", F.col("second") - F.col("first"))
    return both.select("cell", "severity", "first", "second", "difference").orderBy(F.desc("severity"))
