"""Writing results: tables through Spark; reports, whose size doesn't grow with the data, as single files."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_text(v: object) -> str:
    """A number to four places; a dash where there is none."""
    if v is None:
        return "—"
    return f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown(rows: DataFrame, columns: list[str] | None = None) -> str:
    """A table of a result with few rows, as reports have."""
    columns = columns or rows.columns
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell_text(r[c]) for c in columns) + " |" for r in rows.collect()])


def slug(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_")


def write_json(path: str | Path, value: object) -> None:
    """Through a second file, so that no reader sees half of it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(path.name + ".tmp")
    draft.write_text(json.dumps(value, indent=2, sort_keys=True, default=str))
    draft.replace(path)


def write_evaluation(out: str | Path, cells: DataFrame, summary: DataFrame, scores: DataFrame | None = None, config: dict | None = None) -> None:
    """grid.csv, summary.json and report.md in a folder of the driver; score rows, if given, as Parquet beside them."""
    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    cells = cells.orderBy("cell")
    rows = [r.asDict() for r in cells.collect()]  # 19 at most
    names = cells.columns
    quoted = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"' if isinstance(v, str) and re.search('[",\n]', v) else str(v)
    (out / "grid.csv").write_text("\n".join([",".join(names), *(",".join(quoted(r[n]) for n in names) for r in rows)]) + "\n")
    write_json(out / "summary.json", {"summary": summary.first().asDict(), "config": config or {}})
    (out / "report.md").write_text(f"# Evaluation\n\n{markdown(summary.drop('family_means'))}\n\n## Cells\n\n{markdown(cells)}\n")
    if scores is not None:
        scores.write.mode("overwrite").parquet(str(out / "scores.parquet"))


def write_splits(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_content_store(rows: DataFrame, path: str, sha: str = "sha") -> None:
    """Contents under their generator and the first two digits of their hash."""
    rows.withColumn("prefix", F.substring(sha, 1, 2)).write.mode("append").partitionBy("generator", "prefix").parquet(path)


def blocklist_record(shas: DataFrame, hashes: DataFrame, sources: list[str], gaps: list[str]) -> DataFrame:
    """One row: sorted digests, hashes as unsigned decimals, counts. For lists that the driver could hold, too."""
    s = shas.agg(F.array_sort(F.collect_set("sha")).alias("sha256")).withColumn("_k", F.lit(1))
    big = F.col("hi").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)") + F.col("lo").cast("decimal(20,0)")
    h = hashes.agg(F.array_sort(F.collect_list(big.cast("decimal(20,0)").cast("string"))).alias("phash")).withColumn("_k", F.lit(1))
    lists = [F.array(*[F.lit(x) for x in xs]).cast("array<string>").alias(n) for n, xs in (("sources", sources), ("gaps", gaps))]
    return s.join(h, "_k").select("sha256", "phash", *lists, F.size("sha256").alias("n_sha256"), F.size("phash").alias("n_phash"))


def predictions(rows: DataFrame, path: str, score: str = "score", flag: Column | None = None) -> DataFrame:
    """(image_path, pred, domain_flag) in the order of paths; what couldn't be scored stays, with null."""
    return rows.select(F.col(path).alias("image_path"), F.col(score).alias("pred"), (flag if flag is not None else F.lit(None).cast("string")).alias("domain_flag")).orderBy("image_path")


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))
