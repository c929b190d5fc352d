"""python -m corpusloom.cli COMMAND: evaluate, gap, audit, stats, probe, stress, cache, sample-bytes, split, predict, train, ingest,
footprint, query."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import rasters
from .operators import audit, bootstrap, cells, dedup, images, metrics, reports, scoring, splits
from .sources import catalog, readers, sinks
from .streaming.ingest import ingest_stream


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def evaluate(a: argparse.Namespace) -> None:
    """Score images in the grid, or take scores, and write grid, summary and report."""
    spark = session()
    if a.scores:
        scores = spark.read.parquet(a.scores)
    else:
        rows = readers.manifest(spark, a.manifest, a.split)
        if a.limit:
            rows = splits.stratified_limit(rows, "label", a.limit, "image_path", a.seed)
        found = matched(rows, images.decoded_folder(spark, a.images)).select(F.col("image_path").alias("id"), "label", "height", "width", "data")
        scored = images.grid_scores(found.filter("data IS NOT NULL"), a.model, a.seed, a.cells)
        # what can't be read counts as failed in every cell
        failed = cells.expand(found.filter("data IS NULL").select("id", "label"), cells.cell_table(spark, a.cells)).drop("severity").withColumn("score", F.lit(None).cast("double"))
        scores = scored.unionByName(failed)
    table = metrics.cell_metrics(scores, ["cell", "kind", "family"], a.fpr_target)
    sinks.write_evaluation(a.out, table, metrics.grid_summary(table), None if a.no_scores else scores, vars(a) | {"run": None})


def matched(rows, files):
    """rows with what files (path and others) have, null where a file is missing. A file is a row's if its path ends with
    the row's image_path, so that files of one name in different folders stay apart."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    rows, files = rows.withColumn("_name", name("image_path")), files.withColumn("_file", name("path"))
    ends = F.endswith(F.concat(F.lit("/"), "path"), F.concat(F.lit("/"), F.regexp_replace("image_path", "^(?:[.]?/)+", "")))
    return rows.join(files, (F.col("_name") == F.col("_file")) & ends, "left").drop("_name", "_file")


def gap(a: argparse.Namespace) -> None:
    """TPR gaps of a run with bootstrap intervals, as a report with two CSV files if a folder is named."""
    spark = session()
    scores = spark.read.parquet(a.scores)
    if a.out:
        found = reports.gap_report(a.out, a.label, scores, a.replicates, a.seed)
        for k, v in found.items():
            print(k, v)
        return
    drawn = bootstrap.draws(scores.select("id", "label").distinct(), ["label"], a.replicates, a.seed)
    t = bootstrap.replicate_tpr(scores, drawn, ["cell", "family"], a.fpr_target)
    g = bootstrap.gap(t, ["b"]).agg(*bootstrap.interval("gap"))
    g.withColumn("verdict", bootstrap.excludes_zero(F.col("lo"), F.col("hi"))).show(truncate=False)


def audit_files(a: argparse.Namespace) -> None:
    """What single features of files tell about a class column of the manifest. A folder named by --out gets a report and a
    row for each image; one named by --cache keeps what files tell, and isn't made again."""
    spark = session()
    rows = readers.manifest(spark, a.manifest)
    if a.cache and Path(a.cache).exists():
        found = spark.read.parquet(a.cache)
    else:
        found = images.probes(readers.images(spark, a.images))
        if a.cache:
            found.write.parquet(a.cache)
            found = spark.read.parquet(a.cache)
    both = matched(rows, found).filter("path IS NOT NULL")
    names = ("n_bytes", "width", "height", "n_text_chunks")
    if a.out:
        reports.audit_report(a.out, both.withColumn("phash", F.lit(None).cast("bigint")), names, "generator")
    leaks = audit.leak_auroc(audit.long_features(both, names, ["label"]), [])
    leaks.orderBy(F.desc("leak")).show(truncate=False)


def stats(a: argparse.Namespace) -> None:
    """Statistics of a corpus' manifest or ledger."""
    spark = session()
    rows = spark.read.parquet(a.rows) if not a.rows.endswith(".csv") else readers.manifest(spark, a.rows)
    reports.corpus_report(a.out, rows)


def probe(a: argparse.Namespace) -> None:
    """A head over a few plain features (label, group and the features), and its groups beside another head's."""
    spark = session()
    head = spark.read.parquet(a.head) if a.head else None
    print(reports.probe_report(a.out, spark.read.parquet(a.train), spark.read.parquet(a.test), a.features, a.by, head))


def stress(a: argparse.Namespace) -> None:
    """Two runs beside each other over the severities of one degradation."""
    spark = session()
    reports.stress(spark.read.parquet(a.first), spark.read.parquet(a.second), a.family).show(truncate=False)


def cache(a: argparse.Namespace) -> None:
    """Rasters of a manifest in the cells of the grid, lossless; what is there isn't made again."""
    spark = session()
    found = matched(readers.manifest(spark, a.manifest), images.decoded_folder(spark, a.images)).filter("data IS NOT NULL")
    rows = images.cache_transformed(found.select(F.col("image_path").alias("id"), "label", "height", "width", "data"), a.out, a.cells, a.seed)
    print(rows.count())


def sample_bytes(a: argparse.Namespace) -> None:
    """Files drawn by a seeded hash in proportion to their folders, their bytes as they are."""
    spark = session()
    readers.sample_files(spark, a.folder, a.n, a.seed).write.mode("overwrite").parquet(a.out)


def split(a: argparse.Namespace) -> None:
    """Cluster a ledger with a phash column, split it, and write a folder for each split."""
    spark = session()
    rows = spark.read.parquet(a.ledger)
    sha, hashes, gaps = readers.blocklist(spark, a.blocklist)
    keyed = rows.filter("phash IS NOT NULL").select(F.col("image_path").alias("key"), F.col("src_sha256").alias("sha"), *dedup.halves(F.col("phash")), "label", "generator")
    hits = dedup.block_hits(keyed, "key", sha, hashes)
    ready = keyed.join(dedup.clusters(keyed.select("key", "hi", "lo"), "key"), "key").join(hits, "key", "left")
    held = [r["name"] for r in catalog.held_out(catalog.registry(spark)).collect()]
    out = splits.assign(ready, key="key", holdout=F.col("generator").isin(held), blocked=F.col("reason").isNotNull(), seed=a.seed, strict=a.strict)
    sinks.write_splits(out, a.out)
    for g in gaps:
        print("gap:", g)


def predict(a: argparse.Namespace) -> None:
    """Scores of a folder's images as JSON lines in the order of paths."""
    spark = session()
    found = images.decoded_folder(spark, a.images)
    ready = found.filter("data IS NOT NULL").withColumn("label", F.lit(0)).withColumnRenamed("path", "id")
    scored = images.mapped(ready, lambda r, x: [(r["id"], images.SCORERS[a.model](x), "non-photographic" if rasters.domain_guard(x)[2] else None)], "id string, score double, flag string")
    out = sinks.predictions(found.select("path").join(scored, found["path"] == scored["id"], "left"), "path", flag=F.col("flag"))
    out.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(a.out)


def train(a: argparse.Namespace) -> None:
    """A head over cached features (id, label, features), the best of a grid on the validation rows."""
    spark = session()
    weights, bias, a_val = scoring.train_head(spark.read.parquet(a.features), spark.read.parquet(a.validation))
    sinks.write_json(a.out, {"weights": weights, "bias": bias, "embed_dim": len(weights), "validation_auroc": a_val})


def ingest(a: argparse.Namespace) -> None:
    """Take new contents of a folder of Parquet files into a ledger."""
    spark = session()
    ingest_stream(spark, a.source, spark.read.parquet(a.source).schema, a.ledger, a.checkpoint, key=a.key).awaitTermination()


def footprint(a: argparse.Namespace) -> None:
    rows = catalog.footprint(catalog.registry(session()))
    rows.show(truncate=False)
    catalog.footprint_total(rows, a.keep_raw).show()


def query(a: argparse.Namespace) -> None:
    """Run a registered query over a folder of tables."""
    from .plans import registry

    registry.QUERIES[a.name](session(), a.tables).show(a.rows, truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, name: str, *args: tuple) -> None:
        c = sub.add_parser(name, help=f.__doc__)
        for flags, options in args:
            c.add_argument(*flags, **options)
        c.set_defaults(run=f)

    arg = lambda *flags, **options: (flags, options)
    seed, fpr = arg("--seed", type=int, default=0), arg("--fpr-target", type=float, default=0.01)
    command(evaluate, "evaluate", arg("--scores"), arg("--manifest"), arg("--images"), arg("--split"), arg("--model", default="random", choices=sorted(images.SCORERS)), arg("--cells", nargs="*"), arg("--limit", type=int), arg("--out", required=True), arg("--no-scores", action="store_true"), seed, fpr)
    command(gap, "gap", arg("--scores", required=True), arg("--replicates", type=int, default=800), arg("--out"), arg("--label", default="run"), seed, arg("--fpr-target", type=float, default=0.05))
    command(audit_files, "audit", arg("--manifest", required=True), arg("--images", required=True), arg("--out"), arg("--cache"))
    command(stats, "stats", arg("--rows", required=True), arg("--out", required=True))
    command(probe, "probe", arg("--train", required=True), arg("--test", required=True), arg("--features", nargs="+", required=True), arg("--by", default="generator"), arg("--head"), arg("--out", required=True))
    command(stress, "stress", arg("--first", required=True), arg("--second", required=True), arg("--family", default="jpeg", choices=sorted(cells.FAMILIES)))
    command(cache, "cache", arg("--manifest", required=True), arg("--images", required=True), arg("--cells", nargs="*"), arg("--out", required=True), seed)
    command(sample_bytes, "sample-bytes", arg("folder"), arg("--n", type=int, required=True), arg("--out", required=True), seed)
    command(split, "split", arg("--ledger", required=True), arg("--blocklist", default=""), arg("--out", required=True), arg("--strict", action="store_true"), seed)
    command(predict, "predict", arg("images"), arg("--out", required=True), arg("--model", default="brightness", choices=sorted(images.SCORERS)))
    command(train, "train", arg("--features", required=True), arg("--validation", required=True), arg("--out", required=True))
    command(ingest, "ingest", arg("--source", required=True), arg("--ledger", required=True), arg("--checkpoint", required=True), arg("--key", required=True))
    command(footprint, "footprint", arg("--keep-raw", action="store_true"))
    command(query, "query", arg("name"), arg("tables"), arg("--rows", type=int, default=50))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if getattr(a, "cells", None):
        cells.select_cells(a.cells)  # unknown names fail before any work
    a.run(a)


if __name__ == "__main__":
    main()
