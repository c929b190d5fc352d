"""Queries on rasters, trained heads and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, images, metrics, scoring
from ..operators.storage import scratch_dir
from ..streaming.ingest import ingest_stream, windowed_counts
from .metric_queries import rounded
from .registry import query
from .tables import table

Session = SparkSession
#: Rasters that stand in for a corpus of images; no table holds any.
N_IMAGES = 64


@query()
def image_grid_metrics(spark: Session, d: str) -> DataFrame:
    """The grid over rasters with a scorer that knows nothing."""
    return rounded(metrics.cell_metrics(images.grid_scores(images.synthetic(spark, N_IMAGES, partitions=8)), ["cell", "kind", "family"]))


@query()
def image_frequency_features(spark: Session, d: str) -> DataFrame:
    return images.features(images.synthetic(spark, N_IMAGES, partitions=8))


@query()
def image_content_features(spark: Session, d: str) -> DataFrame:
    return images.content(images.synthetic(spark, N_IMAGES, partitions=8))


@query()
def augmented_feature_cache(spark: Session, d: str) -> DataFrame:
    return images.cached_features(images.synthetic(spark, N_IMAGES, partitions=8), 2)


@query()
def image_near_duplicates(spark: Session, d: str) -> DataFrame:
    """Perceptual hashes of rasters and of their JPEG versions, and their near pairs."""
    from ..functions import rasters

    base = images.synthetic(spark, N_IMAGES, partitions=8)
    again = images.mapped(base, lambda r, a: [(r["id"] + "-jpeg", rasters.phash(rasters.jpeg(a, 70)))], "id string, phash bigint")
    rows = images.hashes(base).unionByName(again).select("id", *dedup.halves(F.col("phash")))
    return dedup.clusters(rows, "id")


@query()
def domain_guard_flags(spark: Session, d: str) -> DataFrame:
    return images.guards(images.synthetic(spark, N_IMAGES, partitions=8))


@query()
def ela_summary(spark: Session, d: str) -> DataFrame:
    return images.ela(images.synthetic(spark, N_IMAGES, partitions=8)).drop("heat")


@query()
def encoded_sizes(spark: Session, d: str) -> DataFrame:
    return images.encoded(images.synthetic(spark, N_IMAGES, partitions=8)).drop("content")


@query()
def normalised_corpus(spark: Session, d: str) -> DataFrame:
    return images.normalised(images.synthetic(spark, N_IMAGES, 96, partitions=8), list(images.BAKED_QUALITIES), size=64).drop("data")


@query()
def trained_head_auroc(spark: Session, d: str) -> DataFrame:
    """A head that tells one label of the embeddings from the others: trained on some, judged on the rest."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("label") < 5).cast("int").alias("label"), F.pmod(F.xxhash64("vec_id"), F.lit(10)).alias("fold"))
    weights, bias, _ = scoring.train_head(rows.filter("fold < 6"), rows.filter("fold IN (6, 7)"))
    held = rows.filter("fold > 7").withColumn("score", scoring.linear_head(F.col("features"), weights, bias)).withColumn("part", F.lit("test"))
    return metrics.roc(held, ["part"]).groupBy("part").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"), metrics.auroc().alias("auroc"))


@query("WITH n AS (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents WHERE length(text) >= 200) SELECT sha FROM n WHERE r = 1")
def stream_ingest_state(spark: Session, d: str) -> DataFrame:
    """The ledger after a stream over the documents has run dry: each content once."""
    docs = table(spark, d, "documents")
    where = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs.repartition(4, "source").write.parquet(f"{where}/in")
    ingest_stream(spark, f"{where}/in", docs.schema, f"{where}/ledger", f"{where}/checkpoint", key="doc_id", accept=F.length("text") >= 200, files=2).awaitTermination()
    return spark.read.parquet(f"{where}/ledger").select("sha")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(spark: Session, d: str) -> DataFrame:
    return rounded(windowed_counts(table(spark, d, "events")), 4)
