"""Reading corpora: manifests, image folders, archives, blocklists; samples of rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash_key
from ..operators.ranges import numbered, ranked
from ..operators.storage import save, small_enough

EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp")
IMAGE_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in EXTENSIONS) + "}"
MANIFEST = "image_path string, label int, generator string, source_dataset string, split string"
LEDGER = (
    "image_path string, label int, generator string, family string, source_dataset string, split_hint string, src_sha256 string, out_sha256 string, src_width int, src_height int, src_format string, src_jpeg_quality int, "
    "crop_x int, crop_y int, first_gen_quality int, first_gen_subsampling string, load_status string, pad_frac double, n_bytes bigint, shard int, row_group int, config_hash string"
)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of image files below the folder, whatever the case of their extension; others aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB).load(folder).select("path", "length", "content")


def manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows of a CSV manifest; a malformed line or a label other than 0 and 1 is an error when it is read."""
    rows = spark.read.schema(MANIFEST).option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)
    label = F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("label must be 0 or 1: "), F.coalesce(F.col("label").cast("string"), F.lit("null")))).cast("int"))
    rows = rows.withColumn("label", label)
    return rows if split is None else rows.filter(F.col("split") == split)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def csv_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all CSV lists of a folder, with the list each is from."""
    rows = spark.read.option("header", "true").csv(folder)
    return rows.withColumn("list", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def zip_members(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, name, content) of the image files in the zip archives of a folder, one archive at a time."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.rpartition(".")[2].lower() in EXTENSIONS:
                            yield pa.RecordBatch.from_pydict({"archive": [path], "name": [name], "content": [z.read(name)]}, schema=pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(walk, "archive string, name string, content binary")


def image_bytes(rows: DataFrame, column: str = "image") -> DataFrame:
    """rows with content, from a column of bytes or of a struct that holds them."""
    kind = dict(rows.dtypes)[column]
    return rows.withColumn("content", F.col(f"{column}.bytes") if kind.startswith("struct") else F.col(column))


def blocklist(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(sha, hashes, gaps): hex digests, 64-bit hashes as halves, and what couldn't be read. A missing file is an
    empty list with a gap. Hashes are unsigned decimals in text."""
    schema = "sha256 array<string>, phash array<string>, sources array<string>, gaps array<string>"
    try:
        raw = spark.read.schema(schema).option("multiLine", "true").json(path)
        gaps = [g for r in raw.select("gaps").collect() for g in (r["gaps"] or [])]
    except Exception as e:  # Spark tells a missing path by an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw, gaps = spark.createDataFrame([], schema), [f"no blocklist at {path}"]
    big = F.explode("phash").alias("p")
    wide = raw.select(big).select(F.col("p").cast("decimal(20,0)").alias("p"))
    half = F.lit(2**32).cast("decimal(20,0)")
    hashes = wide.select(F.floor(F.col("p") / half).cast("bigint").alias("hi"), (F.col("p") % half).cast("bigint").alias("lo"))
    return raw.select(F.explode("sha256").alias("sha")), hashes, gaps


def sample_files(spark: SparkSession, folder: str, n: int, seed: int = 0) -> DataFrame:
    """(path, folder, length, content) of about n image files, each folder's share in proportion to its files, drawn by a
    seeded hash of the path. Paths are listed and drawn first; contents of the drawn files alone leave their tasks."""
    files = images(spark, folder).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    names = save(files.select("path", "folder", hash_key(seed, F.col("path")).alias("_key")), "sample-names")  # reads no contents
    every = names.count()
    drawn = ranked(names, ["folder"], "_key", ["path"]).filter(F.col("before") < F.ceil(F.col("total") * F.lit(n / max(1, every)))).select("path")
    return files.join(small_enough(save(drawn, "sample-drawn"), 1_000_000), "path", "left_semi").select("path", "folder", "length", "content")


def sample_blocks(rows: DataFrame, source: str, order: str, size: int, n: int, seed: str) -> DataFrame:
    """n blocks of neighbouring rows from each source, by a seeded hash of the block's number."""
    blocks = numbered(rows, [source], [order], "_at").withColumn("block", F.floor(F.col("_at") / size)).drop("_at")
    blocks = save(blocks, "sample-blocks")
    # one row per block; a window sees those of one source that may be drawn
    rank = F.row_number().over(Window.partitionBy(source).orderBy(hash_key(seed, F.col(source), F.col("block")), "block"))
    drawn = blocks.select(source, "block").distinct().withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
    return blocks.join(drawn, [source, "block"], "left_semi").select(*rows.columns, "block")


def seeded_first(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return rows.orderBy(hash_key(seed, F.col(key)), key).limit(n)
