"""Rasters in tables: generation, degradation grids with scores, features, hashes, guards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jpegfile
from ..functions import rasters as R
from ..sources import png
from .cells import grid

#: Rasters are large: so many rows at a time.
BATCH = 32
RASTER = "id string, label int, height int, width int, data binary"


def synthetic(spark: SparkSession, n: int, side: int = 64, lift: float = 0.0, partitions: int | None = None) -> DataFrame:
    """n textures by their index alone; labels alternate, and lift plants brightness on label 1."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for at in range(0, len(ids), BATCH):
                part = ids[at : at + BATCH]
                data = [R.synthetic_raster(i, side, lift * (i % 2)).tobytes() for i in part]
                yield pa.RecordBatch.from_pydict({"id": [f"item-{i:06d}" for i in part], "label": pa.array([i % 2 for i in part], pa.int32()), "height": pa.array([side] * len(part), pa.int32()), "width": pa.array([side] * len(part), pa.int32()), "data": data})

    return spark.range(0, n, 1, partitions).mapInArrow(make, RASTER)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """(other columns, raster) of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            for row in batch.slice(at, BATCH).to_pylist():
                a = np.frombuffer(row.pop("data"), np.uint8).reshape(row["height"], row["width"], 3)
                yield row, a


def mapped(images: DataFrame, f: Callable[[dict, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows that f makes of each raster; one raster is in memory at a time, with a bounded batch of results."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row, a in rows_of(batches):
            held += f(row, a)
            if len(held) >= 512:
                yield from out(held)
                held = []
        yield from out(held)

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    types = [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    return images.mapInArrow(run, schema)


SCORERS: dict[str, Callable[[np.ndarray], float | None]] = {"random": R.random_score, "brightness": R.brightness_score}


def grid_scores(images: DataFrame, scorer: str | Callable[[np.ndarray], float | None] = "random", seed: int = 0, names: list[str] | None = None) -> DataFrame:
    """(id, label, cell, kind, family, score): each raster is read once, degraded in every cell, and scored.

    What can't be scored has null. Results hang on ids and cells only, not on order or partitions.
    """
    score = SCORERS[scorer] if isinstance(scorer, str) else scorer
    from .cells import select_cells

    cells = select_cells(names) if names else grid()

    def one(row: dict, a: np.ndarray) -> list[tuple]:
        return [(row["id"], row["label"], c.name, c.kind, c.family, score(R.degraded(a, row["id"], c.name, c.ops, seed))) for c in cells]

    return mapped(images, one, "id string, label int, cell string, kind string, family string, score double")


def features(images: DataFrame) -> DataFrame:
    return mapped(images, lambda r, a: [(r["id"], r["label"], R.frequency_features(a).tolist())], "id string, label int, features array<double>")


def cached_features(images: DataFrame, copies: int, seed: int = 0) -> DataFrame:
    """(id, label, features, degradation): the raster itself and so many augmented copies, named id#augK."""

    def one(r: dict, a: np.ndarray) -> list[tuple]:
        out = [(r["id"], r["label"], R.frequency_features(a).tolist(), R.plan_vector(()))]
        for k in range(copies):
            b, v = R.augmented(a, r["id"], k, seed)
            out.append((f"{r['id']}#aug{k}", r["label"], R.frequency_features(b).tolist(), v))
        return out

    return mapped(images, one, "id string, label int, features array<double>, degradation array<double>")


def content(images: DataFrame) -> DataFrame:
    names = ("aspect", "uniq_colors_k", "hf_energy", "flat_frac", "pure_bw_frac", "sat_mean")
    return mapped(images, lambda r, a: [(r["id"], r["label"], *(R.content_features(a)[n] for n in names))], "id string, label int, " + ", ".join(f"{n} double" for n in names))


def hashes(images: DataFrame) -> DataFrame:
    return mapped(images, lambda r, a: [(r["id"], R.phash(a))], "id string, phash bigint")


def guards(images: DataFrame) -> DataFrame:
    return mapped(images, lambda r, a: [(r["id"], *R.domain_guard(a))], "id string, unique_ratio double, dominant_fraction double, likely_non_photographic boolean")


def ela(images: DataFrame, quality: int = 85) -> DataFrame:
    """(id, mean and 99th percentile of the differences, heat map as PNG)."""

    def one(r: dict, a: np.ndarray) -> list[tuple]:
        diff, heat = R.ela(a, quality)
        return [(r["id"], float(diff.mean()), float(np.percentile(diff, 99)), png.encode(heat))]

    return mapped(images, one, "id string, mean double, p99 double, heat binary")


def encoded(images: DataFrame, quality: int = 95) -> DataFrame:
    """(id, kb, content): each raster as a JPEG file, and its size."""

    def one(r: dict, a: np.ndarray) -> list[tuple]:
        data = jpegfile.encode(a, quality)
        return [(r["id"], len(data) / 1024, data)]

    return mapped(images, one, "id string, kb double, content binary")


def normalised(images: DataFrame, qualities: list[int], size: int = 512, seed: int = 0) -> DataFrame:
    """(id, label, status, crop_x, crop_y, first_gen_quality, height, width, data): data is null where rejected."""

    def one(r: dict, a: np.ndarray) -> list[tuple]:
        out, info = R.normalised(a, r["id"], r["label"] == 1, qualities, size=size, base_seed=seed)
        side = None if out is None else size
        return [(r["id"], r["label"], info["status"], info.get("crop_x"), info.get("crop_y"), info.get("first_gen_quality"), side, side, None if out is None else out.tobytes())]

    return mapped(images, one, "id string, label int, status string, crop_x int, crop_y int, first_gen_quality int, height int, width int, data binary")


#: Qualities that stand in where too few are measured.
BAKED_QUALITIES, LEAST_MEASURED = (75, 80, 85, 90, 92, 95), 100


def quality_prior(ledger: DataFrame) -> list[int]:
    """The measured qualities of real items' sources, if there are enough; one number for each of the 100 qualities
    and its count comes to the driver."""
    rows = ledger.filter("label = 0 AND src_jpeg_quality > 0").groupBy("src_jpeg_quality").agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    if total < LEAST_MEASURED:
        return list(BAKED_QUALITIES)
    # in proportion, at most some thousand entries
    return [r["src_jpeg_quality"] for r in sorted(rows, key=lambda r: r["src_jpeg_quality"]) for _ in range(max(1, round(1000 * r["n"] / total)))]


def decoded(files: DataFrame, min_side: int | None = None) -> DataFrame:
    """(path, status, height, width, data) of PNG files; undecodable ones stay, without data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                a, status = png.load(content, min_side)
                yield pa.RecordBatch.from_pydict(
                    {"path": [path], "status": [status], "height": [None if a is None else a.shape[0]], "width": [None if a is None else a.shape[1]], "data": [None if a is None else a.tobytes()]},
                    schema=pa.schema([("path", pa.string()), ("status", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]),
                )

    return files.select("path", "content").mapInArrow(run, "path string, status string, height int, width int, data binary")


#: Files that Spark's image source decodes, by the JVM's own readers.
JVM_GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[bB][mM][pP]}"


def decoded_folder(spark: SparkSession, folder: str, min_side: int | None = None) -> DataFrame:
    """(path, status, height, width, data) of all image files below a folder, upright by their orientation tag.

    PNG files are decoded here, JPEG and BMP files by the JVM; WebP files, and others that nothing decodes, stay with
    status failed and no data.
    """
    files = images_of(spark, folder)
    own = F.lower(F.substring_index("path", ".", -1)) == "png"
    theirs = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", JVM_GLOB).load(folder).select("image.*")

    def upright(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("status", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            for r in (x for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
                a, status = None, "failed"
                if r["data"] and (r["height"] or 0) > 0:
                    a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                    a = R.to_rgb(a if a.shape[2] == 1 else a[:, :, [2, 1, 0, *range(3, a.shape[2])]])  # blue comes first
                    a = R.oriented(a, png.exif_orientation(r["content"] or b"") or 1)
                    status = "too_small" if min_side is not None and min(a.shape[:2]) < min_side else png.shape(r["content"])[2] if r["content"] else "ok"
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "status": [status], "height": [None if a is None else a.shape[0]], "width": [None if a is None else a.shape[1]], "data": [None if a is None else a.tobytes()]}, schema=schema)

    # both name a file by the same address, but for the number of slashes
    key = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/*", "$1:/")
    # the orientation stands in the first 64 KB, the end of the file in its last bytes
    found = files.filter(~own).select("path", key("path").alias("_key"), "content")
    both = found.join(theirs.select(key("origin").alias("_key"), "height", "width", "nChannels", "data"), "_key", "left").drop("_key")
    rest = both.select("path", "content", "height", "width", "nChannels", "data").mapInArrow(upright, "path string, status string, height int, width int, data binary")
    return decoded(files.filter(own), min_side).unionByName(rest)


def images_of(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources import readers

    return readers.images(spark, folder)


def transformed(images: DataFrame, names: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(key, id, label, cell, png): each raster in each cell, lossless. The key is of the id and the chain, and of the seed
    if the chain draws random numbers."""
    from ..functions.hashing import config_hash
    from .cells import select_cells

    cells = select_cells(names)

    def one(row: dict, a: np.ndarray) -> list[tuple]:
        out = []
        for c in cells:
            drawn = {"seed": seed} if any(f in ("noise", "jitter") for f, _ in c.ops) else {}
            out.append((config_hash({"id": row["id"], "chain": c.chain} | drawn), row["id"], row["label"], c.name, png.encode(R.degraded(a, row["id"], c.name, c.ops, seed))))
        return out

    return mapped(images, one, "key string, id string, label int, cell string, png binary")


def cache_transformed(images: DataFrame, path: str, names: list[str] | None = None, seed: int = 0) -> DataFrame:
    """The cache at path, with what it lacks of transformed() added; what it has isn't made again."""
    spark = images.sparkSession
    schema = "key string, id string, label int, cell string, png binary"
    try:
        there = spark.read.schema(schema).parquet(path).select("id", "cell").distinct()
    except Exception as e:  # Spark tells a missing path by an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = spark.createDataFrame([], "id string, cell string")
    from .cells import select_cells

    wanted = [c.name for c in select_cells(names)]
    full = there.filter(F.col("cell").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= len(wanted)).select("id")
    fresh = transformed(images.join(full, "id", "left_anti"), names, seed).join(there, ["id", "cell"], "left_anti").select("key", "id", "label", "cell", "png")
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).filter(F.col("cell").isin(wanted))


PROBE = "n_bytes bigint, status string, width int, height int, n_text_chunks int, metadata_keys string, generator_marker string, has_exif boolean, has_icc boolean, exif_orientation int, jpeg_quality int"


def probes(files: DataFrame) -> DataFrame:
    """path and what each file tells about itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png.probe(x) for x in batch.column("content").to_pylist()]
            kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
            cols = [(n, kinds[t]) for n, t in (x.split(" ") for x in PROBE.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([f[n] for f in found], t) for n, t in cols)], ["path", *(n for n, _ in cols)])

    return files.select("path", "content").mapInArrow(run, f"path string, {PROBE}")
