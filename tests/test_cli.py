from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.functions import jpegfile, rasters
from corpusloom.operators import audit, images, metrics
from corpusloom.sources import png, readers, sinks


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "img").mkdir()
    lines = ["image_path,label,generator,source_dataset,split"]
    for i in range(8):
        (tmp_path / "img" / f"{i}.png").write_bytes(png.encode(rasters.synthetic_raster(i, 32, 60.0 * (i % 2))))
        lines.append(f"img/{i}.png,{i % 2},g{i % 2},s,test")
    (tmp_path / "img" / "bad.png").write_bytes(b"none")
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_evaluate_writes_reports(spark, folder):
    cli.main(["evaluate", "--manifest", str(folder / "m.csv"), "--images", str(folder / "img"), "--split", "test", "--model", "brightness", "--cells", "clean", "jpeg", "--out", str(folder / "out")])
    grid = (folder / "out" / "grid.csv").read_text().splitlines()
    assert len(grid) == 6 and grid[0].startswith("cell,kind,family,n,")
    s = json.loads((folder / "out" / "summary.json").read_text())["summary"]
    assert s["clean"] > 0.9 and s["n_families"] == 1
    assert "| clean |" in (folder / "out" / "report.md").read_text()
    assert spark.read.parquet(str(folder / "out" / "scores.parquet")).count() == 8 * 5
    with pytest.raises(ValueError):
        cli.main(["evaluate", "--cells", "nothing", "--out", "x"])


def jpeg_folder(tmp_path):
    """Equal names in two folders, JPEG and PNG files, one file that nothing decodes, one that is missing."""
    lines = ["image_path,label,generator,source_dataset,split"]
    for i in range(12):
        d = tmp_path / "img" / "ab"[i % 2]
        d.mkdir(parents=True, exist_ok=True)
        raster = rasters.synthetic_raster(i, 48, 70.0 * (i % 2))
        name = f"{i // 2}.{'jpg' if i % 4 < 2 else 'png'}"
        (d / name).write_bytes(jpegfile.encode(raster, 95) if name.endswith("jpg") else png.encode(raster))
        lines.append(f"{'ab'[i % 2]}/{name},{i % 2},g{i % 2},s,test")
    (tmp_path / "img" / "a" / "broken.jpg").write_bytes(b"\xff\xd8 nothing")
    lines += ["a/broken.jpg,0,g0,s,test", "b/missing.png,1,g1,s,test"]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_jpeg_folder_with_equal_names(spark, tmp_path):
    d = jpeg_folder(tmp_path)
    found = {r["path"].rpartition("/img/")[2]: r for r in images.decoded_folder(spark, str(d / "img")).collect()}
    assert len(found) == 13 and found["a/broken.jpg"]["status"] == "failed" and found["a/broken.jpg"]["data"] is None
    for i in range(12):
        r = found[f"{'ab'[i % 2]}/{i // 2}.{'jpg' if i % 4 < 2 else 'png'}"]
        a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
        assert r["status"] == "ok" and np.abs(a.astype(int) - rasters.synthetic_raster(i, 48, 70.0 * (i % 2))).mean() < 6
    cli.main(["evaluate", "--manifest", str(d / "m.csv"), "--images", str(d / "img"), "--model", "brightness", "--cells", "clean", "blur_0.5", "--out", str(d / "out")])
    rows = spark.read.parquet(str(d / "out" / "scores.parquet"))
    assert rows.count() == 2 * 14 and rows.filter("score IS NULL").count() == 2 * 2
    grid = [dict(zip((d / "out" / "grid.csv").read_text().splitlines()[0].split(","), x.split(","))) for x in (d / "out" / "grid.csv").read_text().splitlines()[1:]]
    assert all(g["n_failed"] == "2" and float(g["auroc"]) > 0.9 for g in grid)


def test_orientation_is_applied(spark, tmp_path):
    raster = np.zeros((24, 40, 3), np.uint8)
    raster[:, :20] = 200
    tag = b"Exif\0\0" + b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    data = jpegfile.encode(raster, 95)
    (tmp_path / "x.jpg").write_bytes(data[:2] + b"\xff\xe1" + (len(tag) + 2).to_bytes(2, "big") + tag + data[2:])
    r = images.decoded_folder(spark, str(tmp_path)).first()
    a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
    assert a.shape == (40, 24, 3) and a[5].mean() > 150 > 50 > a[35].mean()
    p = images.probes(readers.images(spark, str(tmp_path))).first()
    assert (p["width"], p["height"], p["status"], p["exif_orientation"], p["has_exif"]) == (40, 24, "ok", 6, True)


def test_reports(spark, tmp_path, capsys):
    d = jpeg_folder(tmp_path)
    args = ["audit", "--manifest", str(d / "m.csv"), "--images", str(d / "img"), "--out", str(d / "audit"), "--cache", str(d / "probes")]
    cli.main(args)
    first = (d / "audit" / "report.md").read_text()
    cli.main(args)  # from the cache
    assert (d / "audit" / "report.md").read_text() == first and "Mean features by class" in first and "| width |" in first
    per_image = spark.read.option("header", "true").csv(str(d / "audit" / "per_image.csv"))
    assert per_image.count() == 13 and "phash" not in per_image.columns and {r["width"] for r in per_image.collect()} == {"48", "0"}
    cli.main(["stats", "--rows", str(d / "m.csv"), "--out", str(d / "stats.md")])
    assert "Rows by split and label" in (d / "stats.md").read_text()
    runs = images.grid_scores(images.synthetic(spark, 60, 32, 40.0), "brightness", names=["clean", "jpeg"]).withColumn("generator", F.when(F.col("label") == 1, "g").otherwise("real"))
    runs.write.parquet(str(d / "run"))
    cli.main(["gap", "--scores", str(d / "run"), "--replicates", "9", "--out", str(d / "gap"), "--label", "Run A: 1"])
    table = (d / "gap" / "run_a_1_cells.csv").read_text().splitlines()
    assert table[0] == "cell,family,tpr1,tpr1_ci_lo,tpr1_ci_hi,tpr5,tpr5_ci_lo,tpr5_ci_hi" and len(table) == 6
    assert (d / "gap" / "run_a_1_generators.csv").exists() and (d / "gap" / "run_a_1_report.md").exists()
    capsys.readouterr()
    cli.main(["stress", "--first", str(d / "run"), "--second", str(d / "run")])
    assert capsys.readouterr().out.count("jpeg_") == 4


def test_probe_report(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i % 2), f"g{i % 3}" if i % 2 else "real", float(rng.normal(i % 2, 1)), float(rng.normal(0, 5))) for i in range(400)]
    spark.createDataFrame(rows, "label int, generator string, a double, b double").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("g0", 0.9), ("g1", 0.8), ("g2", 0.7)], "generator string, auroc double").write.parquet(str(tmp_path / "h"))
    cli.main(["probe", "--train", str(tmp_path / "t"), "--test", str(tmp_path / "t"), "--features", "a", "b", "--head", str(tmp_path / "h"), "--out", str(tmp_path / "p")])
    found = json.loads((tmp_path / "p" / "probe.json").read_text())
    assert 0.7 < found["auroc"] < 0.85 and abs(found["weights"][0]) > 5 * abs(found["weights"][1]) and found["spearman_n"] == 3
    page = (tmp_path / "p" / "probe.md").read_text()
    aurocs = [float(x.split("|")[2]) for x in page.splitlines() if x.startswith(("| g0", "| g1", "| g2"))]
    assert len(aurocs) == 3 and aurocs == sorted(aurocs, reverse=True)
    # Student's distribution: r = 0.5 of 27 pairs has t = 2.8868 with 25 degrees of freedom
    assert audit.correlation_p(0.5, 27) == pytest.approx(0.00790, abs=1e-4) and audit.correlation_p(-0.143, 7) == pytest.approx(0.760, abs=1e-3) and audit.correlation_p(0.1, 2) is None


def test_transform_cache_and_sampled_files(spark, tmp_path):
    d = jpeg_folder(tmp_path)
    args = ["cache", "--manifest", str(d / "m.csv"), "--images", str(d / "img"), "--out", str(d / "cache"), "--cells"]
    cli.main([*args, "clean", "noise_0.05"])
    one = {r["key"]: bytes(r["png"]) for r in spark.read.parquet(str(d / "cache")).collect()}
    cli.main([*args, "clean", "noise_0.05", "blur_0.5"])
    two = {r["key"]: bytes(r["png"]) for r in spark.read.parquet(str(d / "cache")).collect()}
    assert len(one) == 24 and len(two) == 36 and spark.read.parquet(str(d / "cache")).count() == 36 and one.items() <= two.items()
    assert png.decode(next(iter(one.values())))[0].shape == (48, 48, 3)
    cli.main(["sample-bytes", str(d / "img"), "--n", "6", "--out", str(d / "sample")])
    got = spark.read.parquet(str(d / "sample")).collect()
    assert 6 <= len(got) <= 8 and all((r["path"].rpartition("/")[0] == r["folder"]) and bytes(r["content"]) == open(r["path"].removeprefix("file:"), "rb").read() for r in got)


def test_predict_keeps_failures_in_order(spark, folder):
    cli.main(["predict", str(folder / "img"), "--out", str(folder / "p")])
    rows = [json.loads(x) for f in sorted((folder / "p").glob("*.json")) for x in f.read_text().splitlines()]
    assert [r["image_path"].rpartition("/")[2] for r in rows] == [*(f"{i}.png" for i in range(8)), "bad.png"]
    assert rows[-1]["pred"] is None and all(0 <= r["pred"] <= 1 for r in rows[:-1])


def test_split_command(spark, folder):
    hashes = images.hashes(images.synthetic(spark, 30, 32)).withColumnsRenamed({"id": "image_path"})
    ledger = hashes.withColumns({"src_sha256": F.sha2("image_path", 256), "label": (F.xxhash64("image_path") % 2 == 0).cast("int"), "generator": F.lit("SDXL")})
    ledger.write.parquet(str(folder / "ledger"))
    cli.main(["split", "--ledger", str(folder / "ledger"), "--blocklist", str(folder / "none.json"), "--out", str(folder / "splits")])
    got = spark.read.parquet(str(folder / "splits"))
    assert got.count() == 30 and {r["split"] for r in got.select("split").distinct().collect()} == {"train", "val", "test"}


def test_train_command(spark, folder):
    rng = np.random.default_rng(0)
    rows = [(str(i), i % 2, [float(x) for x in rng.normal(i % 2, 0.4, 4)]) for i in range(80)]
    spark.createDataFrame(rows, "id string, label int, features array<double>").write.parquet(str(folder / "f"))
    cli.main(["train", "--features", str(folder / "f"), "--validation", str(folder / "f"), "--out", str(folder / "head.json")])
    head = json.loads((folder / "head.json").read_text())
    assert head["embed_dim"] == 4 and head["validation_auroc"] > 0.95


def test_other_commands_parse_and_run(spark, folder, capsys):
    cli.main(["footprint"])
    assert "MidJourney" in capsys.readouterr().out
    cli.main(["query", "grid_cells", "/root/testdata/sf0.001"])
    assert "composed_blur1.0+jpeg70" in capsys.readouterr().out
    cli.main(["audit", "--manifest", str(folder / "m.csv"), "--images", str(folder / "img")])
    assert "n_bytes" in capsys.readouterr().out
    images.grid_scores(images.synthetic(spark, 40, 32), "brightness", names=["clean", "jpeg_30", "blur_0.5"]).write.parquet(str(folder / "s"))
    cli.main(["gap", "--scores", str(folder / "s"), "--replicates", "5"])
    assert "zero" in capsys.readouterr().out


def test_sinks(spark, folder):
    df = spark.createDataFrame([("a", None, 0.25)], "x string, y double, z double")
    assert sinks.markdown(df).splitlines()[-1] == "| a | — | 0.2500 |" and sinks.slug("Run A: 1/2") == "run_a_1_2"
    rec = sinks.blocklist_record(spark.createDataFrame([("b",), ("a",)], "sha string"), spark.createDataFrame([(2**32 - 1, 2**32 - 1), (1, 0)], "hi long, lo long"), ["s"], [])
    r = rec.first()
    assert r["sha256"] == ["a", "b"] and set(r["phash"]) == {"18446744073709551615", "4294967296"} and r["n_phash"] == 2
    rec.coalesce(1).write.json(str(folder / "bl"))
    sha, hashes, gaps = readers.blocklist(spark, str(folder / "bl"))
    assert sha.count() == 2 and sorted(map(tuple, hashes.collect())) == [(1, 0), (2**32 - 1, 2**32 - 1)] and gaps == []
    assert spark.sql("SELECT X'41' AS b").select(sinks.data_url(F.col("b")).alias("u")).first()["u"] == "data:image/png;base64,QQ=="
    assert metrics.minimum_negatives(0.01) == 100
