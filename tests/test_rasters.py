from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from corpusloom.functions import jpegfile
from corpusloom.functions import rasters as R
from corpusloom.operators import cells, images, metrics
from corpusloom.sources import png


@pytest.fixture
def photo():
    return R.quantised(R.synthetic_raster(3, 96).astype(float) + np.random.default_rng(0).normal(0, 6, (96, 96, 3)))


def test_every_cell_keeps_size_and_repeats(photo):
    for c in cells.grid():
        out = R.degraded(photo, "x", c.name, c.ops)
        assert out.shape == photo.shape and out.dtype == np.uint8
        assert (out == R.degraded(photo, "x", c.name, c.ops)).all()
    assert (R.degraded(photo, "x", "clean", ()) == photo).all()
    noisy = cells.select_cells(["noise_0.1"])[0]
    assert (R.degraded(photo, "x", noisy.name, noisy.ops) != R.degraded(photo, "y", noisy.name, noisy.ops)).any()


def test_stronger_is_further(photo):
    far = lambda a: float(np.abs(a.astype(float) - photo).mean())
    assert far(R.jpeg(photo, 90)) < far(R.jpeg(photo, 50)) < far(R.jpeg(photo, 10))
    assert 0 == far(R.blur(photo, 0)) < far(R.blur(photo, 0.5)) < far(R.blur(photo, 2))
    assert far(R.down_up(photo, 0.5)) < far(R.down_up(photo, 0.25))
    rng = lambda: np.random.default_rng(0)
    grey = np.full((64, 64, 3), 128, np.uint8)
    assert abs(R.noise(grey, 0.05, rng()).astype(float).std() / 255 - 0.05) < 0.004
    assert far(R.jitter(photo, 0.0, rng())) < 0.5
    assert R.center_crop(photo, 1.0).shape == photo.shape and far(R.center_crop(photo, 1.0)) == 0


def test_modes():
    g = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert (R.to_rgb(g)[..., 1] == g).all()
    rgba = np.dstack([np.full((2, 2, 3), 200, np.uint8), np.array([[0, 255], [0, 255]], np.uint8)])
    assert R.to_rgb(rgba)[:, 0].max() == 0 and R.to_rgb(rgba)[:, 1].min() == 200
    assert R.to_rgb(np.array([[0, 40000]], np.uint16)).max() == 255
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (R.oriented(R.oriented(a, 6), 8) == a).all() and R.oriented(a, 6).shape == (4, 2, 3)


def test_phash_is_robust_and_tells_apart(photo):
    d = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert d(R.phash(photo), R.phash(R.jpeg(photo, 60))) <= 6
    assert d(R.phash(photo), R.phash(R.quantised(R.resized(photo, 48, 48)))) <= 6
    assert d(R.phash(photo), R.phash(R.synthetic_raster(9, 96))) > 6


def test_features_and_guard(photo):
    f = R.frequency_features(photo)
    assert f.shape == (19,) == (len(R.FREQUENCY_NAMES),) and np.isfinite(f).all()
    assert R.frequency_features(R.blur(photo, 2))[16] < f[16]  # less energy up there
    flat = np.zeros((64, 64, 3), np.uint8)
    assert R.domain_guard(flat)[2] and R.constant_rows(flat) == 1 and R.constant_rows(photo) == 0
    assert not R.domain_guard(R.quantised(np.random.default_rng(1).uniform(0, 255, (64, 64, 3))))[2]
    c = R.content_features(flat)
    assert c["pure_bw_frac"] == 1 and c["flat_frac"] == 1 and c["aspect"] == 1
    diff, heat = R.ela(photo)
    assert diff.shape == photo.shape[:2] and heat.shape == photo.shape


def test_augmentation_plans():
    plans = [R.sample_plan("x", k) for k in range(400)]
    assert plans == [R.sample_plan("x", k) for k in range(400)]
    assert 0.1 < sum(not p for p in plans) / 400 < 0.3
    for p in plans:
        assert len(p) <= 3 and len({f for f, _ in p}) == len(p)
        for f, s in p:
            lo, hi = R.RANGES[f]
            assert lo <= s <= hi
        v = R.plan_vector(p)
        assert len(v) == 12 and all(0 <= x <= 1 for x in v) and sum(v[:6]) == len(p)
    with pytest.raises(ValueError):
        R.sample_plan("x", 0, p=2)


def test_normalised_hangs_on_label_by_first_generation_only():
    a = R.synthetic_raster(1, 96)
    out, info = R.normalised(a, "x", False, [50], size=64)
    assert out.shape == (64, 64, 3) and info["crop_x"] % 16 == 0 and info["first_gen_quality"] == 0
    assert R.normalised(a, "x", True, [50], size=64)[1]["first_gen_quality"] == 50
    assert R.normalised(a, "x", True, [50], size=128)[0] is None
    crop, drawn = R.random_resample(a, "x", 32)
    assert crop.shape == (32, 32, 3) and drawn == R.random_resample(a, "x", 32)[1]


def test_png_round_trips_texts_and_cuts(photo):
    data = png.encode(photo, {"parameters": "Steps: 20, made with ComfyUI", "Author": "me"})
    back, status = png.load(data)
    assert status == "ok" and (back == photo).all()
    p = png.probe(data)
    assert (p["n_text_chunks"], p["metadata_keys"], p["generator_marker"], p["width"]) == (2, "parameters", "comfyui", 96)
    assert png.load(data[: len(data) * 3 // 4])[1] == "recovered_truncated"
    assert png.load(data[: len(data) // 6])[1] in ("mostly_padding", "failed")
    assert png.load(b"nothing") == (None, "failed") and png.load(None) == (None, "failed")
    assert png.load(data, 200)[1] == "too_small"


def test_png_filters_are_undone():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (5, 7, 3)).astype(np.int64)
    up = np.vstack([np.zeros((1, 7, 3), np.int64), a[:-1]])
    left = np.concatenate([np.zeros((5, 1, 3), np.int64), a[:, :-1]], axis=1)
    corner = np.concatenate([np.zeros((5, 1, 3), np.int64), up[:, :-1]], axis=1)
    p = left + up - corner
    paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
    guesses = [np.zeros_like(a), left, up, (left + up) // 2, paeth]
    raw = b"".join(bytes([k]) + ((a[k] - guesses[k][k]) & 255).astype(np.uint8).tobytes() for k in range(5))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    got, status = png.decode(data)
    assert status == "ok" and (got == a).all()


@pytest.mark.parametrize("quality", [30, 75, 95])
def test_jpeg_quality_and_orientation(quality):
    table = R.quant_table(R.LUMA, quality).ravel()
    dqt = b"\xff\xdb" + struct.pack(">H", 67) + b"\0" + bytes(int(table[k]) for k in png.ZIGZAG)
    tiff = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHII", 274, 3, 1, 6) + b"\0\0\0\0"
    exif = b"Exif\0\0" + tiff
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + dqt + b"\xff\xda"
    assert png.jpeg_quality(data) == quality and png.exif_orientation(data) == 6 and png.probe(data)["has_exif"]


def test_null_scorer_says_nothing_anywhere(spark):
    s = images.grid_scores(images.synthetic(spark, 120, 32, partitions=4), names=["clean", "noise", "jpeg_30"])
    rows = metrics.cell_metrics(s, ["cell"]).collect()
    assert len(rows) == 5
    for r in rows:
        assert abs(r["auroc"] - 0.5) < 4.5 * ((121 / (12 * 60 * 60)) ** 0.5)
    again = images.grid_scores(images.synthetic(spark, 120, 32, partitions=7), names=["clean", "noise", "jpeg_30"])
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect()))


def test_planted_brightness_is_found(spark):
    s = images.grid_scores(images.synthetic(spark, 40, 32, lift=60), "brightness", names=["clean"])
    assert metrics.cell_metrics(s, ["cell"]).first()["auroc"] > 0.95


def test_quality_prior(spark):
    few = spark.createDataFrame([(0, 80)] * 5, "label int, src_jpeg_quality int")
    assert images.quality_prior(few) == list(images.BAKED_QUALITIES)
    many = spark.createDataFrame([(0, 80)] * 75 + [(0, 90)] * 25 + [(1, 30)] * 50, "label int, src_jpeg_quality int")
    got = images.quality_prior(many)
    assert set(got) == {80, 90} and got.count(80) == 3 * got.count(90)


@pytest.mark.parametrize("subsample", [True, False])
@pytest.mark.parametrize("quality", [20, 75, 95])
def test_jpeg_files_are_read_by_others(spark, tmp_path, photo, quality, subsample):
    a = photo[:70, :90]
    data = jpegfile.encode(a, quality, subsample)
    (tmp_path / "x.jpg").write_bytes(data)
    row = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    back = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)[:, :, ::-1]
    assert back.shape == a.shape and np.abs(back.astype(float) - R.jpeg(a, quality, subsample)).mean() < (4 if subsample else 1.5)
    assert png.jpeg_quality(data) == quality
    assert len(data) < len(jpegfile.encode(a, 100, subsample))


def test_code_lengths_are_a_code():
    from collections import Counter

    for counts in (Counter({1: 5}), Counter({k: 2**k for k in range(24)}), Counter({k: 1 for k in range(162)})):
        n = jpegfile.code_lengths(counts)
        assert set(n) == set(counts) and max(n.values()) <= 16 and sum(2.0**-x for x in n.values()) < 1
        own = list(jpegfile.codes(n).values())
        assert len(set(own)) == len(own) and all(code < (1 << m) - 1 or m < max(x for _, x in own) for code, m in own)


def test_encoded_sizes(spark):
    rows = images.encoded(images.synthetic(spark, 3, 32), 90).collect()
    assert all(r["kb"] == len(r["content"]) / 1024 and bytes(r["content"]).startswith(b"\xff\xd8") for r in rows)
