from __future__ import annotations

import random
import time
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hashing, rasters, sql
from corpusloom.operators import audit, dedup, images, ingest, metrics, scoring, splits, storage
from corpusloom.operators.components import components
from corpusloom.operators.storage import save
from corpusloom.plans import registry
from corpusloom.sources import catalog, png, readers
from corpusloom.streaming.ingest import ingest_stream, windowed_counts

DATA = Path("/root/testdata/sf0.001")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def planted_hashes(n=300, seed=0):
    rng = random.Random(seed)
    hs = [rng.getrandbits(64) for _ in range(n)]
    for k in range(20):
        h = hs[k]
        for bit in rng.sample(range(64), k % 7):
            h ^= 1 << bit
        hs.append(h)
    return hs


def test_banded_pairs_equal_brute_force(spark):
    hs = planted_hashes()
    df = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hs)], "key long, h long").select("key", *dedup.halves(F.col("h")))
    d = dedup.distinct_hashes(df, "key")
    got = {tuple(r) for r in dedup.near_pairs(d).collect()}
    assert got == {tuple(r) for r in dedup.near_pairs_brute(d).collect()}
    names = {}
    for i, h in enumerate(hs):
        names.setdefault(h, i)
    assert got == {(min(a, b), max(a, b), bin(g ^ h).count("1")) for g, a in names.items() for h, b in names.items() if a < b and bin(g ^ h).count("1") <= 6}
    for n in (10, 10**5, 10**7, 10**9, 10**11):  # each scheme's masks find every pair, whatever makes it the cheapest
        for threshold in (3, 6, 8):
            masks = dedup.scheme(n, n, threshold)
            assert all(any((g ^ h) & m == 0 for m in masks) for g in hs[:40] for h in hs[:40] if bin(g ^ h).count("1") <= threshold)
            assert n < 10**7 or bin(masks[0]).count("1") >= 12
    far = {tuple(r) for r in dedup.near_pairs(d, 8).collect()}
    assert far == {tuple(r) for r in dedup.near_pairs_brute(d, 8).collect()} and far >= got


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyed_hashes_stay_off_the_driver(spark):
    """A few hashes are small enough to broadcast by their files; what their keys make of them is not."""
    d = spark.createDataFrame([(i, i, i) for i in range(100)], "id long, hi long, lo long")
    assert "Broadcast" not in plan(dedup.near_pairs(d))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_distances_keep_keys_off_the_driver(spark):
    assert "Broadcast" not in plan(registry.QUERIES["near_dup_distances"](spark, str(DATA)))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["dup_components", "split_assignment", "split_contingency", "split_violations"])
def test_queries_on_clusters_keep_keys_off_the_driver(spark, monkeypatch, name):
    plans = []
    monkeypatch.setattr(dedup, "components", lambda links: plans.append(plan(links)) or components(links))
    assert registry.QUERIES[name](spark, str(DATA)).count()
    assert plans and "Broadcast" not in "".join(plans)


def test_named_hashes_are_broadcast_by_their_number(spark, monkeypatch):
    """Hashes in small files were broadcast, however many rows they hold."""
    d = spark.createDataFrame([(i, i, i // 2) for i in range(100)], "id long, hi long, lo long")
    few = dedup.clusters(d, "id")
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 99, raising=False)
    many = dedup.clusters(d, "id")
    assert "Broadcast" not in plan(many)
    assert sorted(many.collect()) == sorted(few.collect())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_labels_are_broadcast_by_their_number(spark, monkeypatch):
    few = registry.corpus_queries.split_rows(spark, str(DATA))
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 9, raising=False)
    many = registry.corpus_queries.split_rows(spark, str(DATA))
    labels = [x for x in plan(many).split("BroadcastExchange")[1:] if "labels.parquet" in x.split("Join")[0]]
    assert not labels
    assert sorted(many.collect()) == sorted(few.collect())


def test_dealt_clusters_are_broadcast_by_their_number(spark, monkeypatch):
    """Spark took every cluster's split, and the sums of their ranges, to the driver by what a shuffle held compressed."""
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("id div 2").alias("cluster"), (F.col("id") % 3).alias("label"), F.concat(F.lit("g"), F.col("id") % 4).alias("generator"), (F.col("id") % 7 == 0).alias("toxic"))
    told = lambda: splits.assign(rows, key="doc_id", holdout=F.col("generator") == "g3", blocked=F.col("toxic"))
    few = told()
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 29)  # of 30 clusters
    many = told()
    assert "Broadcast" in plan(few) and "Broadcast" not in plan(many)
    assert sorted(many.collect()) == sorted(few.collect()) and many.count() == 60
    assert sorted(splits.contingency(many, "generator").collect()) == sorted(splits.contingency(few, "generator").collect())


def test_violations_make_the_split_once(spark):
    rows = spark.range(4).select(F.col("id").alias("doc_id"), F.expr("id div 2").alias("cluster"), (F.col("id") % 2).alias("label"), F.lit("train").alias("split"))
    told = splits.violations(rows, "doc_id")
    assert "Range" not in plan(told)
    assert {tuple(r) for r in told.collect()} == {("row in several splits", 0), ("cluster straddles splits", 0), ("row without a split", 0), ("empty splits", 2), ("labels out of balance", 0)}


def test_pairs_are_made_once_for_their_classes(spark):
    d = spark.createDataFrame([(i, 0, 1 << i) for i in range(5)], "id long, hi long, lo long")
    told = dedup.pair_classes(dedup.near_pairs(d), d.select("id", (F.col("id") % 2).alias("klass")))
    assert "mask" not in plan(told)
    assert tuple(told.first()) == (4, 6, "2 0 1; 2 0 3; 2 1 2; 2 1 4; 2 2 3")


def test_components_close_over_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocklist_exact_before_fuzzy(spark):
    rows = spark.createDataFrame([(1, "x", 5, 7), (2, "y", 5, 6), (3, "z", 2**31, 2**30)], "key long, sha string, hi long, lo long")
    hits = dedup.block_hits(rows, "key", spark.createDataFrame([("x",)], "sha string"), spark.createDataFrame([(5, 7)], "hi long, lo long"))
    assert sorted(map(tuple, hits.collect())) == [(1, "sha256"), (2, "hamming 1")]


def test_blocklist_file(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"sha256": ["aa"], "phash": ["18446744073709551615", "4294967296"], "sources": [], "gaps": ["one"]}')
    sha, hashes, gaps = readers.blocklist(spark, str(tmp_path / "b.json"))
    assert [r["sha"] for r in sha.collect()] == ["aa"] and gaps == ["one"]
    assert sorted(map(tuple, hashes.collect())) == [(1, 0), (2**32 - 1, 2**32 - 1)]
    sha, hashes, gaps = readers.blocklist(spark, str(tmp_path / "none.json"))
    assert sha.count() == hashes.count() == 0 and len(gaps) == 1


def corpus(spark):
    rows = [(i, i % 2, f"g{i % 5}", i - i % 3) for i in range(300)]
    return spark.createDataFrame(rows, "key long, label int, generator string, cluster long")


def test_split_promises(spark):
    rows = corpus(spark)
    held, bad = F.col("generator") == "g4", F.col("key") % 50 == 0
    got = splits.assign(rows, key="key", holdout=held, blocked=bad)
    assert {r["split"] for r in got.filter("generator = 'g4'").collect()} == {"test"}
    assert got.filter((F.col("key") % 50 == 0) & (F.col("split") == "train")).count() == 0
    strict = splits.assign(rows, key="key", holdout=held, blocked=bad, strict=True)
    n = {r["rule"]: r["n"] for r in splits.violations(strict, "key").collect()}
    assert n["cluster straddles splits"] == n["row in several splits"] == n["row without a split"] == 0
    assert {r["rule"]: r["n"] for r in splits.violations(got, "key").collect()}["cluster straddles splits"] > 0  # as documented
    again = splits.assign(rows.repartition(7), key="key", holdout=held, blocked=bad)
    assert sorted(got.collect()) == sorted(again.collect())
    assert sorted(got.collect()) != sorted(splits.assign(rows, key="key", holdout=held, blocked=bad, seed=9).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 13, 100])
def test_quotas_sum(spark, n):
    q = spark.range(1).select(*splits.quotas(F.lit(n))).first()
    assert sum(q) == n and all(abs(x - n * s) < 1 for x, s in zip(q, splits.SHARES))


def test_ingest_reasons_dedupe_quota(spark):
    rows = spark.createDataFrame([(1, "s", "aaaa"), (2, "s", "aaaa"), (3, "s", "bb"), (4, "s", None), (5, "t", "cccc"), (6, "s", "dddd"), (7, "s", "eeee")], "key long, source string, text string")
    rules = [("no_bytes", F.col("text").isNull()), ("too_small", F.length("text") < 4)]
    ok, n = ingest.ingest(rows, None, key="key", source="source", rules=rules, quota=F.lit(2), order=F.col("key"))
    assert sorted(r["key"] for r in ok.collect()) == [1, 5, 6]
    assert {(r["source"], r["reason"]): r["n"] for r in n.collect()} == {("s", "accepted"): 4, ("s", "no_bytes"): 1, ("s", "too_small"): 1, ("t", "accepted"): 1}
    ok2, _ = ingest.ingest(rows, ok, key="key", source="source", rules=rules, quota=F.lit(2), order=F.col("key"))
    assert [r["key"] for r in ok2.collect()] == [7]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = [(i, f"text {i % 30}") for i in range(100)]
    df = spark.createDataFrame(rows, "key long, text string")
    df.limit(60).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    args = dict(source=str(tmp_path / "in" / "*"), schema=df.schema, ledger=str(tmp_path / "ledger"), checkpoint=str(tmp_path / "ck"), key="key")
    ingest_stream(spark, **args).awaitTermination()
    df.filter("key >= 20").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    ingest_stream(spark, **args).awaitTermination()
    got = [r["sha"] for r in spark.read.parquet(str(tmp_path / "ledger")).collect()]
    want = {r["sha"] for r in ingest.with_hash(df).select("sha").distinct().collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_windows(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 3.0D")
    assert [(r["n"], r["value"]) for r in windowed_counts(df).collect()] == [(2, 5.0)]


def test_planted_leak_is_found_and_constant_is_not(spark):
    rows = spark.createDataFrame([(i % 2, float(i % 2), 1.0, float((i * 7919) % 101)) for i in range(200)], "label int, leak double, flat double, noise double")
    got = {r["feature"]: r["leak"] for r in audit.leak_auroc(audit.long_features(rows, ("leak", "flat", "noise"), ["label"]), []).collect()}
    assert got["leak"] == 1.0 and got["flat"] == 0.5 and got["noise"] < 0.6
    tiny = audit.long_features(rows.limit(3), ("leak",), ["label"])
    assert audit.leak_auroc(tiny, []).first()["leak"] is None


def test_containers_and_paths(spark):
    heads = {"jpeg": b"\xff\xd8\xff\xe0", "png": png.SIGNATURE, "gif": b"GIF89a", "bmp": b"BM12", "webp": b"RIFF1234WEBPVP8 ", "unknown": b"RIFF1234WAVE", "tiff": b"II*\0"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "want string, content binary")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", audit.container(F.col("content"))).collect())
    r = spark.createDataFrame([("a/b/c/Gen/x.JPG",), ("x",)], "p string").select(audit.segment(F.col("p"), 3).alias("s"), audit.extension(F.col("p")).alias("e")).collect()
    assert [tuple(x) for x in r] == [("Gen", "jpg"), (None, "x")]


def test_rank_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, 1.0)], "x double, y double")
    rx, ry = [1, 2, 3, 4], [2.5, 2.5, 4, 1]
    assert audit.rank_correlation(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    assert audit.rank_correlation(df.limit(2), "x", "y").first()["rho"] is None


def test_heads(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = df.select(scoring.l2_normalised(F.col("v")).alias("n"), scoring.linear_head(F.col("v"), [1.0, -1.0], 1.0).alias("s")).collect()
    assert got[0]["n"] == pytest.approx([0.6, 0.8]) and got[1]["n"] is None and got[0]["s"] == pytest.approx(0.5)
    with pytest.raises(Exception, match="takes vectors of 3"):
        df.select(scoring.linear_head(F.col("v"), [1.0, 2.0, 3.0], 0.0)).collect()


def test_scorer_registry(spark):
    @scoring.register("half")
    class Half:
        def __init__(self, bias=0.0):
            self.bias = bias

        def score(self, batch):
            return batch.str.len() * 0 + 0.5 + self.bias

    df = spark.createDataFrame([("a",), (None,)], "t string")
    rows = scoring.score_with(df, "t", scoring.load("half", bias=0.25, unknown=3)).collect()
    assert [r["score"] for r in rows] == [0.75, None]
    with pytest.raises(Exception, match=r"\[0, 1\]"):
        scoring.score_with(df, "t", scoring.load("half", bias=2.0)).collect()
    with pytest.raises(KeyError):
        scoring.load("none")


def test_footprint_and_views(spark):
    reg = catalog.registry(spark)
    assert reg.count() == 10 and catalog.held_out(reg).count() == 3 and catalog.trainable(reg).count() == 7
    assert catalog.footprint_total(catalog.footprint(reg)).first()["n_items"] == 18200
    assert [r["name"] for r in catalog.denied(reg, "name", ["FLICKR"]).collect()] == ["Megalith-Flickr"]


def test_readers(spark, tmp_path):
    a = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.PNG").write_bytes(png.encode(a))
    (tmp_path / "img" / "note.txt").write_text("no")
    (tmp_path / "img" / "bad.jpg").write_bytes(b"no image")
    files = readers.images(spark, str(tmp_path / "img"))
    got = {r["path"].rpartition("/")[2]: r for r in images.decoded(files).collect()}
    assert set(got) == {"x.PNG", "bad.jpg"} and got["bad.jpg"]["status"] == "failed" and bytes(got["x.PNG"]["data"]) == a.tobytes()
    assert images.decoded(files, 8).filter("status = 'too_small'").count() == 1
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.png", png.encode(a))
        z.writestr("readme.md", "x")
    assert [r["name"] for r in readers.zip_members(spark, str(tmp_path)).collect()] == ["d/x.png"]
    (tmp_path / "m.csv").write_text("image_path,label,generator,source_dataset,split\np,1,g,s,test\nq,0,g,s,train\n")
    assert [r["image_path"] for r in readers.manifest(spark, str(tmp_path / "m.csv"), "test").collect()] == ["p"]
    (tmp_path / "bad.csv").write_text("image_path,label,generator,source_dataset,split\np,7,g,s,test\n")
    with pytest.raises(Exception, match="label must be 0 or 1"):
        readers.manifest(spark, str(tmp_path / "bad.csv")).collect()


def test_sql_functions(spark):
    assert len(sql.register(spark)) == 7
    r = spark.sql("SELECT hamming64(-1, 0) AS h, verdict(NULL) AS v, auroc_null_sd(1, 0) AS s, seeded_uniform('a', 'b') AS u").first()
    assert (r["h"], r["v"], r["s"]) == (64, "unable", None) and 0 <= r["u"] < 1
    assert r["u"] == spark.range(1).select(hashing.uniform("a", "b").alias("u")).first()["u"]
    images.synthetic(spark, 2, 32).createOrReplaceTempView("pictures")
    got = {x["id"]: x["p"] for x in spark.sql("SELECT id, raster_phash(height, width, data) AS p FROM pictures").collect()}
    assert got["item-000001"] == rasters.phash(rasters.synthetic_raster(1, 32))


def test_differences_and_uploads(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert sorted(map(tuple, metrics.differences(a, spark.createDataFrame([(1,), (3,)], "x int")).collect())) == [(1, "first"), (2, "first"), (3, "second")]
    assert metrics.differences(a, a.repartition(3)).count() == 0
    files = spark.createDataFrame([(0, "a.JPG", 5), (1, "a.JPG", 5), (2, "b.txt", 1), (3, "c.png", 30 * 2**20), (4, "d.png", 1)], "pos int, name string, size long")
    assert [(r["pos"], r["problem"]) for r in ingest.upload_list(files, ("jpg", "png"), 2).collect()] == [(0, None), (3, "too large")]
    assert hashing.config_hash({"a": 1, "b": 2}) == hashing.config_hash({"b": 2, "a": 1}) != hashing.config_hash({"a": 2, "b": 1})


def test_saved_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    before = files()
    assert len(save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").collect()) == 7
    until = time.time() + 10
    while (left := {f for f in files() - before if Path(f).exists()}) and time.time() < until:
        time.sleep(0.2)
    assert not left
