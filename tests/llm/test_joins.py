"""Mixing, repeated strings, top-k, Jaccard join, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jaccard, langid, mixing, pii, suffixes, topk
from corpusloom.llm.queries import ORACLE, QUERIES, WORD_VOCABULARY, vocabulary

from .helpers import CLASHES, DATA, ODD, duck, frame, oracle_rows, words

EMPTY: list = []


# --- mixing


def mix_docs(n=400, seed=0):
    rng = random.Random(seed)
    names = ["b", "a", None, "Z", "é"]
    return [(i, " ".join("w" for _ in range(rng.randint(0, 60))), "en", names[min(4, int(rng.expovariate(1)))], 0) for i in range(n)]


def brute_targets(sizes, passes=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > passes * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: passes * sizes[s] for s in full}
        left -= sum(passes * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(2))
def test_mix_meets_targets(spark, seed):
    docs = mix_docs(seed=seed)
    rows = mixing.mix(frame(spark, docs, CLASHES), shards=8).collect()
    sizes: dict = {}
    for _, t, _, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    assert len(rows) == len(docs)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 60
        assert all(r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] and len(r["placements"]) == r["copies"] for r in own)
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
    again = mixing.mix(frame(spark, docs).repartition(5), shards=8).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_tree_deals_exact_quotas(spark):
    """Every shard has its share of all draws, and each source's blocks are spread as a shuffle of all draws would."""
    draws = spark.sql("SELECT CAST(1 + (id % 4 = 0)::INT AS INT) AS ord, id AS block, CAST(0 AS INT) AS pass FROM range(400)")
    counts = []
    for seed in range(40):
        rows = mixing._deal(draws, 8, f"s{seed}").groupBy("shard").agg(F.count("*").alias("n"), F.sum((F.col("ord") == 2).cast("int")).alias("k")).collect()
        assert sorted(r["shard"] for r in rows) == list(range(8)) and sum(r["n"] for r in rows) == 400
        assert all(r["n"] in (49, 50, 51) for r in rows)
        counts += [r["k"] for r in rows]
    # of 400 draws 100 are of the second source: a shard of 50 has 12.5 of them, with the variance of the law
    mean, variance = 50 * 100 / 400, 50 * 0.25 * 0.75 * 350 / 399
    assert abs(np.mean(counts) - mean) < 0.05 and abs(np.var(counts) / variance - 1) < 0.3


def test_mixed_documents_and_odd_rows(spark):
    docs = frame(spark, ODD, CLASHES)
    m = mixing.mix(docs)
    assert m.count() == len(ODD)
    mixed = mixing.mixed_documents(docs)
    assert mixed.count() == m.agg(F.sum("copies")).first()[0] and set(docs.columns) <= set(mixed.columns)
    assert mixing.mix(frame(spark, EMPTY)).count() == 0 and mixing.mixed_documents(frame(spark, EMPTY)).count() == 0
    nothing = mixing.mix(frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in nothing)


# --- repeated strings


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for k, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    cover = [np.zeros(len(b), bool) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                cover[k][i : i + length] = True
    out = []
    for b, c in zip(data, cover):
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        out.append((len(b), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def planted_texts(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))
    shared = [noise(rng.randint(190, 700)) for _ in range(5)]
    texts = []
    for _ in range(60):
        t = noise(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 60)
            t += p[a : len(p) - rng.randint(0, 60)] + noise(rng.randint(0, 90))
        texts.append(t)
    texts += [texts[3], texts[3], "ab" * 400, "x" * 900, "", None, "y" * 199, "z" * 200, "z" * 200]
    near = list(texts[5] or noise(500))
    near[len(near) // 2] = "#"
    return texts + ["".join(near)]


@pytest.mark.parametrize("large", [20_000, 2])
@pytest.mark.parametrize("seed", range(2))
def test_repeats_by_brute_force(spark, seed, large, monkeypatch):
    monkeypatch.setattr(suffixes, "LARGE_GROUP", large)
    texts = planted_texts(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:-1] for r in suffixes.remove_repeats(df, 200, digest=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


def brute_passages(texts, size):
    """Texts with 50 whole words within bytes that strings of that size cover which another document has."""
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for k, b in enumerate(data):
        for i in range(len(b) - size + 1):
            seen.setdefault(b[i : i + size], []).append((k, i))
    cover = [np.zeros(len(b) + 1, bool) for b in data]
    for at in seen.values():
        if len({k for k, _ in at}) > 1:
            for k, i in at:
                cover[k][i : i + size] = True
    out = []
    for b, c in zip(data, cover):
        inside, best = 0, 0
        ws = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        for n, (a, e) in enumerate(ws):
            whole = c[a:e].all()
            joined = inside and c[ws[n - 1][1] : a].all()
            inside = (inside + 1 if joined else 1) if whole else 0
            best = max(best, inside)
        out.append(best >= 50)
    return out


@pytest.mark.parametrize("large", [20_000, 2])
def test_contract_lengths_and_passages_by_brute_force(spark, large, monkeypatch):
    """Strings of 400 bytes, and passages from another document by strings of 256."""
    monkeypatch.setattr(suffixes, "LARGE_GROUP", large)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (45, 55, 60, 75, 120)]
    texts = []
    for k in range(40):
        parts = [text(rng.randint(5, 60))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts += [p, text(rng.randint(1, 40))]
        texts.append(" ".join(parts))
    own = text(80)
    texts += [own + " x " + own, texts[0], text(200), text(52)[:300], None, ""]  # a text that repeats itself alone
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(df, 400, digest=True).collect()}
    assert [got[i][:-1] for i in range(len(texts))] == brute_repeats(texts, 400)
    want = brute_passages(texts, 256)
    assert [got[i][-1] for i in range(len(texts))] == want and 5 < sum(want) < 40 and not want[40]


def test_repeats_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TILE", 700)
    texts = planted_texts(7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    # workers import the module anew, so the tile is tried on the function itself as well
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    ends = np.cumsum([len((t or "").encode()) for t in texts])
    starts = ends - [len((t or "").encode()) for t in texts]
    ok = ends > starts
    small = suffixes.anchors(data, starts[ok], ends[ok], 200)
    monkeypatch.setattr(suffixes, "TILE", 1 << 18)
    for a, b in zip(small, suffixes.anchors(data, starts[ok], ends[ok], 200)):
        assert (a == b).all()
    got = {r["doc_id"]: tuple(r)[1:-1] for r in suffixes.remove_repeats(df, 200, digest=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


def test_repeats_odd_rows(spark):
    out = suffixes.remove_repeats(frame(spark, ODD, CLASHES))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ODD) and rows[1]["n_bytes"] == 0 and rows[1]["n_spans"] == 0
    for r in rows.values():
        assert r["n_bytes"] - r["n_removed"] == len(r["kept"]) and sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]
    assert suffixes.remove_repeats(frame(spark, EMPTY)).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(frame(spark), 50)


# --- top-k


def test_topk_twin(spark):
    con = duck()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    got, want = oracle_rows(ORACLE["op9_exact_top_k"], QUERIES["op9_exact_top_k"](spark, DATA), con)
    assert got == want


def brute_top(rows, queries, k):
    """rows: (id, vector); each query row's (id, [(rank, id, score)])."""
    q = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows]
    out = []
    for a, (i, x) in enumerate(q):
        if queries(i):
            best = sorted((-sum(s * t for s, t in zip(x, y)), j, b) for b, (j, y) in enumerate(q) if b != a and len(y) == len(x))[:k]
            out.append((i, [(r + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, j, _) in enumerate(best)]))
    return out


def check_top(spark, rows, more=(), **options):
    df = spark.createDataFrame([*rows, *more], "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("score", "row", "query", "fits", "v", "id")}).repartition(3)
    got: dict = {}
    for r in topk.top_k(df, F.col("vec_id") % 5 == 0, 5, **options).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want: dict = {}
    for i, best in brute_top(rows, lambda i: i % 5 == 0, 5):
        want.setdefault(i, []).extend(best)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items() if x}


@pytest.mark.parametrize("bins, group", [(4, 2048), (512, 5)])
def test_topk_by_brute_force(spark, bins, group):
    """Ties, repeated ids and rows, vectors that take no part, other lengths."""
    rng = random.Random(8)
    vecs = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(60)]
    rows = [*vecs, (3, vecs[3][1]), (5, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (10, [-1.0, 0.5, 0.5]), (74, [1.0]), (75, [2.0]), (76, []), (80, []), (85, [])]
    more = [(70, None), (71, [1.0, None, 2.0]), (72, [1.0, float("nan"), 0.0]), (73, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    check_top(spark, rows, more, bins=bins, query_group=group)


@pytest.mark.parametrize("size", [3e6, 1e12, 1e200])
def test_topk_of_large_values(spark, size):
    """Products over 53 bits, over 63 bits, and over what doubles hold, beside ordinary ones."""
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    rows += [(40 + i, [rng.choice([-1, 1]) * size * rng.choice([0.25, 1 / 3, 1.0]) for _ in range(4)]) for i in range(20)]
    check_top(spark, rows)


def test_topk_of_negative_scores(spark):
    check_top(spark, [(i, [1.0 if i % 5 else -1.0, 0.01 * (i % 7)]) for i in range(40)])
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 5 == 0).count() == 0


# --- Jaccard join


def brute_components(docs, part=90, whole=100, size=3):
    sets = {}
    for i, t in docs:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in words(t)]
        sets[i] = frozenset([tuple(w)]) if 0 < len(w) < size else frozenset(zip(*(w[k:] for k in range(size))))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_docs(seed, n=8):
    """Families of texts at about the threshold, of every size, beside passages that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, docs = [word() for _ in range(40)], []
    for size in (1, 2, 3, 8, 11, 12, 14, 20, 21, 22, 25, 31, 40, 60, 100, 180):
        for _ in range(3):
            base = [word() for _ in range(size)]
            if size > 60:
                base[10:50] = passage
            for _ in range(n):
                t = list(base)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    t[rng.randrange(len(t))] = word()
                t = t[rng.randint(0, size // 20) :] if size > 20 else t[: rng.randint(max(1, size - 1), size)]
                docs.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in t))
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(3))
def test_components_by_brute_force(spark, seed):
    docs = near_docs(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "ÉÉ é x y"), (9004, "éé é x y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, size=3, part=90).collect()}
    want = brute_components(docs)
    assert got == want
    assert len({c for _, c in want.values()}) not in (1, len(docs))


@pytest.mark.parametrize("broadcast", [True, False])
def test_other_thresholds_and_sizes(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(jaccard, "SMALL_SETS", 0)
    docs = near_docs(5, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(docs, 80, 100, 5)


def test_threshold_arithmetic():
    t = jaccard.Threshold()
    for n in range(1, 200):
        for m in t.partners(n):
            o = t.shared(n + m)
            if o > min(n, m):
                continue
            assert 100 * o >= 90 * (n + m - o) and 100 * (o - 1) < 90 * (n + m - o + 1)
            # a set with a partner of m shares more than what lies behind the lists that it scans
            assert n - t.scanned(n) < o
    assert all(t.boundary() >= n for n in range(1, t.boundary() + 1)) and t.listed() <= t.boundary() + 1
    for other in (jaccard.Threshold(80), jaccard.Threshold(50)):
        assert 0 < other.listed() <= other.boundary() + 1 and all(other.scanned(n) >= 1 for n in range(1, 500))


def crowd(seed, n=150):
    """One large group of near copies that mostly don't reach each other but by a few, beside a passage that all of
    another group share, and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage, docs = [word() for _ in range(90)], [word() for _ in range(60)], []
    for k in range(n):
        t = list(base)
        for _ in range(k % 4):
            t[rng.randrange(len(t))] = word()
        docs.append(" ".join(t))
        docs.append(" ".join([word() for _ in range(5 + k % 9)] + passage + [word() for _ in range(k % 7)]))
    return list(enumerate(docs + docs[:20]))


@pytest.mark.parametrize("part, size", [(90, 3), (80, 5)])
@pytest.mark.parametrize("rounds, hot", [(3, 512), (0, 2), (1, 10**9)])
def test_large_groups_by_brute_force(spark, part, size, rounds, hot, monkeypatch):
    """With or without hubs, and with hot lists or none."""
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "HOT_SHARE", hot)
    docs = crowd(part)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, size=size, part=part).collect()}
    assert got == brute_components(docs, part, 100, size)


def test_jaccard_odd_rows(spark):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, ODD, CLASHES), size=3, part=90).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, 1, 5)} <= rows
    assert jaccard.jaccard_components(frame(spark, ODD)).count() == len(ODD)
    assert jaccard.jaccard_components(frame(spark, EMPTY)).count() == 0
    nulls = jaccard.jaccard_components(frame(spark, [(None, "a b c", "en", "a", 0), (1, "a b c", "en", "a", 0)]))
    assert sorted(map(tuple, nulls.collect()), key=repr) == [(1, 1, 1), (None, 1, None)]


def test_one_row_of_each_component(spark):
    """Different texts under one id are judged apart; repeated rows and copies go but for one; null ids stay."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "en", "x", 1), (1, b, "en", "x", 1), (1, b, "en", "x", 1), (2, a, "en", "y", 1), (3, b + " more", "en", "y", 1), (None, a, "en", "y", 1), (None, a, None, None, None), (4, None, "en", "y", 0), (5, "", "en", "y", 0), (6, "", "en", "y", 0), (7, "c d", "en", "y", 0)]
    docs = frame(spark, rows, CLASHES)
    kept = jaccard.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (None, a), (None, a), (4, None), (5, ""), (6, ""), (7, "c d")], key=repr)
    assert jaccard.without_near_duplicates(frame(spark, EMPTY)).count() == 0


# --- pipeline


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({c: F.lit("mine") for c in CLASHES})
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.train(docs.filter(~langid.is_held_out(F.col("doc_id"))))
    one = p.language(spark, docs, DATA).cache()
    assert one.columns == docs.columns
    keep = {i for i, (lang, score) in zip(rows, langid.label(model, [r["text"] for r in rows.values()])) if lang != "und" and score >= p.LEAST_SHARE}
    assert {r["doc_id"] for r in one.collect()} == keep and len(keep) > 0.95 * len(rows)
    two = p.near_duplicates(spark, one, DATA).cache()
    want = {i for i, (n, c) in brute_components([(i, rows[i]["text"]) for i in keep], 80, 100, 5).items() if c == i}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(want)
    three = p.personal_data(spark, two, DATA).cache()
    assert three.columns == docs.columns and three.count() == two.count()
    for i, x in ((r["doc_id"], m) for r in pii.pseudonymise(two, pii.key_of(spark)).select("doc_id", F.explode("pii").alias("m")).collect() for m in [r["m"]]):
        assert x["original"] in rows[i]["text"] and x["pseudonym"] != x["original"]
    four = p.mixture(spark, three, DATA).cache()
    con = duck(documents=three.select("doc_id", "text", "source").toPandas())
    copies = {i: t // s if s else None for i, s, t in con.execute(f"SELECT doc_id, size, taken FROM ({ORACLE['op4_mix_sources']})").fetchall()}
    got: dict = {}
    for r in four.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert all(got.get(i, 0) == n for i, n in copies.items() if n is not None)
    lib = __import__("corpusloom.llm.encode", fromlist=["library"]).library(vocabulary(WORD_VOCABULARY))
    five = p.sequences(spark, four, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    for i in list(got)[:40]:
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 0]
        own = sorted((r["piece"], r["length"], r["ids_crc32"]) for r in five if r["doc_id"] == i)
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert own == sorted((k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut) for _ in range(got[i]))


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, two texts under one id, clashing names, and a source
    with nearly all rows."""
    import corpus_pipeline as p

    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [*ODD, *[(100 + i, prose(20 + i), "en", "hot", 0) for i in range(60)], (100, prose(30), "en", "hot", 0), (None, "call 555-123-4567 please", "en", None, None)]
    docs = frame(spark, rows, CLASHES)
    texts = {(r[0], r[1]) for r in rows}
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, DATA)
        got = out.collect()
        assert out.columns == docs.columns and {r["doc_id"] for r in got} <= {r[0] for r in rows}, name
        if name != "PII":
            assert {(r["doc_id"], r["text"]) for r in got} <= texts
        if name == "n-gram Jaccard join":
            assert {(r["doc_id"], r["text"]) for r in got if r["doc_id"] == 100} == {x for x in texts if x[0] == 100} and len(got) == len(texts) - 1  # but for "One TWO"
        assert all(r[c] == "mine" for r in got[:5] for c in CLASHES if c not in ("shard", "shard_order"))
    pieces = p.STAGES[4][1](spark, docs, DATA).groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in pieces) >= len(rows) and any(r["doc_id"] is None for r in pieces)


def test_pipeline_runs_on_nothing(spark, tmp_path):
    import corpus_pipeline as p

    frame(spark, EMPTY).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in p.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
