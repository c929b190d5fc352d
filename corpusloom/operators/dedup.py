"""Near duplicates by 64-bit hashes: exact banded Hamming joins, and their components.

Hashes are two 32-bit halves. Equal hashes are collapsed first. The 64 bits are cut into blocks: a pair that differs in
fewer bits than there are blocks agrees in some of them, so each hash is keyed by every choice of that many blocks. More
blocks make more keys for each hash, but longer ones, which fewer others share; the number of hashes decides.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import bounded, save

THRESHOLD = 6
#: Bits of a counter of words; three counters share a number of 64 bits.
LANE = 21


def hamming(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{h}").bitwiseXOR(F.col(f"{b}.{h}"))) for h in ("hi", "lo")), F.lit(0))


def halves(hash64: Column) -> list[Column]:
    """(hi, lo) of a 64-bit hash, signed or not."""
    return [F.shiftrightunsigned(hash64, 32).alias("hi"), hash64.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo")]


def simhash(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, hi, lo): each bit is the majority of the bits of the distinct words' hashes.

    Votes are counted in lanes of LANE bits, which documents of up to two million distinct words don't leave.
    """
    words = docs.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != ""))).alias("w"))
    part = lambda at: F.conv(F.substring("m", at, 8), 16, 10).cast("bigint")
    hashed = words.select(key, F.md5("w").alias("m")).select(key, part(1).alias("hi"), part(9).alias("lo"))
    bit = lambda i: F.shiftright("hi" if i < 32 else "lo", i % 32).bitwiseAND(F.lit(1))
    lanes = [F.sum(sum((F.shiftleft(bit(i + k), LANE * k) for k in range(1, 3) if i + k < 64), bit(i))).alias(f"v{i}") for i in range(0, 64, 3)]
    votes = hashed.groupBy(key).agg(F.count("*").alias("n"), *lanes)
    count = lambda i: F.shiftright(F.col(f"v{i - i % 3}"), LANE * (i % 3)).bitwiseAND(F.lit((1 << LANE) - 1))
    bits = lambda first: sum((F.when(2 * count(first + i) > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(32)), F.lit(0).cast("bigint"))
    return votes.select(key, bits(0).alias("hi"), bits(32).alias("lo"))


def distinct_hashes(hashes: DataFrame, key: str) -> DataFrame:
    """(id, hi, lo, n): one row per hash, named by its smallest key."""
    return hashes.groupBy("hi", "lo").agg(F.min(key).alias("id"), F.count("*").alias("n"))


def scheme(n: int, others: int, threshold: int) -> list[int]:
    """Masks of the bits that agree in pairs within the threshold, one mask at least for each pair: those that bring the
    fewest keys and pairs to compare, for so many hashes on either side."""

    def masks(blocks: int) -> list[int]:
        edges = [64 * i // blocks for i in range(blocks + 1)]
        ranges = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
        return [sum(c) for c in itertools.combinations(ranges, blocks - threshold)]

    def cost(blocks: int) -> float:
        agree = 64 * (blocks - threshold) / blocks
        return math.comb(blocks, threshold) * (n + others + n * others / 2**agree)

    return masks(min(range(threshold + 1, threshold + 8), key=cost))


def _keyed(rows: DataFrame, columns: list[str], masks: list[int]) -> DataFrame:
    """rows once for each mask, with its number and the bits that it leaves."""
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")
    whole = F.shiftleft(F.col("hi"), 32).bitwiseOR(F.col("lo"))
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), whole.bitwiseAND(signed(m)).alias("v")) for k, m in enumerate(masks)])
    return rows.withColumn("x", F.explode(keys)).select(*columns, "hi", "lo", "x.mask", "x.v")


def _agree() -> Column:
    return (F.col("a.mask") == F.col("b.mask")) & (F.col("a.v") == F.col("b.v"))


def near_pairs(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, distance), a < b, of different hashes within the threshold.

    Spark sizes the keyed rows by the written hashes, as if each had one key: without the hint it takes them to the driver
    to broadcast.
    """
    distinct = save(distinct.select("id", "hi", "lo"), "dedup-hashes")
    n = distinct.count()
    rows = _keyed(distinct, ["id"], scheme(n, n, threshold))
    a, b = rows.alias("a"), rows.alias("b")
    near = a.join(b.hint("merge"), _agree() & (F.col("a.id") < F.col("b.id")) & (hamming("a", "b") <= threshold))
    return near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), hamming("a", "b").cast("int").alias("distance")).distinct()


def near_pairs_brute(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The same by comparing all pairs; for audits of small samples and tests."""
    a, b = distinct.alias("a"), distinct.alias("b")
    return a.join(b, (F.col("a.id") < F.col("b.id")) & (hamming("a", "b") <= threshold)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), hamming("a", "b").cast("int").alias("distance"))


def clusters(hashes: DataFrame, key: str, threshold: int = THRESHOLD) -> DataFrame:
    """(key, cluster): rows whose hashes a chain of near pairs joins; a cluster is named by its smallest key."""
    hashes = save(hashes, "dedup-hashes")
    distinct = save(distinct_hashes(hashes, key), "dedup-distinct")
    n = distinct.count()
    found = components(near_pairs(distinct, threshold).select("a", "b")).withColumnRenamed("id", "_id")
    named = distinct.join(bounded(found, n), distinct["id"] == found["_id"], "left").select("hi", "lo", F.coalesce("component", "id").alias("cluster"))
    return hashes.join(bounded(named, n), ["hi", "lo"]).select(key, "cluster")


def collisions(rows: DataFrame, h: str) -> DataFrame:
    """How many groups share a hash, and how many rows are in them."""
    per = rows.groupBy(h).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_rows"))


def block_hits(rows: DataFrame, key: str, shas: DataFrame, hashes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(key, reason) of rows that a blocklist forbids: rows have sha, hi and lo; an equal sha comes first, then the
    nearest hash within the threshold."""
    rows, listed = save(rows.select(key, "sha", "hi", "lo"), "dedup-rows"), save(hashes.select("hi", "lo").distinct(), "dedup-listed")
    exact = rows.join(shas.select("sha").distinct(), "sha", "left_semi").select(key, F.lit("sha256").alias("reason"))
    masks = scheme(rows.count(), listed.count(), threshold)
    a, b = _keyed(rows, [key], masks).alias("a"), _keyed(listed, [], masks).alias("b")
    near = a.join(b, _agree() & (hamming("a", "b") <= threshold)).groupBy(f"a.{key}").agg(F.min(hamming("a", "b")).alias("d"))
    fuzzy = near.join(exact, key, "left_anti").select(key, F.concat(F.lit("hamming "), F.col("d").cast("string")).alias("reason"))
    return exact.unionByName(fuzzy)


def pair_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(within, across, examples): pairs (a, b, distance) by whether classes (id, klass) tell them alike, and the five
    nearest of those across, as text."""
    of = lambda c: classes.select(F.col("id").alias(c), F.col("klass").alias(f"k{c}"))
    told = save(pairs.join(of("a"), "a").join(of("b"), "b").withColumn("alike", F.col("ka") == F.col("kb")), "dedup-told")  # read twice
    nearest = told.filter("NOT alike").orderBy("distance", "a", "b").limit(5).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("distance").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")))), "; ").alias("examples"))
    return told.agg(F.count_if("alike").alias("within"), F.count_if(~F.col("alike")).alias("across")).join(nearest)
