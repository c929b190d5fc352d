"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source's documents fall into blocks by a keyed hash. A source's target in words fixes exactly how many of
its blocks the mix draws, pass after pass, and which part of the last block. The tree deals these quotas out: each
node halves its shards, and a keyed permutation of its draws says which of them go left. So the numbers of each
source's blocks on both sides follow the multivariate hypergeometric law, every shard gets its share of all draws, and
the blocks of a source that shards have are disjoint runs of a permutation. Shards order their documents by a keyed hash.

Permutations are ranks of hashes: those of a node or a source are counted by ranges of the hash first, so that no
task gets more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranges import ranked
from .common import n_words, save, small_enough, unused

#: No document is taken more often.
MAX_PASSES = 3
#: Source tables and block tables of at most so many rows are broadcast.
SMALL_ROWS = 200_000


def hash31(*parts: Column | str) -> Column:
    """A number under 2^31 from a keyed hash; DuckDB can compute it, too."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint"), F.lit(2**31))


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size): one row per source, null among them.

    Sources by code point, null last, have the weights in turn. The targets share the total size by weight; none
    is over max_passes times its source's size, and the excess is shared by weight until none is. Filling up
    sources in order of cap / weight reaches that state in one pass of prefix sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # one row per source: the number of sources, not of documents, bounds these windows
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = Window.orderBy("ratio", "ord").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "ord").rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("ord") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.col("source_size") * max_passes).cast("double")
    return (
        per.withColumn("ord", F.row_number().over(order))
        .withColumn("w", w)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1))).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(every), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("w").over(rest))
        # levels rise up to the first source that its cap doesn't stop, and fall from there: all share its level
        .withColumn("shared", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy(F.lit(1))))
        .select("source", "source_size", "n_docs", "ord", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce("shared", F.col("ratio")) * F.col("w"))).alias("target"))
    )


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def _deal(draws: DataFrame, shards: int, seed: str) -> DataFrame:
    """(ord, block, pass, shard): the tree, one level of all its nodes after the other."""
    ties = ["ord", "block", "pass"]
    node = draws.select(*ties, F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    for _ in range(max(0, shards - 1).bit_length()):
        key = F.md5(F.concat_ws("|", F.lit(seed), F.col("lo").cast("string"), F.col("hi").cast("string"), *[F.col(c).cast("string") for c in ties]))
        placed = ranked(node.withColumn("key", key), ["lo", "hi"], "key", ties)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        coin = (hash31(F.lit(seed), F.col("lo").cast("string"), F.col("hi").cast("string"), F.lit("coin")) + 0.5) / float(2**31)
        left = F.col("before") < F.floor(F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo")) + coin)
        leaf = F.col("hi") - F.col("lo") == 1
        halved = placed.withColumn("mid", mid).withColumn("left", left)
        node = save(halved.select(*ties, F.when(leaf | F.col("left"), F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(leaf | ~F.col("left"), F.col("hi")).otherwise(F.col("mid")).alias("hi")), "mix-tree")
    return node.select(*ties, F.col("lo").alias("shard"))


def _placed(docs: DataFrame, params: DataFrame, seed: str) -> DataFrame:
    """docs (doc_id, source, size and others) with their source's params, their block, and doc_key."""
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    joined = docs.join(small_enough(params, SMALL_ROWS), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    return joined.withColumn("block", F.pmod(hash31(F.lit(seed), key, _text("doc_id")), F.col("n_blocks"))).withColumn("doc_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("doc"), F.col("doc_id").cast("string"))))


def _plan(sized: DataFrame, weights: tuple[int, ...], shards: int, seed: str, block_docs: int, max_passes: int) -> tuple[DataFrame, DataFrame]:
    """(params, blocks) from (doc_id, source, size): one row per source, and one per block with what the mix draws of it.

    blocks: full passes, cut, draws. In the pass after the full ones, a block's documents are taken whose (doc_key,
    doc_id, size) is at most its cut: all of them if cut.every, none if cut is null.
    """
    targets = save(source_targets(sized, weights, max_passes), "mix-targets")
    blocks = F.greatest(F.ceil(F.col("n_docs") / block_docs), F.lit(1))
    params = targets.withColumn("n_blocks", blocks.cast("bigint")).withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_passes))).otherwise(0).cast("int"))
    params = params.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    params = save(params.withColumnRenamed("source", "of_source").select("of_source", "source_size", "target", "ord", "passes", "rest", "n_blocks"), "mix-params")
    placed = _placed(sized, params.drop("source_size", "target"), seed)
    # blocks by their keyed order: which of them the broken pass takes whole, and which in part
    per_block = placed.groupBy("ord", "block").agg(F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    per_block = per_block.withColumn("block_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("block"), F.col("ord").cast("string"), F.col("block").cast("string"))))
    per_block = ranked(save(per_block, "mix-blocks"), ["ord"], "block_key", ["block"], F.col("block_size")).withColumn("need", F.col("rest") - F.col("before"))
    whole, part = (F.col("need") > 0) & (F.col("need") >= F.col("block_size")), (F.col("need") > 0) & (F.col("need") < F.col("block_size"))
    per_block = save(per_block.select("ord", "block", "passes", "need", whole.alias("whole"), part.alias("part")), "mix-needs")
    # draws: (source, pass, block)
    n_draws = F.col("passes") + F.when(F.col("whole") | F.col("part"), 1).otherwise(0)
    draws = _deal(per_block.select("ord", "block", F.posexplode(F.array_repeat(F.lit(0), n_draws)).alias("pass", "one")), shards, seed)
    # in a block that is taken in part, documents in keyed order while that brings the words nearer to the target
    partly = placed.join(small_enough(per_block.filter("part").select("ord", "block", "need"), SMALL_ROWS), ["ord", "block"])
    last = F.struct("doc_key", "doc_id", "size")
    own = Window.partitionBy("ord", "block").orderBy("doc_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cuts = partly.withColumn("before", F.coalesce(F.sum("size").over(own), F.lit(0))).filter(F.col("before") + F.col("size") / 2 <= F.col("need")).groupBy("ord", "block").agg(F.max(last).alias("cut"))
    dealt = draws.groupBy("ord", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    made = per_block.join(dealt, ["ord", "block"]).join(cuts, ["ord", "block"], "left")
    return params, save(made.select("ord", "block", F.col("passes").alias("full"), F.col("part"), "cut", "draws"), "mix-dealt")


def _placements(rows: DataFrame, blocks: DataFrame, seed: str) -> DataFrame:
    """Rows of _placed() with placements: an array of (pass, shard, order), one for each copy."""
    joined = rows.join(small_enough(blocks, SMALL_ROWS), ["ord", "block"], "left")
    in_part = ~F.col("part") | F.coalesce(F.struct("doc_key", "doc_id", "size") <= F.col("cut"), F.lit(False))
    got = F.filter(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int>>")), lambda d: (d["pass"] < F.col("full")) | in_part)
    entry = lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.md5(F.concat_ws("|", F.lit(seed), d["shard"].cast("string"), d["pass"].cast("string"), F.col("doc_key"))).alias("order"))
    return joined.withColumn("placements", F.transform(got, entry))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), shards: int = 64, seed: str = "mix-1", block_docs: int = 32, max_passes: int = MAX_PASSES) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken, and placements: an array of (pass, shard,
    order) with one entry for each copy that the mix takes.

    A source takes whole passes over its documents and of one more pass its first blocks in a permuted order, the
    last of them in part, so that its words come within one document of its target. Rows with a null text or without
    words have size 0; they come with the passes and blocks they fall in. Repeated rows count each, but are taken or
    left together; ties of the hash order go by id. An empty table gives an empty result; other columns are ignored.
    Runs agree.
    """
    sized = save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    params, blocks = _plan(sized, weights, shards, seed, block_docs, max_passes)
    rows = _placements(_placed(sized, params, seed), blocks, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", F.size("placements").alias("copies"), (F.col("size") * F.size("placements")).alias("taken"), "placements")


def mixed_documents(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), shards: int = 64, seed: str = "mix-1", block_docs: int = 32, max_passes: int = MAX_PASSES) -> DataFrame:
    """The mix itself: a row of docs for each copy taken, with its shard and its place's key within the shard.

    Texts stay where they are if the table of blocks can be broadcast. Columns of docs named shard and shard_order are
    replaced; others stay, whatever their names.
    """
    sized = save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    params, blocks = _plan(sized, weights, shards, seed, block_docs, max_passes)
    (row,) = unused(docs, "row")
    own = docs.select(F.struct(*docs.columns).alias(row), "doc_id", "source", n_words(F.col("text")).alias("size"))
    taken = _placements(_placed(own, params, seed), blocks, seed).select(row, F.explode("placements").alias("placement"))
    return taken.select(*[F.col(row)[c].alias(c) for c in docs.columns if c not in ("shard", "shard_order")], F.col("placement.shard").alias("shard"), F.col("placement.order").alias("shard_order"))
