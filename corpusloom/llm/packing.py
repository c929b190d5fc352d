"""Best-fit packing of tokenised documents into sequences, planned over the histogram of piece lengths.

Lengths are integers up to the capacity, so a plan for the counts of each length is a plan for all pieces, and
its size depends on the capacity only. Pieces over a third of the capacity are matched first, at most two to a
sequence: each, from the longest down, with the longest that still fits beside it. Shorter ones then go, from
the longest down, to the smallest gap that holds them. A piece finds its place by its number among the pieces
of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, tidy
from .encode import WordEncoder

#: Pieces of one length are numbered in shards of about so many rows, whatever they are.
SHARD_ROWS = 2_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, first sequence, pieces to a sequence, offset) for runs of pieces of one length.

    The r-th piece of a length, from 0, in the run that starts last at or before r, goes to sequence
    first sequence + (r - first number) // pieces, at offset + (r - first number) % pieces * length.
    Sequences of like content are ranges of numbers; each step uses up a range or a length, and a range's gap
    halves at least with each length that it takes, so there are O(capacity * log capacity) runs.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, end)
    levels: list[int] = []  # the gaps, ascending
    new = 0

    def free(gap: int, first: int, end: int) -> None:
        if gap and first < end:
            if gap not in gaps:
                gaps[gap] = []
                levels.insert(bisect_left(levels, gap), gap)
            gaps[gap].append((first, end))

    def put(length: int, first: int, each: int, n: int, gap: int) -> None:
        """n pieces into the sequences from first on, that many to each, beside what fills all but gap."""
        runs.append((length, used[length], first, each, capacity - gap))
        used[length] += n

    large = sorted((x for x in counts if 3 * x > capacity and counts[x] > 0), reverse=True)
    left = {x: counts[x] for x in large}
    for x in large:
        while left[x]:
            mate = next((y for y in large if left[y] and x + y <= capacity and (y != x or left[x] > 1)), None)
            if mate is None:
                n = left[x]
                put(x, new, 1, n, capacity)
                free(capacity - x, new, new + n)
            elif mate == x:
                n = left[x] // 2
                put(x, new, 2, 2 * n, capacity)
                free(capacity - 2 * x, new, new + n)
                left[x] -= n  # and n more below
            else:
                n = min(left[x], left[mate])
                put(x, new, 1, n, capacity)
                put(mate, new, 1, n, capacity - x)
                left[mate] -= n
                free(capacity - x - mate, new, new + n)
            left[x] -= n
            new += n
    for x in sorted((x for x in counts if 3 * x <= capacity and counts[x] > 0), reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(levels, x)
            if at == len(levels):
                each = capacity // x
                free(capacity, new, new + -(-n // each))
                new += -(-n // each)
                continue
            gap = levels[at]
            first, end = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                levels.pop(at)
            each = gap // x
            full = min(end - first, n // each)
            if full:
                put(x, first, each, full * each, gap)
                free(gap - each * x, first, first + full)
                n -= full * each
            if n and full < end - first:  # fewer are left than one sequence takes
                put(x, first + full, n, n, gap)
                free(gap - n * x, first + full, first + full + 1)
                n, full = 0, full + 1
            free(gap, first + full, end)
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut at the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode([x or "" for x in part.column("text").to_pylist()])):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        row = (doc, k, start // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None)
                        for name, x in zip(out, row):
                            out[name].append(x)
                if not with_ids:
                    del out["ids"]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", part.column("doc_id").type), *fields]))

        encoder.forget()
        tidy()

    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, ddl)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): a row per piece.

    A null text counts as empty and gives the end id alone; only documents over the capacity are cut. Repeated rows
    are packed each; pieces of one length are numbered as they were written, which nothing else hangs on. An empty
    table gives none. doc_id keeps its type; columns other than doc_id and text are ignored. with_ids adds the ids themselves, for writing the sequences.
    """
    made = token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids)
    pieces = save(made.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    spark = docs.sparkSession
    runs = spark.createDataFrame(plan(counts, capacity), "length bigint, first bigint, sequence bigint, each bigint, at bigint")
    by_length = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "sequence", "each", "at"))).alias("runs"))
    # the number of a piece among those of its length: within a shard, after the shards before
    shards = spark.createDataFrame([(x, -(-n // SHARD_ROWS)) for x, n in counts.items()], "length bigint, shards bigint")
    keyed = pieces.join(F.broadcast(shards), "length").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards"))).drop("shards")
    own = Window.partitionBy("length", "shard").orderBy("row")
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("length", "shard").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = keyed.withColumn("r", F.row_number().over(own) - 1).join(sizes, ["length", "shard"]).withColumn("r", F.col("r") + F.col("before"))
    # the plan has a row per length, at most capacity of them, and its runs are bounded as plan() says
    placed = number.join(F.broadcast(by_length), "length").withColumn("run", F.element_at(F.filter("runs", lambda x: x["first"] <= F.col("r")), -1)).withColumn("r", F.col("r") - F.col("run.first"))
    return placed.select(
        *made.columns, (F.col("run.sequence") + F.floor(F.col("r") / F.col("run.each"))).cast("bigint").alias("sequence_id"), (F.col("run.at") + F.col("r") % F.col("run.each") * F.col("length")).cast("bigint").alias("offset")
    )
