"""Exact top-k search by inner product, by distributed histogram selection.

A stated set of queries is scored against every row where the row lies: bounded groups of queries go to the workers,
rows never move. A pass over the scores gives each query a histogram of them, summed over the workers; the bin that
holds the k-th value becomes the next pass's range, until that value is known exactly. The last pass keeps what scores
above it and, of what scores exactly it, the smallest ids.

Scores are exact integers of any size: doubles or 64-bit integers hold the usual ones, Python's integers the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, save_parts

#: Rows and queries that are scored at once.
ROWS, QUERIES = 512, 2048
#: Doubles hold integers up to the first exactly; sums of products up to the second don't leave 64 bits.
DOUBLE, LONG = 2.0**53, 2.0**61
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


class Scale:
    """How scores of one table become unsigned 64-bit keys in their order: by an offset if bound is known to bound them,
    else by the bits of the nearest doubles; equal keys are told apart by the scores themselves then."""

    def __init__(self, scale: int, bound: float):
        self.scale, self.wide = scale, not bound < LONG
        self.bound = 0 if self.wide else math.ceil(bound * (1 + 1e-9)) + 1
        self.doubles = not self.wide and self.bound < DOUBLE
        self.span = 2**64 if self.wide else 2 * self.bound + 1

    def whole(self, x: np.ndarray) -> np.ndarray:
        """floor(scale * x) of a matrix of doubles: doubles, 64-bit integers, or Python's."""
        if self.wide:
            return np.array([[math.floor(Fraction(v) * self.scale) for v in row] for row in x.tolist()], object).reshape(x.shape)
        y = np.floor(x * self.scale)
        return y if self.doubles else y.astype(np.int64)

    def tame(self, x: np.ndarray) -> np.ndarray:
        """The rows whose products with each other doubles hold exactly."""
        with np.errstate(over="ignore"):
            return (np.square(np.abs(x) * self.scale + 1)).sum(axis=1) < DOUBLE / 2

    def keys(self, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, scores) of all pairs of rows of two matrices of doubles."""
        if not self.wide:
            s = self.whole(q) @ self.whole(c).T
            return (s + self.bound).astype(np.uint64), s.astype(np.int64)
        s = np.zeros((len(q), len(c)), object)
        near = np.zeros(s.shape)
        a, b = self.tame(q), self.tame(c)
        own = np.floor(q[a] * self.scale) @ np.floor(c[b] * self.scale).T
        near[np.ix_(a, b)] = own
        s[np.ix_(a, b)] = own.astype(np.int64).astype(object)
        for rows, cols in ((~a, np.ones(len(c), bool)), (a, ~b)):
            if rows.any() and cols.any():
                s[np.ix_(rows, cols)] = own = self.whole(q[rows]) @ self.whole(c[cols]).T if q.shape[1] else 0
                near[np.ix_(rows, cols)] = [[_near(v) for v in row] for row in own.tolist()] if q.shape[1] else 0
        bits = (near + 0.0).view(np.uint64)
        return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)), s


def _near(v: int) -> float:
    try:
        return float(v)
    except OverflowError:
        return math.inf if v > 0 else -math.inf


def _sortable(v: int) -> str:
    """Strings in the order of the integers."""
    d = f"{len(str(abs(v))):06d}{abs(v)}"
    return "1" + d if v >= 0 else "0" + "".join(str(9 - int(c)) for c in d)


def _by_length(batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, id, vectors as a matrix of doubles) for each length of vector."""
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(v.offsets.to_numpy())
    row, own = (batch.column(c).to_numpy() for c in ("row", "id"))
    first = np.cumsum(size) - size
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield row[at], own[at], flat[first[at][:, None] + np.arange(n)]


class _Group:
    """A bounded group of queries, and what is known of their k-th values so far: lo and, over it, above rows."""

    def __init__(self, table: pa.Table, scale: Scale):
        self.scale, self.parts = scale, list(_by_length(table))
        self.size = table.num_rows
        self.ids = np.concatenate([p[1] for p in self.parts])
        self.lo = np.zeros(self.size, np.uint64)
        self.above = np.zeros(self.size, np.int64)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(places of queries, rows, ids, keys, scores, places of the queries' own rows) by block of rows and queries."""
        for batch in batches:
            for row, own, c in _by_length(batch):
                first = 0
                for q_row, _, q in self.parts:
                    if q.shape[1] == c.shape[1]:
                        for a in range(0, len(q), QUERIES):
                            for b in range(0, len(c), ROWS):
                                keys, s = self.scale.keys(q[a : a + QUERIES], c[b : b + ROWS])
                                _, i, j = np.intersect1d(q_row[a : a + QUERIES], row[b : b + ROWS], assume_unique=True, return_indices=True)
                                yield np.arange(first + a, first + a + len(keys)), row[b : b + ROWS], own[b : b + ROWS], keys, s, (i, j)
                    first += len(q)


def _histograms(shared, k: int, bins: int, span: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each query's range by bin, from the top down until these rows alone have k: lower bins can't hold
        the k-th value of all. What lies over the range was counted in an earlier pass."""
        group: _Group = shared.value
        counts = np.zeros(group.size * bins, np.int64)
        for at, _, _, keys, _, own in group.scored(batches):
            lo = group.lo[at][:, None]
            # counted from the range's start; smaller keys wrap around to huge numbers
            far = keys - lo
            ok = keys >= lo
            if span < 2**64:
                ok &= far < np.uint64(span)
            ok[own] = False
            bin_of = (far // np.uint64(width)).astype(np.int64) + (at * bins)[:, None]
            counts += np.bincount(bin_of[ok], minlength=len(counts))
        counts = counts.reshape(group.size, bins)
        upto = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        q, b = np.nonzero((counts > 0) & (upto - counts < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], ["q", "bin", "n"])

    return run


def _winners(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What may be among the best: keys over the k-th value, and of those equal to it the k best of these rows."""
        group: _Group = shared.value
        wide = group.scale.wide
        held: dict[int, list[tuple]] = {}
        for at, row, ids, keys, s, own in group.scored(batches):
            ok = keys >= group.lo[at][:, None]
            ok[own] = False
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
                best = held.setdefault(int(at[i]), [])
                best.append((-int(s[i, j]), int(ids[j]), int(row[j])))
                if len(best) > 4 * k + 64:  # only the k best of one task can be among those of all
                    best.sort()
                    del best[k:]
        out: dict[str, list] = {c: [] for c in ("q", "vec_id", "row", "score", "exact")}
        for q, best in held.items():
            for s, i, r in sorted(best)[:k]:
                for x, v in zip(out.values(), (q, i, r, min(max(-s, LONG_MIN), LONG_MAX), _sortable(-s) if wide else "")):
                    x.append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64()), ("exact", pa.string())]))

    return run


def _best_of(table: DataFrame, group: _Group, k: int, bins: int) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score) of one group, after narrowing its ranges pass by pass."""
    spark = table.sparkSession
    rows = table.select("row", "id", "v")
    span = group.scale.span
    down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # at most bins rows a query
    while span > 1:
        width = -(-span // bins)
        shared = spark.sparkContext.broadcast(group)
        counts = rows.mapInArrow(_histograms(shared, k, bins, span, width), "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = spark.createDataFrame([(int(q), int(n)) for q, n in enumerate(group.above)], "q bigint, above bigint")
        hits = counts.withColumn("cum", F.sum("n").over(down)).join(F.broadcast(above), "q").filter(F.col("above") + F.col("cum") >= k)
        hits = hits.groupBy("q").agg(F.max_by(F.struct("bin", (F.col("cum") - F.col("n")).alias("over")), "bin").alias("b")).collect()  # a row a query
        # a query with fewer than k candidates has no such bin, and keeps them all
        for r in hits:
            group.lo[r["q"]] += np.uint64(r["b"]["bin"] * width)
            group.above[r["q"]] += r["b"]["over"]
        span = width
        shared.unpersist()
    ids = spark.createDataFrame([(q, int(i)) for q, i in enumerate(group.ids)], "q bigint, query_id bigint")
    found = rows.mapInArrow(_winners(spark.sparkContext.broadcast(group), k), "q bigint, vec_id bigint, row bigint, score bigint, exact string")
    best = Window.partitionBy("q").orderBy(F.desc("exact"), F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(F.broadcast(ids), "q").select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, bins: int = 512, query_group: int = 16_384) -> DataFrame:
    """Each query's k best rows: query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    A query's own row is no candidate; other rows of the same id are, and each row that is a query has its own k
    rows. Null vectors and those with null or non-finite components take no part; neither do null ids. Components of
    any size count exactly; a score that leaves 64 bits is shown as the nearest bound of these. Vectors meet those of
    their own length only; empty vectors score 0. Other columns are ignored; an empty table gives none. Queries go to
    the workers in groups of about query_group.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fits = F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))), F.lit(False))
    table = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), v.alias("v"), fits.alias("fits"))
    table = save(table.filter("fits AND id IS NOT NULL").drop("fits"), "topk-vectors")
    # Cauchy-Schwarz bounds every score
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    n, most = table.agg(F.count(F.when(F.col("query"), 1)), F.max(norm)).first()
    groups = -(-n // query_group)
    own_scale = Scale(scale, math.inf if most is None else most)

    def parts() -> Iterator[DataFrame]:
        for g in range(groups):
            queries = table.filter(F.col("query") & (F.pmod(F.xxhash64("row"), F.lit(groups)) == g)).select("row", "id", "v").toArrow()
            if queries.num_rows:
                yield _best_of(table, _Group(queries, own_scale), k, bins)

    return save_parts(table.sparkSession, parts(), "query_id bigint, rank int, vec_id bigint, score bigint", "topk-found")
