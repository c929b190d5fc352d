"""Removal of repeated byte strings by external induced suffix sorting with common-prefix values.

Every string of a given length holds a sampled position, its anchor: the place of the least hash of a few bytes
among its first ones. Strings at different places are equal only if their anchors are, so suffixes that start at
anchors stand for all others, as in induced sorting the sampled suffixes do. Anchors whose following bytes occur
nowhere else are dropped. The suffixes of the rest are sorted on disk, by Spark's merging sorter, with the values of
their common prefixes; from their order, that of the strings that start one byte before is induced, then two
bytes before, and so on: two strings are equal if the bytes before their anchors are equal so far and their suffixes
have the rest in common. Order beyond the length sought never matters, so one level of sampling ends the recursion.

The same order answers for a shorter length, too: passages of fewer bytes that several documents have are reported, not
removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Bytes hashed for an anchor, and how many places compete.
GRAM, PLACES = 8, 192
#: Bytes that are searched for anchors at once.
TILE = 1 << 18
#: A group of more contexts is counted string by string over all workers, rather than sorted by one.
LARGE_GROUP = 20_000
#: Contexts that a worker sorts out together.
BATCH = 20_000

#: Passages: so many whole words within bytes that strings of so many bytes cover which another document has, too.
PASSAGE_BYTES, PASSAGE_WORDS = 256, 50

U = np.uint64
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _places(data: np.ndarray) -> np.ndarray:
    """For each start, the leftmost place of the least hash among PLACES places from there on."""
    pairs = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << 8
    fours = pairs[:-2].astype(np.uint32) | pairs[2:].astype(np.uint32) << 16
    grams = fours[:-4].astype(np.uint64) | fours[4:].astype(np.uint64) << U(32)
    h = grams * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    key = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while 2 * done <= PLACES:
        key = np.minimum(key[: len(key) - done], key[done:])
        done *= 2
    if rest := PLACES - done:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    return (key & U(0xFFFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) over the strings of that length within the given pieces of data.

    An anchor serves one unbroken run of starts, for within a piece a later start never has an earlier anchor.
    """
    at, lo, hi = [], [], []
    for tile in range(0, len(data), TILE):
        own = data[tile : tile + TILE + length]
        if len(own) < length:
            break
        place = _places(own)[:TILE] + tile
        i = np.arange(tile, tile + len(place))
        piece = np.searchsorted(starts, i, side="right") - 1
        ok = i + length <= ends[piece]
        i, place, piece = i[ok], place[ok], piece[ok]
        if len(i):
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])]))
            at.append(place[first])
            lo.append(i[first])
            hi.append(i[np.concatenate([first[1:], [len(i)]]) - 1])
    if not at:
        return (np.zeros(0, np.int64),) * 3
    at, lo, hi = (np.concatenate(x) for x in (at, lo, hi))
    keep = np.concatenate([[True], (at[1:] != at[:-1]) | (lo[1:] != hi[:-1] + 1)])  # runs over a tile's end go on
    keep |= np.isin(lo, starts)
    first = np.flatnonzero(keep)
    return at[first], lo[first], hi[np.concatenate([first[1:], [len(at)]]) - 1]


def _anchor_rows(length: int):
    right = length - PLACES + 1  # bytes after an anchor that are in every string it stands for

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, texts = (batch.column(c) for c in ("k1", "k2", "text"))
            at = 0
            while at < batch.num_rows:
                parts, size, first = [], 0, at
                while at < batch.num_rows and (not parts or size < TILE):
                    parts.append(texts[at].as_buffer())
                    size += parts[-1].size
                    at += 1
                whole = b"".join(parts)
                ends = np.cumsum([p.size for p in parts])
                starts = ends - [p.size for p in parts]
                order = np.flatnonzero(ends > starts)  # empty texts have no place of their own
                a, lo, hi = anchors(np.frombuffer(whole, np.uint8), starts[order], ends[order], length)
                own = order[np.searchsorted(starts[order], lo, side="right") - 1]
                view = memoryview(whole)
                f = np.fromiter((xxhash.xxh3_64_intdigest(view[x : x + right]) for x in a.tolist()), np.uint64, len(a)).view(np.int64)
                pick = pa.array(own + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f), k1.take(pick), k2.take(pick), pa.array((a - starts[own]).astype(np.int32)), pa.array((a - hi).astype(np.int32)), pa.array((a - lo).astype(np.int32))], ["f", "k1", "k2", "a", "lo", "hi"]
                )

    return run


def _contexts(length: int):
    """Each anchor's bytes from its earliest string's start to its last one's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: dict[str, list] = {k: [] for k in ("f", "left", "right", "lo", "hi", "k1", "k2", "a")}
                part = batch.slice(at, 64)
                for k1, k2, text, found in zip(*(part.column(c) for c in ("k1", "k2", "text", "found"))):
                    data = text.as_buffer().to_pybytes()
                    for x in found.as_py():
                        a, lo, hi = x["a"], x["lo"], x["hi"]
                        for name, v in zip(out, (x["f"], data[a - hi : a], data[a : a + length - lo], lo, hi, k1.as_py(), k2.as_py(), a)):
                            out[name].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("f", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int32())]))

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _edges(found: np.ndarray) -> list[list[tuple[int, int]]]:
    """The runs (first, last) of true values in each row; the last column is false."""
    out: list[list[tuple[int, int]]] = [[] for _ in found]
    edge = np.diff(np.concatenate([np.zeros((len(found), 1), np.int8), found.astype(np.int8)], axis=1), axis=1)
    for (i, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist()):
        out[i].append((a, b - 1))
    return out


def induce(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], lo: np.ndarray, hi: np.ndarray, owners: np.ndarray, length: int, passage: int) -> tuple[list, list]:
    """For each context, the runs (first, last) of offsets before the anchor at which its string of that length is another
    one's, too; and the same for strings of a passage's length, where the other one is another document's.

    Contexts come sorted by group and suffix. common holds the common prefix of each suffix with the one before;
    suffixes between which it never falls under length - offset have enough in common for that offset. Names of what
    stands before the anchors are induced from those of one byte less. owners: the document of each context, 0 for several.
    """
    n = len(rights)
    size = np.fromiter(map(len, rights), np.int64, n)
    common = np.array([0, *(_common(a, b) if g == h else 0 for a, b, g, h in zip(rights, rights[1:], groups, groups[1:]))])
    width = int(hi.max(initial=0))
    before = np.zeros((n, width + 1), np.uint8)
    for i, x in enumerate(lefts):
        if x:
            before[i, 1 : len(x) + 1] = np.frombuffer(x, np.uint8)[::-1]
    found, near = np.zeros((n, width + 2), bool), np.zeros((n, width + 2), bool)
    group = np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]]))
    owner = np.unique(np.append(owners, 0), return_inverse=True)[1]
    several = owner[:-1] == owner[-1]
    owner = owner[:-1]
    alive, name = np.arange(n), group.astype(np.int64)
    for o in range(width + 1):
        if o:
            name = np.unique(name * 256 + before[alive, o], return_inverse=True)[1]
        within = (lo[alive] <= o) & (o <= hi[alive])
        for long, seen in ((length, found), (passage, near)):
            cluster = np.cumsum(common < long - o)[alive]
            may = within & (size[alive] >= long - o)
            at = alive[may]
            _, inverse, count = np.unique(name[may] * (n + 1) + cluster[may], return_inverse=True, return_counts=True)
            if seen is found:
                seen[at, o] = count[inverse] > 1
            else:
                # one document alone owns a cluster if its least owner is its greatest, and no context has several
                least, most = np.full(len(count), n + 2), np.full(len(count), -1)
                np.minimum.at(least, inverse, owner[at])
                np.maximum.at(most, inverse, owner[at])
                shared = np.zeros(len(count), bool)
                np.logical_or.at(shared, inverse, several[at])
                seen[at, o] = (shared | (least < most))[inverse]
        # what no other context of its group has before its anchor so far is alone from here on
        _, inverse, count = np.unique(name, return_inverse=True, return_counts=True)
        stay = (count[inverse] > 1) & (hi[alive] > o)
        alive, name = alive[stay], name[stay]
        if not len(alive):
            break
    return _edges(found), _edges(near)


_OFFSETS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _solve(length: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            g, left, right, lo, hi, owner = (list(x) for x in zip(*(r[:6] for r in rows)))
            named = lambda runs: [[{"first": a, "last": b} for a, b in x] for x in runs]
            runs, near = induce(np.array(g, np.int64), left, right, np.array(lo), np.array(hi), np.array(owner, np.int64), length, passage)
            return pa.RecordBatch.from_pydict({"c": [r[6] for r in rows], "runs": named(runs), "near": named(near)}, schema=pa.schema([("c", pa.binary()), ("runs", _OFFSETS), ("near", _OFFSETS)]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("f", "left", "right", "lo", "hi", "owner", "c"))):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    return run


def _strings(lengths: tuple[int, ...]):
    """Each string of a context by a 128-bit hash, for groups too large for one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, lo, hi, owner, c in zip(*(batch.column(k).to_pylist() for k in ("left", "right", "lo", "hi", "owner", "c"))):
                whole = left + right
                for length in lengths:
                    offsets = range(max(lo, length - len(right)), hi + 1)
                    yield pa.RecordBatch.from_pydict(
                        {"w": [xxhash.xxh3_128_digest(whole[len(left) - o : len(left) - o + length]) for o in offsets], "long": pa.array([length] * len(offsets), pa.int32()), "c": [c] * len(offsets), "o": pa.array(offsets, pa.int32()), "owner": pa.array([owner] * len(offsets), pa.int64())},
                        schema=pa.schema([("w", pa.binary()), ("long", pa.int32()), ("c", pa.binary()), ("o", pa.int32()), ("owner", pa.int64())]),
                    )

    return run


def _merged(runs: list[dict]) -> list[list[int]]:
    spans: list[list[int]] = []
    for r in sorted(runs, key=lambda r: r["first"]):
        if spans and r["first"] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], r["end"])
        else:
            spans.append([r["first"], r["end"]])
    return spans


def _whole_words(data: bytes, first: int, end: int) -> int:
    """Words of data that lie within these bytes from end to end."""
    return sum(1 for m in WORDS.finditer(data, max(0, first - 1), min(len(data), end + 1)) if m.start() >= first and m.end() <= end)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes in runs (first, end), which overlap as they please; and whether near holds a passage."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("repeats_passage", pa.bool_())])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, text, copied, runs, near in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("copied").to_pylist(), part.column("runs").to_pylist(), part.column("near").to_pylist()):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                everything = [{"first": 0, "end": len(data)}]
                spans = _merged(everything if copied == "removed" else runs or [])
                passages = _merged(everything if copied else near or [])
                kept, last = [], 0
                for a, b in spans:
                    kept.append(data[last:a])
                    last = b
                kept.append(data[last:])
                row = (doc, len(data), sum(b - a for a, b in spans), len(spans), b"".join(kept), [{"first": a, "end": b} for a, b in spans], any(_whole_words(data, a, b) >= PASSAGE_WORDS for a, b in passages))
                for x, v in zip(out.values(), row):
                    x.append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        sha = [hashlib.sha256(x.as_buffer() if len(x.as_py()) else b"").hexdigest() for x in batch.column("kept")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [pa.array(sha), batch.column("repeats_passage")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats_passage"])


def repeated_runs(docs: DataFrame, length: int = 400, passage: int = PASSAGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """docs as (doc_id, text, k1, k2), k1 and k2 being a 128-bit key of the text; and per key: copied, runs, near.

    copied: the text is there more than once; "removed" if it is as long as a string, else "short". runs: (first, end) of
    the bytes that strings of that length cover which start anywhere else, too; near: the same for strings of a
    passage's length that another document has. Both are unsorted and may overlap.
    """
    least, longest = min(length, passage), max(length, passage)
    if least < PLACES + GRAM:
        raise ValueError(f"strings must have {PLACES + GRAM} bytes at least")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2"))
    long = keyed.filter(F.octet_length("text") >= least)
    several = long.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.first(F.octet_length("text")).alias("size")).filter("m > 1").select("k1", "k2", F.when(F.col("size") >= length, "removed").otherwise("short").alias("copied"))
    rows = long.select("k1", "k2", "text").mapInArrow(_anchor_rows(least), "f bigint, k1 bigint, k2 bigint, a int, lo int, hi int")

    def shared(rows: DataFrame) -> DataFrame:
        """Rows whose f is not theirs alone. Counts are summed before they are shuffled; the shared ones are written, so
        that both sides of the join come from a shuffle alone, and Spark may split those of a frequent f."""
        several = save(rows.groupBy("f").agg(F.count("*").alias("m")).filter("m > 1").select("f"), "suffix-shared-keys")
        return rows.join(several, "f", "left_semi")

    # equal texts' anchors go with the first selection as well, and are one in the second
    rows = shared(save(save(shared(rows), "suffix-shared").distinct(), "suffix-anchors"))
    found = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("f", "a", "lo", "hi")).alias("found"))  # one text's anchors
    texts = long.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    cut = texts.join(found, ["k1", "k2"]).mapInArrow(_contexts(longest), "f bigint, left binary, right binary, lo int, hi int, k1 bigint, k2 bigint, a int")
    # equal contexts are one; c names them
    cut = cut.withColumn("c", F.unhex(F.md5(F.concat(F.col("left"), F.lit(b"|"), F.col("right"), F.format_string("|%d|%d", "lo", "hi").cast("binary")))))
    cut = save(cut, "suffix-contexts", "zstd")  # contexts of one text overlap, and hardly take more room than it
    uses = cut.select("c", "k1", "k2", "a", "lo", "hi")
    owner = F.when(F.min("k1") == F.max("k1"), F.min("k1")).otherwise(F.lit(0)).alias("owner")
    distinct = cut.groupBy("f", "c").agg(F.count("*").alias("m"), *[F.first(x).alias(x) for x in ("left", "right", "lo", "hi")], owner)
    distinct = save(distinct, "suffix-distinct", "zstd")
    sizes = distinct.groupBy("f").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > LARGE_GROUP).select("f")
    run_type = "array<struct<first:int,last:int>>"
    none = F.array().cast(run_type)
    apart = distinct.join(large, "f", "left_anti").repartition("f").sortWithinPartitions("f", "right")
    solved = apart.select("f", "left", "right", "lo", "hi", "owner", "c").mapInArrow(_solve(length, passage), f"c binary, runs {run_type}, near {run_type}")
    strings = distinct.join(large, "f", "left_semi").select("left", "right", "lo", "hi", "owner", "c").mapInArrow(_strings((length, passage)), "w binary, long int, c binary, o int, owner bigint")
    elsewhere = (F.min("owner") < F.max("owner")) | (F.max(F.when(F.col("owner") == 0, 1).otherwise(0)) == 1)
    again = strings.groupBy("w", "long").agg(F.count("*").alias("m"), elsewhere.alias("elsewhere")).filter((F.col("long") == length) & (F.col("m") > 1) | (F.col("long") == passage) & F.col("elsewhere")).select("w", "long")
    at = lambda n: F.collect_list(F.when(F.col("long") == n, F.struct(F.col("o").alias("first"), F.col("o").alias("last"))))
    counted = strings.join(again, ["w", "long"], "left_semi").groupBy("c").agg(at(length).alias("runs"), at(passage).alias("near"))
    # a context that is there more than once is repeated as far as it goes, if it is long enough
    first = lambda n: F.greatest(F.col("lo"), n - F.octet_length("right"))
    upto = lambda n: F.when(first(n) <= F.col("hi"), F.array(F.struct(first(n).alias("first"), F.col("hi").alias("last")))).otherwise(none)
    alike = distinct.filter("m > 1").select("c", upto(length).alias("runs"), F.when(F.col("owner") == 0, upto(passage)).otherwise(none).alias("near"))
    offsets = solved.filter((F.size("runs") > 0) | (F.size("near") > 0)).unionByName(counted).unionByName(alike)
    bytes_of = lambda c, n: F.flatten(F.collect_list(F.transform(c, lambda r: F.struct((F.col("a") - r["last"]).cast("bigint").alias("first"), (F.col("a") - r["first"] + n).cast("bigint").alias("end")))))
    runs = uses.join(offsets, "c").groupBy("k1", "k2").agg(bytes_of("runs", length).alias("runs"), bytes_of("near", passage).alias("near"))
    return keyed, save(several.join(runs, ["k1", "k2"], "full").select("k1", "k2", "copied", "runs", "near"), "suffix-runs")


def remove_repeats(docs: DataFrame, length: int = 400, *, passage: int = PASSAGE_BYTES, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans, repeats_passage): a row per document; or, with digest, kept_sha256
    for kept and spans.

    Texts count as UTF-8 bytes. Every byte goes that is in a string of so many bytes which also starts elsewhere, in the
    same text or another; overlaps count, and strings never go over a text's end. kept holds what is left, spans the
    maximal removed runs (first, end). repeats_passage tells of documents with a passage of PASSAGE_WORDS whole words or
    more that another document has, too, found by strings of passage bytes. A null text counts as empty. Repeated rows
    are repeats of each other; an empty table gives none; other columns are ignored.
    """
    keyed, runs = repeated_runs(docs, length, passage)
    joined = keyed.join(runs, ["k1", "k2"], "left").select("doc_id", "text", "copied", "runs", "near")
    if digest:
        return joined.mapInArrow(_digested, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, repeats_passage boolean")
    return joined.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<first:bigint,end:bigint>>, repeats_passage boolean")
