"""N-gram Jaccard join by size-aware heavy-light search; components of linked documents, exactly.

Equal sets are one node. Small sets enumerate their subsets of the sizes that a partner has to share; sets with a
subset in common link. Large sets go through inverted lists of single shingles; the boundary between both is chosen
by cost. The lists of all large sets are built once, and shingles of one set only are dropped. A set's shingles then
stand in the order of their lists' lengths: two linked sets have one in common among the first few of each, by
their sizes and the places there, so only these few lists are scanned, and frequent shingles, such as those of a
passage that many documents share, are scanned for the sets alone that consist of them. A list isn't scanned in
pairs: its members are compared with one of them, the most central, round after round; what is left are members of
different components, which are compared if sizes, places, and parity bitmaps allow a link.

Shingles are 64-bit hashes. Sets are told apart by 128 bits and their sizes, in the lists by 64 of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from .common import save, small_enough, tidy, unused

U = np.uint64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words that a worker remembers the hashes of.
KNOWN_WORDS = 60_000
#: Rounds of comparison with central members before what is left is compared.
HUB_ROUNDS = 3
#: Parity bitmaps of shared shingles have so many words of 64 bits: sets differ in as many of them as their bitmaps at least.
BITMAP = 16
BITS = [f"b{k}" for k in range(BITMAP)]
#: Postings that a worker deals to buckets at once; postings of a bucket, about, and buckets at least.
FLUSH, BUCKET, LEAST_BUCKETS = 1 << 21, 1 << 21, 16
#: Shingles in more than one of so many documents have lists too hot for one bucket, and are counted apart: at most
#: HOT_LISTS of them, the most frequent. They are told by counts over so many documents at once.
HOT_SHARE, HOT_LISTS, HOT_DOCS = 512, 1 << 17, 8192
#: Up to so many sizes and bitmaps, of 160 bytes each, are broadcast to pairs; and so many rows' keys, of 24, to rows.
SMALL_SETS, SMALL_KEYS = 100_000, 1_000_000


class Threshold:
    """Sets link if their Jaccard similarity is at least part / whole."""

    def __init__(self, part: int = 90, whole: int = 100):
        self.part, self.whole = part, whole

    def shared(self, both: int) -> int:
        """The fewest shared elements of two linked sets with that many elements together."""
        return -(-self.part * both // (self.part + self.whole))

    def partners(self, n: int) -> range:
        return range(-(-self.part * n // self.whole), self.whole * n // self.part + 1)

    def subset_sizes(self, n: int) -> list[int]:
        return sorted({self.shared(n + k) for k in self.partners(n)})

    def scanned(self, n: int) -> int:
        """The shingles, from the rarest on, whose lists a set of that size scans: any partner has one of them."""
        return n - self.shared(n + self.partners(n)[0]) + 1

    def boundary(self) -> int:
        """The largest size whose subsets cost no more than a posting of each shingle and the lists to scan."""
        n = 1
        while sum(math.comb(n + 1, c) for c in self.subset_sizes(n + 1)) <= n + 1 + self.scanned(n + 1):
            n += 1
        return n

    def listed(self) -> int:
        """The least size of a set in lists: smaller ones have no partner over the boundary."""
        return self.partners(self.boundary() + 1)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_hashes = _Words()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; with fewer words, of all of them as one."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # at ASCII white space
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    if len(h) < size:
        h = np.concatenate([h, np.full(1, len(h), np.uint64)])
        out = mix(h[:1] + U(size))
        for x in h[1:]:
            out = mix(out * U(0x9E3779B97F4A7C15) + x)
        return out
    out = mix(h[: len(h) - size + 1])
    for k in range(1, size):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def fingerprint(h: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mix(h).sum(dtype=np.uint64), mix(h ^ U(0xD1B54A32D192ED03)).sum(dtype=np.uint64)


def subsets(h: np.ndarray, threshold: Threshold) -> list[tuple[int, int, int]]:
    """(size, key, key) of the subsets of each size that a partner may have to share; both keys are 128 bits of it."""
    f, g = ([int(x) for x in mix(h + U(tag))] for tag in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    all_f, all_g, out = sum(f), sum(g), []
    for c in threshold.subset_sizes(len(h)):
        if c <= len(h):
            for gone in itertools.combinations(range(len(h)), len(h) - c):
                out.append((c, (all_f - sum(f[i] for i in gone)) & (2**64 - 1), (all_g - sum(g[i] for i in gone)) & (2**64 - 1)))
    return out


def _signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def facts(docs: DataFrame, size: int, threshold: Threshold) -> DataFrame:
    """Per row: id, t1, t2, n, the set's fingerprint f1 and f2, and the subsets of small sets. Besides, with n = -1,
    shingles f1 that f2 of some thousand documents have, if these are a good part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = threshold.boundary()
        names = ["id", "t1", "t2", "n", "f1", "f2", "subs"]
        kind = pa.list_(pa.struct([("c", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]))
        held: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            """What the documents seen since last time have in common; each has a shingle once."""
            u, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            u, c = (x[c >= max(8, 2 * len(held) // HOT_SHARE)] for x in (u, c))
            held.clear()
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(u), pa.int64())] * 3, pa.array(np.full(len(u), -1)), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(u), kind)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, f1, f2, subs = [], [], [], []
                for text in part.column("text").to_pylist():
                    h = shingles(text, size)
                    n.append(len(h))
                    a, b = fingerprint(h)
                    f1.append(a)
                    f2.append(b)
                    own = subsets(h, threshold) if 0 < len(h) <= small else []
                    subs.append([{"c": c, "k1": x, "k2": y} for (c, _, _), x, y in zip(own, _signed([x for _, x, _ in own]).tolist(), _signed([y for _, _, y in own]).tolist())])
                    held.append(h)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(n, pa.int64()), pa.array(_signed(f1)), pa.array(_signed(f2)), pa.array(subs, kind)], names)
                if len(held) >= HOT_DOCS or sum(map(len, held)) >= FLUSH:
                    yield frequent()
        if held:
            yield frequent()
        _hashes.clear()
        tidy()

    return docs.mapInArrow(run, "id bigint, t1 bigint, t2 bigint, n bigint, f1 bigint, f2 bigint, subs array<struct<c:bigint,k1:bigint,k2:bigint>>")


# --- inverted lists: postings go through two shuffles, in blocks: by shingle, and those of two sets at least by set

#: A block of postings: sets by their names, with their sizes and numbers of postings here; the shingles, and their
#: counts if known. Shingles whose first bits the bucket tells have the last 7 bytes only; bits that get lost (4 at most)
#: count for none.
BLOCK = "bucket bigint, names binary, sizes binary, runs binary, hashes binary, counts binary"
_BLOCK = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("names", "sizes", "runs", "hashes", "counts"))])


def _blocks(bucket: np.ndarray, own: np.ndarray, names: np.ndarray, sizes: np.ndarray, h: np.ndarray, counts: np.ndarray | None) -> pa.RecordBatch:
    """Postings (bucket, place of the set, shingle), in the order of the sets, as a block for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, own, h = bucket[order], own[order], h[order]
    counts = None if counts is None else counts[order].astype(np.int32)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    out: dict[str, list] = {f.name: [] for f in _BLOCK}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        first = np.flatnonzero(np.concatenate([[True], own[a + 1 : b] != own[a : b - 1]]))
        at = own[a + first]
        row = (int(bucket[a]), names[at].tobytes(), sizes[at].astype(np.int32).tobytes(), np.diff(np.append(first, b - a)).astype(np.int32).tobytes(), h[a:b].tobytes() if counts is not None else h[a:b].view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), b"" if counts is None else counts[a:b].tobytes())
        for x, v in zip(out.values(), row):
            x.append(v)
    return pa.RecordBatch.from_pydict(out, schema=_BLOCK)


def _postings(table: pa.Table, first_bits: int | None = None) -> tuple[np.ndarray, ...]:
    """(name, size, shingle, count) of all postings of a bucket's blocks; first_bits: those that the bucket tells."""
    whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    runs = whole("runs", np.int32)
    if first_bits is None:
        h = whole("hashes", np.uint64)
    else:
        last = whole("hashes", np.uint8).reshape(-1, 7)
        h = np.concatenate([last, np.zeros((len(last), 1), np.uint8)], axis=1).view(np.uint64).ravel()
        h |= U(table.column("bucket")[0].as_py()) << U(64 - first_bits)
    return np.repeat(whole("names", np.uint64), runs), np.repeat(whole("sizes", np.int32), runs), h, whole("counts", np.int32)


def _by_shingle(docs: DataFrame, size: int, threshold: Threshold, bits: int, hot) -> DataFrame:
    """Blocks of the postings of all large sets, by the first bits of the shingle. Hot shingles, whose counts are known,
    go by their sets right away, to buckets under 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, (hot_h, hot_n) = threshold.listed(), hot.value
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            names, sets = np.array(list(held), np.uint64), list(held.values())
            sizes = np.array([len(x) for x in sets], np.int64)
            h, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            held.clear()
            at = np.minimum(np.searchsorted(hot_h, h), max(0, len(hot_h) - 1))
            is_hot = hot_h[at] == h if len(hot_h) else np.zeros(len(h), bool)
            yield _blocks((h[~is_hot] >> U(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64), own[~is_hot], names, sizes, h[~is_hot], None)
            if is_hot.any():
                own, at = own[is_hot], at[is_hot]
                yield _blocks(-1 - (names >> U(64 - bits)).astype(np.int64)[own], own, names, sizes, h[is_hot], hot_n[at])

        total = 0
        for batch in batches:
            for text in batch.column("text"):
                h = shingles(text.as_py(), size)
                if len(h) >= listed and (name := int(fingerprint(h)[0])) not in held:
                    held[name] = h
                    total += len(h)
                    if total >= FLUSH:
                        yield from out()
                        total = 0
        if held:
            yield from out()
        _hashes.clear()
        tidy()

    return docs.mapInArrow(run, BLOCK)


def _by_set(bits: int):
    """Blocks by the first bits of the set's name, of the postings whose shingle two sets have at least."""

    def run(table: pa.Table) -> pa.Table:
        known = table.column("bucket")[0].as_py() < 0
        names, sizes, h, counts = _postings(table, None if known else bits)
        if not known:
            order = np.argsort(h, kind="stable")
            s = h[order]
            alike = s[1:] == s[:-1]
            order = order[np.concatenate([[False], alike]) | np.concatenate([alike, [False]])]
            order = order[np.lexsort((names[order], h[order]))]  # equal sets of several workers are one
            order = order[np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (h[order][1:] != h[order][:-1])])] if len(order) else order
            _, back, n = np.unique(h[order], return_inverse=True, return_counts=True)
            order, counts = order[n[back] > 1], n[back][n[back] > 1]
            names, sizes, h = names[order], sizes[order], h[order]
        order = np.argsort(names, kind="stable")
        names, sizes, h, counts = names[order], sizes[order], h[order], counts[order]
        first = np.concatenate([[True], names[1:] != names[:-1]])[: len(names)]
        own = np.cumsum(first) - 1
        return pa.Table.from_batches([_blocks((names >> U(64 - bits)).astype(np.int64), own, names[first], sizes[first], h, counts)])

    return run


def _sets(threshold: Threshold):
    """(id, n, tokens, b0 to b15): sets of which enough is shared for a link, their shared shingles from the rarest on."""

    def run(table: pa.Table) -> pa.Table:
        names, sizes, h, counts = _postings(table)
        order = np.lexsort((h, counts, names))
        names, sizes, h = names[order], sizes[order], h[order]
        new = np.concatenate([[True], (names[1:] != names[:-1]) | (h[1:] != h[:-1])])[: len(names)]
        names, sizes, h = names[new], sizes[new], h[new]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])[: len(names)])
        ends = np.append(first[1:], len(names))
        out: dict[str, list] = {c: [] for c in ("id", "n", "tokens", *BITS)}
        for a, b in zip(first.tolist(), ends.tolist()):
            n = int(sizes[a])
            if (b - a) * threshold.whole >= n * threshold.part:
                own = h[a:b]
                bits = np.packbits((np.bincount((own & U(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1).astype(np.uint8)).view(np.int64)
                for x, v in zip(out.values(), (int(names[a : a + 1].view(np.int64)[0]), n, own.view(np.int64), *bits.tolist())):
                    x.append(v)
        return pa.table({"id": pa.array(out["id"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "tokens": pa.array(out["tokens"], pa.list_(pa.int64())), **{c: pa.array(out[c], pa.int64()) for c in BITS}})

    return run


def _subset_links(nodes: DataFrame, t: Threshold) -> DataFrame:
    """Links (a, b) of small sets: whatever shares a subset links with the smallest set that has it."""
    subs = save(nodes.filter(F.size("subs") > 0).select("id", "n", F.explode("subs").alias("s")).select("id", "n", "s.c", "s.k1", "s.k2"), "jaccard-subsets")
    keys = ["c", "k1", "k2"]
    hubs = subs.groupBy(*keys).agg(F.min(F.struct("n", "id")).alias("hub"), F.count("*").alias("m")).filter("m > 1").select(*keys, F.col("hub.id").alias("a"), F.col("hub.n").alias("na"))
    found = subs.join(hubs, keys).filter((F.col("a") != F.col("id")) & (F.col("c") * (t.part + t.whole) >= (F.col("na") + F.col("n")) * t.part))
    return save(found.select("a", F.col("id").alias("b")).distinct(), "jaccard-small")


def _large_sets(texts: DataFrame, size: int, t: Threshold, total: int, hot: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    bits = (max(LEAST_BUCKETS, -(-total // BUCKET)) - 1).bit_length()
    rows = hot.orderBy(F.desc("m"), "f1").limit(HOT_LISTS).collect()
    n = np.array([r["m"] for r in rows], np.int64)
    h = np.array([r["f1"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((h[order], n[order]))
    blocks = _by_shingle(texts, size, t, bits, shared).groupBy("bucket").applyInArrow(_by_set(bits), BLOCK)
    return save(blocks.groupBy("bucket").applyInArrow(_sets(t), f"id bigint, n bigint, tokens array<bigint>, {', '.join(f'{b} bigint' for b in BITS)}"), "jaccard-sets")


def _list_links(sets: DataFrame, links: DataFrame, t: Threshold) -> DataFrame:
    """links and those that the lists bring; at the end, sets that link are in one component."""
    part, both = t.part, t.part + t.whole
    alone = F.col("n") - F.size("tokens")  # shingles that no other set has, the rarest of all
    about = sets.select("id", "n", alone.alias("alone"), *BITS)
    facts_of = small_enough(about, SMALL_SETS)
    # a set of n scans n - s + 1 lists, s being the fewest shingles that its smallest partner shares
    least = F.expr(f"({part} * (n + ({part} * n + {t.whole - 1}) div {t.whole}) + {both - 1}) div {both}")
    scan = F.col("n") - least + 1 - alone
    entries = sets.filter(scan > 0).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("tokens", F.lit(1), scan.cast("int"))).alias("k", "key"))
    entries = save(entries.select("key", "id", "n", "alone", (F.col("alone") + F.col("k")).alias("at")), "jaccard-lists")

    def may_link(a: Column, b: Column) -> Column:
        apart = a["alone"] + b["alone"] + sum((F.bit_count(a[c].bitwiseXOR(b[c])) for c in BITS), F.lit(0))
        return (a["n"] * t.whole >= b["n"] * part) & (b["n"] * t.whole >= a["n"] * part) & (apart * both <= (a["n"] + b["n"]) * (t.whole - part))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link: what two sets share, both share with another set, so it is in their tokens."""
        for c in ("a", "b"):
            pairs = pairs.join(facts_of.select(F.col("id").alias(c), F.struct("n", "alone", *BITS).alias(f"of_{c}")), c)
        pairs = save(pairs.filter(may_link(F.col("of_a"), F.col("of_b"))).select("a", "b", F.col("of_a.n").alias("na"), F.col("of_b.n").alias("nb")), "jaccard-pairs")
        tokens = lambda c, x: sets.select(F.col("id").alias(c), F.col("tokens").alias(x))
        found = pairs.join(tokens("a", "x"), "a").join(tokens("b", "y"), "b").withColumn("o", F.size(F.array_intersect("x", "y")))
        return found.filter(F.col("o") * t.whole >= (F.col("na") + F.col("nb") - F.col("o")) * part).select("a", "b")

    def placed(links: DataFrame) -> DataFrame:
        return entries.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))

    def open_lists(members: DataFrame, hub: Column) -> DataFrame:
        """Lists with members in several components, and a hub of each."""
        return members.groupBy("key").agg(F.min(hub).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key", "hub")

    for turn in range(HUB_ROUNDS):
        members = placed(links)
        # sets with few shingles of their own are the likeliest centres; later turns try other components
        central = F.struct(F.floor(F.col("alone") * 64 / F.col("n")).alias("c"), "id", "component")
        hub = F.struct(F.xxhash64(F.lit(turn), "component").alias("h"), central.alias("of")) if turn else F.struct(F.lit(0).cast("bigint").alias("h"), central.alias("of"))
        pairs = members.join(open_lists(members, hub), "key").filter(F.col("hub.of.component") != F.col("component"))
        pairs = pairs.select(F.least("hub.of.id", "id").alias("a"), F.greatest("hub.of.id", "id").alias("b")).distinct()
        links = save(links.unionByName(linked(pairs)), "jaccard-links")
    members = placed(links)
    # members of one list in different components: a shared shingle's places bound what two sets may share
    folds = [F.col(b).bitwiseXOR(F.col(f"b{k + 4}")).bitwiseXOR(F.col(f"b{k + 8}")).bitwiseXOR(F.col(f"b{k + 12}")).alias(b) for k, b in enumerate(BITS[:4])]
    left = members.join(open_lists(members, F.col("id")).select("key"), "key", "left_semi")
    left = save(left.join(about.select("id", *folds), "id"), "jaccard-left")
    p, q = left.alias("p"), left.alias("q")
    n, m = F.col("p.n"), F.col("q.n")
    room = F.least(n - F.col("p.at"), m - F.col("q.at")) * both >= (n + m) * part
    apart = F.col("p.alone") + F.col("q.alone") + sum((F.bit_count(F.col(f"p.{c}").bitwiseXOR(F.col(f"q.{c}"))) for c in BITS[:4]), F.lit(0))
    rest = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.component") < F.col("q.component")) & room & (n * t.whole >= m * part) & (m * t.whole >= n * part) & (apart * both <= (n + m) * (t.whole - part)))
    pairs = rest.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()
    return links.unionByName(save(linked(pairs), "jaccard-links"))


def _judged(docs: DataFrame, size: int, t: Threshold) -> DataFrame:
    """Per row of docs: id, t1, t2, n, component_id, and a name of the component; t1 and t2 tell texts apart. Two
    components may have the same id if different texts share one, but not the same name."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), *_text_keys("t1", "t2"), "text")
    every = save(facts(texts, size, t), "jaccard-facts")
    rows = every.filter("n >= 0")
    known = rows.filter((F.col("n") > 0) & F.col("id").isNotNull())
    # equal sets are one node
    nodes = save(known.groupBy("f1", "f2", "n").agg(F.min("id").alias("least"), F.first("subs").alias("subs")), "jaccard-nodes").withColumn("id", F.col("f1"))
    large = nodes.filter(F.col("n") >= t.listed()).agg(F.sum("n")).first()[0] or 0
    links = _subset_links(nodes, t)
    hot = every.filter("n < 0").groupBy("f1").agg(F.sum("f2").alias("m")).filter(F.col("m") * HOT_SHARE >= every.filter("n >= 0").count())
    links = _list_links(_large_sets(texts.filter("id IS NOT NULL").select("text"), size, t, large, hot), links, t)
    labels = save(components(links), "jaccard-components")

    named = nodes.select("f1", "f2", "n", "least").join(labels.withColumnRenamed("id", "f1"), "f1", "left")
    named = save(named, "jaccard-named")
    ids = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "component", "left").select("f1", "f2", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "f1").alias("name"))
    found = known.join(of, ["f1", "f2", "n"]).select("id", "t1", "t2", "n", "component_id", "name")
    alone = rows.filter((F.col("n") == 0) | F.col("id").isNull()).select("id", "t1", "t2", "n", F.col("id").alias("component_id"), F.col("f1").alias("name"))
    return found.unionByName(alone)


def _text_keys(a: str, b: str) -> list[Column]:
    return [F.xxhash64("text").alias(a), F.xxhash64(F.lit(2), F.col("text")).alias(b)]


def jaccard_components(docs: DataFrame, *, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per document; documents link where the Jaccard similarity of their
    sets of word shingles is at least part / whole, and component_id is the smallest doc_id that links reach.

    A null text, or one without words, has an empty set and links with nothing; a text of fewer words than a
    shingle has all of them as one. Equal texts link whatever their ids; rows that share an id are judged each by
    its own text. Rows with a null id take no part and have no component. An empty table gives none; other columns
    are ignored.
    """
    rows = _judged(docs, size, Threshold(part, whole))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def without_near_duplicates(docs: DataFrame, *, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, of rows that share it one text's.

    Rows with a null id stay, and so do texts without words. Of rows with the same id and text one stays. Columns of
    any names stay as they are; an empty table gives none.
    """
    rows = save(_judged(docs, size, Threshold(part, whole)).filter("n > 0 AND id IS NOT NULL").drop("n"), "jaccard-judged")
    first = rows.groupBy("name").agg(F.min(F.struct("id", "t1", "t2")).alias("first"))
    gone = rows.join(first, "name").filter(F.struct("id", "t1", "t2") != F.col("first")).select("id", "t1", "t2").distinct()
    again = rows.groupBy("id", "t1", "t2").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    key = unused(docs, "id", "t1", "t2")
    # keys are small beside texts, which move only where there are too many of these
    named = lambda keys: small_enough(save(keys.toDF(*key), "jaccard-keys"), SMALL_KEYS)
    gone, again = named(gone), named(again)
    kept = docs.withColumn(key[0], F.col("doc_id").cast("bigint")).withColumns(dict(zip(key[1:], _text_keys(*key[1:])))).join(gone, key, "left_anti")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
    (n,) = unused(kept, "n")
    several = kept.join(again, key, "left_semi").withColumn(n, nth).filter(F.col(n) == 1).drop(n)
    return kept.join(again, key, "left_anti").unionByName(several).select(docs.columns)
