"""Token counts of whole documents: pieces are counted once per distinct pre-token, then summed by frequency.

The splitting pattern runs once over each text, in Spark's own regular expressions; what is written is each document's
table of pre-tokens and their frequencies. Pre-tokens that are frequent in the corpus, up to a fixed number of them,
meet these tables in a broadcast join, the rest in a shuffled one. Long pre-tokens are joined by a hash, so that the
broadcast's size is bounded, whatever they are. So no key is hot, and the vocabulary may grow without bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save
from .encode import library

#: White space as the byte-level pre-tokenizer's pattern has it; Java's \s is narrower.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The byte-level pre-tokenizer's pattern (fixed by the library), with that class.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters that Java's Unicode tables don't know; a newer library may class them otherwise.
UNKNOWN = r"\p{Cn}"
#: At most so many pre-tokens are broadcast; those of more than so many characters go by a 256-bit hash.
FREQUENT, LONGEST = 1 << 18, 64
#: Rows of texts whose pre-tokens are counted at once.
ROWS = 500


def pre_tokens(text: Column, special: list[str]) -> Column:
    """A text's pre-tokens in order; a special token's string parts the text and is none itself."""
    text = F.coalesce(text, F.lit(""))
    find = lambda x: F.regexp_extract_all(x, F.lit(SPLIT), F.lit(0))
    if not special:
        return find(text)
    parted = F.split(text, "|".join(rf"\Q{s}\E" for s in special))
    return F.when(F.size(parted) == 1, find(text)).otherwise(F.flatten(F.transform(parted, find)))


def n_special(text: Column, special: list[str]) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.size(F.split(text, "|".join(rf"\Q{s}\E" for s in special))) - 1 if special else F.lit(0)


def _frequencies(tokenizer: str):
    """Each row's distinct pre-tokens and their frequencies; rows with a whole text have its pieces instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists, whole, fixed = part.column("tokens"), part.column("whole").to_pylist(), part.column("fixed").to_pylist()
                for i, text in enumerate(whole):
                    if text is not None:
                        lib = lib or library(tokenizer)
                        fixed[i] = len(lib.encode(text, add_special_tokens=False).ids)
                values = lists.flatten().dictionary_encode()
                size = np.array([len(x) if x.is_valid else 0 for x in lists])
                n = max(1, len(values.dictionary))
                key = np.repeat(np.arange(len(size)), size) * n + values.indices.to_numpy()
                key, count = np.unique(key, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(size) + 1) * n).astype(np.int32))
                tokens = pa.ListArray.from_arrays(ends, values.dictionary.take(pa.array(key % n)))
                counts = pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "n_bytes")), pa.array(fixed, pa.int64()), tokens, counts], ["row", "doc_id", "n_bytes", "fixed", "tokens", "ns"])

    return run


def _pieces(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = [a if b is None else b for a, b in zip(part.column("key").to_pylist(), part.column("long").to_pylist())]
                n = [len(e.ids) for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), pa.array(n, pa.int64())], ["key", "n", "pieces"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row for each row of docs.

    A null text counts as empty: no bytes, no tokens. Special tokens' strings in a text count one each, as in the
    library's default. Rows are counted one by one, whatever their ids, repeated ones too. An empty table gives none;
    other columns are ignored. Texts with characters that Spark's tables don't know are counted by the library whole.
    """
    special = [t.content for t in library(tokenizer).get_added_tokens_decoder().values()]
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, odd = F.col("text"), F.col("text").rlike(UNKNOWN)
    split = own.select("row", "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), n_special(text, special).cast("bigint").alias("fixed"), F.when(odd, text).alias("whole"), F.when(~odd, pre_tokens(text, special)).alias("tokens"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = save(split.mapInArrow(_frequencies(tokenizer), f"row bigint, doc_id {kind}, n_bytes bigint, fixed bigint, tokens array<string>, ns array<bigint>"), "tokens-frequencies")

    is_long = F.length("token") > LONGEST
    key = F.when(is_long, F.concat(F.lit("\0"), F.sha2("token", 256))).otherwise(F.col("token")).alias("key")
    tokens = rows.select("row", F.explode(F.arrays_zip("tokens", "ns")).alias("t")).select("row", F.col("t.tokens").alias("token"), F.col("t.ns").alias("n")).select("row", key, "n", F.when(is_long, F.col("token")).alias("long"))
    distinct = tokens.groupBy("key").agg(F.sum("n").alias("n"), F.max("long").alias("long"))
    vocabulary = save(distinct.mapInArrow(_pieces(tokenizer), "key string, n bigint, pieces bigint"), "tokens-vocabulary")
    # the count from which on pre-tokens are frequent, by a histogram of at most some 1000 rows
    bucket = F.floor(F.log2("n") * 16).cast("int")
    room, least = FREQUENT, None
    for r in sorted(vocabulary.groupBy(bucket.alias("b")).count().collect(), key=lambda r: -r["b"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["b"]
    is_frequent = bucket >= F.lit(least) if least is not None else F.lit(False)
    frequent = F.broadcast(vocabulary.filter(is_frequent).select("key", "pieces"))
    rare = vocabulary.filter(~is_frequent).select("key", "pieces")

    used = tokens.drop("long")
    total = lambda joined, name: joined.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias(name))
    common = total(used.join(frequent, "key"), "common")
    rest = total(used.join(frequent, "key", "left_anti").join(rare, "key"), "rare")
    sums = rows.select("row", "doc_id", "n_bytes", "fixed").join(common, "row", "left").join(rest, "row", "left")
    n_tokens = F.col("fixed") + F.coalesce("common", F.lit(0)) + F.coalesce("rare", F.lit(0))
    return sums.select("doc_id", "n_bytes", n_tokens.cast("bigint").alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
