"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, langid, licences, mixing, packing, pii, quality, suffixes, token_count, topk

#: Where the public vocabularies are; a parameter of the operators.
WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("placements", lambda p: F.concat_ws(":", p["pass"].cast("string"), p["shard"].cast("string"))), " ")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))
    return made.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_pii"))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.is_held_out(F.col("doc_id"))
    model = langid.train(docs.filter(F.coalesce(~held_out, F.lit(False))))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), 400, digest=True)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, part=90)


def _tree(shards: int) -> tuple[str, str]:
    """DuckDB SQL for the splitting tree over draws dr: a table for each level, and the last one's name."""
    number = lambda x: f"(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % 2147483648)"
    out, last = ["t0 AS (SELECT ord, block, pass, 0 AS lo, %d AS hi FROM dr)" % shards], "t0"
    for n in range(1, max(0, shards - 1).bit_length() + 1):
        out.append(
            f"r{n} AS (SELECT *, CAST(floor((lo + hi) / 2) AS INTEGER) AS mid, count(*) OVER (PARTITION BY lo, hi) AS total, "
            f"row_number() OVER (PARTITION BY lo, hi ORDER BY md5('mix-1|' || lo || '|' || hi || '|' || ord || '|' || block || '|' || pass), ord, block, pass) - 1 AS before FROM {last}), "
            f"l{n} AS (SELECT *, before < floor(total * (mid - lo) / (hi - lo) + ({number("'mix-1|' || lo || '|' || hi || '|coin'")} + 0.5) / 2147483648.0) AS at_left, hi - lo = 1 AS leaf FROM r{n}), "
            f"t{n} AS (SELECT ord, block, pass, CASE WHEN leaf OR at_left THEN lo ELSE mid END AS lo, CASE WHEN leaf OR NOT at_left THEN hi ELSE mid END AS hi FROM l{n})"
        )
        last = f"t{n}"
    return ",\n".join(out), last


_TREE, _LEAVES = _tree(64)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_best_fit_packing, op3_licence_scan, op4_mix_sources, op5_token_counts, op6_pseudonyms, op7_language_spans, op8_repeated_strings, op9_exact_top_k, op10_jaccard_join)
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality.oracle(),
    "op3_licence_scan": licences.oracle(),
    "op4_mix_sources": rf"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len({_WORDS}), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM s GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS ord, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM t),
w AS (SELECT *, CAST((ord - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM o),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY ratio, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS shared FROM l),
p AS (SELECT source, source_size, n_docs, ord, CASE WHEN total = 0 THEN CAST(0 AS DOUBLE) ELSE least(cap, coalesce(shared, ratio) * w) END AS target FROM g),
q AS (SELECT *, CAST(greatest(ceil(n_docs / 32.0), 1) AS BIGINT) AS n_blocks,
             CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS INTEGER) ELSE 0 END AS passes FROM p),
d AS (SELECT s.doc_id, s.size, q.source_size, q.target, q.ord, q.passes, q.target - q.passes * q.source_size AS rest,
             (CAST('0x' || substr(md5('mix-1|' || coalesce('s' || s.source, 'null') || '|' || CAST(s.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 2147483648) % q.n_blocks AS block,
             md5('mix-1|doc|' || CAST(s.doc_id AS VARCHAR)) AS doc_key
      FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source),
b AS (SELECT ord, block, sum(size) AS block_size, any_value(rest) AS rest, any_value(passes) AS passes, md5('mix-1|block|' || CAST(ord AS VARCHAR) || '|' || CAST(block AS VARCHAR)) AS block_key FROM d GROUP BY ord, block),
n AS (SELECT ord, block, block_size, passes, rest - coalesce(sum(block_size) OVER (PARTITION BY ord ORDER BY block_key, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS need FROM b),
dr AS (SELECT ord, block, CAST(unnest(range(passes + CASE WHEN need > 0 THEN 1 ELSE 0 END)) AS INTEGER) AS pass FROM n),
{_TREE},
e AS (SELECT d.*, n.need, n.block_size,
             coalesce(sum(d.size) OVER (PARTITION BY d.ord, d.block ORDER BY d.doc_key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN n ON d.ord = n.ord AND d.block = n.block),
x AS (SELECT e.doc_id, string_agg(z.pass || ':' || z.lo, ' ' ORDER BY z.pass) AS shards, count(*) AS copies FROM e JOIN {_LEAVES} z ON z.ord = e.ord AND z.block = e.block
      WHERE z.pass < e.passes OR e.need >= e.block_size OR e.before + e.size / 2.0 <= e.need GROUP BY e.doc_id)
SELECT e.doc_id, e.size, e.source_size, e.target, CAST(e.size * coalesce(x.copies, 0) AS BIGINT) AS taken, coalesce(x.shards, '') AS shards
FROM e LEFT JOIN x ON x.doc_id = e.doc_id""",
    "op9_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM u q JOIN u c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
