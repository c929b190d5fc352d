"""Queries on the corpus: audits, duplicates, blocklists, splits, ingest, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, dedup, ingest, metrics, scoring, splits
from ..operators.storage import bounded
from ..sources import catalog
from .metric_queries import rounded
from .registry import query
from .tables import AUROC, SCORES, roc_sql, scores, table

Session = SparkSession


def docs(spark: Session, d: str) -> DataFrame:
    return table(spark, d, "documents")


def probed(spark: Session, d: str) -> DataFrame:
    return audit.text_probe(docs(spark, d))


def _share(p: str) -> str:
    return f"CAST(length(text) - length(regexp_replace(text, '{p}', '', 'g')) AS DOUBLE) / nullif(length(text), 0)"


PROBED = (
    "probed AS (SELECT *, CAST(length(text) AS DOUBLE) AS n_chars_real, CAST(strlen(text) AS DOUBLE) AS n_bytes, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS n_lines, "
    f"{_share('[A-Z]+')} AS upper_share, {_share('[0-9]+')} AS digit_share, {_share('[ ' + chr(92) + 'n' + chr(92) + 't]+')} AS space_share, {_share('[#*$%&|<>]+')} AS symbol_share FROM documents)"
)


def _long(keep: str, source: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{f}' AS feature, {f} AS value FROM {source} WHERE {f} IS NOT NULL{extra}" for f in audit.PROBES)


def _leak(keys: str) -> str:
    """From long(keys, feature, value, label)."""
    k = f"{keys}, feature" if keys else "feature"
    on = " AND ".join(f"l.{c} = s.{c}" for c in k.split(", "))
    picked = ", ".join(f"l.{c}" for c in k.split(", "))
    back = " AND ".join(f"r.{c} = s.{c}" for c in k.split(", "))
    return (
        f"span AS (SELECT {k}, min(value) AS lo, max(value) AS hi, count(*) AS n, count(DISTINCT label) AS classes FROM long GROUP BY {k}), "
        f"scaled AS (SELECT {picked}, label, CASE WHEN lo = hi THEN 0.5e0 ELSE (value - lo) / (hi - lo) END AS score FROM long l JOIN span s ON {on}), {roc_sql('scaled', k)}, r AS (SELECT {k}, {AUROC} AS a FROM roc GROUP BY {k}), "
        f"leaks AS (SELECT {', '.join('s.' + c for c in k.split(', '))}, n, CASE WHEN n >= 4 AND classes = 2 THEN greatest(a, 1 - a) END AS leak FROM span s JOIN r ON {back})"
    )


def labelled_features(spark: Session, d: str) -> DataFrame:
    rows = probed(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("label", F.col("quality"))
    return audit.long_features(rows, audit.PROBES, ["label"])


_LABELLED = f"{PROBED}, lab AS (SELECT p.*, l.quality AS label FROM probed p JOIN labels l ON l.doc_id = p.doc_id), long AS ({_long('label', 'lab')}), {_leak('')}"


@query(f"WITH {_LABELLED} SELECT feature, n, round(leak, 6) AS leak FROM leaks")
def leak_auroc_by_feature(spark: Session, d: str) -> DataFrame:
    return rounded(audit.leak_auroc(labelled_features(spark, d), []))


@query(
    f"WITH {PROBED}, views AS (SELECT *, 'binary' AS view, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS label FROM probed UNION ALL SELECT *, 'en_vs_' || lang, 1 FROM probed WHERE lang <> 'en' UNION ALL SELECT p.*, 'en_vs_' || z.l, 0 FROM probed p CROSS JOIN (SELECT DISTINCT lang AS l FROM documents WHERE lang <> 'en') z WHERE p.lang = 'en'), "
    f"long AS ({_long('view, label', 'views')}), {_leak('view')} SELECT view, feature, n, round(leak, 6) AS leak FROM leaks"
)
def leak_auroc_pairwise_views(spark: Session, d: str) -> DataFrame:
    views = audit.class_views(probed(spark, d), "lang", "en")
    return rounded(audit.leak_auroc(audit.long_features(views, audit.PROBES, ["view", "label"]), ["view"]))


@query(f"WITH {PROBED} SELECT count(*) AS n, round(avg(CASE WHEN (CASE WHEN n_chars_real < 300 THEN 0 ELSE 1 END) = quality THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy FROM probed p JOIN labels l ON l.doc_id = p.doc_id")
def one_rule_accuracy(spark: Session, d: str) -> DataFrame:
    rows = probed(spark, d).join(table(spark, d, "labels"), "doc_id")
    return rounded(audit.rule_accuracy(rows, F.when(F.col("n_chars_real") < 300, 0).otherwise(1), F.col("quality")))


LANGS = ["de", "en", "es", "fr"]


@query("WITH w AS (SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in LANGS) + " FROM documents GROUP BY source) SELECT *, de + en + es + fr AS total, " + ", ".join(f"round(100.0e0 * {x} / nullif(de + en + es + fr, 0), 4) AS {x}_pct" for x in LANGS) + " FROM w")
def crosstab_pct(spark: Session, d: str) -> DataFrame:
    return audit.crosstab(docs(spark, d), "source", "lang", LANGS)


@query(f"WITH {PROBED} SELECT lang, count(*) AS n, round(avg(n_chars_real), 6) AS mean, round(stddev_samp(n_chars_real), 6) AS sd, median(n_chars_real) AS median, round(avg(CASE WHEN n_lines > 10 THEN 1.0e0 ELSE 0.0e0 END), 6) AS special_share, count(DISTINCT (n_chars_real, n_lines)) AS n_shapes FROM probed GROUP BY lang")
def profile_by_class(spark: Session, d: str) -> DataFrame:
    return rounded(audit.profile(probed(spark, d), "lang", "n_chars_real", F.col("n_lines") > 10, ["n_chars_real", "n_lines"]))


@query(f"WITH {PROBED}, n AS (SELECT lang, n_lines, count(*) AS n FROM probed GROUP BY lang, n_lines), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, n_lines) AS rank, sum(n) OVER (PARTITION BY lang) AS t FROM n) SELECT lang, CAST(rank AS INTEGER) AS rank, n_lines, n, round(n / CAST(t AS DOUBLE), 6) AS share FROM r WHERE rank <= 6")
def top_shapes_per_class(spark: Session, d: str) -> DataFrame:
    return rounded(audit.top_shares(probed(spark, d), "lang", ["n_lines"], 6))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 12")
def token_topk(spark: Session, d: str) -> DataFrame:
    return audit.top_tokens(docs(spark, d), F.split(F.lower("text"), " "), 12)


FLAGS = {"has_title": "<title>", "has_script": "<script>", "has_comment": "<!--", "has_nav": "<nav>", "has_table": "<table"}
_PAGES = "pg AS (SELECT page_id, url, html, regexp_replace(url, '^https?://([^/?#]+).*$', '\\1') AS host FROM pages)"


def pages(spark: Session, d: str) -> DataFrame:
    return table(spark, d, "pages").withColumn("host", F.regexp_replace("url", r"^https?://([^/?#]+).*$", "$1"))


@query(f"WITH {_PAGES} SELECT regexp_replace(host, '^.*[.]', '') AS tld, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN contains(html, '{v}') THEN 1.0e0 ELSE 0.0e0 END), 6) AS {k}" for k, v in FLAGS.items()) + " FROM pg GROUP BY 1")
def metadata_rates(spark: Session, d: str) -> DataFrame:
    rows = pages(spark, d).withColumn("tld", F.regexp_replace("host", r"^.*[.]", ""))
    return rounded(audit.presence(rows, "tld", {k: F.contains(F.col("html"), F.lit(v)) for k, v in FLAGS.items()}))


@query("SELECT page_id, split_part(url, '/', 4) AS part, lower(regexp_extract(url, '[^.]*$')) AS ext FROM pages")
def path_parts(spark: Session, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.coalesce(audit.segment(F.col("url"), 3), F.lit("")).alias("part"), audit.extension(F.col("url")).alias("ext"))


@query(f"WITH {_LABELLED}, v AS (SELECT feature, count(DISTINCT value) AS n_values FROM long GROUP BY feature) SELECT v.feature, n_values, round(leak, 6) AS leak, CASE WHEN n_values <= 1 THEN 'constant' WHEN leak < 0.6 THEN 'ok' ELSE 'LEAK' END AS status FROM v LEFT JOIN leaks l ON l.feature = v.feature")
def constant_channels(spark: Session, d: str) -> DataFrame:
    rows = labelled_features(spark, d)
    values = rows.groupBy("feature").agg(F.count_distinct("value").alias("n_values"))
    return rounded(audit.channel_status(audit.leak_auroc(rows, []), values))


@query(
    f"WITH {PROBED}, one AS (SELECT p.*, l.quality FROM probed p JOIN labels l ON l.doc_id = p.doc_id WHERE l.quality = 1), every AS (SELECT o.n_bytes AS value, z.s AS target, CASE WHEN o.source = z.s THEN 1 ELSE 0 END AS label FROM one o CROSS JOIN (SELECT DISTINCT source AS s FROM one) z), "
    f"long AS (SELECT target, 'n_bytes' AS feature, value, label FROM every), {_leak('target')}, m AS (SELECT source, median(n_bytes) AS median_bytes FROM one GROUP BY source) SELECT target AS source, n, round(leak, 6) AS leak, median_bytes FROM leaks JOIN m ON m.source = target"
)
def source_fingerprint(spark: Session, d: str) -> DataFrame:
    one = probed(spark, d).join(table(spark, d, "labels").filter("quality = 1"), "doc_id").select("source", "n_bytes")
    rows = audit.one_vs_rest(one, "source").select("target", "label", F.lit("n_bytes").alias("feature"), F.col("n_bytes").alias("value"))
    medians = one.groupBy("source").agg(F.median("n_bytes").alias("median_bytes"))
    return rounded(audit.leak_auroc(rows, ["target"]).withColumnRenamed("target", "source").join(medians, "source").select("source", "n", "leak", "median_bytes"))


@query("WITH m AS (SELECT max(doc_id) + 1 AS n FROM documents) SELECT CAST(least(floor(10.0e0 * l.doc_id / m.n), 9) AS INTEGER) AS decile, count(*) AS n, round(avg(quality), 6) AS share FROM labels l CROSS JOIN m GROUP BY 1")
def position_decile_share(spark: Session, d: str) -> DataFrame:
    n = docs(spark, d).agg((F.max("doc_id") + 1).alias("n"))
    rows = table(spark, d, "labels").withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k")  # one row beside all
    return rounded(audit.position_deciles(rows, F.col("doc_id") / F.col("n"), "quality"))


@query("WITH n AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS n_distinct, count(*) FILTER (WHERE n > 1) AS n_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_rows FROM n")
def exact_dup_groups(spark: Session, d: str) -> DataFrame:
    return dedup.collisions(ingest.with_hash(docs(spark, d)), "sha")


def _simhash(source: str, key: str, name: str) -> str:
    h = lambda at: f"CAST('0x' || substr(md5(w), {at}, 8) AS BIGINT)"
    ones = ", ".join(f"sum(({c} >> {i}) & 1) AS {c}{i}" for c in ("hi", "lo") for i in range(32))
    bits = lambda c: " + ".join(f"CASE WHEN 2 * {c}{i} > n THEN CAST({1 << i} AS BIGINT) ELSE 0 END" for i in range(32))
    words = r"regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+')"
    return (
        f"{name}_w AS (SELECT DISTINCT {key}, w FROM (SELECT {key}, unnest({words}) AS w FROM {source}) WHERE w <> ''), {name}_h AS (SELECT {key}, {h(1)} AS hi, {h(9)} AS lo FROM {name}_w), "
        f"{name}_v AS (SELECT {key}, count(*) AS n, {ones} FROM {name}_h GROUP BY {key}), {name} AS (SELECT {key}, CAST({bits('hi')} AS BIGINT) AS hi, CAST({bits('lo')} AS BIGINT) AS lo FROM {name}_v)"
    )


SIM = _simhash("documents", "doc_id", "sim")
PAIRS = f"{SIM}, dist AS (SELECT hi, lo, min(doc_id) AS id, count(*) AS n FROM sim GROUP BY hi, lo), pairs AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM dist a JOIN dist b ON a.id < b.id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6)"


@query(f"WITH {SIM} SELECT doc_id, hi, lo FROM sim")
def simhashes(spark: Session, d: str) -> DataFrame:
    return dedup.simhash(docs(spark, d))


@query(f"WITH {PAIRS} SELECT a, b, distance FROM pairs")
def near_dup_pairs(spark: Session, d: str) -> DataFrame:
    return dedup.near_pairs(dedup.distinct_hashes(dedup.simhash(docs(spark, d)), "doc_id"))


@query(f"WITH {PAIRS} SELECT distance, count(*) AS n FROM pairs GROUP BY distance")
def near_dup_distances(spark: Session, d: str) -> DataFrame:
    return near_dup_pairs(spark, d).groupBy("distance").agg(F.count("*").alias("n"))


_CLUSTERS = f"RECURSIVE {PAIRS}, edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach(id, r) AS (SELECT id, id FROM dist UNION SELECT reach.id, e.b FROM reach JOIN edges e ON e.a = reach.r), comp AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id), clusters AS (SELECT s.doc_id, c.cluster FROM sim s JOIN dist d ON d.hi = s.hi AND d.lo = s.lo JOIN comp c ON c.id = d.id)"


def clusters(spark: Session, d: str) -> DataFrame:
    return dedup.clusters(dedup.simhash(docs(spark, d)), "doc_id")


@query(f"WITH {_CLUSTERS} SELECT doc_id, cluster FROM clusters")
def dup_components(spark: Session, d: str) -> DataFrame:
    return clusters(spark, d)


_LISTED = "listed AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS item_id, text FROM benchmark UNION ALL SELECT 'd' || CAST(d.doc_id AS VARCHAR), d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)"


@query(
    f"WITH {SIM}, {_LISTED}, {_simhash('listed', 'item_id', 'bsim')}, s AS (SELECT d.doc_id, sha256(d.text) AS sha, hi, lo FROM documents d JOIN sim ON sim.doc_id = d.doc_id), e AS (SELECT doc_id FROM s WHERE sha IN (SELECT sha256(text) FROM listed)), "
    "f AS (SELECT s.doc_id, min(bit_count(xor(s.hi, b.hi)) + bit_count(xor(s.lo, b.lo))) AS d FROM s JOIN bsim b ON bit_count(xor(s.hi, b.hi)) + bit_count(xor(s.lo, b.lo)) <= 6 GROUP BY s.doc_id) "
    "SELECT doc_id, 'sha256' AS reason FROM e UNION ALL SELECT doc_id, 'hamming ' || CAST(d AS VARCHAR) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e)"
)
def blocklist_hits(spark: Session, d: str) -> DataFrame:
    """Documents that a blocklist of benchmark items and toxic texts forbids: these, their copies, and what is near."""
    toxic = docs(spark, d).join(table(spark, d, "labels").filter("toxic = 1"), "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item_id"), "text")
    listed = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("item_id"), "text").unionByName(toxic)
    rows = ingest.with_hash(docs(spark, d)).select("doc_id", "sha").join(dedup.simhash(docs(spark, d)), "doc_id")
    return dedup.block_hits(rows, "doc_id", ingest.with_hash(listed), dedup.simhash(listed, "item_id"))


@query(
    f"WITH {PAIRS}, told AS (SELECT p.*, x.source = y.source AS alike FROM pairs p JOIN documents x ON x.doc_id = p.a JOIN documents y ON y.doc_id = p.b), "
    "near AS (SELECT string_agg(t, '; ' ORDER BY t) AS examples FROM (SELECT distance || ' ' || a || ' ' || b AS t FROM told WHERE NOT alike ORDER BY distance, a, b LIMIT 5)) "
    "SELECT count(*) FILTER (WHERE alike) AS within, count(*) FILTER (WHERE NOT alike) AS across, (SELECT coalesce(examples, '') FROM near) AS examples FROM told"
)
def near_dup_classes(spark: Session, d: str) -> DataFrame:
    """Near pairs within a source and across sources, with the nearest of the latter."""
    return dedup.pair_classes(near_dup_pairs(spark, d), docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("klass")))


@query("WITH ledger AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE lang = 'de'), n AS (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) SELECT doc_id, sha FROM n WHERE r = 1 AND sha NOT IN (SELECT sha FROM ledger)")
def content_hash_antijoin(spark: Session, d: str) -> DataFrame:
    """What a ledger that holds one language lacks: the first row of each new content."""
    rows = ingest.with_hash(docs(spark, d)).select("doc_id", "lang", "sha")
    return ingest.new_only(ingest.first_by_hash(rows, "sha", "doc_id"), rows.filter("lang = 'de'")).select("doc_id", "sha")


HOLDOUT = ["src3", "src7"]
_CORPUS = f"{_CLUSTERS}, corpus AS (SELECT l.doc_id, l.quality AS label, d.source AS generator, c.cluster, d.source IN ('src3', 'src7') AS h, l.toxic = 1 AS x FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN clusters c ON c.doc_id = l.doc_id)"


def _quota_sql(n: str) -> str:
    shares = splits.SHARES
    f = [f"floor({n} * {s}e0)" for s in shares]
    r = [f"({n} * {s}e0 - floor({n} * {s}e0))" for s in shares]
    out = []
    for i in range(3):
        ahead = " + ".join(f"CASE WHEN {r[j]} > {r[i]} OR ({r[j]} = {r[i]} AND {str(j < i).lower()}) THEN 1 ELSE 0 END" for j in range(3) if j != i)
        out.append(f"({f[i]} + CASE WHEN {ahead} < {n} - ({' + '.join(f)}) THEN 1 ELSE 0 END)")
    return f"{out[0]} AS q0, {out[1]} AS q1"


_SPLIT = f"""{_CORPUS}, pool AS (SELECT * FROM corpus WHERE NOT h),
gens AS (SELECT cluster, generator, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, generator) AS r FROM pool GROUP BY cluster, generator),
cl AS (SELECT p.cluster, (SELECT min_by(label, doc_id) FROM pool z WHERE z.cluster = p.cluster) AS label, g.generator AS gen FROM (SELECT DISTINCT cluster FROM pool) p JOIN gens g ON g.cluster = p.cluster AND g.r = 1),
dealt AS (SELECT cluster, label, gen, row_number() OVER (PARTITION BY label, gen ORDER BY md5('0|' || CAST(cluster AS VARCHAR)), cluster) AS rn, count(*) OVER (PARTITION BY label, gen) AS n FROM cl),
s AS (SELECT cluster, CASE WHEN rn <= q0 THEN 'train' WHEN rn <= q0 + q1 THEN 'val' ELSE 'test' END AS s FROM (SELECT *, {_quota_sql('n')} FROM dealt)),
split AS (SELECT c.doc_id, c.label, c.generator, c.cluster, CASE WHEN h THEN 'test' WHEN x AND s = 'train' THEN 'test' ELSE s END AS split FROM corpus c LEFT JOIN s ON s.cluster = c.cluster)"""


def labelled(spark: Session, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    return bounded(lab, lab.count()).join(docs(spark, d).select("doc_id", "source"), "doc_id")


def split_rows(spark: Session, d: str, strict: bool = False) -> DataFrame:
    """Labelled documents; toxic ones are the forbidden ones, two sources the held-out generators."""
    rows = labelled(spark, d).join(clusters(spark, d), "doc_id").select("doc_id", F.col("quality").alias("label"), F.col("source").alias("generator"), "cluster", "toxic")
    return splits.assign(rows, key="doc_id", holdout=F.col("generator").isin(HOLDOUT), blocked=F.col("toxic") == 1, strict=strict).drop("toxic")


@query(f"WITH {_SPLIT} SELECT doc_id, label, generator, cluster, split FROM split")
def split_assignment(spark: Session, d: str) -> DataFrame:
    return split_rows(spark, d)


_COUNTS = "count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total"


@query(f"WITH {_SPLIT} SELECT coalesce(generator, 'all') AS generator, {_COUNTS} FROM split GROUP BY ROLLUP (generator)")
def split_contingency(spark: Session, d: str) -> DataFrame:
    return splits.contingency(split_rows(spark, d), "generator")


@query(
    f"WITH {_SPLIT}, k AS (SELECT doc_id, count(DISTINCT split) AS s FROM split GROUP BY doc_id), c AS (SELECT cluster, count(DISTINCT split) AS s FROM split GROUP BY cluster) "
    "SELECT 'row in several splits' AS rule, count(*) FILTER (WHERE s > 1) AS n FROM k UNION ALL SELECT 'cluster straddles splits', count(*) FILTER (WHERE s > 1) FROM c UNION ALL SELECT 'row without a split', count(*) FILTER (WHERE split IS NULL) FROM split "
    "UNION ALL SELECT 'empty splits', 3 - count(DISTINCT split) FROM split UNION ALL SELECT 'labels out of balance', CASE WHEN avg(label) BETWEEN 0.25 AND 0.75 THEN 0 ELSE 1 END FROM split"
)
def split_violations(spark: Session, d: str) -> DataFrame:
    return splits.violations(split_rows(spark, d), "doc_id")


@query("WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('0|' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM labels) SELECT doc_id, quality FROM r WHERE r <= 50")
def stratified_limit(spark: Session, d: str) -> DataFrame:
    return splits.stratified_limit(table(spark, d, "labels"), "quality", 101, "doc_id").select("doc_id", "quality")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT doc_id, lang FROM r WHERE r <= 10")
def head_n_per_class(spark: Session, d: str) -> DataFrame:
    return splits.head_per_class(docs(spark, d), "lang", 10, "doc_id").select("doc_id", "lang")


_RULES = "CASE WHEN quality = 0 THEN 'wrong_class' WHEN text IS NULL OR text = '' THEN 'no_bytes' WHEN length(text) < 200 THEN 'too_small' WHEN length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) < 0.8e0 * length(text) THEN 'mostly_padding' END"
_REASONS = f"r AS (SELECT d.doc_id, d.source, d.text, sha256(d.text) AS sha, {_RULES} AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def ingested(spark: Session, d: str, quota: int = 30) -> tuple[DataFrame, DataFrame]:
    t = F.col("text")
    rules = [("wrong_class", F.col("quality") == 0), ("no_bytes", t.isNull() | (t == "")), ("too_small", F.length(t) < 200), ("mostly_padding", F.length(F.regexp_replace(t, r"[#*$%&|<>]+", "")) < 0.8 * F.length(t))]
    rows = docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return ingest.ingest(rows, None, key="doc_id", source="source", rules=rules, quota=F.lit(quota), order=F.md5(F.concat(F.lit("visit|"), F.col("doc_id").cast("string"))))


@query(f"WITH {_REASONS} SELECT source, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1, 2")
def rejection_counts(spark: Session, d: str) -> DataFrame:
    return ingested(spark, d)[1]


@query(f"WITH {_REASONS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS k FROM r WHERE reason IS NULL) WHERE k = 1), q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('visit|' || CAST(doc_id AS VARCHAR)), doc_id) AS v FROM f) SELECT doc_id, source, sha FROM q WHERE v <= 30")
def source_quota(spark: Session, d: str) -> DataFrame:
    return ingested(spark, d)[0].select("doc_id", "source", "sha")


@query(
    f"WITH {SCORES}, a AS (SELECT generator, avg(score) AS x FROM scores WHERE cell = 'clean' AND label = 1 GROUP BY generator), b AS (SELECT source AS generator, avg(length(text)) AS y FROM documents GROUP BY source), "
    "r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0e0 AS ry FROM a JOIN b ON a.generator = b.generator) SELECT count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(rx, ry) END, 6) AS rho FROM r"
)
def spearman_rank(spark: Session, d: str) -> DataFrame:
    a = scores(spark, d).filter("cell = 'clean' AND label = 1").groupBy("generator").agg(F.avg("score").alias("x"))
    b = docs(spark, d).groupBy(F.col("source").alias("generator")).agg(F.avg(F.length("text")).alias("y"))
    return rounded(audit.rank_correlation(a.join(b, "generator"), "x", "y"))


def vectors(spark: Session, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
WEIGHTS, BIAS = [((i * 37) % 21 - 10) / 10 for i in range(64)], -0.1


@query(f"WITH {_V} SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first FROM v")
def embedding_l2_normalise(spark: Session, d: str) -> DataFrame:
    e = F.col("embedding")
    return rounded(vectors(spark, d).select("vec_id", F.sqrt(scoring.dot(e, e)).alias("norm"), scoring.l2_normalised(e)[0].alias("first")))


_DOT = " + ".join(f"{w}e0 * e[{i + 1}]" for i, w in enumerate(WEIGHTS))


@query(f"WITH {_V} SELECT vec_id, round(1 / (1 + exp(-({_DOT} + {BIAS}e0))), 6) AS score FROM v")
def linear_head_scores(spark: Session, d: str) -> DataFrame:
    return rounded(vectors(spark, d).select("vec_id", scoring.linear_head(F.col("embedding"), WEIGHTS, BIAS).alias("score")))


SCALE = [2.0, 4.0, 8.0]


@query(f"WITH {_V} SELECT vec_id, CAST(len(e) + 3 AS INTEGER) AS n, round(e[1], 6) AS first, round(label / 2.0e0 + (vec_id % 7) / 4.0e0 + len(e) / 8.0e0, 6) AS tail FROM v")
def fused_features(spark: Session, d: str) -> DataFrame:
    other = F.array(F.col("label").cast("double"), (F.col("vec_id") % 7).cast("double"), F.size("embedding").cast("double"))
    f = scoring.fused(F.col("embedding"), other, SCALE)
    return rounded(vectors(spark, d).select("vec_id", F.size(f).alias("n"), f[0].alias("first"), (f[64] + f[65] + f[66]).alias("tail")))


@query(f"WITH {_V}, p AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) SELECT CAST(i AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM p GROUP BY i")
def feature_calibration(spark: Session, d: str) -> DataFrame:
    x = vectors(spark, d).select(F.posexplode("embedding").alias("dim", "x")).select((F.col("dim") + 1).alias("dim"), F.col("x").cast("double").alias("x"))
    return rounded(x.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")))


_REG = "reg(name, label, family, n_rows, total_gb, quota, holdout) AS (VALUES " + ", ".join(f"('{n}', {y}, '{f}', {r}, {g}e0, {q}, {str(h).lower()})" for n, y, f, r, g, q, h, _ in catalog.SOURCES) + ")"
_FOOT = f"{_REG}, foot AS (SELECT name, label, CAST(quota AS BIGINT) AS quota, CAST(round(quota / 0.85e0) AS BIGINT) AS rows_fetched, round(total_gb * 1e9 / n_rows / 1e6, 3) AS mb_per_item, round(quota / 0.85e0 * (total_gb * 1e9 / n_rows) / 1e9, 2) AS transfer_gb, round(quota * 95000 / 1e9, 3) AS normalised_gb FROM reg)"


@query(f"WITH {_FOOT} SELECT * FROM foot")
def footprint_estimate(spark: Session, d: str) -> DataFrame:
    return catalog.footprint(catalog.registry(spark))


@query(f"WITH {_FOOT} SELECT round(sum(transfer_gb), 2) AS transfer_gb, round(sum(normalised_gb), 2) AS normalised_gb, round(sum(normalised_gb) + 0.2e0, 2) AS peak_gb, CAST(sum(quota) AS BIGINT) AS n_items FROM foot")
def footprint_total(spark: Session, d: str) -> DataFrame:
    return catalog.footprint_total(catalog.footprint(catalog.registry(spark)))


@query(f"WITH {_REG} SELECT name, CASE WHEN holdout THEN 'held out' ELSE 'trainable' END AS use FROM reg WHERE NOT (contains(lower(name), 'flickr'))")
def source_views(spark: Session, d: str) -> DataFrame:
    """Trainable and held-out sources, without denied ones."""
    reg = catalog.registry(spark)
    both = catalog.trainable(reg).select("name", F.lit("trainable").alias("use")).unionByName(catalog.held_out(reg).select("name", F.lit("held out").alias("use")))
    return both.join(catalog.denied(reg, "name", ["Flickr"]), "name", "left_anti")


@query("WITH l AS (SELECT DISTINCT source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 0), h AS (SELECT DISTINCT source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1) SELECT source, 'both' AS side FROM (SELECT * FROM l INTERSECT SELECT * FROM h) UNION ALL SELECT source, 'low quality only' FROM (SELECT * FROM l EXCEPT SELECT * FROM h) UNION ALL SELECT source, 'toxic only' FROM (SELECT * FROM h EXCEPT SELECT * FROM l)")
def generator_sets(spark: Session, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    low, toxic = rows.filter("quality = 0").select("source").distinct(), rows.filter("toxic = 1").select("source").distinct()
    named = lambda df, n: df.withColumn("side", F.lit(n))
    return named(low.intersect(toxic), "both").unionByName(named(low.exceptAll(toxic), "low quality only")).unionByName(named(toxic.exceptAll(low), "toxic only"))


@query("WITH n AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS block, count(*) OVER (PARTITION BY source) AS n FROM documents), b AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY md5('blocks|' || source || '|' || CAST(block AS VARCHAR)), block) AS r FROM n) SELECT doc_id, source, CAST(block AS BIGINT) AS block FROM b WHERE r <= 2")
def block_sample(spark: Session, d: str) -> DataFrame:
    """Two blocks of ten neighbouring rows from each source, drawn by a seeded hash."""
    from ..sources.readers import sample_blocks

    return sample_blocks(docs(spark, d).select("doc_id", "source"), "source", "doc_id", 10, 2, "blocks")


@query("SELECT doc_id FROM documents ORDER BY md5('shuffle|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def seeded_first_n(spark: Session, d: str) -> DataFrame:
    from ..sources.readers import seeded_first

    return seeded_first(docs(spark, d), "doc_id", 25, "shuffle").select("doc_id")


@query(f"WITH {PROBED} SELECT doc_id, n_chars_real / 1e6 AS megapixels, n_chars_real = n_bytes AS is_square, round(n_bytes / greatest(n_chars_real * n_lines, 1), 6) AS bytes_per_pixel, least(n_chars_real, n_lines) AS short_side FROM probed")
def geometry(spark: Session, d: str) -> DataFrame:
    """Derivations of width, height and bytes; a text's characters, lines and bytes stand in."""
    rows = probed(spark, d).select("doc_id", F.col("n_chars_real").alias("width"), F.col("n_lines").alias("height"), "n_bytes")
    out = audit.geometry(rows).select("doc_id", (F.col("width") / 1e6).alias("megapixels"), (F.col("width") == F.col("n_bytes")).alias("is_square"), F.round("bytes_per_pixel", 6).alias("bytes_per_pixel"), "short_side")
    return out


@query(
    f"WITH {_V}, a AS (SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS norm2 FROM v), "
    "b AS (SELECT vec_id, round(list_sum(list_transform(e, lambda x: CASE WHEN vec_id % 10 = 0 THEN greatest(x, 0) * greatest(x, 0) ELSE x * x END)), 6) AS norm2 FROM v) "
    "SELECT vec_id, norm2, 'first' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT vec_id, norm2, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"
)
def feature_path_differences(spark: Session, d: str) -> DataFrame:
    """Squared lengths by array functions and by rows; every tenth row leaves out its negative components, and must show."""
    e = F.col("embedding")
    whole = vectors(spark, d).select("vec_id", F.round(scoring.dot(e, e), 6).alias("norm2"))
    x = F.col("x").cast("double")
    kept = F.when(F.col("vec_id") % 10 == 0, F.greatest(x, F.lit(0.0))).otherwise(x)
    rows = vectors(spark, d).select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id").agg(F.round(F.sum(kept * kept), 6).alias("norm2"))
    return metrics.differences(whole, rows)


@query(f"WITH {_LABELLED} SELECT feature, n, round(leak, 6) AS leak FROM leaks WHERE leak IS NOT NULL ORDER BY leak DESC, feature")
def leak_ranking(spark: Session, d: str) -> DataFrame:
    """Features by their largest leak over the views of the classes."""
    return rounded(audit.leak_ranking(audit.leak_auroc(labelled_features(spark, d), [])))


@query(f"WITH {PROBED} SELECT lang, " + ", ".join(f"round(avg({f}), 6) AS {f}" for f in audit.PROBES) + " FROM probed GROUP BY lang")
def mean_features_by_class(spark: Session, d: str) -> DataFrame:
    return rounded(audit.mean_features(probed(spark, d), "lang", audit.PROBES))


PREFIXES = {"https://": 250, "https://www": 10, "http://": 0}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS prefix, count(*) FILTER (WHERE starts_with(url, '{p}')) AS n, CAST({n} AS BIGINT) AS expected FROM pages" for p, n in PREFIXES.items()) + ")")
def prefix_counts(spark: Session, d: str) -> DataFrame:
    return audit.prefix_counts(table(spark, d, "pages"), "url", PREFIXES).drop("as_expected")
