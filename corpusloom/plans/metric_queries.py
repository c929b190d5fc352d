"""Queries on scores: metrics, the grid, generators, errors, significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sql_hash32
from ..operators import bootstrap, cells, metrics
from .registry import query
from .tables import AP, AUROC, CELLS, ITEMS, SCORES, items, roc_sql, scores, scores_sql, tpr_sql

Session = SparkSession


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles to n places: engines sum in different orders."""
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def by_chars(spark: Session, d: str) -> DataFrame:
    """Length as a score, scaled to [0, 1] by a fixed bound, per language."""
    return items(spark, d).select(F.col("group").alias("lang"), "label", F.least(F.col("n_chars") / 50000.0, F.lit(1.0)).alias("score"))


CHARS = f"{ITEMS}, s AS (SELECT \"group\" AS lang, label, least(n_chars / 50000.0e0, 1.0e0) AS score FROM items)"


def _grouped(metric: str, name: str, source: str = "s", keys: str = "lang") -> str:
    return f"SELECT {keys}, round({metric}, 6) AS {name} FROM roc GROUP BY {keys}"


def _by_group(spark: Session, d: str, value, name: str) -> DataFrame:
    return rounded(metrics.roc(by_chars(spark, d), ["lang"]).groupBy("lang").agg(value.alias(name)))


@query(f"WITH {CHARS}, {roc_sql('s', 'lang')} {_grouped(AUROC, 'auroc')}")
def auroc_by_group(spark: Session, d: str) -> DataFrame:
    return _by_group(spark, d, metrics.auroc(), "auroc")


@query(f"WITH {CHARS}, {roc_sql('s', 'lang')} {_grouped(AP, 'ap')}")
def average_precision_by_group(spark: Session, d: str) -> DataFrame:
    return _by_group(spark, d, metrics.average_precision(), "ap")


@query(f"WITH {SCORES} SELECT \"group\" AS lang, round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0e0 ELSE 0.0e0 END), 6) AS acc FROM scores WHERE cell = 'clean' AND score IS NOT NULL GROUP BY \"group\"")
def acc_at_half(spark: Session, d: str) -> DataFrame:
    s = scores(spark, d).filter("cell = 'clean'")
    return rounded(s.groupBy(F.col("group").alias("lang")).agg(*metrics.counts()).select("lang", "acc"))


@query(f"WITH {SCORES}, {roc_sql('scores', 'cell')} SELECT cell, round({tpr_sql(0.01)}, 6) AS tpr FROM roc GROUP BY cell")
def tpr_at_fpr_1pct(spark: Session, d: str) -> DataFrame:
    return rounded(metrics.roc(scores(spark, d), ["cell"]).groupBy("cell").agg(metrics.tpr_at(0.01).alias("tpr")))


@query(f"WITH {SCORES}, {roc_sql('scores', 'cell')} SELECT cell, round({tpr_sql(0.05)}, 6) AS tpr FROM roc GROUP BY cell")
def tpr_at_fpr_5pct(spark: Session, d: str) -> DataFrame:
    return rounded(metrics.roc(scores(spark, d), ["cell"]).groupBy("cell").agg(metrics.tpr_at(0.05).alias("tpr")))


@query(
    f"WITH {SCORES}, s AS (SELECT * FROM scores WHERE score IS NOT NULL), neg AS (SELECT cell, score, row_number() OVER (PARTITION BY cell ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY cell) AS n FROM s WHERE label = 0), "
    "t AS (SELECT cell, score AS threshold FROM neg WHERE r = greatest(CAST(ceil(0.05e0 * n) AS BIGINT) - 1, 0) + 1) "
    "SELECT s.cell, round(avg(CASE WHEN s.score > t.threshold THEN 1.0e0 ELSE 0.0e0 END), 6) AS tpr FROM s JOIN t ON t.cell = s.cell WHERE s.label = 1 GROUP BY s.cell"
)
def tpr_strict_kth_negative(spark: Session, d: str) -> DataFrame:
    return rounded(metrics.roc(scores(spark, d), ["cell"]).groupBy("cell").agg(metrics.tpr_over_negative(0.05).alias("tpr")))


CELL_METRICS = f"""base AS (SELECT cell, max(kind) AS kind, max(family) AS family, count(score) AS n, count(*) FILTER (WHERE score IS NOT NULL AND label = 0) AS n_real, count(*) FILTER (WHERE score IS NOT NULL AND label = 1) AS n_fake,
  count(*) FILTER (WHERE score IS NULL) AS n_failed, avg(CASE WHEN score IS NULL THEN NULL WHEN (score >= 0.5) = (label = 1) THEN 1.0e0 ELSE 0.0e0 END) AS acc, min(score) AS lo, max(score) AS hi FROM scores GROUP BY cell),
{roc_sql('scores', 'cell')}, ranks AS (SELECT cell, {AUROC} AS auroc, {AP} AS ap, {tpr_sql(0.01)} AS tpr_at_fpr FROM roc GROUP BY cell),
grid AS (SELECT b.cell, kind, family, n, n_real, n_fake, n_failed, auroc, ap, acc, tpr_at_fpr,
  concat_ws('; ', CASE WHEN n_real = 0 OR n_fake = 0 THEN 'single-class' END, CASE WHEN n > 1 AND lo = hi THEN 'degenerate' END, CASE WHEN n_failed > 0 THEN CAST(n_failed AS VARCHAR) || ' unscorable' END) AS notes FROM base b LEFT JOIN ranks r ON r.cell = b.cell)"""
KEYS = ["cell", "kind", "family"]


def grid_metrics(spark: Session, d: str) -> DataFrame:
    return metrics.cell_metrics(scores(spark, d), KEYS)


@query(f"WITH {SCORES}, {CELL_METRICS} SELECT cell, kind, family, n, n_real, n_fake, n_failed, round(auroc, 6) AS auroc, round(ap, 6) AS ap, round(acc, 6) AS acc, round(tpr_at_fpr, 6) AS tpr_at_fpr, notes FROM grid")
def cell_metrics_full(spark: Session, d: str) -> DataFrame:
    return rounded(grid_metrics(spark, d))


@query(f"WITH {SCORES} SELECT \"group\" AS lang, CAST(ceil(1 / 0.01e0) AS INTEGER) AS min_negatives, round(sqrt((p + n + 1) / nullif(CAST(12 * p * n AS DOUBLE), 0)), 6) AS null_sd FROM (SELECT \"group\", sum(label) AS p, count(*) - sum(label) AS n FROM items GROUP BY \"group\")")
def auroc_null_sd(spark: Session, d: str) -> DataFrame:
    g = items(spark, d).groupBy(F.col("group").alias("lang")).agg(F.sum("label").alias("p"), (F.count("*") - F.sum("label")).alias("n"))
    return rounded(g.select("lang", F.lit(metrics.minimum_negatives(0.01)).alias("min_negatives"), metrics.auroc_null_sd(F.col("p"), F.col("n")).alias("null_sd")))


@query(f"WITH {CELLS} SELECT ord, cell, kind, family, severity, chain FROM cells")
def grid_cells(spark: Session, d: str) -> DataFrame:
    return cells.cell_table(spark).drop("ops")


@query(f"WITH {SCORES} SELECT id, label, cell, score FROM scores")
def grid_scores(spark: Session, d: str) -> DataFrame:
    return scores(spark, d).select("id", "label", "cell", "score")


_FAMILIES = "fam AS (SELECT family, count(*) AS n_cells, count(auroc) AS n_defined, avg(auroc) AS mean, min(auroc) AS least FROM grid WHERE family <> 'clean' GROUP BY family)"


@query(
    f"WITH {SCORES}, {CELL_METRICS}, {_FAMILIES}, m AS (SELECT avg(mean) AS robust, count(*) AS n_families FROM fam), "
    "b AS (SELECT max(CASE WHEN kind = 'clean' THEN auroc END) AS clean, avg(CASE WHEN kind <> 'clean' THEN auroc END) AS flat_mean, avg(CASE WHEN kind = 'single' THEN auroc END) AS single_mean, avg(CASE WHEN kind = 'composed' THEN auroc END) AS composed_mean, "
    "min(auroc) AS worst, (SELECT cell FROM grid WHERE auroc IS NOT NULL ORDER BY auroc, cell LIMIT 1) AS worst_cell, count(*) AS n_cells, count(*) FILTER (WHERE kind <> 'clean') AS n_transformed, count(*) FILTER (WHERE auroc IS NULL) AS n_undefined FROM grid) "
    "SELECT round(clean, 6) AS clean, round(flat_mean, 6) AS flat_mean, round(single_mean, 6) AS single_mean, round(composed_mean, 6) AS composed_mean, round(worst, 6) AS worst, worst_cell, n_cells, n_transformed, n_undefined, "
    "round(robust, 6) AS robust, n_families, round(clean - robust, 6) AS gap, round(clean - flat_mean, 6) AS flat_gap, round(0.5e0 * clean + 0.5e0 * robust, 6) AS final FROM b CROSS JOIN m"
)
def grid_summary(spark: Session, d: str) -> DataFrame:
    return rounded(metrics.grid_summary(grid_metrics(spark, d)).drop("family_means"))


@query(f"WITH {SCORES}, {CELL_METRICS}, {_FAMILIES} SELECT family, n_cells, n_defined, round(mean, 6) AS mean, round(least, 6) AS least FROM fam")
def family_means(spark: Session, d: str) -> DataFrame:
    return rounded(metrics.family_table(grid_metrics(spark, d)))


_TPR_CELLS = f"{roc_sql('scores', 'cell, family')}, t AS (SELECT cell, family, {tpr_sql(0.05)} AS tpr FROM roc GROUP BY cell, family)"


@query(f"WITH {SCORES}, {_TPR_CELLS}, f AS (SELECT avg(m) AS robust FROM (SELECT family, avg(tpr) AS m FROM t WHERE family <> 'clean' GROUP BY family)) SELECT round(t.tpr, 6) AS clean, round(robust, 6) AS robust, round(t.tpr - robust, 6) AS gap FROM t CROSS JOIN f WHERE family = 'clean'")
def tpr_gap(spark: Session, d: str) -> DataFrame:
    t = metrics.roc(scores(spark, d), ["cell", "family"]).groupBy("cell", "family").agg(metrics.tpr_at(0.05).alias("tpr"))
    return rounded(bootstrap.gap(t.withColumn("_k", F.lit(1)), ["_k"]).drop("_k"))


@query(f"WITH {SCORES}, {CELL_METRICS} SELECT cell, round(auroc, 6) AS auroc FROM grid WHERE auroc IS NOT NULL ORDER BY auroc, cell LIMIT 1")
def worst_cell(spark: Session, d: str) -> DataFrame:
    return rounded(grid_metrics(spark, d).agg(F.min(F.when(F.col("auroc").isNotNull(), F.struct("auroc", "cell"))).alias("x")).select("x.cell", "x.auroc"))


@query(f"WITH {SCORES}, {CELL_METRICS}, {_FAMILIES} SELECT round(0.5e0 * (SELECT auroc FROM grid WHERE cell = 'clean') + 0.5e0 * (SELECT avg(mean) FROM fam), 6) AS final")
def final_score(spark: Session, d: str) -> DataFrame:
    return rounded(metrics.grid_summary(grid_metrics(spark, d)).select("final"))


_VIEWS = "names AS (SELECT DISTINCT generator AS g FROM scores WHERE label = 1), views AS (SELECT id, label, generator, cell, family, score FROM scores WHERE label = 1 UNION ALL SELECT s.id, s.label, n.g, s.cell, s.family, s.score FROM scores s CROSS JOIN names n WHERE s.label = 0)"


@query(f"WITH {SCORES}, {_VIEWS}, clean AS (SELECT * FROM views WHERE cell = 'clean'), {roc_sql('clean', 'generator')} SELECT generator, round({AUROC}, 6) AS auroc, round({tpr_sql(0.05)}, 6) AS tpr, CAST(max(pos) AS BIGINT) AS n_fake, CAST(max(neg) AS BIGINT) AS n_real FROM roc GROUP BY generator")
def per_generator_metrics(spark: Session, d: str) -> DataFrame:
    views = metrics.per_generator(scores(spark, d).filter("cell = 'clean'").select("id", "label", "generator", "score"))
    return rounded(metrics.roc(views, ["generator"]).groupBy("generator").agg(metrics.auroc().alias("auroc"), metrics.tpr_at(0.05).alias("tpr"), F.max("pos").alias("n_fake"), F.max("neg").alias("n_real")))


@query(f"WITH {SCORES}, {_VIEWS}, {roc_sql('views', 'cell, generator')}, t AS (SELECT cell, generator, {tpr_sql(0.05)} AS tpr FROM roc GROUP BY cell, generator) SELECT cell, round(max(tpr) - min(tpr), 6) AS spread FROM t GROUP BY cell")
def tpr_spread(spark: Session, d: str) -> DataFrame:
    views = metrics.per_generator(scores(spark, d).select("id", "label", "generator", "cell", "score"))
    t = metrics.roc(views, ["cell", "generator"]).groupBy("cell", "generator").agg(metrics.tpr_at(0.05).alias("tpr"))
    return rounded(bootstrap.spread(t, ["cell"]))


@query(f"WITH {SCORES} SELECT id, generator, score FROM scores WHERE cell = 'clean' AND label = 0 AND score IS NOT NULL ORDER BY score DESC, id LIMIT 20")
def false_positives_topk(spark: Session, d: str) -> DataFrame:
    return metrics.worst_errors(scores(spark, d).filter("cell = 'clean'"), 0, 20, ["id"]).select("id", "generator", "score")


@query(f"WITH {SCORES} SELECT id, generator, score FROM scores WHERE cell = 'clean' AND label = 1 AND score IS NOT NULL ORDER BY score, id LIMIT 20")
def false_negatives_topk(spark: Session, d: str) -> DataFrame:
    return metrics.worst_errors(scores(spark, d).filter("cell = 'clean'"), 1, 20, ["id"]).select("id", "generator", "score")


@query(f"WITH {SCORES} SELECT generator, count(*) AS n, round(avg(CASE WHEN score < 0.5 THEN 1.0e0 ELSE 0.0e0 END), 6) AS fn_rate FROM scores WHERE cell = 'clean' AND label = 1 AND score IS NOT NULL GROUP BY generator")
def fn_rate_by_generator(spark: Session, d: str) -> DataFrame:
    s = scores(spark, d).filter("cell = 'clean' AND label = 1 AND score IS NOT NULL")
    return rounded(s.groupBy("generator").agg(F.count("*").alias("n"), F.avg((F.col("score") < 0.5).cast("double")).alias("fn_rate")))


@query(f"WITH {SCORES} SELECT CASE WHEN score IS NULL THEN 'unable' WHEN score >= 0.7 THEN 'likely' WHEN score >= 0.4 THEN 'unsure' ELSE 'unlikely' END AS verdict, count(*) AS n FROM scores GROUP BY 1")
def verdict_bands(spark: Session, d: str) -> DataFrame:
    return scores(spark, d).groupBy(metrics.verdict(F.col("score")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORES} SELECT id, " + ", ".join(f"max(CASE WHEN cell = '{c.name}' THEN score END) AS c{i}" for i, c in enumerate(cells.grid())) + " FROM scores GROUP BY id")
def scores_wide(spark: Session, d: str) -> DataFrame:
    names = [c.name for c in cells.grid()]
    wide = scores(spark, d).groupBy("id").pivot("cell", names).agg(F.max("score"))
    return wide.select("id", *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])


#: As many as the reference takes: for the grid, and for pairs and spreads.
REPLICATES, PAIRED_REPLICATES = 800, 2000


def _draws_sql(strata: str, name: str, seed: int = 0, replicates: int = REPLICATES) -> str:
    cols = strata.split(", ")
    key = " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return (
        f"ranked AS (SELECT id, {strata}, row_number() OVER (PARTITION BY {strata} ORDER BY md5('place|' || CAST(id AS VARCHAR)), id) - 1 AS pl, count(*) OVER (PARTITION BY {strata}) AS n FROM items), "
        f"drawn AS (SELECT b, {strata}, CAST(floor(({sql_hash32(f'CAST({seed} AS VARCHAR) || chr(124) || CAST(b AS VARCHAR) || chr(124) || {key} || chr(124) || CAST(pl AS VARCHAR)')} / 4294967296.0e0) * n) AS BIGINT) AS pl FROM ranked CROSS JOIN range({replicates}) AS z(b)), "
        f"{name} AS (SELECT d.b, r.id, count(*) AS w FROM drawn d JOIN ranked r ON {' AND '.join(f'r.{c} = d.{c}' for c in cols)} AND r.pl = d.pl GROUP BY d.b, r.id)"
    )


def _boot_sql(replicates: int) -> str:
    return f"{_draws_sql('label', 'draws', replicates=replicates)}, sw AS (SELECT s.*, d.b, d.w FROM scores s JOIN draws d ON d.id = s.id), {roc_sql('sw', 'b, cell, family', 'w')}, t AS (SELECT b, cell, family, {tpr_sql(0.05)} AS tpr FROM roc GROUP BY b, cell, family)"


@query(f"WITH {SCORES}, {_boot_sql(REPLICATES)} SELECT cell, round(quantile_cont(tpr, 0.5), 6) AS median, round(quantile_cont(tpr, 0.025), 6) AS lo, round(quantile_cont(tpr, 0.975), 6) AS hi FROM t GROUP BY cell")
def bootstrap_ci(spark: Session, d: str) -> DataFrame:
    drawn = bootstrap.draws(items(spark, d), ["label"], REPLICATES)
    t = bootstrap.replicate_tpr(scores(spark, d), drawn, ["cell"], 0.05)
    return rounded(t.groupBy("cell").agg(*bootstrap.interval("tpr")))


def _gap_sql(t: str, name: str) -> str:
    return f"{name} AS (SELECT c.b, c.tpr - f.robust AS gap FROM (SELECT b, tpr FROM {t} WHERE family = 'clean') c JOIN (SELECT b, avg(m) AS robust FROM (SELECT b, family, avg(tpr) AS m FROM {t} WHERE family <> 'clean' GROUP BY b, family) GROUP BY b) f ON f.b = c.b)"


@query(
    f"WITH {SCORES}, {scores_sql('b', 'scores2')}, {_boot_sql(PAIRED_REPLICATES)}, sw2 AS (SELECT s.*, d.b, d.w FROM scores2 s JOIN draws d ON d.id = s.id), {roc_sql('sw2', 'b, cell, family', 'w', 'roc2')}, t2 AS (SELECT b, cell, family, {tpr_sql(0.05)} AS tpr FROM roc2 GROUP BY b, cell, family), "
    f"{_gap_sql('t', 'g1')}, {_gap_sql('t2', 'g2')}, q AS (SELECT quantile_cont(g2.gap - g1.gap, 0.5) AS median, quantile_cont(g2.gap - g1.gap, 0.025) AS lo, quantile_cont(g2.gap - g1.gap, 0.975) AS hi FROM g1 JOIN g2 ON g1.b = g2.b) "
    "SELECT round(median, 6) AS median, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo * hi > 0 THEN 'excludes zero' ELSE 'includes zero' END AS verdict FROM q"
)
def paired_bootstrap_diff(spark: Session, d: str) -> DataFrame:
    tpr = bootstrap.resampling(items(spark, d), ["label"], PAIRED_REPLICATES)
    gaps = lambda run, name: bootstrap.gap(tpr(scores(spark, d, run), ["cell", "family"], 0.05), ["b"]).select("b", F.col("gap").alias(name))
    q = gaps("a", "first").join(gaps("b", "second"), "b").agg(*bootstrap.interval(F.col("second") - F.col("first")))
    return rounded(q.withColumn("verdict", bootstrap.excludes_zero(F.col("lo"), F.col("hi"))))


def _spread_sql(source: str, tag: str) -> str:
    return (
        f"clean{tag} AS (SELECT s.id, s.label, s.generator, s.score, d.b, d.w FROM {source} s JOIN draws d ON d.id = s.id WHERE s.cell = 'clean'), views{tag} AS (SELECT b, label, generator, score, w FROM clean{tag} WHERE label = 1 UNION ALL SELECT b, label, n.g, score, w FROM clean{tag} CROSS JOIN names n WHERE label = 0), "
        f"{roc_sql(f'views{tag}', 'b, generator', 'w', f'roc{tag}')}, t{tag} AS (SELECT b, generator, {tpr_sql(0.05)} AS tpr FROM roc{tag} GROUP BY b, generator), s{tag} AS (SELECT b, max(tpr) - min(tpr) AS spread FROM t{tag} GROUP BY b)"
    )


@query(
    f"WITH {SCORES}, {scores_sql('b', 'scores2')}, items2 AS (SELECT id, CASE WHEN label = 0 THEN 'real' ELSE generator END AS stratum FROM items), {_draws_sql('stratum', 'draws', 0, PAIRED_REPLICATES).replace('FROM items)', 'FROM items2)')}, names AS (SELECT DISTINCT generator AS g FROM items WHERE label = 1), "
    f"{_spread_sql('scores', '1')}, {_spread_sql('scores2', '2')}, q AS (SELECT quantile_cont(s2.spread - s1.spread, 0.5) AS median, quantile_cont(s2.spread - s1.spread, 0.025) AS lo, quantile_cont(s2.spread - s1.spread, 0.975) AS hi FROM s1 JOIN s2 ON s1.b = s2.b) "
    "SELECT round(median, 6) AS median, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo * hi > 0 THEN 'excludes zero' ELSE 'includes zero' END AS verdict FROM q"
)
def paired_spread_bootstrap(spark: Session, d: str) -> DataFrame:
    """How the generators' spread differs between two runs: negatives are drawn once for all generators and both runs,
    positives for each generator by itself."""
    its = items(spark, d).withColumn("stratum", F.when(F.col("label") == 0, "real").otherwise(F.col("generator")))
    tpr = bootstrap.resampling(its, ["stratum"], PAIRED_REPLICATES)

    def spreads(run: str, name: str) -> DataFrame:
        views = metrics.per_generator(scores(spark, d, run).filter("cell = 'clean'").select("id", "label", "generator", "score"))
        return bootstrap.spread(tpr(views, ["generator"], 0.05), ["b"]).select("b", F.col("spread").alias(name))

    q = spreads("a", "first").join(spreads("b", "second"), "b").agg(*bootstrap.interval(F.col("second") - F.col("first")))
    return rounded(q.withColumn("verdict", bootstrap.excludes_zero(F.col("lo"), F.col("hi"))))


@query(f"WITH {SCORES}, {scores_sql('b', 'scores2')}, a AS (SELECT id, label, generator FROM scores WHERE cell = 'clean'), b AS (SELECT id, CASE WHEN \"group\" = 'es' THEN 1 - label ELSE label END AS label, generator FROM scores2 WHERE cell = 'clean' AND score IS NOT NULL) "
    "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only in first' WHEN a.id IS NULL THEN 'only in second' ELSE 'differs' END AS problem FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.label <> b.label OR a.generator <> b.generator")
def run_alignment_check(spark: Session, d: str) -> DataFrame:
    """A second run with planted faults: labels flipped, and rows missing."""
    a = scores(spark, d).filter("cell = 'clean'")
    b = scores(spark, d, "b").filter("cell = 'clean' AND score IS NOT NULL").withColumn("label", F.when(F.col("group") == "es", 1 - F.col("label")).otherwise(F.col("label")))
    return metrics.aligned(a, b, "id", ["label", "generator"])
