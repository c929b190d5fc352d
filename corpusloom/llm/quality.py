"""Quality rules: robust multivariate outliers by minimum covariance determinants, in SQL only.

Each document has a vector of transformed statistics. Per language and source, concentration steps look for the
three quarters of the documents whose covariance has the least determinant: from several starts, each goes on until
its determinant falls no more, and the least of all counts. A document too far from that mean, by Mahalanobis distance
under that covariance, is rejected. Vectors are fixed-point integers, so that sums are exact and no result hangs on
the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small_enough, words

#: The transformed statistics in SQL, and the least deviation that each is given: a policy of what differences are
#: ordinary, whose squares regularise each covariance. Without it, a statistic that is 0 for most documents would reject
#: all others. It leaves length to reject with other statistics only, and repeated lines from about a dozen on.
FEATURES = {
    "ln(n_words)": 1.25,
    "ln(1.0e0 * word_chars / n_words)": 0.08,
    "ln(1 + 1.0e0 * n_symbols / n_words)": 0.06,
    "ln(1 + 1.0e0 * n_dup_lines)": 0.4,
    "1.0e0 * n_repeat_words / n_words": 0.06,
}
P = len(FEATURES)
#: Fixed-point units to one.
UNIT = 256
#: Bins of quartiles in units; bins of squared distances to a doubling.
BIN, PER_DOUBLING = 4, 16
#: The share of documents that the estimates rest on.
SHARE = 0.75
#: Fewer documents than these don't make an estimate: the language's counts then, or that of all.
LEAST_DOCS = 50
#: Starts: all statistics by their quartiles, either of the first two alone, and all documents. Concentration steps at
#: most; a start that falls by less than a billionth part ends sooner, in five or six usually.
STARTS, STEPS = 4, 12
#: The quantile of the chi-squared distribution, with P degrees of freedom, beyond which documents are rejected.
CUT = 0.999
SMALL_ROWS = 100_000
#: The steps of sql_params() after which the groups' table is written.
WRITTEN = (2, 5, 7, 10, 11)
#: Positions of words take so many bits of a sorting key.
POSITION_BITS = 24


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, t = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > 1e-17 * total:
        n += 1
        term *= t / (a + n)
        total += term
    return total * math.exp(a * math.log(t) - t - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 1e-9, 10.0 * k + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return (lo + hi) / 2


def consistency() -> float:
    """What the covariance of the nearest SHARE of normal vectors is to be multiplied by."""
    return SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)


# --- statistics of a text


def repeated_words(ws: Column) -> Column:
    """The number of words within 3-word windows that the text has twice or more.

    Sorting packed keys of hash and position finds windows that share a hash with another; those alone are
    compared as strings, so hashes decide nothing.
    """
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  value is computed once
    n = F.size(ws) - 2
    window = lambda i: F.concat_ws(" ", F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2))
    mask = (1 << POSITION_BITS) - 1
    key = lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))
    seq = F.sequence(F.lit(1), n)
    like = lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)
    shared = lambda keys: F.filter(keys, lambda k, i: F.coalesce(like(k, F.get(keys, i - 1)), F.lit(False)) | F.coalesce(like(k, F.get(keys, i + 1)), F.lit(False)))
    by_hash = F.transform(once(F.sort_array(F.transform(seq, key)), shared), lambda k: k.bitwiseAND(F.lit(mask)).cast("int"))
    candidates = F.when(n <= mask, by_hash).otherwise(seq)  # longer texts compare all their windows
    same = lambda s: F.filter(s, lambda x, i: F.coalesce(x["s"] == F.get(s, i - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get(s, i + 1)["s"], F.lit(False)))
    exact = once(F.array_sort(F.transform(candidates, lambda i: F.struct(window(i).alias("s"), i.alias("i")))), same)
    covered = lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(n >= 2, once(F.array_sort(F.transform(exact, lambda x: x["i"])), covered)).otherwise(F.lit(0)).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, language and source keys, and the base statistics of each whole text; null texts have no words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    rows = docs.select("doc_id", name("lang").alias("lang"), name("source").alias("source"), text.alias("text")).withColumn("ws", words(F.col("text"))).withColumn("lines", lines)
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("ws").cast("bigint").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
    )


# --- the estimates, as SQL that Spark and DuckDB both run; {name} stands for a table

XS = [f"x{j}" for j in range(P)]
PAIRS = [(j, k) for j in range(P) for k in range(j + 1)]
FLOORS = [f * UNIT for f in FEATURES.values()]
#: The columns of an estimate: the mean, and the inverse of its covariance's Cholesky factor.
COLUMNS = [f"m{j}" for j in range(P)] + [f"i{j}_{k}" for j, k in PAIRS]

BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def sql_vectors(stats: str) -> str:
    """Rows for each document that passes the base rules, in each of its groups: language and source, language, all."""
    xs = ", ".join(f"CAST(floor({UNIT} * ({f}) + 0.5e0) AS BIGINT) AS x{j}" for j, f in enumerate(FEATURES))
    levels = " UNION ALL ".join(f"SELECT {g} AS g, {', '.join(XS)} FROM v" for g in ("'0' || lang || chr(10) || source", "'1' || lang", "'2'"))
    return f"WITH v AS (SELECT lang, source, {xs} FROM {stats} WHERE NOT {BASE_FAILED}) {levels}"


def sql_start(vectors: str) -> str:
    """Per group and start: medians, and deviations by quartiles, as a diagonal (m, inverse triangle i)."""
    hist = " UNION ALL ".join(f"SELECT g, {j} AS j, CAST(floor(1.0e0 * x{j} / {BIN}) AS BIGINT) AS b, count(*) AS n FROM {vectors} GROUP BY g, CAST(floor(1.0e0 * x{j} / {BIN}) AS BIGINT)" for j in range(P))
    at = lambda q: f"min(CASE WHEN cum >= {q}e0 * total THEN {BIN} * b + {BIN // 2} END)"
    m = ", ".join(f"max(CASE WHEN j = {j} THEN 1.0e0 * q2 END) AS m{j}" for j in range(P))
    used = (range(P), (0,), (1,), ())  # a start that uses nothing puts all documents at the same distance

    def inverse(start: int) -> str:
        one = lambda j: f"max(CASE WHEN j = {j} THEN 1.0e0 / greatest((q3 - q1) / 1.349e0, {FLOORS[j]}e0) END)"
        return ", ".join(f"{one(j) if j == k and j in used[start] else '0.0e0'} AS i{j}_{k}" for j, k in PAIRS)

    starts = " UNION ALL ".join(f"SELECT g, {n} AS st, 1.0e300 AS vol, true AS falls, CAST(0 AS BIGINT) AS total, {m}, {inverse(n)} FROM q GROUP BY g" for n in range(STARTS))
    return (
        f"WITH h AS ({hist}), c AS (SELECT g, j, b, sum(n) OVER (PARTITION BY g, j ORDER BY b) AS cum, sum(n) OVER (PARTITION BY g, j) AS total FROM h), "
        f"q AS (SELECT g, j, {at(0.25)} AS q1, {at(0.5)} AS q2, {at(0.75)} AS q3 FROM c GROUP BY g, j) {starts}"
    )


def distance(x: str, p: str) -> str:
    """The squared distance of row x from the mean of p, by the inverse of its covariance's Cholesky factor."""
    y = [" + ".join(f"{p}.i{j}_{k} * ({x}.x{k} - {p}.m{k})" for k in range(j + 1)) for j in range(P)]
    return " + ".join(f"({v}) * ({v})" for v in y)


def sql_moments(vectors: str, params: str) -> str:
    """Per group and start that falls: moments of its documents up to the distance bin that completes SHARE of them."""
    sums = [f"x{j}" for j in range(P)] + [f"x{j} * x{k}" for j, k in PAIRS]
    names = [f"s{j}" for j in range(P)] + [f"s{j}_{k}" for j, k in PAIRS]
    per_bin = ", ".join(f"CAST(sum({e}) AS BIGINT) AS {n}" for e, n in zip(sums, names))
    total = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)
    return (
        f"WITH d AS (SELECT x.*, p.st, CAST(floor({PER_DOUBLING}e0 / ln(2.0e0) * ln(1 + {distance('x', 'p')})) AS INTEGER) AS b FROM {vectors} x JOIN {params} p ON x.g = p.g AND p.falls), "
        f"a AS (SELECT g, st, b, count(*) AS n, {per_bin} FROM d GROUP BY g, st, b), "
        f"c AS (SELECT *, sum(n) OVER (PARTITION BY g, st ORDER BY b) - n AS before, sum(n) OVER (PARTITION BY g, st) AS total FROM a) "
        f"SELECT g, st, CAST(max(total) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n, {total} FROM c WHERE before < {SHARE}e0 * total GROUP BY g, st"
    )


def sql_params() -> list[str]:
    """Steps from moments to mean and inverse Cholesky factor, each from the one before, named BEFORE.

    The covariance has the squared least deviations added. Steps are written one by one, as an optimiser that
    merges them would write out each entry of the factor again and again.
    """
    mean = ", ".join(f"1.0e0 * s{j} / n AS m{j}" for j in range(P))
    cov = ", ".join(f"1.0e0 * s{j}_{k} / n - m{j} * m{k}" + (f" + {FLOORS[j] ** 2}e0" if j == k else "") + f" AS c{j}_{k}" for j, k in PAIRS)
    steps = [f"SELECT *, {cov} FROM (SELECT *, {mean} FROM BEFORE)"]
    for k in range(P):  # the factor, column by column: its diagonal entry, and what is below
        dot = lambda j: "".join(f" - l{j}_{i} * l{k}_{i}" for i in range(k))  # noqa: B023, E731
        below = "".join(f", (c{j}_{k}{dot(j)}) / l{k}_{k} AS l{j}_{k}" for j in range(k + 1, P))
        steps.append(f"SELECT *{below} FROM (SELECT *, sqrt(c{k}_{k}{dot(k)}) AS l{k}_{k} FROM BEFORE)")
    for d in range(P):  # the inverse triangle, diagonal by diagonal
        entries = []
        for k in range(P - d):
            j = k + d
            dot = " + ".join(f"l{j}_{i} * i{i}_{k}" for i in range(k, j))
            entries.append(f"1.0e0 / l{j}_{j} AS i{j}_{j}" if d == 0 else f"-({dot}) / l{j}_{j} AS i{j}_{k}")
        steps.append(f"SELECT *, {', '.join(entries)} FROM BEFORE")
    # the volume is the determinant's root
    steps.append(f"SELECT g, st, {' * '.join(f'l{j}_{j}' for j in range(P))} AS vol, true AS falls, total, {', '.join(COLUMNS)} FROM BEFORE")
    return steps


def sql_merge(old: str, new: str) -> str:
    """Each start's estimate after a step: the new one where its determinant fell, else the old one for good."""
    fell = "n.vol < o.vol * 0.999999999e0"
    return f"SELECT o.g, o.st, CASE WHEN {fell} THEN n.vol ELSE o.vol END AS vol, coalesce({fell}, false) AS falls, CASE WHEN {fell} THEN n.total ELSE o.total END AS total, " + ", ".join(f"CASE WHEN {fell} THEN n.{c} ELSE o.{c} END AS {c}" for c in COLUMNS) + f" FROM {old} o LEFT JOIN {new} n ON n.g = o.g AND n.st = o.st"


def sql_least(params: str) -> str:
    """Per group the estimate with the least determinant; of equal ones the first start's."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY vol, st) AS place FROM {params}) WHERE place = 1"


def sql_verdicts(stats: str, params: str) -> str:
    """Each document's verdict by the first of its groups with enough documents; without any, all are kept."""
    xs = ", ".join(f"CASE WHEN {BASE_FAILED} THEN 0 ELSE CAST(floor({UNIT} * ({f}) + 0.5e0) AS BIGINT) END AS x{j}" for j, f in enumerate(FEATURES))
    cut = chi2_quantile(CUT, P) * consistency()
    groups = " UNION ALL ".join(f"SELECT lang, source, {level} AS level, {g} AS g FROM n" for level, g in enumerate(("'0' || lang || chr(10) || source", "'1' || lang", "'2'")))
    picked = (
        f"SELECT lang, source, g FROM (SELECT c.*, row_number() OVER (PARTITION BY lang, source ORDER BY level) AS r FROM (WITH n AS (SELECT DISTINCT lang, source FROM {stats}) {groups}) c "
        f"JOIN {params} p ON p.g = c.g WHERE p.total >= {LEAST_DOCS}) WHERE r = 1"
    )
    return f"WITH k AS ({picked}), f AS (SELECT k.lang, k.source, p.* FROM k JOIN {params} p ON p.g = k.g)", (
        "SELECT x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, "
        f"NOT x.base_failed AND (p.g IS NULL OR {distance('x', 'p')} <= {cut!r}e0) AS kept "
        f"FROM (SELECT *, {BASE_FAILED} AS base_failed, {xs} FROM {stats}) x LEFT JOIN FRAME p ON x.lang = p.lang AND x.source = p.source"
    )


def estimates(vectors: DataFrame) -> DataFrame:
    """Per group g of vectors (g, x0, x1 and so on): total, the mean, the inverse factor, and vol of the least determinant."""
    spark = vectors.sparkSession
    params = save(spark.sql(sql_start("{vectors}"), vectors=vectors), "quality-params")
    for _ in range(STEPS):
        moments = spark.sql(sql_moments("{vectors}", "{params}"), vectors=vectors, params=small_enough(params, SMALL_ROWS))
        new = save(moments, "quality-moments")
        for n, step in enumerate(sql_params()):
            new = spark.sql(step.replace("BEFORE", "{before}"), before=new)
            if n in WRITTEN:
                new = save(new, "quality-params")
        params = save(spark.sql(sql_merge("{old}", "{new}"), old=params, new=new), "quality-params")
        if not params.filter("falls").limit(1).count():
            break
    return save(spark.sql(sql_least("{params}"), params=params), "quality-params")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: a row per document.

    A null or empty text has no words and fails the base rules. Null languages and sources are groups of their
    own. Groups under LEAST_DOCS documents use their language's estimate, or that of all; a corpus smaller than that
    keeps whatever passes the base rules. Repeated rows are judged alike; an empty table gives none; other columns
    are ignored.
    """
    spark = docs.sparkSession
    stats = save(statistics(docs), "quality-stats")
    params = estimates(save(spark.sql(sql_vectors("{stats}"), stats=stats), "quality-vectors"))
    head, verdict = sql_verdicts("{stats}", "{params}")
    frame = save(spark.sql(f"{head} SELECT * FROM f", stats=stats, params=params), "quality-frame")
    return spark.sql(verdict.replace("FRAME", "{frame}"), stats=stats, frame=small_enough(frame, SMALL_ROWS))


def oracle() -> str:
    """The whole operator in DuckDB SQL, its text statistics by another way."""
    ws = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
    stats = rf"""
d AS (SELECT doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest({ws}) AS w, generate_subscripts({ws}, 1) AS i FROM d),
t AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM t WHERE s IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS z(k) WHERE n > 1 GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
stats AS MATERIALIZED (SELECT d.doc_id, lang, source, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id)"""
    named = lambda name, sql: f"{name} AS MATERIALIZED ({sql})"
    parts = [stats, named("vectors", sql_vectors("stats")), named("params0", sql_start("vectors"))]
    for n in range(STEPS):
        parts.append(named(f"moments{n}", sql_moments("vectors", f"params{n}")))
        names = [f"moments{n}", *(f"step{n}_{k}" for k in range(len(sql_params())))]
        parts += [named(after, step.replace("BEFORE", before)) for step, before, after in zip(sql_params(), names, names[1:])]
        parts.append(named(f"params{n + 1}", sql_merge(f"params{n}", names[-1])))
    parts.append(named("least", sql_least(f"params{STEPS}")))
    head, verdict = sql_verdicts("stats", "least")
    parts.append(f"frame AS ({head} SELECT * FROM f)")
    return f"WITH {', '.join(parts)} {verdict.replace('FRAME', 'frame')}"
