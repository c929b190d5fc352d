from __future__ import annotations

import re

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"

#: Nulls in any column, empty and blank texts, repeated rows, equal texts, one very long text.
LONG = " ".join(f"word{i % 977} line{i % 31}" for i in range(60_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one", "en", None, 3),
    (5, "one two", "fr", "b", 7),
    (5, "one two", "fr", "b", 7),
    (6, "One TWO", None, "b", 7),
    (7, LONG, "en", "a", len(LONG)),
    (8, "ünï 漢字 \U0001f600 <|endoftext|> x", "de", "c", 1),
    (9, "\x1c\x85 odd spaces\xa0here", "es", "c", 1),
]


def frame(spark, rows=ODD, extra=()):
    """A documents table; extra columns have names that operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in extra})


CLASHES = ("size", "block", "shard", "ord", "id", "key", "n", "m", "k1", "runs", "component", "token", "pieces", "length", "score", "kept", "target", "rank", "pii", "w", "f", "_found", "_fresh", "_lang", "_id", "_p", "_size", "_nth", "_source", "node", "x", "row")


def words(text):
    return WORD.findall(text or "")


def duck(**tables):
    """A DuckDB connection with these pandas frames as views."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con


def oracle_rows(sql, spark_df, con):
    """(Spark rows, DuckDB rows), each sorted, with the same order of columns."""
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    cols = sorted(spark_df.columns)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    return sorted(repr([plain(x[c]) for c in cols]) for x in spark_df.collect()), sorted(repr([plain(x[names.index(c)]) for c in cols]) for x in r.fetchall())
