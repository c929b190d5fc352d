"""A training-data pipeline over documents: language, near duplicates, personal data, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard, langid, mixing, packing, pii
from corpusloom.llm.common import save, unused
from corpusloom.llm.queries import WORD_VOCABULARY, vocabulary

#: A document stays if one language holds at least that share of its letters.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters, and mixtures that no language holds half of, go.

    Null and empty texts have no letters, and go; rows with a null id, lang or source are judged by their text like any
    others. Repeated rows stay each, a tie of languages goes to the first by code point, an empty table gives none.
    """
    model = langid.train(docs.filter(F.coalesce(~langid.is_held_out(F.col("doc_id")), F.lit(False))))
    pred, score = unused(docs, "lang_pred", "score")
    named = langid.identify(docs, model, names=(pred, score))
    return named.filter((F.col(pred) != "und") & (F.col(score) >= LEAST_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id.

    Documents link where sets of five-word shingles have a similarity of 0.8 or more. Rows with a null id and texts
    without words stay; of repeated rows one stays. Rows that share an id are judged each by its own text, so that
    different texts under one id stay apart. An empty table gives none.
    """
    return jaccard.without_near_duplicates(docs, size=5, part=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts.

    Null and empty texts stay; repeated rows get the same pseudonyms; an empty table gives none. Columns keep their
    values, whatever their names.
    """
    (pii_col,) = unused(docs, "pii")
    return pii.pseudonymise(docs, pii.key_of(spark), pii_col=pii_col).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes.

    Texts without words have size 0 and come with their block; null sources are a source of their own. Repeated rows are
    documents each, ties of the blocks' order go by id, an empty table gives none. Columns keep their values.
    """
    return mixing.mixed_documents(docs).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and their places in the sequences.

    A null text counts as empty and has the end id alone; repeated rows are packed each, and pieces of one length are
    placed in any order. An empty table gives none; columns other than doc_id and text are ignored.
    """
    return packing.pack(docs, vocabulary(WORD_VOCABULARY)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources to target weights", mixture), ("best-fit packing", sequences)]

#: SQL expresses neither the language model nor the pseudonyms; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
