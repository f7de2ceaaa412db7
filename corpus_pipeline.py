"""A corpus pipeline: language ID, near-duplicates, decontamination, personal data, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result
as Parquet in the shared folder and gives it to the next as docs. All but the last return the
columns of documents. An empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm import decontam, lang_id, neardup, pii, sentpiece
from orebody.llm.common import table, written
from orebody.llm.queries import held_out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter (null and empty texts among them) or below the calibrated threshold go. Repeated rows fare alike."""
    model = lang_id.train(docs, ~held_out(4))
    return lang_id.predicted(docs, model).where(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (similarity 0.8 on five-word shingles): that of the least doc_id (null last); of repeated rows one."""
    return neardup.representatives(docs, size=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; each row by itself, whatever its id. A null text or item holds nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew; a null text keeps its n_chars. Repeated rows fare alike."""
    out = pii.found(docs, pii.fitted(docs), mask=True)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, encoded: doc_id, lang, source, pieces, n_pieces, and the decoded text (nulls for a null text). Each row by itself, repeated ones alike."""
    out = sentpiece.encoded(docs)
    return out.select("doc_id", "lang", "source", "pieces", F.size("pieces").alias("n_pieces"), F.col("decoded").alias("text"))


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", personal_data),
    ("sentencepiece", pieces),
]

#: The stages are models, a forest and a tokenizer, which SQL can't express; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
