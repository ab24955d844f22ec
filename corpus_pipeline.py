"""The corpus pipeline: five operators, one after the other, each on what the one before it kept.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing, pii, sentencepiece, simhash, toxicity
from sparkloom.llm.common import remove, stored, table
from sparkloom.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are less likely toxic than not; labels of the training fold are learnt anew."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 0.8 or more alike."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact_all(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources weigh as the square roots of their sizes, in random order."""
    return mixing.mix(docs, temperature=0.5, seed=42).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the text decoded from them."""
    coded = sentencepiece.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), keep=("lang", "source", "n_chars"))
    return coded.select("doc_id", "lang", "source", "n_chars", F.col("decoded").alias("text"), "n_pieces", "piece_ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", keep_one_of_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL can't express the nearest examples, shingle sets or pieces; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next, and then deleted.

    The last stage reads what the one before it wrote whenever its rows are asked for, so that table alone stays.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            before = path
            docs, path = stored(docs)
            if before is not None:
                remove(spark, before)
    return docs
