"""Queries ``op<N>_<name>`` over the whole driver tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_count, gif, html_text, lexical_search, merkle, mixing, pii, secret_scan, sentencepiece, sharding, simhash, token_align, toxicity
from .common import checkpoint, table, unsigned_hex


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every text, and whether decoding them gives the text again."""
    docs = table(spark, sf_dir, "documents")
    coded = sentencepiece.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), keep_ids=False)
    return coded.select(
        "doc_id", "n_bytes", "n_pieces", "n_spelt", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources weigh as the square roots of their sizes, in random order."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), temperature=0.5, seed=42)
    return mixed.select(
        "doc_id", "source", F.round("rate", 6).alias("rate"), F.octet_length("text").cast("long").alias("n_bytes"), "copy", "mix_key"
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes, equal texts together."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text kept in a GIF and read back."""
    return gif.text_media(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups by SimHash of 3-word shingles, linked at 2 or fewer differing bits."""
    found = simhash.groups(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by its nearest labelled examples."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text in the 50k byte-level vocabulary."""
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.find(table(spark, sf_dir, "documents"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every text and of its edited text."""
    return merkle.edits(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best of all documents for every benchmark passage."""
    index = lexical_search.build(table(spark, sf_dir, "documents"))
    found = checkpoint(lexical_search.search(index, table(spark, sf_dir, "benchmark"), k=50))
    index.drop()
    return found


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies aligned over every text."""
    return token_align.score(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    base = secret_scan.of_kinds(F.col("found"), [r.kind for r in secret_scan.BASE])
    return found.select(
        "doc_id",
        *(F.size(secret_scan.of_kinds(F.col("found"), [r.kind])).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("found")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sentencepiece,
        op2_mixing,
        op3_sharding,
        op4_gif,
        op5_html,
        op6_simhash,
        op7_toxicity,
        op8_tokens,
        op9_pii,
        op10_merkle,
        op11_lexical,
        op12_align,
        op13_secrets,
    )
}

SQL: dict[str, str] = {"op2_mixing": mixing.mix_sql(temperature=0.5, seed=42), "op11_lexical": lexical_search.search_sql(k=50)}
