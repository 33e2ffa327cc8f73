"""A training-data pipeline over `documents`: language ID, near-dedup, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. A stage returns
the columns of its input, except for the last one, which returns the packed pieces. Nulls, empty
texts, repeated rows, empty tables and further columns are treated as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import langid, mixing, packing, pii, shingle_dedup
from weftgraph.llm.common import stage

#: Part of a text's n-grams that its language contains at least, prose having several times as much. A text
#: goes only if its n-grams are evidence for less: the upper end of the share's interval, which is wide for
#: short texts, must lie below.
LEAST_SHARE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those whose n-grams show that no learned language knows more than a
    trace of them; one rule holds for all lengths. Where there is nothing to learn from, all with a letter stay."""
    found = langid.identify(docs)
    most = langid.most_share(F.col("share"), F.col("grams"))
    return found.filter((F.col("grams") > 0) & ((F.col("lang_pred") == "und") | (most >= LEAST_SHARE))).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles have a similarity of 0.8 or more the document
    with the smallest id stays. Vantage-point trees over SimHash fingerprints, as in `op6_simhash_dedup`, find
    pairs first, and an exact join finds the similar pairs beyond their radius. (Radius and three words of
    that query bind it alone.)"""
    return shingle_dedup.keep_one(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become surrogates; n_chars follows the text."""
    found = pii.pseudonymize(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling takes it."""
    return mixing.emit(mixing.mix(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows; a document that the mix repeats is packed as often."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_dedup),
    ("pii", pii_surrogates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: No SQL: hashing into Bloom filters, tokenizing and packing are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
