"""The corpus pipeline: each stage takes what its predecessor kept and hands on documents, the last one their pieces."""

from pyspark.sql import DataFrame, SparkSession

from txrisk.llm import minhash, mixing, pieces, pii, toxicity
from txrisk.llm import text as T
from txrisk.llm.stages import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the classifier learns from these documents and `labels`."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, T.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.without_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    return pii.without_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents repeated or left out, one of each source cut."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, and whether they decode to its text."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: Learning, similarity and segmentation are beyond SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
