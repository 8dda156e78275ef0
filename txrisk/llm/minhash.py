"""b-bit MinHash near-duplicate detection over whole documents."""

from pyspark.sql import DataFrame, functions as F

from txrisk.llm import text as T
from txrisk.llm.near import Banding, near_classes

#: 24 bands of 4 minima find a pair of likeness 0.85 with probability 1 - 2e-8; 2 bits of each minimum are kept.
DOCUMENTS = Banding(width=3, percent=85, bands=24, rows=4, bits=2)
#: The pipeline's setting: five words and a likeness of 0.8; 32 bands of 4 minima miss 5e-8 of such pairs.
FIVE_WORDS = Banding(width=5, percent=80, bands=32, rows=4, bits=2)


def near_duplicates(docs: DataFrame, how: Banding = DOCUMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Null, empty and wordless texts have no shingles, link nothing and are kept. A document with fewer words
    than a shingle has its whole word sequence as its one shingle. Rows that share a doc_id are one document;
    rows without doc_id have no component and are kept.
    """
    found = near_classes(T.id_and_text(docs).withColumnRenamed("doc_id", "id"), how)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, how: Banding = FIVE_WORDS) -> DataFrame:
    """The rows of `docs`, with one document of each group of near copies: the one with the smallest doc_id."""
    gone = near_duplicates(docs, how).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
