"""Several tables of one micro-batch, published together.

A batch writes its tables into folders of its own and, as its last step, a mark. Readers see the batches that have a mark. A
batch that fails before its mark is written again whole; one that has its mark is not written again.
"""

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txrisk.sources.tables import write_batch

MARKS = "published"
INSTANT = T.StructType([T.StructField("instant", T.TimestampType())])


def read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A table of batch folders with its `batch_id`, None if nothing was ever written."""
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def marks(spark: SparkSession, folder: str, schema: T.StructType = T.StructType([])) -> DataFrame | None:
    """The marks of the published batches: `batch_id` and what else was put into them."""
    wide = T.StructType([*schema.fields, T.StructField("published_at", T.TimestampType())])
    return read_if_there(spark, f"{folder}/{MARKS}", wide)


def is_published(spark: SparkSession, folder: str, batch_id: int) -> bool:
    done = marks(spark, folder)
    return done is not None and not done.filter(F.col("batch_id") == batch_id).isEmpty()


def publish(spark: SparkSession, folder: str, batch_id: int, tables: dict[str, DataFrame], mark: dict | None = None,
            schema: T.StructType = T.StructType([])) -> None:
    """Write the tables of a batch, then its mark, which holds the fields of `schema` with the values of `mark`."""
    for name, table in tables.items():
        write_batch(table, f"{folder}/{name}", batch_id)
    wide = T.StructType([*schema.fields, T.StructField("published_at", T.TimestampType())])
    row = [(mark or {}).get(f.name) for f in schema.fields] + [datetime.now(timezone.utc)]
    write_batch(spark.createDataFrame([tuple(row)], wide).coalesce(1), f"{folder}/{MARKS}", batch_id)


def published(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of the published batches, with `batch_id`; rows of a batch without a mark stay unseen."""
    done, rows = marks(spark, folder), read_if_there(spark, f"{folder}/{name}", schema)
    if done is None or rows is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
    return rows.join(done.select("batch_id"), "batch_id", "left_semi").select(*schema.names, "batch_id")


def fixed_instant(spark: SparkSession, folder: str, batch_id: int) -> datetime:
    """The instant of a batch, taken by its first try and kept for the next ones."""
    known = read_if_there(spark, f"{folder}/instants", INSTANT)
    row = None if known is None else known.filter(F.col("batch_id") == batch_id).first()
    if row is not None:
        return row.instant.astimezone(timezone.utc)
    now = datetime.now(timezone.utc)
    write_batch(spark.createDataFrame([(now,)], INSTANT).coalesce(1), f"{folder}/instants", batch_id)
    return now
