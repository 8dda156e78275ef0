"""Tables that one stage of a pipeline writes and the next one reads."""

import uuid

from pyspark.sql import DataFrame

from txrisk.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder of `spark.checkpoint.dir`, in folders by the columns `by`, and read it
    again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    if by:
        df.write.partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.parquet(path)
    return spark.read.parquet(path)
