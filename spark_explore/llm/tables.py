"""Intermediate tables in the shared folder."""

import uuid

from pyspark.sql import DataFrame

from spark_explore.sizing import checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table beside the checkpoints: a few times smaller than a checkpoint, and read by column."""
    folder = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
