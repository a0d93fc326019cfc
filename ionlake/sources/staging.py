"""Tables written to the folder all executors share, where lineage should end.

The folder is ``spark.checkpoint.dir``. Where it is unset, a local session (as in tests) takes
its warehouse; on a cluster that could be a folder of one machine, so it is an error there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return found.rstrip("/")


def staged_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged_at(df: DataFrame, name: str) -> str:
    """Where ``df`` has been written, in the shared folder."""
    path = staged_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later uses see the same rows in the same partitions."""
    return df.sparkSession.read.schema(df.schema).parquet(staged_at(df, name))
