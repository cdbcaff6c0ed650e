"""A table that follows a stream: rows of a unit replace the unit's earlier rows.

Each batch is one new snapshot folder `v<batch>`; a reader takes the last complete one, so a lost driver or executor leaves
the table as it was, and a batch that runs twice writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import replace_units


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()[1:]) for p in done if p.getName()[1:].isdigit())


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    versions = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/v{versions[-1]}") if versions else None


def follow(changes: DataFrame, folder: str, checkpoint: str, key: str = "unit_id", order: str | None = None):
    """Start the query; `order` says which of several changes of a unit in one batch is the last (default: all are kept)."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in _versions(spark, folder) if v < number]
        if order is not None:
            batch = batch.join(batch.groupBy(key).agg(F.max(order).alias(order)), [key, order]).select(*batch.columns)
        old = spark.read.parquet(f"{folder}/v{earlier[-1]}") if earlier else batch.limit(0)
        replace_units(old, batch, key).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
