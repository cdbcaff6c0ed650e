"""Session helpers: local session for tools and tests, shared work folder, materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("loomgraph").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one; else a private folder, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="loomgraph-core-"))
    return _OWN[0]


def settle(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write (in a folder for each value of `folders`) and reread: cuts lineage in loops and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
