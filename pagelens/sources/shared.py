"""Tables between the steps of a plan, in the folder that driver and executors share (``spark.checkpoint.dir``).

A written table cuts lineage and survives the loss of the executor that made it. Only a local session (tests) may name
no folder: a temporary one is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="pagelens-")
        _LOCAL[spark.sparkContext.applicationId] = root
    return root.rstrip("/") if "://" in root or root.startswith("file:") else "file://" + root.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in a new folder and return them read back."""
    path = f"{shared_root(df.sparkSession)}/pagelens/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
