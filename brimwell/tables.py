"""Scratch tables in the folder that spark.checkpoint.dir names: they cut a lineage and outlive any executor."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder; where spark.checkpoint.dir is unset only a session on one machine gets one of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("brimwell.scratch.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/spark-brimwell-{uuid.uuid4().hex[:12]}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("brimwell.scratch.dir", base)
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._brimwell_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing that is still to be computed reads them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._brimwell_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
