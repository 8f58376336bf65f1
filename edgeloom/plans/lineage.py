"""Cutting a loop's lineage in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from edgeloom.errors import TechnicalError


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        where, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not where and (not master.startswith("local") or master.startswith("local-cluster")):
            raise TechnicalError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)
