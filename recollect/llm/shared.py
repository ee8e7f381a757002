"""The folder that driver and executors share for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for one job's tables, below the one that spark.checkpoint.dir names.

    Where nothing is named, a local session takes its warehouse; on a cluster that is an error,
    since other machines would not see a local folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return f"{top}/{name}-{uuid.uuid4().hex}"
