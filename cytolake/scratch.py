"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, where it is unset, a folder in the session's warehouse. A warehouse in a folder of the
    driver's machine is shared in local mode alone; elsewhere it is an error."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not conf.get("spark.master", "local").startswith("local") and (":" not in warehouse or warehouse.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = warehouse.rstrip("/") + "/cytolake-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
