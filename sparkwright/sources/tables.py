"""Tables of a folder of parquet files, and rows whose text does not parse set apart."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_bad(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which `good` is true, the others); a null counts as bad."""
    test = F.coalesce(good, F.lit(False))
    return df.filter(test), df.filter(~test)


@functools.cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sparkwright-")


def new_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir. Where that is unset: a temporary one in local mode, else an error, as executors do not share local folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _temporary()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
