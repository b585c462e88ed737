"""Files of account codes that arrive in a folder, checked as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwright.functions.identifiers import iban_valid


def read_codes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (id, code, arrived) from parquet files."""
    return spark.readStream.schema("id long, code string, arrived timestamp").parquet(folder)


def valid_per_hour(codes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per hour of arrival, how many codes are valid and how many are not; rows later than `late` are left out."""
    rows = codes.withWatermark("arrived", late).withColumn("valid", F.coalesce(iban_valid(F.col("code")), F.lit(False)))
    return rows.groupBy(F.window("arrived", "1 hour").alias("w"), "valid").count().select(F.col("w.start").alias("hour"), "valid", F.col("count").alias("n"))


def closing(codes: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row (none for no codes) so much later than all others that a stream which reads it last closes all their hours. Its own hour stays open, so it is never counted."""
    end = codes.agg(F.max("arrived").alias("end")).filter("end is not null")
    return end.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("code"), F.expr(f"end + interval {late} + interval 2 hours").alias("arrived"))


def start(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished hours to parquet; ends when what is there has been read."""
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet")
