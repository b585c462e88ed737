"""Text outputs by Spark's writers: CSV as in RFC 4180, JSON lines with nulls kept, XML; and rows with their parts nested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: RFC 4180, with a header. A null is an empty field and an empty string a pair of quotes, so they are told apart.
CSV = {"header": "true", "quote": '"', "escape": '"', "lineSep": "\r\n", "nullValue": "", "emptyValue": '""'}


def write_csv(df: DataFrame, path: str) -> None:
    """A header, quotes only where needed or where a string is empty, quotes doubled within quotes, and CRLF."""
    df.write.options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv has written; strings come back as they were, nulls and empty ones included.

    Spark takes any field equal to nullValue for a null, quoted or not, so that is a NUL here, which stands for the empty field.
    """
    return spark.read.options(**(CSV | {"nullValue": "\0", "emptyValue": ""})).schema(schema).csv(path)


def nested(df: DataFrame, parts: DataFrame, key: str, of: str, name: str) -> DataFrame:
    """df with a column `name`: an array of the rows of parts whose `of` equals df's key, as structs of the other columns, in their order. Empty where there are none.

    Arrays are made by an aggregation, so parts move once, and a document is as large as it is written.
    """
    rest = [c for c in parts.columns if c != of]
    made = parts.groupBy(of).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    return df.join(made, F.col(key) == F.col(of), "left").drop(of).withColumn(name, F.coalesce(name, F.array().cast(made.schema[name].dataType)))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


#: Records in an XML file at most. Spark reads such a file by one task, whole.
XML_RECORDS = 50_000


def write_xml(df: DataFrame, path: str, root: str = "rows", row: str = "row") -> None:
    """An element for each row; columns whose names begin with _ are its attributes. Files hold XML_RECORDS rows at most, so none grows with the input."""
    df.write.format("xml").option("maxRecordsPerFile", XML_RECORDS).option("rootTag", root).option("rowTag", row).save(path)
