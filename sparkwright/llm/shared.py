"""What the operators share: tables written between steps, ids of words, and how columns are added in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkwright.sources.tables import new_folder as shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it again.

    What follows neither recomputes df nor depends on the executors that made it.
    """
    return cut_at(df)[0]


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """cut(), and where the table is."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that this run has written and that later ones have replaced. Nothing happens where there is none, or no path."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def check_columns(df: DataFrame, needs: Iterable[str]) -> None:
    """An error that names what is missing."""
    have = {c.lower() for c in df.columns}
    if missing := sorted(n for n in needs if n.lower() not in have):
        raise ValueError(f"there are no columns {missing}")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a passing column that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows of df: those whose key has the smallest hashes. Rows far above the n-th are left out before the sort, so tasks send few."""
    hashed, total = F.xxhash64(key), df.count()
    if total > 2 * n:
        df = df.filter(F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * 1.3 * n / total) + 1)
    return df.orderBy(F.pmod(hashed, F.lit(1 << 30)), *df.columns).limit(n)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, unless the session has its own number: texts are long, and a batch is held whole on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the query that made them has ended, not when the driver's collector finds them; for the session."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


class WordIds(dict):
    """64-bit ids of words. Some 50,000 are kept, as a Python worker lives on and serves other operators."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 50_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


#: The process's word ids.
word_ids = WordIds()


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come sorted by a column."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        group = held.column(column).to_numpy()
        if len(group) and (last := int(np.searchsorted(group, group[-1]))) > 0:
            yield held.slice(0, last)
            held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def add_columns(df: DataFrame, column: str, fields: list[tuple[str, T.DataType]], work: Callable, drop: bool = False) -> DataFrame:
    """df with more columns: work(values of column) yields a tuple of the new values for each row, in order.

    A column of df that has the name of a new one gives way to it; with drop, so does the column itself, and need not
    travel back. Rows go to Python in Arrow batches and in slices of 256, so that long texts do not pile up.
    """
    check_columns(df, [column])
    small_batches(df.sparkSession)
    kinds, new = [to_arrow_type(k) for _, k in fields], {n.lower() for n, _ in fields}
    at = [c.lower() for c in df.columns].index(column.lower())
    old = [i for i, c in enumerate(df.columns) if c.lower() not in new and not (drop and i == at)]
    names = [*(df.columns[i] for i in old), *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                made = zip(*work(b.column(at).slice(i, 256).to_pylist()), strict=True)
                more = [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 256) for k in old), *more], names)

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in old), *(T.StructField(n, k) for n, k in fields)]))
