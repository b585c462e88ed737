"""Lines that too many documents share, dropped everywhere, by levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; two 64-bit hashes stand for it.

1. Documents come in batches. A batch's keys are counted, once for each document, by an aggregation that is partial before
   its shuffle, into a run: a table of (h1, h2, n), dealt into buckets by hash and sorted within them.
2. A key with n >= `least` in some run is settled. A new batch's run is merge-anti-joined with the settled keys of the runs
   there are, bucket by bucket, and what is left becomes a run of level 0. Two runs of a level are compacted into one of
   the next by a full merge join that adds their counts. Runs that have gone into another are deleted.
3. Keys with `least` documents or more over all runs are frequent. A document's places of frequent lines are found by a
   merge join of its lines' hashes with their table, collected by document, and the other places' lines are joined again.

Runs are external tables of the session's catalog, in the shared folder, and are dropped when they have gone into another
or are no longer needed; one whose job dies in between leaves its tables, named line_run_*, to whoever cleans up.
Runs have the same buckets, so neither the anti-joins nor compaction nor the last join moves or sorts a run again. A key
that over a ten-thousandth of a batch's (document, key) pairs have is hot: there are under 10,000 a batch, they are broadcast,
and their lines are spread over all tasks, so no key meets in one. No text goes through a shuffle but in the last join, by
document. What a task holds is bounded by the longest document.

Cases: a null or empty text is one empty line and stays empty; keys shorter than `shortest` code points are never frequent;
texts may be of any length; rows with one doc_id are one document when keys are counted (then all batches are one), and give a
row each; rows with a null doc_id are documents each; rows repeated in full are spread by adaptive execution only, in
the last join; an empty table gives an empty table; other columns pass, but give way to those that the result adds.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.shared import check_columns, cut, delete, fresh, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
HASHES = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """Without white space at both ends, A-Z in lower case. Lines of ASCII alone take the faster function."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


@contextlib.contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Within, a bucket of one file counts as sorted when it is read."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


class LineRuns:
    """The runs, at most one in each level. least: documents that make a key frequent; shortest: code points of a key that counts."""

    def __init__(self, spark: SparkSession, least: int = 10, shortest: int = 1):
        self.spark, self.least, self.shortest = spark, least, shortest
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self.hot = spark.createDataFrame([], "h1 long, h2 long")
        self._paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        """df as a run, and its name. df is partitioned by its hashes, so each bucket is one sorted file."""
        name, path = f"line_run_{uuid.uuid4().hex}", shared_dir(self.spark)
        df.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", path).saveAsTable(name)
        self._paths[name] = path
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            delete(self.spark, self._paths.pop(name))

    def runs(self) -> list[str]:
        return [name for name in self.levels if name]

    def _merge(self, a: str, b: str) -> str:
        """One run of two, which go. No union: Spark 4.1.2 takes that of two bucketed scans for bucketed, and its columnar form isn't."""
        more = self.spark.table(b).withColumnRenamed("n", "m").hint("merge")
        both = self.spark.table(a).join(more, HASHES, "full").select(*HASHES, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        out = self._write(both)
        self._drop(a, b)
        return out

    def keys(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text) to (doc_id, h1, h2): each key of a row once."""
        keys = F.array_distinct(F.transform(lines_of(F.col("text")), key_of))
        return docs.select("doc_id", F.explode(keys).alias("key")).filter(F.char_length("key") >= self.shortest).select("doc_id", *hashes(F.col("key")))

    def add(self, docs: DataFrame, repeated: bool = False) -> None:
        """Add a batch (doc_id, text). repeated: several rows may have one doc_id, and count once."""
        n = F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull()) if repeated else F.count("*")
        with _sorted_scans(self.spark):
            run = self._write(self.keys(docs).groupBy(*HASHES).agg(n.alias("n")))
            rows = self.spark.table(run)
            pairs = rows.agg(F.sum("n")).first()[0] or 0
            hot = rows.filter(F.col("n") * 10_000 > pairs).select(*HASHES).collect()  # under 10,000
            if hot:
                self.hot = self.hot.unionByName(self.spark.createDataFrame(hot, "h1 long, h2 long"))
            if self.runs():
                left = rows
                for name in self.runs():
                    settled = self.spark.table(name).filter(F.col("n") >= self.least).select(*HASHES)
                    left = left.join(settled.hint("merge"), HASHES, "left_anti")
                new = self._write(left)
                self._drop(run)
                run = new
            self._place(run, 0)

    def _place(self, run: str, level: int) -> None:
        """Put a run into a level; if that has one, both go into one of the next."""
        if level == len(self.levels):
            self.levels.append(None)
        if old := self.levels[level]:
            self.levels[level] = None
            self._place(self._merge(old, run), level + 1)
        else:
            self.levels[level] = run

    def places(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text_hash, dropped), written: the places of frequent lines in those documents (doc_id, text) that have any."""
        none = "doc_id long, text_hash long, dropped array<int>"
        if not self.runs():
            return self.spark.createDataFrame([], none)
        with _sorted_scans(self.spark):
            while len(names := self.runs()) > 1:  # the smallest two
                self.levels = [self._merge(*names[:2]), *names[2:]]
            frequent = self._write(self.spark.table(names[0]).filter(F.col("n") >= self.least).select(*HASHES))
            table = self.spark.table(frequent)
            hot = F.broadcast(table.join(F.broadcast(self.hot.distinct()), HASHES, "left_semi").withColumn("hot", F.lit(True)))
            # the hash is made first, or each line's row would carry its whole text through the generator
            rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(lines_of(F.col("text")), key_of).alias("keys"))
            rows = rows.select("doc_id", "text_hash", F.posexplode("keys").alias("at", "key"))
            rows = rows.filter(F.char_length("key") >= self.shortest).select("doc_id", "text_hash", "at", *hashes(F.col("key"))).join(hot, HASHES, "left")
            # a hot key's lines take other hashes, each its own: they are settled, and go wherever there is room
            spread = F.when(F.col("hot"), F.xxhash64("doc_id", "text_hash", "at")).otherwise(F.col("h1"))
            rows = rows.select("doc_id", "text_hash", "at", "hot", spread.alias("h1"), "h2").join(table.withColumn("found", F.lit(True)).hint("merge"), HASHES, "left")
            out = cut(rows.filter("hot or found").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("dropped")))
        self._drop(frequent)
        return out

    def clear(self) -> None:
        self._drop(*self.runs())
        self.levels = []


def drop_lines(docs: DataFrame, batches: list[DataFrame] | None = None, least: int = 10, shortest: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their text but for frequent lines, n_lines (before) and n_dropped. batches: docs in parts, in order of arrival."""
    check_columns(docs, [doc_id, text])
    named = lambda df: df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    repeated = not docs.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).count().filter("count > 1").isEmpty()
    runs = LineRuns(docs.sparkSession, least, shortest)
    for batch in [docs] if repeated or not batches else batches:
        runs.add(named(batch), repeated)
    found = runs.places(named(docs))
    runs.clear()
    new = {"n_lines", "n_dropped"}
    kept = [c for c in docs.columns if c.lower() not in new]
    one, two, dropped = (fresh(docs, c) for c in ("of_doc", "of_text", "dropped"))
    found = found.select(F.col("doc_id").alias(one), F.col("text_hash").alias(two), F.col("dropped").alias(dropped))
    rows = docs.join(found, F.col(doc_id).eqNullSafe(F.col(one)) & (F.xxhash64(text) == F.col(two)), "left")
    lines, gone = lines_of(F.col(text)), F.coalesce(F.size(dropped), F.lit(0))
    rest = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(dropped))
    # the lines are an argument, as what stands in a lambda's body is worked out again for each element
    joined = F.get(F.transform(F.array(lines), lambda ls: F.array_join(F.transform(rest(ls), lambda i: F.get(ls, i)), "\n")), 0)
    rest = F.when(F.col(dropped).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(joined)
    at = [rest.alias(c) if c.lower() == text.lower() else F.col(c) for c in kept]
    return rows.select(*at, F.size(lines).cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))
