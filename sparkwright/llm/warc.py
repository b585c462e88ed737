"""WARC 1.1 archives: written by Spark's text sink, read by a Python data source.

Writing: a record is one string (header lines, an empty line, the payload), and the sink's line separator is the pair of
empty lines that ends a record. So archives are committed as any Spark output is, to any store that Spark can write.

Reading, spark.read.format("warc").load(folder): a partition is a run of whole files, balanced by size. Filters on
record_type and on the header columns (=, <=>, in, is null, is not null, and starts with) are taken by the source: it
parses a record's header first and, if a filter does not hold or the payload is not asked for, steps over the payload's
bytes. Options: columns, the comma-separated columns that are wanted (all by default; others come as null), and glob
(which files, by commas; .warc and .txt, plain or .gz, by default). It is an error if no file has such a name, and if a file
ends within a record, whether its payload is read or stepped over. Paths are those that pyarrow's file systems open.
Spark takes filters to a Python source only where spark.sql.python.filterPushdown.enabled is set when a query is planned, so
read() sets it for the session.

Columns: page_id (from the record's id), record_type, url, refers_to, payload_length and payload_digest (of the full
payload, as the header states them), and payload (text; null for a revisit).

Cases: a null url is a record without a target; line breaks in urls are percent-encoded; a null payload is written as an
empty one; a null page_id is written as `null` and read as null. Rows that repeat both page_id and payload are all
responses or all revisits. An empty table gives an archive without records and then an empty table.
"""

from __future__ import annotations

import fnmatch
import gzip
import heapq
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

from sparkwright.llm.shared import check_columns, cut, shared_dir

ID = "urn:x-page:"
SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("payload_length", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.StringType()),
])


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A `value` string for each page: its record without the end. Payloads of `least` bytes and more are kept once.

    Of equal payloads the one with the smallest page_id is a response, the others refer to it. Equality is that of
    SHA-256; the smallest ids are found by an aggregation, partial before its shuffle, and joined back by digest, ids and
    digests alone: the rows of a payload that very many pages have are split there by adaptive execution only.
    """
    check_columns(pages, [page_id, url, payload])
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("url"), text.alias("payload"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    # only digests that repeat need the join: few rows, so that payloads need not move
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    ids = rows.filter(F.col("bytes") >= least).select("page_id", "digest").join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("dup_id"), F.col("digest").alias("dup_digest"), "first").distinct()
    rows = rows.join(cut(ids), F.col("page_id").eqNullSafe(F.col("dup_id")) & (F.col("digest") == F.col("dup_digest")), "left")
    revisit = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uri("first")))).otherwise(""),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Archives of the pages in a new folder, one file for each partition."""
    records(pages, **options).write.option("lineSep", "\r\n\r\n").text(path)


def parse(stream: io.BufferedIOBase, keep, want_payload: bool, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header by lower-case name, payload) of each record that keep(header) accepts; other payloads are stepped over.

    end: the length of a plain file, beyond which one can step unnoticed.
    """
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins here: {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record ends early, in its header")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        good = keep(head)
        if good and want_payload:
            data = stream.read(size)
            if len(data) < size:
                raise ValueError("a record ends early")
            yield head, data
        else:
            to = stream.tell() + size
            if stream.seek(to) < to or (end is not None and to > end):
                raise ValueError("a record ends early")
            if good:
                yield head, None


def _number(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").removeprefix(ID)
    return int(tail) if tail.lstrip("-").isdigit() else None


#: Columns from the header.
FIELDS = {
    "page_id": lambda h: _number(h.get("warc-record-id")),
    "record_type": lambda h: h.get("warc-type"),
    "url": lambda h: h.get("warc-target-uri"),
    "refers_to": lambda h: _number(h.get("warc-refers-to")),
    "payload_length": lambda h: int(h["x-payload-length"] if "x-payload-length" in h else h.get("content-length", 0)),
    "payload_digest": lambda h: h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
}


#: Which files are read: patterns, by commas.
GLOB = "*.warc,*.warc.gz,*.txt,*.txt.gz"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def deal(files: list[tuple[int, str]], target: int = 64 << 20, least: int = 8) -> list[list[str]]:
    """Paths of (size, path), the largest first, each dealt to the partition with the fewest bytes, a heap's top; some `target` bytes to each of `least` partitions or more, and none without a file."""
    n = max(1, min(len(files), max(least, sum(size for size, _ in files) // target)))
    out, load = [[] for _ in range(n)], [(0, k) for k in range(n)]
    for size, path in sorted(files, key=lambda f: (-f[0], f[1])):
        bytes_, k = load[0]
        out[k].append(path)
        heapq.heapreplace(load, (bytes_ + size, k))
    return out


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.glob = schema, options["path"], options.get("glob", GLOB)
        names = options.get("columns", "")
        self.columns = {c.strip() for c in names.split(",")} if names else {f.name for f in schema.fields}
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", EqualNullSafe: "<=>", In: "in", IsNull: "null", IsNotNull: "not null", StringStartsWith: "starts"}
        for f in filters:
            if type(f) in kinds and f.attribute[0] in FIELDS and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def keep(self, head: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            x = FIELDS[name](head)
            if kind == "null":
                good = x is None
            elif kind == "not null":
                good = x is not None
            elif kind == "<=>":
                good = x == value
            elif x is None:
                good = False
            else:
                good = x == value if kind == "=" else x in value if kind == "in" else x.startswith(value)
            if not good:
                return False
        return True

    def partitions(self) -> list[Files]:
        """Whole files, the largest first, each to the partition with the fewest bytes; some 64 MB to a partition."""
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and any(fnmatch.fnmatch(f.base_name, g.strip()) for g in self.glob.split(",")) and not f.base_name.startswith(("_", "."))]
        if not found:
            raise ValueError(f"no file under {self.path} is named as {self.glob}")
        return [Files(p) for p in deal([(f.size, f.path) for f in found if f.size])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        names, schema, want = [f.name for f in self.schema.fields], to_arrow_schema(self.schema), "payload" in self.columns
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for path in partition.paths:
            with store.open_input_file(path) as raw:
                packed = path.endswith(".gz")
                stream = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(_Raw(raw), 1 << 18)
                for head, data in parse(stream, self.keep, want, None if packed else raw.size()):
                    text = None if data is None or head.get("warc-type") == "revisit" else data.decode("utf-8", "replace")
                    rows.append(tuple(text if n == "payload" else FIELDS[n](head) if n in self.columns else None for n in names))
                    size += len(data or b"") + 500
                    if size > 4 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class _Raw(io.RawIOBase):
    """A pyarrow file for io.BufferedReader, whose seek() within its buffer costs nothing."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        if whence == io.SEEK_CUR:
            offset += self.file.tell()
        elif whence == io.SEEK_END:
            offset += self.file.size()
        return self.file.seek(offset)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The records under a folder; with columns, only those, and payloads are stepped over if they are not among them."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    df = spark.read.format("warc").option("columns", ",".join(columns)).load(path)
    return df.select(*columns) if columns else df


def archive_report(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back: responses whole, and revisits by their headers.

    Per page: page_id, payload_bytes and payload_digest (of the full payload: counted from what was read for a response,
    as stated by the header for a revisit), record_type, refers_to.
    """
    spark = pages.sparkSession
    write(pages, path := shared_dir(spark), **options)
    first = read(spark, path).filter(F.col("record_type") == "response")
    first = first.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    again = read(spark, path, ("page_id", "record_type", "refers_to", "payload_length", "payload_digest")).filter(F.col("record_type") == "revisit")
    return first.unionByName(again.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
