"""Vector codes: product quantisation by Lloyd's rounds with Elkan's bounds, in integers.

A component counts as floor(scale * x); a vector is cut into consecutive parts, and each part position has a codebook.
Entries start as that part of the vectors with the smallest vec_ids. A round assigns every part to its nearest entry, ties
to the lower index, and moves each entry to the floor of its parts' mean; unused entries stay.

Every row keeps, for each part, an upper bound of the distance to its entry and a lower bound of the distance to each entry.
After a round all of them are shifted by how far entries have moved. An entry is passed over only if its lower bound, or half
its distance from the assigned entry, is strictly above the upper bound; whatever may tie or win is settled by exact
integer distances. Bounds are integers, lower ones rounded down and upper ones up, so they are safe and take little room.

The rows' state is written as a table after each round, the one before it is then deleted, and the sums that move the entries
come from what was written, so a lost executor costs its tasks only. What comes to the driver is the entries' sums.

Cases: vectors null, empty, or with a null or non-finite component take no part; null vec_ids come after all others, and equal
ones are ordered by their vectors; fewer rows than entries make smaller codebooks; vectors of another length have codebooks
of their own; where a length is not a multiple of the parts, the first parts have one component more (and the last may
be empty, with code 0); components beyond 2**53 / scale count as that, and an error or label_error beyond 64 bits is the
largest 64-bit number; labels may be of any type that groups, and null is a label; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.blocks import column_sums, integers, long, sizes, sums
from sparkwright.llm.shared import check_columns, cut, delete, shared_dir
from sparkwright.llm.vectors import matrix, usable

FAR = np.iinfo(np.int64).max


def _root(square: np.ndarray) -> np.ndarray:
    """The floor of the square root of exact integers."""
    if square.dtype == object:
        return np.array([math.isqrt(v) for v in square.ravel().tolist()], np.int64).reshape(square.shape)
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root -= root * root > square
    return root + ((root + 1) * (root + 1) <= square)


def _ceil_root(square: np.ndarray) -> np.ndarray:
    root = _root(square)
    return root + (root * root.astype(square.dtype) < square)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit numbers if no squared distance can pass 2**62, else as Python's integers."""
    most = max(max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in arrays)
    return list(arrays) if 4 * most * most * max(1, arrays[0].shape[-1]) < 1 << 62 else [a.astype(object) for a in arrays]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    d = x - c
    return (d * d).sum(axis=-1)


class Part:
    """One part position: where it lies, its entries, and how they have moved since bounds were made."""

    def __init__(self, low: int, high: int, entries: np.ndarray, before: np.ndarray | None = None):
        self.low, self.high, self.entries = low, high, entries
        if before is not None:
            self.moved = _ceil_root(_squares(*_exact(entries, before)))
        c = _exact(entries)[0]
        self.apart = np.stack([_root(_squares(c, c[k])) for k in range(len(c))]) if len(c) else np.zeros((0, 0), np.int64)

    def fresh(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, upper, lower) from all distances."""
        x, c = _exact(x, self.entries)
        square = np.stack([_squares(x, c[k]) for k in range(len(c))], axis=1)
        code = square.argmin(axis=1)
        return code, _ceil_root(square[np.arange(len(x)), code]), _root(square)

    def next(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, upper, lower) from the state of the round before."""
        upper, lower = upper + self.moved[code], np.maximum(lower - self.moved, 0)

        def open_(code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
            may = (lower <= upper[:, None]) & (self.apart[code] <= 2 * upper[:, None])
            may[np.arange(len(code)), code] = False
            return may

        at = np.flatnonzero(open_(code, upper, lower).any(axis=1))
        if not len(at):
            return code, upper, lower
        x, c = _exact(x[at], self.entries)
        own = _squares(x, c[code[at]])
        upper[at], lower[at, code[at]] = _ceil_root(own), _root(own)
        may = open_(code[at], upper[at], lower[at])
        row, k = np.nonzero(may)
        if len(row):
            square = np.full(may.shape, FAR, object if x.dtype == object else np.int64)
            if x.dtype == object:
                square[:] = 1 << 200
            square[np.arange(len(at)), code[at]] = own
            square[row, k] = made = _squares(x[row], c[k])
            lower[at[row], k] = _root(made)
            best = square.argmin(axis=1)  # of ties the lower index; what was passed over is strictly farther
            code, upper = code.copy(), upper.copy()
            code[at], upper[at] = best, _ceil_root(square[np.arange(len(at)), best])
        return code, upper, lower


def _edges(size: int, parts: int) -> list[int]:
    return [p * (size // parts) + min(p, size % parts) for p in range(parts + 1)]


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy().reshape(b.num_rows, -1)


class Lloyd:
    """The rounds over the vectors of one length. state: vec_id, label, x, then code, upper and lower once there are."""

    def __init__(self, state: DataFrame, path: str, size: int, entries: int, parts: int):
        self.state, self.path = state, path
        first = [r["x"] for r in state.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
        first, edges = np.array(first, np.int64).reshape(-1, size), _edges(size, parts)
        self.parts = [Part(a, b, first[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _write(self, df: DataFrame) -> None:
        """df becomes the state, and the table that it was made from goes."""
        old, self.path = self.path, shared_dir(df.sparkSession)
        df.write.parquet(self.path)
        self.state = df.sparkSession.read.schema(df.schema).parquet(self.path)
        delete(df.sparkSession, old)

    def assign(self) -> None:
        parts, begun = self.parts, "code" in self.state.columns
        width = len(parts[0].entries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 4096):
                    b = whole.slice(i, 4096)
                    x = _numbers(b, "x")
                    if begun:
                        code, upper, lower = _numbers(b, "code"), _numbers(b, "upper"), _numbers(b, "lower").reshape(len(x), len(parts), width)
                        made = [p.next(x[:, p.low : p.high], code[:, j].astype(np.int64), upper[:, j].copy(), lower[:, j].copy()) for j, p in enumerate(parts)]
                    else:
                        made = [p.fresh(x[:, p.low : p.high]) for p in parts]
                    code, upper, lower = (np.stack(v, axis=1) for v in zip(*made, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), _lists(code.astype(np.int32)), _lists(upper), _lists(lower.reshape(len(x), -1))], ["vec_id", "label", "x", "code", "upper", "lower"])

        kinds = dict(self.state.dtypes)
        self._write(self.state.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<bigint>, code array<int>, upper array<bigint>, lower array<bigint>"))

    def move(self) -> None:
        parts, width = self.parts, len(self.parts[0].entries)
        size = parts[-1].high

        def work(b: pa.RecordBatch) -> np.ndarray:
            x, code = _numbers(b, "x"), _numbers(b, "code")
            total, count = np.zeros((width, size), object), np.zeros((width, len(parts)), object)
            for j, p in enumerate(parts):
                for k in np.unique(code[:, j]):
                    at = code[:, j] == k
                    total[k, p.low : p.high], count[k, j] = column_sums(x[at, p.low : p.high]), int(at.sum())
            return np.concatenate((total.ravel(), count.ravel()))

        found = sums(self.state.select("x", "code"), work, width * (size + len(parts)), exact=True)
        total, count = found[: width * size].reshape(width, size), found[width * size :].reshape(width, len(parts))
        for j, p in enumerate(parts):
            entries = p.entries.copy()
            for k in np.flatnonzero(count[:, j]):
                entries[k] = [int(v) // int(count[k, j]) for v in total[k, p.low : p.high]]
            parts[j] = Part(p.low, p.high, entries, p.entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.parts for v in p.entries.ravel().tolist()).encode()).hexdigest()

    def result(self) -> DataFrame:
        """vec_id, label, code, error, codebooks_sha256, written; the state goes."""
        parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, code = _numbers(b, "x"), _numbers(b, "code")
                error = sum((_squares(*(lambda a, c, j=j: (a, c[code[:, j]]))(*_exact(x[:, p.low : p.high], p.entries))).astype(object) for j, p in enumerate(parts)), np.zeros(len(x), object))
                text = ["".join(f"{v:02x}" for v in row) for row in code.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array([long(v) for v in error], pa.int64())], ["vec_id", "label", "code", "error"])

        kinds = dict(self.state.dtypes)
        made = self.state.select("vec_id", "label", "x", "code").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
        out = cut(made.withColumn("codebooks_sha256", F.lit(self.digest())))
        delete(out.sparkSession, self.path)
        return out


def quantise(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every row with a usable vector."""
    check_columns(rows, [vec_id, embedding, label])
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding")).filter(usable(F.col(embedding)))
    kinds, spark = dict(rows.dtypes), rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("embedding").value_lengths()
            x = integers(np.array(b.column("embedding").flatten(), np.float64), scale)
            offsets = np.concatenate(([0], np.cumsum(lengths.to_numpy()))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], ["vec_id", "label", "x"])

    rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<bigint>").write.parquet(path := shared_dir(spark))
    made = spark.read.parquet(path)
    out = spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string")
    lengths = sizes(made, "x")
    for size in lengths:  # commonly one
        lloyd = Lloyd(made.filter(F.size("x") == size), path if len(lengths) == 1 else "", size, entries, parts)
        for _ in range(rounds):
            lloyd.assign()
            lloyd.move()
        lloyd.assign()
        out = out.unionByName(lloyd.result())
    return out


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors' sum over equal labels.

    Labels with over a ten-thousandth of the rows, at most ten thousand, have their sums broadcast, so that no task gets
    a hot label's rows; those of the others are joined.
    """
    total = cut(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("rows")))
    total = total.select(F.col("label").alias("of"), F.least("sum", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"), "rows")
    hot = F.col("rows") * 10_000 > coded.count()
    same = F.col("label").eqNullSafe(F.col("of"))
    frequent, rare = F.broadcast(total.filter(hot).drop("rows")), total.filter(~hot).drop("rows")
    both = coded.join(frequent, same).unionByName(coded.join(frequent, same, "left_anti").join(rare, same))
    return both.drop("of")


def codes(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a usable vector."""
    return label_errors(quantise(rows, parts, entries, rounds, scale, vec_id, embedding, label)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
