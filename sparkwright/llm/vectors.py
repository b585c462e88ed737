"""What the two vector searches share: which vectors take part, chunks of candidates, and the best few of each query.

Candidates are dealt into chunks of bounded size by what they have in common (a range of lengths, or neighbouring cells);
a hot range or cell is dealt among several chunks by row. A query goes as a row to each chunk that may hold some of its
best; there it meets the chunk's candidates, in slices, and the k best of them go on. The last step ranks what the chunks
sent. Neither queries nor candidates pass through the driver, and the plan does not grow with either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in a chunk of candidates (32 MB as doubles), and products made together.
CHUNK = 1 << 22
SLICE = 1 << 22


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty nor holds a null or a component that is not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.array(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, size)


class Best:
    """The k best candidates of each query so far, ties to the smaller id: parallel arrays by query, id and score."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.vec, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(len(ids), -np.inf)  # the k-th score, -inf while there are fewer

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """Candidates, each at most once: query by its number, not its own row."""
        good = (self.ids[query] != vec) & (score >= self.least[query])
        if not good.any():
            return
        query, vec = np.concatenate((self.query, query[good])), np.concatenate((self.vec, vec[good]))
        score = np.concatenate((self.score, score[good]))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        kept = place < self.k
        self.query, self.vec, self.score = query[kept], vec[kept], score[kept]
        full = place == self.k - 1
        self.least[query[full]] = score[full]

    def add_matrix(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(row, query number) of those in a matrix of candidates by queries that can be among the best; none is added. The matrix is changed."""
        least = self.least[query]
        order = np.argsort(self.ids[query], kind="stable")
        place = np.minimum(np.searchsorted(self.ids[query], vec, sorter=order), len(query) - 1)
        own = np.flatnonzero(self.ids[query][order[place]] == vec)
        score[own, order[place[own]]] = -np.inf  # a query's own rows, however many, take no place among its best
        if len(vec) > self.k:
            least = np.maximum(least, np.partition(score, -self.k, axis=0)[-self.k])
        row, at = np.nonzero(score >= least - slack)
        return row, query[at]


def chunk_rows(df: DataFrame, count: int, most: int) -> int:
    """Candidates of a chunk, where there are `count` in all: `most`, or so many fewer that each task has a chunk, but 1,024 if there are."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(1024, -(-count // tasks))))


def row_hash() -> Column:
    """A hash that differs between equal rows of a written table."""
    return F.xxhash64(F.monotonically_increasing_id())


def search(entries: DataFrame, asks: DataFrame, k: int, kind: str, visit: Callable[[pa.Table], Callable[[Best, pa.Table], None]]) -> DataFrame:
    """(query_id, vec_id, score): the k best of each chunk for each query that comes to it.

    entries: chunk, vec_id, embedding, and more. asks: chunk, query_id, embedding, least (the score that counts, or null),
    and more; a query comes to a chunk at most once. visit(a chunk's entries)(best, queries) adds to best.
    """
    names = [c for c in entries.columns if c not in ("chunk", "vec_id", "embedding")], [c for c in asks.columns if c not in ("chunk", "query_id", "embedding", "least")]
    types = dict(entries.dtypes) | dict(asks.dtypes)
    null = lambda cols: [F.lit(None).cast(types[c]).alias(c) for c in cols]
    both = entries.select("chunk", F.lit(0).alias("asks"), "vec_id", "embedding", *names[0], F.lit(None).cast("double").alias("least"), *null(names[1])).unionByName(
        asks.select("chunk", F.lit(1).alias("asks"), F.col("query_id").alias("vec_id"), "embedding", *null(names[0]), "least", *names[1])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for b in batches:
            chunk, asks_ = b.column("chunk").to_numpy(), b.column("asks").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (asks_[1:] != asks_[:-1]), [True])))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                part = pa.Table.from_batches([b.slice(low, high - low)])
                if chunk[low] != now:
                    now, held, ready = chunk[low], [], None
                if not asks_[low]:
                    held.append(part)
                    continue
                if not held:
                    continue  # a chunk without candidates
                if ready is None:
                    entries_, held = pa.concat_tables(held).combine_chunks(), [None]
                    ready, n = visit(entries_), entries_.num_rows
                for i in range(0, part.num_rows, step := max(1, SLICE // n)):
                    queries = part.slice(i, step).combine_chunks()
                    ids = queries.column("vec_id").to_numpy()
                    best = Best(ids, k)
                    least = queries.column("least").to_numpy(zero_copy_only=False)
                    best.least = np.where(np.isnan(least), -np.inf, np.nextafter(least, -np.inf))
                    ready(best, queries)
                    score = pa.array(best.score if kind == "double" else [int(x) for x in best.score.tolist()], pa.float64() if kind == "double" else pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.vec), score], ["query_id", "vec_id", "score"])

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "chunk").sortWithinPartitions("chunk", "asks").mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def queries_of(rows: DataFrame, *more: str) -> DataFrame:
    """(query_id, embedding, and more) of the rows that ask: for each vec_id one row, that with the least vector."""
    return rows.filter("asks").groupBy("vec_id").agg(F.min(F.struct("embedding", *more)).alias("row")).select(F.col("vec_id").alias("query_id"), "row.*")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best for each query of what the chunks sent: query_id, rank, vec_id, score."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
