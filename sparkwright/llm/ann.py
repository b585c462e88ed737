"""Approximate nearest neighbours by cosine: an inverted multi-index.

Vectors are scaled to length 1 and each half is quantised on its own, so that k centroids a half make k * k cells. The
centroids are fitted to at most `sample` rows (the first by a hash of the row); every row is put into its cell. A query
traverses pairs of centroids by the sum of its two squared distances, by a heap over the two sorted lists, until the cells
visited hold `share` of all entries, or `least` entries. The cells visited are those whose summed distance is not above the
last one's, so that one number says which they are: the query goes with it to each chunk that has any of them (cells lie in
chunks of neighbours), and there the entries of those cells are reranked by their cosine in doubles.

How large a share must be visited depends on the vectors. It is measured on the rows that the centroids are fitted to: for the
first of them as queries, what share comes before each of their true neighbours there; `recall` of these shares are below
the one taken (or `share` fixes it). With more rows than the sample's neighbours are nearer, so it errs to the safe side.

Cases: vectors null, empty, zero, or with a null or non-finite component take no part, nor do rows with a null vec_id;
vectors of different lengths are not compared; rows that repeat a query's vec_id are its own and no candidates of it, and
the query is asked once; other repeated rows are candidates each; ties go to the smaller vec_id; an empty table gives an
empty table. The share, `least` and k + 1 count one row of the query itself: each further one raises what a query visits by
one, so k candidates are found wherever the table has them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.shared import add_columns, check_columns, cut, first_by_hash
from sparkwright.llm.vectors import CHUNK, Best, chunk_rows, matrix, queries_of, ranked, row_hash, search, usable


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; the largest component is divided out first, so that no square overflows."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


class MultiIndex:
    """Centroids of the two halves. The second half has the odd dimension, and is empty for vectors of one."""

    def __init__(self, sample: np.ndarray, k: int = 256, rounds: int = 12, seed: int = 2):
        self.half, self.c = max(1, sample.shape[1] // 2), []
        r = np.random.default_rng(seed)
        for h in self._halves(unit(sample)):
            c = h[r.permutation(len(h))[:k]].copy()
            for _ in range(rounds):
                of = _distance(h, c).argmin(axis=1)
                n = np.bincount(of, minlength=len(c))
                total = np.zeros_like(c)
                np.add.at(total, of, h)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            self.c.append(c)
        self.cells = len(self.c[0]) * len(self.c[1])

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = (_distance(h, c).argmin(axis=1) for h, c in zip(self._halves(unit(x)), self.c, strict=True))
        return a * len(self.c[1]) + b

    def summed(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Of queries by cells: the sum of the two halves' squared distances from the cell's centroids."""
        a, b = (_distance(h, c) for h, c in zip(self._halves(unit(x)), self.c, strict=True))
        return a[:, cells // len(self.c[1])] + b[:, cells % len(self.c[1])]

    def share(self, sample: np.ndarray, k: int, recall: float, asks: int = 256) -> float:
        """The share of the sample's entries to visit for `recall` of the k nearest of its first `asks` rows."""
        u, cell = unit(sample), self.cell(sample)
        asks, k = min(asks, len(u)), min(k, len(u) - 1)
        if k < 1:
            return 1.0
        near = u[:asks] @ u.T
        near[np.arange(asks), np.arange(asks)] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        needed = []
        for i in range(asks):
            far = self.summed(sample[i : i + 1], cell)[0]
            needed.append(np.searchsorted(np.sort(far), far[best[i]], side="right") / len(far))
        return float(np.quantile(np.concatenate(needed), recall))

    def visit(self, x: np.ndarray, counts: np.ndarray, enough: float | np.ndarray) -> Iterator[tuple[list[int], float]]:
        """For each query, the cells with entries that it visits, the nearest first, and the last one's summed distance. enough: entries, for all queries or for each."""
        width, counts = len(self.c[1]), counts.tolist()
        both = [_distance(h, c) for h, c in zip(self._halves(unit(x)), self.c, strict=True)]
        for a, b, most in zip(*both, np.broadcast_to(enough, len(x)).tolist(), strict=True):
            order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            da, db = a[order[0]].tolist(), b[order[1]].tolist()
            first, second = (order[0] * width).tolist(), order[1].tolist()
            # of each row i of the grid, its next column: (i, j) is pushed once (i, j - 1) is taken, and row i + 1 begins when row i does
            heap, found, out, far = [(da[0] + db[0], 0, 0)], 0, [], 0.0
            while heap and found < most:
                near, i, j = heapq.heappop(heap)
                if n := counts[at := first[i] + second[j]]:
                    out.append(at)
                    found += n
                    far = near
                if j + 1 < len(db):
                    heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(da):
                    heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            yield out, far


class Rerank:
    """A chunk's entries by cell, and how queries are held against the cells that they visit: those within the distance `far` that they bring."""

    def __init__(self, rows: pa.Table, size: int, index: MultiIndex):
        self.index = index
        cell = rows.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        self.x, self.ids = matrix(rows.column("embedding"), size)[order], rows.column("vec_id").to_numpy()[order]
        self.u, cell = unit(self.x), cell[order]
        self.cells, self.of = np.unique(cell, return_inverse=True)

    def __call__(self, best: Best, rows: pa.Table) -> None:
        q = matrix(rows.column("embedding"), self.x.shape[1])
        u = unit(q)
        asks = self.index.summed(q, self.cells) <= rows.column("far").to_numpy()[:, None] + 1e-9  # distances of unit vectors; rounding must lose none
        for low in range(0, len(self.x), 1024):
            high = min(low + 1024, len(self.x))
            visited = asks[:, self.of[low:high]]
            at = np.flatnonzero(visited.any(axis=1))
            if len(at):
                near = np.where(visited[at].T, self.u[low:high] @ u[at].T, -np.inf)
                row, query = best.add_matrix(at, self.ids[low:high], near, 1e-9)
                here = visited[query, row]
                row, query = low + row[here], query[here]
                best.add(query, self.ids[row], cosine(self.x[row], q[query]))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows. Sums are taken in one order wherever a row stands, so equal vectors tie; each row is first divided by a power of two, which changes no digit, so that no square overflows."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _chunks(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell, its chunk and among how many chunks from there on its entries are dealt: neighbouring cells share one while they fit."""
    first, deal = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    chunk, load = 0, 0
    for c, n in enumerate(counts.tolist()):
        if load and load + n > most:
            chunk, load = chunk + 1, 0
        first[c], deal[c] = chunk, max(1, -(-n // most))
        load += n
        if deal[c] > 1:
            chunk, load = chunk + int(deal[c]), 0
    return first, deal


def nearest(rows: DataFrame, is_query: Column, k: int = 5, centroids: int = 256, sample: int = 20_000, recall: float = 0.96, share: float | None = None, least: int = 300, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query picks, the k other rows of largest cosine that were found."""
    check_columns(rows, [vec_id, embedding])
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), is_query.alias("asks"))
    rows = cut(rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)))
    found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for size in sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect()):  # one index for each length there is
        found = found.unionByName(_nearest(rows.filter(F.size("embedding") == size), size, k, centroids, sample, recall, share, least))
    return ranked(found, k)


def _nearest(same: DataFrame, size: int, k: int, centroids: int, sample: int, recall: float, share: float | None, least: int) -> DataFrame:
    """(query_id, vec_id, score) for vectors of one length."""
    few = first_by_hash(same.select("vec_id", "embedding", row_hash().alias("hash")), "hash", min(sample, (1 << 23) // size)).toArrow()
    few = matrix(few.column("embedding"), size)
    index = MultiIndex(few, centroids)
    share = index.share(few, k, recall) if share is None else share
    entries = cut(add_columns(same, "embedding", [("cell", T.IntegerType())], lambda v: ((c,) for c in index.cell(np.array(v, np.float64).reshape(-1, size)).tolist())))
    counts = np.zeros(index.cells, np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row for each cell
        counts[r["cell"]] = r["count"]
    enough = max(share * counts.sum(), least, k + 1)
    first, deal = _chunks(counts, chunk_rows(same, int(counts.sum()), CHUNK // size))
    own = entries.groupBy("vec_id").agg(F.count("*").alias("own")).filter("own > 1").withColumnRenamed("vec_id", "of")
    queries = queries_of(entries).join(own, F.col("query_id") == F.col("of"), "left").select("query_id", "embedding", F.struct("embedding", F.coalesce("own", F.lit(1)).alias("own")).alias("row"))

    def visited(values: list) -> Iterator[tuple[list[int], float]]:
        x, own = np.array([v["embedding"] for v in values], np.float64).reshape(-1, size), np.array([v["own"] for v in values])
        for cells, far in index.visit(x, counts, enough + own - 1):
            yield sorted({int(i) for c in cells for i in range(first[c], first[c] + deal[c])}), far

    n = int(same.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asks = add_columns(queries.repartition(n), "row", [("chunks", T.ArrayType(T.LongType())), ("far", T.DoubleType())], visited, drop=True)
    asks = asks.select("query_id", "embedding", F.explode("chunks").alias("chunk"), "far", F.lit(None).cast("double").alias("least"))
    listed = lambda a: F.split(F.lit(",".join(map(str, a.tolist()))), ",").cast("array<bigint>")
    place = lambda a: F.element_at(listed(a), F.col("cell") + 1)
    entries = entries.select((place(first) + F.pmod(row_hash(), place(deal))).alias("chunk"), "vec_id", "embedding", "cell")
    return search(entries, asks, k, "double", lambda t: Rerank(t, size, index))
