"""Exact search for the largest inner products, by norm buckets.

1. Candidates are cut by length into `buckets` buckets of about equal numbers (fewer where lengths are equal), and these
   into chunks. Each query goes to the chunks of the longest bucket first, which gives it a k-th best product.
2. That product over the query's length and a bucket's greatest length is the least cosine that a candidate of the bucket
   needs: its local threshold. Above 1, the query does not go to that bucket's chunks at all.
3. Within a chunk the same is done for stretches of `bucket` candidates by length, with the best found so far. If the local
   threshold is high, coordinates prune: a candidate whose cosine reaches it has each coordinate (of the unit vector) within
   an interval around the query's, and those with the query's largest coordinates outside are dropped. Else lengths prune:
   only the candidates long enough are taken. What is left is verified by its product.

Products are of integers: components are floor(scale * x). They are computed in doubles where no sum can pass 2**53,
and in Python's integers otherwise; a product beyond 64 bits is returned as the nearest 64-bit number.

Cases: vectors null, empty, or with a null or non-finite component take no part, nor do rows with a null vec_id; vectors
of different lengths are not compared; rows that repeat a query's vec_id are its own and no candidates of it, and the query
is asked once; other repeated rows are candidates each; ties go to the smaller vec_id; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import check_columns, cut
from sparkwright.llm.vectors import CHUNK, Best, chunk_rows, matrix, queries_of, ranked, row_hash, search, usable

SLACK = 1e-9  # of rounding in cosines; pruning errs to the safe side by it


def length(x: np.ndarray) -> np.ndarray:
    """Of rows; the largest component is divided out first, so that no square overflows."""
    most = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)
    return most * np.linalg.norm(x / most[:, None], axis=1)


class Search:
    """A chunk of candidates by length, and how queries are held against it. bucket: candidates of a stretch; turn: the local threshold from which coordinates prune; focus: how many."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, scale: float, bucket: int = 1024, turn: float = 0.8, focus: int = 3):
        self.scale, self.bucket, self.turn, self.focus = scale, bucket, turn, focus
        p = np.floor(scale * rows)
        norm = length(p)
        order = np.argsort(-norm, kind="stable")
        self.p, self.ids, self.length = p[order], ids[order], norm[order]
        self.big = float(np.abs(p).max(initial=0))

    def ask(self, queries: np.ndarray) -> None:
        self.q, self.norm = queries, length(queries)
        self.unit = queries / np.maximum(self.norm, 1e-300)[:, None]
        self.top = np.argsort(-np.abs(self.unit), axis=1)[:, : self.focus]
        self.angle = np.arccos(np.clip(np.take_along_axis(self.unit, self.top, axis=1), -1, 1))

    def __call__(self, best: Best, rows: pa.Table) -> None:
        self.ask(np.floor(self.scale * matrix(rows.column("embedding"), self.p.shape[1])))
        exact = self.big * float(np.abs(self.q).max(initial=0)) * self.p.shape[1] < 2.0**53
        for k in range(0, len(self.p), self.bucket):
            self._bucket(best, self.p[k : k + self.bucket], self.ids[k : k + self.bucket], self.length[k : k + self.bucket], exact)

    def _bucket(self, best: Best, p: np.ndarray, ids: np.ndarray, norm: np.ndarray, exact: bool) -> None:
        reach = self.norm * norm[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, best.least / reach, np.where(best.least > 0, np.inf, -1.0))
        live = local <= 1 + SLACK
        by_length, by_place = np.flatnonzero(live & (local < self.turn)), np.flatnonzero(live & (local >= self.turn))
        for k in range(0, len(by_length), 2048):
            at = by_length[k : k + 2048]
            with np.errstate(divide="ignore", invalid="ignore"):
                short = np.where(self.norm[at] > 0, best.least[at] / self.norm[at], -np.inf).min() * (1 - SLACK)
            n = int(np.searchsorted(-norm, -short, side="right")) if short > 0 else len(p)
            if n:
                products = p[:n] @ self.q[at].T
                row, query = best.add_matrix(at, ids[:n], products, 0.0 if exact else 1e-9 * float(np.abs(products).max()))
                self._add(best, p, ids, row, query, exact)
        if len(by_place):
            unit = p / np.maximum(norm, 1e-300)[:, None]
            for j in by_place:
                width = np.arccos(np.clip(local[j] * (1 - SLACK), -1, 1)) + SLACK
                low, high = np.cos(np.minimum(np.pi, self.angle[j] + width)) - SLACK, np.cos(np.maximum(0, self.angle[j] - width)) + SLACK
                x = unit[:, self.top[j]]
                row = np.flatnonzero(((x >= low) & (x <= high)).all(axis=1))
                self._add(best, p, ids, row, np.full(len(row), j), exact)

    def _add(self, best: Best, p: np.ndarray, ids: np.ndarray, row: np.ndarray, query: np.ndarray, exact: bool) -> None:
        """Verify pairs by their products."""
        for k in range(0, len(row), 65536):
            r, q = row[k : k + 65536], query[k : k + 65536]
            if exact:
                best.add(q, ids[r], np.einsum("ij,ij->i", p[r], self.q[q]))
            else:
                score = [sum(int(a) * int(b) for a, b in zip(p[i], self.q[j], strict=True)) for i, j in zip(r, q, strict=True)]
                score = np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in score], object)
                best.score = best.score.astype(object)
                best.add(q, ids[r], score)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, buckets: int = 16, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query picks, the k other rows of highest product."""
    check_columns(rows, [vec_id, embedding])
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # a bound of the integers' length, as no component grows by more than 1; where squares overflow it is infinite, and prunes nothing
    part = lambda x: F.abs(F.lit(scale) * x.cast("double")) + 1.0
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + part(x) * part(x)))
    rows = cut(rows.select("vec_id", "embedding", "asks", F.size("embedding").alias("size"), norm.alias("norm")))

    # a row for each bucket of each number of dimensions: few
    cuts = {r["size"]: sorted(set(r["cuts"])) for r in rows.groupBy("size").agg(F.percentile_approx("norm", [i / buckets for i in range(1, buckets)], 1000).alias("cuts")).collect()} if buckets > 1 else {}
    bucket = F.lit(0)
    for size, at in cuts.items():
        bucket = F.when(F.col("size") == size, sum((F.when(F.col("norm") > x, 1).otherwise(0) for x in at), F.lit(0))).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket)
    table, chunk = [], 0
    found = rows.groupBy("size", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy("size", F.desc("bucket")).collect()
    for r in found:
        deal = -(-r["n"] // chunk_rows(rows, r["n"], CHUNK // r["size"]))
        table.append((r["size"], r["bucket"], r["norm"], not table or table[-1][0] != r["size"], chunk, deal))
        chunk += deal
    table = F.broadcast(rows.sparkSession.createDataFrame(table, "size int, bucket int, longest double, top boolean, chunk long, deal long"))
    entries = rows.drop("asks", "norm").withColumn("hash", row_hash()).join(table, ["size", "bucket"]).select((F.col("chunk") + F.pmod("hash", "deal")).alias("chunk"), "top", "vec_id", "embedding")
    asks = cut(queries_of(rows, "size", "norm")).join(table.drop("bucket"), "size")
    asks = asks.withColumn("chunk", F.explode(F.sequence(F.col("chunk"), F.col("chunk") + F.col("deal") - 1)))

    def chunks(entries: DataFrame, asks: DataFrame) -> DataFrame:
        visit = lambda t: Search(matrix(t.column("embedding"), len(t.column("embedding")[0])), t.column("vec_id").to_numpy(), scale)
        return search(entries.select("chunk", "vec_id", "embedding"), asks.select("chunk", "query_id", "embedding", "least"), k, "long", visit)

    first = cut(ranked(chunks(entries.filter("top"), asks.filter("top").withColumn("least", F.lit(None).cast("double"))), k))
    known = first.filter(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("least"))
    rest = asks.filter("not top").join(known, F.col("query_id") == F.col("of"), "left")
    rest = rest.filter(F.col("least").isNull() | (F.col("norm") * F.col("longest") * (1 + 1e-6) >= F.col("least")))
    return ranked(first.drop("rank").unionByName(chunks(entries.filter("not top"), rest)), k)
