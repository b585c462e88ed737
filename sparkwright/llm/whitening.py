"""Whitening by the leading eigenvectors of the covariance, found by LOBPCG.

A component c counts as the integer x = floor(scale * c) + shift. Rows are centred on the exact mean of all rows, by
integers first, so that the shift costs no digits. The covariance matrix is never made: a pass over the rows gives its
product with a block of some 2 * k vectors, as each task sums its rows times their projections.

Rayleigh-Ritz is done on the span of the iterate, its residual and its previous direction, each block orthonormal to the
others, so that only residuals need a product: a pass a round. The blocks hold `guard` vectors beyond the k asked for. Once
the residuals of the k are small, the product of the iterate itself is made anew and the residuals that it gives must stay
below `tolerance` times the largest eigenvalue; otherwise the rounds go on from it, and after `rounds` of them that is an
error. So what is returned is certified by a pass over all rows and does not rest on updated products.

Cases: vectors null, empty, or with a null or non-finite component take no part; a null vec_id or repeated rows count as any
other row; vectors of another length are whitened among themselves; components beyond 2**53 / scale count as that; with fewer
than k dimensions there are as many components as these; a component without variance (up to rounding: fewer rows than
components, or equal ones) has explained 0 and whitened null; equal eigenvalues share a space, of which any basis may
come; a deviation beyond 64 bits is the largest 64-bit number; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.blocks import column_sums, integers, long, sizes, sums
from sparkwright.llm.shared import check_columns, cut
from sparkwright.llm.vectors import matrix, usable

Product = Callable[[np.ndarray], np.ndarray]
RESULT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _orthonormal(x: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what x adds to the span of orthonormal blocks; columns that add nothing are left out."""
    scale = np.linalg.norm(x, axis=0)
    x = x[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        for q in against:
            x = x - q @ (q.T @ x)
    if not x.size:
        return x[:, :0]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    u = u[:, s > 1e-8]
    for q in against:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0] if u.size else u


def _ritz(b: np.ndarray, ab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of the symmetric matrix on the basis b."""
    g = b.T @ ab
    e, c = np.linalg.eigh((g + g.T) / 2)
    return e[::-1], c[:, ::-1]


def lobpcg(product: Product, x: np.ndarray, k: int, tolerance: float = 1e-12, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors, of the matrix that product multiplies by, from the block x on."""
    x, width = np.linalg.qr(x)[0], x.shape[1]
    ax, p, certified = product(x), x[:, :0], True
    ap = p
    for _ in range(rounds):
        e, c = _ritz(x, ax)
        x, ax = x @ c, ax @ c
        r = ax - x * e
        if np.linalg.norm(r[:, :k], axis=0).max() <= tolerance * abs(e[0]):
            if certified:
                return e[:k], x[:, :k]
            x = np.linalg.qr(x)[0]
            ax, p, ap, certified = product(x), p[:, :0], ap[:, :0], True
            continue
        w = _orthonormal(r, x, p)
        b = np.hstack((x, w, p))
        ab = np.hstack((ax, product(w), ap)) if w.size else np.hstack((ax, ap))
        e, c = _ritz(b, ab)
        c = c[:, :width]
        d = c.copy()
        d[:width] = 0  # the step's part outside the iterate is the next direction
        d = _orthonormal(d, c)
        x, ax, p, ap, certified = b @ c, ab @ c, b @ d, ab @ d, False
    raise RuntimeError(f"residuals are not below {tolerance} of the largest eigenvalue after {rounds} rounds")


class Centred:
    """Rows as integers about their exact mean."""

    def __init__(self, rows: DataFrame, size: int, scale: float, shift: int):
        self.size, self.scale, self.shift = size, scale, shift

        def count(b: pa.RecordBatch) -> np.ndarray:
            return np.append(column_sums(self.x(b)), b.num_rows)

        *s, self.n = (int(v) for v in sums(rows, count, size + 1, exact=True))
        self.s = np.array(s, object)
        self.base = np.array([v // self.n for v in s], np.int64)
        self.rest = np.array([v % self.n / self.n for v in s])

    def x(self, b: pa.RecordBatch) -> np.ndarray:
        return integers(matrix(b.column("embedding"), self.size), self.scale) + self.shift

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S) squared, exactly."""
        d = x - self.base
        most = (max(int(d.max(initial=0)), -int(d.min(initial=0))) + 1) * self.n
        gap = np.array([v % self.n for v in self.s], object)
        if most * most * self.size < 1 << 63:
            d = self.n * d - gap.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * d.astype(object) - gap
        return [long(v) for v in (d * d).sum(axis=1)]


def whiten(rows: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000, guard: int = 8, tolerance: float = 1e-12, rounds: int = 200, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component."""
    check_columns(rows, [vec_id, embedding])
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    rows, schema = cut(rows.filter(usable(F.col("embedding")))), RESULT.format(dict(rows.dtypes)["vec_id"])
    out = rows.sparkSession.createDataFrame([], schema)
    for size in sizes(rows, "embedding"):  # vectors of one length are one fit list
        out = out.unionByName(_whiten(rows.filter(F.size("embedding") == size), size, min(components, size), scale, shift, guard, tolerance, rounds, schema))
    return out


def _whiten(rows: DataFrame, size: int, k: int, scale: float, shift: int, guard: int, tolerance: float, rounds: int, schema: str) -> DataFrame:
    at = Centred(rows, size, scale, shift)

    def trace(b: pa.RecordBatch) -> np.ndarray:
        return np.square(at.rows(at.x(b))).sum(keepdims=True).reshape(1)

    def product(v: np.ndarray) -> np.ndarray:
        def work(b: pa.RecordBatch) -> np.ndarray:
            x = at.rows(at.x(b))
            return (x.T @ (x @ v)).ravel()

        return sums(rows, work, v.size).reshape(v.shape) / at.n

    total = float(sums(rows, trace, 1)[0]) / at.n
    start = np.random.default_rng(11).standard_normal((size, min(size, k + guard)))
    e, u = lobpcg(product, start, k, tolerance, rounds)
    u = u * np.where(np.take_along_axis(u, np.abs(u).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)  # one of the two signs
    live = e > 1e-12 * total
    u, root = u[:, live], np.sqrt(e[live])

    def moments(b: pa.RecordBatch) -> np.ndarray:
        w = at.rows(at.x(b)) @ u / root
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    m = int(live.sum())
    found = sums(rows, moments, m + m * m) / at.n
    error = float(np.abs(found[m:].reshape(m, m) - np.outer(found[:m], found[:m]) - np.eye(m)).max(initial=0))
    explained = np.where(live, e / total, 0.0) if total else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x = at.x(part)
                w = np.full((len(x), k), np.nan)
                w[:, live] = at.rows(x) @ u / root
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), at.n)),
                        pa.array(at.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(w.ravel(), from_pandas=True),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(each), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
