import hashlib
import math

import numpy as np
import pytest

from sparkwright.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, n, "x") for i, v, n in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096.0):
    """Rows of (vec_id, code, error, label_error, digest) by all distances, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v], n) for i, v, n in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    edges = [p * (size // parts) + min(p, size % parts) for p in range(parts + 1)]
    cut = [[tuple(x[a:b]) for a, b in zip(edges, edges[1:], strict=False)] for _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for c in cut:
                of.setdefault(near(c[p], book)[1], []).append(c[p])
            books[p] = [tuple(sum(v) // len(of[k]) for v in zip(*of[k], strict=True)) if k in of else e for k, e in enumerate(book)]
    made = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    label = {}
    for m, (_, _, n) in zip(made, kept, strict=True):
        label[n] = label.get(n, 0) + sum(d for d, _ in m)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in m), sum(d for d, _ in m), label[n], digest) for m, (i, _, n) in zip(made, kept, strict=True)]


def same(a, b):
    key = lambda r: (r[0] is None, *[v if v is not None else 0 for v in r])
    assert sorted(map(tuple, a), key=key) == sorted(b, key=key)


@pytest.mark.parametrize("kind", ["plain", "near", "coarse", "odd"])
def test_like_brute_force(spark, kind):
    r = np.random.default_rng(len(kind))
    x = r.normal(size=(300, 27 if kind == "odd" else 24))
    if kind == "near":
        x = x[r.integers(0, 30, 300)] + 0.001 * r.normal(size=x.shape)
    if kind == "coarse":
        x = np.round(x) / 4096  # many ties, and many equal parts
    rows = [(int(i), v.tolist(), [None, 1, 2, 3, 1][i % 5]) for i, v in enumerate(x)] + [(7, x[7].tolist(), 2), (None, x[3].tolist(), 9)]
    bad = [(-1, None, 1), (-2, [math.nan] * x.shape[1], 1), (-3, [None] * x.shape[1], 1)]
    same(codes.codes(frame(spark, rows + bad).repartition(5)).collect(), brute(rows))


def test_bounds_prune_and_stay_safe():
    """After each round the bounds hold, codes are those of all distances, and most distances are not made."""
    r = np.random.default_rng(2)
    x = np.floor(4096 * (r.normal(size=(40, 8))[r.integers(0, 40, 3000)] + 0.05 * r.normal(size=(3000, 8)))).astype(np.int64)
    part = codes.Part(0, 8, x[:16])
    code, upper, lower = part.fresh(x)
    made, own = [], codes._squares
    for _ in range(8):
        entries = part.entries.copy()
        for k in np.unique(code):
            entries[k] = x[code == k].sum(axis=0) // (code == k).sum()
        part = codes.Part(0, 8, entries, part.entries)
        codes._squares = lambda a, b: (made.append(len(a)), own(a, b))[1]
        try:
            code, upper, lower = part.next(x, code, upper.copy(), lower.copy())
        finally:
            codes._squares = own
        d = np.stack([own(x, e) for e in part.entries], axis=1)
        assert (code == d.argmin(axis=1)).all()
        assert (upper.astype(object) ** 2 >= d[np.arange(len(x)), code]).all() and (lower.astype(object) ** 2 <= d).all()
    assert sum(made) < 0.3 * 8 * 16 * len(x)


def test_cases(spark):
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    empty = codes.codes(frame(spark, [(1, None, 1), (2, [], 1)]))
    assert empty.columns == columns and empty.count() == 0
    few = [(5, [1.0, 2.0, 3.0], None), (5, [1.0, 2.0, 3.0], None), (2, [0.5, 0.25, -1.0], 4)]  # fewer rows than entries, fewer components than parts
    same(codes.codes(frame(spark, few)).collect(), brute(few))
    out = codes.codes(frame(spark, few + [(8, [1.0], 4)])).collect()  # another length: other codebooks, one label
    assert len(out) == 4 and len({r.codebooks_sha256 for r in out}) == 2
    huge = [(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1), (3, [0.0] * 8, 1), (4, [1.0] * 8, 1)]
    out = {r.vec_id: r for r in codes.codes(frame(spark, huge), entries=2).collect()}
    assert out[1].code == "00" * 8 and out[2].code == "01" * 8 and out[4].error > 0


def test_large_integers_are_exact(spark):
    r = np.random.default_rng(6)
    rows = [(int(i), (v * 1e9).tolist(), 1) for i, v in enumerate(r.normal(size=(60, 8)))]
    want = [(i, c, min(e, 2**63 - 1), min(n, 2**63 - 1), d) for i, c, e, n, d in brute(rows)]
    got = codes.codes(frame(spark, rows)).collect()
    assert [r[:2] + r[4:] for r in sorted(map(tuple, got))] == [r[:2] + r[4:] for r in sorted(want)] and [r[2] for r in sorted(map(tuple, got))] == [r[2] for r in sorted(want)]
