import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r], "x") for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)], SCHEMA)


def ranks(score, ids, q, k=5):
    """Rows of (query, rank, id, score) by brute force."""
    out = []
    for n, i in enumerate(q):
        s = [(-score[n, j], ids[j], score[n, j]) for j in range(len(ids)) if ids[j] != i]
        out += [(int(i), r + 1, int(b), c) for r, (_, b, c) in enumerate(sorted(s)[:k])]
    return out


def asks():
    return F.col("vec_id") % 50 == 0


@pytest.mark.parametrize("kind", ["alike", "spread", "near", "coarse"])
def test_top_k(spark, kind):
    r = np.random.default_rng(len(kind))
    x = r.normal(size=(2500, 16)).astype(np.float32)
    if kind == "alike":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "spread":
        x *= np.exp(r.normal(size=(2500, 1)) * 2)  # lengths prune
    if kind == "near":
        x = x[r.integers(0, 60, 2500)] + 0.01 * r.normal(size=x.shape)  # coordinates prune
    if kind == "coarse":
        x = np.round(x) / 256  # many ties
    x = x.astype(np.float32)
    ids = np.arange(2500)
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    q = ids[ids % 50 == 0]
    want = ranks(v[q] @ v.T, ids, q)
    got = topk.top_k(frame(spark, x).repartition(6), asks()).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pruning_takes_place():
    r = np.random.default_rng(9)
    x = np.floor(256 * r.normal(size=(4000, 8)) * np.exp(r.normal(size=(4000, 1)) * 2))
    s = topk.Search(x / 256.0, np.arange(4000), 256.0, bucket=200)
    s.ask(x[:40])
    from sparkwright.llm.vectors import Best

    best, seen = Best(np.arange(40), 5), []
    add = s._add
    s._add = lambda b, p, ids, row, query, exact: (seen.append(len(row)), add(b, p, ids, row, query, exact))
    for k in range(0, 4000, 200):
        s._bucket(best, s.p[k : k + 200], s.ids[k : k + 200], s.length[k : k + 200], True)
    assert sum(seen) < 40 * 4000 / 10


def test_big_numbers(spark):
    x = [[1e6, 3e6], [2e6, -1.0001e6], [3.0001e6, 1e6], [1.5, 2.5]]
    got = topk.top_k(frame(spark, x), asks(), k=3).collect()
    v = [[int(np.floor(256 * np.float64(np.float32(c)))) for c in r] for r in x]
    want = sorted(((sum(a * b for a, b in zip(v[0], v[j], strict=True)), -j) for j in (1, 2, 3)), reverse=True)
    assert [(r.score, -r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == want


def test_nearest_small_is_exact(spark):
    x = np.random.default_rng(1).normal(size=(900, 12)).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    ids = np.arange(900)
    q = ids[ids % 50 == 0]
    want = ranks(u[q] @ u.T, ids, q)
    got = sorted(map(tuple, ann.nearest(frame(spark, x), asks()).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, sorted(want), strict=True)) < 1e-12


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = np.flatnonzero(ids % 50 == 0)
    want = {w[0:3:2] for w in ranks(u[at] @ u.T, ids, ids[at])}
    got = ann.nearest(df, asks(), least=10).collect()
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_all_cells_in_order_of_distance():
    r = np.random.default_rng(3)
    index = ann.MultiIndex(r.normal(size=(500, 6)), 8)
    q = r.normal(size=(5, 6))
    counts = r.integers(0, 9, index.cells)
    u = ann.unit(q)
    both = [ann._distance(h, c) for h, c in zip(index._halves(u), index.c, strict=True)]
    for n, (cells, far) in enumerate(index.visit(q, counts, 60)):
        d = (both[0][n][:, None] + both[1][n]).ravel()
        order = np.argsort(d, kind="stable")
        need = int(np.searchsorted(np.cumsum(counts[order]), 60)) + 1
        assert cells == [c for c in order[:need] if counts[c]]
        near = index.summed(q[n : n + 1], np.arange(index.cells))[0]
        assert {c for c in range(index.cells) if counts[c] and near[c] <= far + 1e-9} == set(cells)  # the one number says which


@pytest.mark.parametrize("search", [topk.top_k, ann.nearest])
def test_cases(spark, search):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "q"), (0, [1.0, 2.0], "q"), (1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, None, "n"), (3, [None, 1.0], "n"), (4, [nan, 1.0], "n"), (5, [inf, 1.0], "n"), (None, [1.0, 2.0], "n"), (6, [], "n"), (7, [1.0, 2.0, 3.0], "other"), (50, [2.0, 4.0], "q"), (100, [0.5, 0.5, 0.5], "q"), (150, None, "q"), (200, [0.0, 0.0], "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted(map(tuple, search(df, asks()).collect()))
    by = {}
    for r in out:
        by.setdefault(r[0], []).append(r[2])
    if search is topk.top_k:
        assert by == {0: [50, 1, 1, 200], 50: [0, 0, 1, 1, 200], 100: [7], 200: [0, 0, 1, 1, 50]}
    else:
        assert by == {0: [1, 1, 50], 50: [0, 0, 1, 1], 100: [7]}
        assert all(abs(r[3] - 1) < 1e-12 for r in out if r[0] != 100)
    empty = search(df.filter("false"), asks())
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


def test_many_equal_vectors(spark):
    x = np.tile(np.array([[0.3, -0.7, 0.2]], np.float32), (3000, 1))
    for search in (topk.top_k, ann.nearest):
        got = {(r.query_id, r.rank): r.vec_id for r in search(frame(spark, x).repartition(5), asks()).collect()}
        assert [got[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [got[50, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("search", [topk.top_k, ann.nearest])
@pytest.mark.parametrize("rows", [2, 6, 2000])
def test_repeated_query_rows(spark, search, rows):
    r = np.random.default_rng(rows)
    x = r.normal(size=(900, 8)).astype(np.float32)
    x[1:40] = x[0] + 0.05 * r.normal(size=(39, 8))  # the true neighbours stand where the query's own rows do
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1:] *= 0.9
    x, ids = np.concatenate((np.repeat(x[:1], rows, axis=0), x[1:])), np.concatenate((np.zeros(rows, np.int64), np.arange(1, 900)))
    v = np.floor(256 * x.astype(float)).astype(np.int64) if search is topk.top_k else ann.unit(x.astype(float))
    want = [w[:3] for w in ranks(v[:1] @ v.T, ids, [0])]
    got = search(frame(spark, x, ids).repartition(1), F.col("vec_id") == 0).collect()
    assert sorted(tuple(g)[:3] for g in got) == want


def test_own_rows_do_not_fill_the_visit(spark):
    r = np.random.default_rng(5)
    x = np.concatenate((np.ones((5000, 8)), r.normal(size=(300, 8)))).astype(np.float32)
    ids = np.concatenate((np.zeros(5000, np.int64), np.arange(1, 301)))
    got = ann.nearest(frame(spark, x, ids), F.col("vec_id") == 0).collect()
    u = ann.unit(x.astype(float))
    assert sorted(tuple(g)[:3] for g in got) == [w[:3] for w in ranks(u[:1] @ u.T, ids, [0])]


@pytest.mark.parametrize("hot", [51, 150])
def test_one_id_with_most_rows(spark, hot):
    """60,000 rows of one vec_id, which asks or not, beside 300 others."""
    r = np.random.default_rng(hot)
    x = np.concatenate((np.tile(r.normal(size=(1, 4)), (60_000, 1)), r.normal(size=(300, 4)))).astype(np.float32)
    ids = np.concatenate((np.full(60_000, hot), np.arange(300) * 50 + 1000))
    for search in (topk.top_k, ann.nearest):
        got = {}
        for row in search(frame(spark, x, ids).repartition(4), F.col("vec_id") % 50 == 0).collect():
            got.setdefault(row.query_id, []).append(row.vec_id)
        assert all(len(v) == 5 for v in got.values()) and len(got) == 300 + (hot % 50 == 0)


def test_nearest_of_huge_and_tiny_doubles(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(120, 6)) * np.array([1e200, 1.0, 1e-200])[np.arange(120) % 3][:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = ann.unit(x)
    q = np.array([0, 50, 100])
    got = sorted(map(tuple, ann.nearest(df, asks()).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(ranks(u[q] @ u.T, np.arange(120), q))] and all(np.isfinite(g[3]) for g in got)
    plain = r.normal(size=(50, 6))
    assert (ann.cosine(plain, plain[::-1]) == (plain * plain[::-1]).sum(axis=1) / (np.sqrt((plain**2).sum(axis=1)) * np.sqrt((plain[::-1] ** 2).sum(axis=1)))).all()


@pytest.mark.parametrize("search", [topk.top_k, ann.nearest])
def test_plans_do_not_grow_with_queries(spark, search):
    x = np.random.default_rng(7).normal(size=(3000, 4)).astype(np.float32)
    df = frame(spark, x)
    size = [search(df, test)._jdf.queryExecution().optimizedPlan().toString().count("\n") for test in (F.col("vec_id") == 0, F.lit(True))]
    assert size[0] == size[1]


@pytest.mark.parametrize("search", [topk.top_k, ann.nearest])
def test_many_chunks(spark, search, monkeypatch):
    """Chunks of a few rows, and hot cells and buckets dealt among several, give the same as one chunk."""
    r = np.random.default_rng(11)
    x = (r.normal(size=(1200, 4)) * np.exp(r.normal(size=(1200, 1)))).astype(np.float32)
    x[100:400] = x[100]
    df = frame(spark, x)
    want = sorted(map(tuple, search(df, asks()).collect()))
    for m in (topk, ann):
        monkeypatch.setattr(m, "CHUNK", 200)
    assert sorted(map(tuple, search(df, asks()).collect())) == want


def test_top_k_of_huge_doubles(spark):
    """Components beyond 64 bits prune nothing that counts."""
    x = [[1e30, 1.0], [1e-3, 5.0], [2e25, -3.0], [-1e28, 1.0], [0.25, 0.5], [1e30, 0.0]] + [[0.5, 0.25]] * 40
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 1).collect()}
    v = [[int(np.floor(256 * c)) for c in r] for r in x]
    score = [(-sum(a * b for a, b in zip(v[1], v[j], strict=True)), j) for j in range(len(x)) if j != 1]
    assert [got[1, k + 1] for k in range(5)] == [(j, -s) for s, j in sorted(score)[:5]]


def test_share_follows_the_structure(spark):
    """Vectors in groups need a small share of the entries, those without structure a large one; the recall is reached on both."""
    r = np.random.default_rng(8)
    flat = r.normal(size=(3000, 32))
    groups = r.normal(size=(60, 32))[r.integers(0, 60, 3000)] + 0.2 * r.normal(size=(3000, 32))
    share = {}
    for name, x in (("flat", flat), ("groups", groups)):
        x = x.astype(np.float32)
        share[name] = ann.MultiIndex(x.astype(float), 64).share(x.astype(float), 5, 0.96)
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        q = np.arange(0, 3000, 50)
        want = {(a, c) for a, _, c, _ in ranks(u[q] @ u.T, np.arange(3000), q)}
        got = {(g.query_id, g.vec_id) for g in ann.nearest(frame(spark, x), asks(), centroids=64, least=10).collect()}
        assert len(want & got) >= 0.9 * len(want)
    assert share["groups"] < 0.1 < share["flat"]
