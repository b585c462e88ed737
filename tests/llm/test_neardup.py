import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import neardup
from sparkwright.llm.neardup import NearDup, Sketcher, shingle_set

SCHEMA = "doc_id long, text string, kept string"


def brute(rows, n, percent):
    sets = {}
    for i, x, *_ in rows:
        w = [v for v in (x or "").encode().lower().split()]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(r, base, count, first, most):
    out = []
    for k in range(count):
        w = list(base)
        for _ in range(r.randrange(most)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append((first + k, " ".join(w), "c"))
    return out


@pytest.mark.parametrize("n,most", [(4, 12), (5, 40), (1, 30)])
def test_like_brute_force(spark, n, most):
    r = random.Random(n)
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(3, 120))), "c") for i in range(150)]
    for g in range(4):
        rows += near_copies(r, [f"g{g}w{k}" for k in range(100)], 40, 1000 * (g + 1), most)
    r.shuffle(rows)
    got = {d.doc_id: (d.n_shingles, d.component_id) for d in NearDup(shingle=n).run(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, n, 80)


def test_small_parts_lose_nothing(spark):
    """Buckets in many parts, and so many links between parts."""
    r = random.Random(8)
    rows = near_copies(r, [f"w{k}" for k in range(150)], 160, 0, 14)
    got = {d.doc_id: (d.n_shingles, d.component_id) for d in NearDup(shingle=4, most=12).run(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 4, 80)


def test_cases(spark):
    text = " ".join(f"a{k}" for k in range(60))
    long = " ".join(f"L{k % 90_000}" for k in range(150_000))
    rows = [(1, None, "c"), (2, "", "c"), (3, " \t\n", "c"), (4, "Two Words", "c"), (5, "two\x0bwords", "c"), (6, "two words ", "c"), (7, "two words", "c"), (8, "É two", "c"), (9, "é two", "c"), (20, text, "c"), (20, text, "c"), (21, text.upper(), "c"), (30, long, "c"), (31, long + " end", "c"), (None, text, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = NearDup(shingle=4).run(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[6] == (1, 4, False) and got[7] == (1, 7, True)
    assert got[8][1] == 8 and got[9][1] == 9
    assert got[20] == (57, 20, True) and got[21] == (57, 20, False) and got[30][1:] == (30, True) and got[31][1:] == (30, False)
    assert got[None] == (57, None, True)
    kept = NearDup(shingle=4).keep(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 2, 3, 4, 7, 8, 9, 20, 30]
    empty = NearDup().run(df.filter("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_threshold_is_exact(spark):
    """Similarities of exactly 80 hundredths and just below."""
    for shared, own, linked in ((80, 20, True), (79, 20, False), (4, 1, True)):
        w = [f"s{k}" for k in range(shared)]
        rows = [(1, " ".join(w + [f"a{k}" for k in range(own)]), "c"), (2, " ".join(w), "c")]
        got = {d.doc_id: d.component_id for d in NearDup(shingle=1).run(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert (got[2] == 1) == linked


def test_registers():
    s, r = Sketcher(512, 1.001), np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = x[:2500], x[500:]
    ra, rb = s.registers(a), s.registers(b)
    assert (s.registers(x) == s.merge(ra, rb)).all()
    j = 2000 / 3000
    assert abs((ra == rb).mean() - j) < 0.08
    up, down = np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()])
    n = np.array([2500.0])
    assert s.reaches(up, down, n, n, j - 0.08)[0] and not s.reaches(up, down, n, n, j + 0.08)[0]


def test_components(spark):
    r = random.Random(3)
    links = [(a, a + 1) for a in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    label = {}

    def find(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    got = {x.node: x.component for x in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(label)}


def test_shingles():
    assert len(shingle_set("a b c d a b c d", 4)) == 4
    assert len(shingle_set("a b c", 4)) == 1 and len(shingle_set("a", 4)) == 1
    assert len({int(shingle_set(t, 4)[0]) for t in ("a", "a a", "a a a", "a a a a", "a b c")}) == 5


def test_straggler_costs_few_rows(spark, monkeypatch):
    """One large bucket whose members are one component, and one member outside: rows grow by the parts, not by members times parts."""
    n, parts = 4000, 40
    nd = NearDup(shingle=4, most=n // parts)
    text = " ".join(f"w{k}" for k in range(40))
    classes = spark.range(n).select(F.col("id").alias("rep"), F.lit(37).cast("long").alias("n_shingles"), F.lit(nd.sketcher.registers(shingle_set(text, 4)).tobytes()).alias("registers"))
    members = classes.select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("band"), F.lit(parts).cast("long").alias("parts"), "rep", "n_shingles")
    found = spark.range(n - 1).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    docs = classes.select(F.col("rep").alias("doc_id"), F.lit(text).alias("text"))
    groups, own = [], NearDup._groups

    def counted(*args):
        groups.append(out := own(*args))
        return out

    monkeypatch.setattr(NearDup, "_groups", staticmethod(counted))
    more = nd.across(members, classes, found, docs).collect()
    assert groups[0].count() == n + parts - 1
    assert {r.b for r in more} | {r.a for r in more} >= {n - 1}


def test_keep_takes_one_of_repeated_rows(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    rows = [(1, texts[0], {"a": "1"})] * 3 + [(1, texts[1], {})] * 2 + [(None, texts[0], None), (None, texts[0].upper(), None), (None, "ein zwei drei vier fuenf", None), (None, "ein zwei drei VIER fuenf", None), (None, "", None), (2, "", None), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone map<string,string>")
    out = NearDup().keep(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in out.collect()) == sorted([(1, texts[0]), (1, texts[1]), (0, "ein zwei drei vier fuenf"), (0, ""), (2, ""), (2, "")])


def test_one_id_with_several_texts(spark):
    """Such rows are one document that has the links of all its texts; keep loses none of them."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "x"), (9, b, "x"), (7, "", "x"), (12, c, "x"), (12, c + " more", "x"), (12, "", "x"), (None, a, "x"), (None, c + " more", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = NearDup(shingle=4).run(df).collect()
    assert len(out) == len(rows)
    assert sorted({(r.doc_id or 0, r.component_id or 0, r.kept) for r in out}) == [(0, 0, True), (3, 3, True), (7, 3, False), (9, 3, False), (12, 12, True)]
    kept = sorted((r.doc_id, r.text) for r in NearDup(shingle=4).keep(df).collect())
    assert [k for k in kept if k[1]] == [(3, a), (7, b), (12, kept[-1][1])] and [k[0] for k in kept if not k[1]] == [7, 12]


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_that_repeat_like_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for g in range(3):
        rows += near_copies(r, [f"g{g}w{k}" for k in range(60)], 30, 0, 8)
    rows = [(r.randrange(45), t, c) for _, t, c in rows] + [(r.randrange(45), " ".join(f"w{r.randrange(99)}" for _ in range(20)), "c") for _ in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    # components: texts as nodes, linked by similarity or by a common id
    text = [(n, t, "c") for n, (_, t, _) in enumerate(rows)]
    similar = {n: c for n, (_, c) in brute(text, 4, 80).items()}
    label = {i: i for i, _, _ in rows}
    for _ in rows:
        for n, (i, _, _) in enumerate(rows):
            m = min(label[j] for k, (j, _, _) in enumerate(rows) if similar[k] == similar[n] or j == i)
            label[i] = min(label[i], m)
    got = NearDup(shingle=4).run(df).collect()
    assert len(got) == len(rows) and all(x.component_id == label[x.doc_id] for x in got)
    # keep: one row, of the smallest id, for each group of similar texts
    kept = NearDup(shingle=4).keep(df).collect()
    want = sorted(min(rows[k][0] for k in range(len(rows)) if similar[k] == s) for s in set(similar.values()))
    assert sorted(x.doc_id for x in kept) == want
    at = {}
    for n, (i, t, _) in enumerate(rows):
        at[(i, t)] = similar[n]
    assert sorted(at[(x.doc_id, x.text)] for x in kept) == sorted(set(similar.values()))
