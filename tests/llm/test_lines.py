import random

import pytest
from pyspark.sql import functions as F

from sparkwright.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, dropped string"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(line):
    return "".join(c.lower() if c in UPPER else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least, shortest=1):
    """Sorted (doc_id, text kept, n_lines, n_dropped)."""
    docs = {}
    for n, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            docs.setdefault(key(line), set()).add(("row", n) if i is None else i)
    bad = {k for k, d in docs.items() if len(k) >= shortest and len(d) >= least}
    out = []
    for i, text in rows:
        ls = (text or "").split("\n")
        kept = [x for x in ls if key(x) not in bad]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def corpus(r, n, first=0):
    common = [f"Common line {k} ÄÉ" for k in range(30)] + ["", "  ", "\t\r", "x"]
    out = []
    for i in range(n):
        ls = [r.choice([str.upper, str.lower, lambda x: f"  {x}\r", str])(r.choice(common)) if r.random() < 0.4 else f"own {r.randrange(900)}" for _ in range(r.randrange(0, 9))]
        out.append((first + i, "\n".join(ls + ["Everywhere"] * (i % 3 == 0))))
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_like_brute_force(spark, batches):
    r = random.Random(batches)
    rows = corpus(r, 240)
    parts = [rows[i::batches] for i in range(batches)]
    out = lines.drop_lines(frame(spark, rows).repartition(3), [frame(spark, p) for p in parts])
    assert out.columns == ["doc_id", "text", "dropped", "n_lines", "n_dropped"]
    assert got(out) == brute(rows, 10)


def test_levels_and_anti_joins(spark):
    """Five batches: runs are compacted as in binary counting; a settled key is not counted again; every key's count is right until then."""
    runs = lines.LineRuns(spark, least=3)
    counts = []
    for b in range(5):
        rows = [(10 * b + i, f"shared\nonce {b} {i}\nfew" if b < 2 and i == 0 else f"shared\nonce {b} {i}") for i in range(3)]
        runs.add(frame(spark, rows).select("doc_id", "text"))
        counts.append(len(runs.runs()))
    assert counts == [1, 1, 2, 1, 2]
    table = [r for name in runs.runs() for r in spark.table(name).collect()]
    of = {k: spark.range(1).select(*lines.hashes(F.lit(k))).first() for k in ("shared", "few", "once 4 1")}
    n = {k: [r.n for r in table if (r.h1, r.h2) == tuple(v)] for k, v in of.items()}
    assert n == {"shared": [3], "few": [2], "once 4 1": [1]}
    runs.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_are_not_moved_again(spark):
    """Compaction and the anti-join read sorted buckets: no exchange, no sort."""
    runs, seen = lines.LineRuns(spark), []
    own = runs._write
    runs._write = lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), own(df))[1]
    for b in range(2):
        runs.add(frame(spark, corpus(random.Random(b), 60, 100 * b)).select("doc_id", "text"))
    runs.clear()
    joins = [p for p in seen if "SortMergeJoin" in p]
    assert len(joins) == 2 and not any("Exchange" in p or "Sort [" in p for p in joins)


def test_hot_key_is_spread(spark):
    rows = [(i, f"hot\nown {i}") for i in range(400)]
    out = lines.drop_lines(frame(spark, rows))
    assert got(out) == brute(rows, 10)


def test_cases(spark):
    nothing = [(1, None), (2, ""), (3, "\n"), (4, " \n\t"), (None, None)]
    long = "\n".join(f"line {k % 60_000}" for k in range(120_000)) + "\nrepeat"
    rows = [*nothing, *((10 + i, f"repeat\r\nRepeat\n  rePEAT \n{'é' if i % 2 else 'É'}\nrest\n") for i in range(9)), (40, long), (50, "rest")]
    assert got(lines.drop_lines(frame(spark, rows))) == brute(rows, 10)
    # rows with one id are one document; null ids are documents each
    rows = [(1, "a\nb")] * 12 + [(2, "a"), (3, "b\nc")] + [(None, "c")] * 9
    out = got(lines.drop_lines(frame(spark, rows), [frame(spark, rows[:5]), frame(spark, rows[5:])]))
    assert out == brute(rows, 10) and {r[3] for r in out if r[0] == 1} == {0} and {r[3] for r in out if r[0] is None} == {1}
    assert got(lines.drop_lines(frame(spark, rows), least=2, shortest=2)) == brute(rows, 2, 2)
    empty = lines.drop_lines(frame(spark, rows).filter("false"))
    assert empty.count() == 0 and "n_dropped" in empty.columns


def test_long_documents_take_linear_time(spark):
    """A text of 300,000 lines: neither its text nor its lines are gone through again for each line."""
    import time

    long = "\n".join(f"line {k % 150_000}" for k in range(300_000)) + "\nrepeat"
    rows = [(1, long), *((10 + i, f"repeat\nline {i}\nx{i}") for i in range(12))]
    df = frame(spark, rows)
    lines.drop_lines(df.filter("doc_id > 1")).count()  # compiled
    began = time.time()
    assert got(lines.drop_lines(df)) == brute(rows, 10)
    assert time.time() - began < 60
