import random
import zlib

import numpy as np

from sparkwright.llm import quality


def corpus(spark, n=600):
    r = random.Random(4)
    good, bad = "the of and river stone walked under light they was".split(), "BUY!!! $$$ click *** FREE ### now %%% win".split()
    rows = [(i, " ".join(r.choices(good if i % 3 else bad, k=30)), "x") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(out) == docs.count()
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in want if out[i].held_out]
    assert held and all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out for i, r in out.items())
    assert np.mean([out[i].predicted == want[i] for i in held]) >= 0.93


def test_no_look_at_held_out_labels(spark):
    docs, labels = corpus(spark)
    held = quality.held_out(labels["doc_id"])
    turned = labels.withColumn("quality", quality.F.when(held, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = ({r.doc_id: r for r in quality.report(d, x).collect()} for d, x in ((docs, labels), (docs.repartition(7), turned)))
    assert all(abs(a[i].score - b[i].score) < 1e-6 and a[i].predicted == b[i].predicted for i in a)  # nor does the partitioning matter


def test_calibration():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-(x[:, 0] * 2 - x[:, 1])))
    y = (r.random(4000) < p).astype(float)
    s = quality.Network().fit(x[:3000], y[:3000]).score(x[3000:])
    for low, high in ((0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        at = (s >= low) & (s < high)
        assert abs(s[at].mean() - y[3000:][at].mean()) < 0.1


def test_word_vectors_are_sums_over_all(spark):
    docs, _ = corpus(spark, 90)
    w = quality.WordVectors()
    whole = w.sums(docs.repartition(5))
    plain = np.zeros((w.buckets, w.size + 1), np.int64)
    for x in (r.text for r in docs.collect()):
        ids = [int(i) for i in quality.word_ids([x], w.buckets)[0]]
        for i, a in enumerate(ids):
            plain[a, -1] += 1
            for j in range(max(0, i - w.window), min(len(ids), i + w.window + 1)):
                if j != i:
                    for place, sign in zip(w.place[ids[j]], w.sign[ids[j]], strict=True):
                        plain[a, place] += sign
    assert (whole == plain).all()


def test_cases(spark):
    docs, labels = corpus(spark, 200)
    long = "the of river " * 100_000
    odd = spark.createDataFrame([(1000, None, "y"), (1001, "", "y"), (1002, long, "y"), (1, "the river", "y"), (None, "BUY!!! $$$ win", "y")], docs.schema)
    more = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (None, 1, 0), (2, None, 0)], labels.schema)
    all_ = docs.union(odd)
    out = quality.report(all_, labels.union(more)).collect()
    assert len(out) == 205 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1000].score == by[1001].score and by[None].predicted == 0 and not by[None].held_out
    kept = quality.keep(all_, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} <= {"x", "y"}
    assert quality.report(docs.filter("false"), labels).count() == 0
    assert {r.score for r in quality.report(docs, labels.filter("false")).collect()} == {0.5}
    assert {r.score for r in quality.report(docs, labels.filter("quality = 1")).collect()} == {1.0}
