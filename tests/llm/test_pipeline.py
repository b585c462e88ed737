import math
import re
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_mixing import plain_targets
from test_neardup import brute
from test_secrets import plain_random

from sparkwright.llm import bpe, quality, secrets


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("score", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("redacted", F.lit(None).cast("int"))
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_duplicates", "secrets", "mix", "tokens"]
    now = docs
    seen = {}
    for n, f in P.STAGES:
        now = f(spark, now, small).cache()
        seen[n] = now
        if n != "tokens":
            assert now.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = ids(quality.report(docs, spark.read.parquet(f"{small}/labels.parquet")).filter("predicted = 1"))
    assert ids(seen["quality"]) == kept
    texts = [r.text for r in seen["near_duplicates"].collect()]
    assert len(texts) == len(set(texts)) and ids(seen["near_duplicates"]) <= kept
    assert ids(seen["secrets"]) == ids(seen["near_duplicates"])
    assert all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in seen["secrets"].collect())
    most = seen["mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 3 and ids(seen["mix"]) <= ids(seen["secrets"])
    assert seen["tokens"].count() == seen["mix"].count()
    assert all(r.n_tokens == len(r.ids) and r.whole for r in seen["tokens"].collect())


def test_run_and_empty(spark, small):
    out = P.run(spark, small)
    assert out.count() > 0 and "ids" in out.columns
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("false")
    for _, f in P.STAGES:
        docs = f(spark, docs, small)
    assert docs.count() == 0


def test_stages_in_a_row_over_odd_rows(spark, small):
    """Nulls in each column, repeated rows, ties, a very long text, secrets, a column that has the names of the operators' own; each stage gets what the one before kept."""
    schema = spark.read.parquet(f"{small}/documents.parquet").schema.add("score", "string").add("set_key", "integer")
    good = [r.text for r in P.keep_quality(spark, spark.read.parquet(f"{small}/documents.parquet"), small).filter("length(text) between 400 and 2000").limit(6).collect()]
    very_long = " ".join(f"{t} {k}" for k in range(400) for t in good[:3])
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, "en", None, 0), (3, very_long, "en", "a", len(very_long))]
    rows += [(10, good[0], None, None, None), (11, good[0], "en", "a", 9), (11, good[0], "en", "a", 9), (12, "".join(c.upper() if c.isascii() else c for c in good[0]), "en", "b", 9), (None, good[1], "en", "b", 9), (None, good[1], "en", "b", 9), (None, good[0], "en", "b", 9)]
    rows += [(20, good[2] + " password=abcdefgh12 " + "=" * 3000 + "a1", "en", "c", 1), (21, good[3], "en", "c", 1), (22, good[4], "en", None, 1)]
    now = spark.createDataFrame([(*r, "x", 7) for r in rows], schema)
    columns, before = now.columns, None
    for name, f in P.STAGES:
        out = f(spark, now, small)
        got = out.collect()
        before = now.collect()
        if name == "tokens":
            assert [c for c in out.columns if c in columns] == ["doc_id", "lang", "source", "n_chars"] and len(got) == len(before) and all(r.whole for r in got)
            break
        assert out.columns == columns
        if name == "quality":
            assert {3, 10, 11, 12, 20, 21, 22} <= {r.doc_id for r in got} and len([r for r in got if r.doc_id == 11]) == 2
        if name == "near_duplicates":
            texts = [(r.text or "").lower() for r in got if r.text]
            assert len(texts) == len(set(texts)) and 10 in {r.doc_id for r in got} and not {11, 12} & {r.doc_id for r in got}
            assert [r.doc_id for r in got if r.text == good[1]] == [None]
        if name == "secrets":
            assert len(got) == len(before) and "[SECRET]" in next(r.text for r in got if r.doc_id == 20)
        if name == "mix":
            assert all([r.text for r in got].count(t) <= 3 for t in {r.text for r in got if r.text})
        # as between written stages
        now = spark.createDataFrame(got, schema)


def plain_redacted(text):
    """The text with a mark for each stretch of spans, by the plain scan of each kind."""
    base = [m.span() for m in re.finditer(secrets.ASSIGN.pattern, text, re.I | re.A) if len(m[2]) >= 8]
    base += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans = base + [(a, b) for kind, a, b in plain_random(text) if kind == "hex" or not any(x < b and a < y for x, y in base)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_run_like_brute_force(spark, small, tmp_path):
    """All that run() returns, against plain versions in a row: the classifier's verdict is given, whose accuracy is tested elsewhere; draws are held against the shares and targets that they round. Some texts get secrets."""
    planted = [" password = 'longenough1' x", " AKIA" + "Q7" * 8, " 0123456789abcdef" * 4, " token=" + "0123456789abcdef" * 2, " zQ3xV9kLp0RtW7bN2mYc", " secret: zQ3xV9kLp0RtW7bN2mYc"]
    more = F.element_at(F.array(*map(F.lit, planted)), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", more)).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.report(docs, labels).filter("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    groups = brute([(i, r.text) for i, r in rows.items()], 5, 80)
    rows = {i: r for i, r in rows.items() if groups[i][1] == i}
    texts = {i: plain_redacted(r.text or "") for i, r in rows.items()}
    assert len(rows) < len(good) and sum("[SECRET]" in t for t in texts.values()) > 10
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    sizes = Counter()
    for i, r in rows.items():
        sizes[r.source] += words[i]
    targets = plain_targets(sizes)

    out = P.run(spark, str(tmp_path)).collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) <= set(rows)
    for source, target in targets.items():
        own = [i for i, r in rows.items() if r.source == source]
        assert abs(sum(times[i] * words[i] for i in own) - target) <= max(words[i] for i in own)
        share = target / sizes[source] if sizes[source] else 0
        assert all(math.floor(share) <= times[i] <= math.ceil(share) for i in own)
    ranks = bpe.read_ranks(public_tokenizers.path(P.VOCABULARY))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: library.encode_ordinary(texts[i]) for i in times}
    for r in out:
        old = rows[r.doc_id]
        chars = old.n_chars if texts[r.doc_id] == (old.text or "") else len(texts[r.doc_id])
        assert (r.lang, r.source, r.n_chars, r.n_tokens, r.ids, r.whole) == (old.lang, old.source, chars, len(ids[r.doc_id]), ids[r.doc_id], True)
