"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

1. Words (runs of letters and digits, and runs of other signs, as written) are hashed into `buckets`. Each bucket has a
   fixed sparse vector of +1 and -1. A bucket's word vector is the sum, over all texts of the table, of the fixed vectors
   of the two words on either side. Sums are of integers, so they do not depend on the order; tasks send at most one row
   for each bucket, and the whole is `buckets` rows whatever the corpus.
2. Word vectors are centred, scaled to length 1 and weighed down for common buckets; a document has their mean, spread
   and mean product of neighbours, and its length.
3. A network of one hidden layer is fitted to labelled documents, at most `sample` of them (the first by a hash of their
   id). A fifth of these set the temperature, that is the scale of the last layer's sums at which probabilities are
   likeliest.

Cases: null and empty texts have a zero vector, hence one score; texts may be of any length; rows that repeat an id count
once in fitting, with the least of their vectors, and are scored each; labels that contradict each other evenly are left
out, others decided by majority; without labels of both kinds every score is the labels' mean (0.5 without any); an empty
table gives an empty table. A null doc_id is scored and never held out. A column named as the score gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.shared import add_columns, check_columns, cut, first_by_hash, fresh, small_batches

WORD = re.compile(r"\w+|[^\w\s]+").findall


class _Buckets(dict):
    """The buckets of words, 1 and up; 0 stands between documents."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= 50_000:
            self.clear()
        self[word] = out = 1 + xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) % (self.count - 1)
        return out


_buckets: dict[int, _Buckets] = {}


def word_ids(texts: list[str | None], count: int, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as bucket numbers, one after another with `gap` zeros after each text; and where each begins."""
    get = _buckets.setdefault(count, _Buckets(count)).__getitem__
    out: list[int] = []
    starts = []
    for x in texts:
        starts.append(len(out))
        if x:
            out += map(get, WORD(x))
        out += (0,) * gap
    return np.array(out, np.int64), np.array(starts, np.int64)


class WordVectors:
    """Parameters of the random indexing: hashed buckets, dimensions, non-zeros of a fixed vector, words seen on each side."""

    def __init__(self, buckets: int = 1 << 14, size: int = 32, ones: int = 4, window: int = 2, seed: int = 3):
        r = np.random.default_rng(seed)
        self.buckets, self.size, self.window = buckets, size, window
        self.place = np.argsort(r.random((buckets, size)), axis=1)[:, :ones]
        self.sign = r.choice(np.array([-1, 1], np.int32), (buckets, ones))
        self.sign[0] = 0
        self.fixed = np.zeros((buckets, size), np.int8)  # the same as rows; 2 * window of them stay within a byte
        np.put_along_axis(self.fixed, self.place, self.sign.astype(np.int8), axis=1)

    def add(self, sums: np.ndarray, texts: list[str | None]) -> None:
        """Adds the texts' contexts to sums (buckets, size + 1), whose last column counts the words."""
        ids, _ = word_ids(texts, self.buckets, self.window)
        if not len(ids):
            return
        own = self.fixed[ids]
        near = np.zeros_like(own)
        for step in range(1, self.window + 1):
            near[:-step] += own[step:]
            near[step:] += own[:-step]
        order = np.argsort(ids.astype(np.uint16 if self.buckets <= 1 << 16 else np.int64), kind="stable")
        ranked = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        sums[ranked[first], :-1] += np.add.reduceat(near[order], first, axis=0, dtype=np.int32)
        sums[ranked[first], -1] += np.diff(np.append(first, len(ranked)))

    def sums(self, docs: DataFrame) -> np.ndarray:
        """The sums over all texts (column `text`)."""
        names = [f"s{i}" for i in range(self.size + 1)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((self.buckets, self.size + 1), np.int64)
            for b in batches:
                for i in range(0, b.num_rows, 128):
                    self.add(total, b.column(0).slice(i, 128).to_pylist())
            total[0] = 0
            at = np.flatnonzero(total[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(total[at, i])) for i in range(self.size + 1))], ["bucket", *names])

        small_batches(docs.sparkSession)
        parts = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
        t = parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        out = np.zeros((self.buckets, self.size + 1))
        out[t.column("bucket").to_numpy()] = np.column_stack([t.column(n).to_numpy() for n in names]) if t.num_rows else 0
        return out

    def vectors(self, docs: DataFrame) -> np.ndarray:
        """Word vectors by bucket, weighed; the row of 0 is zero."""
        sums = self.sums(docs)
        count = sums[:, -1:]
        v = sums[:, :-1] / np.maximum(count, 1)
        seen = count[:, 0] > 0
        v[seen] -= v[seen].mean(axis=0) if seen.any() else 0
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        share = count / max(count.sum(), 1)
        return np.where(seen[:, None], v * 1e-2 / (1e-2 + share), 0).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Each text's pooled word vectors: mean, standard deviation, mean product of neighbours (high where words repeat), and the logarithm of their number. Zero without words."""
    size = vectors.shape[1]
    out = np.zeros((len(texts), 3 * size + 1), np.float32)
    for i, x in enumerate(texts):
        if not x:
            continue
        ids, _ = word_ids([x], len(vectors))
        n, total = max(len(ids), 1), np.zeros((3, size))
        for k in range(0, len(ids), 65536):
            v = vectors[ids[k : k + 65537]]  # one more, for the last one's neighbour
            w = v[:65536]
            total += w.sum(axis=0, dtype=np.float64), np.einsum("ij,ij->j", w, w, dtype=np.float64), np.einsum("ij,ij->j", v[:-1], v[1:], dtype=np.float64)
        mean = total[0] / n
        out[i, :size], out[i, size : 2 * size], out[i, 2 * size : -1], out[i, -1] = mean, np.sqrt(np.maximum(total[1] / n - mean**2, 0)), total[2] / n, np.log1p(len(ids))
    return out


class Network:
    """x -> tanh(x A + a) B + b -> probability, at a temperature."""

    def __init__(self, hidden: int = 24, rounds: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 11):
        self.hidden, self.rounds, self.rate, self.decay, self.seed = hidden, rounds, rate, decay, seed
        self.flat: float | None = None

    def _sums(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._even(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def _even(self, x: np.ndarray) -> np.ndarray:
        """Features at mean 0 and spread 1; what lies far outside the rows of fitting stays near them."""
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """By Adam on four fifths of the rows; the temperature on every fifth."""
        if len(y) < 10 or y.min() == y.max():
            self.flat = float(y.mean()) if len(y) else 0.5
            return self
        x, aside = x.astype(np.float64), np.arange(len(y)) % 5 == 4
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        r = np.random.default_rng(self.seed)
        self.w = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), r.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        xs, ys = self._even(x)[~aside], y[~aside]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(self.rounds):
            order = r.permutation(len(ys))
            for k in range(0, len(order), 128):
                at, t = order[k : k + 128], t + 1
                h = np.tanh(xs[at] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - ys[at]) / len(at)
                dh = np.outer(d, self.w[2]) * (1 - h**2)
                for i, g in enumerate((xs[at].T @ dh + self.decay * self.w[0], dh.sum(axis=0), h.T @ d + self.decay * self.w[2], d.sum(keepdims=True))):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.w[i] = self.w[i] - self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        z, ys = self._sums(x[aside]), y[aside]
        grid = np.geomspace(0.25, 8, 60)
        self.temperature = min(grid, key=lambda t: float(np.logaddexp(0, -np.where(ys > 0, z, -z) / t).mean()))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self._sums(x.astype(np.float64)) / self.temperature, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is not for learning: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, words: WordVectors | None = None) -> tuple[np.ndarray, Network]:
    """Word vectors of docs (doc_id, text) and a network fitted to labels (doc_id, quality) that are not held out."""
    vectors = (words or WordVectors()).vectors(docs)
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("y")).filter("doc_id is not null and y <> 0.5")
    known = first_by_hash(cut(known.join(docs.select("doc_id"), "doc_id", "left_semi")), "doc_id", sample)
    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")  # `sample` rows at most

    def work(values: list) -> Iterator[tuple]:
        return ((x,) for x in pool(values, vectors).tolist())

    t = add_columns(rows, "text", [("x", T.ArrayType(T.FloatType()))], work, drop=True).groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(t.column("x").to_pylist(), np.float32).reshape(t.num_rows, 3 * vectors.shape[1] + 1)
    return vectors, Network().fit(x, (t.column("y").to_numpy() > 0.5).astype(float))


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", score: str = "score", drop: bool = False, **options) -> DataFrame:
    """docs and a column of scores, from 0 to 1: the probability that a document's label is 1. With drop, without the text."""
    check_columns(docs, [doc_id, text])
    check_columns(labels, ["doc_id", "quality"])
    vectors, network = fit(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels.select("doc_id", "quality"), **options)
    return add_columns(docs, text, [(score, T.DoubleType())], lambda values: ((x,) for x in network.score(pool(values, vectors)).tolist()), drop)


def report(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if the score is at least `least`)."""
    s = scored(docs.select("doc_id", "text"), labels, drop=True)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """docs whose score is at least `least`."""
    name = fresh(docs, "score")
    return scored(docs, labels, score=name).filter(F.col(name) >= least).select(*docs.columns)
