"""Near duplicates by SetSketch registers, banded, estimated by likelihood and verified on the full sets.

A document's set is that of its word shingles, as 64-bit hashes. A register is the truncated logarithm, to base `base`,
of the least of the set's exponentially distributed hash values; registers merge by maximum. Two sets' registers agree
with a probability near their Jaccard similarity, the more so the nearer the base is to 1.

1. Documents with equal sets form a class, from here on represented by its smallest doc_id.
2. Bands of `rows` registers are hashed; classes that share a band's hash meet in a bucket. With 32 bands of 5, a pair
   of similarity 0.8 misses all buckets with probability 3e-6.
3. Buckets with the same members are treated once. Those of more than `most` members are dealt by a salt that differs
   between bands into parts of about that size. In each, every member proposes a link to the most similar member before
   it, by the likelihood of the two sketches and sizes, if that may reach the threshold (five standard errors allowed).
4. Proposed links are verified on the sets of the whole texts, and components found by large-star and small-star steps.
5. Where a bucket's members are now in several components, all pairs across components that may reach the threshold are
   verified too, within the bucket's task; and components are found again. In large buckets, each part of the members
   outside the largest component meets each part of all, so few stragglers cost few rows. A link between two classes that
   share a bucket is missed only where the two are in one component anyway.

Documents come to their classes, and to a repeated set's component, by joins on the set: a set that very many documents have is
split there by adaptive execution only. Pairs of a bucket are never rows of a table. No step of the search has more than two parts of a bucket (`most` members each, and
`most_hashes` shingles in all) in one task, and none brings ids, links or components to the driver.

Cases: a null or empty text, or one without words, has the empty set and is linked with nothing; fewer words than a
shingle count as one shingle; texts may be of any length; rows with a null doc_id take no part, have a null component and
count as kept; rows that repeat a document get the same component, and rows with one doc_id and different texts count in
`run` as one document that has the links of all of them (`keep` judges each text on its own, so that none is lost); where
doc_ids repeat, rows are numbered and the table is written once more; doc_id is read as a long; an empty table gives an
empty table. Sets are compared by their shingles' 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.shared import add_columns, check_columns, cut, fresh, whole_groups, word_ids


_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's n-word shingles; A-Z are lower-cased, ASCII white space divides."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(word_ids.__getitem__, words), np.uint64, len(words))
    size = min(n, len(ids))
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out + ids[i : len(ids) - size + 1 + i]) * _C[0]
        out ^= out >> np.uint64(29)
    out = np.sort((out ^ (out >> np.uint64(32))) * _C[1])
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class Sketcher:
    """Registers of sets: `size` of them, to base `base`, truncated to 0..limit."""

    def __init__(self, size: int, base: float, rate: float = 20.0, limit: int = 65535, seed: int = 5):
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 1 << 32, size, np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = r.integers(0, 1 << 32, size, np.uint64).astype(np.uint32)
        self.size, self.base, self.rate, self.limit = size, base, rate, limit

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        h = ((hashes * _C[2]) >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), 512):
            np.minimum(least, (h[i : i + 512, None] * self.a + self.b).min(axis=0), out=least)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / self.rate
        return np.clip(np.floor(1 - np.log(x) / math.log(self.base)), 0, self.limit).astype(np.uint16)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The registers of the union."""
        return np.maximum(a, b)

    def reaches(self, above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
        """Whether the likeliest Jaccard similarity is at least `least`, given how many registers of a exceed b's and fall short, and the sets' sizes.

        The logarithm of the joint likelihood is concave in the similarity j, so that is where its slope at `least` is not
        negative. The chance that a register of a is the greater is p(u - v j), with u and v the shares of the sizes.
        """
        u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
        log_b, shrink = math.log(self.base), (self.base - 1) / self.base
        x, y = np.maximum(u - v * least, 1e-9), np.maximum(v - u * least, 1e-9)
        p, q = -np.log1p(-x * shrink) / log_b, -np.log1p(-y * shrink) / log_b
        dp, dq = -v * shrink / ((1 - x * shrink) * log_b), -u * shrink / ((1 - y * shrink) * log_b)
        same = self.size - above - below
        return above * dp / p + below * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-9) >= 0


class NearDup:
    """Parameters: words in a shingle, the threshold in hundredths, bands, registers in a band, members of a bucket's part."""

    def __init__(self, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, most: int = 1024, most_hashes: int = 1 << 21, base: float = 1.001):
        self.shingle, self.percent, self.bands, self.rows, self.most, self.most_hashes = shingle, percent, bands, rows, most, most_hashes
        self.sketcher = Sketcher(bands * rows, base)
        t = percent / 100
        self.least = t - 5 * math.sqrt(t * (1 - t) / (bands * rows))

    def sketches(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text) to (doc_id, n_shingles, set_key, registers); the last two are null for the empty set."""

        def work(values: list) -> Iterator[tuple]:
            for x in values:
                s = shingle_set(x, self.shingle)
                yield (len(s), xxhash.xxh3_128_digest(s.tobytes()), self.sketcher.registers(s).tobytes()) if len(s) else (0, None, None)

        return add_columns(docs, "text", [("n_shingles", T.LongType()), ("set_key", T.BinaryType()), ("registers", T.BinaryType())], work, drop=True)

    def buckets(self, classes: DataFrame) -> DataFrame:
        """(rep, n_shingles, registers) to (key, band, parts, rep, n_shingles): the members of the buckets that have more than one."""
        width = 2 * self.rows
        keys = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("registers", b * width + 1, width)).alias("key")) for b in range(self.bands)]
        all_ = classes.select("rep", "n_shingles", F.inline(F.array(*keys)))
        full = all_.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes")).filter("n > 1")
        parts = F.greatest(F.ceil(F.col("n") / self.most), F.ceil(F.col("hashes") / self.most_hashes)).cast("long")
        return all_.join(full.select("key", parts.alias("parts")), "key")

    @staticmethod
    def _groups(members: DataFrame, part: Column) -> DataFrame:
        """(group, band, rep): each part of a bucket, parts with the same members once, with the first of their bands."""
        parts = members.groupBy("key", "band", part.alias("part")).agg(F.array_sort(F.collect_set("rep")).alias("reps")).filter("size(reps) > 1")
        parts = parts.groupBy("reps").agg(F.min("band").alias("band"))
        return parts.select(F.xxhash64("reps", "band").alias("group"), "band", F.explode("reps").alias("rep"))

    def _by_group(self, rows: DataFrame, work: Callable, schema: str) -> DataFrame:
        """What work(columns by name as arrays, where each group begins and ends) returns, a pair of arrays; groups are whole."""
        names = rows.columns
        blobs = {f.name: np.dtype(np.uint16 if f.name == "registers" else np.uint64) for f in rows.schema.fields if isinstance(f.dataType, T.BinaryType)}
        out = [f.split()[0] for f in schema.split(", ")]

        def column(t: pa.Table, n: str):
            c = t.column(n)
            return [np.frombuffer(x, blobs[n]) for x in c.to_pylist()] if n in blobs else c.to_numpy()

        def done(t: pa.Table) -> pa.RecordBatch:
            group = t.column("group").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            made = work({n: column(t, n) for n in names}, edges)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from map(done, whole_groups(batches, "group"))

        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "group").sortWithinPartitions("group", "rep").mapInArrow(run, schema)

    def _may(self, r: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows (i, j) may reach the threshold, by sizes and then by likelihood."""
        out = 100 * np.minimum(n[i], n[j]) >= self.percent * np.maximum(n[i], n[j])
        for k in range(0, len(i), 8192):
            at = k + np.flatnonzero(out[k : k + 8192])
            x, y = r[i[at]], r[j[at]]
            out[at] = self.sketcher.reaches((x > y).sum(axis=1), (x < y).sum(axis=1), n[i[at]].astype(float), n[j[at]].astype(float), self.least)
        return out

    def propose(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """Links (a, b), a < b: each member of a part with the most similar one before it, if they may reach the threshold."""
        part = F.pmod(F.xxhash64("rep", "key"), F.col("parts"))
        rows = self._groups(members, part).join(classes.select("rep", "n_shingles", "registers"), "rep")

        def work(t: dict, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            r, n = np.stack(t["registers"]), t["n_shingles"]
            a, b = [], []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                for i in range(low + 1, high):
                    b.append(i)
                    a.append(low if i == low + 1 else low + int((r[low:i] == r[i]).sum(axis=1, dtype=np.int32).argmax()))
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            good = self._may(r, n, a, b) if len(a) else np.empty(0, bool)
            return t["rep"][a[good]], t["rep"][b[good]]

        return self._by_group(rows.select("group", "rep", "n_shingles", "registers"), work, "a long, b long").distinct()

    def _plausible(self, r: np.ndarray, n: np.ndarray, of: np.ndarray, band: int) -> Iterator[tuple[int, np.ndarray]]:
        """For members of one group, i and those before it in other components that it may reach. A pair that meets in an earlier band is left to that."""
        ok = 100 * np.minimum(n[:, None], n) >= self.percent * np.maximum(n[:, None], n)
        ok &= of[:, None] != of
        for i in range(1, len(n)):
            at = np.flatnonzero(ok[i, :i])
            if len(at):
                equal = r[at] == r[i]
                near = equal.sum(axis=1, dtype=np.int32) >= 0.8 * self.least * r.shape[1]  # coarse; the likelihood decides
                at, equal = at[near], equal[near]
                at = at[equal.reshape(len(at), self.bands, self.rows).all(axis=2).argmax(axis=1) == band]
                at = at[self._may(r, n, np.full(len(at), i), at)]
                if len(at):
                    yield i, at

    def across(self, members: DataFrame, classes: DataFrame, components: DataFrame, docs: DataFrame) -> DataFrame:
        """Verified links (a, b) between components.

        First, by sketches, the members that have a plausible partner in another component of a bucket; then those meet
        again with their sets, and each is compared with all such partners. Pairs stay within the tasks; what leaves
        them is one link at most for a member and a component.
        """
        facts = classes.join(components, classes["rep"] == components["node"], "left").select("rep", "n_shingles", "registers", F.coalesce("component", "rep").alias("component"))
        known = members.join(components, members["rep"] == components["node"], "left").select("key", "band", "parts", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
        sums = known.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes"))
        sums = sums.groupBy("key").agg(F.max(F.struct("n", "component", "hashes")).alias("of"), F.sum("n").alias("n"), F.sum("hashes").alias("hashes"))
        left_n, left_hashes = F.col("n") - F.col("of.n"), F.col("hashes") - F.col("of.hashes")
        pieces = F.greatest(F.ceil(left_n / self.most), F.ceil(left_hashes / self.most_hashes)).cast("long")
        open_ = sums.filter(left_n > 0).select("key", F.col("of.component").alias("main"), pieces.alias("pieces"))
        # a part of those outside the bucket's largest component meets each part of all: n * pieces + (n - main) * parts rows
        own, mine = F.pmod(F.xxhash64("rep"), F.col("parts")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("pieces"))
        each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
        met = each("pieces", lambda i: i * F.col("parts") + own)
        met = F.when(F.col("component") == F.col("main"), met).otherwise(F.array_union(met, each("parts", lambda j: mine * F.col("parts") + j)))
        known = known.join(open_, "key").select("key", "band", "rep", F.explode(met).alias("meeting"))
        rows = self._groups(known, F.col("meeting")).join(facts, "rep").select("group", "band", "rep", "n_shingles", "component", "registers")

        def hopeful(t: dict, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            r, n = np.stack(t["registers"]), t["n_shingles"]
            hit = np.zeros(len(n), bool)
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                for i, at in self._plausible(r[low:high], n[low:high], t["component"][low:high], t["band"][low]):
                    hit[low + i] = True
                    hit[low + at] = True
            return t["group"][hit], t["rep"][hit]

        need = cut(self._by_group(rows, hopeful, "group long, rep long"))
        sets = docs.join(need.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sets = add_columns(sets, "text", [("hashes", T.BinaryType())], lambda values: ((shingle_set(x, self.shingle).tobytes(),) for x in values), drop=True)
        sets = cut(sets.select(F.col("doc_id").alias("rep"), F.length("hashes").alias("bytes"), "hashes").groupBy("rep").agg(F.max(F.struct("bytes", "hashes"))["hashes"].alias("hashes")))
        again = need.join(rows, ["group", "rep"]).join(sets, "rep").select("group", "band", "rep", "n_shingles", "component", "registers", "hashes")

        def link(t: dict, edges: np.ndarray) -> tuple[list, list]:
            r, n, rep, of = np.stack(t["registers"]), t["n_shingles"], t["rep"], t["component"]
            a, b = [], []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                sets = t["hashes"][low:high]
                names, flat = np.unique(np.concatenate(sets), return_inverse=True)
                ends = np.cumsum([len(s) for s in sets])
                starts, mark = ends - [len(s) for s in sets], np.zeros(len(names), bool)
                for i, at in self._plausible(r[low:high], n[low:high], of[low:high], t["band"][low]):
                    mark[flat[starts[i] : ends[i]]] = True
                    both = np.array([int(mark[flat[starts[j] : ends[j]]].sum()) for j in at])
                    mark[flat[starts[i] : ends[i]]] = False
                    good = at[100 * both >= self.percent * (n[low + i] + n[low + at] - both)]
                    for j in good[np.unique(of[low + good], return_index=True)[1]]:
                        a.append(rep[low + j])
                        b.append(rep[low + i])
            return a, b

        return self._by_group(again, link, "a long, b long").distinct()

    def verify(self, links: DataFrame, docs: DataFrame) -> DataFrame:
        """The links whose sets, from the whole texts, reach the threshold."""
        docs = docs.filter("text is not null")
        pairs = links.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        pairs = pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", F.struct("text_a", "text_b").alias("texts"))

        def work(values: list) -> Iterator[tuple]:
            seen: dict[str, np.ndarray] = {}
            for x in values:
                sets = []
                for text in (x["text_a"], x["text_b"]):
                    if text not in seen:
                        seen[text] = shingle_set(text, self.shingle)
                    sets.append(seen[text])
                s = np.concatenate(sets)
                s.sort()
                both = int((s[1:] == s[:-1]).sum())
                yield (100 * both >= self.percent * (len(s) - both),)

        return add_columns(pairs, "texts", [("good", T.BooleanType())], work, drop=True).filter("good").select("a", "b").distinct()

    @staticmethod
    def _repeats(docs: DataFrame) -> DataFrame:
        """The doc_ids that several rows have, written."""
        return cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))

    def _linked(self, docs: DataFrame, alike: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Of docs (doc_id, text, and more): (doc_id, n_shingles, set_key, registers, and more) by row, and (key, component) by set.

        A doc_id is that of one row. alike: values of a column `own`, the rows of each of which are linked whatever their texts.
        """
        rows = cut(self.sketches(docs))
        sets = rows.filter("set_key is not null and doc_id is not null")
        classes = cut(sets.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers")))
        members = cut(self.buckets(classes))
        links = cut(self.verify(cut(self.propose(members, classes)), docs))
        if alike is not None:
            same = cut(sets.join(alike, "own", "left_semi").select("own", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key").select("own", "rep"))
            low = same.groupBy("own").agg(F.min("rep").alias("a"))
            links = links.unionByName(same.join(low, "own").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct())
        found = components(links)
        more = cut(self.across(members, classes, found, docs))
        if not more.isEmpty():
            found = components(links.unionByName(more))
        of = classes.join(found, classes["rep"] == found["node"], "left").select(F.col("set_key").alias("key"), F.coalesce("component", "rep").alias("component"))
        return rows, of

    def run(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id = component_id)."""
        check_columns(docs, [doc_id, text])
        docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        twice = self._repeats(docs)
        if twice.isEmpty():
            return self._report(*self._linked(docs))
        # every row is a node of its own, and the rows of a document are linked
        number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
        rows, of = self._linked(cut(docs.select(number.alias("doc_id"), F.col("doc_id").alias("own"), "text")), twice.withColumnRenamed("doc_id", "own"))
        known = cut(rows.filter("doc_id is not null").join(of, F.col("set_key") == F.col("key")).select("own", "component").distinct())
        label = known.join(known.groupBy("component").agg(F.min("own").alias("label")), "component").select(F.col("own").alias("doc"), "label")  # a row for each document
        rows = rows.join(label, F.col("own") == F.col("doc"), "left").select(F.col("own").alias("doc_id"), "n_shingles", F.coalesce("label", "own").alias("component_id"))
        return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    @staticmethod
    def _report(rows: DataFrame, of: DataFrame) -> DataFrame:
        out = rows.drop("registers").join(of, F.col("set_key") == F.col("key"), "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    def keep(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """docs with one row, that of the smallest doc_id, of each group of near duplicates; rows without words all stay.

        Where a doc_id has several texts, each row is judged by its own text: a group is of texts linked by their
        similarity, never by their ids, so every row that goes leaves one that it is linked with. Rows without a
        doc_id are not compared, but of those with equal sets, rows with a doc_id included, one stays.
        """
        check_columns(docs, [doc_id, text])
        plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        if self._repeats(plain).isEmpty() and plain.filter("doc_id is null").isEmpty():
            name = fresh(docs, "gone")
            gone = cut(self._report(*self._linked(plain)).filter("not kept").select(F.col("doc_id").alias(name)))
            return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
        # every row is a node of its own
        name = fresh(docs, "row")
        numbered = cut(docs.withColumn(name, F.monotonically_increasing_id()))
        own = F.col(doc_id).cast("long")
        rows, of = self._linked(numbered.select(F.when(own.isNotNull(), F.col(name)).alias("doc_id"), own.alias("own"), F.col(name).alias("row"), F.col(text).alias("text")))
        rows = rows.filter("set_key is not null").join(of, F.col("set_key") == F.col("key"), "left")
        rows = cut(rows.select("row", "own", "component", F.when(F.col("component").isNull(), F.col("set_key")).alias("lone")))
        best = rows.groupBy("component", "lone").agg(F.min(F.struct(F.col("own").isNull(), "own", "row")).alias("best")).select(F.col("best.row").alias("row"))
        gone = cut(rows.select("row").join(best, "row", "left_anti"))
        return numbered.join(gone.withColumnRenamed("row", fresh(numbered, "gone")), F.col(name) == F.col(fresh(numbered, "gone")), "left_anti").drop(name)


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, component): each linked node with the smallest node that it reaches.

    Large-star and small-star steps in turn (Kiveris et al. 2014) make every component a star around its smallest node;
    a step is an aggregation of minima, partial before its shuffle, and a join back by node. Where a node has very many
    links, the rows of that join are split by adaptive execution only.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = cut(both.join(low, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w"))
        new = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(new.select("v", "v").distinct())
        edges = new
