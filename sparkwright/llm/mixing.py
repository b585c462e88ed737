"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is the number of copies that each of its documents should have on average. The whole part
is taken; the rest is a probability below one. Two documents with such probabilities meet: mass, weighed by size, moves
from one to the other, in a random direction whose odds keep both expectations, until one of the two is 0 or 1 and so
decided. The other goes on. Size times probability summed over a source never changes, so its taken words miss the target
by less than one document. A fold does this within blocks of some 32 documents; each block's undecided document goes to
the next level's blocks, a reduction tree whose levels are each a shuffle of 1/32 of the rows before. The last is drawn.

A unit is a set of repeated rows (same id, source and text). Of r rows with a probability of p each, floor(p * r) are
taken outright, and the rest of p * r is rounded with the size of one row; the unit's rows are then counted through and the
first ones taken, as they are interchangeable. All draws are hashes of what meets, so reruns agree, whatever the partitions.

Cases: a null text has size 0, and a document of size 0 is drawn alone, taking no words; a null source is a source of its
own, last in order; ties and repeated rows as said; an empty table gives an empty table; a size may be up to 2**53 words.
The table of sources (a few numbers each) is sorted in one task: it may have millions of rows, not billions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.shared import check_columns, cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the table of sources that may be broadcast; it is joined by shuffle beyond.
BROADCAST_ROWS = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """sizes (source, source_size) and each source's target.

    Sources in code point order, null last, have the weights in turn and share the sum of all sizes by them. A target
    stops at cap times its source's size and the excess is shared again by weight. At the end, every source below its
    cap has the same target per weight; over the order of caps per weight, that level is the greatest of
    (what caps before leave) / (weights that are left).
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")).cast("double")
    s = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) - taken("most")) / (F.sum("weight").over(every) - taken("weight"))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return s.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def _draw(*of: Column) -> Column:
    """A number from 0 to 1, from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / float(1 << 53)


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """One step of the fold: acc.cur, undecided, meets x; one of them is decided and joins acc.done, the other becomes acc.cur."""
    a = acc["cur"]
    room = x["p"] * x["w"] / a["w"], (1 - x["p"]) * x["w"] / a["w"]  # what x can give and take, in a's probability
    gain, loss = F.least(1 - a["p"], room[0]), F.least(a["p"], room[1])
    up = _draw(F.lit(seed), a["unit"], x["unit"]) * (gain + loss) < loss
    a_ends = F.when(up, 1 - a["p"] <= room[0]).otherwise(a["p"] <= room[1])
    moved = lambda y, p: F.struct(y["unit"].alias("unit"), y["w"].alias("w"), p.alias("p"))
    ended = lambda y, one: F.struct(y["unit"].alias("unit"), F.when(one, 1).otherwise(0).alias("up"))
    rest = F.when(a_ends, moved(x, x["p"] + F.when(up, a["p"] - 1).otherwise(a["p"]) * a["w"] / x["w"])).otherwise(moved(a, a["p"] + F.when(up, room[0]).otherwise(-room[1])))
    return F.when(a.isNull(), F.struct(moved(x, x["p"]).alias("cur"), acc["done"].alias("done"))).otherwise(
        F.struct(rest.alias("cur"), F.concat(acc["done"], F.array(F.when(a_ends, ended(a, up)).otherwise(ended(x, ~up)))).alias("done"))
    )


def decide(units: DataFrame, seed: int = 17, block: int = 32) -> DataFrame:
    """units (source, n: how many units its source has, unit: a struct, w > 0, 0 < p < 1) to (unit, up: 0 or 1)."""
    unit = units.schema["unit"].dataType.simpleString()
    zero = f"named_struct('cur', cast(null as struct<unit:{unit},w:double,p:double>), 'done', cast(array() as array<struct<unit:{unit},up:int>>))"
    level, rows, done = 0, units, []
    most = units.agg(F.max("n")).first()[0] or 0
    while most:
        blocks = F.ceil(F.col("n") / block).cast("long")
        key = F.pmod(F.xxhash64(F.lit(seed + level), "unit"), F.col("blocks"))
        one = F.struct(F.xxhash64(F.lit(seed - 1), "unit").alias("h"), "unit", "w", "p")
        folded = (
            rows.withColumn("blocks", blocks)
            .groupBy("source", "blocks", key.alias("block"))
            .agg(F.array_sort(F.collect_list(one)).alias("all"))
            .select("source", F.col("blocks").alias("n"), F.aggregate("all", F.expr(zero), lambda acc, x: _meet(acc, x, seed)).alias("out"))
        )
        folded = cut(folded)
        done.append(folded.select(F.inline("out.done")))
        rows = folded.select("source", "n", "out.cur.*")
        most, level = -(-most // block) if most > 1 else 0, level + 1
        if most <= 1:
            done.append(rows.select("unit", F.when(_draw(F.lit(seed), F.lit(level), "unit") < F.col("p"), 1).otherwise(0).alias("up")))
            most = 0
    out = done[0] if done else rows.select("unit", F.lit(0).alias("up"))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """Each unit: doc_id, source, text_hash, size, rows (how many repeat it), source_size, target, whole (copies of each row), extra (how many rows have one more)."""
    check_columns(df, [doc_id, source, text])
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    units = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("text_hash"), size.alias("size"))
    units = cut(units.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("rows")))
    wanted = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    wanted = cut(targets(wanted, weights, cap).withColumnRenamed("source", "s").join(wanted.select(F.col("source"), "n"), F.col("s").eqNullSafe(F.col("source"))).drop("source"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("share") + 1e-12)
    all_ = units.join(wanted, units["source"].eqNullSafe(wanted["s"])).drop("s").withColumn("share", share)
    all_ = all_.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(F.col("share") - F.col("whole"), F.lit(0.0)))
    sure = F.floor(F.col("p") * F.col("rows") + 1e-12 * F.col("rows"))
    all_ = all_.withColumn("sure", sure).withColumn("p", F.greatest(F.col("p") * F.col("rows") - F.col("sure"), F.lit(0.0)))
    unit = F.struct("doc_id", "source", "text_hash", "size", "rows", "source_size", "target", "whole", "sure").alias("unit")
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    drawn = decide(all_.filter(open_).select("source", "n", unit, F.col("size").cast("double").alias("w"), "p"), seed)
    alone = all_.filter(~open_).select(unit, F.when(_draw(F.lit(seed), "doc_id", "text_hash") < F.col("p"), 1).otherwise(0).alias("up"))
    out = drawn.unionByName(alone)
    return out.select("unit.*", "up").withColumn("extra", F.col("sure") + F.col("up")).drop("sure", "up")


def taken(df: DataFrame, **options) -> DataFrame:
    """Per row of df: doc_id, size, source_size, target (both its source's), and the words that the mix takes."""
    to = lambda a, b: F.explode(F.sequence(a, b))
    m = mix(df, **options).withColumn("block", to(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / 1000)))  # a hot unit's rows by the thousand
    m = m.withColumn("row", to(F.col("block") * 1000, F.least("rows", F.col("block") * 1000 + 1000) - 1))
    copies = F.col("whole") + (F.col("row") < F.col("extra")).cast("int")
    return m.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def _numbered(rows: DataFrame, unit: list[str], number: str) -> DataFrame:
    """rows and their numbers from 1 in their unit. Stretches of at most 1,000 rows are numbered apart, so a hot unit meets in no one task."""
    at, part, before = fresh(rows, "mix_at"), fresh(rows, "mix_part"), fresh(rows, "mix_before")
    rows = cut(rows.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.floor(F.col(at) / 1000))
    counts = rows.groupBy(*unit, part).count()
    back = Window.partitionBy(*unit).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*unit, part]
    counts = counts.select(*(F.col(c).alias(f"of_{i}") for i, c in enumerate(keys)), F.coalesce(F.sum("count").over(back), F.lit(0)).alias(before))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{i}"))
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(at)))
    return rows.join(counts, same).withColumn(number, F.col(number) + F.col(before))


def apply(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix: df's rows, each as often as it has copies."""
    names = [fresh(df, f"mix_{c}") for c in ("doc_id", "source", "text_hash", "whole", "extra", "rows")]
    m = cut(mix(df, doc_id, source, text, **options).filter("whole + extra > 0").select("doc_id", "source", "text_hash", "whole", "extra", "rows").toDF(*names))
    whole, extra, rows = map(F.col, names[3:])
    same = F.col(doc_id).eqNullSafe(F.col(names[0])) & F.col(source).eqNullSafe(F.col(names[1])) & F.xxhash64(F.col(text)).eqNullSafe(F.col(names[2]))
    split, one = (extra > 0) & (extra < rows), fresh(df, "mix_one")
    copied = lambda d, more: d.select(*df.columns, F.explode(F.array_repeat(F.lit(0), (whole + more.cast("int")).cast("int"))).alias(one)).drop(one)
    out = copied(df.join(m.filter(~split), same), extra > 0)
    if not (some := m.filter(split)).isEmpty():
        number = fresh(df, "mix_number")
        out = out.unionByName(copied(_numbered(df.join(some, same), names[:3], number), F.col(number) <= extra))
    return out
