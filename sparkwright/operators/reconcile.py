"""Order totals held against their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.money import balance


def line_sums(lines: DataFrame) -> DataFrame:
    """Per order: lines, net and tax. Decimals, so sums do not depend on the order; partial sums before the shuffle."""
    price, discount, tax = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    rows = lines.select("l_orderkey", (price * (1 - discount)).cast("decimal(18,4)").alias("n"), tax.alias("t"))
    rows = rows.select("l_orderkey", "n", (F.col("n") * F.col("t")).cast("decimal(18,6)").alias("v"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("n"), 2).alias("net"), F.round(F.sum("v"), 2).alias("tax"))


def reconcile(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Per order: its lines' net and tax, what its total differs by, and a status: balanced (to a cent), over, under or no_lines."""
    both = orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total")).join(line_sums(lines), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    gap = balance(F.col("net"), F.col("tax"), F.col("total"))
    status = F.when(F.col("n_lines").isNull(), "no_lines").when(F.abs(gap) <= F.lit("0.01").cast("decimal(3,2)"), "balanced").when(gap > 0, "over").otherwise("under")
    return both.select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), *(F.col(c).cast("double").alias(c) for c in ("net", "tax", "total")), gap.cast("double").alias("gap"), status.alias("status"))
