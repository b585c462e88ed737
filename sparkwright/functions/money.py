"""Amounts as exact decimals: net, tax and gross."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """Cents are kept; halves are rounded away from zero."""
    return x.try_cast("decimal(18,2)")


def tax_on(net: Column, percent: Column) -> Column:
    return F.round(money(net) * percent.cast("decimal(5,2)") / F.lit(100).cast("decimal(3,0)"), 2).cast("decimal(18,2)")


def net_of(gross: Column, percent: Column) -> Column:
    """The net part of an amount that includes tax."""
    return F.round(money(gross) * 100 / (percent.cast("decimal(5,2)") + 100), 2).cast("decimal(18,2)")


def balance(net: Column, tax: Column, total: Column) -> Column:
    """What the total exceeds net and tax by."""
    return (money(total) - money(net) - money(tax)).cast("decimal(18,2)")
