import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import dates, identifiers, money
from sparkwright.sources.tables import split_bad


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {kind}")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_iban(spark):
    # published examples
    good = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "RO49AAAA1B31007593840000", "fr1420041010050500013m02606", "MT84MALT011000012345MTLCAST001S"]
    bad = ["GB82WEST12345698765433", "DE8937040044053201300", "XX", "", "12DE370400440532013000", "DE89-3704-0044-0532-0130-00", "RO49AAAA1B3100759384000"]
    # a country outside the registry, and one with another's length, each with remainder 1
    bad += [c + str(98 - int("".join(str(int(x, 36)) for x in f"{b}{c}00")) % 97).zfill(2) + b for c, b in (("ZZ", "370400440532013000"), ("NO", "370400440532013000"))]
    assert values(spark, [*good, *bad, None], "code string", identifiers.iban_valid(F.col("code"))) == [True] * 5 + [False] * 9 + [None]
    assert len(identifiers.IBAN_LENGTH) == 89 and min(identifiers.IBAN_LENGTH.values()) == 15
    assert values(spark, ["gb82west12345698765432"], "code string", identifiers.iban_print(F.col("code"))) == ["GB82 WEST 1234 5698 7654 32"]


def test_check_digits_round_trip(spark):
    bban = ["370400440532013000", "WEST12345698765432", "AAAA1B31007593840000", "0"]
    out = values(spark, bban, "b string", identifiers.iban_check_digits("DE", F.col("b")))
    for b, d in zip(bban, out, strict=True):
        n = int("".join(str(int(c, 36)) for c in f"{b}DE{d}"))
        assert n % 97 == 1 and len(d) == 2


def test_fiscal_code(spark):
    def control(base):
        return sum(int(d) * k for d, k in zip(base.zfill(9), (7, 5, 3, 2, 1, 7, 5, 3, 2), strict=True)) * 10 % 11 % 10

    bases = ["1", "12", "159012", "987654321", "000000001"]
    codes = [b + str(control(b)) for b in bases]
    wrong = [b + str((control(b) + 1) % 10) for b in bases]
    assert values(spark, codes + wrong + ["x1", "1", "12345678901", "", None], "code string", identifiers.fiscal_valid(F.col("code"))) == [True] * 5 + [False] * 9 + [None]


def test_verdicts(spark):
    codes = {"DE89370400440532013000": "valid", "gb82 west 1234 5698 7654 32": "valid", "DE89370400440532013001": "wrong_check_digits", "DE8937040044053201300": "wrong_length", "ZZ89370400440532013000": "unknown_country", "DE89-37040044053201": "malformed", "12DE": "malformed", "DE89": "malformed", "": "malformed", None: None}
    assert values(spark, list(codes), "code string", identifiers.iban_verdict(F.col("code"))) == list(codes.values())
    both = values(spark, [c for c in codes if c], "code string", identifiers.iban_verdict(F.col("code")), identifiers.iban_valid(F.col("code")))
    assert all((verdict == "valid") == good for verdict, good in both)
    codes = {"RO1590082": "valid", "ro 1590082": "valid", "1590082": "valid", "1590083": "wrong_check_digit", "RO": "malformed", "1": "malformed", "12345678901": "malformed", "DE1590082": "malformed", "": "malformed", None: None}
    assert values(spark, list(codes), "code string", identifiers.fiscal_verdict(F.col("code"))) == list(codes.values())


def test_money(spark):
    rows = [("100.005", 20), ("-100.005", 20), ("x", 20), (None, 20), ("0.10", 5)]
    assert values(spark, rows, "a string, p int", money.money(F.col("a"))) == [Decimal("100.01"), Decimal("-100.01"), None, None, Decimal("0.10")]
    assert values(spark, rows, "a string, p int", money.tax_on(F.col("a"), F.col("p")))[::4] == [Decimal("20.00"), Decimal("0.01")]
    assert values(spark, [("120.00", 20), ("1.00", 19)], "a string, p int", money.net_of(F.col("a"), F.col("p"))) == [Decimal("100.00"), Decimal("0.84")]
    assert values(spark, [("10", "2", "12.5")], "n string, v string, t string", money.balance(F.col("n"), F.col("v"), F.col("t"))) == [Decimal("0.50")]


@pytest.mark.parametrize("pattern,rows,want", [("yyyy-MM-dd", ["2024-02-29", "2023-02-29", "2024-2-1", "", None], [datetime.date(2024, 2, 29), None, None, None, None]), ("dd.MM.yyyy", ["31.12.1999", "31.04.2000", "1.1.2000"], [datetime.date(1999, 12, 31), None, None])])
def test_dates(spark, pattern, rows, want):
    assert values(spark, rows, "d string", dates.strict_date(F.col("d"), pattern)) == want


def test_split_bad(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, ok boolean")
    good, bad = split_bad(df, F.col("ok"))
    assert [r.i for r in good.collect()] == [1] and sorted(r.i for r in bad.collect()) == [2, 3]
