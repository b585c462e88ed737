"""Identifiers with check digits: IBAN (ISO 13616, ISO 7064 MOD 97-10) and the Romanian fiscal code's control digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of the countries' IBANs in the ISO 13616 registry, and the weights of the fiscal code's digits.
IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in """
        AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27
        DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28
        IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22
        MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24
        SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30
    """.split()
}
FISCAL_KEY = (7, 5, 3, 2, 1, 7, 5, 3, 2)


def compact(code: Column) -> Column:
    """Without white space, in upper case."""
    return F.upper(F.regexp_replace(code, r"\s", ""))


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters read as one number, A being 10 and Z 35."""

    def step(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        letter = n >= F.lit(65)
        return (rest * F.when(letter, 100).otherwise(10) + F.when(letter, n - 55).otherwise(n - 48)) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


def iban_check_digits(country: str, bban: Column) -> Column:
    """The two check digits for a country's basic account number."""
    return F.lpad((98 - mod97(F.concat(bban, F.lit(f"{country}00")))).cast("string"), 2, "0")


def iban_valid(code: Column) -> Column:
    """Whether it is an IBAN: its form, the length of its country, which must be in the registry, and remainder 1. Null for null."""
    c = compact(code)
    lengths = F.create_map(*(F.lit(x) for item in IBAN_LENGTH.items() for x in item))
    form = c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & F.coalesce(F.length(c) == F.try_element_at(lengths, F.left(c, F.lit(2))), F.lit(False))
    return F.when(code.isNotNull(), F.when(form, mod97(F.concat(F.substring(c, 5, 30), F.substring(c, 1, 4))) == 1).otherwise(False))


def iban_verdict(code: Column) -> Column:
    """What is wrong first: malformed (not two letters, two digits, and letters or digits), unknown_country, wrong_length (for its country), wrong_check_digits; else valid. Null for null."""
    c = compact(code)
    lengths = F.create_map(*(F.lit(x) for item in IBAN_LENGTH.items() for x in item))
    length = F.try_element_at(lengths, F.left(c, F.lit(2)))
    return (
        F.when(code.isNull(), None)
        .when(~c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), "malformed")
        .when(length.isNull(), "unknown_country")
        .when(F.length(c) != length, "wrong_length")
        .when(mod97(F.concat(F.substring(c, 5, 30), F.substring(c, 1, 4))) != 1, "wrong_check_digits")
        .otherwise("valid")
    )


def fiscal_verdict(code: Column, prefix: str = "RO") -> Column:
    """Of a fiscal code, with or without its country's prefix as in a VAT number: malformed (not two to ten digits), wrong_check_digit or valid. Null for null."""
    c = compact(code)
    bare = F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 40)).otherwise(c)
    return F.when(code.isNull(), None).when(~bare.rlike("^[0-9]{2,10}$"), "malformed").when(fiscal_valid(bare), "valid").otherwise("wrong_check_digit")


def iban_print(code: Column) -> Column:
    """In groups of four."""
    return F.trim(F.regexp_replace(compact(code), "(.{4})", "$1 "))


def fiscal_control(base: Column) -> Column:
    """The control digit of up to nine digits: weighed sum times 10, by 11; 10 counts as 0."""
    padded = F.lpad(base, 9, "0")
    total = sum((F.substring(padded, i + 1, 1).cast("int") * k for i, k in enumerate(FISCAL_KEY)), F.lit(0))
    return total * 10 % 11 % 10


def fiscal_valid(code: Column) -> Column:
    """Whether two to ten digits end in their control digit. Null for null."""
    form = code.rlike("^[0-9]{2,10}$")
    return F.when(code.isNotNull(), F.when(form, fiscal_control(F.regexp_replace(code, "[0-9]$", "")) == F.right(code, F.lit(1)).try_cast("int")).otherwise(False))
