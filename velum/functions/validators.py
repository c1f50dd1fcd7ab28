"""National identifier checks as Column expressions.

Every function maps null to null, and anything malformed to false: values are cast
with ``try_cast`` because an ``AND`` does not protect a failing cast in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check alphabets, weights and prefixes of the identifier schemes.
FINNISH_CHECK_CHARS = "0123456789ABCDEFHJKLMNPRSTUVWXY"
NORWEGIAN_WEIGHTS_1 = (3, 7, 6, 1, 8, 9, 4, 5, 2)
NORWEGIAN_WEIGHTS_2 = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
NINO_BAD_FIRST = "DFIQUV"
NINO_BAD_PREFIX = ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")


def _without(c: Column, *chars: str) -> Column:
    for ch in chars:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def _num(c: Column, pos: int, length: int) -> Column:
    return F.substring(c, pos, length).try_cast("int")


def _real_date(year: Column, month: Column, day: Column) -> Column:
    """Whether a date exists, in plain arithmetic: parsing would raise and catch an error per wrong date."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= last)


def _verdict(c: Column, cleaned: Column, check: Callable[[Column], Column]) -> Column:
    """``check`` of the cleaned value, which is bound once instead of being rebuilt at every use."""
    ok = F.get(F.transform(F.array(cleaned), check), F.lit(0))
    return F.when(c.isNotNull(), F.coalesce(ok, F.lit(False)))


def finnish_id(c: Column) -> Column:
    """DDMMYY, century sign, three digits, check character (number modulo 31)."""

    def check(s: Column) -> Column:
        sign = F.substring(s, 7, 1)
        century = F.when(sign == "+", 1800).when(sign == "-", 1900).when(sign == "A", 2000)
        number = F.concat(F.substring(s, 1, 6), F.substring(s, 8, 3)).try_cast("long")
        expected = F.substring(F.lit(FINNISH_CHECK_CHARS), (number % 31 + 1).cast("int"), F.lit(1))
        return (
            s.rlike(r"^\d{6}[+\-A]\d{3}[0-9A-FHJ-NPR-Y]\z")
            & _real_date(century + _num(s, 5, 2), _num(s, 3, 2), _num(s, 1, 2))
            & (F.substring(s, 11, 1) == expected)
        )

    return _verdict(c, F.upper(_without(c, " ")), check)


def luhn(c: Column) -> Column:
    return F.when(c.isNotNull(), F.coalesce(F.call_function("luhn_check", c), F.lit(False)))


def swedish_id(c: Column, pivot_year: int | None = None) -> Column:
    """Ten or twelve digits, birth date, Luhn.

    Two-digit years above ``pivot_year`` belong to the 1900s; by default the pivot
    is the current year, as a fixed one would age.
    """
    pivot = F.lit(pivot_year) if pivot_year is not None else F.year(F.current_date()) % 100

    def check(s: Column) -> Column:
        yy = _num(s, 1, 2)
        year = yy + F.when(yy > pivot, 1900).otherwise(2000)
        return (
            s.rlike(r"^\d{10}\z")
            & _real_date(year, _num(s, 3, 2), _num(s, 5, 2))
            & F.call_function("luhn_check", s)
        )

    digits = _without(c, " ", "-", "+")
    return _verdict(c, F.when(F.length(digits) == 12, F.substring(digits, 3, 10)).otherwise(digits), check)


def _mod11_digit(s: Column, weights: tuple[int, ...]) -> Column:
    total = sum((_num(s, i + 1, 1) * w for i, w in enumerate(weights)), F.lit(0))
    digit = 11 - total % 11
    return F.when(digit == 11, 0).otherwise(digit)


def norwegian_id(c: Column) -> Column:
    """Eleven digits; century from the individual number; two modulo-11 check digits."""

    def check(s: Column) -> Column:
        yy, individual = _num(s, 5, 2), _num(s, 7, 3)
        century = (
            F.when(individual.between(500, 749), F.when(yy >= 54, 1800).otherwise(2000))
            .when((individual >= 900) & (yy < 40), 2000)
            .otherwise(1900)
        )
        return (
            s.rlike(r"^\d{11}\z")
            & _real_date(century + yy, _num(s, 3, 2), _num(s, 1, 2))
            & (_mod11_digit(s, NORWEGIAN_WEIGHTS_1) == _num(s, 10, 1))
            & (_mod11_digit(s, NORWEGIAN_WEIGHTS_2) == _num(s, 11, 1))
        )

    return _verdict(c, _without(c, " ", "-"), check)


def danish_id(c: Column) -> Column:
    """Ten digits; century from digit seven; only the date is checked."""

    def check(s: Column) -> Column:
        yy, seventh = _num(s, 5, 2), _num(s, 7, 1)
        century = (
            F.when(seventh <= 3, 1900)
            .when(seventh.isin(4, 9), F.when(yy <= 36, 2000).otherwise(1900))
            .otherwise(F.when(yy <= 57, 2000).otherwise(1800))
        )
        return s.rlike(r"^\d{10}\z") & _real_date(century + yy, _num(s, 3, 2), _num(s, 1, 2))

    return _verdict(c, _without(c, " ", "-"), check)


def uk_nino(c: Column) -> Column:
    """Two prefix letters, six digits, suffix A to D; some prefixes are never issued."""

    def check(s: Column) -> Column:
        return (
            s.rlike(rf"^[^{NINO_BAD_FIRST}].\d{{6}}[A-D]\z")
            & (F.length(s) == 9)
            & ~F.substring(s, 1, 2).isin(*NINO_BAD_PREFIX)
        )

    return _verdict(c, F.upper(_without(c, " ")), check)


VALIDATORS = {
    "finnish_id": finnish_id,
    "swedish_id": swedish_id,
    "norwegian_id": norwegian_id,
    "danish_id": danish_id,
    "uk_nino": uk_nino,
    "luhn": luhn,
}
