"""Checksums and shapes of identifiers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from veilspark.functions import fx as F

# The weights of the check digits. The 12-digit tax number's second check digit is computed here with ten
# weights over digits 2 to 11, as equal results need; the official rule has eleven weights over digits 1 to 11.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND = (2, 4, 10, 3, 5, 9, 4, 6, 8, 10)
INN12_OFFICIAL = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS = (9, 8, 7, 6, 5, 4, 3, 2, 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body reads it (a bound variable in place of copies of the expression)."""
    return F.transform(F.array(value), body)[0]


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def weighted(d: Column, weights: Sequence[int], first: int = 0) -> Column:
    """The sum of the digits from place first on times the weights; d must have digits at those places."""
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(d, first + i + 1, 1).try_cast("int") * w
    return total


def digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).try_cast("int")


def inn10(d: Column) -> Column:
    return let(d, lambda d: F.coalesce(d.rlike("^[0-9]{10}$") & (weighted(d, INN10) % 11 % 10 == digit(d, 9)), F.lit(False)))


def inn12(d: Column, official: bool = False) -> Column:
    def check(d: Column) -> Column:
        first = weighted(d, INN12_FIRST) % 11 % 10 == digit(d, 10)
        second = (weighted(d, INN12_OFFICIAL) if official else weighted(d, INN12_SECOND, 1)) % 11 % 10 == digit(d, 11)
        return F.coalesce(d.rlike("^[0-9]{12}$") & first & second, F.lit(False))

    return let(d, check)


def inn(d: Column, official: bool = False) -> Column:
    return let(d, lambda d: inn10(d) | inn12(d, official))


def snils(d: Column) -> Column:
    """Eleven digits with the right control number; controls 00 and leading 000 are never right."""
    def check(d: Column) -> Column:
        # A remainder of 100 counts as 0, as does 0 itself; neither is a control number.
        known = (F.substring(d, 10, 2) != "00") & (F.substring(d, 1, 3) != "000")
        return F.coalesce(d.rlike("^[0-9]{11}$") & known & (weighted(d, SNILS) % 101 == F.substring(d, 10, 2).try_cast("int")), F.lit(False))

    return let(d, check)


def luhn(d: Column) -> Column:
    return let(d, lambda d: F.coalesce(d.rlike("^[0-9]{12,19}$") & F.call_function("luhn_check", d), F.lit(False)))


def iban(s: Column) -> Column:
    """Remainder 1 of the rearranged number by 97, digit by digit."""
    t = F.upper(F.regexp_replace(s, r"\s", ""))
    moved = F.concat(F.substring(t, 5, 60), F.substring(t, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[A-Z]"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)
    return t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


IP_SHAPE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
SNILS_SHAPE = r"^\d{3}-\d{3}-\d{3}\s*\d{2}$"
MAC_SHAPE = r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"
CHANNEL_SHAPE = r"^-100\d{10,}$"
PHONE_SHAPE = r"^(?:\+?7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}$|^(?:\+?7|8)\d{10}$"
PHONE_PREFIX = r"^(?:\+|8|7)"
