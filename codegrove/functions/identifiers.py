"""Scalar functions: component identifiers, check digits, dates, literals, case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dihedral(a: int, b: int) -> int:
    """The product in the dihedral group of ten elements: rotations 0 to 4, reflections 5 to 9."""
    if a < 5:
        return (a + b) % 5 if b < 5 else (a + b - 5) % 5 + 5
    return (a - 5 - b) % 5 + 5 if b < 5 else (a - b) % 5


def _permutations() -> list[list[int]]:
    """Powers of the check's base permutation, by place modulo 8."""
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    out = [list(range(10))]
    for _ in range(7):
        out.append([base[x] for x in out[-1]])
    return out


_POWERS = _permutations()
_INVERSE = [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]


def check_sum(digits: str, places: int = 0) -> int:
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = _dihedral(c, _POWERS[(i + places) % 8][ord(d) % 10 if not d.isdigit() else int(d)])
    return c


def check_digit(digits: str) -> int:
    return _INVERSE[check_sum(digits, 1)]


def append_check_digit(digits: str) -> str:
    return digits + str(check_digit(digits))


def is_valid(identifier: int | str) -> bool:
    text = str(identifier)
    return bool(re.fullmatch(r"[0-9]{6,18}", text)) and check_sum(text) == 0


_KINDS = {"0": "concept", "1": "description", "2": "relationship"}


def kind(identifier: int | str) -> str | None:
    """concept, description or relationship by the partition digits; None if the check digit or the partition is wrong."""
    text = str(identifier)
    return _KINDS.get(text[-2]) if is_valid(text) and text[-3] in "01" else None


def namespace(identifier: int | str) -> str | None:
    """The 7-digit namespace of an extension's identifier; None for short ones."""
    text = str(identifier)
    return text[:-3].zfill(7)[-7:] if is_valid(text) and text[-3] == "1" else None


def check_sum_column(identifier: Column) -> Column:
    """The check sum of an identifier column, 0 if valid, by table lookups over its digits."""
    product = F.array(*[F.lit(_dihedral(a, b)) for a in range(10) for b in range(10)])
    power = F.array(*[F.lit(x) for row in _POWERS for x in row])
    digits = F.reverse(F.split(identifier.cast("string"), ""))
    return F.aggregate(F.sequence(F.lit(0), F.size(digits) - 1), F.lit(0), lambda c, i: product[c * 10 + power[F.pmod(i, F.lit(8)) * 10 + digits[i].cast("int")]])


def kind_column(identifier: Column) -> Column:
    text = identifier.cast("string")
    digit = F.substring(text, -2, 1)
    found = F.when(digit == "0", "concept").when(digit == "1", "description").when(digit == "2", "relationship")
    return F.when(F.length(text).between(6, 18) & (check_sum_column(identifier) == 0) & F.substring(text, -3, 1).isin("0", "1"), found)


def effective_time(text: Column) -> Column:
    """yyyyMMdd as a date; blank or bad is 1970-01-01."""
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.to_date(F.lit("1970-01-01")))


def flag(text: Column) -> Column:
    return F.coalesce(text == "1", F.lit(False))


def literal(value: Column) -> dict[str, Column]:
    """A tagged literal's columns: '#' numbers as double, quoted strings, true and false."""
    number = F.when(value.startswith("#"), F.expr("try_cast(substring(value, 2) AS double)"))
    return {
        "number": number,
        "text": F.when(value.rlike('(?s)^".*"$'), F.expr("substring(value, 2, length(value) - 2)")),
        "flag": F.when(F.lower(value).isin("true", "false"), F.lower(value) == "true"),
    }


#: Case significance concepts.
CASE_INSENSITIVE, CASE_INITIAL, CASE_SENSITIVE = 900000000000448009, 900000000000020002, 900000000000017005


def lowered(term: Column, significance: Column) -> Column:
    """A term as it stands inside a sentence; unchanged where the significance is sensitive or unknown."""
    first = F.concat(F.lower(F.substring(term, 1, 1)), F.expr("substring(term, 2)"))
    return F.when(significance == CASE_INITIAL, first).when(significance == CASE_INSENSITIVE, F.lower(term)).otherwise(term)
