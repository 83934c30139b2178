"""Reference set members: predicates on fields, reverse maps. Without a filter on active, inactive members count."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import Terminology
from ..plans.storage import members_of

_OPS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def compare(field: Column, op: str, value: object) -> Column:
    """A comparison that null fields fail."""
    return F.coalesce(getattr(field, _OPS[op])(value), F.lit(False))


def wildcard(pattern: str, *, single: bool = True) -> str:
    r"""A pattern with * (any run), ? (one character, if `single`) and \ escapes as a regular expression for the whole text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "*":
            out.append(".*")
        elif c == "?" and single:
            out.append(".")
        else:
            out.append("\\" + c if c in r".^$+{}[]()|\?*" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matching(field: Column, pattern: str) -> Column:
    return F.coalesce(field.rlike(wildcard(pattern)), F.lit(False))


def components(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("referenced_component_id").alias("id")).distinct()


def refset_members(t: Terminology, refsets: DataFrame) -> DataFrame:
    return components(t.refset_member.join(refsets.select(F.col("id").alias("refset_id")), "refset_id", "left_semi"))


def member_field(t: Terminology, refset_id: int, where: Column) -> DataFrame:
    """Components with a member of a reference set for which a condition on its fields holds."""
    return components(t.refset_member.where((F.col("refset_id") == refset_id) & where))


def reverse_map(t: Terminology, refset_id: int, where: Column) -> DataFrame:
    """Active members of a map for which a condition on the target holds, of components that have any such member."""
    found = member_field(t, refset_id, where)
    return t.member.where((F.col("refset_id") == refset_id) & where).join(members_of(found.toDF("referenced_component_id")), "referenced_component_id", "left_semi")
