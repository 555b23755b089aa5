"""Branch guards of edges: arrays of ``struct<groupId, armLabel>``, a conjunction each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARDS = "array<struct<groupId:string,armLabel:string>>"


def no_guards() -> Column:
    return F.array().cast(GUARDS)


def merge(a: Column, b: Column) -> Column:
    """Both conjunctions, first positions kept; null if they demand two arms of one group."""
    both = F.array_distinct(F.concat(a, b))
    groups = F.array_distinct(F.transform(both, lambda r: r["groupId"]))
    return F.when(F.size(groups) == F.size(both), both)


def matches(guards: Column, selected: Column) -> Column:
    """Every guard equals the arm that the map ``selected`` has for its group."""
    return F.forall(guards, lambda r: F.coalesce(F.try_element_at(selected, r["groupId"]) == r["armLabel"], F.lit(False)))


def without_groups(guards: Column, removed: Column) -> Column:
    """Guards of groups that are not in the array ``removed``."""
    return F.filter(guards, lambda r: ~F.array_contains(removed, r["groupId"]))
