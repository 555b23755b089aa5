"""Predicates over method full names, as Column expressions. Null names are never noise."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers and prefixes of generated or standard-library names.
MARKERS = ("<operator>", "<clinit>", "<unresolvedNamespace>", "<unknownFullName>", "<empty>")
ANGLE_MARKERS = (*MARKERS, "<lambda>", "<init>")
ACCESSOR = "access$"
LAMBDA = r"^(?:lambda\$.*\$\d+|<lambda>\d+)(?::.*)?$"
ANONYMOUS_CLASS = r"\$\d+$"
STRIPPED_CALLS = ("java.util.", "java.io.")
BUILTIN = ("java.", "javax.", "jdk.", "sun.", "com.sun.")


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def dotted_part(name: Column, from_end: int) -> Column:
    """The part ``from_end`` (1: last) of the dotted name before its signature; empty if there is none."""
    return F.coalesce(F.try_element_at(F.split(F.substring_index(name, ":", 1), r"\."), F.lit(-from_end)), F.lit(""))


def is_lambda(name: Column) -> Column:
    return dotted_part(name, 1).rlike(LAMBDA)


def is_noise(name: Column) -> Column:
    """Holds a marker, or is an accessor, a lambda body, or a method of an anonymous class."""
    found = any_of([*(name.contains(x) for x in MARKERS), dotted_part(name, 1).startswith(ACCESSOR), is_lambda(name), dotted_part(name, 2).rlike(ANONYMOUS_CLASS)])
    return F.coalesce(found, F.lit(False))


def is_stripped_call(name: Column) -> Column:
    return F.coalesce(any_of([name.startswith(x) for x in STRIPPED_CALLS]), F.lit(False))


def is_builtin(name: Column) -> Column:
    return F.coalesce(any_of([name.startswith(x) for x in BUILTIN]), F.lit(False))


def is_synthetic(name: Column) -> Column:
    """A name of generated code: holds a marker, lambdas and constructors included, is an accessor, a lambda body or an anonymous class."""
    found = any_of([*(name.contains(x) for x in ANGLE_MARKERS), name.startswith(ACCESSOR), name.rlike(LAMBDA), name.rlike(ANONYMOUS_CLASS)])
    return F.coalesce(found, F.lit(False))


def is_document_type(name: Column, full_name: Column) -> Column:
    """Types that get a document: neither synthetic nor of the standard library."""
    return ~(is_synthetic(name) | is_synthetic(full_name) | is_builtin(full_name))


def is_document_method(name: Column) -> Column:
    """Methods that get a document: not synthetic, constructors included."""
    return ~is_synthetic(name) | (name == "<init>")


def is_document_identifier(name: Column) -> Column:
    return ~(is_synthetic(name) | (name == "this") | name.startswith("$"))


def filter_methods(methods: DataFrame, name: str = "fullName") -> DataFrame:
    """Methods whose names are neither noise nor of the standard library."""
    return methods.where(~is_noise(F.col(name)) & ~is_builtin(F.col(name)))


def compact_name(name: Column) -> Column:
    """Without signature, the last two dotted parts."""
    return F.substring_index(F.substring_index(name, ":", 1), ".", -2)


def relative_path(file: Column, root: str) -> Column:
    """Null for blank and ``<...>`` names; below ``root`` relative to it; with forward slashes."""
    slashed = F.replace(file, F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    inside = F.when(slashed.startswith(base), F.substr(slashed, F.lit(len(base) + 1))).otherwise(slashed)
    return F.when((F.trim(file) == "") | file.startswith("<"), None).otherwise(inside)
