"""Set-valued signatures of calls, their overlap and the verdicts about neighbours."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the compared dimensions, dimensions of identity, names of observed features.
WEIGHTS = {"inputs": 0.75, "arguments": 0.65, "receivers": 0.60, "fields_read": 0.45, "method_terms": 0.30, "domain_types": 0.20}
IDENTITY = ("receivers", "inputs", "arguments")
DIMENSIONS = (*WEIGHTS, "fields_written", "output_types")
OBSERVED = {
    "receiver": ["receivers"], "inputs": ["inputs"], "arguments": ["arguments"], "callsiteFields": ["fields_read"], "calleeFields": ["fields_read", "fields_written"], "fieldsRead": ["fields_read"],
    "fieldsWritten": ["fields_written"], "domainTypes": ["domain_types"], "methodTerms": ["method_terms"], "output": ["output_types"], "outputType": ["output_types"],
}
LITERAL = r"""^(?:".*"|'.*'|[-+]?\d+(?:\.\d+)?)$"""


def strings(values: Column) -> Column:
    """Lower-case values without white space, placeholders and synthetic names, distinct and sorted."""
    plain = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.regexp_replace(v, r"\s+", "")))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda v: (v != "") & ~v.isin("<empty>", "<unknown>") & ~v.startswith("$"))))


def signature() -> dict[str, Column]:
    """The columns of a signature from the columns of a features table."""
    not_self = lambda c: F.filter(c, lambda v: ~v.isin("this", "super"))
    one = lambda c: F.array_compact(F.array(F.col(c)))
    names = F.create_map(*[x for k, v in OBSERVED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return {
        "receivers": not_self(strings(F.concat(one("receiver"), one("receiverType")))),
        "inputs": not_self(strings(F.col("inputIdentifiers"))),
        "arguments": F.filter(strings(F.col("arguments")), lambda v: ~v.rlike(LITERAL)),
        "fields_read": strings(F.col("fieldsRead")),
        "fields_written": strings(F.col("fieldsWritten")),
        "domain_types": strings(F.col("domainTypes")),
        "method_terms": strings(F.col("methodTerms")),
        "output_types": strings(one("outputType")),
        "observed": F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.transform(F.coalesce("observedFeatures", F.array().cast("array<string>")), lambda v: F.try_element_at(names, v)))))),
    }


def overlap(a: Column, b: Column) -> Column:
    """Shared values over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def score(left: str, right: str, weights: dict[str, float] = WEIGHTS) -> tuple[Column, Column]:
    """(weighted mean of overlaps, sum of weights) over comparable dimensions of the structs ``left`` and ``right``.

    A dimension counts if values overlap, or both sides observed it fully and are not both empty.
    """
    tops, bottoms = [], []
    for name, weight in weights.items():
        a, b = F.col(f"{left}.{name}"), F.col(f"{right}.{name}")
        seen = F.array_contains(f"{left}.observed", name) & F.array_contains(f"{right}.observed", name)
        counts = F.arrays_overlap(a, b) | (seen & (F.size(a) + F.size(b) > 0))
        tops.append(F.when(counts, weight * overlap(a, b)).otherwise(0.0))
        bottoms.append(F.when(counts, weight).otherwise(0.0))
    top, bottom = reduce(add, tops), reduce(add, bottoms)
    return F.when(bottom > 0, top / bottom).otherwise(0.0), bottom


def missing(left: str, right: str) -> Column:
    """Identity dimensions that one side did not observe."""
    return F.array_compact(F.array(*(F.when(~(F.array_contains(f"{left}.observed", n) & F.array_contains(f"{right}.observed", n)), n) for n in IDENTITY)))


def disjoint(left: str, right: str) -> Column:
    """Identity fully observed on both sides, not empty, and without a shared value."""
    union = lambda side: F.array_distinct(F.concat(*(F.col(f"{side}.{n}") for n in IDENTITY)))
    a, b = union(left), union(right)
    return (F.size(missing(left, right)) == 0) & (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def verdict(left: str, right: str, *, direct_flow: Column | None = None, threshold: float = 0.5, weights: dict[str, float] = WEIGHTS) -> Column:
    """``struct<verdict, confidence, missing>`` of two neighbours; ``direct_flow`` adds dependence (operation to operation)."""
    value, bottom = score(left, right, weights)
    none = F.array().cast("array<string>")
    say = lambda v, c, m=none: F.struct(F.lit(v).alias("verdict"), c.alias("confidence"), m.alias("missing"))
    context = F.when(disjoint(left, right), say("UNRELATED", F.lit(1.0))).when((bottom > 0) & (value >= threshold), say("RELATED", value)).otherwise(say("UNKNOWN", value, missing(left, right)))
    if direct_flow is None:
        return context
    depends = direct_flow | F.arrays_overlap(f"{left}.fields_written", f"{right}.fields_read")
    return F.when(depends, say("RELATED", F.lit(1.0))).otherwise(context)


def judge(a: dict[str, set], b: dict[str, set], *, threshold: float = 0.5) -> tuple[str, float, list[str]]:
    """``verdict`` about two signatures as sets, for folds inside tasks: the same sums in the same order."""
    absent = [n for n in IDENTITY if n not in a["observed"] or n not in b["observed"]]
    one, other = (set().union(*(s[n] for n in IDENTITY)) for s in (a, b))
    if not absent and one and other and not one & other:
        return "UNRELATED", 1.0, []
    top = bottom = 0.0
    for name, weight in WEIGHTS.items():
        shared, least = len(a[name] & b[name]), min(len(a[name]), len(b[name]))
        if shared or ((a[name] or b[name]) and name in a["observed"] and name in b["observed"]):
            top += weight * (shared / least if least else 0.0)
            bottom += weight
    value = top / bottom if bottom else 0.0
    return ("RELATED", value, []) if bottom and value >= threshold else ("UNKNOWN", value, absent)
