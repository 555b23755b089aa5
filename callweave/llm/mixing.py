"""Mixing sources to target weights (operator 3): iterative proportional fitting.

Token weights are summed by cell (source, language, topic) with partial aggregation, raked to the target
marginals, and documents are sampled by the calibrated probability of their cell.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import free_name, table
from callweave.session import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Topic rules in order of precedence: name, strings and patterns of which the text in lower case holds one. A
#: pattern comes after strings that every match of it holds, which are cheap to look for.
TOPICS = (
    ("legal", ("license ", "licence ", "licensed ", "licenced ", "copyright", "all rights reserved"), ()),
    ("technical", ("password", "secret", "token", "api_key", "apikey", "http://", "https://"), ()),
    ("contact", ("@",), ((), "[0-9]{3}[- ][0-9]{3}")),
    ("tabular", (), (("| ", " |"), "[|] [^|]* [|]")),
)


def tokens_of(text: Column) -> Column:
    """Words of the text."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("double")


def topic_of(text: Column, tokens: Column) -> Column:
    """The first topic that the text, in lower case, holds a string or pattern of; otherwise prose by its number of words."""
    low = F.lower(text)
    found = F.when(tokens < 100, "brief").when(tokens < 600, "prose").otherwise("longform")
    for name, strings, pattern in reversed(TOPICS):
        tests = [low.contains(x) for x in strings]
        if pattern:
            tests.append(reduce(and_, [*(low.contains(x) for x in pattern[0]), low.rlike(pattern[1])]))
        found = F.when(reduce(or_, tests), name).otherwise(found)
    return found


def targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a marginal: the observed shares to ``power``, scaled to one."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = sums.agg(F.sum("tokens").alias("t"), F.sum(F.pow("tokens", F.lit(power))).alias("p"))
    return sums.crossJoin(F.broadcast(total)).select(dimension, (F.pow("tokens", F.lit(power)) / F.col("p")).alias("target"))


def _rake_local(cells: list, goals: dict[str, dict], rounds: int) -> np.ndarray:
    weight = np.array([c["tokens"] for c in cells])
    weight /= weight.sum()
    sides = []
    for d in DIMENSIONS:
        names: dict = {}
        code = np.array([names.setdefault(c[d], len(names)) for c in cells])
        sides.append((code, np.array([goals[d][k] for k in names])))
    for _ in range(rounds):
        for code, goal in sides:
            weight = weight * (goal / np.bincount(code, weights=weight))[code]
    return weight


def rake(cells: DataFrame, goals: dict[str, DataFrame], *, rounds: int = 12, driver_cells: int = 200_000) -> DataFrame:
    """``cells`` with ``weight``: their share of tokens raked to all marginals.

    Up to ``driver_cells`` cells (a few MB) are raked on the driver, more by joins; both do the same steps.
    """
    spark = cells.sparkSession
    kept = materialize(cells.where("tokens > 0"))
    n = kept.count()
    if n == 0:
        return kept.withColumn("weight", F.col("tokens"))
    if n <= driver_cells:
        rows = kept.collect()
        weight = _rake_local(rows, {d: {r[0]: r[1] for r in goals[d].collect()} for d in DIMENSIONS}, rounds)
        return spark.createDataFrame([(*r, float(w)) for r, w in zip(rows, weight)], kept.schema.add("weight", "double"))
    now = kept.crossJoin(F.broadcast(kept.agg(F.sum("tokens").alias("all")))).withColumn("weight", F.col("tokens") / F.col("all")).drop("all")
    for _ in range(rounds):
        for d in DIMENSIONS:
            ratio = now.groupBy(d).agg(F.sum("weight").alias("have")).join(goals[d], d).select(d, (F.col("target") / F.col("have")).alias("ratio"))
            now = now.join(ratio, d).withColumn("weight", F.col("weight") * F.col("ratio")).drop("ratio")
        now = materialize(now)
    return now.select(*kept.columns, "weight")


def mix(docs: DataFrame, *, power: float = 0.9, rounds: int = 12, seed: str = "mix", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Every document with ``topic``, ``tokens``, ``probability`` and ``sampled``; its columns ``carry`` (none: all) stay.

    One pass over the texts writes what is carried with topic and tokens; cells, weights and the draw read that. The
    cell of a document has its raked share over its present share as ratio; probabilities are ratios over
    the largest one, so that expected tokens follow the raked weights exactly. A document is sampled if the
    md5 of its id and the seed falls below its probability. Null source or language is a value of its own;
    null and wordless texts weigh nothing and are never sampled. Repeated rows are sampled alike. Where a column has
    one of the four names already, letter case aside, it stays and the new one gets ``_`` behind its name. An empty
    table gives no rows.
    """
    topic, tokens, chance, drawn = (free_name(docs, c) for c in ("topic", "tokens", "probability", "sampled"))
    own = docs.columns if carry is None else list(carry)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    column = lambda c: F.col(f"d.`{c}`")
    counted = docs.select(F.struct(*own).alias("d"), text.alias("text"), cell("source").alias("source"), cell("lang").alias("lang"), draw.alias("draw"), tokens_of(text).alias("tokens"))
    marked = materialize(counted.withColumn("topic", topic_of(F.col("text"), F.col("tokens"))).drop("text"))
    cells = materialize(marked.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    goals = {d: materialize(targets(cells, d, power)) for d in DIMENSIONS}
    raked = materialize(rake(cells, goals, rounds=rounds))
    total = F.broadcast(raked.agg(F.max(F.col("weight") / F.col("tokens")).alias("top")))
    share = raked.crossJoin(total).select(*DIMENSIONS, (F.col("weight") / F.col("tokens") / F.col("top")).alias("share"))
    found = marked.join(share, list(DIMENSIONS), "left").withColumn("share", F.when(F.col("tokens") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0))
    return found.select(*(column(c).alias(c) for c in own), F.col("topic").alias(topic), F.col("tokens").alias(tokens), F.col("share").alias(chance), (F.col("draw") < F.col("share")).alias(drawn))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``mix`` samples, with their own columns only."""
    return mix(docs, **options).where(F.col(free_name(docs, "sampled"))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over ``documents``. Wordless texts are never sampled; an empty table gives no rows."""
    carry = ("doc_id", "source", "lang")
    return mix(table(spark, sf_dir, "documents"), carry=carry).select(*carry, "topic", "tokens", F.round("probability", 9).alias("probability"), "sampled")
