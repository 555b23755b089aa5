"""Instances of methods: the bodies of chosen calls expanded along the active path, as frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.session import Rounds, materialize


def instantiate(
    roots: DataFrame, nodes: DataFrame, edges: DataFrame, calls: DataFrame, *, expanded: DataFrame | None = None, chosen: DataFrame | None = None, max_depth: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(id, instance, method, node, depth, expandable, expanded, cut)`` and ``(src, dst, type)`` of all visible instances.

    ``roots(method)`` are instances of their own; ``nodes(method, node)``, ``edges(method, src, dst)``, ``calls(method, call, pos,
    target)``: the targets of a call in order, by the entry nodes of their methods, which bear the methods' names.
    A call is expanded if ``expanded(instance, call)`` names it (none: all are) into the target that
    ``chosen(instance, call, target)`` names, else its first; an instance is called by its path, ``instance/call/pos:target``.
    A target that is active on the path is not entered again; where all targets are, the call is ``cut``. The
    caller's own edges stay as they are; an invoke edge leads from the call to the entry of its target's instance.
    Every round is a level of all instances; ``max_depth`` ends it (none: paths end, as no method repeats on one).
    """
    frontier = materialize(roots.select(F.col("method").alias("instance"), "method", F.lit(0).alias("depth"), F.array("method").alias("active")).distinct())
    levels, told = Rounds(frontier), Rounds()
    while not frontier.isEmpty():
        met = frontier.join(calls.select("method", "call", "pos", "target"), "method").withColumn("again", F.array_contains("active", F.col("target")))
        if chosen is None:
            met = met.withColumn("asked", F.lit(None).cast("boolean"))
        else:
            met = met.join(chosen.select("instance", "call", "target", F.lit(True).alias("asked")).distinct(), ["instance", "call", "target"], "left")
        if expanded is None:
            met = met.withColumn("open", F.lit(True))
        else:
            met = met.join(expanded.select("instance", "call", F.lit(True).alias("open")).distinct(), ["instance", "call"], "left").fillna(False, ["open"])
        of_call = W.partitionBy("instance", "call")
        picked = met.withColumn("rank", F.row_number().over(of_call.orderBy(F.col("asked").isNull(), "pos", "target"))).withColumn("cut", F.min("again").over(of_call)).where("rank = 1")
        # One row a call of a visible instance: what it leads to, if anything.
        row = told.add(picked.select("instance", "call", "depth", "active", "open", "cut", F.when(F.col("open") & ~F.col("again"), F.col("target")).alias("target"), F.concat_ws("/", "instance", "call", F.concat_ws(":", "pos", "target")).alias("child")))
        if max_depth is not None:
            row = row.where(F.col("depth") < max_depth)
        frontier = levels.add(row.where("target is not null").select(F.col("child").alias("instance"), F.col("target").alias("method"), (F.col("depth") + 1).alias("depth"), F.concat("active", F.array("target")).alias("active")))
    instances, leads = levels.all().select("instance", "method", "depth"), told.all()
    name = lambda node, at="instance": F.concat_ws("#", at, node)
    made = instances.join(nodes.select("method", "node"), "method").join(leads.select("instance", F.col("call").alias("node"), "open", "cut"), ["instance", "node"], "left")
    visible = made.select(name("node").alias("id"), "instance", "method", "node", "depth", F.col("open").isNotNull().alias("expandable"), F.coalesce("open", F.lit(False)).alias("expanded"), F.coalesce("cut", F.lit(False)).alias("cut"))
    own = instances.join(edges.select("method", "src", "dst"), "method").select(name("src").alias("src"), name("dst").alias("dst"), F.lit("sequence").alias("type"))
    entered = leads.join(instances.select(F.col("instance").alias("child")), "child", "left_semi")
    return visible, own.unionByName(entered.select(name("call").alias("src"), name("target", "child").alias("dst"), F.lit("invoke").alias("type")))
