"""Slices of a graph with all that belongs to them, and data flow sought from targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.graph import reach
from callweave.session import materialize


def slice_graph(nodes: DataFrame, edges: DataFrame, branches: DataFrame, loops: DataFrame, roots: DataFrame) -> dict[str, DataFrame]:
    """The slices of all ``roots(id)`` at once: ``nodes``, ``edges``, ``branches`` and ``loops``, each with ``root``.

    A slice holds what its root reaches over sequence and invoke edges, all edges inside, and the groups of its
    methods; groups that name no method belong to it if a node of it is tagged with them. ``nodes(id, type,
    calleeFullName, branchArms, loopIds)``, ``edges(src, dst, type, …)``, ``branches(id, method, …)``, ``loops(id,
    method, …)``. A root that is no entry node is an error. Repeated roots give one slice.
    """
    roots = roots.select("id").distinct()
    odd = roots.join(nodes.where("type = 'entry'"), "id", "left_anti").limit(5).collect()
    if odd:
        raise ValueError(f"roots must be entry nodes: {[r['id'] for r in odd]}")
    found = reach(edges.where("type in ('sequence', 'invoke')"), roots.select(F.col("id").alias("root"), "id"))
    held = materialize(found.select("root", "id").join(nodes, "id"))
    ids = held.select("root", "id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src").join(ids.withColumnRenamed("id", "dst"), ["root", "dst"], "left_semi")
    methods = held.where("type = 'entry'").select("root", F.col("calleeFullName").alias("method")).distinct()

    def groups(table: DataFrame, tags: DataFrame) -> DataFrame:
        own = table.where("method is not null").join(methods, "method")
        tagged = table.where("method is null").join(tags.distinct(), "id")
        return own.unionByName(tagged)

    arms = held.select("root", F.explode("branchArms").alias("a")).select("root", F.col("a.groupId").alias("id"))
    return {"nodes": held, "edges": inside, "branches": groups(branches, arms), "loops": groups(loops, held.select("root", F.explode("loopIds").alias("id")))}


def targeted_flow(edges: DataFrame, requested: DataFrame, retained: DataFrame, nodes: DataFrame, *, max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(src, dst)``, the ``requested(src, dst)`` pairs that data flow joins, and one row ``targets, missing, visited, most_visited``.

    From each target data edges ``(src, dst)`` are followed back for ``max_depth`` steps, through nodes that are not
    ``retained(id)``; a retained one ends the way and counts if it was asked for. Each node is visited once for a
    target, which counts itself. Targets that ``nodes(id)`` lack are missing and not sought from.
    """
    asked = materialize(requested.select("src", "dst").distinct())
    targets = asked.select(F.col("dst").alias("id")).distinct()
    known = materialize(targets.join(nodes.select("id"), "id", "left_semi"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = materialize(reach(back, known.select(F.col("id").alias("root"), "id"), max_depth=max_depth, stop=retained))
    met = seen.where("level > 0").join(retained.select("id"), "id", "left_semi").select(F.col("id").alias("src"), F.col("root").alias("dst"))
    visited = seen.groupBy("root").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("visited"), F.coalesce(F.max("n"), F.lit(0)).alias("most_visited"))
    counts = targets.agg(F.count("*").alias("targets")).crossJoin(targets.join(known, "id", "left_anti").agg(F.count("*").alias("missing")))
    return met.join(asked, ["src", "dst"], "left_semi"), counts.crossJoin(visited)
