"""Branch groups: their metadata after filtering, guards of edges, and the nesting of calls in arms as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.functions.guards import merge, no_guards
from callweave.operators.graph import clean_graph, reach


def refresh_branches(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``groups(id, arms, enclosing)`` after filtering to ``nodes(id, type, branchArms)``.

    An arm is empty if no call is left in it; exits into vanished nodes lose their destination; enclosures of
    vanished groups go. Other fields of arms and exits stay, and so do the arms' positions.
    """
    calls = nodes.where("type = 'call'").select(F.explode("branchArms").alias("a"))
    calls = calls.select(F.col("a.groupId").alias("id"), F.col("a.armLabel").alias("label"), F.lit(True).alias("full")).distinct()
    arms = groups.select("id", F.posexplode("arms").alias("i", "arm")).withColumn("label", F.col("arm.label"))
    ends = arms.select("id", "i", F.explode("arm.exits").alias("exit")).select("id", "i", F.col("exit.destinationNodeId").alias("node")).where("node is not null").distinct()
    gone = ends.join(nodes.select(F.col("id").alias("node")), "node", "left_anti").groupBy("id", "i").agg(F.collect_set("node").alias("gone"))
    keep = lambda x: F.when(~F.coalesce(F.array_contains("gone", x["destinationNodeId"]), F.lit(False)), x["destinationNodeId"])
    exits = F.transform("arm.exits", lambda x: x.withField("destinationNodeId", keep(x)))
    done = arms.join(calls, ["id", "label"], "left").join(gone, ["id", "i"], "left")
    done = done.select("id", "i", F.col("arm").withField("empty", F.col("full").isNull()).withField("exits", exits).alias("arm"))
    nested = done.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "arm"))), lambda x: x["arm"]).alias("__arms"))
    outer = groups.select("id", F.explode("enclosing").alias("r")).select("id", F.col("r.groupId").alias("g"))
    lost = outer.join(groups.select(F.col("id").alias("g")), "g", "left_anti").groupBy("id").agg(F.collect_set("g").alias("__lost"))
    found = groups.join(nested, "id", "left").join(lost, "id", "left")
    held = F.filter("enclosing", lambda r: ~F.coalesce(F.array_contains("__lost", r["groupId"]), F.lit(False)))
    return found.withColumns({"arms": F.coalesce("__arms", "arms"), "enclosing": held}).select(*groups.columns)


def clean_branches(nodes: DataFrame, edges: DataFrame, groups: DataFrame, loops: DataFrame, exits: DataFrame, *, noise: Column, is_lambda: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``clean_graph`` and, in the same pass, the metadata of the branch groups that stay: ``(nodes, edges, groups, loops)``.

    ``groups(id, entryNodeId, arms, enclosing, …)``; their arms lose exits to nodes that are gone and are empty once
    no call is left in them.
    """
    nodes, edges, stay = clean_graph(nodes, edges, groups, loops, exits, noise=noise, is_lambda=is_lambda)
    return nodes, edges, refresh_branches(groups.join(stay, "id", "left_semi"), nodes), loops.join(stay, "id", "left_semi")


def derive_guards(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst, type, reqs)`` from ``edges(src, dst, type, alternatives)`` and ``nodes(id, branchArms)``.

    Guards are the source's memberships, then those that the target adds, then the facts of a route. Each
    alternative is an edge of its own; edges that need two arms of a group are impossible and go; equal edges
    are one. An edge without alternatives has one without facts; unknown nodes have no memberships.
    """
    side = lambda end: nodes.select(F.col("id").alias(end), F.col("branchArms").alias(f"of_{end}"))
    each = edges.select("src", "dst", "type", F.explode_outer("alternatives").alias("facts"))
    each = each.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    a, b, facts = (F.coalesce(c, no_guards()) for c in ("of_src", "of_dst", "facts"))
    return each.select("src", "dst", "type", merge(merge(a, F.array_except(b, a)), facts).alias("reqs")).where("reqs is not null").distinct()


def _container(depth: Column) -> Column:
    return F.slice("arm_path", F.lit(1), depth)


def nest_structure(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(items, arms)`` of all methods from ``calls(method, id, rank, run, arm_path, eligible)``, nested by arm path.

    Items ``(method, container, ordinal, kind, key, members, first)`` are the siblings of a container (a path of
    arms, empty for the method) in the order of their first eligible call: runs of eligible calls that lie
    directly in it, and branch groups with an eligible call below. Arms ``(method, container, key, arm,
    ordinal, empty)`` are those groups' arms in the order of their first call, empty if only excluded calls
    are below.
    """
    below = calls.where(F.size("arm_path") > 0).withColumn("d", F.explode(F.sequence(F.lit(0), F.size("arm_path") - 1)))
    below = below.select("method", _container(F.col("d")).alias("container"), F.get("arm_path", F.col("d")).alias("at"), "rank", "eligible")
    below = below.select("method", "container", F.col("at.groupId").alias("key"), F.col("at.armLabel").alias("arm"), "rank", "eligible")
    arms = below.groupBy("method", "container", "key", "arm").agg(F.min("rank").alias("first"), F.min(F.when(F.col("eligible"), F.col("rank"))).alias("call"))
    groups = arms.groupBy("method", "container", "key").agg(F.min("call").alias("first")).where("first is not null")
    runs = calls.where("eligible").groupBy("method", F.col("arm_path").alias("container"), F.col("run").cast("string").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("members"), F.min("rank").alias("first"))
    empty = F.array().cast(dict(runs.dtypes)["members"])
    items = runs.withColumn("kind", F.lit("run")).unionByName(groups.withColumns({"kind": F.lit("branch"), "members": empty}))
    place = F.row_number().over(W.partitionBy("method", "container").orderBy("first", "kind", "key"))
    items = items.withColumn("ordinal", place).select("method", "container", "ordinal", "kind", "key", "members", "first")
    kept = arms.join(groups.select("method", "container", "key"), ["method", "container", "key"], "left_semi")
    arms = kept.withColumn("ordinal", F.row_number().over(W.partitionBy("method", "container", "key").orderBy("first", "arm")))
    return items, arms.select("method", "container", "key", "arm", "ordinal", F.col("call").isNull().alias("empty"))


def call_edges(calls: DataFrame, callees: DataFrame, methods: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, leaves)`` from ``calls(id)``, ``callees(id, target)``, ``methods(target, fullName, external, hasBody)``, ``refs(id, target)``.

    A call without a callee goes to a leaf of its own; an external callee is one shared leaf; a callee inside
    leads to its entry if it has a body. Method references (lambdas) lead to the entries of their methods.
    Edges are ``(src, dst, type)``, leaves ``(id, calleeFullName, reason)``; repeated rows count once.
    """
    known = calls.select("id").distinct().join(callees.select("id", "target").distinct(), "id", "left")
    told = known.join(methods, "target", "left").select("id", "target", "fullName", "external", F.coalesce("hasBody", F.lit(False)).alias("body"))
    nowhere = told.where("target is null").select("id", F.concat("id", F.lit("_unresolved")).alias("dst"))
    there = told.where("external or body").select("id", F.col("target").alias("dst"))
    direct = refs.select("id", F.col("target").alias("dst")).join(calls.select("id"), "id", "left_semi")
    edges = nowhere.unionByName(there).unionByName(direct).distinct().select(F.col("id").alias("src"), "dst", F.lit("invoke").alias("type"))
    leaves = nowhere.select(F.col("dst").alias("id"), F.lit(None).cast("string").alias("calleeFullName"), F.lit("unresolved").alias("reason"))
    outside = told.where("external").select(F.col("target").alias("id"), F.col("fullName").alias("calleeFullName"), F.lit(None).cast("string").alias("reason"))
    return edges, leaves.unionByName(outside.dropDuplicates(["id"]))


def retained_phase_keys(starts: DataFrame, phases: DataFrame, retained: DataFrame) -> DataFrame:
    """``(root, method, phase)``: phases of ``starts(method)`` and of all methods behind retained calls.

    ``phases(method, phase)``, ``retained(method, call, target, pos)``; a call leads to its first target. Methods
    on a cycle are entered once, as the phases are a set.
    """
    first = retained.groupBy("method", "call").agg(F.min_by("target", F.struct("pos", "target")).alias("dst"))
    seen = reach(first.select(F.col("method").alias("src"), "dst"), starts.select(F.col("method").alias("root"), F.col("method").alias("id")))
    return seen.select("root", F.col("id").alias("method")).join(phases.select("method", "phase").distinct(), "method").select("root", "method", "phase")
