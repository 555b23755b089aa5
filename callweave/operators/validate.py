"""Structural checks; each gives violations ``(check, key, detail)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _said(check: str, key: str, detail: str) -> list:
    return [F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), F.col(detail).cast("string").alias("detail")]


def duplicate_ids(rows: DataFrame, what: str) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(*_said(f"duplicate-{what}", "id", "n"))


def shared_ids(branches: DataFrame, loops: DataFrame) -> DataFrame:
    return branches.select("id").join(loops.select("id"), "id", "left_semi").distinct().select(*_said("branch-and-loop", "id", "id"))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source or target is no node."""
    ids = nodes.select("id").distinct()
    one = lambda side: edges.join(ids.select(F.col("id").alias(side)), side, "left_anti").select(*_said(f"dangling-{side}", side, "dst" if side == "src" else "src"))
    return one("src").unionByName(one("dst"))


def unknown_memberships(nodes: DataFrame, arms: DataFrame, loops: DataFrame) -> DataFrame:
    """Memberships of unknown branch arms ``(groupId, armLabel)`` or loops ``(id)``."""
    held = nodes.select("id", F.explode("branchArms").alias("a")).select("id", "a.groupId", "a.armLabel")
    a = held.join(arms, ["groupId", "armLabel"], "left_anti").select(*_said("unknown-arm", "id", "groupId"))
    b = nodes.select("id", F.explode("loopIds").alias("loop")).join(loops.select(F.col("id").alias("loop")), "loop", "left_anti").select(*_said("unknown-loop", "id", "loop"))
    return a.unionByName(b)


def bad_guards(edges: DataFrame, arms: DataFrame) -> DataFrame:
    """Guards of unknown arms, and edges that demand two arms of one group."""
    each = edges.select("src", "dst", F.explode("reqs").alias("r")).select("src", "dst", "r.groupId", "r.armLabel")
    unknown = each.join(arms, ["groupId", "armLabel"], "left_anti").select(*_said("unknown-guard", "src", "groupId"))
    two = edges.where(F.size(F.array_distinct(F.transform("reqs", lambda r: r["groupId"]))) < F.size(F.array_distinct("reqs"))).select(*_said("two-arms", "src", "dst"))
    return unknown.unionByName(two)


def missing_routes(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """Anchors ``(id)`` without an edge into or out of them."""
    no_in = anchors.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select(*_said("no-way-in", "id", "id"))
    return no_in.unionByName(anchors.join(edges.select(F.col("src").alias("id")), "id", "left_anti").select(*_said("no-way-out", "id", "id")))


def unrequested_pairs(found: DataFrame, asked: DataFrame) -> DataFrame:
    return found.join(asked, ["src", "dst"], "left_anti").select(*_said("unrequested", "src", "dst"))


def bad_anchors(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anchors that are missing or no structure node of their group and role, groups that lack an entry or a decision.

    ``groups(id, kind, entryNodeId, exitNodeId, decisions)``, kind branch or loop. A branch may lack an exit and must have a decision, a loop needs both ends.
    """
    place = nodes.select(F.col("id").alias("node"), "type", "structureGroupId", "structureRole")
    end = lambda role, column: groups.select("id", "kind", F.lit(role).alias("role"), F.col(column).alias("node"))
    asked = end("entry", "entryNodeId").unionByName(end("exit", "exitNodeId").where("kind = 'loop' or node is not null"))
    stages = groups.where("kind = 'branch'").select("id", "kind", F.lit("decision").alias("role"), F.explode("decisions").alias("node")).where("node is not null").distinct()
    told = asked.unionByName(stages).join(place, "node", "left")
    fine = (F.col("type") == "structure") & (F.col("structureGroupId") == F.col("id")) & (F.col("structureRole") == F.col("role"))
    wrong = told.where(~F.coalesce(fine, F.lit(False))).withColumn("check", F.concat(F.lit("bad-"), "role")).select("check", F.col("id").cast("string").alias("key"), F.col("node").cast("string").alias("detail"))
    decided = nodes.where("type = 'structure' and structureRole = 'decision'").select(F.col("structureGroupId").alias("id"))
    none = groups.where("kind = 'branch'").join(decided, "id", "left_anti").select(*_said("no-decision", "id", "kind"))
    return wrong.unionByName(none)


def bad_enclosures(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Branches ``(id, entryNodeId, enclosing)`` whose enclosure isn't what the memberships of their entry say, their own aside."""
    held = nodes.select(F.col("id").alias("entryNodeId"), "branchArms")
    told = groups.join(held, "entryNodeId").withColumn("held", F.filter("branchArms", lambda a: a["groupId"] != F.col("id")))
    same = (F.size(F.array_except("held", "enclosing")) == 0) & (F.size(F.array_except("enclosing", "held")) == 0)
    return told.where(~same).select(*_said("bad-enclosure", "id", "entryNodeId"))


def bad_exits(arms: DataFrame, exits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arms ``(groupId, armLabel)`` without an exit, exits ``(groupId, armLabel, kind, destination)`` to unknown nodes, and continuing ones without a destination."""
    none = arms.join(exits, ["groupId", "armLabel"], "left_anti").select(*_said("no-exit", "groupId", "armLabel"))
    aims = exits.where("destination is not null").join(nodes.select(F.col("id").alias("destination")), "destination", "left_anti").select(*_said("exit-to-unknown", "groupId", "destination"))
    open_ = exits.where("destination is null and kind in ('continues', 'break', 'continue')").select(*_said("exit-to-nothing", "groupId", "kind"))
    return none.unionByName(aims).unionByName(open_)


def bad_definitions(methods: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods ``(entryId, fullName)`` whose entry is missing or of another type or name; nodes that repeat an entry as body;
    local edges that are no sequence edges, outbound ones that are no invoke edges. ``nodes(id, owner_entry_id, type, calleeFullName, body)``, ``edges(src, dst, type, local)``."""
    entry = nodes.where("not body").select(F.col("id").alias("entryId"), "type", "calleeFullName")
    told = methods.join(entry, "entryId", "left")
    wrong = told.where("type is null or type <> 'entry'").select(*_said("bad-entry", "entryId", "type"))
    named = told.where("type = 'entry' and not (calleeFullName <=> fullName)").select(*_said("other-name", "entryId", "calleeFullName"))
    twice = nodes.where("body").join(methods.select(F.col("entryId").alias("id")), "id", "left_semi").select(*_said("entry-in-body", "id", "owner_entry_id"))
    local = edges.where("local and type <> 'sequence'").select(*_said("local-not-sequence", "src", "type"))
    out = edges.where("not local and type <> 'invoke'").select(*_said("outbound-not-invoke", "src", "type"))
    return wrong.unionByName(named).unionByName(twice).unionByName(local).unionByName(out)


def unselected_arms(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sequence edges ``(src, dst, reqs)`` into content whose arms they don't select, unless their source lies in the same arm."""
    side = lambda end: nodes.select(F.col("id").alias(end), F.col("branchArms").alias(f"of_{end}"))
    told = edges.join(side("src"), "src").join(side("dst"), "dst")
    return told.where(F.size(F.array_except(F.array_except("of_dst", "of_src"), "reqs")) > 0).select(*_said("arm-not-selected", "src", "dst"))


def unfit_roots(roots: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Roots ``(id, fullName)`` whose method has no call, and roots without a name in ``names(id)``."""
    calls = nodes.where("type = 'call'").select(F.col("callerMethod").alias("fullName"))
    empty = roots.join(calls, "fullName", "left_anti").select(*_said("no-body", "id", "fullName"))
    return empty.unionByName(roots.join(names.select("id"), "id", "left_anti").select(*_said("no-name", "id", "fullName")))
