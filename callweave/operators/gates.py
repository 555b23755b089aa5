"""Gates between phases: questions, answers, neighbours of retained calls, and phases that share a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.functions.signature import DIMENSIONS
from callweave.operators.graph import components
from callweave.operators.phases import core_signature, tagged
from callweave.session import materialize

DISJOINT = "complete-core-identity-disjoint"


def _open(gates: DataFrame, members: DataFrame) -> DataFrame:
    """Gates whose ends are in different phases of their method, with ``left`` and ``right``."""
    side = lambda s: members.select("method", F.col("id").alias(f"{s}_id"), F.col("phase").alias(s))
    return gates.join(side("left"), ["method", "left_id"]).join(side("right"), ["method", "right_id"]).where(F.col("left") != F.col("right"))


def gate_questions(gates: DataFrame, members: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row per gate that still separates two phases.

    ``gates(method, gate, left_id, right_id, evidence)``, ``members(method, phase, id, seq, callee, code)``,
    ``signatures(id, observed, …dimensions)``. Columns: ``question``, ``reason`` (CONFLICTING_EVIDENCE if disjoint
    identities stand beside other evidence), and for each side the core signature as ``dimension:value``, the
    operations in order and the dimensions that were not observed.
    """
    key = F.struct("method", "phase")
    values = F.flatten(F.array(*map(tagged, (*DIMENSIONS, "observed"))))
    signed = members.select(key.alias("key"), "id").join(signatures.select("id", values.alias("values")), "id", "left")
    core = core_signature(signed.select("key", F.coalesce("values", F.array().cast("array<string>")).alias("values")), by="key", values="values")
    does = members.groupBy(key.alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "callee", "code"))), lambda x: F.struct(x["callee"].alias("callee"), x["code"].alias("code"))).alias("operations"))
    seen = F.transform(F.filter("core", lambda v: v.startswith("observed:")), lambda v: F.substr(v, F.lit(len("observed:") + 1)))
    told = core.join(does, "key").select("key", F.filter("core", lambda v: ~v.startswith("observed:")).alias("signature"), "operations", F.array_sort(F.array_except(F.array(*map(F.lit, DIMENSIONS)), seen)).alias("missing"))
    found = _open(gates, members)
    for s in ("left", "right"):
        named = told.select(F.col("key.method").alias("method"), F.col("key.phase").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("signature", "operations", "missing")))
        found = found.join(named, ["method", s])
    clash = F.array_contains("evidence", DISJOINT) & (F.size(F.array_remove("evidence", DISJOINT)) > 0)
    reason = F.when(clash, "CONFLICTING_EVIDENCE").otherwise("INSUFFICIENT_EVIDENCE")
    return found.withColumns({"question": F.concat_ws(":", F.lit("question"), "method", "gate"), "reason": reason})


def resolve_gates(members: DataFrame, gates: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, gates, decisions)`` after ``answers(method, gate, action, confidence, evidence)``.

    ``members(method, phase, at, id, seq)``: ``at`` is the phase's place in the method, ``seq`` the call's place in
    the phase. An answer counts if it says MERGE or SPLIT and has a confidence and evidence; it is held against
    the phases as earlier answers left them, in the order of ``gates.pos``. A confidence lies in [0, 1]; several
    answers about one gate void each other, whatever they say. MERGE gives both phases the left
    one's id and the earlier place, the right one's calls behind the left one's. Gates that no longer
    separate phases go without a decision. Round r takes the r-th answer of all methods at once.
    """
    once = answers.groupBy("method", "gate").count().where("count = 1").select("method", "gate")
    valid = answers.where("action in ('MERGE', 'SPLIT') and confidence between 0 and 1 and evidence is not null").join(once, ["method", "gate"])
    asked = _open(gates, members).select("method", "gate", "left_id", "right_id", "pos")
    asked = asked.join(valid, ["method", "gate"]).withColumn("round", F.row_number().over(W.partitionBy("method").orderBy("pos", "gate")))
    asked, now, log, done = materialize(asked), members, None, 0
    rounds = asked.agg(F.max("round")).first()[0] or 0
    while done < rounds:
        done += 1
        live = materialize(_open(asked.where(F.col("round") == done), now))
        log = live if log is None else log.unionByName(live)
        size = now.groupBy("method", F.col("phase").alias("left")).agg((F.max("seq") + 1).alias("shift"), F.min("at").alias("at_left"))
        ends = now.groupBy("method", F.col("phase").alias("right")).agg(F.min("at").alias("at_right"))
        merge = live.where("action = 'MERGE'").join(size, ["method", "left"]).join(ends, ["method", "right"])
        into = merge.select("method", "left", "right", "shift", F.least("at_left", "at_right").alias("to"))
        moved = now.join(into, "method", "left")
        right, either = F.col("phase") == F.col("right"), (F.col("phase") == F.col("right")) | (F.col("phase") == F.col("left"))
        now = materialize(moved.select("method", F.when(right, F.col("left")).otherwise(F.col("phase")).alias("phase"), F.when(either, F.col("to")).otherwise(F.col("at")).alias("at"), "id", F.when(right, F.col("seq") + F.col("shift")).otherwise(F.col("seq")).alias("seq")))
    if log is None:
        log = _open(asked, now)
    return now, gates.join(asked.select("method", "gate"), ["method", "gate"], "left_anti"), log.select("method", "gate", "left_id", "right_id", "action", "confidence", "evidence", "round")


def retained_frontiers(items: DataFrame, retained: DataFrame) -> DataFrame:
    """``(method, id, before, after)``: the calls next to each retained one.

    ``items(method, container, ordinal, kind, key, members, entry, exit)`` are the siblings of every container with
    their frontiers (null or empty: none), ``retained(method, id)``. Inside of the run its neighbours count;
    where there is none, the nearest sibling with a frontier, first in its own container, then further out.
    """
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    order = W.partitionBy("method", "container").orderBy("ordinal")
    near = items.withColumns({"__before": F.last(some("exit"), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), "__after": F.first(some("entry"), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))})
    own = items.where("kind = 'run'").select("method", "container", "key", "members", F.posexplode("members").alias("i", "id")).join(retained.select("method", "id"), ["method", "id"], "left_semi")
    beside = lambda i: F.when(F.get("members", i).isNotNull(), F.array(F.get("members", i)))
    own = own.withColumns({"l": beside(F.col("i") - 1), "r": beside(F.col("i") + 1), "depth": F.explode(F.sequence(F.lit(0), F.size("container")))})
    within = F.col("depth") == F.size("container")
    kind, at = F.when(within, "run").otherwise("branch"), F.when(within, F.col("key")).otherwise(F.get("container", F.col("depth"))["groupId"])
    level = own.select("method", "id", "l", "r", "depth", F.slice("container", F.lit(1), F.col("depth")).alias("container"), kind.alias("kind"), at.alias("key"))
    seen = level.join(near.select("method", "container", "kind", "key", "__before", "__after"), ["method", "container", "kind", "key"], "left")
    deepest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("depth")))
    found = seen.groupBy("method", "id", "l", "r").agg(deepest("__before").alias("b"), deepest("__after").alias("a"))
    none = F.array().cast(dict(items.dtypes)["members"])
    return found.select("method", "id", F.coalesce("l", "b", none).alias("before"), F.coalesce("r", "a", none).alias("after"))


def delegation_groups(phases: DataFrame, calls: DataFrame, counts: DataFrame) -> DataFrame:
    """``(item, phase_id)``: phases that share a label, numbered ``item-n`` by the group's smallest phase id.

    ``phases(phase_id, method, ids)``, ``calls(id, target, retained)``, ``counts(method, count)``. A phase of one call
    that is not retained and has a single target, whose effective and local count is one, belongs with that
    target's phase, transitively. All other phases are groups of their own.
    """
    single = phases.where(F.size("ids") == 1).select("phase_id", F.get("ids", F.lit(0)).alias("id"))
    only = calls.groupBy("id").agg(F.count_distinct("target").alias("n"), F.max("target").alias("target"), F.max("retained").alias("kept")).where("n = 1 and not kept")
    local = phases.groupBy("method").agg(F.count("*").alias("n"), F.max("phase_id").alias("dst")).where("n = 1")
    simple = local.join(counts.where("count = 1").select("method"), "method", "left_semi").select(F.col("method").alias("target"), "dst")
    edges = single.join(only, "id").join(simple, "target").select(F.col("phase_id").alias("src"), "dst")
    named = phases.select("phase_id").join(components(edges).withColumnRenamed("id", "phase_id"), "phase_id", "left").select("phase_id", F.coalesce("root", "phase_id").alias("root"))
    return number(named, "root", "item").select(F.concat(F.lit("item-"), F.col("item").cast("string")).alias("item"), "phase_id")


def number(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with the dense rank of ``by`` over the whole table, from 1, without one task that sees all of it.

    Distinct values are split by range; ranks inside a part are shifted by the sizes of the parts before, a table
    with a row for each shuffle partition.
    """
    parts = materialize(rows.select(by).distinct().repartitionByRange(by).select(by, F.spark_partition_id().alias("__part")))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    rank = F.row_number().over(W.partitionBy("__part").orderBy(by))
    ranked = parts.withColumn("__at", rank).join(F.broadcast(before), "__part").select(by, (F.col("__before") + F.col("__at")).alias(name))
    return rows.join(ranked, by)


def attach_labels(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """``(phase_id, label)`` from ``groups(item, phase_id)`` and ``labels(item, label)``; without a label: null."""
    return groups.join(labels, "item", "left").select("phase_id", "label")


def phase_evidence(groups: DataFrame, details: DataFrame, detail: Column) -> DataFrame:
    """``(item, evidence)``: for every group an array of ``detail`` of its phases, by phase id."""
    told = groups.join(details, "phase_id").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("phase_id", detail.alias("detail")))).alias("e"))
    return told.select("item", F.transform("e", lambda x: x["detail"]).alias("evidence"))
