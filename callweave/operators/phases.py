"""Phases: cut ordered calls by verdicts about neighbours, core signatures, effective counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.functions.signature import DIMENSIONS, verdict
from callweave.operators.graph import peel
from callweave.session import Rounds, materialize, release


def core_signature(rows: DataFrame, *, by: str, values: str) -> DataFrame:
    """``(by, core)``: values of at least max(2, half) of a region's operations; of a single one all."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    counts = rows.select(by, F.explode(F.array_distinct(values)).alias("value")).groupBy(by, "value").agg(F.count("*").alias("c")).join(sizes, by)
    least = F.when(F.col("n") == 1, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("n") / 2)))
    kept = counts.where(F.col("c") >= least).groupBy(by).agg(F.array_sort(F.collect_list("value")).alias("core"))
    return sizes.select(by).join(kept, by, "left").select(by, F.coalesce("core", F.array().cast("array<string>")).alias("core"))


def neighbours(calls: DataFrame, *, run: str = "run", pos: str = "pos") -> DataFrame:
    """Every call with the verdict about it and its predecessor in the run (null for the first). ``calls`` has the signature columns, ``flow`` and ``retained``."""
    sig = F.struct(*DIMENSIONS, "observed")
    order = W.partitionBy(run).orderBy(pos)
    pair = calls.withColumn("__b", sig).withColumn("__a", F.lag(sig).over(order)).withColumn("__p", F.lag("retained").over(order))
    told = verdict("__a", "__b", direct_flow=F.col("flow"))
    return pair.withColumn("told", F.when(F.col("__a").isNotNull() & ~F.col("retained") & ~F.col("__p"), told)).drop("__a", "__b", "__p")


def tagged(dimension: str) -> Column:
    """Values of a dimension with its name before them."""
    return F.transform(dimension, lambda v: F.concat(F.lit(f"{dimension}:"), v))


def segment_runs(calls: DataFrame, *, run: str = "run", pos: str = "pos", region: bool = True, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``(phases, gates)`` of all runs at once.

    A retained call ends a phase and is in none. RELATED joins a call to the phase before; UNKNOWN splits and
    leaves a gate; UNRELATED splits. With ``region``, a call joined by context is held against the core
    signature of its phase so far: UNRELATED there splits and leaves a gate. Vetoes are found in rounds, the
    earliest of every phase first, until there is none; all runs advance together.
    """
    told = materialize(neighbours(calls, run=run, pos=pos))
    order = W.partitionBy(run).orderBy(pos)
    cut = F.col("retained") | F.col("told").isNull() | (F.col("told.verdict") != "RELATED")
    now = materialize(told.withColumn("cut", cut.cast("int")).withColumn("veto", F.lit(False)))
    while True:
        seg = now.withColumn("phase", F.sum("cut").over(order))
        if not region:
            break
        seg = materialize(seg)
        live = seg.where("not retained").withColumn("at", F.row_number().over(W.partitionBy(run, "phase").orderBy(pos)))
        wide = live.select(run, pos, "phase", "at", F.explode(F.flatten(F.array(*map(tagged, (*DIMENSIONS, "observed"))))).alias("v"))
        seen = wide.withColumn("before", F.row_number().over(W.partitionBy(run, "phase", "v").orderBy(pos)))
        ends = live.where("told.verdict = 'RELATED' and told.confidence < 1.0").select(run, "phase", F.col("at").alias("end"), F.col(pos).alias("pos_end"))
        least = F.when(F.col("end") == 2, 1).otherwise(F.greatest(F.lit(2), F.ceil((F.col("end") - 1) / 2)))
        held = ends.join(seen.select(run, "phase", "at", "v", "before"), [run, "phase"]).where("at < end").groupBy(run, "phase", "end", "pos_end", "v").agg(F.max("before").alias("n")).where(F.col("n") >= least)
        pick = lambda d: F.transform(F.filter("vs", lambda v: v.startswith(d + ":")), lambda v: F.substr(v, F.lit(len(d) + 2))).alias(d)
        prefix = held.groupBy(run, "phase", "end", "pos_end").agg(F.collect_list("v").alias("vs")).select(run, "phase", F.col("pos_end").alias(pos), F.struct(*(pick(d) for d in DIMENSIONS), pick("observed")).alias("__a"))
        judged = prefix.join(seg.select(run, "phase", pos, F.struct(*DIMENSIONS, "observed").alias("__b")), [run, "phase", pos]).where(verdict("__a", "__b", threshold=threshold)["verdict"] == "UNRELATED")
        first = materialize(judged.groupBy(run, "phase").agg(F.min(pos).alias(pos)).select(run, pos, F.lit(True).alias("new")))
        if first.isEmpty():
            break
        now = materialize(seg.drop("phase").join(first, [run, pos], "left").withColumn("cut", F.when(F.col("new"), 1).otherwise(F.col("cut"))).withColumn("veto", F.col("veto") | F.coalesce("new", F.lit(False))).drop("new"))
    phases = seg.where("not retained").select(run, pos, "id", F.dense_rank().over(W.partitionBy(run).orderBy("phase")).alias("phase"))
    gates = now.where((F.col("told.verdict") == "UNKNOWN") | F.col("veto")).select(run, F.col("id").alias("right_id"), "told", "veto")
    return phases, gates


def effective_counts(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """``(method, count)`` bottom-up: own phases plus, for each call, the largest count of its targets; null on a cycle of calls and above
    one as far as retained calls lead there.

    ``methods(method, own)``, ``calls(method, call, target)``. A call is retained, and counts, if a target's count is over one or
    unknown. Rounds follow the depth of the call graph, then members of cycles are unknown and rounds go on. Targets that
    are no method add nothing.
    """
    inner = materialize(calls.join(methods.select(F.col("method").alias("target")), "target", "left_semi").select("method", "call", "target").distinct())
    left, done = materialize(methods.select("method", F.col("own").cast("long").alias("own"))), Rounds()
    while True:
        waiting = inner.join(done.all().select(F.col("method").alias("target")), "target", "left_anti") if done.tables else inner
        ready = left.join(waiting.select("method").distinct(), "method", "left_anti")
        if ready.isEmpty():
            if left.isEmpty():
                break
            # What is left is on cycles or above them: members of cycles are those that both directions of peeling leave.
            back = waiting.join(left.select("method"), "method", "left_semi").select(F.col("method").alias("src"), F.col("target").alias("dst"))
            below = peel(back).where("level is null").select("id")
            ring = below.join(peel(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("level is null").select("id"), "id", "left_semi")
            ready = left.join(ring.select(F.col("id").alias("method")), "method", "left_semi").withColumn("own", F.lit(None).cast("long"))
        known = done.all() if done.tables else left.select("method", F.col("own").alias("count")).limit(0)
        worst = inner.join(known.select(F.col("method").alias("target"), "count"), "target").groupBy("method", "call").agg(F.max("count").alias("c"), F.bool_or(F.col("count").isNull()).alias("unknown"))
        sums = worst.groupBy("method").agg(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("c"), F.bool_or("unknown").alias("unknown"))
        total = F.when(~F.coalesce("unknown", F.lit(False)), F.col("own") + F.coalesce("c", F.lit(0)))
        found = done.add(ready.join(sums, "method", "left").select("method", total.alias("count")))
        before, left = left, materialize(left.join(found.select("method"), "method", "left_anti"))
        release(before)
    return done.all() if done.tables else methods.select("method", F.lit(None).cast("long").alias("count"))


def excluded_operations(nodes: DataFrame, arm_exits: DataFrame) -> DataFrame:
    """Calls inside arms whose exits are all throws: ``(id, reason)``; those that build an exception are mechanics."""
    thrown = arm_exits.groupBy("groupId", "armLabel").agg(F.collect_set("kind").alias("kinds")).where(F.col("kinds") == F.array(F.lit("throw")))
    inside = nodes.where("type = 'call'").select("id", "calleeFullName", F.explode("branchArms").alias("a")).select("id", "calleeFullName", "a.groupId", "a.armLabel")
    found = inside.join(thrown, ["groupId", "armLabel"]).select("id", "calleeFullName").distinct()
    return found.select("id", F.when(F.col("calleeFullName").rlike(r"(Exception|Error|Throwable)\.<init>"), "exception-mechanic").otherwise("in-throwing-arm").alias("reason"))


def run_summary(phases: DataFrame, retained: DataFrame, gates: DataFrame, excluded: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row of counts: methods, phases and members of ``phases(method, phase, id)``, retained calls, open gates, excluded calls, merges and splits of ``decisions(action)``."""
    one = phases.agg(F.count_distinct("method").alias("methods"), F.count_distinct("method", "phase").alias("phases"), F.count("*").alias("members"))
    acts = decisions.agg(F.count_if(F.col("action") == "MERGE").alias("merges"), F.count_if(F.col("action") == "SPLIT").alias("splits"))
    sizes = [df.agg(F.count("*").alias(name)) for name, df in (("retained", retained), ("unresolved", gates), ("excluded", excluded))]
    for df in (*sizes, acts):
        one = one.crossJoin(df)  # single rows
    return one


def retained_calls(counts: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls ``(method, call, target)`` that are retained: a target's effective count is over one or unknown. ``counts(method, count)`` as of ``effective_counts``."""
    known = counts.select(F.col("method").alias("target"), F.col("count"), F.lit(True).alias("__known"))
    return calls.join(known, "target").where("count is null or count > 1").select("method", "call").distinct()
