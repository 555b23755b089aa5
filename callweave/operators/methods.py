"""Phase analysis of whole methods: runs cut to phases, phases merged across boundaries, methods bottom-up, retained calls put back.

Nested structures stay flat tables: a call has the path of its arms, an item (run or branch group) its container and
place. All methods of a level go through each step together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from callweave.functions.signature import DIMENSIONS, judge, verdict
from callweave.operators.branches import nest_structure
from callweave.operators.cycles import _folded
from callweave.operators.gates import gate_questions, resolve_gates, retained_frontiers
from callweave.operators.graph import peel, reach
from callweave.operators.phases import core_signature, effective_counts, segment_runs, tagged
from callweave.session import Rounds, materialize, release

#: Behind every place among siblings.
LAST = 1 << 30


def frontiers(items: DataFrame, arms: DataFrame) -> DataFrame:
    """``(method, container, key, kind, ordinal, side, place, id)``: the calls that an item exposes at its entry and its exit.

    A run exposes its first and last call; a branch what the first, or last, item of each arm exposes, arms in order. So a run's
    end is exposed by every item around it as far as all items between are first, or last, among their siblings.
    """
    last = items.groupBy("method", "container").agg(F.max("ordinal").alias("siblings"))
    placed = items.join(last, ["method", "container"]).select("method", "container", "kind", "key", "ordinal", (F.col("ordinal") == 1).alias("entry"), (F.col("ordinal") == F.col("siblings")).alias("exit"))
    runs = items.where("kind = 'run'").select("method", F.col("container").alias("path"), F.col("key").alias("run"), F.get("members", F.lit(0)).alias("first"), F.element_at("members", -1).alias("end"))
    runs = runs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("path"))))
    own = F.col("depth") == F.size("path")
    step = F.get("path", F.col("depth"))
    chain = runs.select("method", "path", "run", "first", "end", "depth", F.slice("path", F.lit(1), F.col("depth")).alias("container"), F.when(own, "run").otherwise("branch").alias("kind"), F.when(own, F.col("run")).otherwise(step["groupId"]).alias("key"), step["armLabel"].alias("arm"))
    chain = chain.join(placed, ["method", "container", "kind", "key"])
    order = arms.select("method", "container", "key", "arm", F.col("ordinal").alias("nth")).withColumn("kind", F.lit("branch"))
    chain = chain.join(order, ["method", "container", "kind", "key", "arm"], "left")
    deeper = W.partitionBy("method", "path", "run").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, -1)
    below = W.partitionBy("method", "path", "run").orderBy(F.desc("depth"))
    told = chain.withColumns({"in": F.coalesce(F.min("entry").over(deeper), F.lit(True)), "out": F.coalesce(F.min("exit").over(deeper), F.lit(True)), "place": F.reverse(F.collect_list(F.coalesce("nth", F.lit(0))).over(below))})
    side = lambda name, test, call: told.where(test).select("method", "container", "key", "kind", "ordinal", F.lit(name).alias("side"), "place", F.col(call).alias("id"))
    return side("entry", "in", "first").unionByName(side("exit", "out", "end"))


def places(items: DataFrame, arms: DataFrame) -> DataFrame:
    """``(method, container, at)``: the places of a container's branches and arms from the outside in."""
    steps = arms.join(items.where("kind = 'branch'").select("method", "container", "key", F.col("ordinal").alias("o")), ["method", "container", "key"]).select("method", "container", "key", "arm", "o", "ordinal")
    held = items.select("method", F.col("container").alias("path")).distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("path"))))
    inner = held.where(F.col("depth") < F.size("path")).withColumns({"container": F.slice("path", F.lit(1), F.col("depth")), "key": F.get("path", F.col("depth"))["groupId"], "arm": F.get("path", F.col("depth"))["armLabel"]})
    found = inner.join(steps, ["method", "container", "key", "arm"]).groupBy("method", "path").agg(F.array_sort(F.collect_list(F.struct("depth", "o", "ordinal"))).alias("s"))
    at = F.flatten(F.transform("s", lambda x: F.array(x["o"], x["ordinal"])))
    return held.select("method", "path").distinct().join(found.select("method", "path", at.alias("at")), ["method", "path"], "left").select("method", F.col("path").alias("container"), F.coalesce("at", F.array().cast("array<int>")).alias("at"))


def boundaries(items: DataFrame, arms: DataFrame) -> DataFrame:
    """``(method, rank, left_id, right_id)``: every exit of an item with every entry of the next one, in the order in which they are judged.

    Boundaries inside of arms come first, branch by branch and arm by arm, then those around them.
    """
    ends = materialize(frontiers(items, arms))
    left = ends.where("side = 'exit'").select("method", "container", "ordinal", F.col("place").alias("p"), F.col("id").alias("left_id"))
    right = ends.where("side = 'entry'").select("method", "container", (F.col("ordinal") - 1).alias("ordinal"), F.col("place").alias("q"), F.col("id").alias("right_id"))
    both = left.join(right, ["method", "container", "ordinal"]).join(places(items, arms), ["method", "container"])
    order = W.partitionBy("method").orderBy(F.concat("at", F.array(F.lit(LAST), F.col("ordinal"))), "p", "q", "left_id", "right_id")
    return both.select("method", F.row_number().over(order).alias("rank"), "left_id", "right_id")


def as_signature(core: Column) -> Column:
    """A signature struct from ``dimension:value`` strings."""
    pick = lambda d: F.transform(F.filter(core, lambda v: v.startswith(d + ":")), lambda v: F.substr(v, F.lit(len(d) + 2))).alias(d)
    return F.struct(*(pick(d) for d in (*DIMENSIONS, "observed")))


class _Phase:
    """A phase of a fold: its members, and how many of its signed calls have each value."""

    def __init__(self):
        self.rows, self.signed, self.counts, self.known = [], 0, Counter(), None

    def core(self) -> dict[str, set]:
        if self.known is None:
            least = 1 if self.signed == 1 else max(2, -(-self.signed // 2))
            self.known = {d: set() for d in (*DIMENSIONS, "observed")}
            for value, n in self.counts.items():
                if n >= least:
                    dimension, _, v = value.partition(":")
                    self.known[dimension].add(v)
        return self.known

    def take(self, other: _Phase) -> None:
        """The other phase's members behind the own ones, at the earlier place."""
        shift, at = max(r["seq"] for r in self.rows) + 1, min(r["at"] for r in self.rows + other.rows)
        for r in other.rows:
            r["seq"] += shift
        self.rows += other.rows
        for r in self.rows:
            r.update(phase=self.rows[0]["phase"], at=at)
        self.signed, self.counts, self.known = self.signed + other.signed, self.counts + other.counts, None


def _merged(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rules of ``merge_boundaries`` for whole methods, pair by pair: rows of members, and of gates with ``told``."""
    held: dict = {}
    for r in table.to_pylist():
        held.setdefault(r["method"], ([], []))[r["rank"] is not None].append(r)
    out = []
    for members, pairs in held.values():
        phases: dict = {}
        of: dict = {}
        for r in members:
            p = of[r["id"]] = phases.setdefault(r["phase"], _Phase())
            p.rows.append(r)
            p.signed += r["signed"]
            p.counts.update({v for v in r["values"] or () if v is not None})
        for r in sorted(pairs, key=lambda r: r["rank"]):
            left, right = of.get(r["left_id"]), of.get(r["right_id"])
            if left is None or right is None or left is right:
                continue
            told = ("RELATED", 1.0, []) if r["depends"] else judge(left.core(), right.core())
            if told[0] == "RELATED":
                left.take(right)
                of.update((x["id"], left) for x in right.rows)
            elif told[0] == "UNKNOWN":
                out.append(r | {"told": dict(zip(("verdict", "confidence", "missing"), told))})
        out += members
    return pa.Table.from_pylist(out, schema)


def merge_boundaries(members: DataFrame, pairs: DataFrame, signatures: DataFrame, flow: DataFrame, *, fold: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(members, gates)`` after the phases on both sides of every boundary are judged in the order of ``rank``.

    ``members(method, phase, at, id, seq)``, ``pairs(method, rank, left_id, right_id)``, ``signatures(id, …dimensions, observed)``,
    ``flow(src, dst)``. Direct flow between the two calls, or a field that one writes and the other reads, merges their phases;
    otherwise the core signatures of the phases decide: RELATED merges, UNKNOWN leaves a gate. The left phase keeps its name, the
    earlier place, and takes the right one's calls behind its own; ``gates(method, gate, left_id, right_id, told)``.

    Methods of up to ``fold`` members and pairs are folded whole in tasks that take about ``fold`` rows at once. The others take rounds:
    one judges, in all of them, every pair that comes first for both of its phases, as no pair before it can change them.
    """
    full = F.struct(*DIMENSIONS, "observed")
    side = lambda s: signatures.select(F.col("id").alias(f"{s}_id"), full.alias(f"__{s}"))
    direct = flow.select(F.col("src").alias("left_id"), F.col("dst").alias("right_id"), F.lit(True).alias("__flow")).distinct()
    asked = pairs.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left").join(direct, ["left_id", "right_id"], "left")
    writes = F.coalesce(F.arrays_overlap("__left.fields_written", "__right.fields_read"), F.lit(False))
    asked = asked.select("method", "rank", "left_id", "right_id", (F.coalesce("__flow", F.lit(False)) | writes).alias("depends"))
    tags = signatures.select("id", F.flatten(F.array(*map(tagged, (*DIMENSIONS, "observed")))).alias("values"))
    columns = ["method", "phase", "at", "id", "seq"]
    signed = members.select(*columns).join(tags.withColumn("signed", F.lit(True)), "id", "left").withColumn("signed", F.coalesce("signed", F.lit(False)))
    rows = materialize(signed.unionByName(asked, allowMissingColumns=True))
    sizes = materialize(rows.groupBy("method").agg(F.count("*").alias("n"), F.count("rank").alias("asked")).where("asked > 0 and asked < n"))
    kinds = dict(rows.dtypes) | {"told": "struct<verdict:string,confidence:double,missing:array<string>>"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*columns, "left_id", "right_id", "told"))
    shape = to_arrow_schema(StructType.fromDDL(schema))
    small = rows.join(sizes.where(F.col("n") <= fold).select("method"), "method", "left_semi")
    folded = materialize(_folded(small, "method", lambda table: _merged(table, shape), schema, fold))
    still = rows.where("rank is null").select(*columns).join(sizes.select("method"), "method", "left_anti").unionByName(folded.where("told is null").select(*columns))
    gate = F.concat(F.lit("region:"), "left_id", F.lit("-"), "right_id").alias("gate")
    found = folded.where("told is not null").select("method", gate, "left_id", "right_id", "told")
    large = sizes.where(F.col("n") > fold).select("method")
    if large.isEmpty():
        return still, found
    rest = materialize(rows.join(large, "method", "left_semi"))
    now, open_, gates = materialize(rest.where("rank is null").select(*columns)), materialize(rest.where("rank is not null").select(*asked.columns)), Rounds(found)
    while True:
        of = lambda s: now.select("method", F.col("id").alias(f"{s}_id"), F.col("phase").alias(s))
        live = materialize(open_.join(of("left"), ["method", "left_id"]).join(of("right"), ["method", "right_id"]).where(F.col("left") != F.col("right")))
        if live.isEmpty():
            break
        touched = live.select("method", F.col("left").alias("phase"), "rank").unionByName(live.select("method", F.col("right").alias("phase"), "rank")).groupBy("method", "phase").agg(F.min("rank").alias("rank"))
        first = lambda s: touched.select("method", F.col("phase").alias(s), "rank")
        ready = materialize(live.join(first("left"), ["method", "left", "rank"], "left_semi").join(first("right"), ["method", "right", "rank"], "left_semi"))
        concerned = ready.select("method", F.col("left").alias("phase")).unionByName(ready.select("method", F.col("right").alias("phase")))
        key = F.struct("method", "phase")
        core = core_signature(now.join(concerned, ["method", "phase"], "left_semi").join(tags, "id").select(key.alias("key"), "values"), by="key", values="values")
        signed = core.select("key.method", "key.phase", as_signature(F.col("core")).alias("sig"))
        none = F.struct(*(F.array().cast("array<string>").alias(d) for d in (*DIMENSIONS, "observed")))
        known = lambda s: signed.select("method", F.col("phase").alias(s), F.col("sig").alias(f"sig_{s}"))
        judged = ready.join(known("left"), ["method", "left"], "left").join(known("right"), ["method", "right"], "left")
        judged = judged.withColumns({"sig_left": F.coalesce("sig_left", none), "sig_right": F.coalesce("sig_right", none)}).withColumn("told", verdict("sig_left", "sig_right"))
        judged = materialize(judged.select("method", "rank", "left", "right", "left_id", "right_id", "depends", "told"))
        gates.add(judged.where("not depends and told.verdict = 'UNKNOWN'").select("method", gate, "left_id", "right_id", "told"))
        size = now.groupBy("method", F.col("phase").alias("left")).agg((F.max("seq") + 1).alias("shift"), F.min("at").alias("at_left"))
        end = now.groupBy("method", F.col("phase").alias("right")).agg(F.min("at").alias("at_right"))
        into = judged.where("depends or told.verdict = 'RELATED'").join(size, ["method", "left"]).join(end, ["method", "right"]).select("method", "left", "right", "shift", F.least("at_left", "at_right").alias("to"))
        moves = into.select("method", F.col("right").alias("phase"), "left", "shift", "to").unionByName(into.select("method", F.col("left").alias("phase"), "left", F.lit(0).alias("shift"), "to"))
        found = now.join(moves, ["method", "phase"], "left")
        after = materialize(found.select("method", F.coalesce("left", "phase").alias("phase"), F.coalesce("to", "at").alias("at"), "id", (F.col("seq") + F.coalesce("shift", F.lit(0))).alias("seq")))
        rest = materialize(live.join(judged.select("method", "rank"), ["method", "rank"], "left_anti").select(*open_.columns))
        release(now, open_, live, ready, judged)
        now, open_ = after, rest
    return still.unionByName(now), gates.all()


def analyse_methods(calls: DataFrame, signatures: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, gates)`` of all methods at once: runs are cut to phases, then phases merge across boundaries.

    ``calls(method, id, rank, run, arm_path, eligible, retained)``, ``signatures(id, …dimensions, observed)`` (none: nothing observed),
    ``flow(src, dst)``. ``members(method, phase, at, id, seq)``: a phase is named by its first call, ``at`` orders the phases of a method.
    Retained calls are in no phase. ``gates(method, gate, left_id, right_id)`` of runs and of boundaries.
    """
    items, arms = (materialize(df) for df in nest_structure(calls))
    runs = items.where("kind = 'run'").select("method", "container", "ordinal", F.posexplode("members").alias("pos", "id"))
    name = F.to_json(F.struct("method", "container", "ordinal"))
    order = W.partitionBy("run").orderBy("pos")
    rows = runs.withColumn("run", name).withColumn("before", F.lag("id").over(order))
    direct = flow.select(F.col("src").alias("before"), F.col("dst").alias("id"), F.lit(True).alias("flow")).distinct()
    rows = rows.join(direct, ["before", "id"], "left").join(calls.select("id", "retained"), "id").join(signatures, "id", "left")
    blank = F.array().cast("array<string>")
    rows = materialize(rows.withColumns({"flow": F.coalesce("flow", F.lit(False)), **{d: F.coalesce(d, blank) for d in (*DIMENSIONS, "observed")}}))
    cut, gates = segment_runs(rows)
    placed = cut.join(rows.select("run", "id", "method", "container", "ordinal"), ["run", "id"]).join(places(items, arms), ["method", "container"])
    groups = placed.groupBy("method", "run", "phase").agg(F.min_by("id", "pos").alias("name"), F.first(F.concat("at", F.array("ordinal"))).alias("at"))
    groups = groups.withColumn("nth", F.row_number().over(W.partitionBy("method").orderBy("at", "phase")))
    seq = F.row_number().over(W.partitionBy("run", "phase").orderBy("pos")) - 1
    members = placed.withColumn("seq", seq).select("method", "run", "phase", "id", "seq").join(groups.select("run", "phase", "name", "nth"), ["run", "phase"])
    members = members.select("method", F.col("name").alias("phase"), F.col("nth").alias("at"), "id", "seq")
    held = calls.where("retained").select("id")
    pairs = boundaries(items, arms)
    for side in ("left_id", "right_id"):
        pairs = pairs.join(held.withColumnRenamed("id", side), side, "left_anti")
    merged, across = merge_boundaries(members, materialize(pairs), signatures, flow)
    inside = gates.join(rows.select(F.col("id").alias("right_id"), "method", F.col("before").alias("left_id")), "right_id")
    inside = inside.select("method", F.concat_ws("-", "left_id", "right_id").alias("gate"), "left_id", "right_id")
    return merged, inside.unionByName(across.select("method", "gate", "left_id", "right_id"))


def analyse_bottom_up(calls: DataFrame, targets: DataFrame, signatures: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(members, gates, retained, counts)`` of all methods, callees before callers.

    ``calls`` as for ``analyse_methods`` without ``retained``, ``targets(id, target)`` the methods that a call leads to. A call is retained
    if the largest effective count of its targets is over one or a target's is unknown; the effective count of a method is its phases
    plus those counts of its retained calls. Members of cycles are judged together, with calls between them retained and their counts unknown.
    A round is a level of the call graph; targets without calls of their own count nothing.
    """
    known = calls.select("method").distinct()
    inner = materialize(targets.join(known.select(F.col("method").alias("target")), "target", "left_semi").join(calls.where("eligible").select("id", "method"), "id").select("method", "id", "target").distinct())
    left = materialize(known)
    members, gates, kept, counts = Rounds(), Rounds(), Rounds(), Rounds()
    while not left.isEmpty():
        waiting = inner.join(left.select(F.col("method").alias("target")), "target", "left_semi").join(left, "method", "left_semi")
        ready = left.join(waiting.select("method").distinct(), "method", "left_anti").withColumn("cyclic", F.lit(False))
        if ready.isEmpty():
            steps = materialize(waiting.select(F.col("method").alias("src"), F.col("target").alias("dst")).distinct())
            below = peel(steps).where("level is null").select("id")
            above = peel(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("level is null").select("id")
            ready = below.join(above, "id", "left_semi").select(F.col("id").alias("method")).withColumn("cyclic", F.lit(True))
        ready = materialize(ready)
        done = counts.all() if counts.tables else ready.select("method", F.lit(0).cast("long").alias("count")).limit(0)
        each = inner.join(ready.select("method"), "method", "left_semi").join(done.select(F.col("method").alias("target"), "count", F.lit(True).alias("__done")), "target", "left")
        worst = each.groupBy("method", "id").agg(F.max("count").alias("most"), F.bool_or(F.col("count").isNull()).alias("unknown"))
        retained = kept.add(worst.where("unknown or most > 1").select("method", "id", F.when(~F.col("unknown"), F.col("most")).alias("count")))
        marked = calls.join(ready.select("method"), "method", "left_semi").join(retained.select("id", F.lit(True).alias("retained")), "id", "left").withColumn("retained", F.coalesce("retained", F.lit(False)))
        found, asked = analyse_methods(materialize(marked), signatures, flow)
        found = members.add(found)
        gates.add(asked)
        own = found.groupBy("method").agg(F.count_distinct("phase").alias("own"))
        more = retained.groupBy("method").agg(F.sum("count").alias("more"), F.bool_or(F.col("count").isNull()).alias("unknown"))
        total = F.when(~F.col("cyclic") & ~F.coalesce("unknown", F.lit(False)), F.coalesce("own", F.lit(0)) + F.coalesce("more", F.lit(0)))
        counts.add(ready.join(own, "method", "left").join(more, "method", "left").select("method", total.cast("long").alias("count")))
        left = materialize(left.join(ready.select("method"), "method", "left_anti"))
    return members.all(), gates.all(), kept.all(), counts.all()


def recheck_retained(members: DataFrame, gates: DataFrame, retained: DataFrame, targets: DataFrame, near: DataFrame, signatures: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, gates, retained)`` after every retained call whose targets have one phase at most is put back, until there is none.

    ``members`` and ``gates`` as of ``analyse_methods``, ``retained(method, id, rank)``, ``targets(id, target)``, ``near(method, id, before, after)`` as
    of ``retained_frontiers``. The call joins the phases of its neighbours that it is related to, by flow or a field between the two
    calls or by the phase's core signature: those before it, then the call, then those behind. The new phase takes the place of the
    earliest of them; without one, the place before its earliest neighbour; without a neighbour, the end. Gates inside of it go. A round
    puts back the first such call, by ``rank``, of each method below which no other method has one; where all wait for each other, of each method.
    """
    full = F.struct(*DIMENSIONS, "observed")
    tags = signatures.select("id", F.flatten(F.array(*map(tagged, (*DIMENSIONS, "observed")))).alias("values"))
    direct = flow.select(F.col("src").alias("l"), F.col("dst").alias("r"), F.lit(True).alias("__flow")).distinct()
    now, open_, held = materialize(members.withColumn("at", F.col("at").cast("double"))), materialize(gates), materialize(retained.select("method", "id", "rank"))
    everyone = materialize(members.select("method").unionByName(retained.select("method")).unionByName(targets.join(members.select(F.col("method").alias("target")), "target", "left_semi").select(F.col("target").alias("method"))).distinct())
    while True:
        own = everyone.join(now.groupBy("method").agg(F.count_distinct("phase").alias("own")), "method", "left").select("method", F.coalesce("own", F.lit(0)).alias("own"))
        calls = held.join(targets, "id").select("method", F.col("id").alias("call"), "target")
        counts = effective_counts(own, calls)
        worst = calls.join(counts.select(F.col("method").alias("target"), "count", F.lit(True).alias("__known")), "target").groupBy("method", F.col("call").alias("id")).agg(F.max("count").alias("most"), F.bool_or(F.col("count").isNull()).alias("unknown"))
        loose = materialize(held.join(worst, ["method", "id"], "left").where("not coalesce(unknown, false) and coalesce(most, 0) <= 1").select("method", "id", "rank"))
        if loose.isEmpty():
            return now, open_, held
        up = calls.select(F.col("target").alias("src"), F.col("method").alias("dst")).distinct()
        above = reach(up, loose.select(F.col("method").alias("root"), F.col("method").alias("id")).distinct()).where("level > 0").select(F.col("id").alias("method")).distinct()
        ready = loose.join(above, "method", "left_anti")
        ready = loose if ready.isEmpty() else ready
        picked = materialize(ready.groupBy("method").agg(F.min_by("id", F.struct("rank", "id")).alias("id")))
        found = picked.join(near, ["method", "id"], "left")
        sides = [found.select("method", "id", F.lit(s).alias("side"), F.posexplode(c).alias("pos", "f")) for s, c in ((0, "before"), (2, "after"))]
        beside = sides[0].unionByName(sides[1]).join(now.select("method", F.col("id").alias("f"), "phase", "at"), ["method", "f"])
        beside = beside.join(signatures.select(F.col("id").alias("f"), full.alias("__f")), "f", "left").join(signatures.select("id", full.alias("__c")), "id", "left")
        first = F.col("side") == 0
        beside = beside.withColumns({"l": F.when(first, F.col("f")).otherwise(F.col("id")), "r": F.when(first, F.col("id")).otherwise(F.col("f"))}).join(direct, ["l", "r"], "left")
        writes = F.when(first, F.arrays_overlap("__f.fields_written", "__c.fields_read")).otherwise(F.arrays_overlap("__c.fields_written", "__f.fields_read"))
        key = F.struct("method", "phase")
        core = core_signature(now.join(beside.select("method", "phase").distinct(), ["method", "phase"], "left_semi").join(tags, "id").select(key.alias("key"), "values"), by="key", values="values")
        none = F.struct(*(F.array().cast("array<string>").alias(d) for d in (*DIMENSIONS, "observed")))
        told = beside.join(core.select("key.method", "key.phase", as_signature(F.col("core")).alias("__p")), ["method", "phase"], "left")
        told = told.withColumns({"__p": F.coalesce("__p", none), "__c": F.coalesce("__c", none)})
        related = F.coalesce("__flow", F.lit(False)) | F.coalesce(writes, F.lit(False)) | (verdict("__p", "__c")["verdict"] == "RELATED")
        told = materialize(told.select("method", "phase", "at", "side", "pos", related.alias("related")))
        joins = told.where("related").groupBy("method", "phase").agg(F.min(F.struct("side", "pos")).alias("turn"))
        name = joins.groupBy("method").agg(F.min_by("phase", "turn").alias("name"))
        place = told.groupBy("method").agg(F.min(F.when(F.col("related"), F.col("at"))).alias("to"), (F.min("at") - 0.5).alias("before"))
        end = now.groupBy("method").agg((F.max("at") + 1).alias("end"))
        home = picked.join(name, "method", "left").join(place, "method", "left").join(end, "method", "left")
        home = materialize(home.select("method", F.col("id").alias("call"), F.coalesce("name", "id").alias("name"), F.coalesce("to", "before", "end", F.lit(1.0)).alias("to")))
        moving = now.join(joins, ["method", "phase"]).join(home, "method").select("method", F.col("name").alias("phase"), F.col("to").alias("at"), "id", F.struct("turn.side", "turn.pos", "seq").alias("o"))
        back = home.select("method", F.col("name").alias("phase"), F.col("to").alias("at"), F.col("call").alias("id"), F.struct(F.lit(1).alias("side"), F.lit(0).alias("pos"), F.lit(0).alias("seq")).alias("o"))
        moved = moving.unionByName(back).withColumn("seq", F.row_number().over(W.partitionBy("method", "phase").orderBy("o")) - 1).drop("o")
        rest = now.join(joins.select("method", "phase"), ["method", "phase"], "left_anti")
        after = rest.select("method", "phase", "at", "id", "seq").unionByName(moved)
        # Places are counted anew, so that halves never meet.
        order = after.groupBy("method", "phase").agg(F.min("at").alias("at")).withColumn("nth", F.row_number().over(W.partitionBy("method").orderBy("at", "phase")).cast("double"))
        after = materialize(after.drop("at").join(order.select("method", "phase", F.col("nth").alias("at")), ["method", "phase"]).select("method", "phase", "at", "id", "seq"))
        inside = lambda s: moved.select("method", F.col("id").alias(s), F.lit(True).alias(f"__{s}"))
        kept = materialize(open_.join(inside("left_id"), ["method", "left_id"], "left").join(inside("right_id"), ["method", "right_id"], "left").where("__left_id is null or __right_id is null").select(*open_.columns))
        fewer = materialize(held.join(picked, ["method", "id"], "left_anti").select("method", "id", "rank"))
        release(now, open_, held, loose, picked, told, home)
        now, open_, held = after, kept, fewer


def analyse_phases(calls: DataFrame, targets: DataFrame, signatures: DataFrame, flow: DataFrame, answer: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The whole phase analysis: ``members``, ``gates``, ``retained``, ``questions`` about open gates and ``decisions``.

    ``calls`` as for ``analyse_bottom_up`` with ``callee`` and ``code``; excluded calls are not eligible. ``answer`` takes the questions and
    gives ``(method, gate, action, confidence, evidence)``; its merges are made, retained calls that then lead to one phase at most are
    put back, and the questions are asked anew. Without it there are no decisions. Questions of a method are in the order of their gates.
    """
    members, gates, kept, counts = analyse_bottom_up(calls, targets, signatures, flow)

    def questions(gates: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        place = F.row_number().over(W.partitionBy("method").orderBy("gate", "left_id", "right_id"))
        listed = gates.select("method", "gate", "left_id", "right_id", F.array().cast("array<string>").alias("evidence"), place.alias("pos"))
        return listed, gate_questions(listed, members.join(calls.select("id", "callee", "code"), "id"), signatures)

    listed, asked = questions(gates, members)
    out = {"members": members, "gates": gates, "retained": kept, "counts": counts, "questions": asked}
    if answer is None:
        return out
    listed = materialize(listed)
    after, left, decisions = resolve_gates(members, listed, answer(asked))
    items, arms = (materialize(df) for df in nest_structure(calls))
    ends = frontiers(items, arms).groupBy("method", "container", "kind", "key", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    end = lambda side: ends.where(F.col("side") == side).select("method", "container", "kind", "key", F.col("ids").alias(side))
    shown = items.join(end("entry"), ["method", "container", "kind", "key"], "left").join(end("exit"), ["method", "container", "kind", "key"], "left")
    near = retained_frontiers(shown, kept.select("method", "id"))
    ranked = kept.select("method", "id").join(calls.select("id", "rank"), "id")
    after, left, kept = recheck_retained(after, left.select("method", "gate", "left_id", "right_id"), ranked, targets, near, signatures, flow)
    return out | {"members": after, "gates": left, "retained": kept, "questions": questions(left, after)[1], "decisions": decisions}
