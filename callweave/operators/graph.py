"""Graph operators as frontier joins. Every loop cuts its lineage with a written table; only counts reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from callweave.functions.guards import merge
from callweave.session import Rounds, materialize, release


def bridge(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """``edges(src, dst, type, reqs)`` with the nodes ``excluded(id)`` spliced out.

    Every kept source gets edges to the nearest kept nodes behind excluded ones; guards along a route are merged
    and a conflict ends it. Self-loops go after merging; equal edges are one; cycles of excluded nodes give none.
    Excluded nodes with one edge out of a type are passed by doubling, so rounds follow the branchings of excluded
    nodes and the logarithm of the length of their chains.
    """
    out = excluded.select("id").distinct()
    hit = out.select(F.col("id").alias("dst"), F.lit(True).alias("hidden"))
    key = ["src", "dst", "type", "reqs"]
    first = materialize(edges.select(*key).distinct().join(out.select(F.col("id").alias("src"), F.lit(True).alias("inner")), "src", "left").join(hit, "dst", "left"))
    inner = _shortcuts(first.where("inner").select(F.col("src").alias("dst"), F.col("dst").alias("to"), "type", F.col("reqs").alias("more")))
    done = Rounds(first.where("inner is null and hidden is null").select(*key))
    seen = Rounds()
    frontier = seen.add(first.where("inner is null and hidden").select(*key))
    release(first)
    while not frontier.isEmpty():
        moved = frontier.join(inner, ["dst", "type"]).select("src", F.col("to").alias("dst"), "type", merge(F.col("reqs"), F.col("more")).alias("reqs"))
        step = materialize(moved.where("reqs is not null").distinct().join(hit, "dst", "left"))
        done.add(step.where("hidden is null").select(*key))
        frontier = seen.add(step.where("hidden").select(*key).join(seen.all(), key, "left_anti"))
        release(step)
    return done.all().where("src <> dst").distinct()


def _shortcuts(inner: DataFrame) -> DataFrame:
    """``inner(dst, to, type, more)``, the distinct edges out of excluded nodes, with those that lead to the only edge of an excluded node led on to the end of its chain.

    Merging guards is associative, so a chain has one conjunction, or a conflict and no edge. Chains that never end are cycles and go.
    """
    alone = F.count("*").over(W.partitionBy("dst", "type")) == 1
    marked = materialize(inner.withColumn("alone", alone))
    onto = marked.where("alone").select(F.col("dst").alias("to"), "type", F.lit(False).alias("end"))
    jump = marked.where("alone").join(onto, ["to", "type"], "left").select("dst", "to", "type", "more", F.coalesce("end", F.lit(True)).alias("end"))
    jump = materialize(jump)
    ended = Rounds(jump.where("end").drop("end"))
    live = materialize(jump.where("not end").drop("end"))
    release(jump)
    # An open chain goes on with its end's chain, which has ended or is as long as itself.
    bound = live.count().bit_length() + 1
    for _ in range(bound):
        if live.isEmpty():
            break
        far = ended.all().withColumn("end", F.lit(True)).unionByName(live.withColumn("end", F.lit(False)))
        far = far.select(F.col("dst").alias("to"), "type", F.col("to").alias("next"), F.col("more").alias("rest"), "end")
        step = materialize(live.join(far, ["to", "type"]).select("dst", F.col("next").alias("to"), "type", merge(F.col("more"), F.col("rest")).alias("more"), "end").where("more is not null"))
        ended.add(step.where("end").drop("end"))
        before, live = live, materialize(step.where("not end").drop("end"))
        release(before, step)
    onward = ended.all().select(F.col("dst").alias("to"), "type", F.col("to").alias("next"), F.col("more").alias("rest"))
    single = marked.where("alone").select(F.col("dst").alias("to"), "type", F.lit(True).alias("chained"))
    passed = marked.where("not alone").join(single, ["to", "type"], "left").join(onward, ["to", "type"], "left")
    led = passed.where("chained is null or next is not null").select("dst", F.coalesce("next", "to").alias("to"), "type", F.when(F.col("chained").isNull(), F.col("more")).otherwise(merge(F.col("more"), F.col("rest"))).alias("more"))
    # A node of a chain has one edge, so only the other ones can be repeated.
    return ended.all().unionByName(materialize(led.where("more is not null").distinct()))


def reach(edges: DataFrame, roots: DataFrame, *, max_depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """``(root, id, level)`` of all nodes reachable from ``roots(root, id)`` over ``edges(src, dst)``, each once.

    One loop serves all roots. ``stop(id)``: nodes that are reached but not passed.
    """
    steps = materialize(edges.select(F.col("src").alias("id"), "dst").distinct())
    seen = Rounds()
    frontier = seen.add(roots.select("root", "id", F.lit(0).alias("level")).distinct())
    level = 0
    while (max_depth is None or level < max_depth) and not frontier.isEmpty():
        level += 1
        go = frontier if stop is None or level == 1 else frontier.join(stop.select("id"), "id", "left_anti")
        new = go.join(steps, "id").select("root", F.col("dst").alias("id"), F.lit(level).alias("level")).distinct()
        frontier = seen.add(new.join(seen.all(), ["root", "id"], "left_anti"))
    return seen.all()


def reach_folded(edges: DataFrame, roots: DataFrame, *, max_depth: int | None = None, fold: int = 100_000, share: int = 1_000) -> DataFrame:
    """``reach`` for deep walks from many roots, whose rounds each look through all that was found before.

    Nodes never leave the part of the graph that edges link them to. Parts of up to ``fold`` edges are walked whole in tasks, in shares of
    ``share`` roots or more, so that edges are repeated for at most eight rows a root; larger parts take the rounds of ``reach``.
    Null ids are no nodes.
    """
    steps = materialize(edges.select("src", "dst").distinct().where("src <> dst"))
    starts = roots.select("root", "id").distinct()
    linked = materialize(components(steps)).select("id", F.col("root").alias("part"))
    placed = materialize(starts.join(linked, "id", "left").select("root", "id", "part"))
    inside = materialize(steps.join(linked.withColumnRenamed("id", "src"), "src").select("part", "src", "dst"))
    sizes = inside.groupBy("part").agg(F.count("*").alias("n")).join(placed.groupBy("part").agg(F.count("*").alias("many")), "part")
    sizes = materialize(sizes.withColumn("shares", F.ceil(F.col("many") / F.greatest(F.lit(share), F.col("n") / 8))))
    small = sizes.where(F.col("n") <= fold).select("part", "shares")
    led = inside.join(small, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.col("src").alias("id"), "dst")
    begun = placed.join(small, "part").select("part", F.pmod(F.xxhash64("root"), "shares").alias("share"), "root", "id")
    rows = materialize(led.unionByName(begun, allowMissingColumns=True))
    schema = f"root {dict(rows.dtypes)['root']}, id {dict(rows.dtypes)['id']}, level int"
    shape = to_arrow_schema(StructType.fromDDL(schema))
    tasks = rows.withColumn("__fold", F.pmod(F.xxhash64("part", "share"), F.lit(-(-rows.count() // (10 * share)) or 1))).drop("part", "share")

    # The type hints tell Spark that batches are passed, not whole tables.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walked(batches, shape, max_depth)

    found = tasks.groupBy("__fold").applyInArrow(run, schema)
    found = found.unionByName(placed.where("part is null").select("root", "id", F.lit(0).alias("level")))
    large = sizes.where(F.col("n") > fold).select("part")
    if large.isEmpty():
        return found
    return found.unionByName(reach(inside.join(large, "part", "left_semi"), placed.join(large, "part", "left_semi"), max_depth=max_depth))


def _walked(batches: Iterator[pa.RecordBatch], shape: pa.Schema, max_depth: int | None, size: int = 100_000) -> Iterator[pa.RecordBatch]:
    """``(root, id, level)`` from rows of edges ``(id, dst)`` and of roots, whose dst is null; about ``size`` rows at a time."""
    to: dict = {}
    starts: dict = {}
    for batch in batches:
        for root, at, dst in zip(*(batch.column(c).to_pylist() for c in ("root", "id", "dst"))):
            if dst is None:
                starts.setdefault(root, set()).add(at)
            else:
                to.setdefault(at, set()).add(dst)
    out: tuple[list, list, list] = ([], [], [])
    for root, now in starts.items():
        seen, level = set(), 0
        while now:
            seen |= now
            for column, values in zip(out, ([root] * len(now), now, [level] * len(now))):
                column.extend(values)
            if level == max_depth:
                break
            now = set().union(*(to[at] for at in now if at in to)) - seen
            level += 1
        if len(out[0]) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape)], schema=shape)
            out = ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape)], schema=shape)


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(id)`` of the nodes that ``edges(src, dst)`` lead to from any of ``roots(id)``, those included.

    A node with one edge in is reached if the node before it is, so chains and trees are passed by doubling; rounds follow the nodes where ways join.
    """
    start = materialize(roots.select("id").distinct())
    steps = edges.select("src", "dst").distinct().where("src <> dst").join(start.select(F.col("id").alias("dst")), "dst", "left_anti")
    steps = materialize(steps.withColumn("alone", F.count("*").over(W.partitionBy("dst")) == 1))
    behind, closed = _heads(steps.where("alone").select("src", "dst"))
    if closed is not None:
        behind = behind.join(closed, "id", "left_anti")
    behind = materialize(behind.select("id", F.col("run").alias("top")))
    # What stands for a node of a chain is its top; nodes of and behind closed rings have an edge in, but no top.
    joins = steps.where("not alone").join(behind.select(F.col("id").alias("src"), "top"), "src", "left")
    if closed is not None:
        joins = joins.join(closed.select(F.col("id").alias("src")), "src", "left_anti")
    found = reach(joins.select(F.coalesce("top", "src").alias("src"), "dst"), start.select(F.lit(0).alias("root"), "id")).select("id")
    return found.unionByName(behind.join(found.select(F.col("id").alias("top")), "top", "left_semi").select("id"))


def owners(nodes: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``(id, owner_entry_id)``: entries own themselves, other nodes the last entry of their method; without one: left out.

    ``by`` are columns that tell methods of equal names apart, like the repository.
    """
    entries = nodes.where("type = 'entry'").groupBy(*by, F.col("calleeFullName").alias("callerMethod")).agg(F.max_by("id", "pos").alias("owner_entry_id"))
    rest = nodes.where("type <> 'entry'").select("id", *by, "callerMethod").join(entries, [*by, "callerMethod"]).select("id", "owner_entry_id")
    return nodes.where("type = 'entry'").select("id", F.col("id").alias("owner_entry_id")).unionByName(rest)


def roots_and_orphans(nodes: DataFrame, edges: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``(id, kind)`` of entries that no invoke edge enters: root with a call of their own, else orphan. ``by`` as for ``owners``."""
    entries = nodes.where("type = 'entry'").select("id", *by, "calleeFullName")
    entered = edges.where("type = 'invoke'").select(F.col("dst").alias("id"))
    calls = nodes.where("type = 'call'").select(*by, F.col("callerMethod").alias("calleeFullName"), F.lit(True).alias("calls")).distinct()
    free = entries.join(entered, "id", "left_anti").join(calls, [*by, "calleeFullName"], "left")
    return free.select("id", F.when(F.col("calls"), "root").otherwise("orphan").alias("kind"))


def ordered_roots(kinds: DataFrame) -> DataFrame:
    """``(id, kind, place)``: roots and orphans of ``roots_and_orphans``, each kind in ascending order of id from 1; no task sees all of a kind."""
    from callweave.operators.gates import number

    each = [number(kinds.where(F.col("kind") == kind).select("id", "kind"), "id", "place") for kind in ("root", "orphan")]
    return each[0].unionByName(each[1]).select("id", "kind", "place")


def callees(invokes: DataFrame, internal: DataFrame) -> DataFrame:
    """``(src, targets)``: sorted distinct internal targets of every call."""
    return invokes.join(internal.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def callers(methods: DataFrame, method_edges: DataFrame) -> DataFrame:
    """``(id, callers)`` of every method, sorted and distinct, empty if none."""
    found = method_edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
    return methods.select("id").join(found, "id", "left").select("id", F.coalesce("callers", F.array().cast(dict(found.dtypes)["callers"])).alias("callers"))


def peel(edges: DataFrame) -> DataFrame:
    """``(id, level)`` by rounds of removing nodes without incoming edges; level null: on or behind a cycle."""
    live = materialize(edges.select("src", "dst").distinct())
    nodes = materialize(live.select(F.col("src").alias("id")).unionByName(live.select(F.col("dst").alias("id"))).distinct())
    left, found, level = nodes, Rounds(), 0
    while True:
        free = found.add(left.join(live.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            return nodes.join(found.all(), "id", "left")
        before = (left if left is not nodes else None, live)
        left = materialize(left.join(free.select("id"), "id", "left_anti"))
        live = materialize(live.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        release(*before)
        level += 1


def nearest_kept(edges: DataFrame, starts: DataFrame, transparent: DataFrame) -> DataFrame:
    """``(start, id)``: the first nodes that are not transparent on each way from ``starts(id)``."""
    first = starts.select(F.col("id").alias("start"), "id").join(edges.select(F.col("src").alias("id"), "dst"), "id").select("start", F.col("dst").alias("id")).distinct()
    through = transparent.select("id")
    inner = edges.join(through.select(F.col("id").alias("src")), "src", "left_semi")
    seen = reach(inner, first.select(F.col("start").alias("root"), "id"))
    return seen.select(F.col("root").alias("start"), "id").join(through, "id", "left_anti").select("start", "id").distinct()


def call_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` calls that follow each other across structure and transfer nodes of one method."""
    place = nodes.select("id", "type", "callerMethod")
    local = edges.where("type = 'sequence'").select("src", "dst").join(place.select(F.col("id").alias("src"), F.col("callerMethod").alias("m")), "src")
    local = local.join(place.select(F.col("id").alias("dst"), F.col("callerMethod").alias("n")), "dst").where("m = n").select("src", "dst")
    calls = nodes.where("type = 'call'").select("id")
    found = nearest_kept(local, calls, nodes.where("type in ('structure', 'transfer')").select("id"))
    return found.join(calls, "id", "left_semi").select(F.col("start").alias("src"), F.col("id").alias("dst"))


def dead_ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls whose next calls are all throws."""
    named = pairs.join(nodes.select(F.col("id").alias("dst"), "calleeFullName"), "dst")
    return named.groupBy(F.col("src").alias("id")).agg(F.bool_and(F.col("calleeFullName") == "<operator>.throw").alias("deadEnd")).where("deadEnd").select("id")


def cut_back_edges(edges: DataFrame, nodes: DataFrame, loops: DataFrame) -> DataFrame:
    """Edges whose ends share a loop and that enter it again go to the loop's exit instead."""
    held = nodes.select("id", F.explode("loopIds").alias("loop"))
    back = edges.join(loops.select(F.col("id").alias("loop"), F.col("entryNodeId").alias("dst"), F.col("exitNodeId")), "dst")
    back = back.join(held.select(F.col("id").alias("src"), "loop"), ["src", "loop"]).groupBy("src", "dst").agg(F.min("exitNodeId").alias("exit"))
    return edges.join(back, ["src", "dst"], "left").withColumn("dst", F.coalesce("exit", "dst")).drop("exit")


def linear_runs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, run, position)``: maximal one-in one-out chains among ``members(id, rank)``, by pointer doubling.

    A run is named by its first node; a closed cycle begins at its lowest rank.
    """
    own = edges.select("src", "dst").distinct().join(members.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("dst")), "dst", "left_semi")
    one = lambda c: F.count("*").over(W.partitionBy(c)) == 1
    links = materialize(own.withColumn("a", one("src")).withColumn("b", one("dst")).where("a and b and src <> dst").select("src", "dst"))
    jump, closed = _heads(links)
    if closed is not None:
        ring = materialize(components(links.join(closed.withColumnRenamed("id", "src"), "src", "left_semi")))
        heads = ring.join(members, "id").groupBy("root").agg(F.min_by("id", F.struct("rank", "id")).alias("dst")).select("dst")
        opened = links.join(ring.select(F.col("id").alias("dst")), "dst", "left_semi").join(heads, "dst", "left_anti").select("src", "dst")
        jump = jump.join(ring.select("id"), "id", "left_anti").unionByName(_heads(materialize(opened))[0])
    return members.select("id").join(jump, "id", "left").select("id", F.coalesce("run", "id").alias("run"), F.coalesce("position", F.lit(0)).alias("position"))


def _heads(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(id, run, position)`` of all nodes behind others by pointer doubling, and ``(id)`` of nodes on cycles, if any.

    After as many rounds as the number of links has bits, who still moves is on a cycle.
    """
    jump = materialize(links.select(F.col("dst").alias("id"), F.col("src").alias("run"), F.lit(1).cast("long").alias("position")))
    for _ in range(links.count().bit_length() + 1):
        far = jump.select(F.col("id").alias("run"), F.col("run").alias("next"), F.col("position").alias("more"))
        new = materialize(jump.join(far, "run", "left").select("id", F.coalesce("next", "run").alias("run"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position"), F.col("next").isNotNull().alias("moved")))
        release(jump)
        jump = new
        if new.where("moved").isEmpty():
            return jump.drop("moved"), None
    return jump.drop("moved"), jump.where("moved").select("id")


def expand(starts: DataFrame, calls: DataFrame, *, max_depth: int = 3) -> DataFrame:
    """Bounded path expansion: ``(root, path, method, depth)``; ``calls(method, call, target)``; recursion is cut off on the active path."""
    frontier = starts.select(F.col("method").alias("root"), F.array("method").alias("path"), "method", F.lit(0).alias("depth"))
    levels = [frontier]
    for depth in range(1, max_depth + 1):
        frontier = frontier.join(calls, "method").where(~F.array_contains("path", F.col("target")))
        frontier = materialize(frontier.select("root", F.concat("path", F.array("target")).alias("path"), F.col("target").alias("method"), F.lit(depth).alias("depth")))
        levels.append(frontier)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of the nodes that ``edges(src, dst)`` link; root is the smallest node reachable.

    Contraction rounds: every node points to its smallest neighbour, pointers are doubled until they reach their
    roots, and edges are rewritten to roots. Each round at least halves the nodes that still have edges, so rounds
    grow with the logarithm of the number of nodes, and tables are deleted once they are used up. Self-loops,
    repeated edges and both directions are allowed; nodes with self-loops only are left out.
    """
    live = materialize(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct())
    labels: DataFrame | None = None
    while not live.isEmpty():
        parent = live.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        tops = live.select(F.col("a").alias("id")).distinct().join(parent, "id", "left_anti").select("id", F.col("id").alias("root"))
        parent = materialize(parent.unionByName(tops))
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("up"))
            doubled = materialize(parent.join(up, "root").select("id", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            release(parent)
            parent = doubled
            if doubled.where("moved").isEmpty():
                break
        step = parent.select(F.col("id").alias("root"), F.col("root").alias("up"))
        before, labels = labels, parent.select("id", "root") if labels is None else materialize(labels.join(step, "root", "left").select("id", F.coalesce("up", "root").alias("root")))
        left, right = (parent.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        after = materialize(live.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct())
        if before is not None:
            release(before, parent)
        release(live)
        live = after
    release(live)
    return labels if labels is not None else edges.select(F.col("src").alias("id"), F.col("dst").alias("root")).limit(0)


def retained_structures(content: DataFrame, children: DataFrame) -> DataFrame:
    """Least fixed point of ``content(id)`` under ``children(parent, child)``: a group stays with a child that stays."""
    up = reach(children.select(F.col("child").alias("src"), F.col("parent").alias("dst")), content.select(F.lit(0).alias("root"), "id"))
    return up.select("id").distinct()


def drop_groups(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Guards of ``removed(id)`` groups leave the edges; equal edges are one (first position)."""
    flat = edges.withColumn("__e", F.monotonically_increasing_id())
    flat = materialize(flat)
    each = flat.select("__e", F.posexplode("reqs").alias("i", "r")).withColumn("id", F.col("r.groupId")).join(removed.select("id"), "id", "left_anti")
    kept = each.groupBy("__e").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("left"))
    found = flat.join(kept, "__e", "left").withColumn("reqs", F.coalesce("left", F.expr("filter(reqs, x -> false)"))).drop("left", "__e")
    return found.groupBy("src", "dst", "type", "reqs").agg(F.min("pos").alias("pos"))


def excluded_calls(nodes: DataFrame, edges: DataFrame, noise: Column, is_lambda: Column) -> DataFrame:
    """Ids of noise calls, but for those that invoke the body of a lambda; both tests are about ``calleeFullName``."""
    bodies = nodes.where(F.col("type") == "entry").where(is_lambda).select(F.col("id").alias("dst"))
    kept = edges.where("type = 'invoke'").join(bodies, "dst", "left_semi").select(F.col("src").alias("id"))
    return nodes.where((F.col("type") == "call") & F.coalesce(noise, F.lit(False))).select("id").join(kept, "id", "left_anti")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` without the sequence edges that leave a throw for anything but a throw exit."""
    throws = nodes.where("type = 'call' and calleeFullName = '<operator>.throw'").select(F.col("id").alias("src"), F.lit(True).alias("__throws"))
    ends = nodes.where("type = 'exit' and exitKind = 'throw'").select(F.col("id").alias("dst"), F.lit(True).alias("__ends"))
    told = edges.join(throws, "src", "left").join(ends, "dst", "left")
    return told.where("type <> 'sequence' or __throws is null or __ends").select(*edges.columns)


def arm_outcomes(exits: DataFrame) -> DataFrame:
    """``(groupId, outcomes)``: distinct sets of exits that the arms of a group have, from ``exits(groupId, armLabel, kind, destination)``.

    Sets are told apart by their size and two sums of hashes, so no set is gathered; over one set means that the branch matters.
    """
    each = exits.distinct().withColumns({"h": F.xxhash64("kind", "destination"), "g": F.xxhash64("destination", "kind")})
    sets = each.groupBy("groupId", "armLabel").agg(F.count("kind").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g"))
    return sets.groupBy("groupId").agg(F.count_distinct("n", "h", "g").alias("outcomes"))


def content_groups(nodes: DataFrame, exits: DataFrame, loops: DataFrame) -> DataFrame:
    """``(id)`` of groups with content of their own.

    A branch: a call, transfer, return or throw in one of its arms, or arms of different outcomes. A loop ``(id)``: a call
    or transfer inside, or a transfer that aims at it.
    """
    lively = nodes.where("type in ('call', 'transfer') or (type = 'exit' and exitKind in ('return', 'throw'))")
    arms = lively.select(F.explode("branchArms").alias("a")).select(F.col("a.groupId").alias("id"))
    differ = arm_outcomes(exits).where("outcomes > 1").select(F.col("groupId").alias("id"))
    moving = nodes.where("type in ('call', 'transfer')")
    held = moving.select(F.explode("loopIds").alias("id")).unionByName(moving.where("type = 'transfer'").select(F.col("targetStructureGroupId").alias("id")))
    return arms.unionByName(differ).unionByName(held.join(loops.select("id"), "id", "left_semi")).distinct()


def clean_graph(nodes: DataFrame, edges: DataFrame, branches: DataFrame, loops: DataFrame, exits: DataFrame, *, noise: Column, is_lambda: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, groups)`` after noise calls are spliced out and groups without content are removed to a fixed point.

    ``branches(id, entryNodeId)`` and ``loops(id, entryNodeId)``, ``exits`` as for ``arm_outcomes``. A group stays with content of its
    own or with a group that stays and whose entry lies in it. Guards and memberships of removed groups go before their anchors are
    spliced out, so that alternative empty arms don't meet as a contradiction. Entries stay even if no edge touches them.
    """
    bad = materialize(excluded_calls(nodes, edges, noise, is_lambda))
    edges = valid_edges(edges, nodes).select("src", "dst", "type", "reqs")
    if not bad.isEmpty():
        edges = materialize(bridge(edges, bad))
        touched = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        left = nodes.join(bad, "id", "left_anti")
        nodes = left.where("type = 'entry'").unionByName(left.where("type <> 'entry'").join(touched, "id", "left_semi"))
    nodes = materialize(nodes)
    groups = branches.select("id", "entryNodeId").unionByName(loops.select("id", "entryNodeId"))
    inside = nodes.select(F.col("id").alias("entryNodeId"), F.explode(F.array_union(F.transform("branchArms", lambda a: a["groupId"]), "loopIds")).alias("parent"))
    children = groups.join(inside, "entryNodeId").select("parent", F.col("id").alias("child"))
    stay = materialize(retained_structures(content_groups(nodes, exits, loops), children).join(groups.select("id"), "id", "left_semi"))
    removed = materialize(groups.select("id").join(stay, "id", "left_anti"))
    if not removed.isEmpty():
        edges = materialize(drop_groups(edges.withColumn("pos", F.lit(0)), removed).select("src", "dst", "type", "reqs"))
        nodes = materialize(_leave(nodes, removed))
        anchors = nodes.where("type = 'structure'").join(removed.select(F.col("id").alias("structureGroupId")), "structureGroupId", "left_semi").select("id")
        edges, nodes = bridge(edges, anchors), nodes.join(anchors, "id", "left_anti")
    return nodes, edges, stay


def _leave(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Nodes without their memberships of ``removed(id)`` groups, which a join finds node by node."""
    held = nodes.select("id", F.explode(F.array_union(F.transform("branchArms", lambda a: a["groupId"]), "loopIds")).alias("g"))
    lost = held.join(removed.select(F.col("id").alias("g")), "g", "left_semi").groupBy("id").agg(F.collect_set("g").alias("__lost"))
    told = nodes.join(lost, "id", "left").withColumn("__lost", F.coalesce("__lost", F.array().cast("array<string>")))
    return told.withColumns({"branchArms": F.filter("branchArms", lambda a: ~F.array_contains("__lost", a["groupId"])), "loopIds": F.array_except("loopIds", "__lost")}).select(*nodes.columns)


def visible_graph(edges: DataFrame, hidden: DataFrame, roots: DataFrame) -> DataFrame:
    """Sequence edges ``(src, dst, reqs)`` after the ``hidden(id)`` nodes are spliced out, as far as ``roots(id)`` reach them; guards are sorted, so equal sets are one edge."""
    left = materialize(bridge(edges.withColumn("type", F.lit("sequence")), hidden).select("src", "dst", F.array_sort("reqs").alias("reqs")).distinct())
    found = reached(left, roots).select(F.col("id").alias("src"))
    return left.join(found, "src", "left_semi").select("src", "dst", "reqs")


def filter_noise(nodes: DataFrame, edges: DataFrame, noise: Column) -> tuple[DataFrame, DataFrame]:
    """Noise calls spliced out; if any was, nodes that no edge touches go too, entries excepted."""
    bad = materialize(nodes.where((F.col("type") == "call") & noise).select("id"))
    if bad.isEmpty():
        return nodes, edges.select("src", "dst", "type", "reqs")
    left = materialize(bridge(edges, bad))
    touched = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()
    kept = nodes.join(bad, "id", "left_anti")
    return kept.where("type = 'entry'").unionByName(kept.where("type <> 'entry'").join(touched, "id", "left_semi")), left
