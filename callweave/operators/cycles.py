"""Cycles of directed graphs: strong components, their report, an order of what is left, and the cut of loops.

Linear runs are contracted by pointer doubling first, so rounds follow the branchings of a graph, not the length
of its chains. Every round is a join over written tables, which are deleted after their last reader.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.operators.graph import _heads, components, reach
from callweave.session import Rounds, materialize, release


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``(src, dst, steps)`` between the nodes that branch, join, begin or end; ``(id, src, dst, position)``, the other ones on the run from src to dst; ``(id, component)`` of closed rings, if any.

    ``edges(src, dst)`` are distinct and without self-loops. A node with one edge in and one out is inside of a run.
    """
    once = lambda c: edges.groupBy(F.col(c).alias("id")).count().where("count = 1").select("id")
    thin = materialize(once("dst").join(once("src"), "id", "left_semi"))
    if thin.isEmpty():
        return edges.select("src", "dst", F.lit(1).cast("long").alias("steps")), thin.select("id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("position")), None
    marked = edges.join(thin.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(thin.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    marked = materialize(marked.select("src", "dst", F.col("a").isNotNull().alias("a"), F.col("b").isNotNull().alias("b")))
    links = materialize(marked.where("a and b").select("src", "dst"))
    jump, closed = _heads(links)
    rings = None
    if closed is not None:
        rings = materialize(components(links.join(closed.withColumnRenamed("id", "src"), "src", "left_semi")).withColumnRenamed("root", "component"))
        jump = jump.join(rings.select("id"), "id", "left_anti")
        thin = thin.join(rings.select("id"), "id", "left_anti")
    runs = thin.join(jump, "id", "left").select("id", F.coalesce("run", "id").alias("run"), F.coalesce("position", F.lit(0).cast("long")).alias("position"))
    begins = marked.where("not a and b").select(F.col("src").alias("from"), F.col("dst").alias("run"))
    ends = marked.where("a and not b").select(F.col("src").alias("id"), F.col("dst").alias("to"))
    ended = runs.join(ends, "id").select("run", "to", (F.col("position") + 2).alias("steps"))
    whole = materialize(begins.join(ended, "run"))
    short = marked.where("not a and not b").select("src", "dst", F.lit(1).cast("long").alias("steps"))
    joined = short.unionByName(whole.select(F.col("from").alias("src"), F.col("to").alias("dst"), "steps"))
    inner = runs.join(whole, "run").select("id", F.col("from").alias("src"), F.col("to").alias("dst"), (F.col("position") + 1).alias("position"))
    return materialize(joined), materialize(inner), rings


def _colours(live: DataFrame) -> DataFrame:
    """``(id, colour)``: the smallest node that reaches each node, itself included.

    Nodes that changed tell their successors; then everyone takes the colour of its colour, which reaches it too.
    """
    colours = materialize(live.select(F.col("src").alias("id")).unionByName(live.select(F.col("dst").alias("id"))).distinct().withColumn("colour", F.col("id")))
    changed = colours
    while not changed.isEmpty():
        told = changed.join(live.select(F.col("src").alias("id"), "dst"), "id").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("told"))
        new = materialize(colours.join(told, "id", "left").select("id", F.col("colour").alias("old"), F.least("colour", "told").alias("colour")))
        step = new.select(F.col("id").alias("colour"), F.col("colour").alias("further"))
        both = materialize(new.join(step, "colour", "left").select("id", "old", F.least("colour", "further").alias("colour")))
        release(new, colours)
        colours, changed = both, both.where("colour < old").select("id", "colour")
    return colours.select("id", "colour")


def tarjan(edges: list[tuple]) -> dict:
    """Each node's strong component, named by its smallest node; the stack is explicit, so depth is no limit."""
    to: dict = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
        to.setdefault(b, [])
    index, low, part, stack = {}, {}, {}, []
    for start in to:
        work = [] if start in index else [(start, iter(to[start]))]
        while work:
            node, rest = work[-1]
            if node not in index:
                index[node] = low[node] = len(index)
                stack.append(node)
            for other in rest:
                if other not in index:
                    work.append((other, iter(to[other])))
                    break
                if other not in part:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if low[node] == index[node]:
                    members = [stack.pop()]
                    while members[-1] != node:
                        members.append(stack.pop())
                    part.update(dict.fromkeys(members, min(members)))
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
    return part


def _folded(rows: DataFrame, by: str, run: Callable[[pa.Table], pa.Table], schema: str, fold: int) -> DataFrame:
    """``run`` over tables of about ``fold`` rows that hold whole values of ``by``, many of them if they are small."""
    many = max(1, -(-rows.count() // max(1, fold)))
    return rows.withColumn("__fold", F.pmod(F.xxhash64(by), F.lit(many))).groupBy("__fold").applyInArrow(run, schema)


def _parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Strong components of both ends of the edges from a to b, named by their smallest node; nodes that no cycle can hold are trimmed before the search."""
    nodes, ends = np.unique(np.stack([a, b]), return_inverse=True)
    ends = ends.reshape(2, -1)
    part, live = np.arange(len(nodes)), ends[:, ends[0] != ends[1]]
    for _ in range(20):
        goes, met = np.zeros(len(nodes), dtype=bool), np.zeros(len(nodes), dtype=bool)
        goes[live[0]], met[live[1]] = True, True
        kept = met[live[0]] & goes[live[1]]
        if kept.all():
            break
        live = live[:, kept]
    for n, least in tarjan(list(zip(*live.tolist()))).items():
        part[n] = least
    return nodes[part[ends]]


def strong_components(edges: DataFrame, *, within: str | None = None, fold: int = 100_000) -> DataFrame:
    """``(id, component)`` of every node of ``edges(src, dst)``; the component is its smallest node.

    ``within`` names a column of which every node has one value, like its method: values of up to ``fold`` edges
    are folded in tasks that take about ``fold`` edges at once. The others, and all without it, take rounds of joins.
    Repeated edges and self-loops are allowed; nulls are no nodes; no edges give no rows.
    """
    edges = edges.where("src is not null and dst is not null")
    if within is None:
        return _by_colours(edges)
    kind = dict(edges.dtypes)["src"]
    each = materialize(edges.select(F.coalesce(F.col(within).cast("string"), F.lit("")).alias("within"), "src", "dst").distinct())
    big = materialize(each.groupBy("within").count().where(F.col("count") > fold).select("within"))

    def run(group: pa.Table) -> pa.Table:
        # Nodes are numbered in their order, so that the smallest number is the smallest node.
        nodes = pc.unique(pa.chunked_array([*group.column("src").chunks, *group.column("dst").chunks]))
        nodes = nodes.take(pc.array_sort_indices(nodes))
        a, b = (pc.index_in(group.column(c), nodes).to_numpy() for c in ("src", "dst"))
        part, of = np.arange(len(nodes)), _parts(a, b)
        part[a], part[b] = of
        return pa.table({"id": nodes, "component": nodes.take(pa.array(part))})

    schema = f"id {kind}, component {kind}"
    if big.isEmpty():
        return _folded(each, "within", run, schema, fold)
    folded = _folded(materialize(each.join(big, "within", "left_anti")), "within", run, schema, fold)
    return folded.unionByName(_by_colours(materialize(each.join(big, "within", "left_semi"))))


def _by_colours(edges: DataFrame) -> DataFrame:
    """Strong components by forward-backward colouring.

    Nodes that no cycle can hold are trimmed, the smallest node that reaches a node colours it, and what reaches
    that node back inside its colour is its component; edges between colours are on no cycle. This is repeated
    until no edge is left.
    """
    edges = materialize(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    short, inner, rings = contract(edges.where("src <> dst"))
    live, found = materialize(short.where("src <> dst").select("src", "dst").distinct()), Rounds()
    while not live.isEmpty():
        for _ in range(3):
            held = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            trimmed = materialize(held.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            release(live)
            live = trimmed
        if live.isEmpty():
            break
        colours = materialize(_colours(live))
        side = lambda c: colours.select(F.col("id").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = materialize(live.join(side("src"), "src").join(side("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        # One reach over all colours: edges between colours are gone, so nobody is met twice.
        back = reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), same.select(F.col("colour").alias("root"), F.col("colour").alias("id")).distinct())
        done = found.add(back.select("id", F.col("root").alias("component")))
        left = same.join(done.select(F.col("id").alias("src")), "src", "left_anti").join(done.select(F.col("id").alias("dst")), "dst", "left_anti")
        before, live = live, materialize(left.select("src", "dst"))
        release(before, colours, same)
    held = nodes.select("id", F.col("id").alias("component")).limit(0) if not found.tables else found.all()
    if rings is not None:
        held = held.unionByName(rings.select("id", "component"))
    # A run lies on a cycle if its ends are one node, or two of one component.
    ends = inner.join(held.select(F.col("id").alias("src"), F.col("component").alias("a")), "src", "left").join(held.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst", "left")
    ends = ends.where("src = dst or a = b").select("id", F.coalesce("a", "src").alias("component"))
    own = inner.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component")).distinct().join(held.select("id"), "id", "left_anti")
    told = materialize(held.unionByName(ends).unionByName(own))
    least = told.groupBy("component").agg(F.min("id").alias("least"))
    named = told.join(least, "component").select("id", F.col("least").alias("component"))
    return materialize(nodes.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def cyclic(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The edges ``(src, dst, component)`` that lie on a cycle: both ends in one of the strong components ``parts``."""
    side = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").where("src_part = dst_part").withColumn("component", F.col("src_part")).drop("src_part", "dst_part")


def around(edges: list[tuple]) -> tuple[dict, dict]:
    """The nodes behind and before each node."""
    to: dict = {}
    into: dict = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    return to, into


def shortest_cycle(edges: list[tuple], start: int) -> list[int]:
    """A shortest cycle through ``start`` by breadth-first levels, then back from its end over the smallest nodes of each level."""
    return _cycle(*around(edges), start)


def _cycle(to: dict, into: dict, start: int) -> list[int]:
    level, layer, depth = {start: 0}, [start], 0
    while layer and not any(start in to[n] for n in layer):
        layer = list(dict.fromkeys(m for n in layer for m in to[n] if m not in level))
        depth += 1
        level.update(dict.fromkeys(layer, depth))
    walk = [min(n for n in layer if start in to[n])]
    while walk[-1] != start:
        walk.append(min(n for n in into[walk[-1]] if level.get(n) == level[walk[-1]] - 1))
    return walk[::-1]


def cycle_report(edges: DataFrame, *, within: str | None = None, fold: int = 100_000) -> DataFrame:
    """``(component, nodes, edges, length, witness)`` of every strong component with a cycle.

    The witness is a shortest cycle through the component's smallest node, beginning there; of several the one
    whose nodes, read from its end, are the smallest. ``nodes`` and ``edges`` count those on cycles. Components of
    up to ``fold`` edges are searched in tasks that take about ``fold`` edges at once; in larger ones a round of joins
    is made for each level.
    """
    distinct = edges.select("src", "dst").distinct()
    inside = materialize(cyclic(distinct, strong_components(edges, within=within, fold=fold)))
    kind = dict(inside.dtypes)["component"]
    large = materialize(inside.groupBy("component").count().where(F.col("count") > fold).select("component"))
    small = inside if large.isEmpty() else materialize(inside.join(large, "component", "left_anti"))

    def run(group: pa.Table) -> pa.Table:
        # Components share no node, so all of a task are searched in one graph. A component is named by its smallest node.
        nodes = pc.unique(group.column("src"))
        nodes = nodes.take(pc.array_sort_indices(nodes))
        a, b, of = (pc.index_in(group.column(c), nodes).to_pylist() for c in ("src", "dst", "component"))
        to, into = around(list(zip(a, b)))
        starts = sorted(set(of))
        walks = [_cycle(to, into, n) for n in starts]
        edges_of = Counter(of)
        nodes_of = Counter(dict(zip(a, of)).values())
        held = pa.array([n for walk in walks for n in walk], pa.int64())
        cuts = pa.array(list(accumulate(map(len, walks), initial=0)), pa.int32())
        counts = {"nodes": [nodes_of[n] for n in starts], "edges": [edges_of[n] for n in starts]}
        return pa.table({"component": nodes.take(pa.array(starts, pa.int64())), **{c: pa.array(v, pa.int64()) for c, v in counts.items()}, "length": pa.array(list(map(len, walks)), pa.int32()), "witness": pa.ListArray.from_arrays(cuts, nodes.take(held))})

    folded = _folded(small, "component", run, f"component {kind}, nodes long, edges long, length int, witness array<{kind}>", fold)
    if large.isEmpty():
        return folded
    rest = materialize(inside.join(large, "component", "left_semi"))
    shape = rest.groupBy("component").agg(F.count_distinct("src").alias("nodes"), F.count("*").alias("edges"))
    return folded.unionByName(shape.join(_witnesses(rest), "component").select("component", "nodes", "edges", "length", "witness"))


def _witnesses(inside: DataFrame) -> DataFrame:
    """``(component, length, witness)`` of all components of ``inside(src, dst, component)``, a round for each level."""
    # Breadth first from all smallest nodes at once, each component in its own edges, until they are met again.
    steps = inside.select(F.col("src").alias("id"), "dst", "component")
    start = inside.select("component").distinct()
    seen, met = Rounds(), Rounds()
    frontier = seen.add(start.select("component", F.col("component").alias("id"), F.lit(0).alias("level")))
    open_ = start
    level = 0
    while not frontier.isEmpty():
        level += 1
        new = materialize(frontier.select("component", "id").join(steps, ["component", "id"]).groupBy("component", "dst").agg(F.min("id").alias("from")))
        back = met.add(new.where("dst = component").select("component", "from", F.lit(level).alias("length")))
        open_ = materialize(open_.join(back.select("component"), "component", "left_anti"))
        new = new.join(open_, "component", "left_semi").select("component", F.col("dst").alias("id"), F.lit(level).alias("level"))
        frontier = seen.add(new.join(seen.all().select("component", "id"), ["component", "id"], "left_anti"))
    levels = seen.all()
    walk = materialize(met.all().select("component", "length", F.col("from").alias("id"), F.array("from").alias("witness")))
    into = inside.select("component", F.col("dst").alias("id"), F.col("src").alias("from"))
    done = Rounds()
    while True:
        done.add(walk.where("id = component").select("component", "length", "witness"))
        walk = walk.where("id <> component")
        if walk.isEmpty():
            break
        at = levels.select("component", F.col("id").alias("from"), F.col("level").alias("before"))
        back = walk.join(levels, ["component", "id"]).join(into, ["component", "id"]).join(at, ["component", "from"]).where(F.col("before") == F.col("level") - 1)
        walk = materialize(back.groupBy("component").agg(F.min(F.struct("from", "length", "witness")).alias("x")).select("component", "x.length", F.col("x.from").alias("id"), F.concat(F.array("x.from"), "x.witness").alias("witness")))
    return done.all()


def topo_levels(edges: DataFrame, ranks: DataFrame, *, within: str | None = None) -> DataFrame:
    """``(id, component, level, place)`` of every node of ``edges(src, dst)``.

    Strong components are condensed; the level is the longest way to a component over condensed edges. ``place``
    counts the nodes of a level (and of a value of ``within``) from 1: components by the least rank of
    ``ranks(id, rank)`` in them, then their members by rank, so that members stand side by side. Nodes without a
    rank come behind those with one.
    """
    parts = materialize(strong_components(edges, within=within))
    side = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    dag = edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst").where("src_part <> dst_part")
    dag = materialize(dag.select(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).distinct())
    short, inner, _ = contract(dag)
    live = materialize(short.groupBy("src", "dst").agg(F.max("steps").alias("steps")))
    nodes = parts.select(F.col("component").alias("id")).distinct().join(inner.select("id"), "id", "left_anti")
    # Arrivals of a node: a way to it from each node before it; it is free when no edge to it is left.
    left, found, arrived = materialize(nodes.withColumn("best", F.lit(0).cast("long"))), Rounds(), None
    while not left.isEmpty():
        free = found.add(left.join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.col("best").alias("level")))
        pushed = free.select(F.col("id").alias("src"), "level").join(live, "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("level") + F.col("steps")).alias("pushed"))
        rest = materialize(left.join(free.select("id"), "id", "left_anti").join(pushed, "id", "left").select("id", F.greatest("best", F.coalesce("pushed", F.lit(0))).alias("best")))
        after = materialize(live.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        release(left, live)
        left, live = rest, after
    levels = found.all() if found.tables else nodes.withColumn("level", F.lit(0).cast("long"))
    behind = inner.join(levels.select(F.col("id").alias("src"), "level"), "src").select("id", (F.col("level") + F.col("position")).alias("level"))
    levels = levels.unionByName(behind).withColumnRenamed("id", "component")
    ranked = parts.join(ranks.select("id", "rank"), "id", "left").join(levels, "component")
    first = F.min(F.struct(F.col("rank").isNull().alias("none"), "rank")).over(W.partitionBy("component"))
    graph = F.lit("") if within is None else F.coalesce(F.col(within).cast("string"), F.lit(""))
    of = edges.select(F.col("src").alias("id"), graph.alias("graph")).unionByName(edges.select(F.col("dst").alias("id"), graph.alias("graph"))).distinct()
    ranked = ranked.join(of, "id")
    order = W.partitionBy("graph", "level").orderBy("first", "component", F.asc_nulls_last("rank"), "id")
    return ranked.withColumn("first", first).select("id", "component", "level", F.row_number().over(order).cast("long").alias("place"))


def _closing(inner: DataFrame, fold: int) -> DataFrame:
    """``(loop, depth, src, dst)``: the edges of ``inner(loop, depth, src, dst, to)`` that close a cycle of a loop's own part of the graph: those
    of a strong component to its first node by rank ``to``. Loops of up to ``fold`` edges are folded, many in a task."""
    big = materialize(inner.groupBy("loop").count().where(F.col("count") > fold).select("loop"))
    kinds = dict(inner.dtypes)

    def run(group: pa.Table) -> pa.Table:
        loop, src, dst = (group.column(c).combine_chunks() for c in ("loop", "src", "dst"))
        names, loops = pc.unique(pa.concat_arrays([src, dst])), pc.index_in(loop, pc.unique(loop)).to_numpy().astype(np.int64)
        x, y = (loops * len(names) + pc.index_in(c, names).to_numpy() for c in (src, dst))
        part = _parts(x, y)
        at = np.flatnonzero(part[0] == part[1])
        kept, part = group.take(pa.array(at)), part[1][at].tolist()
        y = y[at].tolist()
        order = pc.sort_indices(kept.select(["to", "dst"]), sort_keys=[("to", "ascending"), ("dst", "ascending")], null_placement="at_start").to_pylist()
        first: dict = {}
        for i in order:
            first.setdefault(part[i], y[i])
        return kept.take(pa.array([i for i, n in enumerate(y) if first[part[i]] == n], pa.int64())).select(["loop", "depth", "src", "dst"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("loop", "depth", "src", "dst"))
    if big.isEmpty():
        return _folded(inner, "loop", run, schema, fold)
    folded = _folded(materialize(inner.join(big, "loop", "left_anti")), "loop", run, schema, fold)
    # A node is told by its loop and its id.
    node = lambda c: F.to_json(F.struct("loop", F.col(c).alias("id")))
    keyed = materialize(inner.join(big, "loop", "left_semi").withColumns({"x": node("src"), "y": node("dst")}))
    ends = keyed.select("loop", F.col("x").alias("src"), F.col("y").alias("dst"))
    closed = cyclic(ends.select("src", "dst"), strong_components(ends, within="loop", fold=fold)).select(F.col("src").alias("x"), F.col("dst").alias("y"), "component")
    closed = materialize(keyed.join(closed, ["x", "y"]).select("loop", "depth", "src", "dst", "to", "component"))
    heads = closed.groupBy("component").agg(F.min(F.struct("to", "dst")).alias("head")).select("component", F.col("head.dst").alias("dst"))
    return folded.unionByName(closed.join(heads, ["component", "dst"]).select("loop", "depth", "src", "dst"))


def cut_cycle_edges(edges: DataFrame, nodes: DataFrame, loops: DataFrame, *, fold: int = 100_000) -> DataFrame:
    """``edges(src, dst, …)`` without cycles whose nodes share a loop: ``(src, dst, …, cut)``.

    ``nodes(id, rank, loopIds)`` name the loops around a node, outermost first, ``loops(id, exitNodeId)`` their
    exits. In each loop's own part of the graph every strong component with a cycle gives up the edges to its first
    node by rank, which close it; they lead to the exit of the innermost loop that they close, unless that exit
    lies in the loop or the edge is there already. This is repeated until no such cycle is left: rounds follow the
    nesting of loops. Cycles of nodes without a common loop stay. Edges that were sent to an exit have ``cut``.
    """
    held = materialize(nodes.select("id", "rank", F.posexplode("loopIds").alias("depth", "loop")))
    exits = loops.select(F.col("id").alias("loop"), F.col("exitNodeId").alias("exit"))
    inside = held.select("loop", F.col("id").alias("exit"), F.lit(True).alias("inner"))
    exits = materialize(exits.join(inside, ["loop", "exit"], "left").select("loop", F.when(F.col("inner").isNull(), F.col("exit")).alias("exit")))
    more = [c for c in edges.columns if c not in ("src", "dst")]
    now = materialize(edges.withColumn("cut", F.lit(False)))
    a = held.select(F.col("id").alias("src"), "loop", "depth")
    b = held.select(F.col("id").alias("dst"), "loop", F.col("rank").alias("to"))
    placed = lambda pairs: materialize(pairs.join(a, "src").join(b, ["dst", "loop"]).select("loop", "depth", "src", "dst", "to"))
    inner = placed(now.where("src is not null and dst is not null").select("src", "dst").distinct())
    asked = inner
    while True:
        closing = materialize(_closing(asked, fold))
        if closing.isEmpty():
            release(inner, asked, closing)
            return now.select("src", "dst", *more, "cut")
        cut = closing.groupBy("src", "dst").agg(F.max_by("loop", F.struct("depth", "loop")).alias("loop"))
        cut = materialize(cut.join(exits, "loop", "left").select("src", "dst", "exit", F.lit(True).alias("closes")))
        told = now.join(cut, ["src", "dst"], "left")
        kept = told.where("closes is null").select("src", "dst", *more, "cut")
        sent = told.where("closes and exit is not null").select("src", F.col("exit").alias("dst"), *more, F.lit(True).alias("cut"))
        # Several edges of one node may meet at an exit: the one of the smallest other columns stays.
        sent = sent.groupBy("src", "dst").agg(F.min(F.struct(*more, "cut")).alias("x")).select("src", "dst", *(F.col("x")[c].alias(c) for c in (*more, "cut")))
        sent = sent.join(kept.select("src", "dst"), ["src", "dst"], "left_anti")
        sent = materialize(sent)
        before, now = now, materialize(kept.unionByName(sent))
        # A loop without a cycle stays without one until an edge is sent into it, so only the others are looked at again.
        added = placed(sent.select("src", "dst"))
        again = materialize(closing.select("loop").unionByName(added.select("loop")).distinct())
        past, inner = (inner, asked), materialize(inner.join(cut.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(added))
        asked = materialize(inner.join(again, "loop", "left_semi"))
        release(before, closing, cut, sent, added, again, *past)
