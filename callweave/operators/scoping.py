"""Which nodes, features, groups and edges belong to a method or an operation, and joins along the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.operators.graph import reach
from callweave.session import Rounds, materialize


def scoped_features(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Features ``(node_id, …)`` of the nodes ``ids(id)``."""
    return features.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def group_methods(groups: DataFrame, tags: DataFrame) -> DataFrame:
    """``(group, method)``: a group's own method or, where it has none, the methods of its members.

    ``groups(id, method)``, ``tags(group, method)`` the memberships of nodes with the method of each.
    """
    own = groups.where("method is not null").select(F.col("id").alias("group"), "method")
    free = groups.where("method is null").select(F.col("id").alias("group"))
    return own.unionByName(tags.where("method is not null").join(free, "group", "left_semi").select("group", "method")).distinct()


def outbound_invokes(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Invoke edges with the method that their source belongs to, ``owners(id, owner_entry_id)``."""
    return edges.where("type = 'invoke'").join(owners.select(F.col("id").alias("src"), "owner_entry_id"), "src").select("owner_entry_id", "src", "dst")


def direct_flow(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct data edges ``(src, dst)`` whose both ends are calls."""
    calls = nodes.where("type = 'call'").select("id")
    ends = edges.where("type = 'data'").select("src", "dst")
    for side in ("src", "dst"):
        ends = ends.join(calls.select(F.col("id").alias(side)), side, "left_semi")
    return ends.select("src", "dst").distinct()


def flow_questions(pairs: DataFrame) -> DataFrame:
    """``(dst, n, first, last)`` of the distinct sources of every target of ``pairs(src, dst)``; the pairs themselves stay a table."""
    return pairs.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("first"), F.max("src").alias("last"))


def attach_data_edges(edges: DataFrame, data: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges(src, dst, type)`` with the distinct data edges whose both ends are nodes."""
    for side in ("src", "dst"):
        data = data.join(nodes.select(F.col("id").alias(side)), side, "left_semi")
    return edges.select("src", "dst", "type").unionByName(data.select("src", "dst", F.lit("data").alias("type"))).distinct()


def cells(low: Column, high: Column, widths: Column | None = None) -> Column:
    """The least set of cells ``(level, cell)`` that makes up [low, high]: of level k are runs of 2^k numbers that begin at a multiple of it.

    Levels up to ``widths`` are tried, 62 by default; the number of bits of ``high`` + 1 is enough above zero.
    """
    state = F.struct(low.alias("l"), (high + 1).alias("r"), F.expr("cast(array() as array<struct<level:int,cell:bigint>>)").alias("cells"))

    def halve(s: Column, k: Column) -> Column:
        open_, odd = s["l"] < s["r"], lambda c: c.bitwiseAND(F.lit(1)) == 1
        left, right = open_ & odd(s["l"]), open_ & odd(s["r"])
        one = lambda yes, c: F.when(yes, F.array(F.struct(k.alias("level"), c.alias("cell")))).otherwise(F.expr("cast(array() as array<struct<level:int,cell:bigint>>)"))
        further = F.concat(s["cells"], one(left, s["l"]), one(right & (~left | (s["l"] + 1 < s["r"])), s["r"] - 1))
        return F.struct(F.shiftright(s["l"] + left.cast("long"), 1).alias("l"), F.shiftright(s["r"] - right.cast("long"), 1).alias("r"), further.alias("cells"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62) if widths is None else widths), state, halve, lambda s: s["cells"])


def _counted(spans: DataFrame, points: DataFrame, *, by: str, at: str, end: str, side: int, name: str) -> DataFrame:
    """``spans`` with the number of ``points`` of their ``by`` that lie before ``end`` (side 0) or not behind it (side 2)."""
    marks = points.select(by, F.col(at).alias("__x"), F.lit(1).alias("__side"))
    marks = marks.unionByName(spans.select(by, F.col(end).alias("__x"), F.lit(side).alias("__side"), F.struct("*").alias("__span")), allowMissingColumns=True)
    order = W.partitionBy(by).orderBy("__x", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return marks.withColumn(name, F.count_if(F.col("__side") == 1).over(order)).where("__span is not null").select("__span.*", name)


def within_lines(points: DataFrame, spans: DataFrame, *, by: str, at: str = "line", low: str = "start", high: str = "end") -> DataFrame:
    """Points of ``points(by, at, …)`` with every span ``(by, low, high, …)`` they lie in, ends included; no end: the start; no start: none.

    Points are ranked within ``by``, and a span becomes the range of the ranks that lie in it, so a span without a
    point is gone. Ranges are cut into cells of doubling width, two of a width at most, which are never more than the
    points in it. A point lies in one cell of each width, and in at most one cell of a span, so an equal join on cells
    gives each row of the result once and no other row, whatever a file holds. The points of one value of ``by`` are
    sorted in one task. Ends before the start hold nothing.
    """
    kind = dict(points.dtypes)[at]
    if kind not in ("timestamp", "timestamp_ntz", "date", "tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"points of type {kind} have no cells")
    points = points.where(F.col(at).isNotNull() & F.col(by).isNotNull())
    bound = spans.where(F.col(low).isNotNull() & F.col(by).isNotNull()).withColumn(high, F.coalesce(F.col(high), F.col(low)))
    bound = _counted(bound, points, by=by, at=at, end=low, side=0, name="__before")
    bound = _counted(bound, points, by=by, at=at, end=high, side=2, name="__through").where("__before < __through")
    # Ties have the rank of their first, so all of them or none lie in a range.
    bits = F.length(F.bin(F.col("__through") + 1))
    bound = materialize(bound.withColumn("__cell", F.explode(cells(F.col("__before") + 1, F.col("__through"), bits))).drop("__before", "__through"))
    # At most 63 widths.
    widths = sorted(r[0] for r in bound.select("__cell.level").distinct().collect())
    mine = lambda k: F.struct(F.lit(k).alias("level"), F.shiftright(F.col("__rank"), k).alias("cell"))
    none = F.expr("cast(array() as array<struct<level:int,cell:bigint>>)")
    ranked = points.withColumn("__rank", F.rank().over(W.partitionBy(by).orderBy(at)).cast("long"))
    placed = ranked.withColumn("__cell", F.explode(F.array(*map(mine, widths)) if widths else none)).drop("__rank")
    # Cells are written small and are many in memory: they are never broadcast.
    return placed.join(bound.hint("merge"), [by, "__cell"]).drop("__cell")


def memberships(edges: DataFrame, operations: DataFrame) -> DataFrame:
    """``(method, operation)`` for every operation ``(operation, entry)`` and method that it reaches over ``edges(src, dst)``, itself included."""
    found = reach(edges, operations.select(F.col("operation").alias("root"), F.col("entry").alias("id")))
    return found.select(F.col("id").alias("method"), F.col("root").alias("operation")).distinct()


def operation_documents(members: DataFrame, documents: DataFrame) -> DataFrame:
    """``(operation, method, pos, name, …document)``: an operation's distinct methods in order of their first ``pos``, each with its
    document; without one, the full name stands for it. ``members(operation, method, pos)``, ``documents(fullName, methodName, …)``."""
    first = members.groupBy("operation", "method").agg(F.min("pos").alias("pos"))
    found = first.join(documents.withColumnRenamed("fullName", "method"), "method", "left")
    return found.withColumn("name", F.coalesce("methodName", "method")).drop("methodName")


def traversal_rank(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, id, rank)`` of a breadth-first visit from every root, each node once, from 0.

    ``edges(src, dst, pos)``, ``roots(root, id)``. Nodes of a level come in the order of the parent that meets them first, then of
    the edge's ``pos``, then of their id. A round is a level of all roots at once.
    """
    steps = edges.select(F.col("src").alias("id"), "dst", "pos")
    seen = Rounds()
    frontier = seen.add(roots.select("root", "id", F.lit(0).cast("long").alias("rank")).distinct())
    while not frontier.isEmpty():
        met = frontier.join(steps, "id").groupBy("root", F.col("dst").alias("id")).agg(F.min(F.struct("rank", "pos")).alias("by"))
        new = met.join(seen.all().select("root", "id"), ["root", "id"], "left_anti")
        before = seen.all().groupBy("root").agg(F.count("*").alias("n"))
        place = F.row_number().over(W.partitionBy("root").orderBy("by", "id")) - 1
        frontier = seen.add(new.withColumn("at", place).join(before, "root").select("root", "id", (F.col("n") + F.col("at")).alias("rank")))
    return seen.all()


def boundary_pairs(items: DataFrame) -> DataFrame:
    """``(method, container, ordinal, left, right)``: every exit frontier of an item with every entry frontier of the next one.

    ``items(method, container, ordinal, entry, exit)`` are siblings in order; an item without a frontier pairs with none.
    """
    order = W.partitionBy("method", "container").orderBy("ordinal")
    both = items.withColumn("next", F.lead("entry").over(order)).where("next is not null")
    left = both.select("method", "container", "ordinal", "next", F.explode("exit").alias("left"))
    return left.select("method", "container", "ordinal", "left", F.explode("next").alias("right"))


def evidence(names: DataFrame) -> DataFrame:
    """``(owner, kind, value, pos)`` from ``names(owner, kind, value, pos)``: distinct values of an owner and kind with their first place; literals lose their outer quotes, blank values go."""
    plain = F.when(F.col("kind") == "literal", F.regexp_replace("value", r"""^(["'])(.*)\1$""", "$2")).otherwise(F.col("value"))
    kept = names.withColumn("value", plain).where(F.trim("value") != "")
    return kept.groupBy("owner", "kind", "value").agg(F.min("pos").alias("pos"))


def call_features(tokens: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row a call with a sorted distinct list for each of ``kinds``, and ``observed``, the kinds that were met, from ``tokens(node_id, kind, value)``.

    A call's list is bounded by its text; a kind that was seen without a value (null) counts as observed.
    """
    lists = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in kinds]
    return tokens.where(F.col("kind").isin(*kinds)).groupBy("node_id").agg(*lists, F.array_sort(F.collect_set("kind")).alias("observed"))
