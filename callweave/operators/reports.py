"""Statistics of graphs, sources and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, name, n)``: nodes and edges by type."""
    count = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n"))
    return count(nodes, "node").unionByName(count(edges, "edge"))


def graph_totals(nodes: DataFrame, edges: DataFrame, kinds: DataFrame, branches: DataFrame, loops: DataFrame) -> DataFrame:
    """One row: nodes and edges, in all and by type, roots and orphans of ``kinds(id, kind)``, branch and loop groups."""
    by = lambda df, column, values: df.agg(F.count("*").alias("n"), *(F.count_if(F.col(column) == v).alias(v) for v in values))
    n = by(nodes, "type", ("entry", "call", "leaf", "exit")).selectExpr("n as nodes", "entry as entry_nodes", "call as call_nodes", "leaf as leaf_nodes", "exit as exit_nodes")
    e = by(edges, "type", ("sequence", "invoke", "data")).selectExpr("n as edges", "sequence as sequence_edges", "invoke as invoke_edges", "data as data_edges")
    k = by(kinds, "kind", ("root", "orphan")).selectExpr("root as roots", "orphan as orphans")
    groups = [df.agg(F.count("*").alias(name)) for df, name in ((branches, "branch_groups"), (loops, "loop_groups"))]
    return reduce(DataFrame.crossJoin, [n, e, k, *groups])  # single rows


def source_stats(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """One row: files, bytes, lines by ``line_stats`` and type declarations of all files."""
    declared = F.size(F.regexp_extract_all(text, F.lit(r"(\b(?:class|interface|enum|record)\s+[A-Za-z_$][\w$]*)"), F.lit(1)))
    whole = files.agg(F.count("*").alias("files"), F.sum(F.octet_length(text)).alias("bytes"), F.sum(declared).cast("long").alias("declared_types"))
    lines = line_stats(files, key=key, text=text).agg(*(F.sum(c).alias(f"{c}_lines") for c in ("physical", "blank", "comment", "source")))
    return whole.crossJoin(lines)


def recorded_totals(stages: DataFrame, calls: DataFrame, batches: DataFrame, *, by: str = "run_id") -> DataFrame:
    """A run's stages, requests, their successes, its tokens and its retried, unresolved and oversized items; a run that a table lacks has 0 there.

    ``stages(by, success)``, ``calls(by, success, input_tokens, output_tokens, total_tokens)``,
    ``batches(by, retry_items, unresolved_items, oversized_items)``.
    """
    tables = [
        stages.groupBy(by).agg(F.count("*").alias("stages"), F.count_if("success").alias("successful_stages")),
        calls.groupBy(by).agg(F.count("*").alias("requests"), F.count_if("success").alias("successful_requests"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens"))),
        batches.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("retry_items", "unresolved_items", "oversized_items"))),
    ]
    return reduce(lambda a, b: a.join(b, by, "full"), tables).fillna(0)


def line_stats(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """``(key, physical, blank, comment, source)`` lines; a line inside of a block comment is a comment.

    A line opens a block if it begins with ``/*`` and does not close it; whether one is open at a line is told
    by the last opening or closing line before it.
    """
    lines = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    bare = lines.withColumn("s", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    opens = F.col("s").startswith("/*") & ~F.substr("s", F.lit(3)).contains("*/")
    event = F.when(F.col("s").contains("*/"), 0).when(opens, 1)
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    state = bare.withColumn("inside", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(0)) == 1)
    blank = F.col("s") == ""
    comment = ~blank & (F.col("inside") | F.col("s").startswith("//") | F.col("s").startswith("/*"))
    n = lambda c, name: F.count_if(c).alias(name)
    return state.groupBy(key).agg(F.count("*").alias("physical"), n(blank, "blank"), n(comment, "comment"), n(~blank & ~comment, "source"))


def run_totals(log: DataFrame, *, by: str) -> DataFrame:
    """Calls, successes and summed duration of a call log."""
    return log.groupBy(by).agg(F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.sum("duration").alias("duration"))
