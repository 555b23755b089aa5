"""Grouping answers, drill-down, assignment, names, orders and totals on small tables."""

import pytest
from pyspark.sql import functions as F

from callweave.functions import names
from callweave.operators import batches, graph, instances, reports, topics


def grouped(spark, *groups):
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    members, bad = batches.grouping_members(spark.createDataFrame(list(groups), "pos int, label string, members array<string>"), known)
    return {r["name"]: r["label"] for r in members.collect()}, sorted(tuple(r) for r in bad.collect())


def test_grouping_answers_are_taken_whole_or_not_at_all(spark):
    assert grouped(spark, (3, "One", ["a", "c"]), (7, "Two", ["b"])) == ({"a": 0, "c": 0, "b": 1, "d": -1}, [])
    void = dict.fromkeys("abcd", -1)
    rows = [(0, " ", ["a"]), (1, "X", ["b", "b"]), (2, " x", []), (3, "y", ["b", "z", None])]
    assert grouped(spark, *rows) == (void, sorted([("blank-label", "0"), ("member-twice", "b"), ("label-twice", "x"), ("no-members", "2"), ("no-text", "3"), ("unknown-member", "z"), ("two-groups", "b")]))


def test_answers_are_held_against_what_was_asked(spark):
    text = '{"id":"a","n":1}{"id":"b","n":2}\n{"id":"b","n":3}\n{"id":"c"}\n{"id":9,"n":1}\n[1]\n{"id":"z","n":1}\n{"id":"d","n":1,"m":2}\noops\n{"id":"f","n":-1}'
    asked = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    scanned = batches.scan_records(spark.createDataFrame([(text,)], "text string"), "id string, n int")
    found, reasons = batches.correlated(asked, scanned, required=("id", "n"), exact=True, valid=lambda r: r["n"] > 0)
    assert [(r["id"], r["record"]["n"]) for r in found.collect()] == [("a", 1)]
    assert {r["reason"]: r["n"] for r in reasons.collect()} == {"malformed_json": 1, "concatenated_json": 1, "invalid_value": 5, "invented_id": 1, "duplicate_id": 1, "missing_id": 1}
    loose, _ = batches.correlated(asked, scanned, required=("id",))
    assert sorted(r["id"] for r in loose.collect()) == ["a", "c", "d", "f"]


def test_topics_are_called_by_answer_term_or_number(spark):
    rows = [(0, " Orders ", ["x"]), (1, " ", [" ", "tax"]), (2, None, None), (-1, None, [])]
    df = spark.createDataFrame(rows, "label int, llm string, terms array<string>")
    args = (F.col("llm"), F.col("terms"), F.col("label"))
    assert {r[0]: (r[1], r[2]) for r in df.select("label", topics.display_label(*args), topics.is_unnamed(*args)).collect()} == {0: ("Orders", False), 1: ("tax", False), 2: ("topic 2", True), -1: ("Unassigned", False)}


def test_drill_down_keeps_all_operations(spark):
    ops = spark.createDataFrame([("o1", "r1"), ("o2", "r2"), ("o3", "r3"), ("o4", "r4")], "op_id string, root string")
    told = spark.createDataFrame([("o1", 0, 0.5), ("o2", 0, 0.7), ("o3", 0, 0.1)], "op_id string, label int, similarity double")
    found = topics.drill_down(ops, told, spark.createDataFrame([("o1", "beta"), ("o2", "Alpha"), ("o3", "")], "op_id string, label string"))
    assert sorted(tuple(r) for r in found.collect()) == [(-1, 1, "o4", "o4", "r4", 0.0), (0, 1, "o2", "Alpha", "r2", 0.7), (0, 2, "o1", "beta", "r1", 0.5), (0, 3, "o3", "o3", "r3", 0.1)]


def test_operations_are_assigned_by_what_formed_the_topics(spark):
    ops = spark.createDataFrame([("o1", "a"), ("o2", " "), ("o3", "b")], "op_id string, text string")
    made = spark.createDataFrame([(0, [1.0, 0.0], False), (1, [0.0, 1.0], False)], "label int, centroid array<double>, fallback boolean")
    embedder = lambda df: df.select("op_id", F.when(F.col("text") == "a", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8))).alias("embedding"))
    got = topics.assign_operations(ops, made, embedder=embedder)
    assert sorted((r["op_id"], r["label"], round(r["similarity"], 6)) for r in got.collect()) == [("o1", 0, 1.0), ("o3", 1, 0.8)]
    fallen = made.withColumn("fallback", F.col("label") == 1)
    with pytest.raises(ValueError):
        topics.assign_operations(ops, fallen, embedder=embedder)
    told = spark.createDataFrame([("o2", 1), ("o3", None), ("zz", 0)], "op_id string, label int")
    assert [tuple(r) for r in topics.assign_operations(ops, fallen, embedder=embedder, answers=told).collect()] == [("o2", 1, 1.0)]


def test_names_of_documents(spark):
    rows = ["run", "<init>", "<clinit>", "access$000", "lambda$x$3", "A$1", "this", "$tmp", None]
    df = spark.createDataFrame([(r,) for r in rows], "n string")
    got = {r[0]: tuple(r)[1:] for r in df.select("n", names.is_synthetic(F.col("n")), names.is_document_method(F.col("n")), names.is_document_identifier(F.col("n"))).collect()}
    assert got["run"] == (False, True, True) and got["<init>"] == (True, True, False) and got["this"][2] is False and got["$tmp"][2] is False
    assert all(got[n] == (True, False, False) for n in ("<clinit>", "access$000", "lambda$x$3", "A$1"))
    assert df.where("n is not null").select(names.is_document_type(F.col("n"), F.concat(F.lit("java.io."), "n")).alias("x")).where("x").count() == 0


def test_roots_are_in_order_and_totals_are_whole(spark):
    kinds = spark.createDataFrame([(f"n{i:02}", "root" if i % 3 else "orphan") for i in range(20)], "id string, kind string")
    found = graph.ordered_roots(kinds).collect()
    for kind in ("root", "orphan"):
        rows = sorted((r["place"], r["id"]) for r in found if r["kind"] == kind)
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1)) and [i for _, i in rows] == sorted(i for _, i in rows)
    nodes = spark.createDataFrame([("entry",), ("call",), ("call",), ("odd",)], "type string")
    edges = spark.createDataFrame([("sequence",), ("data",)], "type string")
    totals = reports.graph_totals(nodes, edges, kinds, nodes.limit(1), nodes.limit(0)).first()
    assert (totals["nodes"], totals["call_nodes"], totals["leaf_nodes"], totals["edges"], totals["data_edges"], totals["roots"], totals["orphans"], totals["branch_groups"], totals["loop_groups"]) == (4, 2, 0, 2, 1, 13, 7, 1, 0)
    source = "enum E {}\r\n\r\n/* x\n y */\ninterface I {} class C {}"
    stats = reports.source_stats(spark.createDataFrame([("a", source), ("b", "")], "path string, text string")).first()
    assert (stats["files"], stats["bytes"], stats["declared_types"], stats["comment_lines"], stats["source_lines"]) == (2, len(source.encode()), 3, 2, 2)


def test_runs_add_up(spark):
    stages = spark.createDataFrame([("r", True), ("r", False), ("s", True)], "run_id string, success boolean")
    calls = spark.createDataFrame([("r", True, 3, None, 5)], "run_id string, success boolean, input_tokens int, output_tokens int, total_tokens int")
    left = spark.createDataFrame([("r", 1, 0, 2), ("r", 1, 1, 0)], "run_id string, retry_items int, unresolved_items int, oversized_items int")
    got = {r["run_id"]: tuple(r)[1:] for r in reports.recorded_totals(stages, calls, left).collect()}
    assert got == {"r": (2, 1, 1, 1, 3, 0, 5, 2, 1, 2), "s": (1, 1, 0, 0, 0, 0, 0, 0, 0, 0)}


def test_rounds_repack_what_is_open(spark):
    """Against a plain reading of the rounds: greedy batches, answers as context, oversized items, repeated and foreign answers."""
    sizes, room = (3, 2, 1), 3 * 20
    rows = [(k, f"{k}{i}", i, 5 + 7 * i % 23 + (70 if i == 4 else 0)) for k in "ab" for i in range(9)]

    def answers(asked, attempt):
        """(batch, id, answer) of one key's batches, by rule."""
        out = []
        for b, ids in enumerate(asked):
            for x in ids:
                n = int(x[1])
                if n % 3 <= attempt:
                    out += [(b, x, f"{x}-{attempt}")] * (2 if n == 3 and attempt == 0 else 1)
                if n == 7:
                    out.append((b, "a0", "foreign"))
        return out

    want, large, open_, sent, retried, known = {}, {}, list(rows), 0, 0, 0
    for attempt, most in enumerate(sizes):
        retried += len(open_) * (attempt > 0)
        extra = 2 * known
        got = []
        for k in "ab":
            packs = []
            for _, x, _, s in sorted((r for r in open_ if r[0] == k), key=lambda r: r[2]):
                if packs and len(packs[-1][0]) < most and packs[-1][1] + s + extra <= room:
                    packs[-1][0].append(x)
                    packs[-1][1] += s
                else:
                    packs.append([[x], s])
            asked = [ids for ids, s in packs if not (len(ids) == 1 and s + extra > room)]
            large |= {ids[0]: attempt for ids, s in packs if len(ids) == 1 and s + extra > room}
            sent += len(asked)
            told = answers(asked, attempt)
            for b, ids in enumerate(asked):
                for x in ids:
                    mine = [a for c, y, a in told if c == b and y == x]
                    if len(mine) == 1:
                        got.append((x, mine[0]))
        want |= {x: (a, attempt) for x, a in got}
        known = len(want)
        open_ = [r for r in open_ if r[1] not in want and r[1] not in large]

    def complete(asked, known, attempt):
        by = {}
        for r in asked.collect():
            by.setdefault((r["key"], r["batch"]), []).append(r["id"])
        out = [(k, b, x, a) for (k, b), ids in by.items() for _, x, a in answers([ids], attempt)]
        return spark.createDataFrame(out, "key string, batch long, id string, answer string")

    found, aside, totals = batches.batched_rounds(spark.createDataFrame(rows, "key string, id string, pos int, size int"), complete, sizes=sizes, overhead=lambda known, attempt: 2 * known.count(), max_input=20)
    assert {r["id"]: (r["answer"], r["attempt"]) for r in found.collect()} == want
    assert {r["id"]: r["attempt"] for r in aside.collect()} == large
    assert tuple(totals.first()) == (18, len(want), 18 - len(want), len(large), 3, sent, retried)


def test_instances_follow_choices_and_cut_recursion(spark):
    calls = spark.createDataFrame([("m", "c1", 0, "x"), ("m", "c1", 1, "y"), ("m", "c2", 0, "x"), ("x", "d", 0, "m"), ("y", "e", 0, "y"), ("y", "e", 1, "x")], "method string, call string, pos int, target string")
    nodes = spark.createDataFrame([("m", "m"), ("m", "c1"), ("m", "c2"), ("x", "x"), ("x", "d"), ("y", "y"), ("y", "e")], "method string, node string")
    edges = spark.createDataFrame([("m", "m", "c1"), ("m", "c1", "c2"), ("x", "x", "d"), ("y", "y", "e")], "method string, src string, dst string")
    roots = spark.createDataFrame([("m",), ("m",)], "method string")
    chosen = spark.createDataFrame([("m", "c1", "y"), ("m", "c1", "zz"), ("m/c1/1:y", "e", "x")], "instance string, call string, target string")
    opened = spark.createDataFrame([("m", "c1"), ("m/c1/1:y", "e"), ("m/c1/1:y/e/1:x", "d")], "instance string, call string")
    seen, lines = instances.instantiate(roots, nodes, edges, calls, expanded=opened, chosen=chosen)
    rows = {r["id"]: (r["depth"], r["expandable"], r["expanded"], r["cut"]) for r in seen.collect()}
    x = "m/c1/1:y/e/1:x"
    assert rows == {"m#m": (0, False, False, False), "m#c1": (0, True, True, False), "m#c2": (0, True, False, False), "m/c1/1:y#y": (1, False, False, False), "m/c1/1:y#e": (1, True, True, False), f"{x}#x": (2, False, False, False), f"{x}#d": (2, True, True, True)}
    assert sorted((r["src"], r["dst"], r["type"]) for r in lines.collect()) == sorted([("m#m", "m#c1", "sequence"), ("m#c1", "m#c2", "sequence"), ("m#c1", "m/c1/1:y#y", "invoke"), ("m/c1/1:y#y", "m/c1/1:y#e", "sequence"), ("m/c1/1:y#e", f"{x}#x", "invoke"), (f"{x}#x", f"{x}#d", "sequence")])
    first, _ = instances.instantiate(roots, nodes, edges, calls, max_depth=1)
    assert {r["instance"] for r in first.select("instance").collect()} == {"m", "m/c1/0:x", "m/c2/0:x"}
