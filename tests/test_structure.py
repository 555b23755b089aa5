"""Branch metadata, gates, retained calls and label groups on small literal tables."""

from pyspark.sql import functions as F

from callweave.functions import signature
from callweave.functions.guards import GUARDS
from callweave.operators import branches, bundle, gates

ARMS = "array<struct<label:string,empty:boolean,exits:array<struct<kind:string,destinationNodeId:string>>>>"


def test_branches_are_refreshed(spark):
    groups = spark.createDataFrame([("g", [("if", False, [("fall", "x"), ("throw", None)]), ("else", True, [("fall", "gone")])], [("h", "if"), ("lost", "if")]), ("h", [], [])], f"id string, arms {ARMS}, enclosing {GUARDS}")
    nodes = spark.createDataFrame([("x", "call", [("g", "else")]), ("s", "structure", [("g", "if")])], f"id string, type string, branchArms {GUARDS}")
    got = {r["id"]: r for r in branches.refresh_branches(groups, nodes).collect()}
    one, two = got["g"]["arms"]
    assert (one["label"], one["empty"], [tuple(e) for e in one["exits"]]) == ("if", True, [("fall", "x"), ("throw", None)])
    assert (two["label"], two["empty"], [tuple(e) for e in two["exits"]]) == ("else", False, [("fall", None)])
    assert [tuple(r) for r in got["g"]["enclosing"]] == [("h", "if")] and got["h"]["arms"] == []


def test_guards_from_memberships(spark):
    nodes = spark.createDataFrame([("a", [("g", "if")]), ("b", [("g", "if"), ("h", "x")]), ("c", [("g", "else")])], f"id string, branchArms {GUARDS}")
    edges = spark.createDataFrame([("a", "b", "sequence", []), ("a", "c", "sequence", []), ("a", "z", "sequence", [[("k", "1")], [("k", "2")], [("k", "2")], [("g", "else")]])], f"src string, dst string, type string, alternatives array<{GUARDS}>")
    got = sorted((r["src"], r["dst"], [tuple(g) for g in r["reqs"]]) for r in branches.derive_guards(edges, nodes).collect())
    assert got == [("a", "b", [("g", "if"), ("h", "x")]), ("a", "z", [("g", "if"), ("k", "1")]), ("a", "z", [("g", "if"), ("k", "2")])]


def nested(spark):
    i, e, n = ("o", "if"), ("o", "else"), ("n", "if")
    rows = [("m", "pre", 0, "r0", [], True), ("m", "oa", 1, "r1", [i], True), ("m", "ia", 2, "r2", [i, n], True), ("m", "ob", 3, "r3", [e], False), ("m", "q", 4, "r4", [("drop", "if")], False), ("m", "join", 5, "r5", [], True), ("m", "after", 6, "r5", [], True)]
    return branches.nest_structure(spark.createDataFrame(rows, f"method string, id string, rank int, run string, arm_path {GUARDS}, eligible boolean"))


def test_nested_structure(spark):
    items, arms = nested(spark)
    got = sorted((len(r["container"]), r["ordinal"], r["kind"], r["key"], r["members"]) for r in items.collect())
    assert got == [(0, 1, "run", "r0", ["pre"]), (0, 2, "branch", "o", []), (0, 3, "run", "r5", ["join", "after"]), (1, 1, "run", "r1", ["oa"]), (1, 2, "branch", "n", []), (2, 1, "run", "r2", ["ia"])]
    assert sorted((r["key"], r["arm"], r["ordinal"], r["empty"]) for r in arms.collect()) == [("n", "if", 1, False), ("o", "else", 2, True), ("o", "if", 1, False)]


def test_frontiers_of_retained_calls(spark):
    items, _ = nested(spark)
    ends = {"o": (["oa"], ["ia"]), "n": (["ia"], ["ia"])}
    pick = lambda at: F.coalesce(*(F.when(F.col("key") == k, F.array(*map(F.lit, v[at]))) for k, v in ends.items()), F.array(F.get("members", F.lit(0) if at == 0 else F.size("members") - 1)))
    kept = spark.createDataFrame([("m", x) for x in ("pre", "ia", "join", "after")], "method string, id string")
    got = {r["id"]: (r["before"], r["after"]) for r in gates.retained_frontiers(items.withColumns({"entry": pick(0), "exit": pick(1)}), kept).collect()}
    assert got == {"pre": ([], ["oa"]), "ia": (["oa"], ["join"]), "join": (["ia"], ["after"]), "after": (["join"], [])}


def members(spark):
    return spark.createDataFrame([("m", "p1", 0, "a", 0), ("m", "p2", 1, "b", 0), ("m", "p2", 1, "c", 1), ("m", "p3", 2, "d", 0)], "method string, phase string, at int, id string, seq int")


def test_answers_merge_split_and_lapse(spark):
    open_gates = spark.createDataFrame([("m", "g1", "c", "d", 0), ("m", "g2", "a", "b", 1), ("m", "g3", "a", "d", 2), ("m", "g4", "b", "c", 3)], "method string, gate string, left_id string, right_id string, pos int")
    answers = spark.createDataFrame([("m", "g1", "MERGE", 0.9, ["x"]), ("m", "g2", "MERGE", 0.8, ["x"]), ("m", "g3", "SPLIT", 0.8, ["x"]), ("m", "g4", "LATER", 1.0, ["x"])], "method string, gate string, action string, confidence double, evidence array<string>")
    got, left, log = gates.resolve_gates(members(spark), open_gates, answers)
    assert [(r["id"], r["phase"], r["at"]) for r in got.orderBy("seq").collect()] == [("a", "p1", 0), ("b", "p1", 0), ("c", "p1", 0), ("d", "p1", 0)]
    assert [r["gate"] for r in left.collect()] == ["g4"] and sorted(r["gate"] for r in log.collect()) == ["g1", "g2"]
    same, _, none = gates.resolve_gates(members(spark), open_gates, answers.limit(0))
    assert same.count() == 4 and none.count() == 0


def test_questions_of_open_gates(spark):
    open_gates = spark.createDataFrame([("m", "g", "a", "b", ["inputs:0.50", gates.DISJOINT]), ("m", "shut", "b", "c", [gates.DISJOINT])], "method string, gate string, left_id string, right_id string, evidence array<string>")
    dims = ", ".join(f"{d} array<string>" for d in signature.DIMENSIONS)
    told = spark.createDataFrame([{"id": i, "observed": ["inputs"], **{d: [] for d in signature.DIMENSIONS}, "inputs": v} for i, v in (("a", ["u"]), ("b", ["v", "w"]), ("c", ["w"]))], f"id string, observed array<string>, {dims}")
    rows = members(spark).withColumns({"callee": F.upper("id"), "code": F.lit(None).cast("string")})
    (q,) = gates.gate_questions(open_gates, rows, told).collect()
    assert (q["question"], q["reason"], q["left_signature"], q["right_signature"]) == ("question:m:g", "CONFLICTING_EVIDENCE", ["inputs:u"], ["inputs:w"])
    assert [o["callee"] for o in q["right_operations"]] == ["B", "C"] and "inputs" not in q["left_missing"] and len(q["left_missing"]) == len(signature.DIMENSIONS) - 1


def test_delegation_and_labels(spark):
    ph = spark.createDataFrame([("a1", "a", ["x"]), ("b1", "b", ["y"]), ("c1", "c", ["z", "w"]), ("d1", "d", ["k"])], "phase_id string, method string, ids array<string>")
    made = spark.createDataFrame([("x", "b", False), ("y", "c", False), ("k", "c", True)], "id string, target string, retained boolean")
    counts = spark.createDataFrame([(m, 1) for m in "abcd"], "method string, count int")
    groups = gates.delegation_groups(ph, made, counts)
    assert sorted(map(tuple, groups.collect())) == [("item-1", "a1"), ("item-1", "b1"), ("item-1", "c1"), ("item-2", "d1")]
    said = gates.attach_labels(groups, spark.createDataFrame([("item-1", "load order")], "item string, label string"))
    assert {r[0]: r[1] for r in said.collect()} == {"a1": "load order", "b1": "load order", "c1": "load order", "d1": None}
    told = gates.phase_evidence(groups, ph, F.col("method"))
    assert {r[0]: r[1] for r in told.collect()} == {"item-1": ["a", "b", "c"], "item-2": ["d"]}


def test_documentation_text(spark):
    rows = spark.createDataFrame([("p", "", "x" * 600), ("q", "a.b", None)], "path string, package string, text string")
    assert {r[0]: r[1] for r in bundle.documentation_text(rows).collect()} == {"p": "[root] " + "x" * 500, "q": "[a.b] "}


def test_bundle_json(spark):
    made = bundle.method_bundle(spark.createDataFrame([("m",), ("n",)], "entry_id string"), exits=spark.createDataFrame([("m", "z"), ("m", "a")], "entry_id string, id string"))
    assert {r[0]: r[1] for r in bundle.bundle_json(made).collect()} == {"m": '{"entry_id":"m","exits":[{"id":"a"},{"id":"z"}]}', "n": '{"entry_id":"n","exits":[]}'}
