"""Sources, scopes, clean-up, checks, answers and the topic pipeline on small literal tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from callweave import session
from callweave.functions import guards, names, signature, text
from callweave.operators import batches, bundle, graph, phases, reports, scoping, topics, validate
from callweave.sources import graphs

ARM = guards.GUARDS
NODES = f"id string, type string, calleeFullName string, callerMethod string, structureGroupId string, structureRole string, targetStructureGroupId string, exitKind string, branchArms {ARM}, loopIds array<string>"


def node(id, type="call", name="work", method="m", group=None, role=None, target=None, exit=None, arms=(), loops=()):
    return (id, type, name, method, group, role, target, exit, list(arms), list(loops))


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("graphs")
    for name in ("one", "two"):
        arms = [{"label": "yes", "exits": [{"kind": "continues", "destinationNodeId": "c2"}]}, {"label": "no", "exits": [{"kind": "return"}]}]
        data = {
            "nodes": [{"id": "e", "type": "entry", "calleeFullName": f"run{name}"}, {"id": "c1", "type": "call", "callerMethod": f"run{name}", "branchArms": [{"groupId": "g", "armLabel": "yes"}]}, {"id": "c2", "type": "call", "callerMethod": "runtwo"}],
            "edges": [{"from": "e", "to": "c1", "type": "sequence"}, {"from": "c1", "to": "c2", "type": "sequence", "branchRequirements": [{"groupId": "g", "armLabel": "yes"}]}] if name == "one" else [],
            "branchGroups": [{"id": "g", "kind": "IF", "entryNodeId": "c1", "arms": arms}],
            "loopGroups": [{"id": "l", "kind": "FOR", "entryNodeId": "c1", "exitNodeId": "c2"}],
            "semanticFeatures": {"c1": {"receiver": "This", "arguments": ["a b", "1.5", "<empty>"], "observedFeatures": ["receiver", "arguments", "other"]}},
        }
        (root / f"{name}.json").write_text(json.dumps(data))
    (root / "docs.json").write_text(json.dumps({"classes": [{"fullName": "A", "className": "A", "methodNames": ["go", "go", " "]}], "methods": [{"fullName": "A.go", "methodName": "go"}]}))
    (root / "sub").mkdir()
    (root / "sub" / "ReadMe.txt").write_bytes(b"hi \xff there")
    (root / "sub" / "notes.MD").write_text("# x")
    (root / "sub" / "A.java").write_text("class A {}")
    return root


def test_graphs_of_two_files_never_meet(spark, files):
    raw = graphs.read_graph(spark, f"{files}/[ot][nw]*.json")
    tables = graphs.scoped(raw)
    assert raw["nodes"].select("id").distinct().count() == 3 and tables["nodes"].select("id").distinct().count() == 6
    found = graph.reach(tables["edges"], tables["nodes"].where("type = 'entry'").select(F.col("id").alias("root"), "id"))
    assert sorted(r[0].rsplit("#")[-1] for r in found.select("id").collect()) == ["c1", "c2", "e", "e"]
    own = graph.owners(tables["nodes"], by=("repo_id",)).join(tables["nodes"].select("id", "repo_id"), "id")
    assert pairs(own.groupBy("repo_id").agg(F.count("*").alias("n")), "n") == [(2,), (3,)]
    branch = tables["branch_groups"].first()
    assert branch["arms"][0]["exits"][0]["destinationNodeId"].endswith("#c2") and branch["arms"][1]["exits"][0]["destinationNodeId"] is None
    assert branch["enclosing"] == [] and tables["loop_groups"].first()["exitNodeId"].endswith("#c2")
    kinds = graph.roots_and_orphans(tables["nodes"], tables["edges"], by=("repo_id",))
    assert pairs(kinds, "kind") == [("root",), ("root",)]


def test_signature_of_features(spark, files):
    row = graphs.read_graph(spark, f"{files}/one.json")["semantic_features"].select(*(c.alias(n) for n, c in signature.signature().items())).first()
    assert (row["receivers"], row["arguments"], row["observed"]) == ([], ["ab"], ["arguments", "receivers"])


def test_documents_and_texts(spark, files, tmp_path):
    docs = graphs.read_documents(spark, f"{files}/docs.json")
    assert docs["classes"].select(text.class_text()).first()[0] == "Class: A\nMethods: go"
    assert docs["classes"].select(text.term_text("methodNames", "comments")).first()[0] == "go"
    assert docs["classes"].select(text.method_text()).first()[0] == "Methods: go"
    assert sorted(r["name"] for r in graphs.scan_texts(spark, f"{files}/sub").collect()) == ["ReadMe.txt", "notes.MD"]
    java = graphs.scan_texts(spark, f"{files}/sub", where="name like '%.java'").first()
    assert (java["n_bytes"], java["text"]) == (10, "class A {}")
    graphs.write_table(docs["classes"].select("fullName", "methodNames", "comments"), f"{tmp_path}/out")
    assert [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()] == [{"fullName": "A", "methodNames": ["go", "go", " "]}]
    with pytest.raises(Exception, match="exist"):
        graphs.write_table(docs["classes"], f"{tmp_path}/out")


def test_names_and_answers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert [get(names.relative_path(F.lit(x), "/src/")) for x in ("/src/a/B.java", "C.java", " ", "<empty>")] == ["a/B.java", "C.java", None, None]
    rows = table(spark, "fullName string", ("a.B.run",), ("java.util.List.add",), ("a.B.access$0",))
    assert pairs(names.filter_methods(rows), "fullName") == [("a.B.run",)]
    assert get(text.strip_fences(F.lit('```json\n{"a": 1}\n```'))).strip() == '{"a": 1}'
    assert get(text.parse_object(F.lit('{"a": 1}'), "a int"))["a"] == 1 and get(text.parse_object(F.lit("[1]"), "a int")) is None
    assert get(text.compact_json(F.lit("é").alias("k"))) == '{"k":"é"}'
    chosen = F.create_map(F.lit("g"), F.lit("yes"))
    held = lambda *rs: F.array(*(F.struct(F.lit(g).alias("groupId"), F.lit(a).alias("armLabel")) for g, a in rs))
    assert get(guards.matches(held(("g", "yes")), chosen)) and not get(guards.matches(held(("g", "no")), chosen)) and not get(guards.matches(held(("h", "yes")), chosen))
    assert get(F.size(guards.without_groups(held(("g", "yes"), ("h", "no")), F.array(F.lit("g"))))) == 1


def test_clean_up_to_a_fixed_point(spark):
    """A loop stays for the branch inside that has a call; a branch of noise alone goes with its anchors, its guards and memberships."""
    nodes = table(
        spark, NODES, node("e", "entry", "m"), node("l1", "structure", None, group="loop", role="entry"), node("b1", "structure", None, group="kept", role="entry", loops=["loop"]), node("c", loops=["loop"], arms=[("kept", "a")]),
        node("d1", "structure", None, group="gone", role="entry"), node("n", name="noise", arms=[("gone", "a")]), node("d2", "structure", None, group="gone", role="exit", arms=[]), node("z"), node("lam", name="noise"), node("body", "entry", "lambda"), node("t", name="<operator>.throw"),
    )
    e = table(
        spark, f"src string, dst string, type string, reqs {ARM}", *((a, b, "sequence", r) for a, b, r in [("e", "l1", []), ("l1", "b1", []), ("b1", "c", [("kept", "a")]), ("c", "d1", []), ("d1", "n", [("gone", "a")]), ("n", "d2", []), ("d1", "d2", [("gone", "b")]), ("d2", "z", []), ("z", "lam", []), ("lam", "t", []), ("t", "z", [])]), ("lam", "body", "invoke", []),
    )
    branches = table(spark, "id string, entryNodeId string", ("kept", "b1"), ("gone", "d1"))
    exits = table(spark, "groupId string, armLabel string, kind string, destination string", ("gone", "a", "continues", "d2"), ("gone", "b", "continues", "d2"), ("kept", "a", "return", None))
    kept, left, groups = graph.clean_graph(nodes, e, branches, table(spark, "id string, entryNodeId string", ("loop", "l1")), exits, noise=F.col("calleeFullName") == "noise", is_lambda=F.col("calleeFullName") == "lambda")
    assert pairs(groups, "id") == [("kept",), ("loop",)]
    assert pairs(kept, "id") == [("b1",), ("body",), ("c",), ("e",), ("l1",), ("lam",), ("t",), ("z",)]
    assert pairs(left, "src", "dst") == [("b1", "c"), ("c", "z"), ("e", "l1"), ("l1", "b1"), ("lam", "body"), ("lam", "t"), ("z", "lam")]
    assert left.where("src = 'c'").first()["reqs"] == []


def test_loops_and_dead_ends(spark):
    e = table(spark, "src string, dst string", ("head", "a"), ("a", "b"), ("b", "head"), ("x", "head"))
    n = table(spark, "id string, loopIds array<string>", ("head", ["l"]), ("a", ["l"]), ("b", ["l"]), ("x", []))
    loops = table(spark, "id string, entryNodeId string, exitNodeId string", ("l", "head", "out"))
    assert pairs(graph.cut_back_edges(e, n, loops), "src", "dst") == [("a", "b"), ("b", "out"), ("head", "a"), ("x", "head")]
    calls = table(spark, "id string, calleeFullName string", ("t", "<operator>.throw"), ("o", "other"))
    assert pairs(graph.dead_ends(table(spark, "src string, dst string", ("a", "t"), ("b", "t"), ("b", "o")), calls), "id") == [("a",)]
    out = phases.excluded_operations(table(spark, NODES, node("q", arms=[("g", "a")]), node("w", name="My.Error.<init>", arms=[("g", "a")]), node("v", arms=[("g", "b")])), table(spark, "groupId string, armLabel string, kind string", ("g", "a", "throw"), ("g", "b", "throw"), ("g", "b", "return")))
    assert pairs(out, "id", "reason") == [("q", "in-throwing-arm"), ("w", "exception-mechanic")]


def test_structure_checks(spark):
    nodes = table(spark, NODES, node("a", "structure", None, group="g", role="entry"), node("b", arms=[("g", "yes"), ("x", "y")], loops=["l"]), node("b"), node("c"))
    assert pairs(validate.duplicate_ids(nodes, "node"), "check", "key") == [("duplicate-node", "b")]
    assert pairs(validate.shared_ids(table(spark, "id string", ("g",)), table(spark, "id string", ("g",), ("l",))), "key") == [("g",)]
    arms = table(spark, "groupId string, armLabel string", ("g", "yes"))
    assert pairs(validate.unknown_memberships(nodes, arms, table(spark, "id string", ("k",))), "check") == [("unknown-arm",), ("unknown-loop",)]
    e = table(spark, f"src string, dst string, reqs {ARM}", ("a", "b", [("g", "yes")]), ("c", "b", []))
    assert pairs(validate.missing_routes(table(spark, "id string", ("a",), ("b",)), e), "check", "key") == [("no-way-in", "a"), ("no-way-out", "b")]
    assert pairs(validate.unselected_arms(e, nodes.where("id <> 'b' or size(branchArms) > 0")), "key") == [("a",), ("c",)]
    groups = table(spark, f"id string, entryNodeId string, enclosing {ARM}", ("g", "b", [("x", "y")]), ("x", "b", []))
    assert pairs(validate.bad_enclosures(groups, nodes.where("size(branchArms) > 0")), "key") == [("x",)]
    methods = table(spark, "entryId string, fullName string", ("e1", "m1"), ("e2", "m2"), ("e3", "m3"))
    body = table(spark, "id string, owner_entry_id string, type string, calleeFullName string, body boolean", ("e1", "e1", "entry", "m1", False), ("e2", "e2", "entry", "other", False), ("e1", "e2", "call", "x", True))
    told = validate.bad_definitions(methods, body, table(spark, "src string, dst string, type string, local boolean", ("p", "q", "invoke", True), ("p", "q", "data", False), ("p", "q", "invoke", False)))
    assert pairs(told, "check", "key") == [("bad-entry", "e3"), ("entry-in-body", "e1"), ("local-not-sequence", "p"), ("other-name", "e2"), ("outbound-not-invoke", "p")]


def test_answers(spark):
    labels = table(spark, "topic int, label string, pos int", (1, "Load data", 2), (1, "load DATA", 1), (2, "Load data", 3))
    assert pairs(batches.unique_labels(labels, topic="topic", label="label", order="pos"), "topic", "label") == [(1, "load DATA"), (2, "Load data")]
    groups = table(spark, "label string, member string", ("a", "x"), ("b", "x"), ("b", "q"))
    assert pairs(batches.groups_check(groups, table(spark, "name string", ("x",), ("y",))), "check", "key") == [("left-over", "y"), ("two-groups", "x"), ("unknown-member", "q")]


def test_payload_items(spark):
    cluster = table(spark, "label int, terms array<string>, members array<string>, llm_label string, name string, entry_point string, methods array<string>, id string", (3, ["a"], ["A"], "L", "n", "e", ["m"], "i"))
    for item in (bundle.topic_context, bundle.cluster_item):
        try:
            got = cluster.select(F.to_json(item()).alias("x")).first()["x"]
        except Exception as error:  # columns that the item needs and this table lacks
            pytest.fail(str(error)[:300])
        assert json.loads(got)


def test_packing_over_many_stretches(spark):
    """Greedy packing of one hot key against a plain loop, whatever the stretches are."""
    rng = random.Random(3)
    sizes = [rng.choice((1, 50, 900, 9000, 29999, 40000)) for _ in range(700)]
    items = table(spark, "k string, o int, s long", *(("hot", i, s) for i, s in enumerate(sizes)), ("cold", 0, 5))
    want, batch, used, n = {}, -1, 0, 0
    for i, s in enumerate(sizes):
        if n == 0 or n == 7 or used + s > 30000:
            batch, used, n = batch + 1, 0, 0
        want[i], used, n = batch, used + s, n + 1
    for stretch in (16, 61, 4096):
        got = batches.pack(items, key="k", order="o", size="s", max_items=7, stretch=stretch).collect()
        assert {r["o"]: r["batch"] for r in got if r["k"] == "hot"} == want and len(got) == 701
    assert batches.pack(items.limit(0), key="k", order="o", size="s", max_items=7).count() == 0


def test_neighbours_by_blocks(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice((0.0, 0.6, 0.8, -0.6)) for _ in range(3)]) for i in range(90)] + [(900, None)]
    want = {}
    for i, v in rows[:-1]:
        near = sorted(((-round(sum(a * b for a, b in zip(v, w)), 12), j) for j, w in rows[:-1] if j != i))[:4]
        want[i] = [j for _, j in near]
    for block in (16, 1000):
        got = {}
        for r in topics.knn(table(spark, "vec_id long, embedding array<double>", *rows), k=4, block_rows=block).orderBy("vec_id", "rank").collect():
            got.setdefault(r["vec_id"], []).append(r["neighbour"])
        assert got == want


def test_discovered_topics(spark):
    rng = random.Random(5)
    words = {"bank": "account balance transfer loan interest teller".split(), "zoo": "lion tiger feeding cage keeper visitor".split()}
    rows = [(f"{kind}{i}", " ".join(rng.choices(w, k=14)), f"com.{kind}") for kind, w in words.items() for i in range(12)] + [("blank", " \n", "com.none")]
    docs = table(spark, "name string, text string, package string", *rows)
    readmes = table(spark, "path string, package string", ("bank/README", "com.bank"))
    got = topics.discover_topics(docs, key="name", readmes=readmes, package="package")
    labels = {r["name"]: r["label"] for r in got["members"].collect()}
    assert "blank" not in labels and len(labels) == 24
    for kind in words:
        assert len({v for k, v in labels.items() if k.startswith(kind) and v != -1}) >= 1
    assert not {labels[k] for k in labels if k.startswith("bank")} & {labels[k] for k in labels if k.startswith("zoo")} - {-1}
    named = {r["label"]: r for r in got["clusters"].collect()}
    assert sum(r["n_members"] for r in named.values()) == 24 and all(r["name"] == r["terms"][0] for r in named.values() if r["terms"]) and not any(r["fallback"] for r in named.values())
    assert {r["label"] for r in got["readmes"].collect()} == {v for k, v in labels.items() if k.startswith("bank") and v != -1} or got["readmes"].count() >= 1
    forced = topics.discover_topics(docs, key="name", fallback=lambda d: d.select("name", F.lit(7).cast("long").alias("label")), force=True)
    assert pairs(forced["clusters"], "label", "n_members", "fallback") == [(7, 24, True)]
    with pytest.raises(ValueError, match="fallback"):
        topics.discover_topics(docs, key="name", force=True)


def test_run_summary(spark):
    p = table(spark, "method string, phase int, id string", ("m", 1, "a"), ("m", 2, "b"), ("n", 1, "c"))
    none = table(spark, "id string")
    got = phases.run_summary(p, table(spark, "id string", ("r",)), none, none, table(spark, "action string", ("MERGE",), ("SPLIT",), ("MERGE",))).first().asDict()
    assert got == {"methods": 2, "phases": 3, "members": 3, "retained": 1, "unresolved": 0, "excluded": 0, "merges": 2, "splits": 1}


def test_outbound_edges_belong_to_their_source(spark):
    e = table(spark, "src string, dst string, type string", ("a", "x", "invoke"), ("a", "b", "sequence"), ("q", "x", "invoke"))
    assert pairs(scoping.outbound_invokes(e, table(spark, "id string, owner_entry_id string", ("a", "m"), ("b", "m"))), "owner_entry_id", "src", "dst") == [("m", "a", "x")]


def test_interval_edges(spark):
    points = table(spark, "file string, line int", ("f", 3), ("f", 9), ("g", 3))
    spans = table(spark, "file string, start int, `end` int, method string", ("f", 1, 5, "a"), ("f", 9, None, "b"), ("f", None, 9, "c"))
    assert pairs(scoping.within_lines(points, spans, by="file"), "line", "method") == [(3, "a"), (9, "b")]


def test_shared_folder_is_never_local_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())
    kept = session.materialize(spark.range(3))
    session.release(kept, spark.range(2), None)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(kept._written_to or "/gone").count()


def test_reports_stay(spark):
    log = table(spark, "kind string, success boolean, duration double", ("a", True, 1.0), ("a", False, 2.0))
    assert reports.run_totals(log, by="kind").count() == 1


def test_evidence_shuffles_texts_once(spark):
    from callweave.plans import queries

    plan = queries.evidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_vectors_are_shuffled_as_floats(spark):
    from callweave.operators import topics

    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(50)], "vec_id long, embedding array<float>")
    found = topics.knn(rows, k=3, block_rows=8)
    assert "array<double>" not in "".join(t.simpleString() for t in found.sparkSession.read.parquet(*found.inputFiles()).schema.fields[1:2] for t in [t.dataType])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, topics.knn(rows, k=3).collect()))
