"""Small literal tables for operators and functions."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.functions import signature, text
from callweave.functions.guards import GUARDS
from callweave.operators import batches, graph, phases, reports, topics, validate
from callweave.plans import queries

EDGE = f"src string, dst string, type string, reqs {GUARDS}"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, "sequence", [tuple(g) for g in r]) for a, b, *r in rows], EDGE)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def routes(df):
    return sorted((r["src"], r["dst"], tuple(tuple(g) for g in r["reqs"])) for r in df.collect())


def test_routes_of_different_guards_are_different_edges(spark):
    rows = [("in", "skip1", ("tax", "due")), ("skip1", "skip2"), ("skip2", "out"), ("in", "skip3"), ("skip3", "out", ("vat", "none"), ("tax", "free")), ("skip2", "far")]
    want = [("in", "far", (("tax", "due"),)), ("in", "out", (("tax", "due"),)), ("in", "out", (("vat", "none"), ("tax", "free")))]
    assert routes(graph.bridge(edges(spark, *rows), ids(spark, "skip1", "skip2", "skip3"))) == sorted(want)


def test_nested_guards_add_up_and_conflicts_end(spark):
    e = edges(spark, ("s", "a", ("g", "if")), ("a", "b", ("h", "if")), ("b", "t"), ("a", "c", ("g", "else")), ("c", "t"))
    assert routes(graph.bridge(e, ids(spark, "a", "b", "c"))) == [("s", "t", (("g", "if"), ("h", "if")))]


def test_cycles_of_excluded_nodes_and_self_loops_give_nothing(spark):
    e = edges(spark, ("s", "a"), ("a", "b"), ("b", "a"), ("b", "s"))
    assert routes(graph.bridge(e, ids(spark, "a", "b"))) == []


def test_long_chains_of_excluded_nodes_take_few_tables(spark, monkeypatch):
    """A chain of 40 excluded nodes, chains that meet, part, conflict, end nowhere or never end: all routes, with rounds of the logarithm."""
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(1) or write(df))
    chain = [(f"h{i}", f"h{i + 1}") for i in range(40)]
    rows = [("s", "h0", ("g", "a")), ("t", "h20"), *chain[:20], ("h20", "h21", ("k", "x")), *chain[21:], ("h40", "p"), ("h40", "q", ("g", "b")), ("r", "h39", ("g", "b"))]
    rows += [("p", "d0"), ("d0", "d1"), ("q", "z1"), ("z1", "z2"), ("z2", "z1"), ("u", "c1"), ("c1", "c2", ("m", "a")), ("c2", "v", ("m", "b"))]
    hidden = ids(spark, *(f"h{i}" for i in range(41)), "d0", "d1", "z1", "z2", "c1", "c2")
    want = [("r", "p", (("g", "b"),)), ("r", "q", (("g", "b"),)), ("s", "p", (("g", "a"), ("k", "x"))), ("t", "p", (("k", "x"),)), ("t", "q", (("k", "x"), ("g", "b")))]
    assert routes(graph.bridge(edges(spark, *rows), hidden)) == want
    assert len(written) < 30


def test_bridge_computes_its_edges_once(spark):
    """Edges made by a window over a large table are not made again for the excluded nodes and the kept ones."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    e = edges(spark, ("s", "a", ("g", "if")), ("a", "b"), ("b", "t"), ("a", "c", ("g", "else")), ("s", "t"), ("t", "d"))
    want = [("s", "t", ()), ("s", "t", (("g", "if"),))]
    assert routes(graph.bridge(e.mapInArrow(count, EDGE), ids(spark, "a", "b", "c", "d"))) == want
    assert made.value == 6


@pytest.mark.parametrize("seed", range(3))
def test_reached_by_a_plain_walk(spark, monkeypatch, seed):
    """Chains, joins, rings and roots inside of them; long chains take tables by the logarithm of their length."""
    rng = random.Random(seed)
    rows = [(f"n{i}", f"n{i + 1}") for i in range(40) if i != 20] + [(f"n{rng.randrange(60)}", f"n{rng.randrange(40, 60)}") for _ in range(25)]
    rows += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r3", "n55"), ("o1", "o2"), ("o2", "o1"), ("n10", "n10")]
    roots = {"n3", "n30", "o1", "lonely"}
    todo, want = list(roots), set(roots)
    while todo:
        at = todo.pop()
        new = {b for a, b in rows if a == at} - want
        want |= new
        todo += new
    found = [r["id"] for r in graph.reached(spark.createDataFrame(rows, "src string, dst string"), ids(spark, *roots)).collect()]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("fold, depth", [(1_000, None), (1_000, 3), (20, None), (20, 2)])
def test_folded_walks_are_those_of_rounds(spark, fold, depth):
    """Chains, joins, rings, several starts of a root, roots without edges; parts above the fold take the rounds, small shares split the roots of a part."""
    rng = random.Random(fold)
    rows = [(f"a{i}", f"a{i + 1}") for i in range(12)] + [(f"b{rng.randrange(15)}", f"b{rng.randrange(15)}") for _ in range(40)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("a3", "a3"), ("a3", "a9")]
    begin = [(n, n) for n in sorted({x for row in rows for x in row})] + [("both", "a9"), ("both", "a2"), ("both", "b1"), ("both", "lonely"), ("lonely", "lonely")]
    e, r = spark.createDataFrame(rows * 2, "src string, dst string"), spark.createDataFrame(begin * 2, "root string, id string")
    want = sorted(map(tuple, graph.reach(e, r, max_depth=depth).collect()))
    assert sorted(map(tuple, graph.reach_folded(e, r, max_depth=depth, fold=fold, share=3).collect())) == want


def test_deep_walks_from_many_roots_take_few_tables(spark, monkeypatch):
    """The rounds of ``reach`` write a table for each step of a chain of 60; the fold writes those of its contraction alone."""
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(1) or write(df))
    monkeypatch.setattr("callweave.session.materialize", graph.materialize)
    rows = [(i, i + 1) for i in range(60)]
    monkeypatch.setattr("callweave.plans.queries.brand_edges", lambda spark, sf_dir: spark.createDataFrame(rows, "src long, dst long"))
    monkeypatch.setattr("callweave.plans.queries.read", lambda spark, sf_dir, name: spark.createDataFrame([(i,) for i in range(62)], "p_partkey long"))
    found = queries.reach_parts(spark, "").collect()
    assert sorted(map(tuple, found)) == [(i, 61 - i) for i in range(61)] + [(61, 1)]
    assert len(written) < 30


def test_roots_need_a_call(spark):
    nodes = spark.createDataFrame([("e1", "entry", "m1", None), ("c1", "call", "x", "m1"), ("e2", "entry", "m2", None), ("e3", "entry", "m3", None), ("c3", "call", "x", "m3")], "id string, type string, calleeFullName string, callerMethod string")
    found = graph.roots_and_orphans(nodes, spark.createDataFrame([("c3", "e3", "invoke")], "src string, dst string, type string"))
    assert sorted(map(tuple, found.collect())) == [("e1", "root"), ("e2", "orphan")]


def test_linear_runs_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("x", "y"), ("y", "z"), ("z", "x")], "src string, dst string")
    m = spark.createDataFrame([(n, i) for i, n in enumerate("abcdeyzx")], "id string, rank int")
    found = {r["id"]: (r["run"], r["position"]) for r in graph.linear_runs(e, m).collect()}
    assert found == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0), "e": ("e", 0), "y": ("y", 0), "z": ("y", 1), "x": ("y", 2)}


def test_parent_is_retained_by_child(spark):
    found = graph.retained_structures(ids(spark, "branch"), spark.createDataFrame([("loop", "branch"), ("other", "empty")], "parent string, child string"))
    assert sorted(r[0] for r in found.collect()) == ["branch", "loop"]


def test_removed_groups_drop_guards_and_repeats(spark):
    e = edges(spark, ("a", "b", ("g", "if")), ("a", "b", ("g", "else")), ("a", "b")).withColumn("pos", F.lit(1))
    assert routes(graph.drop_groups(e, ids(spark, "g"))) == [("a", "b", ())]


def test_identifiers(spark):
    row = spark.range(1).select(text.split_identifier(F.lit("parseHTTPServer2Foo_bar-baz")).alias("x"), text.method_terms(F.lit("getHTTPName")).alias("y"), text.normalise_label(F.lit('"key/value  store"')).alias("l")).first()
    assert row["x"] == ["parse", "http", "server2", "foo", "bar", "baz"]
    assert row["y"] == ["get", "httpname"]
    assert row["l"] == "key / value store"


def test_bounded_list(spark):
    got = spark.range(1).select(text.bounded_list(F.array(F.lit("aa"), F.lit(" aa "), F.lit("bbb"), F.lit("c")), 5).alias("x")).first()["x"]
    assert got == ["aa", "bbb"]


def sig(spark, left, right):
    full = lambda d: {n: d.get(n, []) for n in (*signature.DIMENSIONS, "observed")}
    kind = "struct<" + ",".join(f"{n}:array<string>" for n in (*signature.DIMENSIONS, "observed")) + ">"
    return spark.createDataFrame([(full(left), full(right))], f"a {kind}, b {kind}")


def test_scores_by_definition(spark):
    """Random signatures against a plain reading of the rule."""
    rng = random.Random(12)
    pick = lambda: {d: rng.sample("pqrst", rng.randint(0, 3)) for d in signature.WEIGHTS} | {"observed": rng.sample(list(signature.WEIGHTS), rng.randint(0, 6))}
    for _ in range(12):
        a, b = pick(), pick()
        top = bottom = 0.0
        for d, weight in signature.WEIGHTS.items():
            common = len(set(a[d]) & set(b[d]))
            if common or (d in a["observed"] and d in b["observed"] and a[d] + b[d]):
                bottom += weight
                top += weight * common / max(1, min(len(a[d]), len(b[d])))
        got = sig(spark, a, b).select(*signature.score("a", "b")).first()
        assert tuple(got) == pytest.approx((top / bottom if bottom else 0.0, bottom))


def calls(spark, *rows):
    data = [{"run": 1, "pos": i, "id": f"c{i}", "flow": False, "retained": False, "observed": list(signature.IDENTITY), **{d: [] for d in signature.DIMENSIONS}, **r} for i, r in enumerate(rows)]
    kinds = "run int, pos int, id string, flow boolean, retained boolean, observed array<string>, " + ", ".join(f"{d} array<string>" for d in signature.DIMENSIONS)
    return spark.createDataFrame(data, kinds)


def test_segments_and_gates(spark):
    rows = calls(spark, {"inputs": ["a"]}, {"inputs": ["a"]}, {"inputs": ["z"]}, {"inputs": [], "observed": []}, {"flow": True}, {"retained": True}, {"inputs": ["q"]})
    found, gates = phases.segment_runs(rows)
    assert [(r["id"], r["phase"]) for r in found.orderBy("pos").collect()] == [("c0", 1), ("c1", 1), ("c2", 2), ("c3", 3), ("c4", 3), ("c6", 4)]
    assert [r["right_id"] for r in gates.collect()] == ["c3"]


def test_effective_counts(spark):
    own = {"top": 1, "mid": 2, "one": 1, "x": 1, "y": 1, "above": 1, "beside": 3, "self": 1}
    data = [("top", "k1", "mid"), ("top", "k2", "one"), ("top", "k2", "mid"), ("top", "k3", "outside"), ("x", "k4", "y"), ("y", "k5", "x"), ("above", "k6", "x"), ("x", "k7", "mid"), ("self", "k8", "self"), ("beside", "k9", "one")]
    m, c = spark.createDataFrame(list(own.items()), "method string, own int"), spark.createDataFrame(data, "method string, call string, target string")
    counts = phases.effective_counts(m, c)
    assert {r[0]: r[1] for r in counts.collect()} == {"top": 5, "mid": 2, "one": 1, "x": None, "y": None, "above": None, "beside": 3, "self": None}
    assert sorted(map(tuple, phases.retained_calls(counts, c).collect())) == [("above", "k6"), ("self", "k8"), ("top", "k1"), ("top", "k2"), ("x", "k4"), ("x", "k7"), ("y", "k5")]
    assert phases.effective_counts(m.limit(0), c).count() == 0


def test_class_tfidf(spark):
    import math

    n = spark.createDataFrame([(0, "a", 3), (0, "b", 1), (1, "a", 1), (1, "b", 2)], "cluster int, term string, n long")
    got = {(r["cluster"], r["term"]): r["score"] for r in topics.class_tfidf(n).collect()}
    assert got[(0, "a")] == pytest.approx(0.75 * math.log(1 + 3 / 4))
    assert got[(1, "b")] == pytest.approx(2 / 3 * math.log(1 + 3 / 3))


def test_planted_clusters(spark):
    rows = [(i, [1.0, 0.01 * (i % 5), 0.0]) for i in range(10)] + [(10 + i, [0.0, 0.01 * (i % 5), 1.0]) for i in range(10)] + [(99, [0.0, -1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("embedding", topics.unit(F.transform("embedding", lambda x: x.cast("double"))))
    got = {r[0]: r[1] for r in topics.density_clusters(df, levels=(0.3, 0.6)).collect()}
    assert got[99] == -1 and len({got[i] for i in range(10)}) == 1 and len({got[i] for i in range(10, 20)}) == 1 and got[0] != got[10]


def test_pack_by_items_and_size(spark):
    items = spark.createDataFrame([("t", i, 10) for i in range(5)] + [("u", 0, 40_000), ("u", 1, 1)], "topic string, pos int, size long")
    got = sorted(map(tuple, batches.pack(items, key="topic", order="pos", size="size", max_items=2).collect()))
    assert [b for t, _, b in got if t == "t"] == [0, 0, 1, 1, 2] and [b for t, _, b in got if t == "u"] == [0, 1]


def test_scan_and_correlate(spark):
    a = spark.createDataFrame([('{"id":"a"}\nnot json\n{"id":"b"}{"id":"b"}',)], "text string")
    got = batches.scan_records(a, "id string")
    assert got.where("record is null").count() == 1 and got.where("joined").count() == 2
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    status = {r[0]: r[1] for r in batches.correlate(asked, got.select("record.id")).collect()}
    assert status == {"a": "ok", "b": "duplicate", "c": "missing"}


def test_retry_rounds(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    answer = lambda df, size: df.select("id", F.when((F.col("id") % 2) == int(size == 1), "yes").alias("answer"))
    got = {r["id"]: r["round"] for r in batches.retry_rounds(items, answer).collect()}
    assert got == {2: 0, 1: 2, 3: 2}


def test_line_stats(spark):
    f = spark.createDataFrame([("x", "// heading\nclass A {\n void run() {}\n}\n/* a\nb */\n")], "path string, text string")
    r = reports.line_stats(f).first()
    assert (r["physical"], r["blank"], r["comment"], r["source"]) == (7, 1, 3, 3)


def test_violations(spark):
    e = edges(spark, ("a", "zz", ("g", "if"), ("g", "else")))
    assert [r["check"] for r in validate.dangling_edges(e, ids(spark, "a")).collect()] == ["dangling-dst"]
    arms = spark.createDataFrame([("g", "if")], "groupId string, armLabel string")
    assert sorted(r["check"] for r in validate.bad_guards(e, arms).collect()) == ["two-arms", "unknown-guard"]
