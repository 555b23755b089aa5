"""Answers of models, fallback of topics, embedder hook, interval cells and refreshed branches."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import batches, gates, scoping, topics


def test_records_are_scanned_by_strings_and_depth():
    scan = batches.scan_text
    assert scan('{"a": "} {"}{"b": 1}') == ([('{"a": "} {"}', False), ('{"b": 1}', True)], 0)
    assert scan('```json\n{"a":\n {"x": "\\""}}\n```') == ([('{"a":\n {"x": "\\""}}', False)], 0)
    assert scan('words {"a": 1}\n{"b": 2} tail\n{"c": 3}') == ([('{"b": 2}', False), ('{"c": 3}', False)], 2)
    assert scan('"two lines"}\n{"c": 3}{"d": 4} {"e": 5}') == ([('"two lines"', False), ('{"c": 3}', False), ('{"d": 4}', True), ('{"e": 5}', False)], 1)
    assert scan("") == ([], 0) and scan(" \n ") == ([], 0) and scan("[" * 100000)[1] == 1


def test_scanned_answers_and_their_failures(spark):
    rows = [(1, '{"id": "x", "label": "a } { b"}{"id": "y"}\nnothing\n7'), (2, None), (3, "  "), (4, '{"id": 5')]
    got = batches.scan_records(spark.createDataFrame(rows, "call int, text string"), "id string, label string")
    assert sorted((r["call"], r["pos"], tuple(r["record"]) if r["record"] else None, r["joined"], r["malformed"]) for r in got.collect()) == [(1, 0, ("x", "a } { b"), True, 0), (1, 1, ("y", None), True, 0), (1, 2, None, False, 0), (1, 3, None, False, 1), (4, 0, None, False, 1)]
    assert {r["call"]: tuple(r)[1:] for r in batches.parse_failures(got, by="call").collect()} == {1: (2, 1, 1, 1), 4: (0, 1, 0, 0)}


def test_repeated_and_odd_gate_answers_count_for_nothing(spark):
    members = spark.createDataFrame([("m", f"p{i}", i, f"c{i}", 0) for i in range(4)], "method string, phase string, at int, id string, seq int")
    open_gates = spark.createDataFrame([("m", f"g{i}", f"c{i}", f"c{i + 1}", i) for i in range(3)], "method string, gate string, left_id string, right_id string, pos int")
    told = [("m", "g0", "MERGE", 0.5, ["x"]), ("m", "g0", "SPLIT", 0.5, ["x"]), ("m", "g1", "MERGE", 7.0, ["x"]), ("m", "g2", "MERGE", 1.0, ["x"])]
    got, left, log = gates.resolve_gates(members, open_gates, spark.createDataFrame(told, "method string, gate string, action string, confidence double, evidence array<string>"))
    assert {r["id"]: r["phase"] for r in got.collect()} == {"c0": "p0", "c1": "p1", "c2": "p2", "c3": "p2"}
    assert sorted(r["gate"] for r in left.collect()) == ["g0", "g1"] and [r["gate"] for r in log.collect()] == ["g2"]


@pytest.fixture
def model():
    """A toy embedder: counts of four letters."""

    def load():
        import numpy as np

        return lambda texts: np.array([[t.count(c) for c in "abcd"] for t in texts], dtype=float)

    return load


def test_embedder_of_the_caller(spark, model):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aab", None, "", "dd" * 5000, "abcd"])], "id long, text string")
    got = {r["id"]: r["embedding"] for r in topics.embed_with(docs, model, key="id", batch_bytes=4).collect()}
    assert got == {0: [2, 1, 0, 0], 1: [0, 0, 0, 0], 2: [0, 0, 0, 0], 3: [0, 0, 0, 10000], 4: [1, 1, 1, 1]}
    assert topics.embed_with(docs.limit(0), model, key="id").count() == 0


@pytest.mark.parametrize("n, fallen", [(30, False), (12, True)])
def test_fallback_follows_the_coverage_rule(spark, model, n, fallen):
    """One good topic of 30 classes is no reason to fall back, twelve classes are."""
    docs = spark.createDataFrame([(f"c{i:02}", "a" * (20 + i % 3) + "b") for i in range(n)], "name string, text string")
    found = topics.discover_topics(docs, key="name", embedder=model, fallback=lambda d: d.select("name", F.lit(7).cast("long").alias("label")))
    assert {r["fallback"] for r in found["clusters"].collect()} == {fallen}


def test_spans_are_made_of_cells(spark):
    rng = random.Random(3)
    ends = [(a, a + rng.choice([0, 1, 5, 60, 4000]) - (rng.random() < 0.1)) for a in (rng.randrange(-3000, 3000) for _ in range(200))]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(ends)], "i int, a long, b long").select("i", scoping.cells(F.col("a"), F.col("b")).alias("cells")).collect()
    for r in rows:
        a, b = ends[r["i"]]
        assert sorted(n for level, cell in r["cells"] for n in range(cell << level, (cell + 1) << level)) == list(range(a, b + 1)) and len(r["cells"]) <= 26


def test_points_meet_the_spans_around_them(spark):
    rng = random.Random(4)
    points = [(rng.choice("fg"), rng.choice([None, *range(-5, 90)]), i) for i in range(200)]
    spans = [(rng.choice("fg"), a, b, i) for i, (a, b) in enumerate((rng.choice([None, rng.randrange(-5, 90)]), rng.choice([None, rng.randrange(-5, 120)])) for _ in range(60))]
    got = scoping.within_lines(spark.createDataFrame(points, "file string, line int, p int"), spark.createDataFrame(spans, "file string, start int, end int, s int"), by="file")
    want = sorted((p, s) for f, n, p in points for g, a, b, s in spans if f == g and n is not None and a is not None and a <= n <= (a if b is None else b))
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want


def test_spans_are_cut_by_their_points(spark):
    """Cells of a span never outnumber its points, however wide it is, and are not broadcast."""
    points = spark.createDataFrame([("f", 1000003 * i + 7, i) for i in range(40)], "file string, line long, p int")
    spans = spark.createDataFrame([("f", i, 1000003 * (i + 3), i) for i in range(30)] + [("f", 11, 12, 99), (None, 0, 10**9, 98)], "file string, start long, end long, s int")
    found = scoping.within_lines(points, spans, by="file")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    held = spark.read.parquet(*[f for f in found.inputFiles() if "callweave-" in f])
    assert held.count() <= found.count() == sum(a <= 1000003 * i + 7 <= b for i in range(40) for a, b in ((n, 1000003 * (n + 3)) for n in range(30)))
