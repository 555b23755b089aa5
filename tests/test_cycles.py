"""Strong components, condensed order, cycle report and loop cutting against plain readings."""

import random

from callweave.operators import cycles


def reach_of(pairs):
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
        to.setdefault(b, set())
    out = {}
    for n in to:
        seen, todo = set(), [n]
        while todo:
            for m in to[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[n] = seen
    return out


def parts_of(pairs):
    far = reach_of(pairs)
    return {n: min({n} | {m for m in far[n] if n in far[m]}) for n in far}


def graphs():
    rng = random.Random(4)
    yield [(i, i + 1) for i in range(40)] + [(40, 0), (50, 50), (60, 61), (61, 60), (62, 60)]
    yield [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "y")]
    for n, m in ((12, 14), (30, 33), (40, 80)):
        yield [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] * 2


def table(spark, pairs):
    return spark.createDataFrame([(None, *p) for p in pairs], f"g string, src {'string' if isinstance(pairs[0][0], str) else 'long'}, dst {'string' if isinstance(pairs[0][0], str) else 'long'}")


def test_strong_components(spark):
    for pairs in graphs():
        assert cycles.tarjan(pairs) == parts_of(pairs)
    for pairs in list(graphs())[1:3]:
        found = cycles.strong_components(table(spark, pairs), within="g")
        assert {r["id"]: r["component"] for r in found.collect()} == parts_of(pairs)
    assert cycles.strong_components(spark.createDataFrame([], "src long, dst long"), within="src").count() == 0


def test_strong_components_by_colours(spark):
    """All graphs side by side, so that one run of rounds serves them; beyond the fold, too."""
    pairs = [(f"{i}-{a}", f"{i}-{b}") for i, g in enumerate(graphs()) for a, b in g]
    for found in (cycles.strong_components(table(spark, pairs)), cycles.strong_components(table(spark, pairs), within="g", fold=2)):
        assert {r["id"]: r["component"] for r in found.collect()} == parts_of(pairs)


def test_levels_of_the_condensation(spark):
    for pairs in [list(graphs())[1], list(graphs())[3]]:
        part = parts_of(pairs)
        dag = {(part[a], part[b]) for a, b in pairs if part[a] != part[b]}
        level = dict.fromkeys(part.values(), 0)
        for _ in level:
            for a, b in dag:
                level[b] = max(level[b], level[a] + 1)
        ranks = {n: i for i, n in enumerate(sorted(part, key=lambda n: str(n)[::-1]))}
        ranked = spark.createDataFrame(list(ranks.items()), ["id", "rank"])
        found = cycles.topo_levels(table(spark, pairs), ranked, within="g").collect()
        assert {r["id"]: (r["component"], r["level"]) for r in found} == {n: (p, level[p]) for n, p in part.items()}
        first = {p: min(ranks[n] for n in part if part[n] == p) for p in level}
        for at in set(level.values()):
            want = sorted((first[part[n]], ranks[n], n) for n in part if level[part[n]] == at)
            assert [r["id"] for r in sorted((r for r in found if r["level"] == at), key=lambda r: r["place"])] == [w[2] for w in want]


def test_cycle_report(spark):
    for pairs, fold in [([(f"{i}-{a}", f"{i}-{b}") for i, g in enumerate(graphs()) for a, b in g], 1000)]:
        part, far = parts_of(pairs), reach_of(pairs)
        rows = {r["component"]: r for r in cycles.cycle_report(table(spark, pairs), within="g", fold=fold).collect()}
        assert set(rows) == {part[n] for n in part if n in far[n]}
        for c, r in rows.items():
            on = {(a, b) for a, b in pairs if part[a] == c and part[b] == c}
            walk = r["witness"]
            assert r["nodes"] == len({a for a, _ in on}) and r["edges"] == len(on) and len(walk) == r["length"] and walk[0] == c
            assert all((a, b) in on for a, b in zip(walk, walk[1:] + walk[:1]))
            seen, length = {c}, 1
            layer = {b for a, b in on if a == c}
            while c not in layer:
                seen |= layer
                layer, length = {b for a, b in on if a in layer} - (seen - {c}), length + 1
            assert r["length"] == length


def test_witnesses_by_rounds(spark):
    rows = [("a", "b", "a"), ("b", "c", "a"), ("c", "a", "a"), ("b", "d", "a"), ("d", "a", "a"), ("x", "x", "x")]
    found = cycles._witnesses(spark.createDataFrame(rows, "src string, dst string, component string")).collect()
    assert {r["component"]: (r["length"], r["witness"]) for r in found} == {"a": (3, ["a", "b", "c"]), "x": (1, ["x"])}
    assert cycles.shortest_cycle([(0, 1), (1, 2), (2, 0), (1, 3), (3, 0)], 0) == [0, 1, 2] and cycles.shortest_cycle([(4, 4)], 4) == [4]


def cut_by_hand(edges, nodes, exits):
    """The stated rule: first nodes of cyclic components of each loop's part, again and again."""
    edges = dict.fromkeys(edges, False)
    while True:
        closing = {}
        for loop, out in exits.items():
            inner = [(a, b) for a, b in edges if a in nodes and b in nodes and loop in nodes[a][1] and loop in nodes[b][1]]
            part = parts_of(inner) if inner else {}
            for c in set(part.values()):
                on = [(a, b) for a, b in inner if part[a] == part[b] == c]
                if on:
                    head = min((nodes[b][0], b) for _, b in on)[1]
                    for e in on:
                        if e[1] == head:
                            depth = nodes[e[0]][1].index(loop)
                            closing[e] = max(closing.get(e, (-1, "", None)), (depth, loop, None if loop in nodes.get(out, (0, []))[1] else out), key=lambda x: x[:2])
        if not closing:
            return edges
        for e in closing:
            del edges[e]
        for e, (_, _, out) in closing.items():
            if out is not None:
                edges.setdefault((e[0], out), True)


def test_cycles_of_a_loop_are_cut(spark):
    rng = random.Random(8)
    nested = {"in": (0, []), "h": (1, ["L"]), "b": (2, ["L", "M"]), "c": (3, ["L", "M"]), "d": (4, ["L"]), "mx": (5, ["L"]), "lx": (6, []), "p": (7, []), "q": (8, [])}
    path = [("in", "h"), ("h", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "h"), ("d", "lx"), ("mx", "d"), ("p", "q"), ("q", "p"), ("b", "b")]
    cases = [(path, nested, {"L": "lx", "M": "mx"})]
    for _ in range(1):
        nodes = {f"n{i:02}": (i, ["L"] if i % 3 else ["L", "M"] if i % 2 else []) for i in range(14)}
        cases.append(([(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(30)], nodes, {"L": "lx", "M": "mx"}))
    for edges, nodes, exits in cases:
        edges = list(dict.fromkeys(edges))
        got = cycles.cut_cycle_edges(spark.createDataFrame(edges, ["src", "dst"]), spark.createDataFrame([(n, *x) for n, x in nodes.items()], "id string, rank int, loopIds array<string>"), spark.createDataFrame(list(exits.items()), ["id", "exitNodeId"])).collect()
        assert {(r["src"], r["dst"]): r["cut"] for r in got} == cut_by_hand(edges, nodes, exits) and len(got) == len({(r["src"], r["dst"]) for r in got})
    kept = set(cut_by_hand(path, nested, {"L": "lx", "M": "mx"}))
    assert ("c", "mx") in kept and ("d", "lx") in kept and ("p", "q") in kept and ("q", "p") in kept and not kept & {("c", "b"), ("d", "h"), ("b", "b")}


def test_many_groups_share_a_call(spark, monkeypatch):
    """Values of within are folded together: ten thousand small graphs are searched in few calls."""
    ring = [(f"g{i}", 3 * i + k, 3 * i + (k + 1) % 3) for i in range(10000) for k in range(3)]
    edges = spark.createDataFrame(ring, "g string, src long, dst long")
    calls = spark.sparkContext.accumulator(0)
    plain = cycles._folded

    def counted(rows, by, run, schema, fold):
        def told(group):
            calls.add(1)
            return run(group)

        return plain(rows, by, told, schema, fold)

    monkeypatch.setattr(cycles, "_folded", counted)
    rows = cycles.cycle_report(edges, within="g").collect()
    assert sorted((r["component"], r["nodes"], r["edges"], list(r["witness"])) for r in rows) == [(3 * i, 3, 3, [3 * i, 3 * i + 1, 3 * i + 2]) for i in range(10000)]
    assert calls.value <= 4


def test_a_loop_is_looked_at_again_when_an_edge_is_sent_into_it(spark):
    """The inner loop's exit closes a cycle of an outer loop that had none."""
    nodes = spark.createDataFrame([(1, 1, ["o", "i"]), (2, 2, ["o", "i"]), (3, 0, ["o"]), (4, 3, ["p"]), (5, 4, ["p", "q"]), (6, 5, ["p", "q"])], "id long, rank int, loopIds array<string>")
    loops = spark.createDataFrame([("o", 9), ("i", 3), ("p", 8), ("q", 4)], "id string, exitNodeId long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 5), (5, 6), (6, 5)], "src long, dst long")
    got = sorted((r["src"], r["dst"], r["cut"]) for r in cycles.cut_cycle_edges(edges, nodes, loops).collect())
    assert got == [(1, 2, False), (2, 9, True), (3, 1, False), (4, 5, False), (5, 6, False), (6, 8, True)]
