"""Phase analysis of methods against a plain recursive reading of its rules, on random nested structures."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.functions.guards import GUARDS
from callweave.functions.signature import DIMENSIONS, IDENTITY, WEIGHTS
from callweave.operators import methods

ALL = (*DIMENSIONS, "observed")


def overlap(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def judge(a, b):
    """The verdict about two signatures by sets."""
    seen = [d for d in IDENTITY if d in a["observed"] and d in b["observed"]]
    left, right = (set().union(*(s[d] for d in IDENTITY)) for s in (a, b))
    if len(seen) == 3 and left and right and not left & right:
        return "UNRELATED"
    used = [d for d in WEIGHTS if a[d] & b[d] or (d in a["observed"] and d in b["observed"] and (a[d] or b[d]))]
    total = sum(WEIGHTS[d] for d in used)
    return "RELATED" if used and sum(WEIGHTS[d] * overlap(a[d], b[d]) for d in used) / total >= 0.5 - 1e-12 else "UNKNOWN"


def core(found):
    need = 1 if len(found) == 1 else max(2, -(-len(found) // 2))
    return {d: {v for s in found for v in s[d] if sum(v in t[d] for t in found) >= need} for d in ALL}


class Method:
    """One method: a tree of runs (lists of calls) and branches (lists of arms)."""

    def __init__(self, tree, sigs, flow, retained):
        self.sigs, self.flow, self.retained, self.phases, self.gates, self.of = sigs, flow, retained, [], [], {}
        self.cut(tree)
        order = list(self.phases)
        self.merge(tree)
        self.result = [p for p in order if p]

    def cut(self, items):
        for item in items:
            if isinstance(item, tuple):
                for arm in item:
                    self.cut(arm)
                continue
            active, last = None, None
            for c in item:
                if c in self.retained:
                    active = None
                    continue
                joined = False
                if active is not None:
                    a, b = self.sigs[last], self.sigs[c]
                    if (last, c) in self.flow or a["fields_written"] & b["fields_read"]:
                        joined = True
                    else:
                        said = judge(a, b)
                        if said == "RELATED" and judge(core([self.sigs[x] for x in active]), b) != "UNRELATED":
                            joined = True
                        elif said != "UNRELATED":
                            self.gates.append(f"{last}-{c}")
                if joined:
                    active.append(c)
                else:
                    active = [c]
                    self.phases.append(active)
                self.of[c] = active
                last = c

    def ends(self, item, side):
        if isinstance(item, list):
            return [item[side]]
        return [c for arm in item if arm for c in self.ends(arm[side], side)]

    def merge(self, items):
        for item in items:
            if isinstance(item, tuple):
                for arm in item:
                    self.merge(arm)
        for a, b in zip(items, items[1:]):
            for x in self.ends(a, -1):
                for y in self.ends(b, 0):
                    if x in self.retained or y in self.retained or self.of[x] is self.of[y]:
                        continue
                    p, q = self.of[x], self.of[y]
                    said = judge(core([self.sigs[c] for c in p]), core([self.sigs[c] for c in q]))
                    if (x, y) in self.flow or self.sigs[x]["fields_written"] & self.sigs[y]["fields_read"] or said == "RELATED":
                        if self.phases.index(q) < self.phases.index(p):
                            pass
                        for c in q:
                            self.of[c] = p
                        p.extend(q)
                        q.clear()
                    elif said == "UNKNOWN":
                        self.gates.append(f"region:{x}-{y}")


def random_method(rng, name):
    rows, sigs, count, groups = [], {}, [0], [0]

    def run(path, n):
        out = []
        for _ in range(n):
            c = f"{name}c{count[0]}"
            count[0] += 1
            sigs[c] = {d: set(rng.sample("abc", rng.choice((0, 1, 1, 2)))) if rng.random() < 0.6 else set() for d in DIMENSIONS} | {"observed": set(rng.sample(list(DIMENSIONS), rng.randint(0, 8))) | (set(IDENTITY) if rng.random() < 0.5 else set())}
            out.append(c)
            rows.append((c, len(rows), len(rows) - len(out) + 1, list(path)))
        return out

    def container(path, depth):
        items = []
        for k in range(rng.randint(1, 3)):
            if depth < 2 and rng.random() < 0.45:
                groups[0] += 1
                g = f"{name}g{groups[0]}"
                items.append(tuple(container([*path, (g, f"arm{i}")], depth + 1) for i in range(rng.randint(1, 3))))
            elif not items or isinstance(items[-1], tuple):
                items.append(run(path, rng.randint(1, 4)))
        return items

    tree = container([], 0)
    return tree, [(name, c, rank, f"r{start}", path, True) for c, rank, start, path in rows], sigs


@pytest.fixture(scope="module")
def random_methods():
    rng = random.Random(21)
    return [random_method(rng, f"m{i}") for i in range(16)], rng


CALL = f"method string, id string, rank int, run string, arm_path {GUARDS}, eligible boolean"


def tables(spark, found):
    rows = [r for _, rs, _ in found for r in rs]
    sigs = [(c, *(sorted(s[d]) for d in ALL)) for _, _, ss in found for c, s in ss.items()]
    return spark.createDataFrame(rows, CALL), spark.createDataFrame(sigs, "id string, " + ", ".join(f"{d} array<string>" for d in ALL))


def test_methods_by_a_plain_reading(spark, random_methods):
    found, rng = random_methods
    calls, sigs = tables(spark, found)
    ids = [r[1] for _, rs, _ in found for r in rs]
    retained = {c for c in ids if rng.random() < 0.12}
    flow = {(a, b) for a, b in zip(ids, ids[1:]) if rng.random() < 0.1}
    marked = calls.withColumn("retained", F.col("id").isin(*retained))
    members, gates = methods.analyse_methods(marked, sigs, spark.createDataFrame(sorted(flow), "src string, dst string"))
    got = {}
    for r in members.orderBy("method", "at", "seq").collect():
        got.setdefault(r["method"], {}).setdefault(r["at"], []).append(r["id"])
    want = {rows[0][0]: Method(tree, ss, flow, retained) for tree, rows, ss in found}
    merged = {m: sorted(map(sorted, w.result)) for m, w in want.items() if any(w.result)}
    assert {m: sorted(map(sorted, p.values())) for m, p in got.items()} == merged
    assert sorted(r["gate"] for r in gates.collect()) == sorted(g for w in want.values() for g in w.gates)
    assert any("region" in g for w in want.values() for g in w.gates)


def test_folded_methods_equal_rounds(spark, random_methods):
    """Methods folded in tasks and in rounds: the same members, places, gates and verdicts."""
    found = sorted(random_methods[0], key=lambda f: len(f[1]))[8:12]
    _, sigs = tables(spark, found)
    rng, members, pairs = random.Random(4), [("alone", "x", 1, "x", 0)], [("nobody", 1, "p", "q")]
    for _, rows, _ in found:
        m, cs = rows[0][0], [r[1] for r in rows]
        members += [(m, cs[i - i % 2], i // 2 + 1, c, i % 2) for i, c in enumerate(cs)]
        pairs += [(m, k + 1, *rng.sample([*cs, "retained"], 2)) for k in range(3)]
    frames = spark.createDataFrame(members, "method string, phase string, at int, id string, seq int"), spark.createDataFrame(pairs, "method string, rank int, left_id string, right_id string")
    flow = spark.createDataFrame([pairs[1][2:]], "src string, dst string")
    got = []
    for fold in (0, 10_000):
        after, gates = methods.merge_boundaries(*frames, sigs, flow, fold=fold)
        got.append((sorted(map(tuple, after.select("method", "phase", "at", "id", "seq").collect())), sorted(map(repr, gates.select("method", "gate", "left_id", "right_id", "told").collect()))))
    assert got[0] == got[1] and len(got[0][0]) == len(members) and got[0][1]


def test_bottom_up(spark, random_methods):
    found, rng = random_methods
    found = found[:8]
    calls, sigs = tables(spark, found)
    ids = [[r[1] for r in rows] for _, rows, _ in found]
    names = [rows[0][0] for _, rows, _ in found]
    targets = [(ids[i][0], names[j]) for i, j in ((0, 1), (1, 2), (0, 3), (4, 5), (5, 4), (6, 4), (7, 7))] + [(ids[2][-1], "outside")]
    members, gates, retained, counts = methods.analyse_bottom_up(calls, spark.createDataFrame(targets, "id string, target string"), sigs, spark.createDataFrame([], "src string, dst string"))
    sizes, kept = {}, {}
    for i in (2, 3, 1, 0):
        mine = [(c, t) for c, t in targets if c in ids[i] and t in sizes]
        most = {c: max(sizes[t] for d, t in mine if d == c) for c, _ in mine}
        held = {c for c, n in most.items() if n > 1}
        m = Method(found[i][0], found[i][2], set(), held)
        sizes[names[i]] = sum(map(bool, m.result)) + sum(most[c] for c in held)
        kept |= {c: most[c] for c in held}
    want = sizes | {names[i]: None for i in (4, 5, 6, 7)}
    assert {r["method"]: r["count"] for r in counts.collect()} == want
    assert {r["id"]: r["count"] for r in retained.collect()} == kept | {ids[i][0]: None for i in (4, 5, 6, 7)}


def test_retained_calls_come_back(spark, random_methods):
    """Against a plain loop over methods from the last to the first, whose calls lead to later ones."""
    found, rng = random_methods
    found = found[:10]
    calls, sigs = tables(spark, found)
    ids = [[r[1] for r in rows] for _, rows, _ in found]
    names = [rows[0][0] for _, rows, _ in found]
    every = {c: s for _, _, ss in found for c, s in ss.items()}
    members, gates, retained, near, targets, flow = [], [], [], [], [], set()
    state = {}
    for i, name in enumerate(names):
        held = set(rng.sample(ids[i], min(len(ids[i]), rng.randint(1, 3))))
        free = [c for c in ids[i] if c not in held]
        phases, at = [], 0
        while at < len(free):
            n = rng.randint(1, 3)
            phases.append(free[at : at + n])
            at += n
        for k, p in enumerate(phases):
            members += [(name, p[0], k + 1, c, n) for n, c in enumerate(p)]
        pairs = list(zip(free, free[1:]))
        gates += [(name, f"{a}-{b}", a, b) for a, b in pairs]
        fronts = {c: (rng.sample(ids[i], min(len(ids[i]), rng.randint(0, 2))), rng.sample(ids[i], min(len(ids[i]), rng.randint(0, 2)))) for c in held}
        near += [(name, c, *f) for c, f in fronts.items()]
        retained += [(name, c, ids[i].index(c)) for c in held]
        leads = {c: rng.choice([*names[i + 1 :], "outside"]) for c in held}
        targets += leads.items()
        flow |= {(a, c) for c, (b, _) in fronts.items() for a in b if rng.random() < 0.3}
        state[name] = {"phases": phases, "gates": pairs, "held": held, "near": fronts, "leads": leads, "ids": ids[i]}

    def count(name):
        return len(state[name]["phases"]) + sum(n for n in (count(state[name]["leads"][c]) if state[name]["leads"][c] in state else 0 for c in state[name]["held"]) if n > 1)

    for name in reversed(names):
        s = state[name]
        while True:
            loose = [c for c in s["ids"] if c in s["held"] and (s["leads"][c] not in state or count(s["leads"][c]) <= 1)]
            if not loose:
                break
            c = loose[0]
            sides = []
            for k, ends in enumerate(s["near"][c]):
                mine = []
                for f in ends:
                    p = next((p for p in s["phases"] if f in p), None)
                    if p is None:
                        continue
                    a, b = (f, c) if k == 0 else (c, f)
                    if (a, b) in flow or every[a]["fields_written"] & every[b]["fields_read"] or judge(core([every[x] for x in p]), every[c]) == "RELATED":
                        mine.append(p)
                sides.append(mine)
            related = sides[0] + sides[1]
            beside = related or [p for ends in s["near"][c] for f in ends for p in s["phases"] if f in p]
            place = min((s["phases"].index(p) for p in beside), default=len(s["phases"]))
            new = list(dict.fromkeys([x for p in sides[0] for x in p] + [c] + [x for p in sides[1] for x in p]))
            s["phases"] = [p for p in s["phases"] if not any(p is q for q in related)]
            s["phases"].insert(place, new)
            s["held"].discard(c)
            s["gates"] = [(a, b) for a, b in s["gates"] if not (a in new and b in new)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = methods.recheck_retained(
        frame(members, "method string, phase string, at int, id string, seq int"), frame(gates, "method string, gate string, left_id string, right_id string"), frame(retained, "method string, id string, rank int"), frame(targets, "id string, target string"),
        frame(near, "method string, id string, before array<string>, after array<string>"), sigs, frame(sorted(flow) or [("-", "-")], "src string, dst string"),
    )
    phases = {}
    for r in got[0].orderBy("method", "at", "seq").collect():
        phases.setdefault(r["method"], {}).setdefault(r["at"], []).append(r["id"])
    assert {m: list(p.values()) for m, p in phases.items()} == {m: s["phases"] for m, s in state.items() if s["phases"]}
    assert sorted(r["gate"] for r in got[1].collect()) == sorted(f"{a}-{b}" for s in state.values() for a, b in s["gates"])
    assert {r["id"] for r in got[2].collect()} == {c for s in state.values() for c in s["held"]}


def test_whole_analysis(spark, random_methods):
    """Every call is in one phase or retained; merges leave no gate between phases; callees of one phase are put back."""
    found = random_methods[0][10:12]
    calls, sigs = tables(spark, found)
    calls = calls.withColumns({"callee": F.col("id"), "code": F.lit("x()")})
    ids = [[r[1] for r in rows] for _, rows, _ in found]
    names = [rows[0][0] for _, rows, _ in found]
    targets = spark.createDataFrame([(ids[0][0], names[1])], "id string, target string")
    flow = spark.createDataFrame([], "src string, dst string")
    plain = methods.analyse_phases(calls, targets, sigs, flow)
    yes = lambda asked: asked.select("method", "gate", F.lit("MERGE").alias("action"), F.lit(0.9).alias("confidence"), F.lit("same").alias("evidence"))
    got = methods.analyse_phases(calls, targets, sigs, flow, yes)
    assert plain["questions"].count() == plain["decisions"].count() if "decisions" in plain else plain["questions"].count() > 0
    placed = [r["id"] for r in got["members"].collect()] + [r["id"] for r in got["retained"].collect()]
    assert sorted(placed) == sorted(c for x in ids for c in x)
    assert got["questions"].count() == 0 and got["decisions"].where("action = 'MERGE'").count() > 0
    assert got["members"].select("method", "phase").distinct().count() < plain["members"].select("method", "phase").distinct().count()
