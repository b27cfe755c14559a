"""Flows and cuts against augmenting paths and against all sets of nodes, on random graphs."""

import random
from itertools import combinations

import pytest

from skein.operators import flow

NODES = [f"v{i}" for i in range(7)]


def least_cut(arcs, sources, sinks):
    """Value, and the largest side of the sources of a least cut, by trying every set."""
    inner = [v for v in NODES if v not in sources and v not in sinks]
    best = None
    for k in range(len(inner) + 1):
        for some in combinations(inner, k):
            side = set(sources) | set(some)
            cost = sum(c for a, b, c in arcs if a in side and b not in side)
            if best is None or cost < best[0] or cost == best[0] and len(side) > len(best[1]):
                best = cost, side
    return best


def test_flow_is_greatest(spark):
    """Twelve graphs that share no node, as one."""
    arcs, sources, sinks, value, want = [], [], [], 0, {}
    for seed in range(12):
        rng = random.Random(seed)
        own = [(*rng.sample(NODES, 2), rng.randint(0, 9)) for _ in range(rng.choice([12, 22]))]
        s, t = ["v0", "v1"][: 1 + seed % 2], ["v6", "v5"][: 1 + seed // 2 % 2]
        cost, side = least_cut(own, s, t)
        value += cost
        for a, b, c in own:
            if a in side and b not in side and c:
                want[f"{seed}{a}", f"{seed}{b}"] = want.get((f"{seed}{a}", f"{seed}{b}"), 0) + c
        arcs += [(f"{seed}{a}", f"{seed}{b}", c) for a, b, c in own]
        sources += [f"{seed}{v}" for v in s]
        sinks += [f"{seed}{v}" for v in t]
    odd = [("0v1", "0v1", 5), (None, "0v2", 3), ("0v2", "0v3", -4), ("0v2", "0v4", None)]
    frame = lambda ids: spark.createDataFrame([(v,) for v in [*ids, ids[0], None]], "id string")
    got = flow.max_flow(spark.createDataFrame([*arcs, *odd], "src string, dst string, capacity long").repartition(3), frame(sources), frame(sinks))
    assert got.value == value
    assert {(r.src, r.dst): r.capacity for r in got.cut.collect()} == want
    balance = {}
    for r in got.arcs.collect():
        assert 0 <= r.flow <= r.capacity
        balance[r.src] = balance.get(r.src, 0) - r.flow
        balance[r.dst] = balance.get(r.dst, 0) + r.flow
    assert all(x == 0 for v, x in balance.items() if v not in sources and v not in sinks)
    assert sum(balance.get(v, 0) for v in sinks) == value


def test_flow_of_a_hub_and_a_path(spark, monkeypatch):
    monkeypatch.setattr(flow, "BLOCK", 4)
    monkeypatch.setattr(flow, "TABLES", 3)
    hub = [("s", "h", 30)] + [x for i in range(40) for x in (("h", f"m{i:02}", 1), (f"m{i:02}", "p0", 1))]
    path = [(f"p{i}", f"p{i + 1}", 25) for i in range(3)] + [("p3", "t", 99)]
    got = flow.max_flow(spark.createDataFrame(hub + path, "src string, dst string, capacity long"), spark.createDataFrame([("s",)], "id string"), spark.createDataFrame([("t",)], "id string"))
    assert got.value == 25 and [tuple(r) for r in got.cut.collect()] == [("p2", "p3", 25)]
    assert sum(r.flow for r in got.arcs.where("src = 'h'").collect()) == 25


def test_flow_without_a_way(spark):
    arcs = spark.createDataFrame([("a", "b", 1)], "src string, dst string, capacity long")
    one = lambda v: spark.createDataFrame([(v,)], "id string")
    for rows, s, t in ((arcs, "b", "a"), (arcs, "x", "b"), (arcs.limit(0), "a", "b")):
        got = flow.max_flow(rows, one(s), one(t))
        assert got.value == 0 and got.cut.isEmpty() and got.arcs.where("flow > 0").isEmpty()
    with pytest.raises(ValueError):
        flow.max_flow(arcs, one("a"), one("a"))


def parted(edges, gone, sources, targets):
    reach = set(sources)
    while True:
        more = {b for a, b in edges if a in reach and b not in gone} - reach
        if not more:
            return not reach & set(targets)
        reach |= more


def test_vertex_cut_is_least(spark):
    rng = random.Random(10)
    ways = {tuple(sorted(rng.sample(NODES, 2))) for _ in range(11)} - {("v0", "v6")}
    weight = {v: rng.randint(1, 3) for v in NODES}
    edges = [e for a, b in ways for e in ((a, b), (b, a))]
    inner = [v for v in NODES if v not in ("v0", "v6")]
    want = min(sum(weight[v] for v in some) for k in range(6) for some in combinations(inner, k) if parted(edges, set(some), ["v0"], ["v6"]))
    one = lambda v: spark.createDataFrame([(v,)], "id string")
    got = flow.vertex_cut(spark.createDataFrame(sorted(ways), "src string, dst string"), one("v0"), one("v6"), spark.createDataFrame(list(weight.items()), "id string, weight long")).collect()
    assert sum(r.weight for r in got) == want and parted(edges, {r.id for r in got}, ["v0"], ["v6"])
    with pytest.raises(ValueError):
        flow.vertex_cut(spark.createDataFrame([("v0", "v6")], "src string, dst string"), one("v0"), one("v6"))
