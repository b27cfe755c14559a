"""Distances, reachability and strong components of long paths against searches, on many small graphs at once and on shapes that loops are slow on."""

import random
from collections import deque

import pytest

from skein.operators import iterate, longpath


def shapes():
    """Arcs of disjoint graphs: random ones, a long path with a way back, a ring, a ladder of diamonds, trees, a grid, a clique and a hub."""
    rng = random.Random(9)
    arcs = []
    for g in range(60):
        n = rng.randint(2, 9)
        arcs += [(f"g{g}_{rng.randrange(n)}", f"g{g}_{rng.randrange(n)}") for _ in range(rng.randint(1, 16))]
    arcs += [(f"p{i:03}", f"p{i + 1:03}") for i in range(200)] + [("p150", "p050"), ("p020", "p120"), ("p199", "p180")]
    arcs += [(f"r{i:02}", f"r{(i + 1) % 40:02}") for i in range(40)]
    arcs += [(f"lone{i}", f"lone{(i + 1) % 5}") for i in range(5)]
    for i in range(25):
        arcs += [(f"d{i:02}", f"d{i:02}{s}") for s in "xy"] + [(f"d{i:02}{s}", f"d{i + 1:02}") for s in "xy"]
    arcs += [(f"t{i // 2:02}", f"t{i:02}") for i in range(1, 64)]
    arcs += [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [(f"c{i:02}", f"leg{i:02}") for i in range(30)]
    arcs += [(f"q{i}{j}", f"q{i + 1}{j}") for i in range(6) for j in range(7)] + [(f"q{i}{j}", f"q{i}{j + 1}") for i in range(7) for j in range(6)]
    arcs += [(f"k{i}", f"k{j}") for i in range(6) for j in range(6)]
    arcs += [("hub", f"leaf{i:03}") for i in range(100)] + [(f"leaf{i:03}", "hub") for i in range(0, 100, 3)]
    return arcs


SOURCES = ["g0_0", "g1_1", "g2_0", "g3_0", "g5_2", "g9_1", "g11_0", "g20_0", "g31_3", "g44_2", "p000", "p100", "r07", "d03x", "d00", "t01", "t10", "c00", "c17", "q00", "q24", "k2", "leaf003", "leaf004", "alone"]


def searched(arcs, start):
    ahead = {}
    for a, b in arcs:
        ahead.setdefault(a, set()).add(b)
    hops, queue = {s: 0 for s in start}, deque(start)
    while queue:
        v = queue.popleft()
        for w in ahead.get(v, ()):
            if w not in hops:
                hops[w] = hops[v] + 1
                queue.append(w)
    return hops


@pytest.fixture(scope="module")
def tables(spark):
    arcs = shapes()
    rows = [*arcs, *arcs[:20], (None, "p000"), ("p000", None), (None, None)]
    random.Random(1).shuffle(rows)
    return arcs, iterate.cut(spark.createDataFrame(rows, "src string, dst string").repartition(3)), iterate.cut(spark.createDataFrame([(s,) for s in [*SOURCES, "p000", None]], "id string"))


def test_distances_of_each_source(tables):
    arcs, edges, sources = tables
    rows = longpath.distances(edges, sources).collect()
    assert {(r.source, r.id): r.hops for r in rows} == {(s, v): h for s in SOURCES for v, h in searched(arcs, [s]).items()}
    assert len(rows) == len({(r.source, r.id) for r in rows})


@pytest.mark.parametrize("directed", [True, False])
def test_nearest_source(tables, directed):
    arcs, edges, sources = tables
    both = arcs if directed else arcs + [(b, a) for a, b in arcs]
    rows = longpath.nearest(edges, sources, directed).collect()
    assert sorted((r.id, r.hops) for r in rows) == sorted(searched(both, SOURCES).items())


def test_core_is_walked_where_contraction_stops(tables, monkeypatch):
    arcs, edges, sources = tables
    monkeypatch.setattr(longpath, "LEAST_SHRINK", 1.1)
    assert sorted(r.id for r in longpath.reachable(edges, sources).collect()) == sorted(searched(arcs, SOURCES))


@pytest.mark.parametrize("shrink", [0.1, 1.1])
def test_strong_components(spark, tables, monkeypatch, shrink):
    monkeypatch.setattr(longpath, "LEAST_SHRINK", shrink)
    arcs, edges, _ = tables
    nodes = {v for a in arcs for v in a} | {"alone"}
    reach = {v: set(searched(arcs, [v])) for v in nodes}
    expected = {v: min(w for w in reach[v] if v in reach[w]) for v in nodes}
    rows = longpath.strong_components(edges, spark.createDataFrame([("alone",), ("p000",), (None,)], "id string")).collect()
    assert sorted((r.id, r.component) for r in rows) == sorted(expected.items())


@pytest.mark.parametrize("block", [7, 10**6])
def test_strong_components_along_an_order(spark, tables, block):
    arcs, edges, _ = tables
    nodes = sorted({v for a in arcs for v in a} | {"alone"})
    reach = {v: set(searched(arcs, [v])) for v in nodes}
    order = spark.createDataFrame([(v, i) for i, v in enumerate(nodes) if v != "p060"] + [(None, 3), ("p061", 5), ("elsewhere", 9)], "id string, at long")
    rows = longpath.strong_components(edges, spark.createDataFrame([("alone",)], "id string"), order, block).collect()
    assert sorted((r.id, r.component) for r in rows) == sorted((v, min(w for w in reach[v] if v in reach[w])) for v in nodes)


def test_empty_and_odd_inputs(spark):
    none, ids = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(7,)], "id long")
    loop = spark.createDataFrame([(1, 1), (2, None)], "src long, dst long")
    assert longpath.nearest(none, ids.where("id < 0")).collect() == [] and longpath.strong_components(none).collect() == []
    assert [tuple(r) for r in longpath.distances(none, ids).collect()] == [(7, 7, 0)]
    assert [tuple(r) for r in longpath.nearest(loop, ids).collect()] == [(7, 0)]
    assert [tuple(r) for r in longpath.strong_components(loop, ids).orderBy("id").collect()] == [(1, 1), (7, 7)]
    ring = spark.createDataFrame([(i, i % 9 + 1) for i in range(1, 10)], "src long, dst long")
    assert {r.component for r in longpath.strong_components(ring).collect()} == {1}
    assert longpath.nearest(ring, ids.where("id < 0")).collect() == [] and {r.id: r.hops for r in longpath.nearest(ring, ids).collect()} == {i: (i - 7) % 9 for i in range(1, 10)}


def test_long_path_ends_in_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(longpath, "cut", lambda df: written.append(1) or iterate.cut(df))
    path = spark.range(5000).selectExpr("id AS src", "id + 1 AS dst")
    far = longpath.nearest(path, spark.createDataFrame([(0,)], "id long"))
    assert far.where("hops <> id").isEmpty() and far.count() == 5001 and len(written) < 30
    written.clear()
    whole = longpath.strong_components(path.unionByName(spark.createDataFrame([(4000, 1000)], "src long, dst long")))
    assert {r.component: r["count"] for r in whole.where("id between 1000 and 4000 or id < 3").groupBy("component").count().collect()} == {0: 1, 1: 1, 2: 1, 1000: 3001} and len(written) < 50
