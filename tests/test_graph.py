import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.graph import PropertyGraph
from skein.operators import centrality, dense, geometry, topology, traverse


def graph(spark, pairs, **columns):
    rows = [(a, b, i, *(v[i] for v in columns.values())) for i, (a, b) in enumerate(pairs)]
    return PropertyGraph.of_edges(spark.createDataFrame(rows, ["src", "dst", "pos", *columns]))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def got(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


#: Two squares that share a corner, a pendant path of two edges on one of them, and an edge apart.
SQUARES = [("k", "l"), ("l", "m"), ("m", "n"), ("n", "k"), ("m", "o"), ("o", "p"), ("p", "q"), ("q", "m"), ("p", "u"), ("u", "v"), ("y", "z")]


def random_digraph(seed, n, edges):
    """Distinct edges without loops, and a cost for each."""
    random = np.random.default_rng(seed)
    pairs = sorted({(f"v{a}", f"v{b}") for a, b in random.integers(0, n, (edges, 2)).tolist() if a != b})
    return pairs, np.round(random.uniform(1, 9, len(pairs)), 2).tolist()


def pieces(nodes, pairs):
    """Number of connected components, counted by search."""
    left, n = set(nodes), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            v = todo.pop()
            near = {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}
            todo += near & left
            left -= near
    return n


def paths_between(pairs, s, t, at=()):
    """All simple paths."""
    at = at or (s,)
    if at[-1] == t:
        yield at
        return
    for a, b in pairs:
        if a == at[-1] and b not in at:
            yield from paths_between(pairs, s, t, (*at, b))


def test_undirected_takes_first_and_drops_loops(spark):
    g = graph(spark, [("b", "a"), ("a", "b"), ("a", "a")], weight=[2.0, 5.0, 1.0])
    assert [tuple(r) for r in g.undirected().select("a", "b", "weight").collect()] == [("a", "b", 2.0)]


def test_costs_take_last_and_clamp(spark):
    g = graph(spark, [("a", "b"), ("a", "b"), ("b", "c")], cost=[3.0, 4.0, -1.0])
    assert {(r.src, r.dst): r.cost for r in g.costs().collect()} == {("a", "b"): 4.0, ("b", "c"): 0.0}


def test_valid_drops_dangling(spark):
    g = graph(spark, [("a", "b"), ("b", "x")])
    g = PropertyGraph(g.nodes.where("id <> 'x'"), g.edges)
    assert g.valid().edges.count() == 1


def test_components_and_betti(spark):
    g = graph(spark, SQUARES)
    assert got(traverse.components(g.edges), "id", "component") == {**dict.fromkeys("klmnopquv", "k"), "y": "y", "z": "y"}
    r = topology.betti_numbers(g.undirected()).first()
    assert (r.n_nodes, r.n_edges, r.b0, r.b1) == (11, 11, 2, 2)


def test_components_long_path(spark):
    names = [f"v{i:03d}" for i in range(120)]
    g = graph(spark, list(zip(names[:-1], names[1:], strict=True)))
    assert set(got(traverse.components(g.edges), "id", "component").values()) == {"v000"}


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert traverse.components(empty).count() == 0
    assert got(traverse.components(empty, ids(spark, "a")), "id", "component") == {"a": "a"}


def test_removed_nodes(spark):
    g = graph(spark, SQUARES)
    left = traverse.components_without(g.edges, g.nodes, ids(spark, "m", "u"))
    assert len(set(got(left, "id", "component").values())) == 4


def test_strong_components(spark):
    g = graph(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "a")])
    strong = traverse.strongly_connected(g.edges, g.nodes)
    assert got(strong, "id", "component") == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}
    assert {r.id for r in traverse.largest_component(strong).collect()} == {"a", "b"}
    assert got(topology.cycle_membership(g.edges, strong), "id", "in_cycle") == {"a": True, "b": True, "c": True, "d": True, "e": False}


def test_reach_and_hops(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("x", "c")])
    assert {r.id for r in traverse.reachable(g.edges, ids(spark, "a")).collect()} == {"a", "b", "c"}
    assert {r.id for r in traverse.reaching(g.edges, ids(spark, "c")).collect()} == {"a", "b", "c", "x"}
    assert got(traverse.hop_distances(g.edges, ids(spark, "a")), "id", "hops") == {"a": 0, "b": 1, "c": 2, "x": 3}
    assert got(traverse.entailed(g.edges, ids(spark, "a"), ids(spark, "c", "x")), "id", "entailed") == {"c": True, "x": False}


def test_simple_paths_bound_nodes(spark):
    g = graph(spark, [("s", "a"), ("a", "t"), ("s", "b"), ("b", "c"), ("c", "t"), ("s", "a")])
    paths = [r.nodes for r in traverse.simple_paths(g.edges, ids(spark, "s"), ids(spark, "t"), 3).collect()]
    assert paths == [["s", "a", "t"]] * 2
    assert traverse.simple_paths(g.edges, ids(spark, "s"), ids(spark, "t"), 4).count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_paths_brute(spark, seed):
    pairs, costs = random_digraph(seed, 9, 30)
    g = graph(spark, pairs, cost=costs)
    cost = dict(zip(pairs, costs, strict=True))
    for r in traverse.cheapest_paths(g.edges, ids(spark, "v0", "v1"), g.nodes).collect():
        ways = [sum(cost[e] for e in zip(p, p[1:], strict=False)) for s in ("v0", "v1") for p in paths_between(pairs, s, r.target)]
        assert r.cost == pytest.approx(min(ways)) and sum(cost[e] for e in zip(r.nodes, r.nodes[1:], strict=False)) == pytest.approx(r.cost)


def test_pagerank_sums_to_one(spark):
    g = graph(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")])
    assert sum(got(centrality.pagerank(g.edges, g.nodes), "id", "rank").values()) == pytest.approx(1)


def test_centralities_against_eigenvectors(spark):
    pairs, _ = random_digraph(4, 7, 40)
    g = graph(spark, pairs)
    names = sorted({v for p in pairs for v in p})
    a = np.zeros((len(names), len(names)))
    for x, y in pairs:
        a[names.index(x), names.index(y)] = 1

    def leading(m):
        values, vectors = np.linalg.eig(m)
        v = np.abs(vectors[:, int(np.argmax(values.real))].real)
        return v / v.sum()

    near = lambda df, column, want: [r[column] for r in df.orderBy("id").collect()] == pytest.approx(want.tolist(), abs=2e-6)
    h = centrality.hits(g.edges, g.nodes, most=1000).cache()
    assert near(h, "authority", leading(a.T @ a)) and near(h, "hub", leading(a @ a.T))
    assert near(centrality.eigenvector_centrality(g.edges, g.nodes), "score", leading(a.T))
    x = np.asarray([r.score for r in centrality.katz_centrality(g.edges, g.nodes).orderBy("id").collect()])
    y = 1 + 0.1 * a.T @ x
    assert x == pytest.approx(y / y.max(), abs=1e-5)


def test_unsettled_vectors_raise(spark):
    turn = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c")])
    for run in (lambda: centrality.eigenvector_centrality(turn.edges, turn.nodes, most=3), lambda: centrality.hits(turn.edges, turn.nodes, tol=1e-15, most=2), lambda: centrality.hitting_probabilities(turn.edges, turn.nodes, ids(spark, "d"), most=1)):
        with pytest.raises(RuntimeError, match="settle"):
            run()


def test_betweenness_path(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert got(centrality.betweenness(g.edges, g.nodes), "id", "score") == {"a": 0, "b": 2, "c": 2, "d": 0}


def test_betweenness_beyond_the_edge_list(spark):
    pairs = [(f"v{a}", f"v{b}") for a in range(9) for b in range(9) if (a * 7 + b * 5) % 4 == 1]
    g = graph(spark, [*pairs, ("v8", "w"), ("w", "x")])
    want = got(centrality.betweenness(g.edges, g.nodes), "id", "score")
    assert max(want.values()) > 1
    for rows in (20, 10**6):
        assert got(centrality.betweenness(g.edges, g.nodes, most_edges=0, block_rows=rows), "id", "score") == pytest.approx(want)


@pytest.mark.parametrize("seed", [5, 6])
def test_hitting_brute(spark, seed):
    pairs, _ = random_digraph(seed, 8, 14)
    g = graph(spark, pairs)
    names = sorted({v for p in pairs for v in p})
    goal, want = names[-1], dict.fromkeys(names, 0.0)
    for _ in range(5000):
        out = {v: [b for a, b in pairs if a == v] for v in names}
        want = {v: 1.0 if v == goal else sum(want[b] for b in out[v]) / len(out[v]) if out[v] else 0.0 for v in names}
    loop = centrality.hitting_probabilities(g.edges, g.nodes, ids(spark, goal))
    assert got(loop, "id", "probability") == pytest.approx(want, abs=1e-5)
    assert got(dense.hitting_exact(g.edges, [goal]), "id", "probability") == pytest.approx(want, abs=1e-8)
    ranked = [r.probability for r in centrality.hitting_rank(loop, g.nodes).collect()]
    assert ranked == sorted(ranked, reverse=True) and len(ranked) == sum(v > 1e-6 for v in want.values())


def test_curvature(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    f = {(r.a, r.b): r.curvature for r in geometry.forman_ricci(g.undirected()).collect()}
    assert f == {("a", "b"): 0, ("b", "c"): -1, ("a", "c"): -1, ("c", "d"): 0}
    k3 = graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    exact = {(r.a, r.b): r.curvature for r in geometry.ollivier_ricci(k3.undirected()).collect()}
    assert all(v == pytest.approx(0.75) for v in exact.values())
    near = {(r.a, r.b): r.curvature for r in geometry.ollivier_ricci(k3.undirected(), reg=0.05, iterations=200).collect()}
    assert all(near[k] == pytest.approx(v, abs=0.05) for k, v in exact.items())
    p2 = geometry.ollivier_ricci(graph(spark, [("a", "b"), ("b", "c"), ("c", "d")]).undirected())
    assert {(r.a, r.b): r.curvature for r in p2.collect()}[("b", "c")] == pytest.approx(0.0)


@pytest.mark.parametrize("pairs", [SQUARES, random_digraph(7, 12, 15)[0], random_digraph(8, 9, 16)[0]])
def test_cut_points_and_bridges_brute(spark, pairs):
    g, nodes = graph(spark, pairs), {v for p in pairs for v in p}
    base = pieces(nodes, pairs)
    added = {v: pieces(nodes - {v}, [p for p in pairs if v not in p]) - base for v in nodes}
    assert got(dense.articulation_points(g.edges), "id", "added") == {v: n for v, n in added.items() if n > 0}
    simple = {tuple(sorted(p)) for p in pairs}
    assert {(r.a, r.b) for r in dense.bridges(g.edges).collect()} == {p for p in simple if pieces(nodes, simple - {p}) > base}


@pytest.mark.parametrize("seed", [9, 10, 11])
def test_vertex_cut_and_flow_brute(spark, seed):
    pairs, costs = random_digraph(seed, 8, 26)
    pairs, costs = zip(*[(p, c) for p, c in zip(pairs, costs, strict=True) if p != ("v0", "v7")], strict=True)
    g, cost = graph(spark, list(pairs), cost=list(costs)), dict(zip(pairs, costs, strict=True))
    inner = sorted({v for p in pairs for v in p} - {"v0", "v7"})
    blocks = lambda gone: not any(True for _ in paths_between([p for p in pairs if not gone & set(p)], "v0", "v7"))
    least = next(k for k in range(len(inner) + 1) if any(blocks(set(c)) for c in combinations(inner, k)))
    r = dense.min_vertex_cut(g.edges, ["v0"], ["v7"]).first()
    assert r["size"] == least == len(r["cut"]) and blocks(set(r["cut"]))
    direct = graph(spark, [*pairs, ("v0", "v7")])
    assert tuple(dense.min_vertex_cut(direct.edges, ["v0"], ["v7"]).first())[1:] == (0, [])
    ways = list(paths_between(pairs, "v0", "v7"))
    price = lambda p: sum(cost[e] for e in zip(p, p[1:], strict=False))
    for k in (1, 2):
        sets = [c for c in combinations(ways, k) if all(not set(a[1:-1]) & set(b[1:-1]) for a, b in combinations(c, 2))]
        f = dense.min_cost_flow(g.edges, ["v0"], ["v7"], k).first()
        assert f["flow"] == min(k, least)
        if sets:
            assert f["cost"] == pytest.approx(min(sum(map(price, c)) for c in sets)) == sum(price(p) for p in f["paths"])
            assert all(tuple(p) in ways for p in f["paths"]) and len(f["paths"]) == f["flow"]


@pytest.mark.parametrize("seed", [12, 13])
def test_plan_brute(spark, seed):
    pairs, costs = random_digraph(seed, 6, 9)
    rules = [(["v1", "v2"], "w", 2.5), (["v3", "w"], "x", 1.5), (["v4"], "x", 40.0)]
    actions = [({a}, b, c) for (a, b), c in zip(pairs, costs, strict=True)] + [(set(n), t, c) for n, t, c in rules]
    best = math.inf
    for k in range(len(actions) + 1):
        for some in combinations(actions, k):
            held, todo = {"v0"}, list(some)
            while ready := [x for x in todo if x[0] <= held]:
                held |= {x[1] for x in ready}
                todo = [x for x in todo if x not in ready]
            if "x" in held:
                best = min(best, sum(x[2] for x in some))
    r = dense.cheapest_plan(graph(spark, pairs, cost=costs).edges, ["v0"], "x", rules).first()
    assert (r["cost"] if r["cost"] is not None else math.inf) == pytest.approx(best)


def test_directed_laplacian_of_largest_component(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)]
    rows = dense.directed_laplacian(graph(spark, [*ring, ("t", "r0"), ("r2", "u"), ("p", "q"), ("q", "p")]).edges, teleport=0.0).collect()
    assert sorted(r.id for r in rows) == [f"r{i}" for i in range(5)]
    # On a ring of uniform walks the second value is 1 - cos(2 pi / 5).
    whole = dense.directed_laplacian(graph(spark, ring).edges, teleport=0.0).first().value
    assert whole == pytest.approx(1 - math.cos(2 * math.pi / 5))


def test_fiedler_of_path(spark):
    rows = dense.fiedler(graph(spark, [("0", "1"), ("1", "2"), ("2", "3")]).edges).collect()
    assert rows[0].value == pytest.approx(2 - 2 * math.cos(math.pi / 4))
    signs = [r.v > 0 for r in sorted(rows, key=lambda r: r.id)]
    assert sum(a != b for a, b in zip(signs, signs[1:], strict=False)) == 1


@pytest.mark.parametrize(("pairs", "restricted", "full"), [
    ([("a", "b"), ("b", "a")], 1, 1),
    ([("a", "b"), ("a", "c"), ("b", "c")], 0, 0),
    ([("a", "b"), ("b", "c"), ("c", "a")], 1, 1),
    ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], 1, 0),
])
def test_path_homology(spark, pairs, restricted, full):
    e = graph(spark, pairs).edges
    assert dense.path_homology(e, "restricted").first()["b1"] == restricted
    assert dense.path_homology(e, "full").first()["b1"] == full


def test_cycle_basis_counts(spark):
    assert dense.cycle_basis(graph(spark, SQUARES).edges).count() == 2


def test_two_paths(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("b", "a")])
    assert {tuple(r) for r in topology.allowed_two_paths(g.directed()).collect()} == {("a", "b", "c"), ("b", "a", "c")}


def test_mapper_of_path(spark):
    names = [str(i) for i in range(9)]
    g = graph(spark, list(zip(names[:-1], names[1:], strict=True)))
    values = spark.createDataFrame([(n, float(n)) for n in names], "id string, f double")
    clusters, nerve = topology.mapper(values, g.undirected(), 4, 0.3)
    n = clusters.select("cluster").distinct().count()
    assert n == 4 and nerve.count() == n - 1


def test_cap_raises(spark):
    g = graph(spark, [("a", "b"), ("b", "c")])
    with pytest.raises(Exception, match="more than 2"):
        dense.fiedler(g.edges, cap=2).collect()


def test_undirected_keeps_no_order_of_frame(spark):
    g = graph(spark, SQUARES)
    assert g.neighbours().where(F.col("id") == "m").first()["out_degree"] == 2


def test_small_graphs_across_batches(spark):
    rows = [(f"g{g}", f"n{i}", f"n{i + 1}") for g in range(7) for i in range(g)]
    edges = spark.createDataFrame(rows, "graph_id string, src string, dst string")
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 3, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, dense.bridges(edges).collect())) == sorted(rows)
        assert dense.bridges(edges.where("false")).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def brute_betweenness(pairs):
    out, names = {}, {x for p in pairs for x in p}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    depth, paths = {}, {}
    for s in names:
        depth[s], paths[s], level = {s: 0}, {s: 1}, [s]
        while level:
            new = {}
            for a in level:
                for b in out.get(a, set()) - depth[s].keys():
                    new[b] = new.get(b, 0) + paths[s][a]
            depth[s].update(dict.fromkeys(new, len(depth[s]) and depth[s][level[0]] + 1))
            paths[s].update(new)
            level = list(new)
    between = lambda v, s, t: v in depth[s] and t in depth[v] and depth[s][v] + depth[v][t] == depth[s][t]
    return {v: sum(paths[s][v] * paths[v][t] / paths[s][t] for s in names for t in depth[s] if len({v, s, t}) == 3 and between(v, s, t)) for v in names}


@pytest.mark.parametrize("most_edges", [5_000_000, 0])
def test_betweenness_with_trees_on_a_directed_core(spark, most_edges):
    dice = np.random.default_rng(3)
    pairs = {(f"v{a}", f"v{b}") for a, b in dice.integers(0, 12, (30, 2)) if a != b} | {("in", "v1"), ("v2", "out")}
    for i in range(16):
        hung = [f"t{i}", f"v{i}" if i < 7 else f"t{(i * 5) % 7 if i < 13 else i - 3}"]
        pairs |= {tuple(hung), tuple(hung[::-1])}
    pairs |= {p for a, b in [("x", "y"), ("y", "z"), ("z", "w"), ("z", "u")] for p in ((a, b), (b, a))}
    g = graph(spark, sorted(pairs))
    assert got(centrality.betweenness(g.edges, g.nodes, most_edges=most_edges), "id", "score") == pytest.approx(brute_betweenness(pairs))


def test_betweenness_of_a_large_tree(spark):
    n, k = 200_000, 10
    ends = spark.range(n).select(F.concat(F.lit("l"), "id").alias("src"), F.concat(F.lit("h"), F.col("id") % k).alias("dst")).unionByName(spark.range(k).select(F.concat(F.lit("h"), "id").alias("src"), F.lit("r").alias("dst")))
    found = got(centrality.betweenness(traverse.both_ways(ends), ends.select(F.col("dst").alias("id"))), "id", "score")
    hang, whole = n // k, n + k + 1
    assert found["r"] == (whole - 1) ** 2 - k * (hang + 1) ** 2 and found["h3"] == (whole - 1) ** 2 - hang - (whole - 1 - hang) ** 2
