"""Forests, blocks, cycles and spectra against brute force, on many small graphs at once and on shapes that are hard for loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import forest, iterate, spectra


def random_graphs(n_graphs):
    """Edges of disjoint random graphs, of a long path, a hub and two circles that share a node."""
    rng = random.Random(4)
    edges = set()
    for g in range(n_graphs):
        n = rng.randint(2, 9)
        for _ in range(rng.randint(1, 13)):
            a, b = rng.sample(range(n), 2)
            edges.add((f"g{g}_{min(a, b)}", f"g{g}_{max(a, b)}"))
    edges |= {(f"path{i:03}", f"path{i + 1:03}") for i in range(70)}
    edges |= {("hub", f"leaf{i:03}") for i in range(150)}
    edges |= {(f"ring{c}{i}" if i else "ring", f"ring{c}{i + 1}" if i < 4 else "ring") for c in "xy" for i in range(5)}
    return sorted((min(e), max(e)) for e in edges)


def n_components(nodes, edges):
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[find(a)] = find(b)
    return len({find(v) for v in nodes})


@pytest.fixture(scope="module")
def graph(spark):
    edges = random_graphs(40)
    weight = {e: float(random.Random(str(e)).randint(1, 4)) for e in edges}
    rows = [(b, a, weight[a, b]) if i % 2 else (a, b, weight[a, b]) for i, (a, b) in enumerate(edges)]
    df = spark.createDataFrame([*rows, ("path000", "path000", 1.0), (None, "x", 1.0), *rows[:9]], "a string, b string, weight double").repartition(3)
    return edges, weight, df, forest.rooted_forest(df)


def test_forest_is_rooted(graph):
    edges, _, _, g = graph
    names = {r.n: r.id for r in g.names.collect()}
    tree = {names[r.n]: (names.get(r.parent), r.first, r.last) for r in g.tree.collect()}
    nodes = {v for e in edges for v in e}
    assert set(tree) == nodes and sum(p is None for p, _, _ in tree.values()) == n_components(nodes, edges)
    for v, (p, first, last) in tree.items():
        seen = v
        while tree[seen][0] is not None:
            seen = tree[seen][0]
            assert tree[seen][1] < first <= last < tree[seen][2] or tree[seen][0] is None and tree[seen][1] < first
        assert p is None or (min(v, p), max(v, p)) in set(edges)


def test_blocks_bridges_and_cut_vertices(graph):
    edges, _, df, g = graph
    found = forest.blocks(df, g)
    rows = {(r.a, r.b): r.block for r in found.collect()}
    assert set(rows) == set(edges)
    nodes = sorted({v for e in edges for v in e})
    whole = n_components(nodes, edges)
    near = {v: [e for e in edges if v in e] for v in nodes}
    assert {(r.a, r.b) for r in forest.bridges(found).collect()} == {e for e in edges if n_components(nodes, [x for x in edges if x != e]) > whole}
    added = {v: n_components([x for x in nodes if x != v], [e for e in edges if v not in e]) - whole for v in nodes}
    assert {r.id: r.added for r in forest.cut_vertices(found).collect()} == {v: k for v, k in added.items() if k > 0}
    # Neighbouring edges share a block exactly if their other ends meet without the node between them.
    for v in nodes:
        for e in near[v][:6]:
            for f in near[v][:6]:
                x, y = (set(e) - {v}).pop(), (set(f) - {v}).pop()
                left = [z for z in edges if v not in z]
                apart = n_components([z for z in nodes if z != v], left) > n_components([z for z in nodes if z != v], [*left, (x, y)])
                assert (rows[e] == rows[f]) == (e == f or not apart)


def test_cycles_are_a_basis_of_least_births(graph):
    edges, weight, df, g = graph
    walks = {}
    for r in forest.fundamental_cycles(df, g).collect():
        walks.setdefault((r.a, r.b, r.birth), []).append((r.pos, r.id))
    nodes = {v for e in edges for v in e}
    assert len(walks) == len(edges) - len(nodes) + n_components(nodes, edges)
    for (a, b, birth), rows in walks.items():
        rows.sort()
        ids = [x for _, x in rows]
        assert [p for p, _ in rows] == list(range(len(rows))) and ids[0] == a and ids[-1] == b and len(set(ids)) == len(ids) > 2
        used = [(min(p, q), max(p, q)) for p, q in zip(ids, ids[1:], strict=False)]
        assert all(weight[e] <= birth for e in used) and weight[a, b] == birth


def test_empty_graph_has_no_blocks(spark):
    none = spark.createDataFrame([], "a string, b string, weight double")
    found = forest.blocks(none)
    assert found.count() == 0 and forest.cut_vertices(found).count() == 0


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(2).sample(range(999), 200)], "v long")
    assert sorted(r.at for r in iterate.numbered(df, ["v"], "at").collect()) == list(range(200))


@pytest.mark.parametrize(("shape", "basis"), [("random", 12), ("star", 40), ("pair", 40)])
def test_lowest_pairs_are_those_of_the_dense_matrix(spark, shape, basis):
    rng = np.random.default_rng(8)
    n = {"random": 24, "path": 25, "star": 30, "pair": 2}[shape]
    edges = {"random": {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(60)} | {(i, i + 1) for i in range(n - 1)}, "path": {(i, i + 1) for i in range(n - 1)}, "star": {(0, i) for i in range(1, n)}, "pair": {(0, 1)}}[shape]
    rows = [(f"v{a:02}", f"v{b:02}", float(1 + (a * b) % 3)) for a, b in sorted(edges)]
    pairs = spectra.lowest_pairs(spark.createDataFrame(rows, "a string, b string, weight double"), k=1 if shape in ("star", "pair") else 3, basis=basis)
    dense = np.zeros((n, n))
    for a, b, w in rows:
        i, j = int(a[1:]), int(b[1:])
        dense[[i, j], [j, i]] -= w
        dense[[i, j], [i, j]] += w
    want = np.linalg.eigvalsh(dense)[1:]
    assert np.allclose(pairs.values, want[: len(pairs.values)], atol=1e-7) and max(pairs.residuals) < 1e-6
    v = np.asarray([r.v for r in pairs.vectors.orderBy("id").collect()])
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-7) and np.allclose(dense @ v, v * pairs.values, atol=1e-5)
    assert (v[np.abs(v[:, 0]) > 1e-9, 0][0]) > 0


def test_fiedler_of_nothing(spark):
    assert spectra.fiedler(spark.createDataFrame([], "a string, b string")).count() == 0
    rows = spectra.spectral_embedding(spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string"), k=2).select(F.size("coordinates").alias("k")).collect()
    assert [r.k for r in rows] == [2] * 3


def test_residuals_do_not_grow_with_the_largest_eigenvalue(spark):
    # Hubs with a leaf of great weight each: the largest eigenvalue is near 20,000, the least is below one.
    rows = [("r", f"h{i}", 1.0) for i in range(6)] + [(f"h{i}", f"l{i}-{k}", 1.0 + i) for i in range(6) for k in range(i + 2)] + [(f"h{i}", f"z{i}", 10000.0 - i) for i in range(6)]
    found = spectra.fiedler(spark.createDataFrame(rows, "a string, b string, weight double")).collect()
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    dense = np.zeros((len(names), len(names)))
    for a, b, w in rows:
        i, j = names.index(a), names.index(b)
        dense[[i, j], [j, i]] -= w
        dense[[i, j], [i, j]] += w
    values, vectors = np.linalg.eigh(dense)
    v = np.asarray([r.v for r in sorted(found, key=lambda r: r.id)])
    assert found[0].residual < 1e-8 and np.allclose(v, vectors[:, 1] * np.sign(vectors[:, 1] @ v), atol=1e-8)


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_parts_in_tasks_give_the_blocks_of_joins(spark, graph, monkeypatch, most):
    edges, _, df, g = graph
    monkeypatch.setattr(forest, "PART_EDGES", most)
    grouped = lambda rows: {frozenset((r.a, r.b) for r in rows if r.block == k) for k in {r.block for r in rows}}
    found = forest.blocks(df).collect()
    assert len(found) == len(edges) and grouped(found) == grouped(forest.blocks(df, g).collect())


def test_cycles_of_parts_in_tasks(spark, graph, monkeypatch):
    _, _, df, g = graph
    want = sorted(map(tuple, forest.fundamental_cycles(df, g).collect()))
    written = []
    monkeypatch.setattr(forest, "cut", lambda x: written.append(1) or iterate.cut(x))
    assert sorted(map(tuple, forest.fundamental_cycles(df).collect())) == want
    # By joins alone it takes some forty tables here.
    assert len(written) < 20


def test_cut_vertices_of_parts_in_tasks(spark, graph):
    _, _, df, g = graph
    rows = lambda found: sorted((r.id, r.added) for r in forest.cut_vertices(found).collect())
    assert rows(forest.blocks(df)) == rows(forest.blocks(df, g))
