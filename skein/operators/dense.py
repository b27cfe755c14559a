"""Kernels on bounded graphs, one graph per group: cuts, flows, spectra, exact chains, plans.

Every function takes edges(graph_id, src, dst, ...) and runs a small numpy kernel for each graph, many graphs side
by side. A graph of more nodes than the cap fails the job: larger ones need the loops of joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CAP = 2000


def per_graph(rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, cap: int = CAP, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """Rows of kernel(graph) for each graph_id.

    The rows are sorted by graph within their partitions, so that a batch holds many small graphs; only the last
    one of a batch waits for the next. A graph of more than cap nodes is an error.
    """

    def one(graph_id: str, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(set(pdf[ends[0]]) | set(pdf[ends[1]]))
        if n > cap:
            raise ValueError(f"graph {graph_id} has {n} nodes, more than {cap}")
        out = kernel(pdf.reset_index(drop=True))
        out.insert(0, "graph_id", graph_id)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            ids = batch["graph_id"].to_numpy()
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            if held and held[-1]["graph_id"].iloc[-1] != ids[0]:
                yield one(held[0]["graph_id"].iloc[0], pd.concat(held))
                held = []
            if not len(cuts):
                held.append(batch)
                continue
            out = [one(ids[0], pd.concat([*held, batch.iloc[: cuts[0]]]))]
            out += [one(ids[i], batch.iloc[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            held = [batch.iloc[cuts[-1] :]]
            if out := [x for x in out if len(x)]:
                yield pd.concat(out)
        if held:
            yield one(held[0]["graph_id"].iloc[0], pd.concat(held))

    # A given number of partitions stays as it is: rows of small graphs are few bytes but much work.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "graph_id").sortWithinPartitions("graph_id").mapInPandas(run, f"graph_id string, {schema}")


def _index(pdf: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    names = sorted(set(pdf["src"]) | set(pdf["dst"]))
    at = {v: i for i, v in enumerate(names)}
    return names, pdf["src"].map(at).to_numpy(int), pdf["dst"].map(at).to_numpy(int)


def _lowpoints(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[set[int], set[tuple[int, int]]]:
    """Cut vertices and bridges of the simple undirected graph, by depth-first order without recursion."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in sorted({(min(a, b), max(a, b)) for a, b in zip(src.tolist(), dst.tolist(), strict=True) if a != b}):
        near[a].append(b)
        near[b].append(a)
    order, low, points, bridges, clock = [-1] * n, [0] * n, set(), set(), 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = clock
        clock += 1
        stack, children = [(root, -1, iter(near[root]))], 0
        while stack:
            v, parent, todo = stack[-1]
            w = next(todo, None)
            if w is not None:
                if order[w] < 0:
                    order[w] = low[w] = clock
                    clock += 1
                    children += v == root
                    stack.append((w, v, iter(near[w])))
                elif w != parent:
                    low[v] = min(low[v], order[w])
                continue
            stack.pop()
            if parent >= 0:
                low[parent] = min(low[parent], low[v])
                if low[v] > order[parent]:
                    bridges.add((min(v, parent), max(v, parent)))
                if parent != root and low[v] >= order[parent]:
                    points.add(parent)
        if children > 1:
            points.add(root)
    return points, bridges


def articulation_points(edges: DataFrame, cap: int = CAP) -> DataFrame:
    """(graph_id, id, added): undirected cut vertices and how many components removing one adds, most first."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        points, _ = _lowpoints(len(names), s, d)
        base = _component_count(len(names), s, d, set())
        rows = [(names[p], _component_count(len(names), s, d, {p}) - base) for p in points]
        return pd.DataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), columns=["id", "added"])

    return per_graph(edges, kernel, "id string, added int", cap)


def _component_count(n: int, s: np.ndarray, d: np.ndarray, removed: set[int]) -> int:
    label = np.arange(n)
    keep = ~(np.isin(s, list(removed)) | np.isin(d, list(removed)))
    s, d = s[keep], d[keep]
    while True:
        new = label.copy()
        np.minimum.at(new, s, label[d])
        np.minimum.at(new, d, label[s])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return len(set(label[i] for i in range(n) if i not in removed))


def bridges(edges: DataFrame, cap: int = CAP) -> DataFrame:
    """(graph_id, a, b): undirected bridges with a < b."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        return pd.DataFrame(sorted((names[a], names[b]) for a, b in _lowpoints(len(names), s, d)[1]), columns=["a", "b"])

    return per_graph(edges, kernel, "a string, b string", cap)


def _max_flow(n: int, arcs: dict[tuple[int, int], float], s: int, t: int, limit: float = np.inf) -> tuple[float, dict, set[int]]:
    """Flow, residual capacities and the source's side of the last cut, by breadth-first augmentation."""
    left: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    for (a, b), c in arcs.items():
        left[a][b] = left[a].get(b, 0) + c
        left[b].setdefault(a, 0)
    flow = 0.0
    while True:
        prev, queue = {s: s}, [s]
        for v in queue:
            for w, c in sorted(left[v].items()):
                if c > 0 and w not in prev:
                    prev[w] = v
                    queue.append(w)
        if t not in prev or flow >= limit:
            return flow, left, set(prev)
        path, v = [], t
        while v != s:
            path.append((prev[v], v))
            v = prev[v]
        push = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= push
            left[b][a] += push
        flow += push


def min_vertex_cut(edges: DataFrame, sources: list[str], targets: list[str], cap: int = CAP) -> DataFrame:
    """(graph_id, size, cut): fewest nodes other than the ends that separate them; (0, []) if an edge joins them."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        n, huge = len(names), 1e9
        ends = {i for i, v in enumerate(names) if v in sources or v in targets}
        arcs = {(2 * i, 2 * i + 1): huge if i in ends else 1.0 for i in range(n)}
        arcs |= {(2 * a + 1, 2 * b): huge for a, b in zip(s.tolist(), d.tolist(), strict=True) if a != b}
        arcs |= {(2 * n, 2 * i): huge for i, v in enumerate(names) if v in sources}
        arcs |= {(2 * i + 1, 2 * n + 1): huge for i, v in enumerate(names) if v in targets}
        flow, _, side = _max_flow(2 * n + 2, arcs, 2 * n, 2 * n + 1, huge)
        cut = [] if flow >= huge else [names[i] for i in range(n) if 2 * i in side and 2 * i + 1 not in side]
        return pd.DataFrame({"size": [0 if flow >= huge else int(flow)], "cut": [cut]})

    return per_graph(edges, kernel, "size int, cut array<string>", cap)


def min_cost_flow(edges: DataFrame, sources: list[str], targets: list[str], flow: int, cap: int = CAP) -> DataFrame:
    """(graph_id, flow, cost, paths): least cost of so many paths that share no inner node, or as many as there are.

    paths lists the nodes of each. Successive cheapest paths on the residual graph, where going back along an edge gives its cost back.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        n = len(names)
        arcs: list[list] = []  # from, to, capacity, cost
        out: list[list[int]] = [[] for _ in range(2 * n + 2)]

        def add(a: int, b: int, capacity: int, cost: float) -> None:
            out[a].append(len(arcs))
            arcs.append([a, b, capacity, cost])
            out[b].append(len(arcs))
            arcs.append([b, a, 0, -cost])

        for i, v in enumerate(names):
            free = v in sources or v in targets
            add(2 * i, 2 * i + 1, flow if free else 1, 0.0)
            if v in sources:
                add(2 * n, 2 * i, flow, 0.0)
            if v in targets:
                add(2 * i + 1, 2 * n + 1, flow, 0.0)
        cheap: dict[tuple[int, int], float] = {}
        for a, b, c in zip(s.tolist(), d.tolist(), pdf["cost"], strict=True):
            if a != b:
                cheap[a, b] = min(cheap.get((a, b), np.inf), max(float(c), 0.0))
        for (a, b), c in sorted(cheap.items()):
            add(2 * a + 1, 2 * b, 1 if (names[a] in sources and names[b] in targets) else flow, c)
        done, cost = 0, 0.0
        while done < flow:
            dist, prev = np.full(2 * n + 2, np.inf), [-1] * (2 * n + 2)
            dist[2 * n] = 0
            for _ in range(2 * n + 2):
                moved = False
                for k, (a, b, capacity, c) in enumerate(arcs):
                    if capacity > 0 and dist[a] + c < dist[b] - 1e-12:
                        dist[b], prev[b], moved = dist[a] + c, k, True
                if not moved:
                    break
            if not np.isfinite(dist[2 * n + 1]):
                break
            v = 2 * n + 1
            while v != 2 * n:
                k = prev[v]
                arcs[k][2] -= 1
                arcs[k ^ 1][2] += 1
                v = arcs[k][0]
            done += 1
            cost += float(dist[2 * n + 1])
        # What an arc carries is the capacity of its way back.
        carried = [arcs[k ^ 1][2] if k % 2 == 0 else 0 for k in range(len(arcs))]
        paths = []
        for _ in range(done):
            v, walk = 2 * n, []
            while v != 2 * n + 1:
                k = next(k for k in out[v] if carried[k] > 0)
                carried[k] -= 1
                if v < 2 * n and v % 2 == 0:
                    walk.append(names[v // 2])
                v = arcs[k][1]
            paths.append(walk)
        return pd.DataFrame({"flow": [done], "cost": [cost], "paths": [sorted(paths)]})

    return per_graph(edges, kernel, "flow int, cost double, paths array<array<string>>", cap)


def hitting_exact(edges: DataFrame, targets: list[str], cap: int = CAP) -> DataFrame:
    """(graph_id, id, probability): absorbing chain solved directly over the states that can reach a target."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        n = len(names)
        p = np.zeros((n, n))
        np.add.at(p, (s, d), 1.0)
        total = p.sum(axis=1, keepdims=True)
        p = np.divide(p, total, out=np.zeros_like(p), where=total > 0)
        goal = np.asarray([v in targets for v in names])
        able = goal.copy()
        while True:
            new = able | ((p @ able) > 0)
            if (new == able).all():
                break
            able = new
        h = goal.astype(float)
        free = np.flatnonzero(able & ~goal)
        if len(free):
            h[free] = np.linalg.solve(np.eye(len(free)) - p[np.ix_(free, free)], p[np.ix_(free, np.flatnonzero(goal))].sum(axis=1))
        return pd.DataFrame({"id": names, "probability": np.round(np.clip(h, 0, 1), 9)})

    return per_graph(edges, kernel, "id string, probability double", cap)


def _laplacian(n: int, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    a = np.zeros((n, n))
    off = s != d
    np.add.at(a, (s[off], d[off]), 1.0)
    a = a + a.T
    return np.diag(a.sum(axis=1)) - a


def _largest_strong(near: np.ndarray) -> np.ndarray:
    """Nodes of the strong component with most nodes; of ties that of the first node."""

    def closure(start: int, step: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(step), bool)
        seen[start] = True
        new = seen
        while new.any():
            new = step[new].any(axis=0) & ~seen
            seen = seen | new
        return seen

    left, best = np.ones(len(near), bool), np.zeros(0, int)
    while left.any():
        start = int(np.argmax(left))
        own = np.flatnonzero(closure(start, near) & closure(start, near.T))
        left[own] = False
        best = own if len(own) > len(best) else best
    return best


def fiedler(edges: DataFrame, cap: int = CAP) -> DataFrame:
    """(graph_id, id, value, v): smallest eigenvalue over 1e-9 of the Laplacian and its vector, first entry positive."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        values, vectors = np.linalg.eigh(_laplacian(len(names), s, d))
        k = int(np.argmax(values > 1e-9)) if (values > 1e-9).any() else 0
        v = vectors[:, k] if (values > 1e-9).any() else np.zeros(len(names))
        lead = v[np.abs(v) > 1e-9][:1]
        return pd.DataFrame({"id": names, "value": float(values[k]) if values[k] > 1e-9 else 0.0, "v": v * (np.sign(lead[0]) if len(lead) else 1)})

    return per_graph(edges, kernel, "id string, value double, v double", cap)


def spectral_embedding(edges: DataFrame, k: int = 8, cap: int = CAP) -> DataFrame:
    """(graph_id, id, coordinates): the k eigenvectors after the constant ones."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        values, vectors = np.linalg.eigh(_laplacian(len(names), s, d))
        keep = np.flatnonzero(values > 1e-9)[:k]
        return pd.DataFrame({"id": names, "coordinates": vectors[:, keep].tolist()})

    return per_graph(edges, kernel, "id string, coordinates array<double>", cap)


def directed_laplacian(edges: DataFrame, teleport: float = 0.01, cap: int = CAP) -> DataFrame:
    """(graph_id, id, value, v): second eigenpair of Chung's Laplacian of the largest strong component, with that teleport."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        n = len(names)
        p = np.zeros((n, n))
        np.add.at(p, (s, d), 1.0)
        own = _largest_strong(p > 0)
        names, p, n = [names[i] for i in own], p[np.ix_(own, own)], len(own)
        total = p.sum(axis=1, keepdims=True)
        p = np.where(total > 0, p / np.maximum(total, 1), 1.0 / n) * (1 - teleport) + teleport / n
        phi = np.full(n, 1.0 / n)
        for _ in range(2000):
            new = phi @ p
            if np.abs(new - phi).max() < 1e-12:
                break
            phi = new
        root = np.sqrt(phi)
        m = root[:, None] * p / root
        values, vectors = np.linalg.eigh(np.eye(n) - (m + m.T) / 2)
        k = min(1, n - 1)
        return pd.DataFrame({"id": names, "value": float(values[k]), "v": vectors[:, k] / root})

    return per_graph(edges, kernel, "id string, value double, v double", cap)


def path_homology(edges: DataFrame, omega2: str = "full", cap: int = 300) -> DataFrame:
    """(graph_id, b0, b1) of path homology. omega2 full: combinations of two-paths whose boundary is allowed;
    restricted: only single two-paths whose long edge is there. Both leave out u-v-u."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        e = sorted({(a, b) for a, b in zip(s.tolist(), d.tolist(), strict=True) if a != b})
        at, n = {x: i for i, x in enumerate(e)}, len(names)
        d1 = np.zeros((n, len(e)))
        for i, (a, b) in enumerate(e):
            d1[a, i], d1[b, i] = -1, 1
        r1 = int(np.linalg.matrix_rank(d1)) if e else 0
        after: dict[int, list[int]] = {}
        for a, b in e:
            after.setdefault(a, []).append(b)
        two = [(u, v, w) for u, v in e for w in after.get(v, []) if w != u]
        if omega2 == "restricted":
            two = [t for t in two if (t[0], t[2]) in at]
        missing = {x: i for i, x in enumerate(sorted({(u, w) for u, _, w in two} - set(e)))}
        inside, outside = np.zeros((len(e), len(two))), np.zeros((len(missing), len(two)))
        for i, (u, v, w) in enumerate(two):
            inside[at[u, v], i] += 1
            inside[at[v, w], i] += 1
            if (u, w) in at:
                inside[at[u, w], i] -= 1
            else:
                outside[missing[u, w], i] -= 1
        if len(missing) and two:
            _, sv, vt = np.linalg.svd(outside)
            basis = vt[int((sv > 1e-9).sum()) :].T
        else:
            basis = np.eye(len(two))
        r2 = int(np.linalg.matrix_rank(inside @ basis)) if basis.size else 0
        return pd.DataFrame({"b0": [n - r1], "b1": [len(e) - r1 - r2]})

    return per_graph(edges, kernel, "b0 int, b1 int", cap)


def cycle_basis(edges: DataFrame, cap: int = CAP) -> DataFrame:
    """(graph_id, birth, cycle): a closed walk for each edge outside a spanning forest grown by weight, then pos."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s, d = _index(pdf)
        weight = pdf["weight"].to_numpy(float) if "weight" in pdf else np.ones(len(pdf))
        pos = pdf["pos"].to_numpy() if "pos" in pdf else np.arange(len(pdf))
        seen: set[tuple[int, int]] = set()
        forest: dict[int, list[int]] = {i: [] for i in range(len(names))}
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i in sorted(range(len(pdf)), key=lambda i: (weight[i], pos[i])):
            a, b = int(min(s[i], d[i])), int(max(s[i], d[i]))
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if find(a) != find(b):
                root[find(a)] = find(b)
                forest[a].append(b)
                forest[b].append(a)
                continue
            prev, queue = {a: a}, [a]
            for v in queue:
                for w in forest[v]:
                    if w not in prev:
                        prev[w] = v
                        queue.append(w)
            walk, v = [b], b
            while v != a:
                v = prev[v]
                walk.append(v)
            out.append((float(weight[i]), [names[v] for v in [*reversed(walk), a]]))
        return pd.DataFrame(out, columns=["birth", "cycle"])

    return per_graph(edges, kernel, "birth double, cycle array<string>", cap)


def cheapest_plan(edges: DataFrame, sources: list[str], target: str, compounds: list[tuple[list[str], str, float]] = (), most_states: int = 200_000) -> DataFrame:
    """(graph_id, cost, steps): least total cost of actions that make target hold; an action is paid once.

    An edge needs its start; a compound (needs, gives, cost) needs all of its list. Best-first over sets of what
    holds; past most_states the cost is null: not solved.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        actions = [(frozenset([a]), b, max(float(c), 0.0), f"{a}->{b}") for a, b, c in zip(pdf["src"], pdf["dst"], pdf["cost"], strict=True)]
        actions += [(frozenset(n), g, max(float(c), 0.0), f"{'&'.join(n)}->{g}") for n, g, c in compounds]
        start = frozenset(sources)
        heap, done, k = [(0.0, 0, start, ())], set(), 0
        while heap and len(done) < most_states:
            cost, _, held, steps = heapq.heappop(heap)
            if target in held:
                return pd.DataFrame({"cost": [cost], "steps": [list(steps)]})
            if held in done:
                continue
            done.add(held)
            for need, give, c, name in actions:
                if give not in held and need <= held:
                    k += 1
                    heapq.heappush(heap, (cost + c, k, held | {give}, (*steps, name)))
        return pd.DataFrame({"cost": [None], "steps": [None]}).astype({"cost": "float64"})

    return per_graph(edges, kernel, "cost double, steps array<string>", CAP)
