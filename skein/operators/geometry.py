"""Discrete curvature of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forman_ricci(undirected: DataFrame) -> DataFrame:
    """(a, b, curvature): 4 - deg(a) - deg(b) on a simple undirected graph."""
    ends = undirected.select(F.explode(F.array("a", "b")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    rows = undirected.select("a", "b").join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a")
    return rows.join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b").select("a", "b", (4 - F.col("da") - F.col("db")).alias("curvature"))


def most_negative(curvature: DataFrame, k: int) -> DataFrame:
    """The k edges of most negative curvature, ties by their ends."""
    return curvature.orderBy("curvature", "a", "b").limit(k)


def negative_by_node(curvature: DataFrame) -> DataFrame:
    """(id, score): the largest -curvature over a node's edges."""
    return curvature.select(F.explode(F.array("a", "b")).alias("id"), (-F.col("curvature")).alias("s")).groupBy("id").agg(F.max("s").alias("score"))


def ollivier_ricci(undirected: DataFrame, alpha: float = 0.5, reg: float | None = None, iterations: int = 200, most_degree: int = 5000) -> DataFrame:
    """(a, b, curvature): 1 - W1 of the lazy measures at both ends, hop metric.

    Neighbourhoods of an edge's ends are at most three hops apart, so distances come from neighbour lists alone.
    reg None solves the transport exactly; else Sinkhorn with that regularisation. A node of more than
    most_degree neighbours is an error, as its lists are copied to each of its edges.
    """
    import numpy as np
    import pandas as pd

    both = undirected.select("a", "b").unionByName(undirected.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lists = both.groupBy("a").agg(F.collect_set("b").alias("near"))
    worst = lists.agg(F.max(F.size("near"))).first()[0] or 0
    if worst > most_degree:
        raise ValueError(f"a node has {worst} neighbours, more than {most_degree}")
    # Each edge gets both ends' neighbours and, for these, their own neighbours: enough for distances up to three.
    named = lists.select(F.col("a").alias("x"), F.col("near").alias("nx"))

    def around(end: str) -> DataFrame:
        near = undirected.select("a", "b").join(lists.select(F.col("a").alias(end), "near"), end)
        each = near.select("a", "b", F.explode(F.array_append("near", F.col(end))).alias("x")).join(named, "x")
        return each.groupBy("a", "b").agg(F.collect_list(F.struct("x", "nx")).alias(f"around_{end}"))

    rows = around("a").join(around("b"), ["a", "b"])

    def one(a: str, b: str, left: list, right: list) -> float:
        left = sorted(((x["x"], set(x["nx"])) for x in left), key=lambda x: (x[0] != a, x[0]))
        right = sorted(((y["x"], set(y["nx"])) for y in right), key=lambda y: (y[0] != b, y[0]))
        d = np.asarray([[0.0 if x == y else 1.0 if y in nx else 2.0 if nx & ny else 3.0 for y, ny in right] for x, nx in left])
        mu = np.asarray([alpha, *[(1 - alpha) / (len(left) - 1)] * (len(left) - 1)])
        nu = np.asarray([alpha, *[(1 - alpha) / (len(right) - 1)] * (len(right) - 1)])
        return 1 - (transport(mu, nu, d) if reg is None else sinkhorn(mu, nu, d, reg, iterations))

    def solve(batches):
        for table in batches:
            values = [one(*row) for row in zip(table["a"], table["b"], table["around_a"], table["around_b"], strict=True)]
            yield pd.DataFrame({"a": table["a"], "b": table["b"], "curvature": np.asarray(values, dtype=float)})

    kind = undirected.schema["a"].dataType.simpleString()
    return rows.mapInPandas(solve, f"a {kind}, b {kind}, curvature double")


def sinkhorn(mu, nu, d, reg: float, iterations: int) -> float:
    """Cost of the entropic plan after so many rounds."""
    import numpy as np

    k = np.exp(-d / reg)
    u = np.ones(len(mu))
    for _ in range(iterations):
        v = nu / np.maximum(k.T @ u, 1e-300)
        u = mu / np.maximum(k @ v, 1e-300)
    return float((u[:, None] * k * v * d).sum())


def transport(mu, nu, d) -> float:
    """Exact transport cost by successive cheapest augmentation on the residual graph."""
    import numpy as np

    mu, nu = mu.astype(float).copy(), nu.astype(float).copy()
    n, m = d.shape
    flow, total = np.zeros((n, m)), 0.0
    while mu.sum() > 1e-12:
        dist = np.concatenate([np.where(mu > 1e-12, 0.0, np.inf), np.full(m, np.inf)])
        prev = np.full(n + m, -1)
        for _ in range(n + m):
            old = dist.copy()
            across = dist[:n, None] + d
            best = across.argmin(axis=0)
            new = across[best, np.arange(m)]
            better = new < dist[n:] - 1e-12
            dist[n:][better], prev[n:][better] = new[better], best[better]
            back = np.where(flow > 1e-12, dist[n:] - d, np.inf)
            best = back.argmin(axis=1)
            new = back[np.arange(n), best]
            better = new < dist[:n] - 1e-12
            dist[:n][better], prev[:n][better] = new[better], best[better] + n
            if (dist == old).all():
                break
        j = int(np.where(nu > 1e-12, dist[n:], np.inf).argmin())
        path, at = [], j + n
        while prev[at] >= 0:
            path.append((int(prev[at]), at))
            at = int(prev[at])
        push = min(mu[at], nu[j], *(flow[b, a - n] for a, b in path if a >= n))
        for a, b in path:
            if a < n:
                flow[a, b - n] += push
                total += push * d[a, b - n]
            else:
                flow[b, a - n] -= push
                total -= push * d[b, a - n]
        mu[at] -= push
        nu[j] -= push
    return total
