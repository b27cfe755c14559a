"""Lowest eigenpairs of graph Laplacians of any size: a Lanczos process whose matrix products are joins with the edges.

Each step multiplies one vector by the Laplacian (a join and a sum by node), orthogonalises it twice against the basis (sums
that come back as one row) and appends it to the node's basis array. The driver only sees the projected matrix of at
most `basis` rows. A full basis is replaced by its best Ritz vectors and the process goes on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut

#: A residual below this part of the largest eigenvalue can't be told from rounding.
ROUNDING = 1e-13


@dataclass(frozen=True)
class EigenPairs:
    """values, ascending, with the norms of L v - value v; vectors(id, v array): unit vectors, the first entry over 1e-9 by id is positive."""

    values: list[float]
    residuals: list[float]
    vectors: DataFrame


def laplacian(undirected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links(src, dst, weight) both ways and degrees(id, degree) of undirected (a, b[, weight]); loops go, parallel edges add up."""
    weight = F.col("weight").cast("double") if "weight" in undirected.columns else F.lit(1.0)
    rows = undirected.where("a <> b").select("a", "b", F.coalesce(weight, F.lit(1.0)).alias("weight"))
    both = rows.toDF("src", "dst", "weight").unionByName(rows.toDF("dst", "src", "weight"))
    links = cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    return links, cut(links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")))


def _times(vector: DataFrame, links: DataFrame) -> DataFrame:
    """(id, into): the weighted sum of vector(id, x) over each node's neighbours."""
    return links.join(vector.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("x")).alias("into"))


def _less(y: Column, coefficients: list[float], mean: float) -> Column:
    return sum((F.lit(-c) * F.col("q")[i] for i, c in enumerate(coefficients)), y - F.lit(mean))


def lowest_pairs(undirected: DataFrame, k: int = 1, basis: int = 40, tol: float = 1e-9, most: int = 10_000) -> EigenPairs:
    """The k lowest eigenpairs of the Laplacian of a connected graph after the constant vector, with multiplicity as far as the start tells.

    undirected is (a, b[, weight]). A pair is done if its residual is at most tol times its own value, as the gaps to its neighbours are
    of that size, or what rounding leaves of the largest eigenvalue met (`ROUNDING`), if that is more. Fewer than k
    come back where the process ends in an invariant subspace; of an empty graph none. Not settling in `most` steps is an error.
    """
    if basis < k + 2:
        raise ValueError("the basis must be larger than k + 1")
    links, degrees = laplacian(undirected)
    n = degrees.count()
    state = cut(degrees.withColumns({"q": F.array().cast("array<double>"), "y": F.xxhash64("id").cast("double") / float(1 << 63)}))
    h = np.zeros((0, 0))
    for _ in range(most if n else 0):
        j = len(h)
        dots = lambda y: [F.sum(y * F.col("q")[i]) for i in range(j)]
        first = [x or 0.0 for x in state.agg(F.sum("y"), *dots(F.col("y"))).first()]
        once = _less(F.col("y"), first[1:], first[0] / n)
        second = [x or 0.0 for x in state.agg(F.sum(once), F.sum(once * once), *dots(once)).first()]
        norm = float(np.sqrt(max(0.0, second[1] - second[0] ** 2 / n - sum(x * x for x in second[2:]))))
        scale = 1.0
        if j:
            column = np.asarray(first[1:]) + np.asarray(second[2:])
            h[:, j - 1] = h[j - 1, :] = column
            theta, s = np.linalg.eigh(h)
            scale = max(1.0, float(np.abs(theta).max()))
            enough = np.minimum(tol * scale, np.maximum(tol * np.abs(theta[:k]), ROUNDING * scale))
            done = j >= min(k, n - 1) and bool((norm * np.abs(s[-1, :k]) <= enough).all())
            if done or norm <= 1e-12 * scale or j >= n - 1:
                return _result(state, links, theta[:k], s[:, :k])
            if j == basis:
                keep = min(basis - 1, k + basis // 3)
                state = state.withColumn("q2", F.array(*[sum((F.lit(float(s[i, c])) * F.col("q")[i] for i in range(1, j)), F.lit(float(s[0, c])) * F.col("q")[0]) for c in range(keep)]))
                # Both bases are there until the next vector, orthogonal to the old one, is taken.
                old, h = "q2", np.diag(theta[:keep])
            else:
                old = "q"
        else:
            old = "q"
            if norm == 0.0:
                break
        twice = _less(once, second[2:], second[0] / n) / F.lit(norm)
        vector = state.select("id", "degree", F.col(old).alias("kept"), twice.alias("x"))
        ahead = vector.join(_times(vector.select("id", "x"), links), "id")
        state = cut(ahead.select("id", "degree", F.array_append("kept", F.col("x")).alias("q"), (F.col("degree") * F.col("x") - F.col("into")).alias("y")))
        h = np.pad(h, ((0, 1), (0, 1)))
    else:
        if n:
            raise RuntimeError(f"the eigenpairs did not settle in {most} steps")
    return EigenPairs([], [], degrees.select("id", F.array().cast("array<double>").alias("v")))


def _result(state: DataFrame, links: DataFrame, theta: np.ndarray, s: np.ndarray) -> EigenPairs:
    v = [sum((F.lit(float(s[i, c])) * F.col("q")[i] for i in range(1, len(s))), F.lit(float(s[0, c])) * F.col("q")[0]) for c in range(len(theta))]
    vectors = cut(state.select("id", "degree", F.array(*v).alias("v")))
    lead = vectors.agg(*[F.min_by(F.when(F.abs(F.col("v")[c]) > 1e-9, F.col("v")[c]), F.when(F.abs(F.col("v")[c]) > 1e-9, F.col("id"))) for c in range(len(theta))]).first()
    residuals = []
    for c, value in enumerate(theta):
        one = vectors.select("id", "degree", F.col("v")[c].alias("x"))
        off = (F.col("degree") - F.lit(float(value))) * F.col("x") - F.col("into")
        residuals.append(float(np.sqrt(one.join(_times(one.select("id", "x"), links), "id").agg(F.sum(off * off)).first()[0])))
    signed = F.array(*[F.col("v")[c] * F.lit(-1.0 if (x or 0.0) < 0 else 1.0) for c, x in enumerate(lead)])
    return EigenPairs([float(t) for t in theta], residuals, vectors.select("id", signed.alias("v")))


def fiedler(undirected: DataFrame, tol: float = 1e-9) -> DataFrame:
    """(id, value, v, residual): the algebraic connectivity of a connected graph (a, b[, weight]) and its vector."""
    pairs = lowest_pairs(undirected, 1, tol=tol)
    value, residual = (pairs.values or [0.0])[0], (pairs.residuals or [0.0])[0]
    return pairs.vectors.select("id", F.lit(value).alias("value"), F.coalesce(F.try_element_at("v", F.lit(1)), F.lit(0.0)).alias("v"), F.lit(residual).alias("residual"))


def spectral_embedding(undirected: DataFrame, k: int = 8, tol: float = 1e-9) -> DataFrame:
    """(id, coordinates): the k eigenvectors after the constant one, fewer where the graph has fewer."""
    return lowest_pairs(undirected, k, basis=max(40, 3 * k), tol=tol).vectors.select("id", F.col("v").alias("coordinates"))
