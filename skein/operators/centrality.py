"""Centralities and absorbing chains as loops of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut, numbered


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank): uniform start, fixed iterations, rank of nodes without out-edges spread over all; parallel edges count."""
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = cut(edges.select("src", "dst").join(out, "src"))
    ranks = ids.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for _ in range(iterations):
        into = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("into"))
        into = cut(into)
        # What doesn't flow along edges is the rank of nodes without out-edges.
        loose = 1.0 - (into.agg(F.sum("into")).first()[0] or 0.0)
        ranks = ids.join(into, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("into", F.lit(0.0)) + loose / n)).alias("rank"))
    return ranks


def _power(edges: DataFrame, nodes: DataFrame, start: float, step: object, norm: str, tol: float, most: int) -> DataFrame:
    ids = cut(nodes.select("id").distinct())
    links = cut(edges.select("src", "dst"))
    state = cut(ids.withColumn("x", F.lit(start)))
    for _ in range(most):
        into = links.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("into"))
        new = cut(state.join(into, "id", "left").select("id", F.col("x").alias("old"), step(F.coalesce("into", F.lit(0.0))).alias("x")))
        total = new.agg((F.sum(F.abs("x")) if norm == "sum" else F.max(F.abs("x"))).alias("n")).first()["n"]
        if not total:
            return state.select("id", F.round("x", 6).alias("score"))
        new = cut(new.select("id", "old", (F.col("x") / total).alias("x")))
        if (new.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0) < tol:
            return new.select("id", F.round("x", 6).alias("score"))
        state = new.select("id", "x")
    raise RuntimeError(f"the vector did not settle in {most} rounds")


def eigenvector_centrality(edges: DataFrame, nodes: DataFrame, tol: float = 1e-9, most: int = 1000) -> DataFrame:
    """(id, score): power iteration along in-edges with sum 1; a zero vector ends it and the one before is kept."""
    n = max(1, nodes.select("id").distinct().count())
    return _power(edges, nodes, 1.0 / n, lambda x: x, "sum", tol, most)


def katz_centrality(edges: DataFrame, nodes: DataFrame, alpha: float = 0.1, tol: float = 1e-9, most: int = 1000) -> DataFrame:
    """(id, score): y = 1 + alpha A'x, divided by its maximum each round."""
    return _power(edges, nodes, 1.0, lambda x: 1.0 + alpha * x, "max", tol, most)


def hits(edges: DataFrame, nodes: DataFrame, tol: float = 1e-9, most: int = 100) -> DataFrame:
    """(id, authority, hub): both updated from the vectors of the round before, each with sum 1."""
    ids = cut(nodes.select("id").distinct())
    links = cut(edges.select("src", "dst"))
    n = max(1, ids.count())
    state = cut(ids.select("id", F.lit(1.0 / n).alias("a"), F.lit(1.0 / n).alias("h")))
    for _ in range(most):
        a = links.join(state.select(F.col("id").alias("src"), "h"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("h").alias("na"))
        h = links.join(state.select(F.col("id").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("nh"))
        new = cut(state.join(a, "id", "left").join(h, "id", "left").fillna(0.0, ["na", "nh"]))
        sa, sh = new.agg(F.sum("na"), F.sum("nh")).first()
        new = cut(new.select("id", (F.col("na") / (sa or 1.0)).alias("x"), (F.col("nh") / (sh or 1.0)).alias("y"), "a", "h"))
        moved = new.agg(F.max(F.greatest(F.abs(F.col("x") - F.col("a")), F.abs(F.col("y") - F.col("h"))))).first()[0] or 0.0
        state = new.select("id", F.col("x").alias("a"), F.col("y").alias("h"))
        if moved < tol:
            return state.select("id", F.round("a", 6).alias("authority"), F.round("h", 6).alias("hub"))
    raise RuntimeError(f"the vectors did not settle in {most} rounds")


def hitting_probabilities(edges: DataFrame, nodes: DataFrame, targets: DataFrame, tol: float = 1e-9, most: int = 1000, fixed: int | None = None) -> DataFrame:
    """(id, probability) that a walk along uniformly chosen out-edges meets a target; dead ends count 0.

    Jacobi rounds from 0 rise to the least fixpoint. fixed asks for so many rounds, whatever has changed.
    """
    ids = cut(nodes.select("id").distinct().join(targets.select("id").distinct().withColumn("t", F.lit(1.0)), "id", "left"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("degree")).alias("p")))
    state = cut(ids.select("id", "t", F.coalesce("t", F.lit(0.0)).alias("h")))
    for _ in range(most if fixed is None else fixed):
        near = links.join(state.select(F.col("id").alias("dst"), "h"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("p") * F.col("h")).alias("new"))
        new = cut(state.join(near, "id", "left").select("id", "t", F.coalesce("t", "new", F.lit(0.0)).alias("h"), F.col("h").alias("old")))
        moved = None if fixed is not None else new.agg(F.max(F.abs(F.col("h") - F.col("old")))).first()[0] or 0.0
        state = new.select("id", "t", "h")
        if moved is not None and moved < tol:
            break
    else:
        if fixed is None:
            raise RuntimeError(f"probabilities did not settle in {most} rounds")
    return state.select("id", F.round("h", 6).alias("probability"))


def hitting_rank(probabilities: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with a positive probability, highest first."""
    return probabilities.join(sources.select("id").distinct(), "id", "left_semi").where("probability > 0").orderBy(F.desc("probability"), "id")


#: Nodes that hang on one other are taken away while that is at least this part of all.
LEAST_HANGING = 0.02


def _hanging(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pairs(src, dst) less nodes that only have ways to and from one other, again and again; (id, root, weight, squares) of all nodes; and
    (id, weight) of those with pairs left.

    weight counts the nodes that hang on id, itself included, squares sums those of the nodes next to it that hang on it;
    root is what stays of what id hangs on.
    """
    ends = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    state = cut(ends.select("id", F.lit(1.0).alias("weight"), F.lit(0.0).alias("squares")))
    gone, size = [], state.count()
    while size:
        out = pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"))
        into = pairs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("m"), F.min("src").alias("from"))
        single = cut(out.join(into, "id").where("n = 1 AND m = 1 AND to = from").select("id", "to"))
        # Of two that only have each other the smaller one stays.
        other = single.select(F.col("id").alias("to"), F.lit(True).alias("too"))
        leaves = cut(single.join(other, "to", "left").where("too IS NULL OR id > to").select("id", "to").join(state, "id"))
        found = leaves.count()
        if not found:
            break
        got = leaves.groupBy(F.col("to").alias("id")).agg(F.sum("weight").alias("more"), F.sum(F.col("weight") * F.col("weight")).alias("more_squares"))
        stays = state.join(leaves.select("id"), "id", "left_anti").join(got, "id", "left").fillna(0.0, ["more", "more_squares"])
        state = cut(stays.select("id", (F.col("weight") + F.col("more")).alias("weight"), (F.col("squares") + F.col("more_squares")).alias("squares")))
        drop = leaves.select("id")
        pairs = cut(pairs.join(drop.toDF("src"), "src", "left_anti").join(drop.toDF("dst"), "dst", "left_anti").select("src", "dst"))
        gone.append(leaves)
        if found < LEAST_HANGING * size:
            break
        size -= found
    every = state.select("id", F.col("id").alias("root"), "weight", "squares")
    for leaves in reversed(gone):
        every = cut(every.unionByName(leaves.join(every.select(F.col("id").alias("to"), "root"), "to").select("id", "root", "weight", "squares")))
    left = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    return pairs, every, cut(left.join(state.select("id", "weight"), "id"))


def _betweenness_joins(pairs: DataFrame, weights: DataFrame, block_rows: int) -> DataFrame:
    """(id, score, reach): as in _core, Brandes by joins for a block of sources at a time; a level is rows (source, id, paths)."""
    n = weights.count()
    sources = weights.select(F.col("id").alias("source"), F.col("weight").alias("own"))
    blocks = -(-n * n // max(1, block_rows))
    sources = cut(sources.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(max(1, blocks)))))
    total = None
    for block in range(blocks):
        own = sources.where(F.col("block") == block).select("source", "own")
        level = cut(own.select("source", F.col("source").alias("id"), F.lit(1.0).alias("paths")))
        levels, seen = [], level.select("source", "id")
        while not level.isEmpty():
            levels.append(level)
            met = level.withColumnRenamed("id", "src").join(pairs, "src").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
            level = cut(met.join(seen, ["source", "id"], "left_anti"))
            seen = cut(seen.unionByName(level.select("source", "id")))
        below = None
        for level in reversed(levels):
            delta = level.withColumn("delta", F.lit(0.0))
            if below is not None:
                share = below.select("source", F.col("id").alias("dst"), ((F.col("weight") + F.col("delta")) / F.col("paths")).alias("share"))
                back = share.join(pairs, "dst").groupBy("source", F.col("src").alias("id")).agg(F.sum("share").alias("share"))
                delta = level.join(back, ["source", "id"], "left").select("source", "id", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("delta"))
            below = cut(delta.join(weights, "id").join(own, "source"))
            start = F.col("source") == F.col("id")
            part = below.groupBy("id").agg(F.sum(F.when(start, 0.0).otherwise(F.col("own") * F.col("delta"))).alias("score"), F.sum(F.when(start, F.col("delta")).otherwise(F.col("own"))).alias("reach"))
            total = cut(part if total is None else total.unionByName(part).groupBy("id").agg(F.sum("score").alias("score"), F.sum("reach").alias("reach")))
    return total if total is not None else weights.select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("reach")).limit(0)


def _core(pairs: DataFrame, weights: DataFrame, most_edges: int, block_rows: int) -> DataFrame:
    """(id, score, reach) of nodes weights(id, weight) that stand for so many each: Brandes, and how many nodes (others') id reaches and is reached by, added."""
    import numpy as np
    import pandas as pd

    if pairs.count() > most_edges:
        return _betweenness_joins(pairs, weights, block_rows)
    known = cut(numbered(weights, ["id"], "i"))
    place = known.select("id", "i")
    frame = pairs.join(place.toDF("src", "s"), "src").join(place.toDF("dst", "t"), "dst").select("s", "t").toPandas()
    weight = known.select("i", "weight").toPandas().sort_values("i")["weight"].to_numpy()
    src, dst = frame["s"].to_numpy(), frame["t"].to_numpy()
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(len(weight) + 1))
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast((first, dst, weight))

    def run(batches):
        first, dst, weight = shared.value
        n = len(weight)
        score, reach = np.zeros(n), np.zeros(n)
        for batch in batches:
            for s in batch["i"]:
                depth, paths = np.full(n, -1), np.zeros(n)
                depth[s], paths[s] = 0, 1.0
                level, levels = np.asarray([s]), []
                while len(level):
                    levels.append(level)
                    size = first[level + 1] - first[level]
                    at = np.repeat(first[level], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    a, b = np.repeat(level, size), dst[at]
                    new = depth[b] < 0
                    depth[b[new]] = len(levels)
                    down = depth[b] == len(levels)
                    np.add.at(paths, b[down], paths[a[down]])
                    level = np.unique(b[new])
                delta = np.zeros(n)
                for level in reversed(levels):
                    size = first[level + 1] - first[level]
                    at = np.repeat(first[level], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    a, b = np.repeat(level, size), dst[at]
                    down = depth[b] == depth[a] + 1
                    np.add.at(delta, a[down], paths[a[down]] / paths[b[down]] * (weight[b[down]] + delta[b[down]]))
                met = np.concatenate(levels[1:]) if len(levels) > 1 else np.zeros(0, dtype=int)
                # All paths begin at s: its own delta is the weight of what it reaches.
                reach[s] += delta[s]
                reach[met] += weight[s]
                score[met] += weight[s] * delta[met]
        some = np.flatnonzero(reach)
        yield pd.DataFrame({"i": some, "score": score[some], "reach": reach[some]})

    parts = spark.range(len(weight)).select(F.col("id").cast("int").alias("i")).mapInPandas(run, "i long, score double, reach double")
    return known.join(parts.groupBy("i").agg(F.sum("score").alias("score"), F.sum("reach").alias("reach")), "i").select("id", "score", "reach")


def betweenness(edges: DataFrame, nodes: DataFrame, most_edges: int = 5_000_000, block_rows: int = 50_000_000) -> DataFrame:
    """(id, score): Brandes, directed, unnormalised, ends excluded; sources are dealt to tasks.

    Nodes that hang on a single other (ways both in and out, to it alone), and what then does, are counted and taken away first: trees cost
    a few joins whatever their size. What is left is walked from each of its nodes, each weighed with what hangs on it. Up to
    most_edges the edge list goes to every task as arrays; a longer one stays in tables, and levels of paths are
    joined with it for so many sources at a time that a block has about block_rows (source, id).
    """
    pairs, every, weights = _hanging(cut(edges.where("src <> dst").select("src", "dst").distinct()))
    every = every.withColumns({"score": F.lit(0.0), "reach": F.lit(0.0)})
    if not pairs.isEmpty():
        core = cut(_core(pairs, weights, most_edges, block_rows))
        every = every.drop("score", "reach").join(core.select("id", "score"), "id", "left").join(core.select(F.col("id").alias("root"), "reach"), "root", "left").fillna(0.0, ["score", "reach"])
    # Paths between nodes that hang on id one way or another, and between these and what is beyond, both ways.
    whole = every.where("id = root").select("root", F.col("weight").alias("whole"))
    hung = F.col("weight") - 1
    score = F.col("score") + hung * hung - F.col("squares") + hung * (F.col("reach") + 2 * (F.col("whole") - F.col("weight")))
    total = every.join(whole, "root").select(F.col("id").cast("string").alias("id"), score.alias("score"))
    return nodes.select(F.col("id").cast("string").alias("id")).distinct().join(total, "id", "left").fillna(0.0, ["score"])
