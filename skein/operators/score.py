"""Fusion of node signals into a score, and its calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cvss import sigmoid


def signal_fields(nodes: DataFrame, tainted: DataFrame, cyclic: DataFrame, curvature: DataFrame, confirmed: DataFrame, fiedler: DataFrame | None = None) -> DataFrame:
    """(graph_id, id, signal, v) of every node(graph_id, id, label): what the single analyses say about it.

    taint: in tainted(id); topological: in cyclic(id); geometric: the largest -curvature of its edges in
    curvature(a, b, curvature), 0 if none is negative; formal: its label is in confirmed(label); spectral: |v| of
    fiedler(id, v), where that is given. Each is an equi-join on keys made distinct before.
    """
    flag = lambda t, key, name: t.select(key).distinct().withColumn(name, F.lit(1.0))
    bent = curvature.where("curvature < 0").select(F.explode(F.array("a", "b")).alias("id"), (-F.col("curvature")).cast("double").alias("k")).groupBy("id").agg(F.max("k").alias("geometric"))
    rows = nodes.join(flag(tainted, "id", "taint"), "id", "left").join(flag(cyclic, "id", "topological"), "id", "left").join(bent, "id", "left").join(flag(confirmed, "label", "formal"), "label", "left")
    names = ["taint", "topological", "geometric", "formal"]
    if fiedler is not None:
        rows, names = rows.join(fiedler.groupBy("id").agg(F.max(F.abs("v")).alias("spectral")), "id", "left"), [*names, "spectral"]
    return rows.select("graph_id", "id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names]).unpivot(["graph_id", "id"], names, "signal", "v")


def normalise(signals: DataFrame) -> DataFrame:
    """signals(graph_id, id, signal, v) divided by the signal's maximum in the graph; all 0 if that isn't positive.

    The maximum is aggregated and joined back, so a graph of many nodes isn't sorted in one task.
    """
    top = signals.groupBy("graph_id", "signal").agg(F.max("v").alias("top"))
    joined = signals.join(top, ["graph_id", "signal"])
    return joined.select("graph_id", "id", "signal", F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(0.0).alias("v"))


def fuse(signals: DataFrame, weights: dict[str, float] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(graph_id, id, score): weighted sum of normalised signals; without weights each of the signals counts alike.

    skip leaves signals out, as a prior does with those that need a solver.
    """
    rows = normalise(signals).where(~F.col("signal").isin(*skip)) if skip else normalise(signals)
    if weights is None:
        names = rows.select("signal").distinct()
        n = max(1, names.count())
        value = F.col("v") / n
    else:
        value = F.col("v") * F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("signal")), F.lit(0.0))
    return rows.groupBy("graph_id", "id").agg(F.sum(value).alias("score"))


def probability(scores: DataFrame) -> DataFrame:
    return scores.withColumn("probability", sigmoid(F.col("score") - 0.5))


def features(signals: DataFrame, names: list[str]) -> DataFrame:
    """(graph_id, one column per signal): the largest value of each in the graph, 0 if it has none."""
    return signals.groupBy("graph_id").pivot("signal", names).agg(F.max("v")).fillna(0.0, names)


def fit_logistic(rows: DataFrame, names: list[str], iterations: int = 1000, rate: float = 0.5) -> list[float]:
    """Weights (last: constant) by full-batch gradient descent from zero; each step is one aggregate over rows(label)."""
    rows = rows.select(*[F.col(c).cast("double") for c in names], F.col("label").cast("double").alias("label")).cache()
    n = rows.count()
    w = [0.0] * (len(names) + 1)
    for _ in range(iterations if n else 0):
        z = sum((F.col(c) * v for c, v in zip(names, w[:-1], strict=True)), F.lit(w[-1]))
        error = sigmoid(z, 50) - F.col("label")
        g = rows.agg(*[F.sum(error * F.col(c)) for c in names], F.sum(error)).first()
        w = [v - rate * x / n for v, x in zip(w, g, strict=True)]
    rows.unpersist()
    return w


def _sums(rows: DataFrame, names: list[str], w: list[float]) -> tuple[list[float], list[list[float]]]:
    """Gradient and curvature of the log likelihood at weights w (last: constant), in one aggregate of p + p (p + 1) / 2 sums."""
    x = [F.col(c) for c in names] + [F.lit(1.0)]
    p = sigmoid(sum((c * v for c, v in zip(x[:-1], w[:-1], strict=True)), F.lit(w[-1])), 50)
    k = len(x)
    out = rows.agg(*[F.sum((F.col("label") - p) * c) for c in x], *[F.sum(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i + 1)]).first()
    curve, at = [[0.0] * k for _ in x], k
    for i in range(k):
        for j in range(i + 1):
            curve[i][j] = curve[j][i] = out[at] or 0.0
            at += 1
    return [g or 0.0 for g in out[:k]], curve


def fit_newton(rows: DataFrame, names: list[str], ridge: float = 1e-3, tol: float = 1e-10, most: int = 100) -> list[float]:
    """Weights (last: constant) of greatest penalised likelihood over rows(label): Newton steps, each one aggregate over the rows.

    The penalty, ridge / 2 times the squared weights, keeps them finite where classes are apart. A step is halved while it
    makes the gradient longer. No rows give zeros; not settling is an error.
    """
    import numpy as np

    rows = rows.select(*[F.col(c).cast("double") for c in names], F.col("label").cast("double").alias("label"))
    w = np.zeros(len(names) + 1)
    g, h = _sums(rows, names, w.tolist())
    g, h = np.asarray(g) - ridge * w, np.asarray(h) + ridge * np.eye(len(w))
    for _ in range(most):
        step, share = np.linalg.solve(h, g), 1.0
        if np.abs(step).max() < tol:
            return (w + step).tolist()
        while True:
            new = w + share * step
            g2, h2 = _sums(rows, names, new.tolist())
            g2, h2 = np.asarray(g2) - ridge * new, np.asarray(h2) + ridge * np.eye(len(w))
            if np.linalg.norm(g2) <= np.linalg.norm(g) or share < 1e-3:
                break
            share /= 2
        w, g, h = new, g2, h2
    raise RuntimeError(f"the weights did not settle in {most} steps")


def leave_one_out_newton(rows: DataFrame, names: list[str], key: str = "graph_id", ridge: float = 1e-3) -> DataFrame:
    """(key, label, probability): each row predicted without its own part, by downdating the fit of all rows.

    One Newton step from the weights of all rows to those of the others, whose curvature is that of all less the row's own
    (a rank-one downdate). An expression on each row: nothing is collected, and no row is a fold of its own.
    """
    import numpy as np

    w = fit_newton(rows, names, ridge)
    rows = rows.select(key, *[F.col(c).cast("double").alias(c) for c in names], F.col("label").cast("double").alias("label"))
    _, h = _sums(rows, names, w)
    inverse = np.linalg.inv(np.asarray(h) + ridge * np.eye(len(w))).tolist()
    x = [F.col(c) for c in names] + [F.lit(1.0)]
    z = sum((c * v for c, v in zip(x[:-1], w[:-1], strict=True)), F.lit(w[-1]))
    p = sigmoid(z, 50)
    lever = sum((x[i] * x[j] * inverse[i][j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    moved = z - lever * (F.col("label") - p) / (1.0 - p * (1.0 - p) * lever)
    return rows.select(key, "label", sigmoid(moved, 50).alias("probability"))


def leave_one_out(rows: DataFrame, names: list[str], iterations: int = 1000, rate: float = 0.5, most: int = 10_000) -> DataFrame:
    """(graph_id, label, probability): each row predicted by a model fitted on the others, a fold for each task.

    Every task holds all rows, so more than `most` are an error.
    """
    import numpy as np
    import pandas as pd

    frame = rows.select("graph_id", *names, "label").limit(most + 1).toPandas().sort_values("graph_id")
    if len(frame) > most:
        raise ValueError(f"leave-one-out over more than {most} rows")
    x, y, ids = frame[names].to_numpy(float), frame["label"].to_numpy(float), frame["graph_id"].to_numpy()
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((np.hstack([x, np.ones((len(x), 1))]), y, ids))

    def run(batches):
        x, y, ids = shared.value
        for batch in batches:
            out = []
            for i in batch["id"]:
                keep = np.arange(len(y)) != i
                w = np.zeros(x.shape[1])
                for _ in range(iterations):
                    w -= rate * x[keep].T @ (1 / (1 + np.exp(-np.clip(x[keep] @ w, -50, 50))) - y[keep]) / max(1, keep.sum())
                out.append((str(ids[i]), float(y[i]), float(1 / (1 + np.exp(-np.clip(x[i] @ w, -50, 50))))))
            yield pd.DataFrame(out, columns=["graph_id", "label", "probability"])

    return spark.range(len(frame)).mapInPandas(run, "graph_id string, label double, probability double")
