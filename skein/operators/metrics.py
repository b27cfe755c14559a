"""Evaluation: confusion counts, rankings, pooled precision, AUC, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _share(a: Column, b: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def confusion(rows: DataFrame, by: list[str] | None = None, empty: float = 1.0, with_total: bool = False) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of boolean columns `truth` and `flagged`.

    empty is what a ratio without a denominator counts as (f1: 0). with_total adds a row over all groups, with
    null keys, by one pass of grouping sets.
    """
    by = by or []
    counts = [
        F.count_if(F.col("truth") & F.col("flagged")).alias("tp"), F.count_if(~F.col("truth") & F.col("flagged")).alias("fp"),
        F.count_if(F.col("truth") & ~F.col("flagged")).alias("fn"), F.count_if(~F.col("truth") & ~F.col("flagged")).alias("tn"),
    ]
    grouped = rows.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]) if with_total and by else rows.groupBy(*by)
    out = grouped.agg(*counts)
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp"), empty), _share(F.col("tp"), F.col("tp") + F.col("fn"), empty)
    out = out.withColumns({"precision": p, "recall": r, "accuracy": _share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), empty)})
    return out.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def confusion_by_prefix(rows: DataFrame, name: str = "name", mark: str = "_", empty: float = 1.0) -> DataFrame:
    """confusion() by the part of a name before the first mark, with a row over all."""
    return confusion(rows.withColumn("prefix", F.split_part(name, F.lit(mark), F.lit(1))), ["prefix"], empty, with_total=True)


def ablation(rows: DataFrame, variants: dict[str, Column], empty: float = 0.0) -> DataFrame:
    """confusion() of rows(truth) for each variant of the rule that flags them: (variant, tp, ...), in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("flagged")) for k, v in variants.items()]))
    return confusion(rows.select("truth", each.alias("v")).select("truth", "v.variant", "v.flagged"), ["variant"], empty)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows(case_id, ...) with `rank` in each case."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy(*order)))


def shuffled(seed: int, *keys: str) -> Column:
    """A seeded order."""
    return F.xxhash64(F.lit(seed), *keys)


def rank_of_target(rows: DataFrame) -> DataFrame:
    """(case_id, rank) of the first row whose category is the case's target; one past the end if there is none."""
    return rows.groupBy("case_id").agg(F.coalesce(F.min(F.when(F.col("category") == F.col("target_category"), F.col("rank"))), F.count(F.lit(1)) + 1).cast("long").alias("rank"))


def ranking_summary(ranks: DataFrame) -> DataFrame:
    """n, mrr, recall_at_1, mean_rank, ndcg_at_5; a case has one relevant row."""
    r = F.col("rank")
    return ranks.agg(
        F.count(F.lit(1)).alias("n"), F.avg(1 / r).alias("mrr"), F.avg((r == 1).cast("double")).alias("recall_at_1"),
        F.avg(r).alias("mean_rank"), F.avg(F.when(r <= 5, 1 / F.log2(r + 1.0)).otherwise(0.0)).alias("ndcg_at_5"),
    )


def cost_curve(ranks: DataFrame, budget: int) -> DataFrame:
    """(b, found): share of cases found within b looks. One histogram of ranks, then running sums over it."""
    per_rank = ranks.select(F.least("rank", F.lit(budget + 1)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    every = ranks.sparkSession.range(1, budget + 2).select(F.col("id").alias("b")).join(per_rank, "b", "left").fillna(0, ["k"])
    w = W.orderBy("b")
    out = every.select("b", F.sum("k").over(w).alias("s"), F.sum("k").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"))
    return out.where(F.col("b") <= budget).select("b", _share(F.col("s"), F.col("n"), 0.0).alias("found"))


def positions(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """rows with `position` in the global order and `hits` so far, without a single-task window.

    A range sort deals rows to partitions; counts by partition, one row each, give every partition its base.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_dealt", F.spark_partition_id())
    from .iterate import cut

    dealt = cut(dealt)
    w = W.partitionBy("_dealt").orderBy(*order)
    local = dealt.withColumn("position", F.row_number().over(w)).withColumn("hits", F.sum("relevant").over(w.rowsBetween(W.unboundedPreceding, 0)))
    totals = dealt.groupBy("_dealt").agg(F.count(F.lit(1)).alias("n"), F.sum("relevant").alias("k"))
    before = W.orderBy("_dealt").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("_dealt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_bn"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_bk"))
    return local.join(F.broadcast(base), "_dealt").withColumns({"position": F.col("position") + F.col("_bn"), "hits": F.col("hits") + F.col("_bk")}).drop("_dealt", "_bn", "_bk")


def pooled(rows: DataFrame, order: list[Column], at: tuple[int, ...] = (10, 50, 100), recall: float = 0.9) -> DataFrame:
    """One row: n, relevant, average precision, precision and recall at k, looks to a recall. rows has relevant 0/1."""
    p = positions(rows, order)
    total = p.agg(F.sum("relevant").alias("total"))
    p = p.join(F.broadcast(total))
    precise = F.col("hits") / F.col("position")
    out = [F.count(F.lit(1)).alias("n"), F.max("total").alias("n_relevant"), F.coalesce(F.try_divide(F.sum(F.when(F.col("relevant") == 1, precise)), F.max("total").cast("double")), F.lit(0.0)).alias("average_precision")]
    for k in at:
        hits = F.max(F.when(F.col("position") <= k, F.col("hits")))
        out += [F.when(F.count(F.lit(1)) >= k, hits / k).alias(f"precision_at_{k}"), F.try_divide(hits.cast("double"), F.max("total").cast("double")).alias(f"recall_at_{k}")]
    out.append(F.min(F.when(F.col("hits") >= F.ceil(recall * F.col("total")), F.col("position"))).alias("looks"))
    return p.agg(*out)


def auc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(…, auc) of `score` for `relevant` 0/1 by average ranks; 0.5 if a class is empty.

    Rows are counted by score first, so ties and hot scores are one row each before any order.
    """
    by = by or []
    return _auc_of_counts(rows.groupBy(*by, "score").agg(F.sum("relevant").alias("p"), F.count(F.lit(1)).alias("n")), by)


def _auc_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc) of (by, score, p, n): how many of the n rows of a score are relevant."""
    w = W.partitionBy(*by).orderBy("score")
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    mid = F.col("p") * (F.col("before") + (F.col("n") + 1) / 2)
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    value = F.when((pos > 0) & (neg > 0), F.try_divide(F.sum(mid) - pos * (pos + 1) / 2, (pos * neg).cast("double"))).otherwise(0.5)
    return counts.groupBy(*by).agg(value.alias("auc"))


def paired_permutation(pairs: DataFrame, iterations: int = 20_000, resamples: int = 2000, seed: int = 7, block: int = 500) -> DataFrame:
    """(n, mean_diff, low, high, p): sign-flip test of pairs(a, b) with an add-one p and a bootstrap interval.

    Differences are counted by value first. Each value draws the flips (binomial) and the bootstrap weights (Poisson) of
    all its pairs for every replicate from a generator of its own, so nothing depends on how rows are dealt, and tasks
    give one partial sum per replicate.
    """
    import numpy as np
    import pandas as pd

    d = pairs.select((F.col("a") - F.col("b")).cast("double").alias("d")).where("d IS NOT NULL")
    n, mean = d.agg(F.count("d"), F.avg("d")).first()
    spark = pairs.sparkSession
    if not n:
        return spark.createDataFrame([(0, None, None, None, 1.0)], "n long, mean_diff double, low double, high double, p double")
    counts = d.groupBy("d").agg(F.count(F.lit(1)).alias("k"))

    def run(batches):
        signs, sums, weights = np.zeros(iterations), np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for x, k in zip(batch["d"].to_numpy(float), batch["k"].to_numpy(), strict=True):
                random = np.random.default_rng([seed, int(np.float64(x).view(np.uint64))])
                signs += x * (2 * random.binomial(k, 0.5, iterations) - k)
                drawn = random.poisson(k, resamples)
                sums += x * drawn
                weights += drawn
        for kind, v, w in (("s", signs, np.full(iterations, 0.0)), ("b", sums, weights)):
            for i in range(0, len(v), block):
                part = slice(i, i + block)
                yield pd.DataFrame({"kind": kind, "replicate": np.arange(len(v))[part], "v": v[part], "w": w[part]})

    parts = counts.mapInPandas(run, "kind string, replicate long, v double, w double")
    # A resample's weights differ in their sum; one without any row has no mean.
    draws = parts.groupBy("kind", "replicate").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    draws = draws.select("kind", F.try_divide("v", F.when(F.col("kind") == "s", F.lit(float(n))).otherwise(F.col("w"))).alias("v"))
    extreme = F.count_if((F.col("kind") == "s") & (F.abs("v") >= abs(mean) - 1e-12))
    boots = F.when(F.col("kind") == "b", F.col("v"))
    return draws.agg(
        F.lit(n).cast("long").alias("n"), F.lit(mean).alias("mean_diff"), F.percentile(boots, 0.025).alias("low"),
        F.percentile(boots, 0.975).alias("high"), ((extreme + 1) / (iterations + 1.0)).alias("p"),
    )


def poisson_bootstrap(rows: DataFrame, resamples: int = 200, seed: int = 7) -> DataFrame:
    """(replicate, weight, ...): every row with a Poisson(1) weight per replicate, drawn from a hash of its key `id`.

    Weighted aggregates by replicate are then bootstrap draws, with partial sums before the shuffle.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "id", "replicate"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # Cumulative Poisson(1) probabilities of 0 to 5.
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    weight = sum((F.col("u") > s).cast("int") for s in steps)
    out = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("u", u)
    return out.withColumn("weight", weight).drop("u").where("weight > 0")


def confusion_interval(rows: DataFrame, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """One row: 95 % bootstrap limits of precision and recall of rows(truth, flagged).

    Rows are counted by outcome first; each of the at most four outcomes then draws its Poisson weight a replicate.
    """
    import numpy as np
    import pandas as pd

    counts = rows.groupBy("truth", "flagged").agg(F.count(F.lit(1)).alias("k")).where("truth IS NOT NULL AND flagged IS NOT NULL")

    def draw(batches):
        for batch in batches:
            for truth, flagged, k in zip(batch["truth"], batch["flagged"], batch["k"], strict=True):
                random = np.random.default_rng([seed, int(truth), int(flagged)])
                yield pd.DataFrame({"replicate": np.arange(resamples), "truth": truth, "flagged": flagged, "weight": random.poisson(k, resamples)})

    drawn = counts.mapInPandas(draw, "replicate long, truth boolean, flagged boolean, weight long")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("weight"))), F.lit(0))
    s = drawn.groupBy("replicate").agg(total(F.col("truth") & F.col("flagged")).alias("tp"), total(F.col("flagged")).alias("flags"), total(F.col("truth")).alias("truths"))
    s = s.select(_share(F.col("tp"), F.col("flags"), 0.0).alias("p"), _share(F.col("tp"), F.col("truths"), 0.0).alias("r"))
    return s.agg(*[F.percentile(c, q).alias(f"{n}_{e}") for c, n in (("p", "precision"), ("r", "recall")) for q, e in ((0.025, "low"), (0.975, "high"))])


def auc_intervals(rows: DataFrame, by: list[str], resamples: int = 200, seed: int = 7) -> DataFrame:
    """(by, auc, low, high): the AUC of each group and its 95 % bootstrap limits.

    rows(by, score, relevant) are counted by score and class first, so a draw costs a row a distinct score.
    """
    import numpy as np
    import pandas as pd

    counts = rows.groupBy(*by, "score", "relevant").agg(F.count(F.lit(1)).alias("k"))
    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in [*by, "score"])

    def draw(batches):
        for batch in batches:
            keys = pd.util.hash_pandas_object(batch[[*by, "score", "relevant"]].astype(str), index=False).to_numpy()
            drawn = np.stack([np.random.default_rng([seed, int(h)]).poisson(k, resamples) for h, k in zip(keys, batch["k"], strict=True)]) if len(batch) else np.zeros((0, resamples), int)
            for i in range(resamples):
                some = drawn[:, i] > 0
                out = batch.loc[some, [*by, "score"]].copy()
                out["replicate"] = i
                out["n"] = drawn[some, i]
                out["p"] = out["n"] * (batch.loc[some, "relevant"].to_numpy() == 1)
                yield out

    drawn = counts.mapInPandas(draw, f"{schema}, replicate long, n long, p long")
    keys = [*by, "replicate"]
    replicates = _auc_of_counts(drawn.groupBy(*keys, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), keys)
    limits = replicates.groupBy(*by).agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))
    return auc(rows, by).join(limits, by)


def mean_interval(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean and half width 1.96 * population deviation / sqrt(n)."""
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(1.96 * F.stddev_pop(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("half_width"))


def token_recall(rows: DataFrame) -> DataFrame:
    """(id, recall): share of expected(array) that text contains, whatever the case; null if none is expected."""
    found = F.filter("expected", lambda t: F.contains(F.lower(F.col("text")), F.lower(t)))
    return rows.select("id", F.try_divide(F.size(found).cast("double"), F.size("expected").cast("double")).alias("recall"))


def run_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row on runs(key, label): shared, only_left, only_right, same_keys, label_change_rate."""
    both = left.select("key", F.col("label").alias("l"), F.lit(1).alias("x")).join(right.select("key", F.col("label").alias("r"), F.lit(1).alias("y")), "key", "full")
    shared = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    return both.agg(
        shared.alias("shared"), F.count_if(F.col("y").isNull()).alias("only_left"), F.count_if(F.col("x").isNull()).alias("only_right"),
        (F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("same_keys"),
        _share(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col("l").eqNullSafe(F.col("r"))), shared, 0.0).alias("label_change_rate"),
    )


def runs_stable(runs: DataFrame) -> DataFrame:
    """(file, n_runs, keys_same, order_same) of runs(file, run, key, confidence): whether all runs of a file found the
    same keys, and in the same order by confidence; equal confidence is ordered by key. Runs without rows don't count."""
    lists = runs.groupBy("file", "run").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "key"))).alias("rows"))
    lists = lists.select("file", F.transform("rows", lambda r: r["key"]).alias("ordered"))
    return lists.groupBy("file").agg(F.count(F.lit(1)).alias("n_runs"), (F.countDistinct(F.array_sort(F.array_distinct("ordered"))) == 1).alias("keys_same"), (F.countDistinct("ordered") == 1).alias("order_same"))
