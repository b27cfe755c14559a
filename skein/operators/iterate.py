"""Loops of joins: a driver loop that cuts lineage with tables in the checkpoint folder and stops on a one-row aggregate."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the session's checkpoint folder; sets one of this machine only where there is none (tests)."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing has yet, in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder; later plans start at that table.

    A table read back has its true size and no history. A checkpointed frame keeps the estimated size and the constraints
    of its plan: in loops that join a state with itself both grow with a power of the rounds. It is used only for
    what Parquet can't hold (untyped nulls, names that differ in case alone).
    """
    spark = df.sparkSession
    if "void" in df.schema.simpleString() or len({c.lower() for c in df.columns}) < len(df.columns):
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    path = new_folder(spark, "loop")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, computed once, with the place of each row in that order, from 0, as column name.

    A range sort deals rows to partitions whose sizes, a row each, give every partition its base: no task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    base, total = {}, 0
    for p, n in sorted((r[0], r[1]) for r in dealt.groupBy(part.alias("p")).count().collect()):
        base[p], total = total, total + n
    bases = F.array(*[F.lit(base.get(p, 0)).cast("long") for p in range(max(base, default=0) + 1)])
    return dealt.withColumn(name, F.element_at(bases, part.cast("int") + 1) + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], settled: Callable[[DataFrame, DataFrame], bool], most: int | None, name: str = "loop") -> DataFrame:
    """step applied to a state until settled(old, new); more than `most` rounds are an error, never a cut result. None is for steps that surely settle."""
    state = cut(state)
    for i in itertools.count() if most is None else range(most):
        new = cut(step(state, i))
        if settled(state, new):
            return new
        state = new
    raise RuntimeError(f"{name} did not settle in {most} rounds")


class Runs:
    """Rows kept as tables of falling size: one that is as large as that before it is merged with it."""

    def __init__(self, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.merge, self.tables, self.sizes = merge, [], []

    def add(self, table: DataFrame, size: int) -> None:
        self.tables.append(table)
        self.sizes.append(size)
        while len(self.sizes) > 1 and self.sizes[-1] >= self.sizes[-2]:
            both = cut(self.merge(self.tables[-2].unionByName(self.tables[-1])))
            self.tables[-2:], self.sizes[-2:] = [both], [both.count()]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)


def closure(seeds: DataFrame, edges: DataFrame, keys: list[str], step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Semi-naive least fixpoint: rows of `keys` reached from seeds; step(frontier, edges) gives the next rows.

    It ends where step only gives rows of a finite set. Rows once found are rewritten a logarithmic number of times.
    """
    frontier = cut(seeds.select(keys).distinct())
    seen = Runs()
    while size := frontier.count():
        seen.add(frontier, size)
        frontier = cut(step(frontier, edges).select(keys).distinct().join(seen.all(), keys, "left_anti"))
    return seen.all() if seen.tables else frontier
