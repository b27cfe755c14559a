"""Exact duplicates by a content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts and Spark's external sort places equal texts next to each
other. Each row is compared, whole text against whole text, with its neighbour in that order: where they differ a
new run begins, and a run keeps its smallest identifier. Splitters are sampled on a short key in the order of the
sort (the first characters, a hash of the rest, a block), so a sample of it fits any driver; nothing is decided by
the hash. A text of very many copies fills several blocks. The first rows of its blocks, one of each, are carried
over and compared in the same way, so that the runs of one text are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved

LEAD = 24
#: Rows of one key from which it is cut into blocks, and blocks at most; rows of a block then grow with the key.
RUN_ROWS = 1024
BLOCKS = 256
#: Keys with several blocks that a join broadcasts at most: 50 bytes each.
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty. Nothing is trimmed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def neighbour_runs(rows: DataFrame, text: str, *by: str, order: list[Column]) -> DataFrame:
    """rows with `starts`, whether the text differs from the one before it in its sorted place, and `run`, the number of starts so far."""
    place = W.partitionBy(*by).orderBy(text, *order)
    starts = ~F.col(text).eqNullSafe(F.lag(text).over(place)) | (F.row_number().over(place) == 1)
    return rows.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int")).over(place.rowsBetween(W.unboundedPreceding, W.currentRow)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS, most_blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: (id, keep_id, group_size long, kept boolean, text_sha256).

    Null and empty texts are equal to each other. Of rows with the same smallest identifier (repeated rows)
    all are kept by `kept`, as they can't be told apart; a null identifier counts as larger than any other and
    is kept only if its whole group has none. Texts of any length are compared whole. An empty table gives an
    empty one. Other columns, whatever their names, are left out.
    """
    norm = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("norm"))
    norm = norm.select("id", "norm", F.substring("norm", 1, LEAD).alias("lead"), F.xxhash64("norm").alias("h"))
    # Which keys need several blocks; equality is not decided here.
    crowded = saved(norm.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > run_rows), "content-crowded")
    crowded = crowded.select("h", F.least(F.ceil(F.col("m") / run_rows), F.lit(most_blocks)).alias("blocks"))
    few = crowded.count() <= BROADCAST_ROWS
    norm = norm.join(F.broadcast(crowded) if few else crowded, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    norm = norm.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(0).cast("int"))

    parts = int(norm.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range partitioning brings equal (lead, h, block) together, so the windows add sorts and no shuffle.
    key = ["lead", "h", "block"]
    ordered = neighbour_runs(norm.repartitionByRange(parts, *key), "norm", *key, order=[F.col("id").asc_nulls_last()])
    thin = ordered.select(*key, "run", "id", "blocks", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.when(F.col("starts") & (F.col("blocks") > 1), F.col("norm")).alias("first"))
    run = W.partitionBy(*key, "run")
    thin = saved(thin.select("*", F.min("id").over(run).alias("least"), F.count(F.lit(1)).over(run).alias("n")), "content-sort")

    # One row of each run in a cut key is carried over and meets the runs of its other blocks.
    heads = thin.where(F.col("first").isNotNull()).select("lead", "h", "block", "run", "first", "least", "n")
    heads = neighbour_runs(heads.withColumnRenamed("run", "part"), "first", "lead", "h", order=[F.col("block"), F.col("part")])
    text = W.partitionBy("lead", "h", "run")
    carried = heads.select(*key, F.col("part").alias("run"), F.min("least").over(text).alias("least"), F.sum("n").over(text).alias("n"))
    columns = ["id", "least", "n", "sha"]
    cut = thin.where("blocks > 1").drop("least", "n", "first").join(saved(carried, "content-heads"), [*key, "run"]).select(columns)
    return thin.where("blocks = 1").select(columns).unionByName(cut).select(
        F.col("id").alias(id_col), F.col("least").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("least")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
