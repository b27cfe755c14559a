"""A training corpus from documents: STAGES in order, each written as Parquet and read again.

Every stage works on all rows that the one before it kept. Null texts, texts without letters and texts that fit
no language that was learned go at the first stage, all of them where no document has a language to learn; without labels of
both classes the quality stage keeps everything. Texts of any length are read whole. An empty table gives an empty one. The duplicate stages keep exactly one row of each group,
also where ids are null or repeated. Extra columns of documents, whatever
their names, pass through the stages unchanged and end at packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import exact_dedup, langid, near_join, packing, quality
from skein.llm.queries import table, tokenizer
from skein.llm.shared import free_name, saved

#: Ids that an anti join broadcasts at most: eight bytes each.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, duplicates: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs without the rows that duplicates(docs, id_col) doesn't keep; the list of them is broadcast if it is short.

    Where ids are null or repeated, rows are numbered in the order of their ids, null last, and the numbers stand for them.
    """
    key, rows = "doc_id", docs
    if not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        key, order = free_name(docs, "row"), F.col("doc_id").asc_nulls_last()
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = saved(docs.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn(key, F.monotonically_increasing_id()), "numbered")
    dropped = saved(duplicates(rows, key).where("not kept").select(key).distinct(), "dropped")
    few = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped, key, "left_anti").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that fit a learned language: foreign scripts, languages that were not learned and noise go, mixed text stays."""
    lang, score, fits = (free_name(docs, c) for c in ("lang_pred", "lang_score", "lang_fits"))
    found = langid.predict(docs, langid.train(docs), lang=lang, score=score, fits=fits)
    return found.where(F.col(fits)).select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality model predicts 1 for, and all where the labels teach nothing."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not any(t.any() for t in model.tables):
        return docs
    score = free_name(docs, "score")
    return quality.score(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of equal texts."""
    return without(docs, exact_dedup.exact_dedup)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group that links of similarity 0.8 or more join."""
    return without(docs, near_join.similarity_join)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed."""
    return packing.checksum(packing.pack(docs, tokenizer("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("packing", pack_sequences),
]

#: SQL can't express the trained stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
