"""Which of very many phrases a text holds: automata over slices of the phrases, built in the tasks that scan the texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut

#: Characters of phrases that a task has an automaton for at a time, in the mean.
SLICE_CHARS = 2_000_000


def contained(texts: DataFrame, phrases: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(id, phrase, n, first): every phrase of phrases(phrase) that texts(id, text) hold, whatever the case of letters.

    n counts all places, overlapping ones too, first is the earliest from 1. Any number of phrases, of any words, blanks
    included: they are dealt by hash to slices, so what a task holds doesn't grow with them; each slice is one more pass
    over the texts, without a shuffle of texts or of pairs. Phrases that are equal in small letters are one, in small
    letters. Empty and null phrases and null texts match nothing; texts under one id are scanned apart.
    """
    spark = texts.sparkSession
    known = cut(phrases.select(F.lower("phrase").alias("phrase")).where("phrase <> ''").distinct())
    chars = known.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-chars // slice_chars))
    dealt = cut(known.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(n))))
    lowered = texts.where("text IS NOT NULL").select("id", F.lower("text").alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, phrase string, n long, first long"

    def scan(words) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in words.value:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for batch in batches:
                out = []
                for key, text in zip(batch["id"], batch["text"], strict=True):
                    met: dict[str, list[int]] = {}
                    for end, w in automaton.iter(text):
                        met.setdefault(w, [0, end - len(w) + 2])[0] += 1
                    out += [(key, w, k, at) for w, (k, at) in met.items()]
                yield pd.DataFrame(out, columns=["id", "phrase", "n", "first"])

        return lowered.mapInPandas(search, schema)

    found = []
    for i in range(n):
        words = [r["phrase"] for r in dealt.where(F.col("slice") == i).select("phrase").toLocalIterator()]
        if words:
            found.append(scan(spark.sparkContext.broadcast(words)))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def either_way(names: DataFrame, products: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(name, product) in small letters: every name of names(name) that contains one of products(product) or lies in one,
    with as many of either as there are. Each side's phrases are looked for in the other's."""
    a, b = names.select(F.lower("name").alias("id")).where("id <> ''").distinct(), products.select(F.lower("product").alias("id")).where("id <> ''").distinct()
    holds = contained(a.withColumn("text", F.col("id")), b.withColumnRenamed("id", "phrase"), slice_chars).select(F.col("id").alias("name"), F.col("phrase").alias("product"))
    lies = contained(b.withColumn("text", F.col("id")), a.withColumnRenamed("id", "phrase"), slice_chars).select(F.col("phrase").alias("name"), F.col("id").alias("product"))
    return holds.unionByName(lies).distinct()
