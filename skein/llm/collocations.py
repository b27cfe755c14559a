"""Phrase collocations by SETM relational mining.

A relation R_k has a row (piece, position, phrase) for every occurrence of a frequent phrase of k words. R_1 is persisted
sorted by position; R_{k+1} comes from R_k: a merge join of R_k with itself at adjacent positions of one piece (the last
k - 1 words of the one are the first of the other), a count of the groups, and a semi-join with the frequent ones, which is
persisted for the next length. Relations are stored in blocks of whole texts, a row of sorted positions
and ids each, so the merge join needs no shuffle; groups are counted in tasks before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import numbered, offsets_of, saved, slices, text_of

#: A phrase has so many words at most and occurs so often at least.
LONGEST, LEAST = 3, 10
#: Phrases of a language that are returned, and the share of its occurrences from which a longer phrase replaces one.
TOP, REPLACED_PERCENT = 2000, 50
#: Frequent words or groups that every task gets at most; more are met by a join of the occurrences.
SHIPPED = 2_000_000
SLICE = 8 << 20
#: Rows of a language that one task orders at most, unless the first ones of all parts are more.
ORDERED = 200_000
#: Words of a block, from which the next text begins another, and words of the blocks that a step of a task takes.
BLOCK_WORDS, BLOCKS_AT_ONCE = 1 << 14, 1 << 19
#: Bytes of a row group of a relation: what the reader has in memory at once.
ROW_GROUP = 4 << 20
WORD, WHITE, BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = WHITE
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = BREAK


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The lower-cased words of texts: row and position of each, and the words.

    Positions grow along the slice; two words have adjacent ones exactly if they are neighbours in a piece.
    """
    text = pc.ascii_lower(text)
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    kind = _KIND[data]
    word = np.concatenate([[False], kind == WORD, [False]])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == BREAK)[starts] + row
    at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(np.diff(piece) > 0)])[: len(starts)]
    ends = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[kind == WORD].tobytes()))
    return row, at, words


def coded(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of a slice (lang, text): row and position of each word, a code for it in its language, and for each code language and word."""
    row, at, words = words_of(text_of(part))
    lang = pc.fill_null(part.column(0), "und").dictionary_encode()
    words = words.dictionary_encode()
    both = np.asarray(lang.indices, dtype=np.int64)[row] * max(1, len(words.dictionary)) + np.asarray(words.indices, dtype=np.int64)
    found, codes = np.unique(both, return_inverse=True)
    return row, at, codes, lang.dictionary.take(pa.array(found // max(1, len(words.dictionary)))), words.dictionary.take(pa.array(found % max(1, len(words.dictionary))))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                _, _, codes, lang, word = coded(part)
                yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), word.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(word)))], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def relation_type(ids: int) -> str:
    """Columns of a relation in blocks of whole texts, a row each: steps from one position to the next, and what stands there."""
    return f"step array<int>, id array<{'int' if ids < 1 << 31 else 'bigint'}>"


def _rows(at: np.ndarray, ids: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """Blocks, ids[offsets[i]:offsets[i + 1]] each. Gaps of any width and the first step of a block are a step of 2."""
    step = np.minimum(np.diff(at, prepend=at[:1] - 2), 2).astype(np.int32)
    step[offsets[:-1][offsets[:-1] < len(step)]] = 2
    ends = pa.array(offsets.astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(step), pa.array(ids).cast(kind))]
    return pa.RecordBatch.from_arrays(lists, names=["step", "id"])


def _id_kind(schema: str) -> pa.DataType:
    return pa.int64() if "bigint" in schema else pa.int32()


def merge_join(step: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of sorted blocks that meet the row at the next position: index of the left row, its id and the right one's."""
    left = np.flatnonzero(step[1:] == 1)
    return left, ids[left], ids[left + 1]


def _blocks(batch: pa.RecordBatch, most: int = BLOCKS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps, ids and offsets of some blocks, one after another."""
    offsets = offsets_of(batch.column(0))
    step, ids = (batch.column(i).flatten() for i in (0, 1))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        a, b = int(offsets[low]), int(offsets[high])
        yield np.asarray(step[a:b]), np.asarray(ids[a:b], dtype=np.int64), offsets[low : high + 1] - a
        low = high


def _counted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    if max(left.max(initial=0), right.max(initial=0)) < 1 << 31:
        both, n = np.unique(left << 32 | right, return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, n
    both, n = np.unique(np.stack([left, right]), axis=1, return_counts=True)
    return both[0], both[1], n


def group_counts(relation: DataFrame) -> DataFrame:
    """(left, right, f): how often two phrases of a relation stand at adjacent positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                left, right, n = _counted(*merge_join(*block[:2])[1:])
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n)], names=["left", "right", "n"])

    return relation.mapInArrow(run, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("f"))


def first_relation(docs: DataFrame, words: DataFrame, shipped: int) -> DataFrame:
    """R_1 of texts (lang, text): occurrences of the frequent words (id, lang, word)."""
    schema = relation_type(n := words.count())
    if n <= shipped:
        known: dict[str, tuple[pa.Array, np.ndarray]] = {}
        table = words.select("lang", "word", "id").toArrow().combine_chunks()
        for lang in pc.unique(table["lang"]).to_pylist():
            own = table.filter(pc.equal(table["lang"], lang))
            known[lang] = own["word"].combine_chunks(), np.asarray(own["id"], dtype=np.int64)
        sent = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, most=SLICE):
                    row, at, codes, langs, word = coded(part)
                    ids = np.full(len(word), -1, np.int64)
                    for lang in pc.unique(langs).to_pylist():
                        if lang in sent.value:
                            own = np.flatnonzero(np.asarray(pc.equal(langs, lang)))
                            there, numbers = sent.value[lang]
                            found = np.asarray(pc.fill_null(pc.index_in(word.take(pa.array(own)), there), -1), dtype=np.int64)
                            ids[own] = np.where(found >= 0, numbers[found], -1)
                    ids = ids[codes]
                    there = ids >= 0
                    yield _rows(at[there], ids[there], _block_offsets(row[there]), _id_kind(schema))

        return docs.mapInArrow(run, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, most=SLICE):
                _, at, codes, lang, word = coded(part)
                yield _places(block, codes, at, len(word), lang=lang.cast(pa.string()), word=word.cast(pa.string()))
                block += 1

    rows = saved(docs.mapInArrow(listed, "block long, at array<bigint>, lang string, word string"), "word-places")
    return regrouped(rows.join(words.select("lang", "word", "id"), ["lang", "word"]), schema)


def _block_offsets(row: np.ndarray) -> np.ndarray:
    """Where blocks begin and end among words of these rows: at the first row that begins BLOCK_WORDS or more later."""
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    cuts = [0]
    while (k := int(np.searchsorted(begins, cuts[-1] + BLOCK_WORDS))) < len(begins):
        cuts.append(int(begins[k]))
    return np.asarray([*cuts, len(row)])


def _places(block: int, codes: np.ndarray, at: np.ndarray, n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A row for each code of a block: its positions, ascending."""
    order = np.argsort(codes, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n))]).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), places, *columns.values()], names=["block", "at", *columns])


def regrouped(rows: DataFrame, schema: str) -> DataFrame:
    """A relation in blocks again from (block, at array, id): a block holds one slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(1):
                lists = r.values.field(0)
                at = np.asarray(lists.flatten(), dtype=np.int64)
                ids = np.repeat(np.asarray(r.values.field(1), dtype=np.int64), np.asarray(pc.list_value_length(lists), dtype=np.int64))
                order = np.argsort(at)
                yield _rows(at[order], ids[order], np.asarray([0, len(ids)]), _id_kind(schema))

    return rows.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("own")).mapInArrow(run, schema)


def next_relation(relation: DataFrame, groups: DataFrame, shipped: int) -> DataFrame:
    """R_{k+1}: occurrences of the frequent groups (id, left, right) in the self-join of R_k."""
    schema = relation_type(n := groups.count())
    if n <= shipped:
        table = groups.select("left", "right", "id").toArrow()
        left, right, ids = (np.asarray(table[c], dtype=np.int64) for c in ("left", "right", "id"))
        order = np.lexsort((right, left))
        sent = groups.sparkSession.sparkContext.broadcast((left[order], right[order], ids[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left, right, ids = sent.value
            leads = np.unique(left)
            span = int(right.max(initial=0)) + 1
            keys = np.searchsorted(leads, left) * span + right
            for batch in batches:
                for step, own, offsets in _blocks(batch):
                    index, a, b = merge_join(step, own)
                    lead = np.minimum(np.searchsorted(leads, a), max(0, len(leads) - 1))
                    wanted = np.where((leads[lead] == a) & (b < span), lead * span + b, -1) if len(leads) else np.full(len(a), -1)
                    place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                    hit = keys[place] == wanted if len(keys) else np.zeros(len(a), bool)
                    yield _rows(np.cumsum(step)[index[hit]], ids[place[hit]], np.searchsorted(index[hit], offsets), _id_kind(schema))

        return relation.mapInArrow(run, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for step, own, _ in _blocks(batch):
                index, a, b = merge_join(step, own)
                pairs, codes = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
                yield _places(block, codes.ravel(), np.cumsum(step)[index], pairs.shape[1], left=pa.array(pairs[0]), right=pa.array(pairs[1]))
                block += 1

    rows = saved(relation.mapInArrow(listed, "block long, at array<bigint>, left long, right long"), "group-places")
    return regrouped(rows.join(groups.select("left", "right", "id"), ["left", "right"]), schema)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shipped: int = SHIPPED) -> tuple[list[DataFrame], DataFrame]:
    """For each length from 1 the frequent phrases of texts (lang, text), and (lang, n), the words of each language.

    Phrases are (id, left, right, lang, words, heads, tails): left and right are the phrase without its last and its
    first word, heads and tails count the occurrences of its first and its last 1, 2, ... words, itself included.
    """
    counts = saved(word_counts(docs), "word-counts")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = numbered(counts.where(F.col("f") >= least), ["lang", "word"], "id")
    none = F.lit(None).cast("long")
    found = [words.select("id", none.alias("left"), none.alias("right"), "lang", F.array("word").alias("words"), F.array("f").alias("heads"), F.array("f").alias("tails"))]
    relation = None
    for k in range(2, longest + 1):
        relation = saved(first_relation(docs, words, shipped) if relation is None else next_relation(relation, groups, shipped), f"occurrences-{k - 1}", **{"parquet.block.size": ROW_GROUP})
        groups = numbered(group_counts(relation).where(F.col("f") >= least), ["left", "right"], "id")
        before = found[-1]
        left = before.select(F.col("id").alias("left"), "lang", "words", "heads")
        right = before.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"), "tails")
        rows = groups.join(left, "left").join(right, "right")
        found.append(saved(rows.select("id", "left", "right", "lang", F.array_append("words", F.col("last")).alias("words"), F.array_append("heads", F.col("f")).alias("heads"), F.array_append("tails", F.col("f")).alias("tails")), f"phrases-{k}"))
    return found, total


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in exact decimals: counts of up to 10^15."""
    d = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", d(a) * d(a) * F.lit(1_000_000).cast("decimal(7,0)"), d(left) * d(right)).cast("long")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, replaced: int = REPLACED_PERCENT, shipped: int = SHIPPED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words of each language.

    A null language is `und`, a null text empty. Words are lower-cased in A-Z and stand between spaces and tabs within
    pieces; pieces end at [.,;:!?\\x0A-\\x0D]. a, l and r count a phrase and the two sides of its lowest-scoring cut (ties:
    the shortest left side), n all words of the language. A phrase goes if a longer one that has it occurs in
    `replaced` percent of its places or more. Ties in score and a go by the phrase's bytes. Repeated rows count each. Texts of any
    length are counted whole. A table without frequent phrases, or an empty one, gives an empty one. Other columns are left out.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    texts = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    found, total = frequent_phrases(texts, longest, least, shipped)
    kept = []
    for k, phrases in enumerate(found[1:], 2):
        a = F.element_at("heads", k)
        cuts = [F.struct(cut_score(a, F.element_at("heads", j), F.element_at("tails", k - j)).alias("score"), F.lit(j).alias("j"), F.element_at("heads", j).alias("l"), F.element_at("tails", k - j).alias("r")) for j in range(1, k)]
        lowest = reduce(lambda x, y: F.when(y.score < x.score, y).otherwise(x), cuts[1:], cuts[0])
        rows = phrases.select("id", "lang", F.array_join("words", " ").alias("phrase"), a.alias("a"), lowest.alias("cut"))
        if k < longest:
            # What holds a phrase within a longer one holds it within one of a word more, which is at least as frequent.
            longer = found[k].select(F.explode(F.array("left", "right")).alias("id"), F.element_at("heads", k + 1).alias("more"))
            rows = rows.join(longer.groupBy("id").agg(F.max("more").alias("more")), "id", "left").where(F.col("more").isNull() | (100 * F.col("more") < replaced * F.col("a")))
        kept.append(rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    rows = saved(reduce(DataFrame.unionByName, kept), "scored-phrases")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The first of each part of a language, then of these, until one task can order what is left.
    while (n := rows.count()) > max(ORDERED, 2 * top):
        part = F.pmod(F.xxhash64("phrase"), F.lit(-(-n // max(ORDERED, 2 * top)))).alias("part")
        place = F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))
        fewer = saved(rows.select("*", part).withColumn("rank", place).where(F.col("rank") <= top).drop("rank", "part"), "best-phrases")
        if fewer.count() == n:
            break
        rows = fewer
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
