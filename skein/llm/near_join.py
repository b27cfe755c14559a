"""Similarity join on word n-grams: MinHash LSH forest, then exact verification.

A text is the set of its five-word shingles. Each of the forest's trees is a trie over a few MinHash values of the
texts, kept as a sorted table: texts that agree on a prefix lie next to each other. Joining starts with texts that
agree on whole paths and shortens the prefix by one value at a time; at each length only texts of different branches
of a node are new to each other. The similarities of what was found say how many links a prefix of that length must
have missed: shortening ends when these are fewer than the target recall allows, or at the length at which even links
at the threshold itself are found often enough. Texts that agree, and whose whole signatures don't rule a link out,
form candidate families; within a family every pair is verified on the shingle sets themselves. Texts with the same
set are one class, joined once. Large nodes and families are dealt as pairs of blocks, each of which returns counts
and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .embedding_join import local_components
from .shared import distinct_words, mixed, offsets_of, saved, slices, text_of

WORDS = 5
SIMILARITY = 0.8
TREES = 16
DEPTH = 6
#: Probability at which a link at the threshold itself has to be found, and the share of all links that may end shortening sooner.
RECALL = 0.9995
ENOUGH = 0.99999
#: How far below the threshold the share of equal signature values may lie (over five standard deviations).
MARGIN = 0.26
BUCKET_BLOCK = 1024
FAMILY_BLOCK = 256
FAMILY_SHINGLES = 1 << 20
#: Ids that a join broadcasts at most: eight bytes each.
BROADCAST_ROWS = 500_000
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡·"


def found_share(similarity: np.ndarray | float, trees: int, prefix: int) -> np.ndarray | float:
    """The probability that a pair agrees on a prefix of that length in one of the trees."""
    return 1 - (1 - similarity**prefix) ** trees


def prefix_depth(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which the trees together find a pair of that similarity with that probability."""
    while depth > 1 and found_share(similarity, trees, depth) < recall:
        depth -= 1
    return depth


def recall_at(seen: dict[int, float], values: int, trees: int, prefix: int) -> float:
    """The share of all links that prefixes of that length find, judged by those found: pairs by equal signature values.

    A pair that is found with probability p stands for 1 / p pairs. Without pairs nothing is known: 0.
    """
    if not seen:
        return 0.0
    same, n = np.asarray(list(seen), float), np.asarray(list(seen.values()))
    return float(n.sum() / (n / found_share(same / values, trees, prefix)).sum())


def shingles(text: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted: offsets by row, hashes, and 16-byte keys of the sets.

    Words are lower-cased and lose punctuation at their ends. A text of fewer words has one shingle, of all.
    """
    offsets, codes, distinct = distinct_words(text)
    plain = pc.utf8_trim(pc.utf8_lower(distinct), PUNCTUATION).to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in plain), np.uint64, len(plain))
    at = table[codes] if len(codes) else np.zeros(0, np.uint64)
    real = at != 0
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    at = at[real]
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(at) - words + 1), np.uint64)
        for j in range(words):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + at[j : j + len(rolled)]
    rolled = mixed(rolled)
    out, keys, size = [], [], np.zeros(len(offsets) - 1, np.int64)
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a >= words:
            own = np.unique(rolled[a : b - words + 1])
        elif b > a:
            own = np.asarray([xxhash.xxh64_intdigest(at[a:b].tobytes())], np.uint64)
        else:
            keys.append(None)
            continue
        out.append(own)
        size[row] = len(own)
        keys.append(xxhash.xxh128_digest(own.tobytes()))
    return np.concatenate([[0], np.cumsum(size)]), np.concatenate(out) if out else np.zeros(0, np.uint64), keys


def min_hashes(offsets: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
    """count MinHash values of 32 bits for each non-empty row."""
    random = np.random.default_rng(20)
    a = random.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = random.integers(0, 2**63, count, dtype=np.uint64)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), count), np.uint32)
    # Groups of rows that stay in the processor's cache.
    cut = np.flatnonzero(np.diff(starts // 32768)) + 1
    with np.errstate(over="ignore"):
        for p, q in zip([0, *cut.tolist()], [*cut.tolist(), len(starts)], strict=True):
            if p == q:
                continue
            own = hashes[starts[p] : starts[q] if q < len(starts) else len(hashes)]
            for j in range(count):
                out[p:q, j] = np.minimum.reduceat(((own * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), starts[p:q] - starts[p])
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first `keys` columns."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        cols = [np.asarray(table.column(i)) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        if len(change):
            cut = int(change[-1]) + 1
            yield table.slice(0, cut).combine_chunks()
            table = table.slice(cut)
        held = table
    if held is not None:
        yield held.combine_chunks()


def run_starts(table: pa.Table, keys: int) -> np.ndarray:
    cols = [np.asarray(table.column(i)) for i in range(keys)]
    return np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1, [table.num_rows]])


def forest(trees: int, depth: int, prefix: int, likely: float, similarity: float):
    """Rows of a node that agree on a prefix of that length and on no longer one, or on the whole path if it is that long.

    The rows of a node come sorted by path. Yields edges (src, dst) of a spanning forest of pairs whose signatures agree
    on at least the likely share, and (same, n): new pairs of at least that similarity by equal values. A pair that
    several trees show counts in each by its part; one that a longer prefix has shown is not new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, float] = {}
        for table in groups(batches, 3):
            starts = run_starts(table, 3)
            raw = table.column("sig").chunk(0)
            sig = np.frombuffer(raw.buffers()[2], np.uint8)[np.frombuffer(raw.buffers()[1], "<i4")[raw.offset] :][: table.num_rows * trees * depth].reshape(table.num_rows, -1)
            left = np.asarray(table.column("two"))
            cross = np.asarray(table.column("bi")) != np.asarray(table.column("bj"))
            row = np.arange(table.num_rows)
            path = sig.reshape(-1, trees, depth)[row, np.asarray(table.column("tree"))]
            fresh = np.zeros(table.num_rows, bool)
            fresh[starts[:-1]] = True
            node, branch = (np.cumsum(fresh | np.concatenate([[True], (path[1:, :k] != path[:-1, :k]).any(axis=1)])) for k in (prefix, prefix + 1))
            end = np.searchsorted(node, node, side="right")
            one: list[np.ndarray] = []
            two: list[np.ndarray] = []
            for shift in range(1, int((end - row).max())):
                i = row[row + shift < end]
                i = i[(~cross[i] | (left[i] != left[i + shift])) & ((branch[i] != branch[i + shift]) | (prefix == depth))]
                for at in range(0, len(i), 1 << 16):
                    p = i[at : at + (1 << 16)]
                    agree = sig[p] == sig[p + shift]
                    same = agree.sum(axis=1)
                    keep = same >= likely * trees * depth
                    one.append(p[keep])
                    two.append(p[keep] + shift)
                    close = same >= similarity * trees * depth
                    shown = np.logical_and.accumulate(agree[close].reshape(-1, trees, depth), axis=2).sum(axis=2)
                    new = shown.max(axis=1, initial=0) == prefix
                    for k, n in zip(same[close][new].tolist(), (1 / (shown[new] == prefix).sum(axis=1)).tolist(), strict=True):
                        seen[k] = seen.get(k, 0.0) + n
            if not one:
                continue
            # To the smallest id of each component, so that trees and lengths which join the same rows give the same edges.
            rep = table.column("rep").combine_chunks()
            order = np.asarray(pc.sort_indices(rep), dtype=np.int64)
            rank = np.empty(len(order), np.int64)
            rank[order] = row
            label = order[local_components(len(order), rank[np.concatenate(one)], rank[np.concatenate(two)])][rank]
            found = np.flatnonzero(label != row)
            if len(found):
                none = pa.nulls(len(found))
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(found)), rep.take(pa.array(label[found])), none.cast(pa.int32()), none.cast(pa.float64())], names=["src", "dst", "same", "n"])
        if seen:
            none = pa.nulls(len(seen), rep.type)
            yield pa.RecordBatch.from_arrays([none, none, pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.float64())], names=["src", "dst", "same", "n"])

    return run


def common(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many hashes each two rows share, by products of blocks of the incidence matrix."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    row, column = row[order][shared], column[shared]
    out = np.zeros((n, n))
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    width = 4096
    bounds = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
    for k, (p, q) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if p < q:
            x = np.zeros((n, min(width, int(column[q - 1]) - k * width + 1)), np.float32)
            x[row[p:q], column[p:q] - k * width] = 1
            out += x @ x.T
    return out


def verify(similarity: float):
    """Exact links within pairs of blocks of a family: (src, smallest reached, links) for rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            reps = np.asarray(table.column("rep"))
            fresh = np.concatenate([[True], reps[1:] != reps[:-1]])
            fresh[run_starts(table, 3)[:-1]] = True
            table = table if fresh.all() else table.filter(pa.array(fresh)).combine_chunks()
            starts = run_starts(table, 3)
            sets = table.column("set").combine_chunks()
            two, size = np.asarray(table.column("two")), np.asarray(table.column("size"))
            rep = table.column("rep").combine_chunks()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                lists = sets.slice(a, b - a)
                hashes = np.frombuffer(b"".join(lists.to_pylist()), np.uint64)
                n = np.asarray(pc.binary_length(lists), dtype=np.int64) // 8
                both = common(np.concatenate([[0], np.cumsum(n)]), hashes)
                linked = both >= similarity * (n[:, None] + n - both) - 1e-9
                np.fill_diagonal(linked, False)
                if table.column("bi")[a].as_py() != table.column("bj")[a].as_py():
                    linked &= two[a:b, None] != two[a:b]
                links = linked @ size[a:b]
                left, right = np.nonzero(np.triu(linked))
                label = local_components(b - a, left, right)
                found = np.flatnonzero(links)
                if len(found):
                    yield pa.RecordBatch.from_arrays([rep.take(pa.array(found + a)), rep.take(pa.array(label[found] + a)), pa.array(links[found].astype(np.int64))], names=["src", "dst", "links"])

    return run


def in_blocks(rows: DataFrame, blocks: str, key: str) -> DataFrame:
    """Deals each group's rows to pairs of its blocks: (key, bi, bj, two, ...); two tells which block a row is of."""
    rows = rows.withColumn("two", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int"))
    whole = rows.where(F.col(blocks) == 1).withColumn("bi", F.lit(0)).withColumn("bj", F.lit(0))
    many = rows.where(F.col(blocks) > 1).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    many = many.withColumn("bi", F.least("two", "other")).withColumn("bj", F.greatest("two", "other")).drop("other")
    return whole.unionByName(many).select(key, "bi", "bj", "two", *[c for c in rows.columns if c not in (key, "bi", "bj", "two", blocks)])


def by_row(source: DataFrame, id_col: str, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """join over source(id, text) where different texts share an id: by numbers of rows in the order of ids, null last."""
    order = F.col("id").asc_nulls_last()
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(source.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    found = join(rows.select(F.when(F.col("id").isNotNull(), F.col("row")).alias("row"), "text"))
    name = lambda number, out: rows.select(F.col("row").alias(number), F.col("id").alias(out))
    found = found.join(name("row", "own"), "row", "left").join(name("class_id", "class"), "class_id", "left").join(name("component_id", "least"), "component_id", "left")
    return found.select(F.col("own").alias(id_col), F.col("class").alias("class_id"), "n_links", F.col("least").alias("component_id"), F.col("own").eqNullSafe(F.col("least")).alias("kept"))


def similarity_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, enough: float = ENOUGH,
) -> DataFrame:
    """One row per input row: (id, class_id, n_links, component_id, kept).

    class_id is the smallest id of the texts with the same shingle set, n_links the number of other rows at a
    Jaccard similarity of at least `similarity`, component_id the smallest id that links reach, kept whether it
    is the row's own. Null texts, texts without words and rows without an id link with nothing. Rows that repeat an
    id count as rows of their own, so copies under one id link with each other. An empty table gives an empty one.
    Other columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    count = trees * depth

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                offsets, hashes, keys = shingles(text_of(rows), words)
                n = np.diff(offsets)
                sig = np.zeros((len(n), count), np.uint32)
                sig[n > 0] = min_hashes(offsets, hashes, count)
                flat = pa.array(sig.view(np.int32).ravel(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * count, pa.int32()), flat)],
                    names=["id", "n", "key", "sig"],
                )

    signed = saved(source.mapInArrow(sign, f"id {kind}, n long, key binary, sig array<int>"), "signatures")
    real = signed.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    classes = saved(real.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig")), "shingle-classes")

    if not classes.groupBy("rep").count().where("count > 1").isEmpty():
        return by_row(source, id_col, lambda rows: similarity_join(rows, "row", "text", words, similarity, trees, depth, recall, enough))

    shortest = prefix_depth(similarity, trees, depth, recall)
    roots = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.slice("sig", t * depth + 1, shortest)).alias("bucket")))
    thin = classes.select("rep", F.inline(roots))
    crowded = saved(thin.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    # Eight bits of each value are enough to rule links out and to tell branches apart: unequal values agree once in 256.
    short = F.unhex(F.array_join(F.transform("sig", lambda s: F.lpad(F.hex(s.bitwiseAND(255)), 2, "0")), ""))
    members = saved(thin.join(crowded, "bucket").select("bucket", "tree", "rep", F.ceil(F.col("m") / BUCKET_BLOCK).alias("blocks")), "bucket-members")
    bits = saved(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", short.alias("sig")), "short-signatures")
    tries = saved(in_blocks(members.join(bits, "rep"), "blocks", "bucket"), "tries")
    path = F.expr(f"substring(sig, tree * {depth} + 1, {depth})")
    seen: dict[int, float] = {}
    edges: DataFrame | None = None
    for prefix in range(depth, shortest - 1, -1):
        rows = tries.select("bucket", "bi", "bj", "two", "tree", "rep", "sig").repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", path, "rep")
        found = saved(rows.mapInArrow(forest(trees, depth, prefix, similarity - MARGIN, similarity), f"src {kind}, dst {kind}, same int, n double"), "candidate-edges")
        # One row for each number of equal values comes back.
        for r in found.where("same IS NOT NULL").groupBy("same").agg(F.sum("n").alias("n")).collect():
            seen[r["same"]] = seen.get(r["same"], 0.0) + r["n"]
        own = found.where("src IS NOT NULL").select("src", "dst")
        edges = own if edges is None else edges.unionByName(own)
        if recall_at(seen, count, trees, prefix) >= enough:
            break
    families = connected_components(edges)

    size = classes.select("rep", "size", "n", "key").join(families.withColumnRenamed("id", "rep"), "rep")
    size = saved(size, "family-members")
    blocks = size.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK), F.ceil(F.sum("n") / FAMILY_SHINGLES)).alias("blocks"))
    wanted = saved(size.join(blocks, "component").select("rep", "size", "component", "blocks", "key"), "families")
    few = wanted.count() <= BROADCAST_ROWS
    texts = source.join(F.broadcast(wanted) if few else wanted, source["id"] == wanted["rep"]).select("rep", "size", "component", "blocks", "key", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                offsets, hashes, keys = shingles(text_of(rows), words)
                # Rows that repeat an id may hold another text than the class's.
                own = pc.equal(pa.array(keys, pa.binary()), rows.column(4)).fill_null(False)
                sets = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer((offsets * 8).astype("<i4")), pa.py_buffer(np.ascontiguousarray(hashes))])
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], sets], names=["rep", "size", "component", "blocks", "set"]).filter(own)

    sets = texts.mapInArrow(gather, f"rep {kind}, size long, component {kind}, blocks long, set binary")
    sets = in_blocks(sets, "blocks", "component").repartition(parts, "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj", "rep")
    sets = sets.select("component", "bi", "bj", "two", "rep", "size", "set")
    links = saved(sets.mapInArrow(verify(similarity), f"src {kind}, dst {kind}, links long"), "links")
    found = connected_components(links.select("src", "dst"))
    stats = links.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links")).join(found.withColumnRenamed("id", "rep"), "rep", "left")
    stats = saved(classes.select("key", "rep", "size").join(stats, "rep", "left"), "class-stats")
    rows = real.select("id", "key").join(stats, "key").select(
        "id", F.col("rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    alone = signed.where(F.col("key").isNull() | F.col("id").isNull()).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return rows.unionByName(alone).select(F.col("id").alias(id_col), "class_id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
