"""Near-duplicate embeddings by an epsilon grid order join.

On unit vectors a cosine of at least t is a distance of at most eps = sqrt(2 - 2t). Vectors are projected on a
few orthonormal axes (the leading principal ones of a sample), which never lengthens a distance, and sorted by
label and by their cells of an eps grid on those axes. The sorted sequence is cut into blocks; a block meets only
the blocks of the same or neighbouring cells whose bounding boxes are within eps, and inside such a pair of
intervals the join recurses on halves and skips those that are provably too far apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import offsets_of, saved, with_columns

THRESHOLD = 0.98
AXES = 8
BLOCK = 1024
LEAF = 128
#: Vectors of one label that a cell may hold before another axis joins the blocks' key.
CELL_ROWS = 8192
MOST_KEY_AXES = 4
SAMPLE = 2048


def principal_axes(vectors: list[list[float]], dims: int, axes: int) -> np.ndarray:
    """Orthonormal rows: the leading principal axes of unit vectors, shorter ones padded with zeros."""
    x = np.zeros((max(1, len(vectors)), dims))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
        x[i] /= np.abs(x[i]).max() or 1
        x[i] /= math.sqrt(math.fsum(x[i] ** 2)) or 1
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=True)[2][: min(axes, dims)] if dims <= 4096 else np.eye(axes, dims)


def near_pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, eps: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in a, j in b) with cosine >= threshold; for same only i before j. x: vectors, y: projections."""
    # Scaling by the largest component keeps products of large ones finite and of small ones above zero.
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324) if len(x) else x
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def join(p: np.ndarray, q: np.ndarray, own: bool) -> None:
        if not len(p) or not len(q):
            return
        if not own:
            gap = np.maximum(0, np.maximum(y[q].min(axis=0) - y[p].max(axis=0), y[p].min(axis=0) - y[q].max(axis=0)))
            if gap @ gap > eps * eps:
                return
        if len(p) <= LEAF and len(q) <= LEAF:
            i, j = np.nonzero((x[p] @ x[q].T) / (norm[p][:, None] * norm[q]) >= threshold)
            if own:
                i, j = i[i < j], j[i < j]
            left.append(p[i])
            right.append(q[j])
        elif own:
            h = len(p) // 2
            join(p[:h], p[:h], True)
            join(p[:h], p[h:], False)
            join(p[h:], p[h:], True)
        elif len(p) >= len(q):
            h = len(p) // 2
            join(p[:h], q, False)
            join(p[h:], q, False)
        else:
            h = len(q) // 2
            join(p, q[:h], False)
            join(p, q[h:], False)

    join(a, b, same)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n points the smallest index that the pairs reach."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept).

    Vectors are compared when their labels are equal and not null and they have equally many components. A
    vector that is null, empty or zero or holds a null or non-finite component links with nothing, nor does one
    with a null id. Equal vectors of a label are joined once, as a class with a size. Rows that repeat an id
    count as links of each other. Other columns are left out.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    eps = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-9
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    good = rows.where("valid").select("id", "label", "v")
    classes = saved(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes")
    shape = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).agg(F.max("n"), F.max("d")).first()
    most, dims = shape[0] or 0, shape[1] or 1
    sample = [r["v"] for r in classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()]
    axes = principal_axes(sample, dims, AXES)
    keys = min(MOST_KEY_AXES, len(axes), max(1, math.ceil(math.log(max(1, most) / CELL_ROWS, 4))) if most > CELL_ROWS else 1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets, flat = offsets_of(lists), np.asarray(lists.flatten(), dtype=np.float64)
            x = np.zeros((batch.num_rows, dims))
            size = np.diff(offsets)
            x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offsets[:-1], size)] = flat
            # Scaling by the largest component first keeps the squares finite.
            x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324)
            y = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ axes.T
            cells = np.floor(y / eps).astype(np.int32)
            even = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), t))
            yield pa.RecordBatch.from_arrays([*batch.columns, even(cells[:, :keys], pa.int32()), even(cells[:, keys:], pa.int32()), even(y, pa.float64())], names=["rep", "label", "v", "n", "cell", "rest", "y"])

    label_kind = vectors.schema[label_col].dataType.simpleString()
    v_kind = vectors.schema[vector_col].dataType.simpleString()
    placed = classes.select("rep", "label", "v", "n").mapInArrow(project, f"rep {kind}, label {label_kind}, v {v_kind}, n long, cell array<int>, rest array<int>, y array<double>")
    order = [F.col("label"), F.size("v"), F.col("cell"), F.col("rest"), F.col("rep")]
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    columns = placed.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, last = TaskContext.get().partitionId() << 36, 0, None
        for batch in batches:
            out = []
            sizes = np.diff(offsets_of(batch.column(2))).tolist()
            for key in zip(batch.column(1).to_pylist(), sizes, batch.column(4).to_pylist(), strict=True):
                if key != last or held == block:
                    number, held, last = number + 1, 0, key
                held += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*columns, "block"])

    sequence = saved(placed.mapInArrow(cut, with_columns(placed, block="long")), "grid-order")
    bounds = [f(F.col("y")[j]).alias(f"{n}{j}") for j in range(len(axes)) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = saved(sequence.groupBy("block", "label", F.size("v").alias("d"), "cell").agg(*bounds), "grid-boxes")
    one = boxes
    for k in range(keys):
        middle = F.col("cell")[k]
        one = one.withColumn(f"k{k}", F.explode(F.array(middle - 1, middle, middle + 1)))
    near_cell = F.array(*[F.col(f"k{k}") for k in range(keys)])
    one = one.withColumn("cell", near_cell).drop(*[f"k{k}" for k in range(keys)])
    two = boxes.select("label", "d", "cell", *[F.col(c).alias(f"{c}_b") for c in boxes.columns if c not in ("label", "d", "cell")])
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"lo{j}_b") - F.col(f"hi{j}"), F.col(f"lo{j}") - F.col(f"hi{j}_b")), F.lit(2)) for j in range(len(axes)))
    pairs = one.join(two, ["label", "d", "cell"]).where((F.col("block") <= F.col("block_b")) & (gap <= eps * eps)).select(F.col("block").alias("a"), F.col("block_b").alias("b"))
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("a", "b"))))
    met = sides.join(sequence.select("block", "rep", "n", "v", "y"), "block")

    def join_blocks(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        x = np.asarray(table["v"].combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)
        y = np.asarray(table["y"].combine_chunks().flatten()).reshape(table.num_rows, -1)
        rank = np.lexsort(np.floor(y / eps).T[::-1])
        where = np.asarray(table["block"])[rank]
        left, right = near_pairs(x, y, rank[where == a], rank[where == b], a == b, eps, threshold)
        n = np.asarray(table["n"])
        links = np.bincount(left, n[right], table.num_rows) + np.bincount(right, n[left], table.num_rows)
        label = local_components(table.num_rows, left, right)
        found = np.flatnonzero(links)
        rep = table["rep"].combine_chunks()
        return pa.table([rep.take(pa.array(found)), rep.take(pa.array(label[found])), pa.array(links[found].astype(np.int64))], names=["src", "dst", "links"])

    links = saved(met.groupBy("a", "b").applyInArrow(join_blocks, f"src {kind}, dst {kind}, links long"), "vector-links")
    found = connected_components(links.select("src", "dst"))
    stats = links.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    stats = saved(stats.join(found.withColumnRenamed("id", "rep"), "rep", "left"), "vector-stats")
    own = saved(good.join(classes, ["label", "v"]).select("id", "rep", "n"), "vector-members")
    linked = own.join(stats, "rep", "left").select(
        "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
