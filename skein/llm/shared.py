"""What several operators use: the shared folder, saved tables, slices of text and their words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that one step of a task works on at once, in bytes; a longer document is a step of its own.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where none is set and Spark runs on this machine alone, as in tests, a folder of it becomes the checkpoint folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that the executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            found = context._jsc.sc().getCheckpointDir()
        base = found.get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Writes df to the shared folder and reads it again: later jobs start there, whoever is lost. options are the writer's."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_training(doc_id: Column) -> Column:
    """True for the rows that models may learn from; the others are held out."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most per_class training documents of each class: (doc_id, text, y), chosen by a hash of the id.

    per_class bounds the ids, so the join broadcasts them.
    """
    ids = None
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
    for y in (0, 1):
        one = (
            rows.where(F.col(label) == y)
            .select("doc_id", F.lit(y).alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(per_class)
        )
        ids = one if ids is None else ids.unionByName(one)
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id")
        .dropDuplicates(["doc_id"])
    )


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column, null as empty."""
    text = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(text.type):
        text = text.cast(pa.string())
    return pc.fill_null(text, "")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, about most bytes of text at a time."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.binary_length(text_of(batch, column)), dtype=np.int64) + 64
    step = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(step)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_columns(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of df with columns of these types after its own; a name that df has already, in any case, is an error."""
    if taken := sorted(k for k in kinds if free_name(df, k) != k):
        raise ValueError(f"there are columns named {', '.join(taken)}: pass other names")
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items())])


def offsets_of(lists: pa.Array) -> np.ndarray:
    """Offsets of a list array into its flattened values, from 0."""
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return offsets - offsets[0]


def distinct_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between white space: offsets by row, a code for each word, and the distinct words themselves."""
    lists = pc.utf8_split_whitespace(text)
    words = lists.flatten().dictionary_encode()
    return offsets_of(lists), np.asarray(words.indices, dtype=np.int64), words.dictionary


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], ... starts[i] + lengths[i] - 1 for each i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values by row of a ragged array; empty rows give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words one after another, and the offsets of the words."""
    lengths = np.asarray(pc.utf8_length(words), dtype=np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points, np.concatenate([[0], np.cumsum(lengths)])


def mixed(h: np.ndarray) -> np.ndarray:
    """Stirs the bits of 64-bit hashes."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, written, with the place of each row in that order, from 0, as column name.

    A range sort deals the rows out; the sizes of its partitions, a row each, give every partition its base.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy(part.alias("p")).count().collect())
    base, total = {}, 0
    for p, n in sizes:
        base[p], total = total, total + n
    bases = F.array(*[F.lit(base.get(p, 0)) for p in range(max(base, default=0) + 1)])
    return dealt.withColumn(name, (F.element_at(bases, part.cast("int") + 1) + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")
