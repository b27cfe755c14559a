"""Token counts of whole texts, with huge documents encoded in overlapping chunks that are spliced where it is proven.

A byte-pair encoding merges the adjacent pair of best rank, then leftmost; both orders are kept when a text is cut at
token boundaries. So a sequence of tokens is the encoding of what it spells exactly if every two neighbours
are what their own text encodes to, and neighbours of any encoding are. Where two overlapping chunks have a boundary
at the same place with the same token on either side, the left chunk's tokens before it and the right chunk's
tokens after it have only neighbours of that kind: they are the encoding of the whole. If an overlap has no such
boundary, the document is encoded again with wider chunks and overlaps, at last as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, slices, text_of

#: Code points of a chunk, and of what it shares with the next one. Longer documents are huge.
CHUNK, OVERLAP = 16_384, 256
#: Tokens that a document may have without being over the limit.
LIMIT = 4096
MARK = "▁"
MARKS = "array<struct<at:bigint,left:int,right:int>>"


@lru_cache(maxsize=2)
def processor(model: str):
    """The library's processor and the code points that each piece spells; a byte that continues a character spells none.

    Models that rewrite text, or whose first symbols aren't single characters, are refused: the proof doesn't hold.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    if sp.normalize("a  \tÅ ") != f"{MARK}a{MARK}{MARK}\tÅ{MARK}":
        raise ValueError("this model rewrites text or has no leading marker")
    if any(sp.is_unused(i) for i in range(n)) or sum(sp.is_byte(i) for i in range(n)) != 256:
        raise ValueError("this model has unused pieces or no pieces for bytes")
    byte = [int(sp.id_to_piece(i)[3:5], 16) if sp.is_byte(i) else -1 for i in range(n)]
    spelt = np.asarray([len(sp.id_to_piece(i)) if b < 0 else 0 if 0x80 <= b < 0xC0 else 1 for i, b in enumerate(byte)], np.int64)
    return sp, spelt


def marks(ids: np.ndarray, start: int, model: str, low: int, high: int) -> tuple[list[dict], list[int]]:
    """Boundaries of a chunk's tokens at places low..high of the document, each with the tokens on its sides.

    start is the place of the chunk's first code point. Also says how many tokens stand before each boundary.
    """
    _, spelt = processor(model)
    size = spelt[ids]
    at = start - 1 + np.concatenate([[0], np.cumsum(size)])  # less the marker that the library puts first
    inner = np.flatnonzero((at[1:-1] >= low) & (at[1:-1] <= high) & (size[1:] > 0)) + 1
    found = [{"at": a, "left": x, "right": y} for a, x, y in zip(at[inner].tolist(), ids[inner - 1].tolist(), ids[inner].tolist(), strict=True)]
    return found, inner.tolist()


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Start and text of each chunk; each but the last shares its last `overlap` code points with the next."""
    start = 0
    while True:
        yield start, text[start : start + chunk]
        if start + chunk >= len(text):
            return
        start += chunk - overlap


def splices(parts: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """(key, part, n, last, head, head_before, tail, tail_before) of chunks (key, part, start, last, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = processor(model)
        for batch in batches:
            for rows in slices(batch):
                out = []
                for r, ids in zip(rows.to_pylist(), sp.encode(text_of(rows).to_pylist(), num_threads=1), strict=True):
                    ids, start, end = np.asarray(ids, np.int64), r["start"], r["start"] + len(r["text"])
                    head, head_before = marks(ids, start, model, start, start + overlap) if r["part"] else ([], [])
                    tail, tail_before = ([], []) if r["last"] else marks(ids, start, model, end - overlap, end)
                    out.append({"key": r["key"], "part": r["part"], "n": len(ids), "last": r["last"], "head": head, "head_before": head_before, "tail": tail, "tail_before": tail_before})
                yield pa.RecordBatch.from_pylist(out, schema=_CODED)

    return parts.mapInArrow(run, f"key long, part int, n long, last boolean, head {MARKS}, head_before array<int>, tail {MARKS}, tail_before array<int>")


_MARKS = pa.list_(pa.struct([("at", pa.int64()), ("left", pa.int32()), ("right", pa.int32())]))
_CODED = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("last", pa.bool_()), ("head", _MARKS), ("head_before", pa.list_(pa.int32())), ("tail", _MARKS), ("tail_before", pa.list_(pa.int32()))])


def huge_counts(texts: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of texts (key, text); n_tokens is null where some overlap has no proven boundary.

    Chunks are dealt over all tasks, so a document isn't one task's work; what meets are the boundaries of
    neighbouring chunks, by a join on the document and the chunk's number.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for part, (start, piece) in enumerate(cut(text, chunk, overlap)):
                    last = start + chunk >= len(text)
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([start]), pa.array([last]), pa.array([piece])], names=["key", "part", "start", "last", "text"])

    parts = texts.select("key", "text").mapInArrow(chunks, "key long, part int, start long, last boolean, text string")
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = saved(splices(parts.repartition(tasks, "key", "part"), model, chunk, overlap), "chunk-tokens")
    right = coded.where("part > 0").select("key", (F.col("part") - 1).alias("part"), "head", "head_before")
    seams = coded.where("not last").select("key", "part", "tail", "tail_before").join(right, ["key", "part"])
    seams = seams.withColumn("met", F.try_element_at(F.array_intersect("tail", "head"), F.lit(1)))
    # Tokens of the left chunk before the seam, less those of the right chunk before it; of a last chunk all tokens.
    before = lambda marks, counts: F.try_element_at(F.col(counts), F.array_position(marks, F.col("met")).cast("int"))
    gained = F.when(F.col("met").isNotNull(), before("tail", "tail_before") - before("head", "head_before")).cast("long")
    terms = seams.select("key", gained.alias("n")).unionByName(coded.where("last").select("key", "n"))
    return terms.groupBy("key").agg(F.when(F.count(F.lit(1)) == F.count("n"), F.sum("n")).alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row: the ids that the library gives the whole text, counted.

    A null or empty text has no bytes and no tokens. Texts of up to `chunk` code points go to the library whole, longer ones
    in overlapping chunks; a text without any proven boundary, such as one letter a million times, ends as one
    chunk after a logarithmic number of rounds. Rows come back as often as they come in, also with null or repeated ids.
    An empty table gives an empty one. Other columns, whatever their names, are left out.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("overlaps of a chunk must not meet")
    kind = docs.schema[id_col].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = processor(model)
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch):
                text = text_of(part)
                huge = np.asarray(pc.greater(pc.utf8_length(text), chunk))
                whole = text.take(pa.array(np.arange(len(text)), mask=~huge))
                n = list(map(len, sp.encode(["" if h else t for h, t in zip(huge.tolist(), text.to_pylist(), strict=True)], num_threads=1)))
                counts = pa.array(n, pa.int64(), mask=huge)
                keys = pa.array(np.arange(key, key + part.num_rows))
                key += part.num_rows
                yield pa.RecordBatch.from_arrays([keys, part.column(0), pc.cast(pc.binary_length(text), pa.int64()), counts, whole], names=["key", id_col, "n_bytes", "n", "text"])

    source = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    # Written once: the rows' keys and the texts of huge documents stay the same whoever is lost.
    rows = saved(source.mapInArrow(short, f"key long, `{id_col}` {kind}, n_bytes long, n long, text string"), "short-counts")
    left, done = rows.where("text IS NOT NULL").select("key", "text"), None
    while not left.isEmpty():
        found = saved(huge_counts(left, model, chunk, overlap), "huge-counts")
        part = found.where("n_tokens IS NOT NULL")
        done = part if done is None else done.unionByName(part)
        left = left.join(found.where("n_tokens IS NULL").select("key"), "key", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap
    out = rows.drop("text")
    out = out.withColumn("n_tokens", F.col("n")) if done is None else out.join(done, "key", "left").withColumn("n_tokens", F.coalesce("n", "n_tokens"))
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
