"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the models taken here has a white-space marker after another character, so pieces never cross
the start of a marked word and a text's segmentation is that of its chunks, one after another. Each task
cuts its texts at single spaces, segments every distinct chunk of a slice of texts once, and joins the ids
back by position with array gathers. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import offsets_of, slices, spread, text_of

MARK = "▁"


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [found.id_to_piece(i) for i in range(found.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("pieces of this model cross white-space markers: chunks can't be segmented alone")
    if found.encode("a  b", out_type=str)[0][0] != MARK or found.normalize("a  \tÅ") != f"{MARK}a{MARK}{MARK}\tÅ":
        raise ValueError("this model rewrites text or has no leading marker: chunks can't be segmented alone")
    return found


def _chunks(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Marked words: a run of spaces belongs to the word after it. Offsets by row, and the chunks without their first space."""
    spaced = pc.replace_substring(text, MARK, " ")
    lists = pc.split_pattern(spaced, " ")
    return offsets_of(lists), lists.flatten()


def encode_texts(text: pa.Array, model: str) -> pa.Array:
    """The ids of each text, as the library's encode() gives them."""
    sp = processor(model)
    offsets, chunks = _chunks(text)
    size = np.diff(offsets)
    empty = np.asarray(pc.equal(pc.binary_length(chunks), 0))
    first = np.zeros(len(chunks), bool)
    first[offsets[:-1]] = True
    # An empty chunk is a space that belongs to a run: it joins the chunk after it. An empty text has no chunk.
    if empty.any():
        last = np.zeros(len(chunks), bool)
        last[offsets[1:] - 1] = True
        row = np.repeat(np.arange(len(size)), size)
        kept = np.flatnonzero((~empty | last) & ~(empty & last & first))
        before = np.concatenate([[-1], kept[:-1]])
        spaces = kept - np.maximum(before, offsets[:-1][row[kept]] - 1) - 1
        chunks = chunks.take(pa.array(kept))
        led = np.flatnonzero(spaces)
        longer = [" " * n + w for n, w in zip(spaces[led].tolist(), chunks.take(pa.array(led)).to_pylist(), strict=True)]
        chunks = pc.replace_with_mask(chunks, pa.array(spaces > 0), pa.array(longer, pa.string()))
        size = np.bincount(row[kept], minlength=len(size))
    coded = chunks.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    table = [sp.encode(w) or [] for w in coded.dictionary.to_pylist()]
    # The library gives nothing for an empty text, but a marker for an empty last chunk.
    mark = sp.piece_to_id(MARK)
    table = [x or [mark] for x in table]
    lengths = np.fromiter(map(len, table), np.int64, len(table))
    flat = np.fromiter((i for x in table for i in x), np.int32, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    ids = flat[spread(starts[codes], lengths[codes])]
    ends = np.concatenate([[0], np.cumsum(lengths[codes])])[np.concatenate([[0], np.cumsum(size)])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


@lru_cache(maxsize=2)
def _pieces(model: str) -> tuple[pa.Array, np.ndarray]:
    """The bytes of each piece, and which of them are single bytes."""
    sp = processor(model)
    out, single = [], []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        single.append(sp.is_byte(i))
        out.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else piece.replace(MARK, " ").encode())
    return pa.array(out, pa.binary()), np.asarray(single)


def decode_ids(ids: pa.Array, model: str) -> pa.Array:
    """The text of each list of ids, as the library's decode() gives it."""
    pieces, single = _pieces(model)
    flat = np.asarray(ids.flatten(), dtype=np.int64)
    offsets = offsets_of(ids)
    if len(flat) and (flat.min() < 0 or flat.max() >= len(pieces)):
        raise ValueError("an id is outside the model's vocabulary")
    parts = pieces.take(pa.array(flat))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)
    joined = pc.binary_join(lists, b"").to_pylist()
    sp, out = processor(model), []
    for row, raw in enumerate(joined):
        raw = raw[1:] if raw[:1] == b" " and not single[flat[offsets[row]]] else raw
        try:
            out.append(raw.decode())
        except UnicodeDecodeError:  # bytes that are no text: the library's own rule replaces them
            out.append(sp.decode(flat[offsets[row] : offsets[row + 1]].tolist()))
    return pa.array(out, pa.string())


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row, the ids of the whole text without begin or end ids.

    A null or empty text has no ids. Rows come back as often as they come in, other columns are left out,
    so their names can't clash. model is the path of a SentencePiece model on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), encode_texts(text_of(part), model)], names=[id_col, "ids"])

    source = docs.select(docs[id_col], docs[text_col].alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) for every row; null ids count as none and give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                ids = part.column(1)
                ids = pc.if_else(pc.is_null(ids), pa.scalar([], ids.type), ids) if ids.null_count else ids
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decode_ids(ids, model)], names=[id_col, ids_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, text string")
