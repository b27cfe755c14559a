"""Packing by concatenate and cut.

The first pass tokenises every document and gives it its offset inside its partition; the second takes prefix
sums over the partitions' token totals, so that every document knows its offset in the concatenation of all,
and cuts at multiples of the sequence length. A document that crosses a cut leaves a boundary record on either
side. Only the totals, one number for each partition, pass through the driver.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import offsets_of, saved, slices, spread, text_of

LENGTH = 1024
END = 0
#: A space next to other white space: such texts aren't cut at spaces before tokenising.
SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BESIDE = f" {SPACE}|{SPACE} |^ | $"


#: A letter and a mark or digit after it: byte-level patterns always start a new piece between these two.
INSIDE = r"[A-Za-zÀ-ÖØ-öø-ɏ][!-@\[-`{-~]"
BETWEEN = r"^(?s)(?P<head>.*?[A-Za-zÀ-ÖØ-öø-ɏ])(?P<tail>[!-@\[-`{-~].*)$"
#: What these patterns leave in one piece: letters, with a space before them or without.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Distinct pieces of text whose ids a worker keeps from one slice to the next, at most; those unused for longest go first.
KEPT = 100_000
#: Pieces that the library gets at once.
JOINED = 400
#: The character that stands for each byte in byte-level vocabularies: printable ones of Latin-1 as they are, the others from 256 on.
PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = "".join(chr(b if b in PLAIN else 256 + sum(x not in PLAIN for x in range(b))) for b in range(256))
FEED = ALPHABET[10]


@dataclass
class Library:
    """A tokenizer file: ids of texts, ids of bytes that are cut at line feeds only, the strings of its added tokens, whether texts may be cut at lone spaces, and the pieces known so far with their ids."""

    encode: Callable[[list[str]], list]
    encode_lines: Callable[[list[str]], list]
    added: str
    cuts: bool
    known: dict[str, pa.Array]


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    """The tokenizers library over a file; one thread, as Spark has a task for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec, made = json.loads(text), tokenizers.Tokenizer.from_str(text)
    before = spec.get("pre_tokenizer") or {}
    # A byte-level pattern starts a new piece at every space between two other characters.
    cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec.get("normalizer") is None
    added = "|".join(re.escape(x["content"]) for x in spec.get("added_tokens") or [])
    lines = tokenizers.Tokenizer(made.model)
    lines.pre_tokenizer = tokenizers.pre_tokenizers.Split(FEED, "isolated")
    encode, encode_lines = (lambda texts, made=x: [y.ids for y in made.encode_batch_fast(texts, add_special_tokens=False)] for x in (made, lines))
    return Library(encode, encode_lines, added, cuts, {})


def encode_pieces(pieces: list[str], lib: Library) -> pa.Array:
    """The ids of each piece as bytes; pieces without white space but a space before them go to the library by the hundred.

    A line feed between such pieces is a piece of its own with one id, at which the ids are cut again. Of words the library
    gets the bytes, as it has nothing to cut in them; other pieces it cuts by its pattern first.
    """
    feed = lib.encode(["\n"])[0]
    out: list[bytes] = [b""] * len(pieces)

    def by_lines(at: list[int], encode: Callable[[list[str]], list], form: Callable[[str], str]) -> None:
        lines = [at[k : k + JOINED] for k in range(0, len(at), JOINED)]
        for some, ids in zip(lines, encode([form("\n".join([pieces[i] for i in some])) for some in lines]), strict=True):
            raw = np.asarray(ids, "<u4")
            ends = (np.flatnonzero(raw == feed[0]) * 4).tolist()
            raw = raw.tobytes()
            for i, p, q in zip(some, [0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True):
                out[i] = raw[p:q]

    words, plain, rest = [], [], []
    for i, w in enumerate(pieces):
        if len(feed) != 1:
            rest.append(i)
        elif WORD.fullmatch(w):
            words.append(i)
        else:
            (plain if w[w[:1] == " " :].split() == [w[w[:1] == " " :]] else rest).append(i)
    by_lines(words, lib.encode_lines, lambda line: codecs.charmap_decode(line.encode(), "strict", ALPHABET)[0])
    by_lines(plain, lib.encode, str)
    for i, ids in zip(rest, lib.encode([pieces[i] for i in rest]), strict=True):
        out[i] = array("I", ids).tobytes()
    return pa.array(out, pa.binary())


def ids_of(pieces: pa.Array, lib: Library) -> pa.Array:
    """The ids of each distinct piece as bytes, from the library or as it gave them before."""
    none = pa.array([], pieces.type), pa.array([], pa.binary())
    known, ids = (lib.known.get(k, x) for k, x in zip(("pieces", "ids"), none, strict=True))
    at = pc.index_in(pieces, value_set=known)
    missing = pc.is_null(at)
    new = pieces.filter(missing)
    at = np.array(pc.fill_null(at, 0), dtype=np.int64)
    at[np.asarray(missing)] = np.arange(len(known), len(known) + len(new))
    found = pa.concat_arrays([ids, encode_pieces(new.to_pylist(), lib)]).take(pa.array(at))
    # Those of this slice are the last to go.
    idle = np.ones(len(known) + len(new), bool)
    idle[at] = False
    idle = np.flatnonzero(idle[: len(known)])
    idle = pa.array(idle[max(0, len(idle) + len(pieces) - KEPT) :])
    lib.known.update(pieces=pa.concat_arrays([known.take(idle), pieces])[-KEPT:], ids=pa.concat_arrays([ids.take(idle), found])[-KEPT:])
    return found


def values_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids in an array of bytes, one after another, and their number in each value."""
    ends = np.frombuffer(lists.buffers()[1], "<i4")[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    raw = lists.buffers()[2]
    return np.frombuffer(raw, "<u4")[ends[0] // 4 : ends[-1] // 4] if raw else np.zeros(0, "<u4"), np.diff(ends) // 4


def tokenise(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids that the library gives all texts, one after another, and the offsets of the texts.

    Where every space of a text stands alone and no added token's string is in it, a word and the space before it
    are tokenised apart from the others: each distinct one of a slice once. Other texts go to the library whole.
    """
    lib = library(path)
    odd = np.asarray(pc.match_substring_regex(text, BESIDE)) if lib.cuts else np.ones(len(text), bool)
    if lib.added:
        odd = odd | np.fromiter((re.search(lib.added, x) is not None for x in text.to_pylist()), bool, len(text))
    size = np.zeros(len(text), np.int64)
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    if not odd.all():
        rows = np.flatnonzero(~odd)
        lists = pc.split_pattern(text.take(pa.array(rows)), " ")
        offsets, words = offsets_of(lists), lists.flatten()
        head = np.zeros(len(words), bool)
        head[offsets[:-1]] = True
        spaced = pc.if_else(pa.array(head), words, pc.binary_join_element_wise(" ", words, "")).dictionary_encode()
        n, inside = len(spaced.dictionary), pc.match_substring_regex(spaced.dictionary, INSIDE)
        cut = pc.extract_regex(spaced.dictionary.filter(inside), BETWEEN)
        parts = pa.concat_arrays([spaced.dictionary.filter(pc.invert(inside)), pc.struct_field(cut, "head"), pc.struct_field(cut, "tail")]).dictionary_encode()
        found = ids_of(parts.dictionary, lib).take(parts.indices)
        uncut = n - len(cut)
        table = pa.concat_arrays([found.slice(0, uncut), pc.binary_join_element_wise(found.slice(uncut, len(cut)), found.slice(n), b"")])
        order = np.argsort(np.asarray(inside), kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        ids, own = values_of(table.take(pa.array(place[np.asarray(spaced.indices)])))
        size[rows] = np.diff(np.concatenate([[0], np.cumsum(own)])[offsets])
        if not odd.any():
            return ids, np.concatenate([[0], np.cumsum(size)])
        pieces.append((rows, ids))
    rows = np.flatnonzero(odd)
    alone = [np.asarray(x, np.uint32) for x in lib.encode(text.take(pa.array(rows)).to_pylist())]
    size[rows] = list(map(len, alone))
    ends = np.concatenate([[0], np.cumsum(size)])
    ids = np.empty(int(ends[-1]), np.uint32)
    for at, values in [*pieces, (rows, np.concatenate(alone) if alone else np.zeros(0, np.uint32))]:
        ids[spread(ends[at], size[at])] = values
    return ids, ends


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: (id, start, length, ids binary, doc_tokens, sequence_id, offset).

    A document is the ids that the library gives its whole text (null: empty) and an END id, so an empty one has one
    id; a special token's string in a text gives that token's id. ids holds little-endian unsigned 32-bit ids.
    Sequences are full but for the last; documents keep the order in which Spark reads them. Repeated rows and ids are
    packed as often as they come, null ids too; an empty table gives no piece; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            # Ids are kept between slices, so short ones cost little.
            for rows in slices(batch, most=2 << 20):
                ids, ends = tokenise(text_of(rows), tokenizer)
                n = len(ends) - 1
                full = np.insert(ids, ends[1:], END).astype("<u4", copy=False)
                ends = ends + np.arange(n + 1)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 4).astype("<i4")), pa.py_buffer(full)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(n, part), pa.int32()), pa.array(ends[:-1] + at, pa.int64()), pa.array(np.diff(ends), pa.int64()), raw],
                    names=["id", "part", "at", "doc_tokens", "ids"],
                )
                at += int(ends[-1])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    tokens = saved(source.mapInArrow(first_pass, f"id {kind}, part int, at long, doc_tokens long, ids binary"), "tokens")
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part] = total
        total += totals[part]

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "ids"):
                part, at, n = (np.asarray(rows.column(i), dtype=np.int64) for i in (1, 2, 3))
                begin = at + np.asarray([base[p] for p in part.tolist()], dtype=np.int64)
                count = (begin + n - 1) // length - begin // length + 1
                doc = np.repeat(np.arange(len(n)), count)
                sequence = spread(begin // length, count)
                left = np.maximum(sequence * length, begin[doc])
                right = np.minimum((sequence + 1) * length, (begin + n)[doc])
                start, size = left - begin[doc], right - left
                raw = rows.column(4)
                where = np.frombuffer(raw.buffers()[1], "<i4")[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
                ids = np.frombuffer(raw.buffers()[2], "u1") if raw.buffers()[2] else np.zeros(0, "u1")
                ids = ids[where[0] : where[-1]]
                ends = np.concatenate([[0], np.cumsum(size * 4)])
                # Pieces of a slice are its ids in order, so the values stay where they are.
                cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, size)), cut, *(pa.array(x, pa.int64()) for x in (n[doc], sequence, left % length))],
                    names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return tokens.mapInArrow(second_pass, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def checksum(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
