"""Fill-in-middle: texts cut at two unit boundaries that a wavelet matrix over character classes finds.

The bytes of a slice of texts get a class each and the classes go into a wavelet matrix. Boundaries of units are
unions of classes, so their number up to a place is a sum of ranks; the k-th boundary is found by bisection on that
sum, for both cuts of all texts of the slice at once. Nothing is decoded, split or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, text_of, with_columns

#: Classes of bytes. A continuation byte of UTF-8 starts nothing; every other one starts a code point.
CONTINUATION, LINE_START, WORD_START, WHITE, INNER = range(5)
LEVELS = 3
#: The classes whose bytes begin a unit.
UNITS = {
    "char": (LINE_START, WORD_START, WHITE, INNER),
    "word": (WORD_START,),
    "line": (LINE_START,),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHITE_BYTES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def classes(data: np.ndarray, starts: np.ndarray, unit: str) -> np.ndarray:
    """The class of each byte; starts are the places where texts begin.

    A word starts at a byte other than white space after white space, a line after a line feed. Words and lines both
    start at the first byte of a text, so that its first unit holds all of it up to the second boundary. A byte can start
    both a line and a word: which of the two its class says follows from the unit.
    """
    before = np.concatenate([[10], data[:-1]]).astype(np.uint8) if len(data) else data
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    first = first[:-1]
    white = WHITE_BYTES[data]
    kind = np.where(white, WHITE, INNER).astype(np.uint8)
    kind[(data & 0xC0) == 0x80] = CONTINUATION
    if unit == "word":
        kind[(WHITE_BYTES[before] & ~white) | first] = WORD_START
    elif unit == "line":
        kind[(before == 10) | first] = LINE_START
    return kind


class WaveletMatrix:
    """Ranks of symbols of LEVELS bits: at each level a bit of every symbol, zeros first for the next level.

    A level keeps its bits packed into words of 64 and their sums before each word.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        self.size = len(symbols)
        self.bits, self.sums, self.zeros = [], [], []
        for level in reversed(range(LEVELS)):
            bit = (symbols >> level) & 1
            padded = np.zeros(-(-(self.size + 1) // 64) * 64, np.uint8)
            padded[: self.size] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(self.size - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before the places at."""
        word, left = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << left) - np.uint64(1)
        return self.sums[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before each of the places at (0 to size)."""
        low, high = np.zeros_like(at), at
        for i, level in enumerate(reversed(range(LEVELS))):
            a, b = self._ones(i, low), self._ones(i, high)
            low, high = (a + self.zeros[i], b + self.zeros[i]) if symbol >> level & 1 else (low - a, high - b)
        return high - low

    def boundaries(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """Boundaries before each place: the ranks of all classes that begin a unit."""
        return sum((self.rank(s, at) for s in symbols), np.zeros_like(at))

    def locate(self, symbols: tuple[int, ...], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest place in low..high with at most k boundaries before it: bisection on ranks.

        With k counted from 0 that is where the boundary number k stands, or high if there is none.
        """
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.boundaries(symbols, middle) <= k
            low, high = np.where(open_ & fits, middle, low), np.where(open_ & ~fits, middle - 1, high)
        return low


def cut_texts(text: pa.Array, first: np.ndarray, second: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each text the bytes of its parts, with both cuts drawn from its units.

    first and second are random 32-bit numbers; modulo units + 1 they give the two cuts. Returns the number of
    units n, the cuts (2 x rows, in units, in order), and the byte places start, cut, cut, end of each text in the slice's buffer.
    """
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts, ends = offsets[:-1], offsets[1:]
    matrix, symbols = WaveletMatrix(classes(data, starts[starts < ends], unit)), UNITS[unit]
    base, n = matrix.boundaries(symbols, starts), None
    n = matrix.boundaries(symbols, ends) - base
    cuts = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    places = [np.where(c == n, ends, matrix.locate(symbols, base + c, starts, ends)) for c in cuts]
    return n, cuts, [starts, *places, ends]


def seeds(id_col: Column, seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits from the hash of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, unit: str = "char", seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n, form, prefix_chars, middle_chars, output).

    n counts the units of the text: code points, words with the white space after them, or lines with their ends (white
    space before the first word belongs to the first unit). The prefix ends after the smaller of two drawn numbers of
    units, the middle after the larger; prefix_chars and middle_chars count their code points. form is
    plain (output is the text; no counts), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part led by
    its marker. Texts that are null (taken as empty), empty or hold a marker are plain, as are rows with a null
    id, whose draws are null. Equal rows give equal rows. An empty table gives an empty one. Texts of any length are cut whole.
    Other columns, whatever their names, are left out.
    """
    h1, h2, h3, h4 = seeds(docs[id_col], seed)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= 100 - plain_percent) | docs[id_col].isNull()
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    source = docs.select(docs[id_col].alias(id_col), text.alias("text"), form.alias("form"), F.coalesce(h1, F.lit(0)).alias("h1"), F.coalesce(h2, F.lit(0)).alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _rows(part, id_col, unit)

    return source.mapInArrow(run, with_columns(source.select(id_col), n="long", form="string", prefix_chars="long", middle_chars="long", output="string"))


def _rows(part: pa.RecordBatch, id_col: str, unit: str) -> pa.RecordBatch:
    text, form = text_of(part), part.column(2)
    h1, h2 = (np.asarray(part.column(i), dtype=np.int64) for i in (3, 4))
    n, cuts, places = cut_texts(text, h1, h2, unit)
    raw = text.buffers()[2]
    data = raw.to_pybytes() if raw else b""
    base = np.frombuffer(text.buffers()[1], np.int32, 1, text.offset * 4)[0]
    pieces = [_piece(data, base, a, b) for a, b in zip(places[:-1], places[1:], strict=True)]
    prefix, middle, suffix = pieces
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    plain = pc.equal(form, "plain")
    output = pc.if_else(plain, text, pc.if_else(pc.equal(form, "psm"), psm, spm))
    none = pa.scalar(None, pa.int64())
    counts = [pc.if_else(plain, none, pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(n), form, *counts, output], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])


def _piece(data: bytes, base: int, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The texts data[a:b] as an array."""
    return pa.array([data[base + i : base + j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()).cast(pa.string())


def restore(output: Column, form: Column) -> Column:
    """The text that transform() made output from: markers can't occur in its parts, nor across their seams."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.try_element_at(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)
