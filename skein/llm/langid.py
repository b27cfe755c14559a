"""Language identification of mixed text.

Every distinct word gets a score for each language (log probability of its character trigrams); ranges of
scripts narrow which languages a word may be of. Viterbi over a document's words with a penalty for switching
labels spans, and the language whose spans hold most letters is the document's. Apart from that it is said whether the
text fits its languages: not if its letters are of other scripts, or its trigrams nearer to random ones than to the languages' own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import code_points, distinct_words, held_out, in_training, mixed, slices, sums, text_of, with_columns

TRIGRAM_BITS = 16
#: Training documents that the model is fitted on, at most.
SAMPLE_DOCS = 6000
SWITCH = 6.0
UNKNOWN = "und"
#: A text fits its languages if its mean trigram lies within this share of the way from their own text to random trigrams.
FIT_SHARE = 0.55
#: Trigrams below which a text is too short to tell, and fits.
LEAST_TRIGRAMS = 20
# First code points of Unicode script ranges, each up to the next entry; 0 is for no letter script.
SCRIPTS = (
    (0x41, "latin"), (0x2B0, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"),
    (0x780, "thaana"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"),
    (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x2E00, ""), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xE000, ""), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFE0, ""), (0x10000, "other"), (0x1F000, ""), (0x20000, "han"), (0xE0000, ""),
)
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
STARTS = np.asarray([a for a, _ in SCRIPTS])
SCRIPT_OF = np.asarray([SCRIPT_NAMES.index(""), *(SCRIPT_NAMES.index(s) for _, s in SCRIPTS)])
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha()) + "«»“”„‘’…–—¿¡·"


@dataclass
class Words:
    """Of distinct words: trigram bins, their offsets, letters, script, whether they have digits inside, as codes do."""

    bins: np.ndarray
    offsets: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    code: np.ndarray


def analyse(distinct: pa.Array) -> Words:
    plain = pc.utf8_trim(pc.utf8_lower(distinct), TRIM)
    points, offsets = code_points(plain)
    length = np.diff(offsets)
    points = points.astype(np.int64)
    # Every word between two marks: w characters give w trigrams.
    inner = np.arange(len(points))
    first, last = np.zeros(len(points), bool), np.zeros(len(points), bool)
    first[offsets[:-1][length > 0]] = True
    last[offsets[1:][length > 0] - 1] = True
    before = np.where(first, 1, points[inner - 1]) if len(points) else points
    after = np.where(last, 2, points[(inner + 1) % max(1, len(points))]) if len(points) else points
    bins = (mixed((before << 42) | (points << 21) | after) >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64)
    letter = np.asarray(pc.utf8_is_alpha(pa.array(list(map(chr, np.unique(points).tolist())), pa.string())), dtype=bool) if len(points) else np.zeros(0, bool)
    is_letter = letter[np.searchsorted(np.unique(points), points)] if len(points) else letter
    script = SCRIPT_OF[np.searchsorted(STARTS, points, side="right")]
    letters = sums(is_letter.astype(np.int64), offsets)
    # A word's script is that of its first letter; words without letters have script "".
    at = np.where(is_letter, inner, len(points))
    lead = np.full(len(length), len(points))
    if len(points):
        lead[length > 0] = np.minimum.reduceat(at, offsets[:-1][length > 0])
    own = np.concatenate([script, [SCRIPT_NAMES.index("")]])[lead]
    code = np.asarray(pc.match_substring_regex(plain, r"\pN"), dtype=bool)
    return Words(bins, offsets, letters, own, code)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # trigram bin by language: log probability against the mean of all
    scripts: np.ndarray  # script by language: whether its words may be of that language
    known: np.ndarray  # whether a script was learned for any language
    fit: np.ndarray  # trigram bin by language: log probability against the mean of the language's own text

    def bound(self) -> float:
        """How far below its languages' own text a text that fits may stay: a share of what random trigrams stay below."""
        return FIT_SHARE * float(-self.fit.mean(axis=0).max(initial=-np.inf)) if self.languages else np.inf

    def word_scores(self, words: Words) -> np.ndarray:
        score = sums(self.table[words.bins], words.offsets)
        return np.where(self.scripts[words.script], score, score - 50.0) * (words.letters > 0)[:, None]

    def word_fits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """By word and language the log probability of the trigrams that count, and their number."""
        counts = (words.letters > 0) & ~words.code
        return sums(self.fit[words.bins].astype(np.float64), words.offsets) * counts[:, None], np.diff(words.offsets) * counts


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word: documents side by side, longest first, one position at a time."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, size = offsets[:-1][order], size[order]
    out = np.zeros(len(scores), np.int64)
    if not len(scores):
        return out
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # documents longer than a position
    best = scores[start[: active[0]]].astype(np.float64)
    lead = np.zeros(len(scores), np.int8)
    kept = np.zeros(scores.shape, bool)
    for t in range(1, longest):
        n = active[t]
        at = start[:n] + t
        old = best[:n]
        top = old.max(axis=1)
        kept[at] = old >= (top - switch)[:, None]
        lead[at] = old.argmax(axis=1)
        best[:n] = np.maximum(old, (top - switch)[:, None]) + scores[at]
    last = np.flatnonzero(size > 0)
    state = np.zeros(len(size), np.int64)
    state[last] = best[last].argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        out[at] = state[:n]
        if t:
            state[:n] = np.where(kept[at, state[:n]], state[:n], lead[at])
    return out


@dataclass
class Labelled:
    """Of documents: offsets of their words; by word a language, letters, whether its script was learned; by document the fit and the trigrams of its different words."""

    offsets: np.ndarray
    labels: np.ndarray
    letters: np.ndarray
    known: np.ndarray
    fit: np.ndarray
    trigrams: np.ndarray


def label_words(text: pa.Array, model: LanguageModel, switch: float) -> Labelled:
    offsets, codes, distinct = distinct_words(text)
    words = analyse(distinct)
    labels = viterbi(model.word_scores(words)[codes], offsets, switch)
    fits, weight = model.word_fits(words)
    fit = sums(fits[codes, labels], offsets) / np.maximum(1, sums(weight[codes], offsets))
    # A word said again is no further evidence.
    k = max(1, len(distinct))
    once = np.unique(np.repeat(np.arange(len(offsets) - 1) * k, np.diff(offsets)) + codes)
    trigrams = np.bincount(once // k, weight[once % k], len(offsets) - 1).astype(np.int64)
    return Labelled(offsets, labels, words.letters[codes], model.known[words.script][codes], fit, trigrams)


def model_of(languages: list[str], grams: np.ndarray, scripts: np.ndarray) -> LanguageModel:
    """The model of counts by language."""
    # Rare bins are smoothed towards all languages' share.
    every = grams.sum(axis=1, keepdims=True) + 0.5
    every /= every.sum()
    log = np.log((grams + 200 * every) / (grams.sum(axis=0, keepdims=True) + 200))
    allowed = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0, keepdims=True))
    known = allowed.any(axis=1)
    allowed[~known] = True  # a script never learned rules nothing out
    own = (log * grams).sum(axis=0) / np.maximum(1, grams.sum(axis=0))
    return LanguageModel(languages, (log - log.mean(axis=1, keepdims=True)).astype(np.float32), allowed, known, (log - own).astype(np.float32))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Counts trigrams by language over at most sample_docs training documents, chosen by a hash of their ids."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for part in slices(batch):
                langs = np.asarray(part.column(0).to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    _, codes, distinct = distinct_words(text_of(part.filter(pa.array(langs == lang))))
                    words = analyse(distinct)
                    times = np.bincount(codes, minlength=len(distinct))
                    for kind, at, n in ((0, words.bins, np.repeat(times, np.diff(words.offsets))), (1, words.script, times * words.letters)):
                        total = np.bincount(at, n) if len(at) else np.zeros(0)
                        for b in np.flatnonzero(total).tolist():
                            counts[lang, kind, b] = counts.get((lang, kind, b), 0) + int(total[b])
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[j] for k in keys], pa.int32()) for j in (1, 2)), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "kind", "bin", "n"])

    # Languages times bins bound what comes back.
    found = rows.mapInArrow(run, "lang string, kind int, bin int, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in found})
    at = {lang: i for i, lang in enumerate(languages)}
    grams, scripts = np.zeros((1 << TRIGRAM_BITS, max(1, len(languages)))), np.zeros((len(SCRIPT_NAMES), max(1, len(languages))))
    for r in found:
        (scripts if r["kind"] else grams)[r["bin"], at[r["lang"]]] = r["n"]
    return model_of(languages, grams, scripts)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", switch: float = SWITCH, lang: str = "lang_pred", score: str = "lang_score", fits: str = "lang_fits") -> DataFrame:
    """All rows and columns of docs with a language, a score and whether the text fits its languages.

    `und` with score 0 and no fit where the text is null or has no letter, or where no language was learned. Any other text
    has the learned language whose spans hold most letters of learned scripts, or of any where there are none of these; the score
    is those letters' share of all. A text doesn't fit if most letters are in words of scripts that were not learned, or
    if its trigrams, where there are enough to tell, are nearer to random ones than FIT_SHARE says.
    """
    schema = with_columns(docs, **{lang: "string", score: "double", fits: "boolean"})
    k, bound = max(1, len(model.languages)), model.bound()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text_col):
                got = label_words(text_of(rows, text_col), model, switch)
                cell = np.repeat(np.arange(rows.num_rows), np.diff(got.offsets)) * k + got.labels
                every = sums(got.letters, got.offsets)
                found = (every > 0) & bool(model.languages)
                known, total = (np.bincount(cell, w, rows.num_rows * k).reshape(rows.num_rows, k) for w in (got.letters * got.known, got.letters))
                best = np.where(known.any(axis=1), known.argmax(axis=1), total.argmax(axis=1))
                share = np.where(found, known.max(axis=1) / np.maximum(1, every), 0.0)
                good = found & (2 * known.sum(axis=1) >= every) & ((got.trigrams < LEAST_TRIGRAMS) | (-got.fit <= bound))
                names = [model.languages[b] if e else UNKNOWN for b, e in zip(best.tolist(), found.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(share), pa.array(good)], names=schema.names)

    return docs.mapInArrow(run, schema)


def spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(id, first_word, words, lang): the spans of one language, counted in words between white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                got = label_words(text_of(rows), model, switch)
                offsets, labels = got.offsets, got.labels
                row = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
                cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])])) if len(row) else row
                size = np.diff(np.concatenate([cut, [len(row)]]))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row[cut])), pa.array(cut - offsets[row[cut]], pa.int64()), pa.array(size, pa.int64()), pa.array([model.languages[i] for i in labels[cut]], pa.string())], names=[id_col, "first_word", "words", "lang"])

    source = docs.select(docs[id_col], docs[text_col].alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, first_word long, words long, lang string")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, switch: float = SWITCH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, fits) for every document; other columns, whatever their names, are left out.

    Null and empty texts and those without a letter are `und` with score 0; texts of any length are read whole, and of
    languages with equally many letters the first by name is taken. Repeated rows and ids come back as often as they
    come; rows with a null id are not held out and teach nothing. An empty table gives an empty one.
    """
    model = train(docs, sample_docs)
    found = predict(docs.select("doc_id", "text"), model, switch=switch)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_fits").alias("fits"))
