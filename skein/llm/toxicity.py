"""Toxic spans by a linear-chain conditional random field.

Only documents are labelled, so tokens are labelled first: a word of a toxic document is toxic if it occurs in
many more distinct contexts (neighbouring words) of toxic documents than of clean ones. The field is trained on
those tokens with features of a word and its prefixes, in windows of a few dozen tokens. Forward-backward
marginals give each token a probability of being toxic; a document's score is a logistic function of their sum
and maximum, fitted on training documents, and tokens of high marginal are the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import code_points, distinct_words, held_out, in_training, labelled_sample, mixed, offsets_of, saved, slices, sums, text_of, with_columns

THRESHOLD = 0.3
#: Labelled documents of each class, and windows of their tokens, that the model is fitted on, at most.
PER_CLASS = 4000
WINDOWS = 16_000
LENGTH = 32
BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡·"


def plain_words(distinct: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(distinct), TRIM)


def word_features(plain: pa.Array) -> np.ndarray:
    """Hashed features of words: the word itself, then its prefixes; a prefix as long as the word counts as none (0)."""
    points, offsets = code_points(plain)
    length = np.diff(offsets)
    position = np.arange(len(points)) - np.repeat(offsets[:-1], length)
    power = np.ones(int(length.max(initial=0)) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, len(power)):
            power[i] = power[i - 1] * np.uint64(0x9E3779B97F4A7C15)
        term = (points.astype(np.uint64) + np.uint64(1)) * power[position]
        out = np.empty((len(plain), 1 + len(PREFIXES)), np.int64)
        for j, k in enumerate((0, *PREFIXES)):
            h = sums(term if not k else np.where(position < k, term, np.uint64(0)), offsets)
            h = mixed(h + np.uint64(k) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
            # Bin 0 is for what isn't there.
            out[:, j] = np.where(length > k, np.maximum(1, h.astype(np.int64)), 0)
    return out


@dataclass
class Field:
    """A two-state chain: weight of each feature for the toxic state, and transition scores."""

    weights: np.ndarray
    transitions: np.ndarray
    bias: float
    document: np.ndarray  # logistic weights: constant, log(1 + expected tokens), highest marginal, log(1 + words)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1) + self.bias


def marginals(emission: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over windows side by side: P(toxic) by token, expected transitions, log-likelihood norm.

    emission and mask are windows by positions; the clean state scores 0. Padding follows the tokens.
    """
    n, steps = emission.shape
    t = np.exp(transitions)
    e = np.exp(np.clip(emission, -30, 30))
    forward, scale = np.empty((n, steps, 2)), np.ones((n, steps))
    for i in range(steps):
        if i == 0:
            a0, a1 = np.ones(n), e[:, 0].copy()
        else:
            p0, p1 = forward[:, i - 1, 0], forward[:, i - 1, 1]
            a0, a1 = p0 * t[0, 0] + p1 * t[1, 0], (p0 * t[0, 1] + p1 * t[1, 1]) * e[:, i]
            a0, a1 = np.where(mask[:, i], a0, p0), np.where(mask[:, i], a1, p1)
        total = a0 + a1
        forward[:, i, 0], forward[:, i, 1] = a0 / total, a1 / total
        scale[:, i] = total
    out = np.empty((n, steps))
    b0, b1 = np.ones(n), np.ones(n)
    pair = np.zeros((2, 2))
    for i in range(steps - 1, -1, -1):
        p1 = forward[:, i, 1] * b1
        p0 = forward[:, i, 0] * b0
        out[:, i] = p1 / (p0 + p1)
        if i:
            c1 = b1 * e[:, i]
            f0, f1 = forward[:, i - 1, 0], forward[:, i - 1, 1]
            cells = np.stack([f0 * t[0, 0] * b0, f0 * t[0, 1] * c1, f1 * t[1, 0] * b0, f1 * t[1, 1] * c1])
            pair += ((cells / cells.sum(axis=0)) * mask[:, i]).sum(axis=1).reshape(2, 2)
            n0, n1 = t[0, 0] * b0 + t[0, 1] * c1, t[1, 0] * b0 + t[1, 1] * c1
            total = n0 + n1
            b0, b1 = np.where(mask[:, i], n0 / total, b0), np.where(mask[:, i], n1 / total, b1)
    return out * mask, pair, float(np.log(scale)[mask].sum())


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of every token in windows of LENGTH positions that don't cross documents: window, position."""
    size = np.diff(offsets)
    count = -(-size // LENGTH)
    inside = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], size)
    base = np.repeat(np.cumsum(count) - count, size)
    return base + inside // LENGTH, inside % LENGTH


def token_marginals(emission: np.ndarray, offsets: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """P(toxic) of every token of documents given by offsets."""
    if not len(emission):
        return emission
    window, position = windows(offsets)
    grid = np.zeros((int(window[-1]) + 1, LENGTH))
    mask = np.zeros(grid.shape, bool)
    grid[window, position] = emission
    mask[window, position] = True
    out = np.empty(len(emission))
    for at in range(0, len(grid), 4096):
        p, _, _ = marginals(grid[at : at + 4096], mask[at : at + 4096], transitions)
        own = slice(*np.searchsorted(window, [at, at + 4096]))
        out[own] = p[window[own] - at, position[own]]
    return out


def document_features(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    top = np.zeros(len(size))
    if len(p):
        top[size > 0] = np.maximum.reduceat(p, offsets[:-1][size > 0])
    return np.stack([np.ones(len(size)), np.log1p(sums(p, offsets)), top, np.log1p(size)], axis=1)


def score_texts(text: pa.Array, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document scores, offsets of the documents' words, and P(toxic) of each word."""
    offsets, codes, distinct = distinct_words(text)
    emission = field.emissions(word_features(plain_words(distinct)))[codes]
    p = token_marginals(emission, offsets, field.transitions)
    z = document_features(p, offsets) @ field.document
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), offsets, p


def fit_field(words: pa.ListArray, y: np.ndarray, epochs: int = 40, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Gradient ascent (AdaGrad) on the likelihood of windows of at most LENGTH words; y tags each word with 0 or 1."""
    field = Field(np.zeros(1 << BITS), np.zeros((2, 2)), -3.0, np.asarray([-4.0, 4.0, 2.0, 0.0]))
    if not y.any():
        return field
    offsets = offsets_of(words)
    size = np.diff(offsets)
    coded = words.flatten().dictionary_encode()
    per_word = word_features(coded.dictionary)
    codes = np.asarray(coded.indices, dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(y)) - offsets[row]
    mask = np.zeros((len(size), LENGTH), bool)
    mask[row, column] = True
    next_in = np.flatnonzero(column[1:] > 0) if len(y) > 1 else np.zeros(0, int)
    seen = np.bincount(y[next_in] * 2 + y[next_in + 1], minlength=4).reshape(2, 2).astype(float)
    weights, past = field.weights, np.zeros(1 << BITS)
    past_t, past_b = np.zeros((2, 2)), 0.0
    for _ in range(epochs):
        emission = field.emissions(per_word)[codes]
        grid = np.zeros(mask.shape)
        grid[row, column] = emission
        p, pair, _ = marginals(grid, mask, field.transitions)
        error = y - p[row, column]
        by_word = np.bincount(codes, error, len(per_word))
        g = np.zeros(1 << BITS)
        for j in range(per_word.shape[1]):
            g += np.bincount(per_word[:, j], by_word, 1 << BITS)
        g -= ridge * len(y) / 100 * weights
        g[0] = 0
        past += g * g
        weights += rate * g / np.sqrt(past + 1e-6)
        gt, gb = seen - pair - ridge * len(y) * field.transitions, error.sum()
        past_t += gt * gt
        past_b += gb * gb
        field.transitions = field.transitions + rate * gt / np.sqrt(past_t + 1e-6)
        field.bias += rate * gb / np.sqrt(past_b + 1e-6)
    return field


def fit_document(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return start
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - 0.01 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    """Fits the field on at most per_class training documents of each class."""
    sample = labelled_sample(docs, labels, "toxic", per_class)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, most=2 << 20):
                offsets, codes, distinct = distinct_words(text_of(rows))
                words = plain_words(distinct).take(pa.array(codes))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], names=["doc_id", "y", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    split_docs = saved(sample.select("doc_id", "y", "text").mapInArrow(split, f"doc_id {kind}, y int, words array<string>"), "toxic-sample")

    # Copies of a document repeat its contexts, so distinct contexts count it once.
    side = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.xxhash64(side(i - 1), side(i + 1)).alias("context")))
    near = split_docs.select("y", F.explode(placed).alias("at")).select("y", "at.word", "at.context").where("word <> ''").distinct()
    counts = near.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean"))
    total = {r["y"]: r["n"] for r in split_docs.groupBy("y").agg(F.sum(F.size("words")).alias("n")).collect()}
    ratio = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * ((total.get(0) or 1) / (total.get(1) or 1))
    # Words of a bounded number of documents.
    seeds = saved(counts.where((F.col("toxic") >= 4) & (ratio >= 6)).select("word"), "toxic-words")
    lexicon = sorted(r["word"] for r in seeds.collect())

    # Windows of toxic documents with a seed, and others for contrast.
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / LENGTH)), lambda k: F.slice("words", k.cast("int") * LENGTH + 1, LENGTH))
    pieces = split_docs.where(F.size("words") > 0).select("doc_id", "y", F.posexplode(cut).alias("k", "words"))
    known = pieces.select("doc_id", "k", F.explode("words").alias("word")).join(F.broadcast(seeds), "word", "left_semi").select("doc_id", "k", F.lit(True).alias("seeded")).distinct()
    pieces = saved(pieces.join(known, ["doc_id", "k"], "left").withColumn("seeded", F.coalesce("seeded", F.lit(False))), "toxic-windows")
    # As many with a seed in toxic documents as others, among these those of clean documents with a seed first.
    order = [F.xxhash64("doc_id", "k"), F.col("doc_id"), F.col("k")]
    hit = (F.col("y") == 1) & F.col("seeded")
    chosen = pieces.where(hit).orderBy(*order).limit(WINDOWS // 2).unionByName(
        pieces.where(~hit).orderBy(F.desc(F.col("seeded") & (F.xxhash64("k", "doc_id") % 2 == 0)), *order).limit(WINDOWS // 2)
    )
    table = chosen.select("y", F.array_join("words", " ").alias("text")).toArrow().sort_by([("y", "ascending"), ("text", "ascending")]).combine_chunks()
    text = table["text"].chunk(0) if table.num_rows else pa.array([], pa.string())
    lists = pc.split_pattern(text, " ")
    toxic = np.repeat(np.asarray(table["y"]), np.diff(offsets_of(lists)))
    tagged = np.asarray(pc.is_in(lists.flatten(), value_set=pa.array(lexicon, pa.string()))).astype(np.int64) * toxic
    field = fit_field(lists, tagged)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                offsets, codes, distinct = distinct_words(text_of(part))
                p = token_marginals(field.emissions(word_features(plain_words(distinct)))[codes], offsets, field.transitions)
                x = document_features(p, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["y", "x"])

    found = sorted((r["y"], r["x"]) for r in split_docs.select("y", F.array_join("words", " ").alias("text")).mapInArrow(measure, "y int, x array<double>").collect())
    y = np.asarray([r[0] for r in found], dtype=float)
    x = np.asarray([r[1] for r in found]).reshape(-1, 4)
    share = {r["toxic"]: r["count"] for r in labels.where(F.col("toxic").isin(0, 1) & in_training(F.col("doc_id"))).groupBy("toxic").count().collect()}
    weight = np.where(y == 1, share.get(1, 0) / max(1, y.sum()), share.get(0, 0) / max(1, len(y) - y.sum())) if len(y) else y
    field.document = fit_document(x, y, weight / max(1e-9, weight.mean()) if len(y) else weight, field.document)
    return field


def score(docs: DataFrame, field: Field, text_col: str = "text", out: str = "score", tokens: str = "toxic_tokens") -> DataFrame:
    """All rows and columns of docs with a score and the number of words of marginal over one half."""
    schema = with_columns(docs, **{out: "double", tokens: "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text_col):
                values, offsets, p = score_texts(text_of(rows, text_col), field)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(values), pa.array(sums((p > 0.5).astype(np.int64), offsets), pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, start, end, span, probability): toxic words with their offsets in the text, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            for rows in slices(batch):
                texts = text_of(rows)
                _, offsets, p = score_texts(texts, field)
                out = []
                for row, text in enumerate(texts.to_pylist()):
                    own = p[offsets[row] : offsets[row + 1]]
                    if (own >= least).any():
                        places = [m.span() for m in re.finditer(r"\S+", text)]
                        lead = len(own) - len(places) if text[:1].isspace() else 0  # an empty word before leading space
                        lead = 1 if lead > 0 else 0
                        for i in np.flatnonzero(own >= least).tolist():
                            if 0 <= i - lead < len(places):
                                a, b = places[i - lead]
                                out.append((row, a, b, text[a:b], float(own[i])))
                keys = rows.column(0).take(pa.array([o[0] for o in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([o[j] for o in out], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.float64())))], names=[id_col, "start", "end", "span", "probability"])

    source = docs.select(docs[id_col], docs[text_col].alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, end long, span string, probability double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; other columns are left out.

    Null and empty texts score like a document without words; texts of any length are scored whole. Repeated rows and
    ids come back as often as they come, rows with a null id are not held out and teach nothing. Without labels of both
    classes the score is that of an unfitted field.
    """
    field = train(docs, labels, per_class)
    scored = score(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
