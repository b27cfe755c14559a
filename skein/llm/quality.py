"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn and fits a shallow tree on one feature's bins at a time, so that a
feature's trees add up to a lookup table over its bins; pairs of features that explain most of what is left get
two-dimensional tables in the same way. A score is a sum of table entries, gathered by bin for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, in_training, labelled_sample, slices, text_of, with_columns

THRESHOLD = 0.7
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 6000
BINS = 48
NAMES = (
    "log_words", "log_chars", "word_length", "upper_share", "lower_share", "digit_share", "space_share", "symbol_share", "bar_share", "bang_share", "stop_share",
    "distinct_share", "repeat_share", "newline_share", "top_word_share", "symbol_words", "upper_words", "non_ascii_share", "single_letters", "line_repeats",
)


def features(texts: list[str]) -> np.ndarray:
    """A row of shape and repetition measures for each text; an empty text gives zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        c = np.bincount(raw, minlength=256)
        n = len(raw)
        words = text.split()
        w = max(1, len(words))
        upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
        symbols = n - upper - lower - digit - c[128:].sum() - c[9:14].sum() - c[32] - c[44] - c[46]
        seen: dict[str, int] = {}
        repeats, before, symbol_words, upper_words, single = 0, None, 0, 0, 0
        for word in words:
            seen[word] = seen.get(word, 0) + 1
            repeats += word == before
            before = word
        for word, k in seen.items():
            symbol_words += k * (not word[-1].isalnum() and word[-1] not in ".,;:")
            upper_words += k * (len(word) > 2 and word.isupper())
            single += k * (len(word) == 1)
        lines = text.split("\n")
        out[i] = (
            np.log1p(len(words)), np.log1p(n), len(text) / w, upper / n, lower / n, digit / n, c[32] / n, symbols / n, c[124] / w, c[33] / w, c[46] / w,
            len(seen) / w, repeats / w, c[10] / w, max(seen.values(), default=0) / w, symbol_words / w, upper_words / w, c[128:].sum() / n, single / w, 1 - len(set(lines)) / len(lines),
        )
    return out


@dataclass
class AdditiveModel:
    """Bin edges by feature, tables by feature and by pair; scored by adding table entries."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for j, k, table in self.pairs:
            out += table[b[:, j], b[:, k]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _splits(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree with so many leaves over one ordered feature, grown on the best gain."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    bounds = [0, len(g)]
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(bounds) <= leaves:
        best = (1e-9, -1)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = value(a, m) + value(m, b) - value(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(m[k])))
        if best[1] < 0:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 15, pairs: int = 4, rate: float = 0.15, ridge: float = 2.0, leaves: int = 3, bins: int = BINS) -> AdditiveModel:
    """Cyclic boosting with logistic loss. Without rows of both classes the model is a constant."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = AdditiveModel(edges)
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    margin = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = slope()
                step = rate * _splits(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), leaves, ridge)
                table += step
                margin += step[b[:, j]]
    # Pairs by what a coarse table of both would take from the residual.
    g, h = slope()
    coarse = [b[:, j] * 6 // len(t) for j, t in enumerate(model.tables)]
    gain = {}
    for j, k in combinations([j for j, t in enumerate(model.tables) if len(t) > 1], 2):
        cell = coarse[j] * 6 + coarse[k]
        gain[j, k] = (np.bincount(cell, g, 36) ** 2 / (np.bincount(cell, h, 36) + ridge)).sum()
    for j, k in sorted(gain, key=lambda p: (-gain[p], p))[:pairs]:
        model.pairs.append((j, k, np.zeros((len(model.tables[j]), len(model.tables[k])))))
    for _ in range(pair_rounds):
        for j, k, table in model.pairs:
            g, h = slope()
            cell = b[:, j] * table.shape[1] + b[:, k]
            gs, hs = np.bincount(cell, g, table.size).reshape(table.shape), np.bincount(cell, h, table.size).reshape(table.shape)
            # A tree of depth two: the best cut of one feature, then one of the other on either side.
            cut = int(np.argmax((np.cumsum(gs.sum(1)) ** 2 / (np.cumsum(hs.sum(1)) + ridge))[:-1])) + 1
            step = np.vstack([np.tile(_splits(gs[s].sum(0), hs[s].sum(0), 2, ridge), (n, 1)) for s, n in ((slice(0, cut), cut), (slice(cut, None), table.shape[0] - cut))]) * rate
            table += step
            margin += step[b[:, j], b[:, k]]
    return model


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch):
            x = features(text_of(rows).to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), flat], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> AdditiveModel:
    """Fits the model on at most per_class training documents of each class, chosen by a hash of their ids."""
    sample = labelled_sample(docs, labels, "quality", per_class)
    rows = sample.select("y", "text").mapInArrow(_featurise, "y int, x array<double>").collect()
    # Rows come in no fixed order: sorted, the fit doesn't depend on it.
    rows = sorted((r["y"], r["x"]) for r in rows)
    x = np.asarray([r[1] for r in rows]).reshape(-1, len(NAMES))
    y = np.asarray([r[0] for r in rows], dtype=float)
    if not len(y):
        return fit_additive(x, y)
    # Classes count by their share of the training labels, whatever the sample's is.
    counts = {r["quality"]: r["count"] for r in labels.where(F.col("quality").isin(0, 1) & in_training(F.col("doc_id"))).groupBy("quality").count().collect()}
    model = fit_additive(x, y)
    p, q = counts.get(1, 0) + 0.5, counts.get(0, 0) + 0.5
    model.base += float(np.log(p / q) - np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    return model


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of docs with a score column between 0 and 1; null text counts as empty.

    A column of that name in docs is an error: pass another name.
    """
    schema = with_columns(docs, **{out: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text_col):
                values = model.score(features(text_of(rows, text_col).to_pylist()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(values, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; other columns, whatever their names, are left out.

    Null and empty texts have the same score, that of a text without words; texts of any length are scored whole.
    Repeated rows and ids come back as often as they come, rows with a null id are not held out and teach nothing.
    Without labels of both classes the score is their share, one half without any.
    """
    model = train(docs, labels, per_class)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
