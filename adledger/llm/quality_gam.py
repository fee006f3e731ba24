"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of surface features (lengths, shares of character classes, repeated
words and lines); ids, languages, sources and labels are never among them. Features are cut
into quantile bins. Boosting goes round the features in turn and fits one shallow tree to
the current gradients each time, with a small step; the trees of a feature add up to one
lookup table. Then the pairs of features that explain most of what is left get tables of
their own in the same way. A score is the sum of one entry per table, so scoring is
vectorised additions by bin.

Null and empty texts have all features zero and are scored like any other row. Labels of
null ids and null labels are left out; several labels of one id count as their rounded mean.
Without labels of both kinds the model is the constant share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import sieve_split, staged

FEATURES = ("log_chars", "log_words", "word_length", "digits", "upper", "punctuation", "symbols", "bars", "marks",
            "other_bytes", "line_words", "sentence_words", "distinct_words", "repeated_lines", "title_words",
            "frequent_byte", "echoes")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


CLASSES = np.stack([_class("0123456789"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(".,;:'\"()-"),
                    _class("#$%&*+<=>@\\^_`{}[]~/"), _class("|"), _class("!?"), (np.arange(256) >= 128).astype(float)], axis=1)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of features per text, over the whole text."""
    counts = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 6))
    for i, t in enumerate(texts):
        if not t:
            continue
        data = np.frombuffer(t.encode(), np.uint8)
        counts[i] = np.bincount(data, minlength=256)
        words = t.split()
        lines = t.split("\n")
        rest[i] = (len(words), len(set(words)), len(lines), len(set(lines)), sum(map(str.istitle, set(words))),
                   sum(map(eq, words, words[1:])))
    size = counts.sum(axis=1)
    n = np.maximum(rest[:, 0], 1)
    share = counts @ CLASSES / np.maximum(size, 1)[:, None]
    visible = size - counts[:, [9, 10, 13, 32]].sum(axis=1)
    ends = counts[:, [33, 46, 63]].sum(axis=1)
    sharpest = counts[:, 33:].max(axis=1) / np.maximum(visible, 1)
    out = np.column_stack([
        np.log1p(size), np.log1p(rest[:, 0]), visible / n, share, rest[:, 0] / np.maximum(rest[:, 2], 1),
        rest[:, 0] / (ends + 1), rest[:, 1] / n, 1 - rest[:, 3] / np.maximum(rest[:, 2], 1),
        rest[:, 4] / np.maximum(rest[:, 1], 1), sharpest, rest[:, 5] / n])
    out[size == 0] = 0
    return out


@dataclass
class Model:
    """base + sum of tables[j][bin of feature j] + sum of pair tables."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"),
                           np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _leaf(g, h):
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int, least: float) -> int | None:
    """The best cut of bins lo..hi-1 in two, by gain."""
    left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
    gain = left_g ** 2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1)
    gain[(left_h < least) | (all_h - left_h < least)] = -1
    if not len(gain) or gain.max() <= all_g ** 2 / (all_h + 1):
        return None
    return lo + 1 + int(gain.argmax())


def _tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """A tree of two levels over the bins of one feature, as values by bin."""
    edges = {0, len(g)}
    if (first := _split(g, h, 0, len(g), least)) is not None:
        edges.add(first)
        for lo, hi in ((0, first), (first, len(g))):
            if (cut := _split(g, h, lo, hi, least)) is not None:
                edges.add(cut)
    out = np.zeros(len(g))
    if len(edges) > 2:
        at = sorted(edges)
        for lo, hi in zip(at, at[1:]):
            out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each of two features, as a table, and its gain."""
    cum = lambda m: np.cumsum(np.cumsum(m, 0), 1)
    cg, ch = cum(g), cum(h)
    a = [(cg[:-1, :-1], ch[:-1, :-1])]
    a.append((cg[:-1, -1:] - cg[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1]))
    a.append((cg[-1:, :-1] - cg[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]))
    a.append((cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + cg[:-1, :-1], ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + ch[:-1, :-1]))
    gain = sum(x ** 2 / (y + 1) for x, y in a) if min(g.shape) > 1 else np.zeros((0, 0))
    out = np.zeros(g.shape)
    if not gain.size:
        return out, 0.0
    gain = np.where(np.minimum.reduce([y for _, y in a]) >= least, gain, -1)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    if gain[i, j] <= 0:
        return out, 0.0
    values = [_leaf(x[i, j], y[i, j]) for x, y in a]
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = values
    return out, float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + 1))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 12, rounds: int = 250, pair_rounds: int = 120,
        most_pairs: int = 6, step: float = 0.1, least: float = 2.0) -> Model:
    """Cyclic boosting on rows x with labels y in {0, 1}."""
    if len(y) == 0:
        return Model(0.0)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, j], bins) for j in range(x.shape[1])]
    model.coarse = [_cuts(x[:, j], coarse_bins) for j in range(x.shape[1])]
    fine = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    margin = np.full(len(y), model.base)

    def gradients():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(fine):
            g, h = gradients()
            n = len(model.tables[j])
            tree = step * _tree(np.bincount(b, g, n), np.bincount(b, h, n), least)
            model.tables[j] += tree
            margin += tree[b]

    def grid(a, b, v):
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(rough[a] * shape[1] + rough[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = gradients()
    ranked = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h), least)[1], a, b) for a, b in combinations(range(x.shape[1]), 2)))
    model.pairs = [(a, b) for gain, a, b in ranked[:most_pairs] if gain < 0]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, h = gradients()
            tree = step * _quadrants(grid(a, b, g), grid(a, b, h), least)[0]
            model.pair_tables[k] += tree
            margin += tree[rough[a], rough[b]]
    return model


def held_out(id_: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is 0 modulo folds; a null id is not."""
    return F.coalesce(F.crc32(id_.cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", folds: int = 5, sample: int = 16_000) -> Model:
    """Fits on the labelled rows outside the held-out fold, `sample` of them at most.

    The sample is the rows with the smallest hashes of their ids; only their texts are
    shuffled, and their features (not texts) are brought together for the fit.
    """
    marked = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col), folds))
              .groupBy(id_col).agg(F.avg(label_col).alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
              .select(F.col(id_col), (F.col("y") >= 0.5).cast("double").alias("y")))
    marked = staged(marked, "labels")
    near, _ = sieve_split(docs.select(id_col, text_col), marked.select(id_col), id_col)

    @F.pandas_udf("array<double>")
    def row(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(texts.tolist())), index=texts.index)

    got = (near.join(marked, id_col).dropDuplicates([id_col]).select(row(text_col).alias("x"), "y", id_col)
           .toPandas().sort_values(id_col))
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score(text: Column, model: Model) -> Column:
    """The model's score of a text column, 0 to 1."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(texts.tolist())), index=texts.index)

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """id, held_out, score, predicted per row of docs."""
    model = train(docs, labels, id_col, text_col, folds=folds, **options)
    return (docs.select(F.col(id_col), held_out(F.col(id_col), folds).alias("held_out"),
                        score(F.col(text_col), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs with a score of at least threshold, all columns as they are."""
    model = train(docs, labels, id_col, text_col, **options)
    return docs.where(score(F.col(text_col), model) >= threshold)
