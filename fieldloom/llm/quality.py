"""Quality by a generalised additive model with pairwise interactions: boosted shallow trees as lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8, word_codes
from .toxicity import fold

FEATURES = ["log_bytes", "log_words", "word_bytes", "capitals", "digits", "symbols", "bars", "exclamations", "stops", "commas", "feeds", "other_letters", "repeated_next", "repeated_second", "distinct_words", "long_words"]
BINS, PAIR_BINS = 32, 8


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


CAPITALS, DIGITS, SYMBOLS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("#$%&*@^~<>{}[]\\/=+_")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; shares are 0 for an empty text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    code, a, b, doc = word_codes(data, offsets, lower=False)
    words = np.bincount(doc, minlength=n)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)

    def share(mask):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]) * per_byte

    def same(k):
        hit = (code[k:] == code[:-k]) & (doc[k:] == doc[:-k]) if len(code) > k else np.zeros(0, bool)
        return np.bincount(doc[k:][hit], minlength=n) * per_word

    order = np.argsort(doc.astype(np.uint64) << np.uint64(40) | code >> np.uint64(24), kind="stable") if len(code) else np.zeros(0, np.int64)
    key = code[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n) * per_word
    columns = [
        np.log1p(size), np.log1p(words), np.bincount(doc, b - a, n) * per_word, share(CAPITALS[data]), share(DIGITS[data]), share(SYMBOLS[data]),
        share(data == 124), share(data == 33), share(data == 46), share(data == 44), share(data == 10), share(data >= 0xC0),
        same(1), same(2), distinct * np.sqrt(np.log1p(words) + 1), np.bincount(doc, b - a > 14, n) * per_word,
    ]
    return np.stack(columns, 1).astype(np.float64)


@dataclass
class Model:
    cuts: list[np.ndarray]  #: ascending borders of each feature's bins
    base: float
    single: np.ndarray  #: feature x bin
    pairs: list[tuple[int, int]]
    double: np.ndarray  #: pair x bin x bin, of the coarse bins

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Additions of table entries: one for each feature, one for each pair."""
        k = self.bins(x)
        total = self.base + self.single[np.arange(len(self.cuts)), k].sum(1)
        for t, (i, j) in enumerate(self.pairs):
            total += self.double[t, k[:, i] * PAIR_BINS // BINS, k[:, j] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The leaf value of each bin: a tree of that depth over ordered bins with gradient and curvature sums g and h."""
    value = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    if gain[at] <= 1e-9:
        return value
    return np.concatenate([_tree(g[: at + 1], h[: at + 1], depth - 1, ridge), _tree(g[at + 1 :], h[at + 1 :], depth - 1, ridge)])


def fit_tables(x: np.ndarray, y: np.ndarray, rounds: int = 80, pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.15, ridge: float = 2.0) -> Model:
    """Boosting in cycles: each feature in turn gets one shallow tree on the current residuals; then, with these tables
    held, the pairs with the largest gain get trees of one split in each direction, again in turn."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(cuts, float(np.log(p / (1 - p))), np.zeros((x.shape[1], BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    k = model.bins(x)
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for f in range(x.shape[1]):
            q = 1 / (1 + np.exp(-total))
            add = rate * _tree(np.bincount(k[:, f], y - q, BINS), np.bincount(k[:, f], q * (1 - q), BINS), 2, ridge)
            model.single[f] += add
            total += add[k[:, f]]
    coarse = k * PAIR_BINS // BINS

    def corner(i, j):
        """(gain, table) of the best tree of one split in each direction."""
        q = 1 / (1 + np.exp(-total))
        cell = coarse[:, i] * PAIR_BINS + coarse[:, j]
        g, h = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (y - q, q * (1 - q)))
        best = (0.0, np.zeros((PAIR_BINS, PAIR_BINS)))
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        for a in range(PAIR_BINS - 1):
            for b in range(PAIR_BINS - 1):
                gs, hs = [np.array([c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b]]) for c in (cg, ch)]
                leaf = gs / (hs + ridge)
                if (gain := float((gs * leaf).sum())) > best[0]:
                    t = np.empty((PAIR_BINS, PAIR_BINS))
                    t[: a + 1, : b + 1], t[: a + 1, b + 1 :], t[a + 1 :, : b + 1], t[a + 1 :, b + 1 :] = leaf
                    best = (gain, t)
        return best

    ranked = sorted(((corner(i, j)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j) for _, i, j in ranked]
    model.double = np.zeros((len(ranked), PAIR_BINS, PAIR_BINS))
    for _ in range(pair_rounds):
        for t, (i, j) in enumerate(model.pairs):
            _, table = corner(i, j)
            model.double[t] += rate * table
            total += rate * table[coarse[:, i], coarse[:, j]]
    return model


def _features(batches, batch_bytes: int):
    for batch in pieces(batches, 2, batch_bytes):
        x = features(*utf8(batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 10_000, batch_bytes: int = 3 << 20) -> Model:
    """A model from at most `rows` labelled documents of each label, the first by hash of their id; one row for each id, of several the one with the least features."""
    folds = [labels.filter(F.col(label_col) == v).select(F.col(id_col).alias("sample_id"), F.col(label_col).cast("double").alias("label")).distinct().orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows) for v in (0, 1)]
    picked = folds[0].unionByName(folds[1])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))  # names of its own, whatever else docs has
    texts = texts.join(F.broadcast(picked), F.col("id") == F.col("sample_id")).select("id", "label", "text")
    found = texts.mapInArrow(lambda it: _features(it, batch_bytes), f"id {dict(docs.dtypes)[id_col]}, label double, x array<double>")
    found = found.groupBy("id", "label").agg(F.min("x").alias("x")).orderBy("label", "x").collect()  # at most 2 * rows
    y = np.array([r.label for r in found])
    if len(set(y)) < 2:
        return Model([np.zeros(0)] * len(FEATURES), float(y.mean() * 4 - 2) if len(y) else 0.0, np.zeros((len(FEATURES), BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    return fit_tables(np.array([r.x for r in found]), y)


def _score(batches, model: Model, batch_bytes: int):
    for batch in pieces(batches, 1, batch_bytes):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(*utf8(batch.column(1)))))], names=["id", "score"])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 4, held: int = 2, threshold: float = 0.7, batch_bytes: int = 3 << 20) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs, fitted on the labels of the other folds of crc32(id) % parts.

    A null text counts as empty, and an empty text is scored like others. A null label is no label; a null id is in no held-out
    fold. With labels of one kind only, every score is the same."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.filter(fold(id_col, parts) != held), id_col, text_col, label_col))  # a few tables of fixed size
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _score(it, model.value, batch_bytes), f"id {kind}, score double")
    out = out.withColumnRenamed("id", id_col)
    held_out = F.coalesce(fold(id_col, parts) == held, F.lit(False))
    return out.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
