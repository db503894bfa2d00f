"""Quality rules and a verdict: counts of each text, and calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, mix64, pieces, range_codes, released, utf8, word_codes, written
from .toxicity import fold

BUCKETS = 1 << 16  #: for the word n-grams, and as many for the character n-grams
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
CHARS = 3  #: the most characters of an n-gram
#: How much a share of a text's n-grams weighs as an input of the regression, whose penalty is on the weights.
SCALE = 128.0


def _keyed(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal codes of one document."""
    return mix64(code + mix64(doc.astype(np.uint64) + np.uint64(1)))


def _joined(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n codes in a row, one for each place where they begin."""
    out = np.zeros(max(0, len(code) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + code[k : k + len(out)]
    return mix64(out)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of COUNTS for each of the texts laid end to end.

    Words are runs of other than ASCII white space; word_chars their code points; n_symbols the characters of SYMBOLS; n_dup_lines the lines with
    a word that equal an earlier line; n_repeat_words the words of windows of WINDOW words that stand twice or more in the text."""
    n = len(offsets) - 1
    code, a, b, doc = word_codes(data, offsets, lower=False)
    size = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    white = np.isin(data, [32, 9, 10, 11, 12, 13])
    chars = size((data & 0xC0) != 0x80) - size(white)

    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    stops = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[np.searchsorted(offsets, starts, "right")]) if len(starts) else starts
    full = np.bincount(np.searchsorted(starts, a, "right") - 1, minlength=len(starts)) > 0 if len(starts) else np.zeros(0, bool)
    line_doc = np.searchsorted(offsets, starts[full], "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    once = np.unique(_keyed(range_codes(data, starts[full], stops[full]), line_doc), return_index=True)[1] if full.any() else np.zeros(0, np.int64)
    dup = lines - np.bincount(line_doc[once], minlength=n)

    repeats = np.zeros(n, np.int64)
    if len(code) >= WINDOW:
        inside = np.flatnonzero(doc[: len(code) - WINDOW + 1] == doc[WINDOW - 1 :])
        key = _keyed(_joined(code, WINDOW)[inside], doc[inside])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        step = np.zeros(len(code) + 1, np.int64)
        np.add.at(step, inside[twice], 1)
        np.add.at(step, inside[twice] + WINDOW, -1)
        repeats = np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=n)
    return np.stack([np.bincount(doc, minlength=n), chars, size(SYMBOLS[data]), dup, repeats], 1).astype(np.int64)


def grams(data: np.ndarray, offsets: np.ndarray):
    """(bucket, document) of the words and pairs of words, and of the one to three characters in a row, of each text."""
    code, _, _, doc = word_codes(data, offsets, lower=False)
    pairs = np.flatnonzero(doc[1:] == doc[:-1])
    words = np.concatenate([code, _joined(code, 2)[pairs]]) if len(code) else code
    word_doc = np.concatenate([doc, doc[pairs]])
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at = np.searchsorted(offsets, lead[:-1], "right") - 1
    first = [np.flatnonzero(at[: max(0, len(at) - k)] == at[k:]) for k in range(CHARS)]
    start, stop = np.concatenate(first), np.concatenate([f + k + 1 for k, f in enumerate(first)])
    bucket = lambda c: (c >> np.uint64(48)).astype(np.int64)
    return (bucket(words), word_doc), (bucket(range_codes(data, lead[start], lead[stop])) + BUCKETS, at[start])


@dataclass
class Model:
    weights: np.ndarray  #: of the word buckets, then of the character buckets
    intercept: float
    slope: float = 1.0  #: of the calibration
    shift: float = 0.0

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Intercept and the mean weight of a text's word and of its character n-grams; an empty text has the intercept alone."""
        n = len(offsets) - 1
        out = np.full(n, self.intercept)
        for bucket, doc in grams(data, offsets):
            out += SCALE * np.bincount(doc, self.weights[bucket], n) / np.maximum(np.bincount(doc, minlength=n), 1)
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def calibrated(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the sigmoid that makes margins probabilities: weighted maximum likelihood with softened targets, by Newton's steps.

    With one label only, or without rows, margins stay as they are. The slope is never negative."""
    many, few = (labels == 1).sum(), (labels == 0).sum()
    if not many or not few:
        return 1.0, 0.0
    target = np.where(labels == 1, (many + 1) / (many + 2), 1 / (few + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    w = weights / weights.mean()
    loss = lambda t: (w * (np.logaddexp(0, x @ t) - target * (x @ t))).sum() + ridge * ((t - [1, 0]) ** 2).sum()
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + 2 * ridge * np.eye(2), x.T @ (w * (q - target)) + 2 * ridge * (theta - [1, 0]))
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1e-6, float(theta[1]))


def _vectors(batches, batch_bytes: int):
    """(id, label, indices, values): the shares of each text's n-grams, by bucket, times SCALE."""
    for batch in pieces(batches, 2, batch_bytes):
        n, found = batch.num_rows, []
        for bucket, doc in grams(*utf8(batch.column(2))):
            key, count = np.unique(doc * (2 * BUCKETS) + bucket, return_counts=True)
            found.append((key, SCALE * count / np.bincount(doc, minlength=n)[key // (2 * BUCKETS)]))
        key, value = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(key)
        ends = pa.array(np.searchsorted(key[order], np.arange(n + 1) * (2 * BUCKETS)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((key[order] % (2 * BUCKETS)).astype(np.int32), value[order])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "label", "indices", "values"])


def _margins(batches, model: Model, batch_bytes: int):
    for batch in pieces(batches, 2, batch_bytes):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.margins(*utf8(batch.column(2))))], names=["id", "label", "margin"])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, label, text, weight): whole texts of at most `rows` ids of each label, the first by hash that have a text; of several rows of an id the shortest.

    An id with both labels counts as one without. weight: how many labelled ids each row stands for."""
    kind = dict(docs.dtypes)[id_col]
    marks = labels.select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).cast("double").alias("label")).filter("id is not null and label in (0, 1)")
    marks = marks.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    marks = marks.join(texts.select("id"), "id", "left_semi")
    folds = [marks.filter(F.col("label") == v) for v in (0.0, 1.0)]
    picked = [f.orderBy(F.xxhash64("id"), "id").limit(rows).withColumn("weight", F.lit(max(1, f.count()) / rows).cast("double")) for f in folds]
    chosen = picked[0].unionByName(picked[1]).withColumn("weight", F.greatest("weight", F.lit(1.0)))  # at most 2 * rows ids
    found = texts.join(F.broadcast(chosen), "id")
    return found.groupBy("id", "label", "weight").agg(F.min_by("text", F.struct(F.octet_length("text"), F.xxhash64("text"))).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 4_000, penalty: float = 1e-4, steps: int = 30, batch_bytes: int = 1 << 20) -> Model:
    """A model from at most `rows` labelled ids of each label (see labelled): three fifths by hash fit the weights, the rest the calibration.

    The regression is Spark's own, over sparse vectors in a table of the shared folder; the driver holds the weights and the calibration's
    margins, at most 2 * rows. Rows of the calibration weigh as many labelled ids as they stand for. With labels of one kind only, or none, all scores are one half."""
    sample = labelled(docs, labels, id_col, text_col, label_col, rows)
    sample = written(sample.withColumn("part", F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(5)).cast("int")), "ngram-sample")
    kind = dict(sample.dtypes)["id"]
    blank = Model(np.zeros(2 * BUCKETS), 0.0)
    train = sample.filter("part > 1")
    if train.select("label").distinct().count() < 2:
        drop_written(sample)
        return blank
    sparse = F.udf(lambda i, v: Vectors.sparse(2 * BUCKETS, i, v), VectorUDT())  # for the sample's rows alone
    rows_of = train.select("id", "label", "text").mapInArrow(lambda it: _vectors(it, batch_bytes), f"id {kind}, label double, indices array<int>, values array<double>")
    vectors = written(rows_of, "ngram-vectors")
    learner = LogisticRegression(maxIter=steps, regParam=penalty, standardization=False, tol=1e-7)
    learned = learner.fit(vectors.select("label", sparse("indices", "values").alias("features")))
    model = Model(learned.coefficients.toArray(), float(learned.intercept))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte
    rest = sample.filter("part <= 1")
    found = rest.select("id", "label", "text").mapInArrow(lambda it: _margins(it, held.value, batch_bytes), f"id {kind}, label double, margin double")
    found = found.join(rest.select("id", "weight"), "id").orderBy("id").collect()  # at most 2 * rows
    model.slope, model.shift = calibrated(np.array([r.margin for r in found]), np.array([r.label for r in found]), np.array([r.weight for r in found]))
    for table in (sample, vectors):
        drop_written(table)
    return model


def _rated(batches, model: Model, batch_bytes: int):
    for batch in pieces(released(batches), 1, batch_bytes):
        text = utf8(batch.column(1))
        counts = base_counts(*text)
        columns = [pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(model.scores(model.margins(*text)))], names=["id", *COUNTS, "score"])


def quality_rules(docs: DataFrame, labels: DataFrame, keep: float = 0.5, least_words: int = 20, most_repeats: int = 30, parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", batch_bytes: int = 1 << 20, **options) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, held_out) for every row of docs.

    base_failed: fewer than least_words words, or more than most_repeats of 100 words in repeated windows. Other texts are kept if their
    score, the calibrated probability of label 1, is at least `keep`. The model is fitted on the labels of other folds of crc32(id) % parts than `held`, so
    held_out rows measure it; options go to fit. A null text counts as empty; a null id is in no held-out fold. Rows are judged by
    themselves, so repeated rows get the same result. A null label is no label."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.filter(fold(id_col, parts) != held), id_col, text_col, label_col, **options))
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, score double"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _rated(it, model.value, batch_bytes), schema)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    out = out.select(F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") >= keep)).alias("kept"), "score")
    return out.withColumn("held_out", F.coalesce(fold(id_col, parts) == held, F.lit(False)))
