"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LETTERS, READ, SPACE, drop_written, inverse_powers, mix64, pieces, powers, released, utf8, written

PREFIXES = (4, 5)  #: lengths in bytes of the word beginnings that are features besides whole words
GAP = 512  #: after so many neutral words the chain has forgotten its state to double precision
SCHEMA = "score double, spans array<struct<start:bigint,end:bigint,marginal:double>>"


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(codes of every word: whole word and beginnings, 0 where too short; start; end; document)."""
    data = READ[data]
    n = len(data)
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers(n), out=total[1:])
    down = inverse_powers(max(n, 1))[a]
    codes = [mix64((total[b] - total[a]) * down + (b - a).astype(np.uint64))]
    for k in PREFIXES:
        code = mix64((total[np.minimum(a + k, n)] - total[a]) * down + np.uint64(1000 + k))
        codes.append(np.where(b - a >= k, code, np.uint64(0)))
    return codes, a, b, np.searchsorted(offsets, a, "right") - 1


@dataclass
class Model:
    vocabulary: np.ndarray  #: codes of the features, ascending
    weights: np.ndarray
    bias: float
    moves: np.ndarray  #: 2 x 2, the scores of going from one state to the next
    link: np.ndarray  #: intercept and slopes of the document score

    def __post_init__(self):
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        step = np.exp(self.moves) * np.array([1.0, np.exp(self.bias)])
        out = [np.eye(2)]
        for _ in range(GAP):
            new = out[-1] @ step
            out.append(new / new.sum())
        self.gaps = np.array(out)

    def emissions(self, codes) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words with a feature, the sum of their weights)."""
        low = np.uint64((1 << 20) - 1)
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0)
        hit = np.zeros(len(codes[0]), bool)
        score = np.zeros(len(codes[0]))
        for code in codes:
            maybe = np.flatnonzero(self.hint[(code & low).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, code[maybe]), len(self.vocabulary) - 1)
            sure = self.vocabulary[at] == code[maybe]
            hit[maybe[sure]] = True
            score[maybe[sure]] += self.weights[at[sure]]
        at = np.flatnonzero(hit)
        return at, score[at]

    def marginals(self, at: np.ndarray, score: np.ndarray, doc: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The probability of the toxic state at each word with a feature, by forward-backward over whole documents.

        The words between two such words are alike, so their steps are a power of one matrix. Documents run side
        by side, one word with a feature after another."""
        out = np.zeros(len(at))
        if not len(at):
            return out
        d, place = doc[at], at - first[doc[at]]
        start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        count = np.diff(np.concatenate([start, [len(at)]]))
        rank = np.arange(len(at)) - np.repeat(start, count)
        before = np.where(rank == 0, place, place - np.concatenate([[0], place[:-1]]) - 1)
        tail = length[d] - place - 1
        potential = np.stack([np.ones(len(at)), np.exp(np.clip(score + self.bias, -50, 50))], 1)
        move = np.exp(self.moves)
        forward, backward = np.zeros((len(at), 2)), np.zeros((len(at), 2))
        order = np.argsort(-count, kind="stable")
        start, count = start[order], count[order]
        state = np.tile([1.0, 0.0], (len(start), 1))
        for k in range(int(count[0])):
            live = int(np.searchsorted(-count, -k, "left"))
            i = start[:live] + k
            state = np.einsum("ij,ijk->ik", state[:live], self.gaps[np.minimum(before[i], GAP)]) @ move * potential[i]
            state /= state.sum(1, keepdims=True)
            forward[i] = state
        for k in range(int(count[0]) - 1, -1, -1):
            live = int(np.searchsorted(-count, -k, "left"))
            i = start[:live] + k
            last = count[:live] == k + 1
            new = np.ones((live, 2))
            j = np.where(last, i, i + 1).clip(max=len(at) - 1)
            inner = np.einsum("ijk,ik->ij", self.gaps[np.minimum(before[j], GAP)], (potential[j] * backward[j]) @ move.T)
            end = self.gaps[np.minimum(tail[i], GAP)].sum(2)
            new = np.where(last[:, None], end, inner)
            backward[i] = new / new.sum(1, keepdims=True)
        joint = forward * backward
        return joint[:, 1] / joint.sum(1)

    def documents(self, data: np.ndarray, offsets: np.ndarray):
        """(score of each document, places in it of tagged words: document, start and end in bytes, marginal)."""
        codes, a, b, doc = tokens(data, offsets) if len(data) else ([np.zeros(0, np.uint64)], *[np.zeros(0, np.int64)] * 3)
        n = len(offsets) - 1
        length = np.bincount(doc, minlength=n)
        at, score = self.emissions(codes)
        m = self.marginals(at, score, doc, np.cumsum(length) - length, length)
        x = document_features(m, doc[at], n)
        tagged = m >= 0.5
        return x, (doc[at][tagged], a[at][tagged], b[at][tagged], m[tagged])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.link[0] + x @ self.link[1:], -30, 30)))


def document_features(m: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The largest log-odds of a marginal in each document (-6 to 6), and the logarithm of 1 + the sum of the marginals."""
    top = np.full(n, -6.0)
    np.maximum.at(top, doc, np.clip(np.log(np.maximum(m, 1e-9)) - np.log(np.maximum(1 - m, 1e-9)), -6, 6))
    return np.stack([top, np.log1p(np.bincount(doc, m, n))], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    x1 = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x1.T @ (y - p) - ridge * w)
    return w


def features_of(codes, vocabulary: np.ndarray) -> list[np.ndarray]:
    """The place of each code in the vocabulary, or the vocabulary's length."""
    places = [np.searchsorted(vocabulary, c).clip(max=len(vocabulary) - 1) for c in codes]
    return [np.where(vocabulary[k] == c, k, len(vocabulary)).astype(np.int32) for k, c in zip(places, codes)]


def forward_backward(potential: np.ndarray, move: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, sums of the pairwise marginals, log of the normaliser) of chains side by side that start in state 0.

    potential: chain x place x state; move: state x state; live: places that the chain has, from its first on."""
    s, width, _ = potential.shape
    f, b, log_z = np.empty((s, width, 2)), np.ones((s, width, 2)), np.zeros(s)
    for t in range(width):
        f[:, t] = (move[0] if t == 0 else f[:, t - 1] @ move) * potential[:, t]
        total = f[:, t].sum(1, keepdims=True)
        f[:, t] /= total
        log_z += np.where(live[:, t], np.log(total[:, 0]), 0)
    for t in range(width - 2, -1, -1):
        new = (potential[:, t + 1] * b[:, t + 1]) @ move.T
        b[:, t] = np.where(live[:, t + 1, None], new / new.sum(1, keepdims=True), 1)
    joint = f * b
    marginal = joint[..., 1] / joint.sum(2) * live
    pair = f[:, :-1, :, None] * move[None, None] * (potential * b)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return marginal, (pair * live[:, 1:, None, None]).sum((0, 1)), log_z


def stretches(doc: np.ndarray, width: int):
    """Stretches of at most `width` words, none across the end of a document: (first word of each, its number of words)."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    start = np.flatnonzero(place % width == 0)
    return start, np.diff(np.append(start, len(doc)))


def gradient(k: np.ndarray, y: np.ndarray, live: np.ndarray, weights: np.ndarray, bias: float, moves: np.ndarray):
    """(gradient by weight, by bias, by moves, log-likelihood) of labelled stretches.

    k: places in the vocabulary, its length for no feature; weights has a 0 there. y: labels."""
    pot = np.exp(np.clip(weights[k].sum(2) + bias, -30, 30)) * live
    pot = np.stack([np.ones_like(pot), pot], 2)
    m, pair, log_z = forward_backward(pot, np.exp(moves), live)
    miss = (y - m) * live
    both = np.concatenate([np.zeros((len(y), 1), np.int64), y], 1)
    seen = np.zeros((2, 2))
    np.add.at(seen, (both[:, :-1][live], both[:, 1:][live]), 1)
    first = np.array([[(live[:, 0] - m[:, 0]).sum(), m[:, 0].sum()], [0, 0]])
    by_weight = np.bincount(k.ravel(), np.repeat(miss.ravel(), k.shape[2]), len(weights))
    path = (np.log(np.maximum(pot[..., 1], 1e-300)) * y * live).sum() + (seen * moves).sum()
    return by_weight, miss.sum(), seen - pair - first, float(path - log_z.sum())


def within_budget(rows: list[tuple], most_bytes: int) -> list[tuple]:
    """Of rows (h, size, label, ...) those to read, in the order of h: each label has half of the bytes, and what the other leaves of its half.

    A text that doesn't fit is skipped, and one of more than a sixteenth of its label's bytes is taken after the others."""
    out, left = [], most_bytes
    kinds = sorted({r[2] for r in rows}, key=lambda y: (sum(r[1] for r in rows if r[2] == y), y))
    for k, label in enumerate(kinds):
        quota = left // (len(kinds) - k)
        room = quota
        for r in sorted((r for r in rows if r[2] == label), key=lambda r: (r[1] > quota // 16, *r)):
            if r[1] <= room:
                out.append(r)
                room -= r[1]
        left -= quota - room
    return sorted(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: dict[int, int], most_bytes: int) -> DataFrame:
    """(text, label) of labelled documents: the first so many of each label by hash, one row for each id (of several the shortest), whole, as far as the bytes go.

    The rows are chosen by id and size, before a text is read; the texts themselves never pass through the driver. Where the
    texts of a label are all too large, the shortest of them stands for it by its beginning, most_bytes / 8 code points."""
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).filter("text is not null")
    mark = F.xxhash64("text").alias("mark")

    def first(labels):
        folds = [labels.filter(F.col("sample_label") == value).distinct().orderBy(F.xxhash64("sample_id"), "sample_id").limit(n) for value, n in rows.items()]
        picked = folds[0]
        for f in folds[1:]:
            picked = picked.unionByName(f)
        found = texts.join(F.broadcast(picked), "sample_id").select("sample_id", "sample_label", F.octet_length("text").alias("size"), mark)
        found = found.groupBy("sample_id", "sample_label").agg(F.min(F.struct("size", "mark")).alias("least"))  # at most sum(rows) ids
        return [tuple(r) for r in found.select(F.xxhash64("sample_id"), "least.size", "sample_label", "sample_id", "least.mark").collect()]

    labels = labels.select(F.col(id_col).cast(kind).alias("sample_id"), F.col(label_col).cast("int").alias("sample_label"))
    found = first(labels)
    if {r[2] for r in found} != set(rows):  # the first labels may be of ids without a text
        found = first(labels.join(texts.select("sample_id"), "sample_id", "left_semi"))
    chosen = [(r[3], r[4], r[2], None) for r in within_budget(found, most_bytes)]
    for label in {r[2] for r in found} - {r[2] for r in chosen}:
        least = min((r for r in found if r[2] == label), key=lambda r: (r[1], r[0]))
        chosen.append((least[3], least[4], label, max(1, most_bytes // 8)))  # of at most four bytes each: half of the bytes
    ids = docs.sparkSession.createDataFrame(sorted(set(chosen), key=lambda r: r[:3]), f"sample_id {kind}, mark bigint, label int, most int")
    read = texts.withColumn("mark", mark).join(F.broadcast(ids), ["sample_id", "mark"])
    read = read.withColumn("text", F.coalesce(F.substring("text", F.lit(1), F.col("most")), F.col("text")))
    return read.groupBy("sample_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def _marked(batches):
    """(cluster, fold, label, text): near copies mostly share the least two hashes of their words, and make a cluster."""
    for batch in batches:
        least = [np.full(batch.num_rows, np.iinfo(np.uint64).max, np.uint64) for _ in range(2)]
        for part, base in zip(parts := list(pieces([batch], 0, 1 << 20)), np.cumsum([0] + [p.num_rows for p in parts])):
            codes, _, _, doc = tokens(*utf8(part.column(0)))
            np.minimum.at(least[0], doc + base, mix64(codes[0]))
            np.minimum.at(least[1], doc + base, mix64(codes[0] + np.uint64(77)))
        cluster = mix64(mix64(least[0]) + least[1])
        fold = (cluster >> np.uint64(40)) % np.uint64(4)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.view(np.int64)), pa.array(fold.astype(np.int32)), batch.column(1), batch.column(0)], names=["cluster", "fold", "label", "text"])


def _words(batches):
    """(code, fold, label, n): in how many clusters of the partition, each wholly in it, a code stands."""
    held = []
    for batch in pieces(batches, 3, 1 << 20):
        codes, _, _, doc = tokens(*utf8(batch.column(3)))
        cluster, fold, label = (np.asarray(batch.column(j)) for j in range(3))
        for code in codes:
            once = np.unique(mix64(code + mix64(cluster.view(np.uint64)[doc] * np.uint64(2) + label[doc].astype(np.uint64))), return_index=True)
            keep = code[once[1]] != 0
            at = doc[once[1][keep]]
            held.append((once[0][keep], code[once[1][keep]], (fold[at] * 2 + label[at]).astype(np.uint64)))
    if held:
        key, code, kind = (np.concatenate(c) for c in zip(*held))
        del held
        once = np.unique(key, return_index=True)[1]
        code, kind = code[once], kind[once]
        value, n = _counted(code, kind)
        yield pa.RecordBatch.from_arrays([pa.array(value[0].view(np.int64)), pa.array((value[1] // np.uint64(2)).astype(np.int32)), pa.array((value[1] % np.uint64(2)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["code", "fold", "label", "n"])


def _counted(code: np.ndarray, kind: np.ndarray):
    order = np.lexsort((kind, code))
    code, kind = code[order], kind[order]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (kind[1:] != kind[:-1])]))
    return (code[first], kind[first]), np.diff(np.append(first, len(code)))


#: Folds of clusters: the words of 0, 1 and 2 make the vocabulary, 3 is for the document score.
FOLDS = (0, 1, 2)


def telling(counts: DataFrame, clusters: dict[tuple[int, int], int], least: float = 4.5) -> DataFrame:
    """(code, sets): the words of toxic texts. Bit f of sets says that the folds other than f show it, bit 3 that all do.

    Of the clusters with a word, at least three and three quarters are toxic, far more than their share."""
    t = {f: F.sum(F.when((F.col("fold") == f) & (F.col("label") == 1), F.col("n")).otherwise(0)) for f in FOLDS}
    c = {f: F.sum(F.when((F.col("fold") == f) & (F.col("label") == 0), F.col("n")).otherwise(0)) for f in FOLDS}
    wide = counts.filter(F.col("fold").isin(*FOLDS)).groupBy("code").agg(*[t[f].alias(f"t{f}") for f in FOLDS], *[c[f].alias(f"c{f}") for f in FOLDS])
    sets = F.lit(0)
    for bit, folds in enumerate([*[[f for f in FOLDS if f != out] for out in FOLDS], list(FOLDS)]):
        nt, nc = (sum(clusters.get((f, y), 0) for f in folds) for y in (1, 0))
        p = nt / max(1, nt + nc)
        toxic, clean = sum(F.col(f"t{f}") for f in folds), sum(F.col(f"c{f}") for f in folds)
        both = toxic + clean
        z = (toxic - both * p) / F.sqrt(both * (p * (1 - p)) + 1e-9)
        sets = sets + F.when((z >= least) & (toxic >= 3) & (toxic >= 0.75 * both), 1 << bit).otherwise(0)
    return wide.select("code", sets.cast("int").alias("sets")).filter("sets > 0")


def _stretches(batches, vocabulary: np.ndarray, sets: np.ndarray, width: int):
    """(pick, holds, label, k) of the stretches of the folds that the field is fitted on; lists of `width` words, -1 past the end.

    A word of a toxic text is labelled toxic if the other folds' texts show it to be: what labels a word is never counted from its own text."""
    sets = np.append(sets, 0)
    for batch in pieces(batches, 3, 1 << 20):
        codes, a, _, doc = tokens(*utf8(batch.column(3)))
        cluster, fold, toxic = (np.asarray(batch.column(j)) for j in range(3))
        use = fold[doc] < 3
        known, doc = features_of([c[use] for c in codes], vocabulary), doc[use]
        shown = np.any([sets[k] >> fold[doc] & 1 for k in known], axis=0)
        label = shown & (toxic[doc] == 1)
        start, n = stretches(doc, width)
        if not len(start):
            continue
        at = start[:, None] + np.arange(width)
        live = np.arange(width) < n[:, None]
        at = np.minimum(at, len(doc) - 1)
        y = np.where(live, label[at], -1).astype(np.int8)
        k = np.stack([np.where(live, x[at], len(vocabulary)) for x in known], 2).astype(np.int32)
        pick = mix64(cluster.view(np.uint64)[doc[start]] + np.arange(len(start)).astype(np.uint64) * np.uint64(0x9E3779B1)).view(np.int64)
        lists = lambda x, t: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(t))
        yield pa.RecordBatch.from_arrays([pa.array(pick), pa.array((y == 1).any(1).astype(np.int32)), lists(y, pa.int8()), lists(k.reshape(len(k), -1), pa.int32())], names=["pick", "holds", "y", "k"])


def _gradients(batches, weights: np.ndarray, bias: float, moves: np.ndarray, features: int):
    """One row: the gradient of the partition's stretches as bytes."""
    total, size = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            y = part.column(0).flatten().to_numpy().reshape(part.num_rows, -1).astype(np.int64)
            k = part.column(1).flatten().to_numpy().reshape(*y.shape, features)
            live = y >= 0
            found = gradient(k, np.maximum(y, 0), live, weights, bias, moves)
            flat = np.concatenate([found[0], [found[1]], found[2].ravel(), [found[3], live.sum()], np.bincount(k.ravel(), minlength=len(weights))])
            total = flat if total is None else total + flat
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def fit_crf(table: DataFrame, vocabulary: int, features: int, steps: int = 40, rate: float = 2.0, momentum: float = 0.8) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, moves) by gradient ascent with momentum on the likelihood of the labelled stretches (y, k).

    Each step is a job: tasks sum the gradients of their stretches, and one vector for each task comes back."""
    w, bias, moves = np.append(np.full(vocabulary, 1.0), 0.0), -3.0, np.array([[1.0, -1.0], [0.0, 0.0]])
    vw, vb, vm = np.zeros_like(w), 0.0, np.zeros((2, 2))
    for _ in range(steps):
        run = lambda it, w=w, bias=bias, moves=moves: _gradients(it, w, bias, moves, features)
        total = sum(np.frombuffer(r.sums) for r in sorted(table.mapInArrow(run, "sums binary").collect()))
        n = len(w)
        by_weight, by_bias, by_move, words, size = total[:n], total[n], total[n + 1 : n + 5].reshape(2, 2), total[n + 6], total[n + 7 :] + 5
        vw = momentum * vw + rate * (by_weight - 0.02 * w) / size
        vb = momentum * vb + rate * (by_bias - 0.1 * bias) / words
        vm = momentum * vm + rate * (by_move - 0.05 * moves) / words
        w, bias, moves = w + vw, bias + vb, moves + vm
        w[-1] = 0
    return w[:-1], bias, moves


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = 1500, clean_rows: int = 4500, most_bytes: int = 16 << 20,
    width: int = 48, most_stretches: int = 6000, parts: int = 6,
) -> Model:
    """A model from a bounded sample of labelled documents: at most so many toxic and clean ones, and so many bytes (see labelled_sample).

    The field learns from at most most_stretches stretches of `width` words with a toxic word, the first by hash, and as many without one.

    Words and word beginnings that stand in toxic documents far more often than in clean ones (near copies counted once) are
    the vocabulary. Of three folds, those of the other two label the words of a fold's toxic documents, on
    which the field is fitted; the document score is fitted on a fourth. All passes over the sample are Spark jobs: the
    driver holds the vocabulary, one gradient for each task and step, and two numbers for each document of the fourth."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -3.0, np.zeros((2, 2)), np.array([-2.0, 0.0, 0.0]))
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, {1: toxic_rows, 0: clean_rows}, most_bytes)
    marked = sample.mapInArrow(lambda it: released(_marked(it)), "cluster bigint, fold int, label int, text string").repartition(parts, "cluster")
    sample = written(marked, "toxicity-sample")
    clusters = {(r.fold, r.label): r.n for r in sample.groupBy("fold", "label").agg(F.countDistinct("cluster").alias("n")).collect()}
    if len({y for _, y in clusters}) < 2:
        drop_written(sample)
        return empty
    by_cluster = sample.repartition(parts, "cluster")
    found = telling(by_cluster.mapInArrow(lambda it: released(_words(it)), "code bigint, fold int, label int, n bigint"), clusters).collect()
    vocabulary, sets = np.array([r.code for r in found], np.int64).view(np.uint64), np.array([r.sets for r in found], np.int64)
    order = np.argsort(vocabulary)
    vocabulary, sets = vocabulary[order], sets[order]
    if not len(vocabulary):
        drop_written(sample)
        return empty
    table = sample.mapInArrow(lambda it: _stretches(it, vocabulary, sets, width), "pick bigint, holds int, y array<tinyint>, k array<int>")
    table = written(table, "toxicity-stretches")
    some = table.filter("holds = 1").orderBy("pick", "k").limit(most_stretches)
    n = max(50, min(most_stretches, table.filter("holds = 1").count()))
    rest = table.filter("holds = 0").orderBy("pick", "k").limit(n)
    chosen = written(some.unionByName(rest).repartition(parts, "pick").select("y", "k"), "toxicity-chosen")
    weights, bias, moves = fit_crf(chosen, len(vocabulary), 1 + len(PREFIXES))
    model = Model(vocabulary, weights, bias, moves, np.zeros(3))
    half = 3 if clusters.get((3, 0)) and clusters.get((3, 1)) else None
    judged = (sample if half is None else sample.filter(F.col("fold") == half)).select("label", "text")
    rows = sorted(tuple(r) for r in judged.mapInArrow(lambda it: _evidence(it, model), "label int, top double, mass double").collect())
    model.link = logistic(np.array([r[1:] for r in rows]), np.array([r[0] for r in rows], float))
    for t in (sample, table, chosen):
        drop_written(t)
    return model


def _evidence(batches, model: Model):
    for batch in pieces(batches, 1, 1 << 20):
        x, _ = model.documents(*utf8(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["label", "top", "mass"])


def _tag(batches, model: Model, batch_bytes: int):
    for batch in pieces(batches, 1, batch_bytes):
        data, offsets = utf8(batch.column(1))
        x, (doc, a, b, m) = model.documents(data, offsets)
        score = model.score(x)
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
        base = letters[offsets[doc]]
        spans = pa.StructArray.from_arrays([pa.array(letters[a] - base, pa.int64()), pa.array(letters[b] - base, pa.int64()), pa.array(m, pa.float64())], ["start", "end", "marginal"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32()), spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), lists], names=["id", "score", "spans"])


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """(id_col, score, spans) for every row of docs.

    spans are the words tagged toxic: where they start and end, in code points, and their marginal. A null or empty
    text has no spans and the score of a document without any word of the vocabulary. Ids may repeat or be null."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample's vocabulary at most
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: released(_tag(it, held.value, batch_bytes)), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def _with_score(batches, model: Model, text_col: int, batch_bytes: int):
    for batch in pieces(batches, text_col, batch_bytes):
        score = model.score(model.documents(*utf8(batch.column(text_col)))[0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, batch_bytes: int = 1 << 20) -> DataFrame:
    """The rows of docs that score less than threshold, each judged by its own text in one pass, without a join."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at, places = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(places, docs.schema)] + [StructField("score", DoubleType())])
    scored = docs.toDF(*places).mapInArrow(lambda it: released(_with_score(it, held.value, at, batch_bytes)), schema)
    return scored.filter(F.col("score") < threshold).select(*[F.col(n).alias(c) for n, c in zip(places, docs.columns)])


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """(id_col, held_out, score, predicted, spans): fitted on the labels of the other folds of crc32(id) % parts.

    A null label is no label; a null id is in no held-out fold. Without labels of both kinds every score is the same."""
    model = fit(docs, labels.filter(fold(id_col, parts) != held), id_col, text_col, label_col)
    out = tag(docs, model, id_col, text_col)
    held_out = F.coalesce(fold(id_col, parts) == held, F.lit(False))
    return out.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
