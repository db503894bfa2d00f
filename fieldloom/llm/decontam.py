"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items by block-max WAND."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import READ, drop_written, mix64, pieces, released, utf8, with_count, word_codes, written

INDEX_WORDS = 20_000  #: words of the items of one index; more items make more indexes, each asked in turn
PASS_BYTES = 16 << 20  #: bytes of the indexes that one pass over the documents broadcasts; more make more passes
BLOCK = 8  #: items of a block
STEPS = [16 * 4**k for k in range(12)]  #: lengths of passages: an item's is the first that is no shorter than the item

K1 = np.uint64(0x9FB21C651E98DF25)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item that comes as one text: its last sentence is the answer, or its last quarter of words without two sentences."""
    cuts = [m.end() for m in re.finditer(r"[.?!](?=\s+\S)", text)]
    if cuts:
        return text[: cuts[-1]], text[cuts[-1] :]
    words = text.split()
    n = max(1, len(words) // 4)
    return " ".join(words[:-n]), " ".join(words[-n:])


def shingles_of(code: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the runs of so many words (the whole sequence if there are fewer; none without words)."""
    m = min(words, len(code))
    if not m:
        return np.zeros(0, np.uint64)
    h = code[: len(code) - m + 1].copy()
    for j in range(1, m):
        h = mix64(h * K1 + code[j : len(code) - m + 1 + j])
    return h


def may_lack(shingles: int, runs: int, overlap: float, words: int) -> int:
    """How many distinct words a passage can lack that has `overlap` of a part's distinct shingles (runs: places where one begins).

    A word is lacking only if all shingles with it are. Take one that is not lacking: each lacking word before it begins a lacking
    shingle, each after it ends one, so there are no more such words than shingles, if each shingle has one place. If shingles repeat, at
    most one word begins each, and the last words - 1 words of the part begin none."""
    lost = int((1 - overlap) * shingles + 1e-9)
    return lost if not lost or shingles == runs else lost + words - 1


def _codes(text: str) -> np.ndarray:
    data, offsets = utf8(pa.array([text], pa.string()))
    return word_codes(READ[data], offsets)[0]


@dataclass
class Index:
    """Postings of terms, each impact a share of the score that its item needs; items in blocks with the largest impact."""

    items: list
    lengths: list[tuple[int, int]]  #: words of the question and of the answer
    questions: list[np.ndarray]  #: distinct shingles
    answers: list[np.ndarray]
    terms: np.ndarray  #: ascending
    begins: np.ndarray  #: of each term's postings
    posted: np.ndarray  #: items, ascending within a term
    impact: np.ndarray  #: as a share of `need`
    need: np.ndarray  #: the share of its full score below which an item cannot have both overlaps
    step: int
    block_max: np.ndarray = field(repr=False, default=None)  #: term x block; made where it is used
    hint: np.ndarray = field(repr=False, default=None)

    @staticmethod
    def build(rows: list[tuple], step: int, words: int, overlap: float, mean: float, k1: float = 1.2, b: float = 0.75) -> Index:
        """rows: (id, words of the question, words of the answer, distinct words ascending, their idf). idf and mean are those of all items of all indexes."""
        # items that share frequent words stand together, so that a block's bounds are close
        often = [t for t, _ in Counter(t for r in rows for t in r[3].tolist()).most_common(12)]
        rows = sorted(rows, key=lambda r: ([not np.isin(t, r[3]) for t in np.array(often, np.uint64)], r[0], r[1].tolist(), r[2].tolist()))
        parts = [[np.unique(shingles_of(c, words)) for c in r[1:3]] for r in rows]
        terms, posted, impacts, need = [], [], [], np.ones(len(rows))
        for i, (_, q, a, own, idf) in enumerate(rows):
            whole = np.concatenate([q, a])
            tf = np.unique(whole, return_counts=True)[1]
            share = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(whole) / mean))
            share = share / max(share.sum(), 1e-9)
            for c, h in zip((q, a), parts[i]):
                lack = may_lack(len(h), max(1, len(c) - words + 1), overlap, words)
                if lack:
                    need[i] -= np.sort(share[np.isin(own, c)])[-lack:].sum()
            need[i] = max(need[i] - 1e-5, 1e-5)
            terms.append(own)
            posted.append(np.full(len(own), i, np.int32))
            impacts.append(np.nextafter((share / need[i]).astype(np.float32), np.float32(9)))
        term, item, impact = (np.concatenate(x) for x in (terms, posted, impacts))
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        distinct, begins = np.unique(term, return_index=True)
        return Index([r[0] for r in rows], [(len(r[1]), len(r[2])) for r in rows], [q for q, _ in parts], [a for _, a in parts], distinct, np.append(begins, len(term)), item, impact, need, step)

    def ready(self) -> Index:
        """With the tables that are made from the postings: the largest impact of each term in each block, and a filter of words."""
        if self.block_max is None:
            self.block_max = np.zeros((len(self.terms), -(-len(self.items) // BLOCK)), np.float32)
            np.maximum.at(self.block_max, (np.repeat(np.arange(len(self.terms)), np.diff(self.begins)), self.posted // BLOCK), self.impact)
            self.hint = np.zeros(1 << 20, bool)
            self.hint[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return self

    def known(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of words that are terms, their terms)."""
        maybe = np.flatnonzero(self.hint[(code & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, code[maybe]), len(self.terms) - 1)
        sure = self.terms[at] == code[maybe]
        return maybe[sure], at[sure]

    def above(self, terms: np.ndarray, bounds: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of every item whose score for these distinct terms is as high as it needs, by block-max WAND.

        bounds: for each block of items the sum of the terms' largest impacts in it. The cursors of the terms stand in the order of
        their items; the first ones whose largest impacts add up to 1 end at the pivot, and no item before it can have a
        score of 1. Where the pivot's block has a lower bound, all cursors before the next block that has not are moved there."""
        open_blocks = np.flatnonzero(bounds >= 1)
        if not len(open_blocks):
            return []
        lists = [(self.posted[a:z], self.impact[a:z], float(self.block_max[t].max())) for t, a, z in zip(terms.tolist(), self.begins[terms].tolist(), self.begins[terms + 1].tolist())]
        first = int(open_blocks[0]) * BLOCK
        cursors = [[int(items[at]), k, at] for k, (items, _, _) in enumerate(lists) if (at := int(np.searchsorted(items, first))) < len(items)]
        out = []

        def move(chosen, to):
            for c in chosen:
                items = lists[c[1]][0]
                c[2] += int(np.searchsorted(items[c[2] :], to))
                c[0] = int(items[c[2]]) if c[2] < len(items) else -1
            return sorted(c for c in cursors if c[0] >= 0)

        cursors.sort()
        while cursors:
            total, pivot = 0.0, None
            for c in cursors:
                total += lists[c[1]][2]
                if total >= 1:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if bounds[pivot // BLOCK] < 1:
                k = int(np.searchsorted(open_blocks, pivot // BLOCK))
                if k == len(open_blocks):
                    break
                to = int(open_blocks[k]) * BLOCK
                cursors = move([c for c in cursors if c[0] < to], to)
            elif cursors[0][0] < pivot:
                cursors = move([c for c in cursors if c[0] < pivot], pivot)
            else:
                own = [c for c in cursors if c[0] == pivot]
                score = sum(float(lists[k][1][at]) for _, k, at in sorted(own, key=lambda c: c[1]))
                if score >= 1:
                    out.append((pivot, score * float(self.need[pivot])))
                cursors = move(own, pivot + 1)
        return out


def _covered(part: np.ndarray, have: np.ndarray) -> float:
    return float(np.isin(part, have, assume_unique=False).mean()) if len(part) else 1.0


def _found(batches, indexes: list[Index], words: int, overlap: float, batch_bytes: int, text_col: int = 1):
    """(piece of a batch, {(row, index, item): (score, question_overlap, answer_overlap, passage_word)})."""
    for batch in pieces(batches, text_col, batch_bytes):
        data, offsets = utf8(batch.column(text_col))
        code, _, _, doc = word_codes(READ[data], offsets)
        n = batch.num_rows
        count = np.bincount(doc, minlength=n)
        first = np.cumsum(count) - count
        found: dict[tuple[int, int, int], tuple] = {}
        for x, index in enumerate(indexes):
            step = index.ready().step
            at, term = index.known(code)
            if not len(at):
                continue
            # a passage is two stretches of `step` words, and begins with each stretch: an item lies whole in one
            stretches = np.maximum(1, -(-count // step))
            base = np.cumsum(stretches) - stretches
            stretch = base[doc[at]] + (at - first[doc[at]]) // step
            second = stretch > base[doc[at]]
            pairs = np.unique(np.concatenate([stretch, stretch[second] - 1]) * len(index.terms) + np.concatenate([term, term[second]]))
            passage, term = np.divmod(pairs, len(index.terms))
            start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
            ends = np.append(start[1:], len(passage))
            bounds = np.add.reduceat(index.block_max[term], start, axis=0)
            for k in np.flatnonzero(bounds.max(1) >= 1).tolist():
                own = term[start[k] : ends[k]]
                hits = index.above(own, bounds[k])
                if not hits:
                    continue
                p = int(passage[start[k]])
                d = int(np.searchsorted(base, p, "right") - 1)
                a = first[d] + (p - base[d]) * step
                z = min(a + 2 * step, first[d] + count[d])
                have = shingles_of(code[a:z], words)
                for item, score in hits:
                    q, w = (_covered(part, have if n >= words else shingles_of(code[a:z], n)) for part, n in ((index.questions[item], index.lengths[item][0]), (index.answers[item], index.lengths[item][1])))
                    if q >= overlap and w >= overlap:
                        key = (d, x, item)
                        new = (score, q, w, int(a - first[d]))
                        if key not in found or (new[1] + new[2], new[0], -new[3]) > (found[key][1] + found[key][2], found[key][0], -found[key][3]):
                            found[key] = new
        yield batch, found


def _search(batches, indexes: list[Index], words: int, overlap: float, batch_bytes: int):
    for batch, found in _found(batches, indexes, words, overlap, batch_bytes):
        if found:
            keys = sorted(found)
            ids = batch.column(0).take(pa.array([k[0] for k in keys], pa.int64()))
            values = [found[k] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([indexes[k[1]].items[k[2]] for k in keys], pa.int64()), *(pa.array([v[j] for v in values], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.int64())))],
                names=["id", "item_id", "score", "question_overlap", "answer_overlap", "passage_word"],
            )


def _clean(batches, indexes: list[Index], words: int, overlap: float, batch_bytes: int, text_col: int):
    for batch, found in _found(batches, indexes, words, overlap, batch_bytes, text_col):
        keep = np.ones(batch.num_rows, bool)
        keep[[k[0] for k in found]] = False
        yield batch.filter(pa.array(keep))


def _items(batches, has_answer: bool):
    """(item, q, a, step): the words of each item's question and answer, and the length of its passages; items without words are left out."""
    for batch in batches:
        rows = []
        for i, q, a in zip(*(batch.column(j).to_pylist() for j in range(3))):
            parts = [_codes(x) for x in ((q, a or "") if has_answer else split_item(q))]
            n = sum(map(len, parts))
            if n:
                rows.append((i, *(c.view(np.int64) for c in parts), next((s for s in STEPS if s >= n), STEPS[-1])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()))], names=["item", "q", "a", "step"])


def _index(table: pa.Table, words: int, overlap: float, mean: float) -> pa.Table:
    rows = []
    for r in table.to_pylist():
        own = sorted((np.uint64(t["term"] % 2**64), t["idf"]) for t in r["terms"])
        rows.append((r["item"], *(np.array(r[c], np.int64).view(np.uint64) for c in "qa"), np.array([t for t, _ in own], np.uint64), np.array([f for _, f in own])))
    index = pickle.dumps(Index.build(rows, table.column("step")[0].as_py(), words, overlap, mean))
    return pa.table({"step": table.column("step").slice(0, 1), "portion": table.column("portion").slice(0, 1), "index": pa.array([index], pa.binary()), "bytes": pa.array([len(index)], pa.int64())})


def build_indexes(items: DataFrame, words: int, overlap: float, id_col: str, question_col: str, answer_col: str | None, index_words: int) -> DataFrame:
    """(step, portion, index, bytes): indexes of some index_words words each, as a written table, made in tasks.

    An item is in a portion with others of its length of passage. What words weigh is counted over all items, so an item's score depends on the whole
    table and not on its portion. Items with equal ids and words are one."""
    columns = [F.col(id_col).cast("long").alias("i"), F.col(question_col).alias("q"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a")]
    run = lambda it: _items(it, answer_col is not None)
    coded = items.select(*columns).filter("q is not null").mapInArrow(run, "item bigint, q array<bigint>, a array<bigint>, step bigint").dropDuplicates(["item", "q", "a"])
    coded = written(coded.withColumn("row", F.monotonically_increasing_id()), "decontam-items")
    size = F.size("q") + F.size("a")
    steps = coded.groupBy("step").agg(F.sum(size).alias("words"), F.count("*").alias("n")).collect()  # a row for each of STEPS at most
    if not steps:
        return coded.select("step", F.col("row").alias("portion"), F.lit(None).cast("binary").alias("index"), F.lit(0).cast("long").alias("bytes"))
    n, total = sum(r.n for r in steps), sum(r.words for r in steps)
    mean = max(1.0, total / n)
    posted = coded.select("row", F.explode(F.array_distinct(F.concat("q", "a"))).alias("term"))
    posted = with_count(posted, "term", F.xxhash64("row"), "df")
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = posted.select("row", F.struct("term", idf.alias("idf")).alias("t")).groupBy("row").agg(F.collect_list("t").alias("terms"))
    portions = F.lit(1)
    for r in steps:
        portions = F.when(F.col("step") == r.step, max(1, -(-r.words // index_words))).otherwise(portions)
    ready = coded.join(terms, "row").withColumn("portion", F.pmod(F.xxhash64("item", "q", "a"), portions.cast("long")))
    build = lambda t: _index(t, words, overlap, mean)
    out = written(ready.groupBy("step", "portion").applyInArrow(build, "step bigint, portion bigint, index binary, bytes bigint"), "decontam-indexes")
    drop_written(coded)
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None,
    words: int = 5, overlap: float = 0.8, batch_bytes: int = 2 << 20, index_words: int = INDEX_WORDS, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap, passage_word): a row for each item that a row of docs leaks.

    Every passage of every whole text is a query: runs of twice as many words as the item's length rounded up (STEPS), one
    beginning at each such half. Items are retrieved by their BM25 score, from the share of the full score below which
    none can be a leak (see may_lack), so that no leak is lost before the overlaps are checked; a leak is one where at least
    `overlap` of the distinct shingles of the question, and of the answer, stand in the passage (a part with fewer words
    than a shingle counts as one shingle). Of an item's passages in a document the one with the most overlap is reported, then
    the higher score, then the first. Without answer_col, an item's last sentence is its answer. Null texts leak nothing;
    null items and items without words are no items, equal ones are one. Rows with equal ids are
    judged one by one. Words are compared with A-Z lower-cased and without ASCII punctuation.

    Neither the driver nor a task holds more of the indexes at once than pass_bytes (or one index): a larger test collection makes several passes over docs.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, item_id bigint, score double, question_overlap double, answer_overlap double, passage_word bigint"
    indexes = build_indexes(items, words, overlap, item_col, question_col, answer_col, index_words)
    texts, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for held, more in _passes(indexes, pass_bytes):
        found = texts.mapInArrow(lambda it, held=held: released(_search(it, held.value, words, overlap, batch_bytes)), schema)
        if more:
            found = written(found, "decontam-pass")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def _passes(indexes: DataFrame, pass_bytes: int):
    """(a broadcast of indexes of about pass_bytes, whether there are several): what one pass over the documents asks."""
    spark = indexes.sparkSession
    passes, size = [[]], 0
    for r in indexes.select("step", "portion", "bytes").orderBy("step", "portion").collect():  # three numbers for each index
        if passes[-1] and size + r.bytes > pass_bytes:
            passes.append([])
            size = 0
        passes[-1].append((r.step, r.portion))
        size += r.bytes
    for keys in passes:
        mine = indexes.filter(F.struct("step", "portion").isin([F.struct(F.lit(s).cast("long"), F.lit(p).cast("long")) for s, p in keys])) if keys else indexes.limit(0)
        rows = mine.select("step", "portion", "index").orderBy("step", "portion").collect()
        yield spark.sparkContext.broadcast([pickle.loads(r["index"]) for r in rows]), len(passes) > 1


def without_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None,
    words: int = 5, overlap: float = 0.8, batch_bytes: int = 2 << 20, index_words: int = INDEX_WORDS, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The rows of docs that leak no item (see decontaminate), each judged by its own text, without a join."""
    indexes = build_indexes(items, words, overlap, item_col, question_col, answer_col, index_words)
    at, names = docs.columns.index(text_col), docs.columns
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for held, more in _passes(indexes, pass_bytes):
        out = out.mapInArrow(lambda it, held=held: released(_clean(it, held.value, words, overlap, batch_bytes, at)), out.schema)
        out = written(out, "decontam-pass") if more else out
    return out.toDF(*names)
