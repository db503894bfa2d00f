"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Full suffix arrays need several times the text itself. A sparse one keeps the suffixes that begin at anchors:
places where the hash of the next SPAN bytes is least among its neighbours. Every string of `length` bytes holds
an anchor whose place depends on that string alone, so two equal strings hold equal anchors at equal places. The array's
order is the hash of those first bytes, then of the surroundings, which is all that a search for long matches asks for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, drop_written, inverse_powers, mix64, pieces, powers, utf8, with_count, written

ENTRY = "fp bigint, around bigint, key bigint, pos int, left int, right int"


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of w values; as many as there are whole runs."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(total: np.ndarray, down: np.ndarray, a: int, b: int, span: int, length: int) -> np.ndarray:
    """Places in the text [a, b) whose hash of span bytes is the least of some run of length - span + 1 such hashes."""
    w = length - span + 1
    h = mix64((total[a + span : b + 1] - total[a : b + 1 - span]) * down[a : b + 1 - span])
    low = _least(h, w)
    # the largest of the minima of the runs that hold a place equals its own hash if it is the least of one
    most = np.iinfo(np.uint64).max
    edge = np.zeros(w - 1, np.uint64) + most
    high = most - _least(np.concatenate([edge, most - low, edge]), w)
    return np.flatnonzero(high == h)


def _window_hash(total, down, at, n):
    """down: inverse_powers(len(total)), made once for all windows, as a large table is not kept."""
    return mix64((total[at + n] - total[at]) * down[at] + np.uint64(0x51ED27))


def _entries(batches, span: int, length: int, batch_bytes: int):
    """The entries of each batch's texts, each distinct text of the batch once (twice if it is there more often)."""
    for batch in pieces(batches, 1, batch_bytes):
        data, offsets = utf8(batch.column(1))
        keys = batch.column(0).to_numpy()
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[data] * powers(len(data)), out=total[1:])
        down = inverse_powers(len(total))
        seen: dict[int, int] = {}
        out = []
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            times = seen[keys[k]] = seen.get(keys[k], 0) + 1
            if b - a < length or times > 2:
                continue
            at = a + anchors(total, down, a, b, span, length)
            left, right = np.minimum(at - a, length - span), np.minimum(b - at, length)
            fp = _window_hash(total, down, at, span)
            around = mix64((total[at + right] - total[at - left]) * down[at - left] + left.astype(np.uint64) * np.uint64(0x9E3779B1) + right.astype(np.uint64))
            out.append((fp.view(np.int64), around.view(np.int64), np.full(len(at), keys[k]), at - a, left, right))
        if out:
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 3)], names=["fp", "around", "key", "pos", "left", "right"])


class LogIndex:
    """Levels of sorted entry tables, each at least twice as large as the next; a new batch is scanned against all, then merged.

    A batch's array comes in sorted order by fp. Against each level, one merge scan finds the fps that both have; matches are
    kept as counts by (fp, around). Levels of equal size are merged into one of twice the size, so an entry is written
    again only as often as the number of batches has binary digits."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.matches: list[DataFrame] = []

    @staticmethod
    def counted(entries: DataFrame) -> DataFrame:
        return entries.groupBy("fp", "around").agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """batch: (fp, around, n)."""
        array = written(self.counted(batch).sortWithinPartitions("fp", "around"), "suffix-level")
        inside = array.groupBy("fp").agg(F.sum("n").alias("n")).filter("n > 1").select("fp")
        own = array.select("fp").distinct()  # a row for each fp: one that has very many surroundings is no heavier than others
        hits = inside
        for _, level in self.levels:
            hits = hits.union(own.join(level.select("fp").distinct(), "fp", "left_semi"))
        self.matches.append(written(hits.distinct(), "suffix-hits"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, other = self.levels.pop()
            merged = written(self.counted(array.union(other)).sortWithinPartitions("fp", "around"), "suffix-level")
            drop_written(array)
            drop_written(other)
            array, size = merged, size * 2
        self.levels.append((size, array))

    def repeated(self) -> DataFrame:
        """(fp, around, n, kinds) of every fp that occurs more than once: kinds counts its different surroundings."""
        hits = self.matches[0]
        for m in self.matches[1:]:
            hits = hits.union(m)
        every = self.levels[0][1]
        for _, level in self.levels[1:]:
            every = every.union(level)
        return with_count(self.counted(every), "fp", F.col("around"), "kinds", hits.distinct())


def _surroundings(batches, length: int, span: int):
    """For rows (key, text, places: pos, fp): the bytes around each place."""
    for batch in batches:
        out = []
        for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for p in places:
                a = max(0, p["pos"] - (length - span))
                out.append((p["fp"], key, p["pos"], p["pos"] - a, text[a : p["pos"] + length]))
        for at in range(0, len(out), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 5000]), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["fp", "key", "pos", "left", "bytes"])


def _windows(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, span: int, length: int):
    """For each shift: (shift, rows that have the string, its hash), of strings of `length` bytes that begin `shift` before the anchor."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers(len(data)), out=total[1:])
    anchor, down = offsets[:-1] + left, inverse_powers(len(total))
    for shift in range(length - span + 1):
        rows = np.flatnonzero((left >= shift) & (anchor - shift + length <= offsets[1:]))
        if len(rows):
            yield shift, rows, _window_hash(total, down, anchor[rows] - shift, length)


def _runs(rows: np.ndarray, shifts: np.ndarray, pos: np.ndarray, length: int):
    """(row, start, end) of the bytes covered by strings at these shifts; overlapping and touching ones as one."""
    if not len(rows):  # equal anchors, but no string of this length again
        return rows, rows, rows
    start = pos[rows] - shifts
    order = np.lexsort((start, rows))
    rows, start = rows[order], start[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return rows[first], start[first], start[last] + length


def _compare(table: pa.Table, span: int, length: int) -> pa.Table:
    """Of surroundings with the same anchors: the covered stretches (key, start, end)."""
    table = table.combine_chunks()
    data, offsets = utf8(table.column("bytes"))
    fp, left = table.column("fp").to_numpy().view(np.uint64), table.column("left").to_numpy().astype(np.int64)
    hit_rows, hit_shifts = [], []
    for shift, rows, h in _windows(data, offsets, left, span, length):
        _, back, count = np.unique(mix64(h + fp[rows] * np.uint64(31)), return_inverse=True, return_counts=True)
        again = count[back] > 1
        hit_rows.append(rows[again])
        hit_shifts.append(np.full(int(again.sum()), shift))
    rows, shifts = np.concatenate([*hit_rows, np.zeros(0, np.int64)]), np.concatenate([*hit_shifts, np.zeros(0, np.int64)])
    rows, start, end = _runs(rows, shifts, table.column("pos").to_numpy().astype(np.int64), length)
    return pa.table({"key": table.column("key").take(pa.array(rows)), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())})


def _strings(batches, span: int, length: int):
    """(hash of anchor, shift and string, key, start) of every string of rows (fp, key, pos, left, bytes)."""
    for batch in batches:
        data, offsets = utf8(batch.column(4))
        fp, left = batch.column(0).to_numpy().view(np.uint64), batch.column(3).to_numpy().astype(np.int64)
        for shift, rows, h in _windows(data, offsets, left, span, length):
            code = mix64(mix64(h + fp[rows] * np.uint64(31)) + np.uint64(shift))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), batch.column(1).take(pa.array(rows)), pa.array((batch.column(2).to_numpy()[rows] - shift).astype(np.int32))], names=["code", "key", "start"])


def _remove(batches):
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = text or b""
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            end = -1
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if s[0] > end:
                    n += 1
                a = max(s[0], end, 0)
                kept.update(text[at:a])
                end = max(end, s[1])
                removed += max(0, end - a)
                at = max(at, end)
            kept.update(text[at:])
            out.append((doc, len(text), removed, n, kept.hexdigest()))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int, span: int, batches: int, group_rows: int, batch_bytes: int, part_bytes: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows (id, content, key), covered stretches (key, start, end), the tables that these read); key is a 64-bit hash of the content."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("content"))
    rows = rows.withColumn("key", F.xxhash64("content"))
    run = lambda it: _entries(it, span, length, batch_bytes)
    entries = written(rows.select("key", "content").mapInArrow(run, ENTRY), "suffix-entries")
    index = LogIndex()
    for k in range(batches):
        part = entries.filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(batches)) == k)
        index.add(part.groupBy("fp", "around").agg(F.count("*").alias("n")))
    again = written(index.repeated(), "suffix-repeated")
    for _, level in index.levels:
        drop_written(level)
    mine = entries.join(again, ["fp", "around"])
    # equal surroundings elsewhere: every string in them is repeated
    whole = mine.filter((F.col("n") > 1) & (F.col("left") + F.col("right") >= length)).select("key", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"))
    # the anchor occurs elsewhere, but in other surroundings: compare these byte by byte, each kind once
    open_ = mine.filter("n = 1 or kinds > 1").select("fp", "key", "pos", F.when(F.col("n") > 1, F.col("around")).alias("around"))
    alone = open_.filter("around is null").select("fp", "key", "pos")
    kinds = open_.filter("around is not null").groupBy("fp", "around").agg(F.min(F.struct("key", "pos")).alias("one")).select("fp", "one.key", "one.pos")
    asked = written(alone.union(kinds).groupBy("key").agg(F.collect_set(F.struct("pos", "fp")).alias("places")), "suffix-asked")
    texts = rows.select("key", "content").join(asked, "key")
    near = texts.mapInArrow(lambda it: _surroundings(it, length, span), "fp bigint, key bigint, pos int, left int, bytes binary").dropDuplicates(["fp", "key", "pos"])
    near = written(near, "suffix-near")
    drop_written(asked)
    sizes = near.groupBy("fp").agg(F.count("*").alias("rows"))
    large = written(sizes.filter(F.col("rows") > group_rows).select("fp"), "suffix-large")
    # a part holds about part_bytes of surroundings, and at most one anchor's group_rows more
    size = near.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    parts = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // part_bytes)
    small = near.join(large, "fp", "left_anti").withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(parts)))
    found = small.groupBy("part").applyInArrow(lambda t: _compare(t, span, length), "key bigint, start int, end int")
    # anchors with very many surroundings: their strings are counted one by one over all tasks
    strings = near.join(large, "fp").select("fp", "key", "pos", "left", "bytes").mapInArrow(lambda it: _strings(it, span, length), "code bigint, key bigint, start int")
    both = strings.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").select("code")
    many = strings.join(both, "code").select("key", "start", (F.col("start") + length).alias("end")).distinct()
    return rows, whole.union(found).union(many), [entries, again, near, large]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, span: int = 160, batches: int = 4, group_rows: int = 20_000, batch_bytes: int = 1 << 20, part_bytes: int = 4 << 20) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256), one for every row of docs.

    Texts are UTF-8 bytes (null: empty). Each byte covered by a string of `length` bytes that begins anywhere else too, in the
    same row or another, is removed; all rows are judged as they came, so both of two copies lose it. Runs that touch
    are one span. Rows with equal ids are rows of their own. Strings are compared by 64-bit hashes of all their bytes.
    """
    rows, spans, tables = repeated_spans(docs, id_col, text_col, length, span, batches, group_rows, batch_bytes, part_bytes)
    gathered = written(spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suffix-spans")
    for table in tables:
        drop_written(table)
    kind = dict(docs.dtypes)[id_col]
    joined = rows.join(gathered, "key", "left").select("id", "content", "spans")
    return joined.mapInArrow(_remove, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("id", id_col)
