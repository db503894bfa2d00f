"""Grace hash deduplication of whole texts that are equal after white space is deleted."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, written


class ContentTable:
    """Open addressing with linear probing; a slot is taken as equal only after the complete contents are compared."""

    def __init__(self, room: int = 1024):
        self.slots = np.full(room, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def put(self, content: bytes, code: int) -> int:
        """The index of the content, added if it is new."""
        if 2 * len(self.contents) >= len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for i, h in enumerate(self.hashes):
                self.slots[self._free(h)] = i
        mask, at = len(self.slots) - 1, code & (len(self.slots) - 1)
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == code and self.contents[i] == content:
                return int(i)
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(code)
        self.contents.append(content)
        return len(self.contents) - 1

    def _free(self, code: int) -> int:
        at = code & (len(self.slots) - 1)
        while self.slots[at] >= 0:
            at = (at + 1) & (len(self.slots) - 1)
        return at


def _order(chars, key):
    """Sorts the row that stays first: most code points, then smallest id; a null id comes last."""
    return (-chars, key is None, 0 if key is None else key)


def _local_pass(id_type: pa.DataType, table_bytes: int):
    """Each task's own table: one row per document that names its content's first holder (link); only holders carry the content."""

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        made = 0

        def flush(table, rows, shas):
            nonlocal made
            best, count, first = [None] * len(table.contents), [0] * len(table.contents), [None] * len(table.contents)
            for r, (key, chars, i) in enumerate(rows):
                count[i] += 1
                if first[i] is None:
                    first[i] = r
                if best[i] is None or _order(chars, key) < _order(*best[i]):
                    best[i] = (chars, key)
            links = [base + made + first[i] for i in range(len(first))]
            made += len(rows)
            held = [first[i] == r for r, (_, _, i) in enumerate(rows)]
            own = [i for _, _, i in rows]
            pick = lambda f: [f(i) if h else None for h, i in zip(held, own)]
            for at in range(0, len(rows), 2000):
                part = slice(at, at + 2000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in rows[part]], id_type),
                        pa.array([links[i] for i in own[part]], pa.int64()),
                        pa.array([shas[i] for i in own[part]], pa.string()),
                        pa.array(pick(lambda i: table.contents[i])[part], pa.binary()),
                        pa.array(pick(lambda i: len(table.contents[i]))[part], pa.int64()),
                        pa.array(pick(lambda i: count[i])[part], pa.int64()),
                        pa.array(pick(lambda i: best[i][0])[part], pa.int64()),
                        pa.array(pick(lambda i: best[i][1])[part], id_type),
                    ],
                    names=["id", "link", "sha", "content", "n_bytes", "n", "best_chars", "best_id"],
                )

        table, rows, shas, held = ContentTable(), [], [], 0
        for batch in batches:
            for key, content, chars in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                content = (content or b"").translate(None, WHITE)
                digest = hashlib.sha256(content)
                i = table.put(content, int.from_bytes(digest.digest()[:8], "little"))
                if i == len(shas):
                    shas.append(digest.hexdigest())
                    held += len(content)
                rows.append((key, chars or 0, i))
                if held > table_bytes or len(rows) >= 200_000:
                    yield from flush(table, rows, shas)
                    table, rows, shas, held = ContentTable(), [], [], 0
        if rows:
            yield from flush(table, rows, shas)

    return run


def _classes(table: pa.Table):
    """The content table of one bucket: (index of each row's class, best (chars, id) and number of rows of each class, first row of each)."""
    found, own, best, count, first = ContentTable(), [], [], [], []
    cols = [table.column(c).to_pylist() for c in ("content", "code", "n", "best_chars", "best_id")]
    for r, (content, code, n, chars, key) in enumerate(zip(*cols)):
        i = found.put(content, code & (2**63 - 1))
        if i == len(best):
            best.append((chars, key))
            count.append(0)
            first.append(r)
        elif _order(chars, key) < _order(*best[i]):
            best[i] = (chars, key)
        count[i] += n
        own.append(i)
    return own, best, count, first


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 48 << 20, fan_out: int = 16, max_levels: int = 12) -> DataFrame:
    """Rows (id_col, keep_id, group_size, kept, text_sha256), one for every row of docs.

    Texts are equal when identical after deleting ASCII white space; a null text counts as empty.
    Of equal texts the row with the most code points in its original text stays, then the smallest id
    (a null id comes last). Rows that share an id are rows of their own: kept is true on each that has keep_id.

    1. Each task keeps an open-addressing table of its own contents, so that copies leave a task once.
    2. Records are dealt into buckets by hash, as files in the shared folder. A bucket of more than
       bucket_bytes is first combined in salted parts, so that one content's copies shrink, then
       dealt again by another hash; this repeats until every bucket fits.
    3. A table for each bucket compares complete contents.
    """
    id_type = pa.int64() if dict(docs.dtypes)[id_col] in ("bigint", "int") else pa.string()
    kind = "bigint" if id_type == pa.int64() else "string"
    source = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("binary").alias("content"), F.length(text_col).alias("chars"))
    schema = f"id {kind}, link bigint, sha string, content binary, n_bytes bigint, n bigint, best_chars bigint, best_id {kind}"
    spread = written(source.mapInArrow(_local_pass(id_type, bucket_bytes), schema), "grace-records")

    work = spread.filter("content is not null").select("link", "content", F.xxhash64("content").alias("code"), "n_bytes", "n", "best_chars", "best_id")
    answers, merged = [], []
    total = work.agg(F.sum("n_bytes"), F.count("*")).first()
    parts = max(1, -(-int((total[0] or 0) + 64 * total[1]) * 2 // bucket_bytes))
    parts = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    work = work.withColumn("bucket", F.pmod(F.xxhash64(F.lit(0), "code"), F.lit(parts)))

    def resolve(table: pa.Table) -> pa.Table:
        own, best, count, _ = _classes(table)
        return pa.table({"link": table.column("link"), "keep_id": pa.array([best[i][1] for i in own], id_type), "group_size": pa.array([count[i] for i in own], pa.int64())})

    def combine(table: pa.Table) -> pa.Table:
        own, best, count, first = _classes(table)
        links = table.column("link").to_pylist()
        holds = [first[i] == r for r, i in enumerate(own)]
        return table.drop_columns(["salt"]).append_column("into", pa.array([links[first[i]] for i in own], pa.int64())).set_column(
            table.column_names.index("n"), "n", pa.array([count[i] if h else None for h, i in zip(holds, own)], pa.int64())
        ).set_column(table.column_names.index("best_chars"), "best_chars", pa.array([best[i][0] for i in own], pa.int64())).set_column(
            table.column_names.index("best_id"), "best_id", pa.array([best[i][1] for i in own], id_type)
        ).set_column(table.column_names.index("content"), "content", pa.array([c if h else None for h, c in zip(holds, table.column("content").to_pylist())], pa.binary()))

    answer = f"link bigint, keep_id {kind}, group_size bigint"
    for level in range(max_levels):
        sizes = work.groupBy("bucket").agg(F.sum(F.col("n_bytes") + 64).alias("size"), F.count("*").alias("rows"))
        large = sizes.filter((F.col("size") > bucket_bytes) & (F.col("rows") > 1))
        if level == max_levels - 1 or not large.limit(1).count():
            answers.append(work.groupBy("bucket").applyInArrow(resolve, answer))
            break
        large = written(large, "grace-large")
        answers.append(work.join(large, "bucket", "left_anti").groupBy("bucket").applyInArrow(resolve, answer))
        salted = work.join(large, "bucket").withColumn("salt", F.pmod(F.xxhash64("link", F.lit(level)), F.ceil(F.col("size") * 2 / bucket_bytes))).drop("size", "rows")
        columns = "link bigint, content binary, code bigint, n_bytes bigint, n bigint, best_chars bigint, best_id " + kind + ", bucket bigint, into bigint"
        names = [c.split()[0] for c in columns.split(", ")]
        done = written(salted.select(*names[:-1], "salt").groupBy("bucket", "salt").applyInArrow(combine, columns), "grace-combined")
        merged.append(done.filter("link != into").select("link", "into"))
        work = done.filter("content is not null").drop("into").withColumn("bucket", F.pmod(F.xxhash64(F.lit(level + 1), "code"), F.lit(fan_out)) + F.col("bucket") * fan_out)

    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    for step in reversed(merged):  # links that were combined at a level have the answer of the link they went into
        found = written(found, "grace-found")
        found = found.unionByName(step.join(found.withColumnRenamed("link", "into"), "into").drop("into"))
    return (
        spread.select("id", "link", "sha")
        .join(found, "link")
        .select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    )
