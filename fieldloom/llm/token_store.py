"""Token ids in binary shards: one zstandard frame per document, a shared dictionary, and an offset index.

A shard file: the header (MAGIC, width of an id in bytes, number of documents, SHA-256 of the dictionary), the frames
end to end, then the index (for each document: id, where its frame starts, its length, number of ids) and the
index's place. A document is read by its index entry alone, with the dictionary whose hash the header names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import FORGET, pieces, released, scratch_path, utf8, written

MAGIC = b"TOKSHRD1"
HEADER = struct.Struct("<8sIQ32s")
TRAILER = struct.Struct("<QQ8s")
INDEX = np.dtype([("doc_id", "<i8"), ("at", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
WORDS_HELD = 600_000  #: words whose ids a worker remembers; forgotten all at once when full
#: White space and separators in ASCII, and the first bytes of characters that are white space in Unicode.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
MAYBE_BLANK = BLANK.copy()
MAYBE_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True

_loaded: dict[str, Encoder] = {}
FORGET.append(_loaded.clear)


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places where a byte-level pre-tokenizer always cuts, which texts have a blank for which that isn't sure).

    It cuts before a blank (unless that stands between other white space), on both sides of a single line feed,
    and before a full stop or comma between an ASCII letter and white space or the end. What stands on one
    side of such a place does not change the tokens on the other."""
    n = len(data)
    before, after = np.full(n, 32, np.uint8), np.full(n, 32, np.uint8)
    before[1:], after[:-1] = data[:-1], data[1:]
    first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    before[first], after[last] = 97, 32

    def behind_blank(at):
        p1, p2, p3 = before[at], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        return BLANK[p1] | ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 >= 0xE1) & (p3 <= 0xE3) & ((p2 == 0x80) | (p2 == 0x81) | (p2 == 0x9A)))

    blanks = np.flatnonzero(data == 32)
    unsafe = blanks[MAYBE_BLANK[after[blanks]]]
    unsafe = unsafe[behind_blank(unsafe)]
    feeds = np.flatnonzero((data == 10) & ~MAYBE_BLANK[after])
    feeds = feeds[~behind_blank(feeds)]
    stops = np.flatnonzero(((data == 46) | (data == 44)) & BLANK[after] & LETTER[before])
    mark = np.zeros(n + 1, bool)
    for at in (blanks, feeds, feeds + 1, stops, offsets):
        mark[at] = True
    return np.flatnonzero(mark), np.unique(np.searchsorted(offsets, unsafe, "right") - 1)


class Encoder:
    """Ids of texts by the tokenizers library.

    Under a byte-level pre-tokenizer without a prefix blank, each distinct piece between sure cuts is encoded
    once and its ids are gathered. Texts for which a cut is not sure, and all texts under other tokenizers,
    are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        pre = model.get("pre_tokenizer") or {}
        added = [t["content"] for t in model.get("added_tokens", [])]
        self.by_piece = model.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(set(" \n.,") & set(t) for t in added) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in model.get("added_tokens", []))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.held: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def look_up(self, names: list[str]) -> list[bytes]:
        """The ids of each piece, as native integers."""
        if len(self.held) > WORDS_HELD:
            self.held.clear()
        new = [p for p in names if p not in self.held]
        code = "H" if self.width == 2 else "I"
        self.held.update(zip(new, (array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return [self.held[p] for p in names]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts in them); a null is empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        data, offsets = utf8(texts)
        places, unsafe = cuts(data, offsets) if self.by_piece else (None, np.arange(len(texts)))
        if len(unsafe) == len(texts):
            ids = self.whole(texts.to_pylist())
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, ids)])
        if len(unsafe):
            safe = np.setdiff1d(np.arange(len(texts)), unsafe)
            some, at = self.encode(texts.take(pa.array(safe)))
            ids: list = [None] * len(texts)
            for k, i in enumerate(safe):
                ids[i] = some[at[k] : at[k + 1]]
            for i, x in zip(unsafe, self.whole(texts.take(pa.array(unsafe)).to_pylist())):
                ids[i] = x
            return np.concatenate(ids), np.cumsum([0, *map(len, ids)])
        parts = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        slot = np.asarray(parts.indices).astype(np.int64)
        own = self.look_up(parts.dictionary.to_pylist())
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // self.width
        flat = np.frombuffer(b"".join(own), np.uint16 if self.width == 2 else np.uint32)
        bounds = np.searchsorted(places, offsets)
        starts = np.cumsum(lengths) - lengths
        count = lengths[slot]
        ends = np.cumsum(count)
        ids = flat[np.repeat(starts[slot] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[bounds]


def filesystem(folder: str):
    """(pyarrow file system, path) of a URI. Hadoop's names of S3 (s3a, s3n) are read as s3."""
    folder = re.sub(r"^s3[an]://", "s3://", folder)
    return pafs.FileSystem.from_uri(folder if re.match(r"[a-z0-9+.-]+://|file:", folder) else f"file://{folder}")


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, sample_rows: int, sample_bytes: int, size: int) -> tuple[bytes, int]:
    """A dictionary from the id arrays of a sample, of the first sample_rows rows by hash those that fit, whole, into sample_bytes of text; and the bytes of all texts, counted on the way.

    A text that does not fit is skipped, and one of more than a sixteenth of the bytes never enters, so that no single text displaces the others."""
    counted = Observation()
    sample = docs.observe(counted, F.sum(F.octet_length(text_col)).alias("bytes")).select(F.xxhash64(F.lit(3), F.col(id_col), F.length(text_col)).alias("h"), F.col(id_col).alias("id"), F.octet_length(text_col).alias("bytes")).filter(F.col("bytes") <= sample_bytes // 16)
    room, ids = sample_bytes, set()
    for r in sample.orderBy("h", "id", "bytes").limit(sample_rows).collect():  # ids and sizes of at most sample_rows rows
        if r.bytes <= room and r.id is not None and (r.id, r.bytes) not in ids:
            ids.add((r.id, r.bytes))
            room -= r.bytes
    total = counted.get["bytes"] or 0
    near = docs.sparkSession.createDataFrame(sorted(ids), "sample_id bigint, sample_bytes int")
    texts = docs.join(F.broadcast(near), (F.col(id_col) == F.col("sample_id")) & (F.octet_length(text_col) == F.col("sample_bytes")))
    texts = texts.groupBy("sample_id", "sample_bytes").agg(F.min(text_col).alias("text"))  # one text for each: sample_bytes at most
    enc = encoder(tokenizer)
    texts = sorted(r.text for r in texts.collect() if r.text)
    if not texts:
        return b"", total
    frames = []
    for batch in pieces([pa.record_batch([pa.array(texts, pa.string())], ["text"])], 0, 1 << 20):
        ids, at = enc.encode(batch.column(0))
        ids = np.insert(ids, at[1:], end_id).astype(f"<u{enc.width}")
        at = at + np.arange(len(at))
        frames += [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
    try:
        return zstandard.train_dictionary(size, frames).as_bytes(), total
    except zstandard.ZstdError:  # too few samples: without a dictionary
        return b"", total


def _write_shard(batches, folder: str, tokenizer: str, dictionary: bytes, end_id: int, level: int, batch_bytes: int):
    key = hashlib.sha256(dictionary).digest()
    enc = encoder(tokenizer)
    pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
    fs, root = filesystem(folder)
    name, out, index, at, total, least = uuid.uuid4().hex, None, [], HEADER.size, 0, None
    for batch in pieces(batches, 1, batch_bytes):
        if out is None:
            out = fs.open_output_stream(f"{root}/{name}.part")
            out.write(b"\0" * HEADER.size)
        ids, bounds = enc.encode(batch.column(1))
        ids = np.insert(ids, bounds[1:], end_id).astype(f"<u{enc.width}")
        bounds = bounds + np.arange(len(bounds))
        raw = memoryview(ids.view(np.uint8))
        keys = batch.column(0).fill_null(-(2**63)).to_pylist()
        rows = np.zeros(len(keys), INDEX)
        frames = [pack.compress(raw[a * enc.width : b * enc.width]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        sizes = np.fromiter(map(len, frames), np.int64, len(frames))
        rows["doc_id"], rows["at"], rows["length"], rows["n_tokens"] = keys, at + np.cumsum(sizes) - sizes, sizes, np.diff(bounds)
        out.write(b"".join(frames))
        index.append(rows)
        at, total = at + int(sizes.sum()), total + len(ids)
        least = keys[0] if least is None else least
    if out is None:
        return
    rows = np.concatenate(index)
    out.write(rows.tobytes())
    out.write(TRAILER.pack(at, len(rows), MAGIC))
    out.write(HEADER.pack(MAGIC, enc.width, len(rows), key))  # the last bytes: streams of object stores cannot go back to the start
    out.close()
    fs.move(f"{root}/{name}.part", f"{root}/{name}.tok")
    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.tok"]), pa.array([least], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([total], pa.int64())], names=["path", "least", "n_docs", "n_tokens"])


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None,
    level: int = 3, sample_rows: int = 2_000, sample_bytes: int = 8 << 20, dictionary_bytes: int = 112_640, batch_bytes: int = 3 << 20, shard_bytes: int = 256 << 20,
) -> DataFrame:
    """Encode docs in ascending id order (null ids first, as the least 64-bit value) and write shards; the manifest (path, shard, n_docs, n_tokens).

    A null text is empty; every document ends with end_id, which must be below 2 ** (8 * width). Rows with equal ids are
    ordered by their text's hash. A shard is written under a name of its own and then renamed, so that a task that
    is lost or runs twice leaves either a whole file or none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dictionary, n_bytes = train_dictionary(docs, "id", "text", tokenizer, end_id, sample_rows, sample_bytes, dictionary_bytes)
    key = hashlib.sha256(dictionary).digest()
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{key.hex()}.dict") as out:
        out.write(dictionary)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n_bytes // shard_bytes)

    run = lambda batches: _write_shard(batches, folder, tokenizer, dictionary, end_id, level, batch_bytes)
    ordered = docs.repartitionByRange(shards, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    manifest = written(ordered.mapInArrow(run, "path string, least bigint, n_docs bigint, n_tokens bigint").withColumn("part", F.spark_partition_id()), "token-manifest")
    order = W.orderBy("part")  # a row for each shard, not for each document
    return manifest.select(
        "path", (F.row_number().over(order) - 1).cast("long").alias("shard"), "n_docs", "n_tokens",
        F.coalesce(F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )


class ShardReader:
    """Random access to one shard file."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.width, self.n, key = HEADER.unpack(self.file.read_at(HEADER.size, size - HEADER.size))
        place, n, magic_too = TRAILER.unpack(self.file.read_at(TRAILER.size, size - HEADER.size - TRAILER.size))
        if magic != MAGIC or magic_too != MAGIC or n != self.n:
            raise ValueError(f"{path} is not a whole token shard")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, place), INDEX)
        with fs.open_input_file(f"{path.rsplit('/', 1)[0]}/{key.hex()}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != key:
            raise ValueError("the dictionary does not have the hash that the shard names")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        e = self.index[k]
        return np.frombuffer(self.unpack.decompress(self.file.read_at(int(e["length"]), int(e["at"]))), f"<u{self.width}")

    def blocks(self, limit: int = 1 << 22):
        """(k, frames) of neighbouring documents, read together."""
        k = 0
        while k < self.n:
            to = max(k + 1, int(np.searchsorted(self.index["at"], self.index["at"][k] + np.uint64(limit))))
            first, last = self.index[k], self.index[to - 1]
            base = int(first["at"])
            data = self.file.read_at(int(last["at"]) + int(last["length"]) - base, base)
            for e in range(k, to):
                at = int(self.index["at"][e]) - base
                yield e, data[at : at + int(self.index["length"][e])]
            k = to


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    doc = [None if x == -(2**63) else x for x in columns[0]]
    arrays = [pa.array(doc, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:4])]
    arrays += [pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in columns[4:]]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def _read_shards(batches, with_ids: bool):
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader = ShardReader(*filesystem(path))
            starts = start + np.cumsum(reader.index["n_tokens"], dtype=np.int64) - reader.index["n_tokens"]
            rows = []
            for k, frame in reader.blocks():
                ids = np.frombuffer(reader.unpack.decompress(frame), f"<u{reader.width}").astype("<u4")
                rows.append((int(reader.index["doc_id"][k]), int(starts[k]), len(ids), zlib.crc32(ids), *([ids] if with_ids else [])))
                if len(rows) == 2000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files that the manifest lists."""
    spark = manifest.sparkSession

    run = lambda batches: released(_read_shards(batches, with_ids))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "start").repartition(parts).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def token_store(docs: DataFrame, tokenizer: str, folder: str | None = None, with_ids: bool = False, **options) -> DataFrame:
    """Write docs as token shards into folder (a new one in the shared folder by default) and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_tokens(write_tokens(docs, folder or scratch_path(spark, "tokens"), tokenizer, **options), with_ids)
