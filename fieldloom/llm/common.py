"""Helpers that the text operators share: scratch tables and byte views of Arrow text."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.scratch import drop_written, scratch_path, shared_folder, written  # noqa: F401  the operators take them from here

#: The ASCII white space that separates words.
WHITE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def perhaps_among(rows: DataFrame, keys: DataFrame, key: str, maps: int = 1024) -> DataFrame:
    """rows without most of those whose key is not in keys; none with a key in keys goes.

    The hashes of the keys are bits of at most `maps` bitmaps of 4 KB, which are broadcast: 4 MB at any size of keys. With n
    keys a foreign row stays with probability n / (32768 * maps) or less, so an exact join has to follow, which then shuffles few rows."""
    h = F.pmod(F.xxhash64(key), F.lit(32768 * maps))
    place, bit = F.shiftright(h, 15).alias("map_no"), h.bitwiseAND(F.lit(32767))
    bitmaps = keys.select(place, bit.alias("bit")).groupBy("map_no").agg(F.bitmap_construct_agg("bit").alias("map_bits"))
    byte = F.conv(F.hex(F.substring("map_bits", F.shiftright(F.col("map_bit"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.lit(1).cast("bigint")
    found = rows.withColumns({"map_no": place, "map_bit": bit}).join(F.broadcast(bitmaps), "map_no")
    return found.filter(F.floor(byte / F.pow(F.lit(2), F.col("map_bit").bitwiseAND(F.lit(7)))).bitwiseAND(one) == one).select(*rows.columns)


def with_count(rows: DataFrame, key: str, salt: Column, name: str, only: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """rows with the number of rows that have the same key (of the keys in `only`, if given).

    Rows meet their key's count by (key, salt), and a count is there for salts that occur only: a key with very many rows is spread over `salts` tasks."""
    rows = rows.withColumn("salt_no", F.pmod(salt, F.lit(salts)))
    total = rows.groupBy(key, "salt_no").agg(F.count("*").alias("own")).groupBy(key).agg(F.sum("own").alias(name), F.collect_list("salt_no").alias("salt_nos"))
    if only is not None:
        total = total.join(only, key, "left_semi")
    return rows.join(total.select(key, name, F.explode("salt_nos").alias("salt_no")), [key, "salt_no"]).drop("salt_no")


def released(batches):
    """The batches; at their end memory that the worker no longer needs goes back to the system, as workers live on through the stages of a job."""
    try:
        yield from batches
    finally:
        for forget in FORGET:
            forget()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches, column: int, limit: int):
    """Record batches cut so that each holds about limit bytes of the text in that column, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(utf8(batch.column(column))[1])
        at = 0
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def word_codes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end, document) of every word, in order, for texts laid end to end.

    Words are runs of bytes other than ASCII white space, and end where their document ends.
    Each hash is a polynomial of the word's bytes with random 64-bit letters, scrambled with its length.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    letters = LETTERS_LOWER if lower else LETTERS
    np.cumsum(letters[data] * powers(n), out=total[1:])
    code = (total[b] - total[a]) * inverse_powers(n)[a]
    code = mix64(code + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(offsets, a, "right") - 1
    return code, a, b, doc


def range_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges from starts to ends of one array, made as those of word_codes are."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers(len(data)), out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse_powers(len(data) + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: ASCII for matching words: capitals as small letters, all but letters and digits as blanks.
READ = np.arange(256, dtype=np.uint8)
READ[65:91] += 32
READ[[c for c in range(128) if not chr(c).isalnum()]] = 32
SPACE = np.zeros(256, bool)
SPACE[list(WHITE)] = True
LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTERS_LOWER = LETTERS.copy()
LETTERS_LOWER[65:91] = LETTERS[97:123]
_BASE = 0xE3D1F5C6A4B29867 | 1
_powers: dict[str, np.ndarray] = {}
#: What released() calls: each drops a cache that workers keep.
FORGET = [_powers.clear]
KEPT = 1 << 21  #: entries of a table of powers that a worker keeps


def _geometric(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        at, step = 1, base % 2**64
        while at < size:  # doubling: the second half is the first times base ** at
            out[at : 2 * at] = out[:at] * np.uint64(step)
            step = step * step % 2**64
            at *= 2
        have = out
        if size <= KEPT:  # the table for a very long text goes with it
            _powers[name] = out
    return have[:n]


def powers(n: int) -> np.ndarray:
    return _geometric("up", _BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _geometric("down", pow(_BASE, -1, 2**64), n)
