"""Pairs of points and items (points, triangles, segments) of a scene that have to meet, found by bounding boxes.

Scenes of bounded size are dealt to tasks in packs, each scene whole. A larger scene is cut, on both sides, into blocks of
neighbours with their boxes, and a block of points meets the blocks of items that its box can't rule out, some at a time. So
no task holds more than a pack, or a block and a chunk of blocks, however a scene's rows are spread or repeated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.scratch import held

LOW, HIGH = ["lx", "ly", "lz"], ["hx", "hy", "hz"]  #: the columns of an item's box
#: The shifts and masks that put two zero bits after each of 21 bits.
SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


@dataclass
class Sizes:
    scene_rows: int = 20_000  #: a scene with more rows than this on a side is cut into blocks
    scene_pairs: int = 16_000_000  #: and so is one with more pairs
    pack_rows: int = 40_000  #: rows of both sides in a pack, on average
    left_rows: int = 1_024  #: rows of a block of points
    right_rows: int = 512  #: rows of a block of items
    chunk: int = 16  #: blocks of items that a block of points meets at a time


def z_order(names: list[str], low: list[float], span: list[float]) -> Column:
    """The place of a point on a curve through the box that keeps neighbours together: bits of its coordinates in turn."""
    out = F.lit(0).cast("bigint")
    for k, (c, a, s) in enumerate(zip(names, low, span)):
        x = F.least(F.greatest(F.floor((F.col(c) - a) / (s or 1.0) * 2097151), F.lit(0)), F.lit(2097151)).cast("bigint")
        x = F.coalesce(x, F.lit(0).cast("bigint"))
        for shift, mask in SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(x, k))
    return out


def _numbered(batches, rows: int, fields: list[str]):
    """Sorted rows with the number of their block, of at most so many rows of one scene, and a number of their own."""
    first = TaskContext.get().partitionId() << 32
    block, row, held_rows, scene = first - 1, first, rows, None
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
        blocks = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if keys[a] != scene:
                scene, held_rows = keys[a], rows
            place = held_rows + np.arange(b - a)
            blocks.append(block + place // rows)
            block, held_rows = int(block + (held_rows + b - a - 1) // rows), (held_rows + b - a - 1) % rows + 1
        number = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number.astype(np.int64)), pa.array(np.arange(row, row + len(keys), dtype=np.int64))], names=[*fields, "block", "row"])
        row += len(keys)


def blocked(items: DataFrame, rows: int, centre: list[Column]) -> DataFrame:
    """items (first column: the scene) with a block of neighbours and a row number, as a checkpoint: both stay what they are if a task runs again."""
    fields = items.columns
    named = items.select("*", *[c.cast("double").alias(f"centre_{k}") for c, k in zip(centre, "xyz")])
    box = named.agg(*[f(f"centre_{k}").alias(f"{f.__name__}_{k}") for k in "xyz" for f in (F.min, F.max)], F.count("*").alias("n")).first()
    low = [box[f"min_{k}"] or 0.0 for k in "xyz"]
    span = [(box[f"max_{k}"] or 0.0) - a for k, a in zip("xyz", low)]
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + box.n // (rows * 256))
    place = named.withColumn("z_order", z_order([f"centre_{k}" for k in "xyz"], low, span)).drop(*[f"centre_{k}" for k in "xyz"])
    keys = [fields[0], "z_order", fields[1]]
    dealt = place.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*fields)
    schema = StructType([*items.schema.fields, *StructType.fromDDL("block bigint, row bigint").fields])
    return held(dealt.mapInArrow(lambda it: _numbered(it, rows, fields), schema))


def boxes(rows: DataFrame, key: str, low: list[str], high: list[str], *more: Column) -> DataFrame:
    """(key, block, rows, lx .. hz, more): the box of each block."""
    edges = [*[F.min(c).alias(n) for c, n in zip(low, LOW)], *[F.max(c).alias(n) for c, n in zip(high, HIGH)]]
    return rows.groupBy(key, "block").agg(F.count("*").alias("rows"), *edges, *more)


def matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1).reshape(table.num_rows, len(names))


def between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the least and of the largest distance of boxes (n x 6: low, high) to boxes (m x 6)."""
    near, far = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for k in range(3):
        al, ah, bl, bh = a[:, k, None], a[:, k + 3, None], b[None, :, k], b[None, :, k + 3]
        near += np.maximum(0, np.maximum(bl - ah, al - bh)) ** 2
        far += np.maximum(ah - bl, bh - al) ** 2
    return near, far


def in_reach(a: np.ndarray, b: np.ndarray, rows: np.ndarray, k: int = 1) -> np.ndarray:
    """Which boxes b (with so many rows each) can hold one of the k nearest rows of some point in a box of a.

    The k nearest of a point are no farther than the far ends of the boxes that, from the nearest such end on, hold k rows."""
    near, far = between(a, b)
    if k == 1:
        limit = far.min(1)
    else:
        order = np.argsort(far, 1)
        enough = (np.cumsum(rows[order], 1) >= k).argmax(1)
        limit = np.take_along_axis(far, order, 1)[np.arange(len(a)), enough]
        limit[rows.sum() < k] = np.inf
    return near <= limit[:, None] * (1 + 1e-9) + 1e-300


PAIRS = "block bigint, r_block bigint, chunk int, several boolean"


def _reach(a: pa.Table, b: pa.Table, k: int, chunk: int) -> pa.Table:
    """(block, r_block, chunk, several) of the boxes of one share."""
    p, q = matrix(a, LOW + HIGH), matrix(b, LOW + HIGH)
    rows, left, right = (t.column(c).to_numpy() for t, c in ((b, "rows"), (a, "block"), (b, "block")))
    out = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
    step = max(1, 1_000_000 // max(1, len(q)))
    for at in range(0, len(p) if len(q) else 0, step):
        i, j = np.nonzero(in_reach(p[at : at + step], q, rows, k))
        out[0].append(i + at)
        out[1].append(j)
    i, j = (np.concatenate(o) for o in out)
    many = np.bincount(i, minlength=len(p))
    place = np.arange(len(i)) - (np.cumsum(many) - many)[i]
    return pa.table({"block": left[i], "r_block": right[j], "chunk": (place // chunk).astype(np.int32), "several": many[i] > chunk})


def within_reach(a: pa.Table, b: pa.Table, most: float, chunk: int) -> pa.Table:
    """(block, r_block, chunk, several) of the boxes of one share that are not farther apart than `most`."""
    left, right = (t.column("block").to_numpy() for t in (a, b))
    near = between(matrix(a, LOW + HIGH), matrix(b, LOW + HIGH))[0]
    i, j = np.nonzero(near <= most * most * (1 + 1e-9))
    many = np.bincount(i, minlength=len(left))
    place = np.arange(len(i)) - (np.cumsum(many) - many)[i]
    return pa.table({"block": left[i], "r_block": right[j], "chunk": (place // chunk).astype(np.int32), "several": many[i] > chunk})


def candidates(left: DataFrame, right: DataFrame, key: str, run, schema: str, share: int = 256) -> DataFrame:
    """run(boxes of a share of a scene's left blocks, all boxes of its right blocks) for every share."""
    shares = left.groupBy(key).agg(F.ceil(F.count("*") / share).alias("shares"))
    a = left.join(shares, key).withColumn("share", F.pmod(F.xxhash64("block"), F.col("shares"))).drop("shares")
    b = right.join(shares, key).withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))).drop("shares")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])
    return a.groupBy(key, "share").cogroup(b.groupBy(key, "share")).applyInArrow(run, schema)


Run = Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, dict[str, np.ndarray]]]


def _columns(table: pa.Table, skip: set[str]) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names if c not in skip}


def _results(a: pa.Table, index: np.ndarray, found: dict[str, np.ndarray], names: list[str], schema: pa.Schema) -> pa.Table:
    """The rows of a with what was found for them; those without anything once, with nulls."""
    alone = np.ones(a.num_rows, bool)
    alone[index] = False
    alone = np.flatnonzero(alone)
    rows = pa.array(np.concatenate([index, alone]))
    out = {c: a.column(c).take(rows).cast(schema.field(c).type) for c in names}
    for c, values in found.items():
        out[c] = pa.concat_arrays([pa.array(values, schema.field(c).type), pa.nulls(len(alone), schema.field(c).type)])
    return pa.table(out, schema=schema)


def by_scene(a: pa.Table, b: pa.Table, key: str):
    """(order of a, order of b, (from, to) of each scene of a in the first, (from, to) in the second)."""
    both = pa.chunked_array([*a.column(key).chunks, *b.column(key).chunks], a.schema.field(key).type).combine_chunks()
    codes = both.dictionary_encode().indices if len(both) else pa.array([], pa.int32())
    # rows without a scene meet nothing
    left, right = (c.fill_null(v).to_numpy(zero_copy_only=False) for c, v in ((codes[: a.num_rows], -1), (codes[a.num_rows :], -2)))
    order_a, order_b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    scenes = np.unique(left)
    at_a, at_b = (np.stack([np.searchsorted(v, scenes, side) for side in ("left", "right")], 1) for v in (left[order_a], right[order_b]))
    return order_a, order_b, at_a, at_b


def _pack(a: pa.Table, b: pa.Table, run: Run, key: str, coordinates: list[str], names: list[str], schema: pa.Schema) -> pa.Table:
    """run for each scene of a pack."""
    order_a, order_b, at_a, at_b = by_scene(a, b, key)
    points = matrix(a, coordinates)[order_a]
    items = {c: v[order_b] for c, v in _columns(b, {key, "pack"}).items()}
    index, found = [np.zeros(0, np.int64)], []
    for (a0, a1), (b0, b1) in zip(at_a, at_b):
        sound = a0 + np.flatnonzero(np.isfinite(points[a0:a1]).all(1))
        if b1 > b0 and len(sound):
            i, values = run(points[sound], {c: v[b0:b1] for c, v in items.items()})
            index.append(order_a[sound[i]])
            found.append(values)
    values = {c: np.concatenate([f[c] for f in found]) for c in found[0]} if found else {c: np.zeros(0) for c in schema.names if c not in names}
    return _results(a, np.concatenate(index), values, names, schema)


def _block(a: pa.Table, b: pa.Table, run: Run, coordinates: list[str], names: list[str], schema: pa.Schema) -> pa.Table:
    index, found = run(matrix(a, coordinates), _columns(b, {"block", "chunk"}))
    return _results(a, index, found, names, schema)


@dataclass
class Reach:
    """How blocks are picked that meet: find(left boxes, right boxes) gives PAIRS and the columns of schema; rows without an r_block stand for far blocks."""

    find: Callable[[pa.Table, pa.Table], pa.Table]
    schema: str
    summary: tuple[Column, ...] = ()  #: what the boxes of the right side tell besides


def met(
    left: DataFrame, right: DataFrame, run: Run, results: str, merge: Callable[[DataFrame], DataFrame], k: int = 1, sizes: Sizes | None = None,
    reach: Reach | None = None, more: tuple[str, ...] = (),
) -> DataFrame:
    """left (scene, id, x, y, z and more) with the columns `results` that run gives for its points and the items of its scene.

    The first column of both sides is the scene. Items have the box lx .. hz and what run needs. run gets points (x, y, z and the columns `more` of left) and items
    and gives, for places among the points, the results; rows without any, and points with a coordinate that is null or not finite, get nulls. A point that meets its items in several chunks has
    results of each, which merge puts together: it gets them with `row`, the point's number. Without a reach, blocks meet that can hold one of
    the k nearest items of a point (in_reach)."""
    sizes = sizes or Sizes()
    key, names, coordinates = left.columns[0], left.columns, ["x", "y", "z", *more]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, where both sides come from one table
    n = left.groupBy(key).agg(F.count("*").alias("n_left")).join(right.groupBy(key).agg(F.count("*").alias("n_right")), key, "left").fillna(0, ["n_right"])
    big = (F.col("n_left") > sizes.scene_rows) | (F.col("n_right") > sizes.scene_rows) | (F.col("n_left") * F.col("n_right") > sizes.scene_pairs)
    n = held(n.withColumn("big", big))
    total = n.agg(F.sum(F.when(~F.col("big"), F.col("n_left") + F.col("n_right"))).alias("rows"), F.count_if("big").alias("big")).first()
    small_left, small_right = left, right
    added = StructType.fromDDL(results)
    schema = StructType([*left.schema.fields, *added.fields])
    arrow = _arrow(schema)
    if total.big:
        small_left, small_right = (df.join(n.filter("big").select(key), key, "left_anti").select(*df.columns) for df in (left, right))
    packs = 1 + (total.rows or 0) // sizes.pack_rows
    pack = lambda df: df.withColumn("pack", F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.xxhash64(df.columns[1]).cast("string"))), F.lit(packs))).groupBy("pack")
    out = pack(small_left).cogroup(pack(small_right)).applyInArrow(lambda a, b: _pack(a, b, run, key, coordinates, names, arrow), schema)
    if not total.big:
        return out
    large = n.filter("big")
    of = lambda df, keep: df.join(large.filter(keep).select(key), key, "left_semi").select(*df.columns)
    sound = F.lit(True)
    for c in coordinates:
        sound = sound & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    lone = of(left, "n_right = 0").unionByName(of(left.filter(~sound), "n_right > 0")).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    p = blocked(of(left.filter(sound), "n_right > 0"), sizes.left_rows, [F.col(c) for c in "xyz"])
    q = blocked(of(right, "n_right > 0"), sizes.right_rows, [(F.col(a) + F.col(b)) / 2 for a, b in zip(LOW, HIGH)])
    reach, how = reach or Reach(lambda a, b: _reach(a, b, k, sizes.chunk), ""), "inner" if reach is None else "right"
    found_boxes = boxes(p, key, list("xyz"), list("xyz")), boxes(q, key, LOW, HIGH, *reach.summary)
    pairs = held(candidates(*found_boxes, key, reach.find, ", ".join(x for x in (PAIRS, reach.schema) if x)))
    a = p.join(pairs.select("block", "chunk", "several").distinct(), "block")
    b = q.withColumnRenamed("block", "r_block").drop(key, "row").join(pairs, "r_block", how).drop("r_block", "several")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])
    partial = StructType([*left.schema.fields, *StructType.fromDDL("row bigint, several boolean").fields, *added.fields])
    partial_arrow, kept = _arrow(partial), [*names, "row", "several"]
    found = a.groupBy("block", "chunk").cogroup(b.groupBy("block", "chunk")).applyInArrow(lambda s, t: _block(s, t, run, coordinates, kept, partial_arrow), partial)
    found = held(found)
    once = found.filter("not several").select(*names, *added.names)
    return out.unionByName(lone).unionByName(once).unionByName(merge(found.filter("several")).select(*names, *added.names))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# -- inside a task


def curve_order(points: np.ndarray, bits: int = 10) -> np.ndarray:
    """The order of points along a curve that keeps neighbours together."""
    low = points.min(0)
    q = ((points - low) / np.maximum(points.max(0) - low, 1e-300) * (2**bits - 1)).astype(np.int64)
    code = np.zeros(len(points), np.int64)
    for b in range(bits):
        for k in range(3):
            code |= (q[:, k] >> b & 1) << (3 * b + k)
    return np.argsort(code, kind="stable")


def runs_of(order: np.ndarray, rows: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, boxes n x 6) of the runs of so many rows in that order."""
    starts = np.arange(0, len(order), rows)
    return starts, np.concatenate([np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)], 1)


def expanded(hit: np.ndarray, order_a: np.ndarray, starts_a: np.ndarray, order_b: np.ndarray, starts_b: np.ndarray, most: int):
    """(places in a, places in b) of all pairs of the runs that hit marks, about `most` pairs at a time and those of a point together."""
    size_a, size_b = np.diff(np.append(starts_a, len(order_a))), np.diff(np.append(starts_b, len(order_b)))
    at = 0
    per = size_a * (hit @ size_b)
    while at < len(starts_a):
        to = max(at + 1, int(np.searchsorted(np.cumsum(per[at:]), most, "right")) + at)
        i, j = np.nonzero(hit[at:to])
        i += at
        n = size_a[i] * size_b[j]
        pair = np.repeat(np.arange(len(i)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        yield order_a[starts_a[i[pair]] + place // size_b[j[pair]]], order_b[starts_b[j[pair]] + place % size_b[j[pair]]]
        at = to


def least_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray, middle: np.ndarray, reach: np.ndarray, exact, counts: list | None = None) -> np.ndarray:
    """The least squared distance of each point to items with these boxes; middle: a place on each item, no farther from any other than reach.

    Points meet the runs of neighbouring items that can be nearest by their boxes, and of these pairs only those whose
    sphere lets them be nearer than the nearest middle are measured by exact(point places, item places). counts gets (pairs met, pairs measured)."""
    best = np.full(len(points), np.inf)
    order = curve_order(middle)
    starts, box = runs_of(order, 8, low, high)
    step = max(1, 1_000_000 // len(box))
    for at in range(0, len(points), step):
        part = points[at : at + step]
        hit = in_reach(np.concatenate([part, part], 1), box, np.ones(len(box)))
        for i, j in expanded(hit, np.arange(at, at + len(part)), np.arange(len(part)), order, starts, 500_000):
            off = np.sqrt(((points[i] - middle[j]) ** 2).sum(1))
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            nearest = np.minimum.reduceat(off, first)
            keep = off - reach[j] <= np.repeat(nearest, np.diff(np.append(first, len(i)))) * (1 + 1e-9) + 1e-12
            np.minimum.at(best, i[keep], exact(i[keep], j[keep]))
            if counts is not None:
                counts.append((len(i), int(keep.sum())))
    return best
