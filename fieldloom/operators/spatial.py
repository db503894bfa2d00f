"""Nearest-neighbour, radius and slab joins within scenes, and the scores made from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.functions.scalars import finite
from fieldloom.operators.bounding import HIGH, LOW, Sizes, met
from fieldloom.scratch import held, written  # noqa: F401  other modules take held from here


def _cells(df: DataFrame, size: float, prefix: str) -> DataFrame:
    return df.select("*", *[F.floor(F.col(k) / size).alias(f"{prefix}{k}") for k in "xyz"])


def _around(df: DataFrame, size: float) -> DataFrame:
    """Each row once for its cell and the 26 around it."""
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    out = _cells(df, size, "c")
    for k in "xyz":
        out = out.withColumn("step", steps).withColumn(f"c{k}", F.col(f"c{k}") + F.col("step")).drop("step")
    return out


def _d2(a: str = "", b: str = "r_") -> Column:
    return sum((F.col(f"{a}{k}") - F.col(f"{b}{k}")) ** 2 for k in "xyz")


def _least(points: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """The place of the nearest row of q for each point, ties by the first; None if rounding leaves too many of them open.

    A product of matrices finds the rows that may be nearest, within a bound of its rounding errors, and only these are measured as differences."""
    squares = (q * q).sum(1)
    size = (points * points).sum(1).max() + squares.max()
    rough = points @ (-2 * q).T
    rough += squares
    j = rough.argmin(1)
    hit = rough <= (rough[np.arange(len(points)), j] + 64 * np.finfo(float).eps * size)[:, None]
    found = np.count_nonzero(hit)
    if not np.isfinite(size) or found > 4 * len(points):
        return None
    if found == len(points):
        return j
    i, j = np.nonzero(hit)
    d2 = sum((points[i, c] - q[j, c]) ** 2 for c in range(3))
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    least = np.flatnonzero(d2 == np.repeat(np.minimum.reduceat(d2, first), np.diff(np.append(first, len(i)))))
    return j[least[np.unique(i[least], return_index=True)[1]]]


def nearest_places(points: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest row of q for each point, ties by the first, and its squared distance."""
    places = []
    step = max(1, 2_000_000 // len(q))
    for at in range(0, len(points), step):
        part = points[at : at + step]
        least = _least(part, q)
        places.append(np.argmin(sum((part[:, c, None] - q[None, :, c]) ** 2 for c in range(3)), 1) if least is None else least)
    place = places[0] if len(places) == 1 else np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
    return place, sum((points[:, c] - q[place, c]) ** 2 for c in range(3))


def _nearest(points: np.ndarray, items: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The k nearest items of each point, ties by the least id."""
    by_id = np.argsort(items["r_id"], kind="stable")  # so the stable order of equal distances is that of ids
    ids, q = items["r_id"][by_id], np.stack([items[c][by_id] for c in LOW], 1)
    if k == 1 and len(q):
        place, d2 = nearest_places(points, q)
        return np.arange(len(points)), {"rank": np.ones(len(points), np.int32), "r_id": ids[place].astype(np.int64), "d2": d2}
    index, found, ranks, d2s = [], [], [], []
    step = max(1, 2_000_000 // max(1, len(q)))
    for at in range(0, len(points) if len(q) else 0, step):
        part = points[at : at + step]
        d2 = sum((part[:, c, None] - q[None, :, c]) ** 2 for c in range(3))
        near = np.argsort(d2, 1, kind="stable")[:, :k]
        index.append(np.repeat(np.arange(at, at + len(d2)), near.shape[1]))
        ranks.append(np.tile(np.arange(1, near.shape[1] + 1), len(d2)))
        found.append(ids[near.ravel()])
        d2s.append(np.take_along_axis(d2, near, 1).ravel())
    index, ranks, found = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (index, ranks, found))
    return index, {"rank": ranks.astype(np.int32), "r_id": found, "d2": np.concatenate([*d2s, np.zeros(0)])}


def neighbours(left: DataFrame, right: DataFrame, k: int = 1, block_rows: int = 512, whole_rows: int = 20_000, share_rows: int = 1_024) -> DataFrame:
    """(scene_id, point_id, x, y, z, rank, r_id, d2): the k nearest points of right in the scene, ties by the least id; nulls without one.

    Points with a coordinate that is null or not finite have no neighbours and are nobody's.

    Scenes of at most whole_rows points a side are searched whole, many in a task. Others are cut into blocks of neighbours, share_rows of
    left and block_rows of right at most, and a block of left meets those of right whose boxes can hold one of the k nearest (see bounding.met)."""
    p = left.select("scene_id", F.col("point_id").cast("bigint").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    q = right.select("scene_id", F.col("point_id").cast("bigint").alias("r_id"), *[F.col(c).cast("double").alias(n) for c, n in zip("xyz" * 2, LOW + HIGH)])
    for c in LOW:
        q = q.filter(finite(c))

    def merge(rows):
        first = W.partitionBy("row").orderBy("d2", "r_id")
        return rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)

    sizes = Sizes(scene_rows=whole_rows, left_rows=share_rows, right_rows=block_rows)
    return met(p, q, lambda a, b: _nearest(a, b, k), "rank int, r_id bigint, d2 double", merge, k, sizes)


def nearest_join(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """left (scene_id, point_id, x, y, z) with nearest_id and distance of the nearest point of right in the scene; ties: the least id (see neighbours)."""
    return neighbours(left, right, 1, **options).select("scene_id", "point_id", F.col("r_id").alias("nearest_id"), F.sqrt("d2").alias("distance"))


def columns_of(table: pa.Table, *names: str) -> np.ndarray:
    """The columns side by side, as double."""
    return np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1).reshape(table.num_rows, len(names))


def radius_sum(queries: DataFrame, weights: DataFrame, radius: float) -> DataFrame:
    """The sum of mass within a ball around each query, by a join on the 27 cells of the radius's size, never through the driver: 27 copies of the queries are more than Spark reckons with."""
    size = radius * (1 + 1e-9)  # so that no pair within the radius is two cells apart by rounding
    w = weights.select("scene_id", "mass", *[F.col(k).alias(f"r_{k}") for k in "xyz"], *[F.floor(F.col(k) / size).alias(f"c{k}") for k in "xyz"])
    hit = _around(queries.select("scene_id", "point_id", "x", "y", "z"), size).join(w.hint("merge"), ["scene_id", "cx", "cy", "cz"]).filter(_d2() <= radius * radius)
    return hit.groupBy("scene_id", "point_id").agg(F.sum("mass").alias("mass"), F.count("*").alias("n"))


def points_in_slab(points: DataFrame, planes: DataFrame, half: float) -> DataFrame:
    """Rows of points with those of planes (scene_id, plane_id, o*, n*: unit normal) that are at most `half` off, and their depth (p - o) . n.

    Planes of one normal are stacked by bins of their place along it, so points meet three bins of each stack of their scene: an
    equi-join instead of a range join. The stacks of a scene are few; its points are copied once for each."""
    width, stack = 2 * half, [F.round(F.col("n" + k), 12).alias("s" + k) for k in "xyz"]
    along = lambda p, n: sum(F.col(p + k) * F.col(n + k) for k in "xyz")
    listed = planes.withColumns({"sx": stack[0], "sy": stack[1], "sz": stack[2]})
    listed = listed.withColumn("bin", F.floor(along("o", "s") / width))
    stacks = listed.select("scene_id", "sx", "sy", "sz").distinct()
    p = points.join(stacks, "scene_id").withColumn("bin", F.explode(F.array(*[F.floor(along("", "s") / width) + i for i in (-1, 0, 1)])))
    j = p.join(listed.hint("merge"), ["scene_id", "sx", "sy", "sz", "bin"])
    depth = sum((F.col(k) - F.col("o" + k)) * F.col("n" + k) for k in "xyz")
    return j.withColumn("depth", depth).filter(F.abs("depth") <= half).drop("bin", "sx", "sy", "sz")


def sides(a: DataFrame, b: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Points of two sides (scene_id, point_id, x, y, z, and those of the columns `more` that b has), made once and read again from one table of the shared folder: each step that follows reads both."""
    names = ["scene_id", "point_id", "x", "y", "z"]
    both = a.select(*names, F.lit(True).alias("first")).unionByName(b.select(*names, *more, F.lit(False).alias("first")), allowMissingColumns=True)
    both = written(both, "sides")
    return both.filter("first").select(*names), both.filter("not first").select(*names, *more)


def directed(a: DataFrame, b: DataFrame, tau: float | DataFrame) -> DataFrame:
    """Per scene of a: the mean and the largest distance to b, and the share nearer than tau, a number or a table (scene_id, tau)."""
    near = nearest_join(a, b)
    near = near.join(tau.hint("shuffle_hash"), "scene_id", "left") if isinstance(tau, DataFrame) else near.withColumn("tau", F.lit(tau))
    return near.groupBy("scene_id").agg(F.avg("distance").alias("mean"), F.max("distance").alias("most"), F.avg((F.col("distance") < F.col("tau")).cast("double")).alias("share"))


def share_of_diagonal(points: DataFrame, share: float = 0.01) -> DataFrame:
    """(scene_id, tau): a share of the diagonal of each scene's box."""
    side = [(F.max(k) - F.min(k)) * (F.max(k) - F.min(k)) for k in "xyz"]
    return points.groupBy("scene_id").agg((share * F.sqrt(side[0] + side[1] + side[2])).alias("tau"))


def surface_scores(gt: DataFrame, pred: DataFrame, tau: float | None = None) -> DataFrame:
    """Per scene: chamfer (half the sum of the mean distances), chamfer_sum, hausdorff, precision, recall and f1 at tau (without: 1 % of gt's diagonal).

    All are null in a scene of which one side is empty. Both sides are made once (see sides)."""
    gt, pred = sides(gt, pred)
    limit = share_of_diagonal(gt) if tau is None else tau
    f, b = directed(gt, pred, limit), directed(pred, gt, limit)
    j = f.select("scene_id", F.col("mean").alias("m1"), F.col("most").alias("h1"), F.col("share").alias("recall")).join(b.select("scene_id", F.col("mean").alias("m2"), F.col("most").alias("h2"), F.col("share").alias("precision")), "scene_id", "full")
    total, both = F.col("precision") + F.col("recall"), F.col("m1").isNotNull() & F.col("m2").isNotNull()
    scores = {
        "chamfer": (F.col("m1") + F.col("m2")) / 2,
        "chamfer_sum": F.col("m1") + F.col("m2"),
        "hausdorff": F.greatest("h1", "h2"),
        "precision": F.col("precision"),
        "recall": F.col("recall"),
        "f1": F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total),
    }
    return j.select("scene_id", *[F.when(both, v).alias(k) for k, v in scores.items()])


def on_grid(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Rows (scene_id, sdf_pred, sdf_gt) of two tables (scene_id, ix, iy, iz, sdf), joined by the grid's cell and not by position."""
    keys = ["scene_id", "ix", "iy", "iz"]
    return pred.select(*keys, F.col("sdf").alias("sdf_pred")).join(gt.select(*keys, F.col("sdf").alias("sdf_gt")), keys)


def overlap(grid: DataFrame, level: float = 0.0, eps: float = 1e-8) -> DataFrame:
    """Dice and IoU of sdf_pred <= level and sdf_gt <= level; the grid's rows carry both, joined by cell."""
    p, g = F.col("sdf_pred") <= level, F.col("sdf_gt") <= level
    n = grid.groupBy("scene_id").agg(F.count_if(p & g).alias("both"), F.count_if(p).alias("p"), F.count_if(g).alias("g"))
    return n.select("scene_id", ((2 * F.col("both") + eps) / (F.col("p") + F.col("g") + eps)).alias("dice"), ((F.col("both") + eps) / (F.col("p") + F.col("g") - F.col("both") + eps)).alias("iou"))


def masked_loss(rows: DataFrame, kind: str) -> DataFrame:
    """Per scene and surface the masked mean of l1, mse or smooth l1, then the mean over surfaces."""
    e = F.abs(F.col("pred") - F.col("gt"))
    err = {"l1": e, "mse": e * e, "smooth": F.when(e < 1, 0.5 * e * e).otherwise(e - 0.5)}[kind]
    per = rows.groupBy("scene_id", "surface").agg((F.sum(err * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("loss"))
    return per.groupBy("scene_id").agg(F.avg("loss").alias("loss"))


def error_summary(rows: DataFrame, *keys: str) -> DataFrame:
    d = F.col("pred") - F.col("gt")
    return rows.filter("mask > 0.5").groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"))
