"""Surfaces (vertices, faces), planes, contours and distances, as column arithmetic over keyed joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.functions.scalars import cross, dot, finite, minus, norm, uniform
from fieldloom.operators.bounding import HIGH, LOW, Reach, Sizes, curve_order, expanded, least_distance, met, runs_of, within_reach
from fieldloom.operators.spatial import columns_of
from fieldloom.scratch import held


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces (scene_id, fid, v0, v1, v2) with the corners' coordinates a*, b*, c*.

    Spark does not count what explode makes of a row, so it takes tables of vertices and planes for small and would send them whole through the driver: here and below they are joined by merge."""
    out = faces
    for v, p in (("v0", "a"), ("v1", "b"), ("v2", "c")):
        out = out.join(vertices.select("scene_id", F.col("vid").alias(v), *[F.col(k).alias(p + k) for k in "xyz"]).hint("merge"), ["scene_id", v])
    return out


def boxed_triangles(corners_: DataFrame, key: str = "scene_id") -> DataFrame:
    """Triangles (key, fid, ax .. cz) with their boxes, as items of bounding.met; those with a corner that is null or not finite go."""
    at = [q + k for q in "abc" for k in "xyz"]
    edge = [f(*[F.col(q + k) for q in "abc"]).alias(n) for f, names in ((F.least, LOW), (F.greatest, HIGH)) for k, n in zip("xyz", names)]
    sound = corners_.select(key, F.col("fid").cast("bigint").alias("fid"), *[F.col(c).cast("double").alias(c) for c in at])
    for c in at:
        sound = sound.filter(finite(c))
    return sound.select("*", *edge)


def _p(p: str) -> list:
    return [F.col(p + k) for k in "xyz"]


def face_table(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Centre, unit normal and area of each face."""
    n = cross(minus(_p("b"), _p("a")), minus(_p("c"), _p("a")))
    c = corners(vertices, faces).withColumns({f"n{k}": x for k, x in zip("xyz", n)})
    size = norm(_p("n"))
    return c.select("scene_id", "fid", *[((F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) / 3).alias(k) for k in "xyz"], *[(F.col("n" + k) / F.nullif(size, F.lit(0.0))).alias("n" + k) for k in "xyz"], (size / 2).alias("area"))


def measures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Area and enclosed volume of each scene's surface."""
    c = corners(vertices, faces)
    area = norm(cross(minus(_p("b"), _p("a")), minus(_p("c"), _p("a")))) / 2
    return c.groupBy("scene_id").agg(F.sum(area).alias("area"), F.abs(F.sum(dot(_p("a"), cross(_p("b"), _p("c")))) / 6).alias("volume"))


def area_weighted_centroid(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    t = face_table(vertices, faces)
    return t.groupBy("scene_id").agg(*[(F.sum(F.col("area") * F.col(k)) / F.nullif(F.sum("area"), F.lit(0.0))).alias(k) for k in "xyz"])


def edge_audit(faces: DataFrame) -> DataFrame:
    """Boundary edges (of one face only) per scene; watertight if there are none."""
    pairs = F.array(*[F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    edges = faces.select("scene_id", F.explode(pairs).alias("e")).groupBy("scene_id", "e").agg(F.count("*").alias("n"))
    return edges.groupBy("scene_id").agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("boundary"), (F.count_if(F.col("n") == 1) == 0).alias("watertight"))


def connected_components(faces: DataFrame) -> DataFrame:
    """(scene_id, vid, component): the least vertex reachable over faces, by label propagation with pointer jumping, until nothing changes."""
    pairs = faces.select("scene_id", F.explode(F.array(F.array("v0", "v1"), F.array("v1", "v2"), F.array("v2", "v0"))).alias("e"))
    edges = pairs.select("scene_id", F.col("e")[0].alias("p"), F.col("e")[1].alias("q"))
    edges = edges.unionByName(edges.select("scene_id", F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    labels = edges.groupBy("scene_id", "p").agg(F.least(F.min("q"), F.first("p")).alias("label")).withColumnRenamed("p", "vid")
    while True:
        near = edges.join(labels.select("scene_id", F.col("vid").alias("q"), "label").hint("merge"), ["scene_id", "q"]).groupBy("scene_id", F.col("p").alias("vid")).agg(F.min("label").alias("near"))
        new = labels.join(near.hint("merge"), ["scene_id", "vid"]).select("scene_id", "vid", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = new.select("scene_id", F.col("vid").alias("label"), F.col("label").alias("far"))
        new = new.join(jump.hint("merge"), ["scene_id", "label"], "left").select("scene_id", "vid", F.least("label", "far").alias("label"), "old")
        new = held(new)
        labels = new.drop("old")
        if not new.filter("label != old").limit(1).count():
            break
    return labels.withColumnRenamed("label", "component")


def component_faces(faces: DataFrame, largest: bool = False) -> DataFrame:
    """faces with their component; of each scene only the one with the most faces if `largest` (ties: the least)."""
    c = connected_components(faces).select("scene_id", F.col("vid").alias("v0"), "component")
    out = faces.join(c.hint("merge"), ["scene_id", "v0"])
    if not largest:
        return out
    best = out.groupBy("scene_id", "component").agg(F.count("*").alias("n")).groupBy("scene_id").agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"))
    return out.join(best, ["scene_id", "component"])


def plane_contours(vertices: DataFrame, faces: DataFrame, planes: DataFrame) -> DataFrame:
    """Segments where faces cross planes (scene_id, plane_id, ox, oy, oz, nx, ny, nz); faces off the plane are dropped by their depths first."""
    c = corners(vertices, faces).join(planes.hint("merge"), "scene_id")
    depth = {p: dot(minus(_p(p), _p("o")), _p("n")) for p in "abc"}
    c = c.withColumns({f"d{p}": d for p, d in depth.items()}).filter((F.least("da", "db", "dc") < 0) & (F.greatest("da", "db", "dc") >= 0))
    hits = []
    for p, q in ("ab", "bc", "ca"):
        t = F.col(f"d{p}") / (F.col(f"d{p}") - F.col(f"d{q}"))
        hits.append(F.when((F.col(f"d{p}") < 0) != (F.col(f"d{q}") < 0), F.array(*[F.col(p + k) + t * (F.col(q + k) - F.col(p + k)) for k in "xyz"])))
    pts = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return c.select("scene_id", "plane_id", "fid", pts.alias("s")).select("scene_id", "plane_id", "fid", *[F.get(F.get("s", F.lit(i)), F.lit(j)).alias(f"{'ab'[i]}{'xyz'[j]}") for i in (0, 1) for j in range(3)])


def _least_segment(points: np.ndarray, items: dict[str, np.ndarray], counts: list | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The least squared distance of each point (z = 0) to the segments."""
    a, b = (np.stack([items[p + k] for k in "uv"], 1) for p in "ab")
    flat = lambda v: np.concatenate([v, np.zeros((len(v), 1))], 1)
    d, middle = b - a, (a + b) / 2

    def exact(i, j):
        w = points[i, :2] - a[j]
        t = np.clip((w * d[j]).sum(1) / (d[j] * d[j]).sum(1), 0, 1)
        return ((w - t[:, None] * d[j]) ** 2).sum(1)

    d2 = least_distance(points, flat(np.minimum(a, b)), flat(np.maximum(a, b)), flat(middle), np.sqrt((d * d).sum(1)) / 2, exact, counts)
    return np.arange(len(points)), {"d2": d2}


def boxed_segments(segments: DataFrame, place: Column) -> DataFrame:
    """Segments (place, au, av, bu, bv) with their boxes, as items of bounding.met; those of no length go, and those with an end that is null or not finite."""
    ends = [p + k for p in "ab" for k in "uv"]
    s = segments.select(place, *[F.col(c).cast("double").alias(c) for c in ends]).filter((F.col("bu") - F.col("au")) ** 2 + (F.col("bv") - F.col("av")) ** 2 > 1e-20)
    for c in ends:
        s = s.filter(finite(c))
    flat = {n: f("a" + k, "b" + k) for f, names in ((F.least, LOW), (F.greatest, HIGH)) for k, n in zip("uv", names)}
    return s.select("*", *[flat.get(n, F.lit(0.0)).alias(n) for n in (*LOW, *HIGH)])


def segment_distance(points: DataFrame, segments: DataFrame, *keys: str, more: tuple[str, ...] = (), sizes: Sizes | None = None) -> DataFrame:
    """The least distance of each 2-D point (u, v) to the segments (au, av, bu, bv) of its keys, by blocks and boxes (see bounding.met); `more` columns of points go with them (none named x, y, z). Segments as in boxed_segments."""
    one = F.to_json(F.struct(*keys)).alias("place")  # what has equal keys is a scene of its own
    p = points.select(one, *keys, "point_id", *more, F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return met(p, boxed_segments(segments, one), _least_segment, "d2 double", nearest_row, sizes=sizes).select(*keys, "point_id", *more, F.sqrt("d2").alias("distance"))


def nearest_row(rows: DataFrame) -> DataFrame:
    """Of a point's results in several chunks the least distance, null if all are."""
    return rows.groupBy("row").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("row", "several")]), F.coalesce("d2", F.lit(math.inf))).alias("r")).select("row", "r.*")


#: The error of winding numbers that are wanted for their sign: those within it of a half are summed in full again.
SIGN_ERROR = 0.2


def winding_number(points: DataFrame, vertices: DataFrame, faces: DataFrame, error: float = 0.0, sizes: Sizes | None = None, items: DataFrame | None = None) -> DataFrame:
    """Generalised winding number of points (scene_id, point_id, x, y, z), and -1 inside (over a half in size), +1 outside. items: the faces as boxed_triangles, if they are at hand.

    Points outside the surface's box are outside without a look at the faces. With an error, groups of faces that are far enough count by the sum of their
    area vectors alone: near groups are opened until what is left out is below the error; rows whose sign this leaves open are summed in full."""
    c = boxed_triangles(corners(vertices, faces)) if items is None else items
    box = vertices.groupBy("scene_id").agg(*[f(k).alias(f"{f.__name__}_{k}") for k in "xyz" for f in (F.min, F.max)])
    boxed = points.join(box, "scene_id")
    within = F.lit(True)
    for k in "xyz":
        within = within & F.col(k).between(F.col(f"min_{k}"), F.col(f"max_{k}"))
    near = boxed.filter(within).select("scene_id", "point_id", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    w = _wound(near, c, error, sizes)
    if error:
        w = held(w)
        open_ = F.abs(F.abs(F.col("w")) - 0.5) <= error
        if w.filter(open_).limit(1).count():
            w = w.filter(~open_).unionByName(_wound(w.filter(open_).drop("w"), c, 0.0, sizes))
    w = w.select("scene_id", "point_id", "w")
    return points.join(w, ["scene_id", "point_id"], "left").select("scene_id", "point_id", F.coalesce("w", F.lit(0.0)).alias("w"), F.when(F.abs(F.coalesce("w", F.lit(0.0))) > 0.5, -1).otherwise(1).alias("sign"))


def _wound(points: DataFrame, items: DataFrame, error: float, sizes: Sizes | None) -> DataFrame:
    half = [x / 2 for x in cross(minus(_p("b"), _p("a")), minus(_p("c"), _p("a")))]
    area = norm(half)
    middle = [F.sum(area * (F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) / 3).alias("m" + k) for k in "xyz"]
    squares = sum(((F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) / 3) ** 2 for k in "xyz")
    summary = (F.sum(area).alias("area"), F.sum(area * squares).alias("ms"), *middle, *[F.sum(x).alias("f" + k) for k, x in zip("xyz", half)])
    chunk = (sizes or Sizes()).chunk

    def merge(rows):
        first = [F.first(c).alias(c) for c in rows.columns if c not in ("row", "several", "w")]
        return rows.groupBy("row").agg(*first, F.sum("w").alias("w"))

    reach = Reach(lambda a, b: far_blocks(a, b, error / 2, chunk), FAR_SCHEMA, summary)
    return met(points, items, lambda p, q: _winding(p, q, error / 2), "w double", merge, sizes=sizes, reach=reach)


FAR = ["fx", "fy", "fz", "gx", "gy", "gz"]  #: the area vector of a group of faces, and its centre
FAR_SCHEMA = ", ".join(f"{c} double" for c in FAR)


def opened(distance: np.ndarray, radius: np.ndarray, area: np.ndarray, bend: np.ndarray, error: float) -> np.ndarray:
    """Which groups of faces have to be opened for points at a distance of `distance` or more from their centre (a row for each point), for the sum of all errors to stay below `error`.

    A derivative of order k of 1 / d is at most k! / d ** (k + 1). A group that counts by its area vector in its area's centre, where the
    first order vanishes for a flat group, errs by at most 2 bend / d ** 3 (bend: the sum of area times distance from the centre times turn off the mean
    normal) and 3 area r ** 2 / (d - r) ** 4 for the second order. Groups stay closed in the order of these bounds, as long as their sum allows."""
    if not error:
        return np.ones(np.broadcast_shapes(distance.shape, radius.shape), bool)
    room = np.maximum(distance - radius, 1e-60)
    wrong = 2 * bend / np.maximum(distance, 1e-60) ** 3 + 3 * area * radius**2 / room**4
    wrong[distance <= radius] = np.inf
    order = np.argsort(wrong, 1)
    out = np.empty(wrong.shape, bool)
    np.put_along_axis(out, order, np.cumsum(np.take_along_axis(wrong, order, 1), 1) > error * 4 * math.pi, 1)
    return out


def _distance_to_box(box: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The least distance of boxes (n x 6) to points (m x 3)."""
    off = np.maximum(0, np.maximum(box[:, None, :3] - points[None], points[None] - box[:, None, 3:]))
    return np.sqrt((off * off).sum(-1))


def far_blocks(a: pa.Table, b: pa.Table, error: float, chunk: int) -> pa.Table:
    """Of a share of a scene's point boxes and all its face boxes: the pairs that meet, and far boxes by their area vector and centre.

    The face boxes are a tree of two levels: 32 that follow each other have one sum, which counts if even that is far enough."""
    order = np.argsort(b.column("block").to_numpy())
    box = columns_of(a, *LOW, *HIGH)
    area, faces, spread = (columns_of(b, *n)[order] for n in (("area",), (*LOW, *HIGH), ("ms",)))
    weight, vector = columns_of(b, "mx", "my", "mz")[order], columns_of(b, "fx", "fy", "fz")[order]
    levels, starts = [], np.arange(0, len(order), 32)
    for group in (starts, np.arange(len(order))):
        ga, gw, gv, gs = (np.add.reduceat(v, group, 0) if len(group) < len(order) else v for v in (area, weight, vector, spread))
        low, high = (f.reduceat(faces[:, s], group, 0) for f, s in ((np.minimum, slice(0, 3)), (np.maximum, slice(3, 6))))
        centre = np.where(ga > 0, gw / np.where(ga > 0, ga, 1), (low + high) / 2)
        radius = np.sqrt((np.maximum(high - centre, centre - low) ** 2).sum(1))
        # bend by its bound: the root of the second moments of places and of normals
        some = np.maximum(ga[:, 0], 1e-300)
        apart = np.maximum(gs[:, 0] - ga[:, 0] * (centre**2).sum(1), 0) + 1e-12 * np.abs(gs[:, 0])
        bend = np.sqrt(apart * (np.maximum(ga[:, 0] - (gv**2).sum(1) / some, 0) + 1e-12 * ga[:, 0]))
        levels.append((centre, gv, opened(_distance_to_box(box, centre), radius[None], ga[None, :, 0], bend[None], error / 2)))
    top, own = levels[0][2], np.arange(len(order)) // 32
    below = top[:, own]  # blocks of opened groups
    meet, far = below & levels[1][2], below & ~levels[1][2]
    blocks, r_blocks = a.column("block").to_numpy(), b.column("block").to_numpy()[order]
    i, j = np.nonzero(meet)
    many = np.bincount(i, minlength=len(box))
    place = np.arange(len(i)) - (np.cumsum(many) - many)[i]
    out = {"block": [blocks[i]], "chunk": [place // chunk], "several": [many[i] > chunk], "values": [np.full((len(i), 6), np.nan)]}
    for (centre, gv, _), hit in zip(levels, (~top, far)):
        p, q = np.nonzero(hit)
        for name, v in (("block", blocks[p]), ("chunk", np.zeros(len(p))), ("several", many[p] > chunk), ("values", np.concatenate([gv[q], centre[q]], 1))):
            out[name].append(v)
    block, chunks, several, values = (np.concatenate(v) for v in out.values())
    lone = np.arange(len(block)) >= len(i)
    numbers = np.concatenate([r_blocks[j], np.zeros(len(block) - len(i), np.int64)])
    named = {"block": pa.array(block.astype(np.int64)), "r_block": pa.array(numbers.astype(np.int64), mask=lone), "chunk": pa.array(chunks.astype(np.int32)), "several": pa.array(several.astype(bool))}
    return pa.table(named | {c: pa.array(np.ascontiguousarray(values[:, k]), mask=~lone) for k, c in enumerate(FAR)})


def _solid_angles(points: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The sum of the solid angles of all faces for each point, by matrix products: the faces' determinants are linear in the point."""
    out = np.zeros(len(points))
    middle = a.mean(0) if len(a) else np.zeros(3)
    a, b, c, points = a - middle, b - middle, c - middle, points - middle
    turn = np.cross(a, b) + np.cross(b, c) + np.cross(c, a)
    volume = (a * np.cross(b, c)).sum(1)
    edges = [((u - v) ** 2).sum(1) for u, v in ((a, b), (b, c), (c, a))]
    step = max(1, 250_000 // max(1, len(a)))
    for at in range(0, len(points), step):
        p = points[at : at + step]
        sa, sb, sc = (sum((p[:, k, None] - q[None, :, k]) ** 2 for k in range(3)) for q in (a, b, c))
        la, lb, lc = np.sqrt(sa), np.sqrt(sb), np.sqrt(sc)
        # twice the products of two directions, by the law of cosines
        ab, bc, ca = sa + sb - edges[0], sb + sc - edges[1], sc + sa - edges[2]
        low = la * lb * lc + (ab * lc + bc * la + ca * lb) / 2
        out[at : at + step] = np.arctan2(volume - p @ turn.T, low).sum(1)
    return 2 * out


def _angles_of_pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The solid angle of each triangle as seen from the origin."""
    la, lb, lc = (np.sqrt((q * q).sum(-1)) for q in (a, b, c))
    return 2 * np.arctan2((a * np.cross(b, c)).sum(-1), la * lb * lc + (a * b).sum(-1) * lc + (b * c).sum(-1) * la + (c * a).sum(-1) * lb)


def _dipoles(points: np.ndarray, vectors: np.ndarray, centres: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """The sum of the solid angles of groups of faces that are put in their centres."""
    out = np.zeros(len(points))
    step = max(1, 500_000 // max(1, len(centres)))
    for at in range(0, len(points) if len(centres) else 0, step):
        off = [centres[None, :, k] - points[at : at + step, k, None] for k in range(3)]
        d2 = off[0] ** 2 + off[1] ** 2 + off[2] ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            value = sum(o * vectors[None, :, k] for k, o in enumerate(off)) / (d2 * np.sqrt(d2))
        out[at : at + step] = (value if use is None else np.where(use[at : at + step], value, 0)).sum(1)
    return out


def _winding(points: np.ndarray, items: dict[str, np.ndarray], error: float, counts: list | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The winding number of each point for faces (ax .. cz) and far groups (FAR); counts gets (pairs in all, pairs summed face by face)."""
    total = np.zeros(len(points))
    if "fx" in items:
        far = np.isfinite(items["fx"].astype(float))
        total += _dipoles(points, *(np.stack([items[c][far].astype(float) for c in n], 1) for n in (FAR[:3], FAR[3:])))
        items = {k: v[~far] for k, v in items.items()}
    a, b, c = (np.stack([items[q + k].astype(float) for k in "xyz"], 1) for q in "abc")
    if not error or len(a) <= 256:
        total += _solid_angles(points, a, b, c)
    else:
        half = np.cross(b - a, c - a) / 2
        area = np.sqrt((half * half).sum(1))
        middle = (a + b + c) / 3
        order = curve_order(middle)
        starts, box = runs_of(order, 16, np.minimum.reduce([a, b, c]), np.maximum.reduce([a, b, c]))
        weight = np.add.reduceat(area[order], starts)
        centre = np.add.reduceat((area[:, None] * middle)[order], starts, 0) / np.maximum(weight, 1e-300)[:, None]
        centre = np.where(weight[:, None] > 0, centre, (box[:, :3] + box[:, 3:]) / 2)
        radius = np.sqrt((np.maximum(box[:, 3:] - centre, centre - box[:, :3]) ** 2).sum(1))
        vector, group = np.add.reduceat(half[order], starts, 0), np.arange(len(a)) // 16
        normal = half[order] / np.maximum(area[order], 1e-300)[:, None] - (vector / np.maximum(weight, 1e-300)[:, None])[group]
        bend = np.bincount(group, area[order] * np.sqrt(((middle[order] - centre[group]) ** 2).sum(1) * (normal**2).sum(1)), len(starts))
        near = opened(_distance_to_box(np.concatenate([points, points], 1), centre), radius[None], weight[None], bend[None], error)
        total += _dipoles(points, vector, centre, ~near)
        every = np.arange(len(points))
        for i, j in expanded(near, every, every, order, starts, 300_000):
            total += np.bincount(i, _angles_of_pairs(a[j] - points[i], b[j] - points[i], c[j] - points[i]), len(points))
            if counts is not None:
                counts.append((0, len(i)))
    if counts is not None:
        counts.append((len(points) * len(a), 0 if error and len(a) > 256 else len(points) * len(a)))
    return np.arange(len(points)), {"w": total / (4 * math.pi)}


def _kernels(faces: np.ndarray, items: dict[str, np.ndarray], gamma: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each face (x, y, z, nx, ny, nz, area) the sums of its kernel with the items of side 0 and with those of side 1."""
    q = np.stack([items[c] for c in ("x", "y", "z", "nx", "ny", "nz", "area")], 1)
    of = [(items["side"] == s).astype(float) for s in (0, 1)]
    sums = np.zeros((len(faces), 2))
    step = max(1, 1_000_000 // max(1, len(q)))
    for at in range(0, len(faces), step):
        r = faces[at : at + step]
        d2 = sum((r[:, None, i] - q[None, :, i]) ** 2 for i in range(3))
        k = np.exp(-gamma * d2) * (r[:, 3:6] @ q[:, 3:6].T) * q[None, :, 6]
        sums[at : at + step] = np.stack([k @ s for s in of], 1) * r[:, 6:7]
    return np.arange(len(faces)), {"k0": sums[:, 0], "k1": sums[:, 1]}


def varifold(a: DataFrame, b: DataFrame, gamma: float, cut: float | None = None, sizes: Sizes | None = None) -> DataFrame:
    """(scene_id, distance): K11 + K22 - 2 K12 over two face tables, K the sum of exp(-gamma d ** 2) (n . n') area area' over pairs of faces.

    Without a cut all pairs of a scene are summed, quadratic by definition; blocks of faces meet in tasks of bounded size. With a cut, blocks of
    large scenes meet only where the exponential can be above it, and left_out bounds what that misses: 4 cut (area of both) ** 2 at most."""
    columns = ["x", "y", "z", "nx", "ny", "nz", "area"]
    one = lambda df, side: df.select("scene_id", F.lit(side).alias("side"), *[F.col(c).cast("double").alias(c) for c in columns])
    both = one(a, 0).unionByName(one(b, 1))
    for c in columns:
        both = both.filter(finite(c))
    both = held(both)  # counted, and read as both sides
    items = both.select("*", *[F.col(k).alias(n) for k, n in zip("xyz" * 2, LOW + HIGH)])
    most = math.inf if cut is None else math.sqrt(max(0.0, -math.log(cut) / gamma))
    chunk = (sizes or Sizes()).chunk

    def merge(rows):
        first = [F.first(c).alias(c) for c in rows.columns if c not in ("row", "several", "k0", "k1")]
        return rows.groupBy("row").agg(*first, F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))

    reach = Reach(lambda p, q: within_reach(p, q, most, chunk), "")
    k = met(both, items, lambda p, q: _kernels(p, q, gamma), "k0 double, k1 double", merge, sizes=sizes, reach=reach, more=tuple(columns[3:]))
    of = lambda c, side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0.0))
    total = k.groupBy("scene_id").agg((of("k0", 0) + of("k1", 1) - 2 * of("k1", 0)).alias("distance"), F.sum("area").alias("area"))
    return total.select("scene_id", "distance", *([] if cut is None else [(4 * cut * F.col("area") ** 2).alias("left_out")]))


def plane_stack(landmarks: DataFrame, spacing: float, before: int = 0, after: int = 0) -> DataFrame:
    """Parallel planes from C towards A (cx.., ax..): `before` behind C, floor(L / spacing) + 1, `after` beyond."""
    d = [F.col("a" + k) - F.col("c" + k) for k in "xyz"]
    rows = landmarks.withColumns({f"n{k}": x / F.nullif(norm(d), F.lit(0.0)) for k, x in zip("xyz", d)}).withColumn("last", F.floor(norm(d) / spacing) + after)
    rows = rows.select("*", F.explode(F.sequence(F.lit(-before).cast("bigint"), F.col("last"))).alias("k"))
    return rows.select("scene_id", (F.col("k") + before).alias("plane_id"), *[(F.col("c" + k) + F.col("k") * spacing * F.col("n" + k)).alias("o" + k) for k in "xyz"], "nx", "ny", "nz")


def plane_pairs(planes: DataFrame) -> DataFrame:
    """Pairs of a short-axis and a long-axis plane of a scene that are not parallel."""
    sa, la = (planes.filter(F.col("plane_type") == t).select("scene_id", F.col("plane_id").alias(f"{p}plane"), *[F.col("n" + k).alias(p + k) for k in "xyz"]) for t, p in (("SA", "a"), ("LA", "b")))
    return sa.join(la.hint("merge"), "scene_id").filter(norm(cross(_p("a"), _p("b"))) >= 1e-10).select("scene_id", F.col("aplane").alias("sa_plane"), F.col("bplane").alias("la_plane"))


def covariance(points: DataFrame) -> DataFrame:
    """Means and the six covariances (n - 1) of x, y, z per scene."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return points.groupBy("scene_id").agg(*[F.avg(k).alias(f"mean_{k}") for k in "xyz"], *[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs])


def rigid_fit(pairs: DataFrame) -> DataFrame:
    """Rotation (9) and translation (3) per scene that bring sources (x, y, z) to targets (tx, ty, tz): 15 sums per scene, then a 3 x 3 decomposition of one row."""
    sums = pairs.groupBy("scene_id").agg(F.count("*").alias("n"), *[F.avg(c).alias("m" + c) for c in ("x", "y", "z", "tx", "ty", "tz")], *[F.covar_pop(a, "t" + b).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                h = np.array([[r[f"h{a}{b}"] for b in "xyz"] for a in "xyz"])
                turn, shift = rigid_of(h, np.array([r["mx"], r["my"], r["mz"]]), np.array([r["mtx"], r["mty"], r["mtz"]]))
                out.append((r["scene_id"], turn.ravel().tolist(), shift.tolist()))
            yield pd.DataFrame(out, columns=["scene_id", "rotation", "translation"])

    return sums.mapInPandas(solve, "scene_id bigint, rotation array<double>, translation array<double>")


def rigid_of(h: np.ndarray, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The turn and the shift of least squares from the covariance of sources and targets (3 x 3) and their means; never a mirror image."""
    u, _, vt = np.linalg.svd(h)
    turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1]) @ u.T
    return turn, target - turn @ source


def apex(points: DataFrame, base: DataFrame) -> DataFrame:
    """The point of each scene farthest from the base point (bx, by, bz); ties: the least id."""
    d = sum((F.col(k) - F.col("b" + k)) ** 2 for k in "xyz")
    j = points.join(base.hint("merge"), "scene_id").withColumn("d2", d)
    best = j.groupBy("scene_id").agg(F.min_by(F.struct("point_id", "x", "y", "z", "d2"), F.struct(-F.col("d2"), F.col("point_id"))).alias("p"))
    return best.select("scene_id", "p.point_id", "p.x", "p.y", "p.z", F.sqrt("p.d2").alias("distance"))


def surface_points(vertices: DataFrame, faces: DataFrame, n: int, slots: int = 64) -> DataFrame:
    """(scene_id, draw, fid, x, y, z): n points per scene, uniform by area.

    Draw u in (0, 1) takes the face whose stretch of the cumulated area holds it, and a keyed point of that face. Stretches and draws
    meet by slot, one of `slots` parts of (0, 1) of each scene, so that a scene's draws do not meet all of its faces."""
    c = corners(vertices, faces)
    area = norm(cross(minus(_p("b"), _p("a")), minus(_p("c"), _p("a")))) / 2
    c = c.withColumn("area", area)
    total = c.groupBy("scene_id").agg(F.sum("area").alias("all")).filter(F.col("all") > 0)
    w = W.partitionBy("scene_id").orderBy("fid")
    cum = c.join(total, "scene_id").withColumn("high", F.sum("area").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.col("all"))
    cum = cum.withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0.0))).withColumn("high", F.when(F.lead("fid").over(w).isNull(), F.lit(2.0)).otherwise(F.col("high")))
    slot = lambda u: F.least(F.floor(u * slots), F.lit(slots - 1))
    cum = cum.withColumn("slot", F.explode(F.sequence(slot(F.col("low")), slot(F.col("high")))))
    draws = total.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).withColumn("u", uniform("scene_id", "draw", F.lit("area")))
    hit = draws.withColumn("slot", slot(F.col("u"))).join(cum.hint("merge"), ["scene_id", "slot"]).filter((F.col("u") > F.col("low")) & (F.col("u") <= F.col("high")))
    a, b = F.sqrt(uniform("scene_id", "draw", F.lit("u"))), uniform("scene_id", "draw", F.lit("v"))
    return hit.select("scene_id", "draw", "fid", *[((1 - a) * F.col("a" + k) + a * (1 - b) * F.col("b" + k) + a * b * F.col("c" + k)).alias(k) for k in "xyz"])
