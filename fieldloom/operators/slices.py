"""Acquisition planes, what they cut from surfaces, line samples, budget picks, hole patches, and the jobs composed of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.functions.scalars import cross, dot, finite, minus, norm, uniform, unit
from fieldloom.operators.geometry import (
    SIGN_ERROR, apex, area_weighted_centroid, component_faces, corners, covariance, face_table, plane_contours, plane_pairs, plane_stack, segment_distance, surface_points, varifold, winding_number,
)
from fieldloom.operators.samples import SURFACES, cell_name, first_last_mask, mask_stats, supervision_mask, threshold_counts, valid_shares
from fieldloom.operators.shapes import ball_points, by_surfaces, inside_or_near, jitter, multi_plane_sdf, plane_distance, planar_grid, volume_grid
from fieldloom.operators.spatial import columns_of, held, nearest_join, overlap, surface_scores
from fieldloom.operators.tables import best_patch, centroid, minmax_norm
from fieldloom.scratch import drop_written, written

#: The axis from apex to base, the area of full score, and the weights of projection, area and prior.
BASE_AXIS = (-math.sqrt(0.5), math.sqrt(0.5), 0.0)
FULL_AREA = 0.20
PATCH_WEIGHTS = {"mitral": (0.45, 0.25, 0.30), "tricuspid": (0.45, 0.40, 0.15), "pulmonary": (0.0, 0.1, 0.9)}


def vec(prefix: str = "") -> list[Column]:
    return [F.col(prefix + k) for k in "xyz"]


def named(values: list[Column], prefix: str) -> list[Column]:
    return [v.alias(prefix + k) for v, k in zip(values, "xyz")]


# -- planes


def long_axis_planes(landmarks: DataFrame, shift_mm: float = 25.0) -> DataFrame:
    """Two planes for each scene through C + shift along the axis e1, with the normals e2 and e3. landmarks: (scene_id, scale_mm, c*, e1*, e2*, e3*)."""
    at = [F.col("c" + k) + F.lit(shift_mm) / F.col("scale_mm") * F.col("e1" + k) for k in "xyz"]
    kinds = [("long_axis_1", "e2", "e1", "e3"), ("long_axis_2", "e3", "e1", "e2")]
    rows = [F.struct(F.lit(t).alias("plane_type"), F.struct(*named(vec(n), "n"), *named(vec(u), "u"), *named(vec(v), "v")).alias("f")) for t, n, u, v in kinds]
    out = landmarks.select("scene_id", *named(at, "o"), F.explode(F.array(*rows)).alias("p"))
    return out.select("scene_id", "p.plane_type", "ox", "oy", "oz", "p.f.*")


def checked_axis(landmarks: DataFrame) -> DataFrame:
    """landmarks (scene_id, c*, a*, e1*), which fail where the apex is not beyond C along e1, or is off that axis."""
    d = minus(vec("a"), vec("c"))
    along = dot(d, vec("e1"))
    aside = norm([x - along * e for x, e in zip(d, vec("e1"))])
    wrong = lambda text: F.raise_error(F.concat(F.lit(text), F.col("scene_id").cast("string"))).cast("double")
    ok = F.when(~F.coalesce(along > 0, F.lit(False)), wrong("the apex is not beyond the start, scene ")).when(aside > F.greatest(F.lit(1e-10), 1e-8 * along), wrong("the apex is off the axis, scene "))
    return landmarks.withColumn("ax", ok.otherwise(F.col("ax")))


def all_planes(landmarks: DataFrame, spacing: float, before: int, after: int, shift_mm: float = 25.0) -> DataFrame:
    """The short-axis stack, numbered from 0, and then the two long-axis planes, with axes: (scene_id, plane_id, plane_type, o*, n*, u*, v*)."""
    marks = checked_axis(landmarks)
    axes = landmarks.select("scene_id", *named(vec("e2"), "u"), *named(vec("e3"), "v"))
    sa = plane_stack(marks, spacing, before, after).join(axes, "scene_id").withColumn("plane_type", F.lit("short_axis"))
    n = sa.groupBy("scene_id").agg(F.count("*").alias("n"))
    la = long_axis_planes(landmarks, shift_mm).join(n, "scene_id").withColumn("plane_id", F.col("n") + F.when(F.col("plane_type") == "long_axis_1", 0).otherwise(1)).drop("n")
    return sa.unionByName(la)


def square_frame(planes: DataFrame) -> DataFrame:
    """planes (n*) with axes u and v of a square: u at right angles to the normal and to x (to y where the normal is nearly x), v to both."""
    x, y = [F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)]
    out = _unit_columns(planes, vec("n"), "unit_n")
    n = vec("unit_n")
    tmp = [F.when(F.abs(n[0]) > 0.9, b).otherwise(a) for a, b in zip(x, y)]
    out = _unit_columns(out, cross(n, tmp), "u")
    return _unit_columns(out, cross(n, vec("u")), "v").drop(*["unit_n" + k for k in "xyz"])


def _unit_columns(rows: DataFrame, vector: list[Column], prefix: str) -> DataFrame:
    """rows with the vector made a unit vector, in steps: as one expression each use would repeat all before it."""
    out = rows.withColumns({"raw_" + k: c for k, c in zip("xyz", vector)})
    out = out.withColumn("raw_size", F.nullif(norm(vec("raw_")), F.lit(0.0)))
    return out.withColumns({prefix + k: F.col("raw_" + k) / F.col("raw_size") for k in "xyz"}).drop("raw_x", "raw_y", "raw_z", "raw_size")


def square_corners(planes: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Rows (scene_id, plane_id, corner, x, y, z): four corners of the square (side, u*, v*) whose diagonal holds the plane's point o* at that fraction."""
    shift = (fraction - 0.5) * F.col("side")
    signs = F.array(*[F.struct(F.lit(i).alias("corner"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)))])
    rows = planes.select("*", F.explode(signs).alias("s"))
    at = [o - shift * (u + v) + F.col("side") * (F.col("s.a") * u + F.col("s.b") * v) for o, u, v in zip(vec("o"), vec("u"), vec("v"))]
    return rows.select("scene_id", "plane_id", "s.corner", *named(at, ""))


# -- what planes cut


def _cut(points: np.ndarray, depth: np.ndarray, count: np.ndarray, side: float, wide: float):
    """Convex polygons (n x m x 3, the first count of each row) where side * depth <= wide: they get one corner more at most."""
    n, m = depth.shape
    rows = np.arange(n)
    new, new_depth, new_count = np.zeros((n, m + 1, 3)), np.zeros((n, m + 1)), np.zeros(n, np.int64)

    def add(chosen, at, d):
        new[chosen, new_count[chosen]] = at[chosen]
        new_depth[chosen, new_count[chosen]] = d[chosen]
        new_count[chosen] += 1

    for i in range(m):
        there, j = i < count, np.where(i + 1 < count, i + 1, 0)
        p, q, dp, dq = points[:, i], points[rows, j], depth[:, i], depth[rows, j]
        over_p, over_q = side * dp - wide, side * dq - wide
        add(np.flatnonzero(there & (over_p <= 0)), p, dp)
        across = there & (over_p * over_q < 0)
        t = np.where(across, over_p / np.where(across, over_p - over_q, 1), 0)
        add(np.flatnonzero(across), p + t[:, None] * (q - p), dp + t * (dq - dp))
    return new, new_depth, new_count


def _clipped(batches, wide: float):
    corner = [p + k for p in "abc" for k in "xyz"]
    for batch in batches:
        table = pa.Table.from_batches([batch])
        points, depth = columns_of(table, *corner).reshape(-1, 3, 3), columns_of(table, "da", "db", "dc")
        count = np.full(len(depth), 3)
        for side in (1.0, -1.0):
            points, depth, count = _cut(points, depth, count, side, wide)
        for part in range(points.shape[1] - 2):
            a, b, c = points[:, 0], points[:, part + 1], points[:, part + 2]
            has = np.flatnonzero((part + 2 < count) & (np.linalg.norm(np.cross(b - a, c - a), axis=1) > 0))
            if len(has):
                out = np.concatenate([a[has], b[has], c[has]], 1)
                keys = table.select(["scene_id", "plane_id", "fid"]).take(pa.array(has)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.full(len(has), part, np.int32)), *(pa.array(out[:, i]) for i in range(9))], names=["scene_id", "plane_id", "fid", "part", *corner])


def slab_clip(vertices: DataFrame, faces: DataFrame, planes: DataFrame, half: float) -> DataFrame:
    """Triangles (scene_id, plane_id, fid, part, a*, b*, c*) of the faces within half of each plane (o*, n*: unit normal).

    Faces off the slab are dropped by their depths; the others are cut at both of its sides as polygons, and each polygon is a
    fan of triangles. The slab is wider by max(1e-12, 1e-9 half), so that faces on its border stay."""
    wide = half + max(1e-12, 1e-9 * half)
    c = corners(vertices, faces).join(planes.select("scene_id", "plane_id", *vec("o"), *vec("n")).hint("merge"), "scene_id")
    depth = {p: dot(minus(vec(p), vec("o")), vec("n")) for p in "abc"}
    c = c.withColumns({"d" + p: d for p, d in depth.items()}).filter((F.least("da", "db", "dc") <= wide) & (F.greatest("da", "db", "dc") >= -wide))
    corner = [p + k for p in "abc" for k in "xyz"]
    c = c.select(*[F.col(k).cast("bigint").alias(k) for k in ("scene_id", "plane_id", "fid")], *[F.col(k).cast("double").alias(k) for k in [*corner, "da", "db", "dc"]])
    return c.mapInArrow(lambda it: _clipped(it, wide), "scene_id bigint, plane_id bigint, fid bigint, part int, " + ", ".join(f"{k} double" for k in corner))


def contour_curvature(segments: DataFrame, decimals: int = 9) -> DataFrame:
    """segments (scene_id, plane_id, fid, a*, b*) with curvature: the mean over both ends of turning angle / mean length of the two edges.

    Ends are the same vertex if they agree to so many decimals; a vertex of one edge, or with an edge of no length, has none (0), and one of more
    than two edges takes those of the two least faces."""
    key = lambda p: F.concat_ws(" ", *[(F.round(F.col(p + k), decimals) + 0.0).cast("string") for k in "xyz"])
    rows = segments.select("scene_id", "plane_id", "fid", *vec("a"), *vec("b"), key("a").alias("ka"), key("b").alias("kb"))
    side = lambda own, other: F.struct(F.col("k" + own).alias("k"), F.struct("fid", *[(F.col(other + c) - F.col(own + c)).alias("d" + c) for c in "xyz"]).alias("e"))
    ends = rows.select("scene_id", "plane_id", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("scene_id", "plane_id", "s.k", "s.e")
    # of each vertex the two edges of the least faces: sums of two structs, not a list of all
    first = ends.groupBy("scene_id", "plane_id", "k").agg(F.min("e").alias("p"), F.count("*").alias("degree"))
    second = ends.join(first, ["scene_id", "plane_id", "k"]).filter(F.col("e") > F.col("p")).groupBy("scene_id", "plane_id", "k").agg(F.min("e").alias("q"), F.first("p").alias("p"))
    p, q = ([F.col(f"{s}.d{c}") for c in "xyz"] for s in "pq")
    lp, lq = norm(p), norm(q)
    turn = math.pi - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(p, q) / (lp * lq))))
    at = second.select("scene_id", "plane_id", "k", F.when((lp > 1e-12) & (lq > 1e-12), turn / F.greatest((lp + lq) / 2, F.lit(1e-12))).otherwise(0.0).alias("v"))
    out = rows
    for e in "ab":
        out = out.join(at.select("scene_id", "plane_id", F.col("k").alias("k" + e), F.col("v").alias("v" + e)), ["scene_id", "plane_id", "k" + e], "left")
    mean = (F.coalesce("va", F.lit(0.0)) + F.coalesce("vb", F.lit(0.0))) / 2
    return out.select("scene_id", "plane_id", "fid", *vec("a"), *vec("b"), mean.alias("curvature"))


def curvature_on_grid(points: DataFrame, curved: DataFrame) -> DataFrame:
    """points (scene_id, plane_id, point_id, x, y, z) with the curvature of the nearest segment's middle in their plane; 0 in a plane without a contour."""
    both = F.struct("scene_id", "plane_id")
    mids = curved.select(F.xxhash64(both).alias("scene_id"), F.col("fid").alias("point_id"), *named([(a + b) / 2 for a, b in zip(vec("a"), vec("b"))], ""), "curvature")
    near = nearest_join(points.select(F.xxhash64(both).alias("scene_id"), "point_id", "x", "y", "z"), mids)
    values = near.join(mids.select("scene_id", F.col("point_id").alias("nearest_id"), "curvature"), ["scene_id", "nearest_id"], "left").select(F.col("scene_id").alias("both"), "point_id", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))
    return points.withColumn("both", F.xxhash64(both)).join(values, ["both", "point_id"]).drop("both")


def plane_lines(planes: DataFrame) -> DataFrame:
    """(scene_id, sa_plane, la_plane, p*, d*): the line of each short-axis and long-axis plane that are not parallel, p being its point nearest to the origin."""
    pairs = plane_pairs(planes)
    for name, p in (("sa_plane", "1"), ("la_plane", "2")):
        side = planes.select("scene_id", F.col("plane_id").alias(name), *[F.col(f"n{k}").alias(f"n{p}{k}") for k in "xyz"], dot(vec("o"), vec("n")).alias("h" + p))
        pairs = pairs.join(side.hint("merge"), ["scene_id", name])
    n1, n2 = vec("n1"), vec("n2")
    d = unit(cross(n1, n2))
    pairs = pairs.withColumns({"d" + k: c for k, c in zip("xyz", d)})
    a, b = cross(n2, vec("d")), cross(vec("d"), n1)
    det = dot(n1, a)
    return pairs.select("scene_id", "sa_plane", "la_plane", *named([(F.col("h1") * x + F.col("h2") * y) / det for x, y in zip(a, b)], "p"), *vec("d"))


def plane_line_samples(planes: DataFrame, vertices: DataFrame, step: float, margin: float = 0.0) -> DataFrame:
    """(scene_id, sa_plane, la_plane, i, t, x, y, z): points every step on the lines of plane pairs, from margin before to margin past the vertices' places along them.

    The last point is less than half a step past the end."""
    lines = plane_lines(planes)
    key = ["scene_id", "sa_plane", "la_plane"]
    along = dot(minus(vec(), vec("p")), vec("d"))
    ends = lines.join(vertices.select("scene_id", "x", "y", "z").hint("merge"), "scene_id").groupBy(*key).agg((F.min(along) - margin).alias("low"), (F.max(along) + margin).alias("high"))
    last = F.ceil((F.col("high") + step / 2 - F.col("low")) / step) - 1
    rows = lines.join(ends, key).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("i")).withColumn("t", F.col("low") + F.col("i") * step)
    return rows.select(*key, "i", "t", *named([p + F.col("t") * d for p, d in zip(vec("p"), vec("d"))], ""))


# -- sectors


def sector_geometry(spheres: DataFrame, degrees: float, arc: int = 100) -> DataFrame:
    """Points (scene_id, part, i, x, y, z) of a flat sector inside a sphere (c*, radius): the apex at the end of the direction w*, then `arc` points of the
    circle in the plane of w* and l*, from one ray's end to the other's; the rays are turned by half of the opening to both sides of the line to the centre."""
    if not 0 < degrees < 180:
        raise ValueError("the opening lies between 0 and 180 degrees")
    alpha = math.radians(degrees)
    s = with_sector_axes(spheres)
    r = F.col("radius")
    rows = s.select("*", F.explode(F.sequence(F.lit(-1), F.lit(arc - 1))).alias("i"))
    angle = -alpha + 2 * alpha * F.col("i") / max(1, arc - 1)
    point = [c + r * F.when(F.col("i") < 0, w).otherwise(-F.cos(angle) * w + F.sin(angle) * q) for c, w, q in zip(vec("c"), vec("w"), vec("l"))]
    return rows.select("scene_id", F.when(F.col("i") < 0, "apex").otherwise("arc").alias("part"), "i", *named(point, ""))


def with_sector_axes(spheres: DataFrame) -> DataFrame:
    """spheres with w* as a unit vector, and l* made a unit vector at right angles to it."""
    s = spheres.withColumns({"w" + k: c for k, c in zip("xyz", unit(vec("w")))})
    along = dot(vec("l"), vec("w"))
    return s.withColumns({"l" + k: c for k, c in zip("xyz", unit([q - along * w for q, w in zip(vec("l"), vec("w"))]))})


def sector_contours(vertices: DataFrame, faces: DataFrame, spheres: DataFrame, degrees: float) -> DataFrame:
    """Segments (scene_id, fid, a*, b*) where a surface meets the sector (see sector_geometry).

    The plane's contour is cut by the two rays, which a point is between if its sideways place is at most tan(opening / 2) times the forward one, and by the circle."""
    s = with_sector_axes(spheres)
    apex_of = [c + F.col("radius") * w for c, w in zip(vec("c"), vec("w"))]
    planes = s.select("scene_id", F.lit(0).alias("plane_id"), *named(apex_of, "o"), *named(cross(vec("w"), vec("l")), "n"))
    cut = plane_contours(vertices, faces, planes).filter("ax is not null and bx is not null")
    j = cut.join(s.select("scene_id", *vec("c"), *vec("w"), *vec("l"), "radius").hint("merge"), "scene_id")
    tan, lower, upper = math.tan(math.radians(degrees) / 2), F.lit(0.0), F.lit(1.0)
    place = {}
    for e in "ab":
        d = minus(vec(e), vec("c"))
        place[e] = (F.col("radius") - dot(d, vec("w")), dot(d, vec("l")))  # forward from the apex towards the centre, and sideways
    for sign in (1, -1):  # sign * sideways - tan * forward <= 0 at both ends of what stays
        f, g = (sign * place[e][1] - tan * place[e][0] for e in "ab")
        t = f / F.nullif(f - g, F.lit(0.0))
        lower = F.greatest(lower, F.when((f > 0) & (g > 0), F.lit(2.0)).when(f > 0, t).otherwise(0.0))
        upper = F.least(upper, F.when(g > 0, F.when(f > 0, F.lit(-1.0)).otherwise(t)).otherwise(1.0))
    a, b = (minus(vec(e), vec("c")) for e in "ab")
    d = minus(b, a)
    p, q, r = dot(d, d), dot(a, d), dot(a, a) - F.col("radius") * F.col("radius")
    root = q * q - p * r
    near, far = (-q - F.sqrt(root)) / F.nullif(p, F.lit(0.0)), (-q + F.sqrt(root)) / F.nullif(p, F.lit(0.0))
    j = j.withColumns({"lower": F.greatest(lower, near), "upper": F.least(upper, far)}).filter((root > 0) & (F.col("upper") > F.col("lower")))
    at = lambda t: [x + F.col(t) * (y - x) for x, y in zip(vec("a"), vec("b"))]
    return j.select("scene_id", "fid", *named(at("lower"), "a"), *named(at("upper"), "b"))


# -- budget picks


def budgets(n: int, weights: tuple[float, ...], remainder: str) -> list[int]:
    """n in shares of the weights. What rounding leaves goes to the largest weight (largest), one each by falling weight (each), or to the last (last; shares are rounded, not cut)."""
    total = sum(weights)
    w = [x / total for x in weights] if total > 0 else [1 / len(weights)] * len(weights)
    if remainder == "last":
        out = [round(n * x) for x in w[:-1]]
        return [*out, n - sum(out)]
    out = [math.floor(n * x) for x in w]
    order = sorted(range(len(w)), key=lambda i: -w[i])
    for k in range(n - sum(out)):
        out[order[0 if remainder == "largest" else k % len(order)]] += 1
    return out


def budget_pick(
    points: DataFrame, n: int, bands: list[float], axes: list[str], bins: int, share: float = 0.8, weights: tuple[float, ...] = (1, 1, 1), remainder: str = "largest", labelled: bool = False,
    surfaces: tuple[str, ...] = SURFACES,
) -> DataFrame:
    """(scene_id, point_id, source_surface, pass): n rows of each scene (scene_id, point_id, axes, dist_*), all of a scene that has no more.

    A share of n is split by the weights; surface after surface picks its part, one per cell in turn, among the rows not yet picked that lie in the narrowest
    band that holds enough (else in the widest). The rest comes from all other rows (background); labelled, all of n is split, and
    what is missing is filled surface after surface from the widest band. (scene_id, point_id) is a key. The turns are windows within scenes over one table,
    so the rows are shuffled once."""
    quota = budgets(n if labelled else round(share * n), weights, remainder)
    scene = W.partitionBy("scene_id")
    points = points.select(*dict.fromkeys(["scene_id", "point_id", *axes, *[f"dist_{s}" for s in surfaces]])).filter("scene_id is not null")
    whole = F.lit(None).cast("string") if labelled else F.when(F.count("*").over(scene) <= n, "all")
    rows = points.withColumn("picked", whole).withColumn("pass", F.when(F.col("picked").isNotNull(), 0))

    def take(rows, open_, need, surface, turn, salt):
        """rows with picked and pass set for the first `need` rows of stratified_pick among those with open_."""
        rows = rows.withColumn("open", F.coalesce(open_, F.lit(False)))
        rows = rows.withColumns({f"{f.__name__}_{a}": f(F.when(F.col("open"), F.col(a))).over(scene) for a in axes for f in (F.min, F.max)})
        rows = rows.withColumn("cell", F.when(F.col("open"), cell_name(axes, bins)))
        rows = rows.withColumn("h", F.when(F.col("open"), uniform("scene_id", "point_id", F.lit(salt))))
        rows = rows.withColumn("turn", F.row_number().over(W.partitionBy("scene_id", "cell").orderBy("h", "point_id")))
        rows = rows.withColumn("ch", F.when(F.col("open"), uniform("scene_id", "cell", F.lit(salt))))
        rows = rows.withColumn("rank", F.row_number().over(scene.orderBy(F.desc("open"), "turn", "ch", "cell")))
        new = F.col("open") & (F.col("rank") <= need)
        rows = rows.withColumns({"picked": F.when(new, surface).otherwise(F.col("picked")), "pass": F.when(new, turn).otherwise(F.col("pass"))})
        return rows.select(*points.columns, "picked", "pass")

    free = F.col("picked").isNull()
    for s, need in zip(surfaces, quota):
        if need <= 0:
            continue
        d = F.when(finite(f"dist_{s}"), F.col(f"dist_{s}"))
        rows = rows.withColumns({f"n{i}": F.count_if(free & (d <= b)).over(scene) for i, b in enumerate(bands)})
        band = F.coalesce(*[F.when(F.col(f"n{i}") >= need, F.lit(b)) for i, b in enumerate(bands)], F.lit(bands[-1]))
        rows = take(rows, free & (d <= band), F.lit(need), s, 1, f"budget_{s}")

    fills = [(s, f"fill_{s}", finite(f"dist_{s}") & (F.col(f"dist_{s}") <= bands[-1])) for s in surfaces] if labelled else [("background", "budget_background", F.lit(True))]
    for name, salt, near in fills:
        rows = rows.withColumn("need", n - F.count("picked").over(scene))
        rows = take(rows, free & near & (F.col("need") > 0), F.col("need"), name, 2, salt)
    return rows.filter("picked is not null").select("scene_id", "point_id", F.col("picked").alias("source_surface"), "pass")


# -- hole patches, apexes, landmarks


def hole_patch_scores(vertices: DataFrame, patch_faces: DataFrame, kind: str) -> DataFrame:
    """(scene_id, component, projection, area, prior, likelihood) of the patches of holes: faces (scene_id, fid, v0, v1, v2, component).

    kind mitral: the patch's first vertex, prior y + x; tricuspid: the mean of its vertices, prior -z; pulmonary: its
    centroid by area, prior z, and all three values scaled from 0 to 1 within the scene. Else values v score (v + 1) / 2, areas their share of FULL_AREA, from 0 to 1."""
    key = ["scene_id", "component"]
    t = face_table(vertices, patch_faces).join(patch_faces.select("scene_id", "fid", "component").hint("merge"), ["scene_id", "fid"])
    area = t.groupBy(*key).agg(F.sum("area").alias("area"), *[(F.sum(F.col("area") * F.col(k)) / F.nullif(F.sum("area"), F.lit(0.0))).alias(k) for k in "xyz"])
    corner = patch_faces.select(*key, F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().join(vertices.select("scene_id", "vid", "x", "y", "z").hint("merge"), ["scene_id", "vid"])
    if kind == "mitral":
        at = corner.groupBy(*key).agg(F.min_by(F.struct("x", "y", "z"), "vid").alias("p")).select(*key, "p.*")
    elif kind == "tricuspid":
        at = corner.groupBy(*key).agg(*[F.avg(k).alias(k) for k in "xyz"])
    else:
        at = area.select(*key, "x", "y", "z")
    prior = {"mitral": F.col("y") + F.col("x"), "tricuspid": -F.col("z"), "pulmonary": F.col("z")}[kind]
    rows = at.join(area.select(*key, "area"), key).select(*key, dot(vec(), [F.lit(a) for a in BASE_AXIS]).alias("projection"), "area", prior.alias("prior"))
    weights = PATCH_WEIGHTS[kind]
    if kind == "pulmonary":
        scored = rows
        for c in ("projection", "area", "prior"):
            scored = minmax_norm(scored.withColumn(f"s_{c}", F.col(c)), f"s_{c}", "scene_id")
        scores = [F.col(f"s_{c}") for c in ("projection", "area", "prior")]
    else:
        scored, clip = rows, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        scores = [clip((F.col("projection") + 1) / 2), clip(F.col("area") / FULL_AREA), clip((F.col("prior") + 1) / 2)]
    return scored.select(*key, "projection", "area", "prior", sum(w * s for w, s in zip(weights, scores)).alias("likelihood"))


def leading_axis(points: DataFrame) -> DataFrame:
    """(scene_id, m*, e*): the mean of each scene's points and the eigenvector of the largest variance; nine sums for each scene, then a 3 x 3 problem of one row."""

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                m = np.array([[r["c" + "".join(sorted(a + b))] for b in "xyz"] for a in "xyz"], float)
                e = np.linalg.eigh(m)[1][:, -1] if np.isfinite(m).all() else np.full(3, np.nan)
                out.append((r["scene_id"], r["mean_x"], r["mean_y"], r["mean_z"], *e.tolist()))
            yield pd.DataFrame(out, columns=["scene_id", "mx", "my", "mz", "ex", "ey", "ez"])

    return covariance(points).mapInPandas(solve, "scene_id bigint, mx double, my double, mz double, ex double, ey double, ez double")


def apex_by_pca(points: DataFrame, base: DataFrame) -> DataFrame:
    """The point of each scene farthest from the base (b*) along the leading axis, which is turned away from the base: (scene_id, point_id, x, y, z, projection); ties: the least id."""
    axis = leading_axis(points).join(base, "scene_id")
    sign = F.when(dot(minus(vec("m"), vec("b")), vec("e")) < 0, -1.0).otherwise(1.0)
    j = points.join(axis.withColumn("turn", sign), "scene_id")
    p = dot(minus(vec(), vec("b")), vec("e")) * F.col("turn")
    best = j.withColumn("projection", p).groupBy("scene_id").agg(F.min_by(F.struct("point_id", "x", "y", "z", "projection"), F.struct(-F.col("projection"), F.col("point_id"))).alias("p"))
    return best.select("scene_id", "p.*")


def apex_gap(points: DataFrame, base: DataFrame, meta: DataFrame) -> DataFrame:
    """(scene_id, far_id, pca_id, gap_mm): the apex by distance, the one by the leading axis, and how far they are apart. meta: (scene_id, scale_mm)."""
    a = apex(points, base).select("scene_id", F.col("point_id").alias("far_id"), *named(vec(), "f"))
    b = apex_by_pca(points, base).select("scene_id", F.col("point_id").alias("pca_id"), *named(vec(), "p"))
    j = a.join(b, "scene_id").join(meta.select("scene_id", "scale_mm"), "scene_id")
    return j.select("scene_id", "far_id", "pca_id", (norm(minus(vec("f"), vec("p"))) * F.col("scale_mm")).alias("gap_mm"))


def landmark_table(vertices: DataFrame, patch_faces: DataFrame, kinds: tuple[str, ...] = ("mitral", "tricuspid", "pulmonary")) -> DataFrame:
    """(scene_id, {kind}_patch, {kind}_x, .., apex_id, A_maxD_x, ..): the best patch of holes of each kind with its centroid by area, and the vertex farthest from the mitral one.

    patch_faces: the faces that close holes (scene_id, fid, v0, v1, v2); their components are the patches."""
    faces = held(component_faces(patch_faces))
    out = faces.select("scene_id").distinct()
    for kind in kinds:
        best = best_patch(hole_patch_scores(vertices, faces, kind), "scene_id", "component", "likelihood").withColumnRenamed("best", "component")
        mine = faces.join(best, ["scene_id", "component"], "left_semi")
        centre = area_weighted_centroid(vertices, mine).select("scene_id", *named(vec(), f"{kind}_"))
        out = out.join(best.select("scene_id", F.col("component").alias(f"{kind}_patch")), "scene_id", "left").join(centre, "scene_id", "left")
    base = out.select("scene_id", *named(vec(f"{kinds[0]}_"), "b"))
    far = apex(vertices.withColumnRenamed("vid", "point_id"), base).select("scene_id", F.col("point_id").alias("apex_id"), *named(vec(), "A_maxD_"))
    return out.join(far, "scene_id", "left")


# -- samples on planes


def build_slice_samples(
    surfaces: dict[str, tuple[DataFrame, DataFrame]], planes: DataFrame, step: float, n: int, mode: str = "contour", half: float = 0.05, expansion: float = 0.1,
    bands: tuple[float, ...] = (0.02, 0.05, 0.1), bins: int = 6, weights: tuple[float, ...] = (1, 1, 1), supervision: str = "hybrid",
    offset: str | None = None, depth: float | None = None,
) -> DataFrame:
    """Training samples of acquisition planes: (scene_id, plane_id, point_id, x, y, z, source_surface, sdf_*, mask_*), at most n for each plane.

    planes (scene_id, plane_id, o*, n*, u*, v*, side) get a grid, or with a depth a lattice that far to both sides (volume_grid), with an offset as in grid_axis; of it stay the points inside epi or near it, and of these n by budget
    of the surfaces. Distances are to the plane's own part of each surface: mode slab, to its faces within `half`; contour, to its
    segments in the plane; volume, to the whole surface. They have the sign of the whole surface, and are 0 with mask 0 where there is no such part."""
    if depth is None:
        last = F.lit(2**20)
        grid = planar_grid(planes, step, offset).withColumn("point_id", (F.col("plane_id") * last + F.col("i")) * last + F.col("j"))
    else:
        last = F.lit(2**16)
        grid = volume_grid(planes, step, depth, offset).withColumn("point_id", ((F.col("plane_id") * last + F.col("i")) * last + F.col("j")) * last + F.col("k"))
    names = ["scene_id", "plane_id", "point_id", "x", "y", "z"]
    signed = written(by_surfaces(grid.select(*names, "i", "j"), surfaces, None if mode == "volume" else ("epi",)), "slice-signs")
    rows = inside_or_near(signed.withColumn("inside", F.col("sign_epi") < 0), expansion, distance="distance_epi")
    key, signs, before = ["scene_id", "plane_id", "point_id"], [f"sign_{s}" for s in surfaces], signed
    if mode == "volume":
        rows = rows.select(*names, "i", "j", *[(F.col(f"distance_{s}") * F.col(f"sign_{s}")).alias(f"sdf_{s}") for s in surfaces])
    else:
        rows = rows.select(*names, "i", "j", *signs)
        coords = lambda p: [dot(minus(vec(p), vec("o")), vec(a)) for a in "uv"]
        if mode != "slab":
            flat = planes.select("scene_id", "plane_id", *named(vec("o"), "o"), *named(vec("u"), "u"), *named(vec("v"), "v"))
            rows = rows.join(flat.hint("merge"), ["scene_id", "plane_id"]).select(*key, "i", "j", *signs, *named(vec(), "at_"), *[c.alias(a) for a, c in zip("uv", coords(""))])
        for s, (v, f) in surfaces.items():  # each step reads the table of the one before, which holds all columns
            kept = [c for c in rows.columns if c not in key]
            if mode == "slab":
                near = plane_distance(rows, slab_clip(v, f, planes, half))
            else:
                cut = plane_contours(v, f, planes).filter("ax is not null and bx is not null").join(flat.hint("merge"), ["scene_id", "plane_id"])
                segments = cut.select("scene_id", "plane_id", *[c.alias(p + a) for p in "ab" for a, c in zip("uv", coords(p))])
                near = segment_distance(rows, segments, "scene_id", "plane_id", more=tuple(kept))
            rows = written(near.select(*key, *kept, (F.col("distance") * F.col(f"sign_{s}")).alias(f"sdf_{s}")), "slice-rows")
            drop_written(before)
            before = rows
        if mode != "slab":
            rows = rows.select("*", *[F.col("at_" + k).alias(k) for k in "xyz"])
        rows = rows.select(*names, "i", "j", *[f"sdf_{s}" for s in surfaces])
    rows = written(rows.withColumns({f"dist_{s}": F.abs(f"sdf_{s}") for s in surfaces}), "slice-distances")
    drop_written(before)
    # a plane is a scene of its own for the pick
    of_plane = rows.withColumn("scene_id", F.struct("scene_id", "plane_id"))
    picked = budget_pick(of_plane, n, list(bands), ["i", "j"], bins, weights=weights)
    picked = picked.select(F.col("scene_id.scene_id").alias("scene_id"), F.col("scene_id.plane_id").alias("plane_id"), "point_id", "source_surface")
    out = rows.join(picked, key)
    masks = supervision_mask(supervision)
    out = out.select(*names, "source_surface", *[f"sdf_{s}" for s in SURFACES], *masks)
    known = {s: finite(f"sdf_{s}") for s in SURFACES}
    return out.withColumns({f"mask_{s}": F.when(known[s], F.col(f"mask_{s}")).otherwise(0) for s in SURFACES}).withColumns({f"sdf_{s}": F.when(known[s], F.col(f"sdf_{s}")).otherwise(0.0) for s in SURFACES})


def line_compatibility(planes: DataFrame, vertices: DataFrame, faces: DataFrame, step: float, margin: float = 0.0) -> DataFrame:
    """(scene_id, sa_plane, la_plane, i, sdf_sa, sdf_lax): at points of the line that two planes share, the distance to the surface's contour in each plane, negative inside the surface; null without a contour."""
    points = held(plane_line_samples(planes, vertices, step, margin).withColumn("point_id", F.xxhash64("sa_plane", "la_plane", "i")))
    frames = square_frame(planes.select("scene_id", "plane_id", *vec("o"), *vec("n")))
    cut = plane_contours(vertices, faces, planes.select("scene_id", "plane_id", *vec("o"), *vec("n"))).filter("ax is not null and bx is not null").join(frames.hint("merge"), ["scene_id", "plane_id"])
    coords = lambda p: [dot(minus(vec(p), vec("o")), vec(a)) for a in "uv"]
    segments = held(cut.select("scene_id", "plane_id", *[c.alias(p + a) for p in "ab" for a, c in zip("uv", coords(p))]))
    out = points.join(winding_number(points, vertices, faces, SIGN_ERROR).select("scene_id", "point_id", "sign"), ["scene_id", "point_id"])
    for plane, name in (("sa_plane", "sdf_sa"), ("la_plane", "sdf_lax")):
        local = points.withColumn("plane_id", F.col(plane)).join(frames.hint("merge"), ["scene_id", "plane_id"]).select("scene_id", "plane_id", "point_id", *[c.alias(a) for a, c in zip("uv", coords(""))])
        d = segment_distance(local, segments, "scene_id", "plane_id").select("scene_id", "point_id", F.col("distance").alias(name))
        out = out.join(d, ["scene_id", "point_id"], "left").withColumn(name, F.col(name) * F.col("sign"))
    return out.select("scene_id", "sa_plane", "la_plane", "i", "sdf_sa", "sdf_lax")


def build_samples(surfaces: dict[str, tuple[DataFrame, DataFrame]], n: int, sigma: float, ball: int = 0) -> DataFrame:
    """Training samples of whole surfaces: (scene_id, point_id, x, y, z, source_surface, sdf_*): n points on each surface, each moved twice (see jitter), and `ball` points around the first one's centre, with their signed distances to all surfaces."""
    parts = []
    for i, (s, (v, f)) in enumerate(surfaces.items()):
        drawn = surface_points(v, f, n).select("scene_id", (F.col("draw").cast("bigint") * len(surfaces) + i).alias("point_id"), "x", "y", "z")
        moved = jitter(drawn, sigma).select("scene_id", (F.col("point_id") * 2 + F.col("near")).alias("point_id"), "x", "y", "z")
        parts.append(moved.withColumn("source_surface", F.lit(s)))
    if ball:
        first = next(iter(surfaces.values()))[0]
        around = ball_points(centroid(first), ball)
        parts.append(around.select("scene_id", (F.lit(2 * n * len(surfaces)) + F.col("draw")).cast("bigint").alias("point_id"), "x", "y", "z", F.lit("ball").alias("source_surface")))
    points = parts[0]
    for p in parts[1:]:
        points = points.unionByName(p)
    out = by_surfaces(written(points, "drawn-points"), surfaces)
    return out.select(*points.columns, *[(F.col(f"distance_{s}") * F.col(f"sign_{s}")).alias(f"sdf_{s}") for s in surfaces])


def score_rows(gt: DataFrame, pred: DataFrame, grid: DataFrame, tau: float | None = None, faces: tuple[DataFrame, DataFrame] | None = None, gamma: float = 0.5) -> DataFrame:
    """Metric rows (scene_id, metric, value) of reconstructions: distances of two point sets, overlap on a grid (sdf_pred, sdf_gt), and the varifold distance of two face tables, if given."""
    wide = overlap(grid).join(surface_scores(gt, pred, tau), "scene_id", "full")
    names = ["chamfer", "chamfer_sum", "hausdorff", "precision", "recall", "f1", "dice", "iou"]
    if faces is not None:
        wide, names = wide.join(varifold(*faces, gamma).withColumnRenamed("distance", "varifold"), "scene_id", "full"), [*names, "varifold"]
    return wide.unpivot(["scene_id"], names, "metric", "value")


def dataset_qa(samples: DataFrame, threshold: float, least: int) -> DataFrame:
    """One row per scene: counts near each surface, the first and last row without a mask, valid shares and ranges, the eight combinations of masks, and a status (failed below `least` rows)."""
    masks = mask_stats(samples).withColumn("combo", F.concat(F.lit("n_"), *[F.col(f"mask_{s}").cast("string") for s in SURFACES]))
    combos = [f"n_{a}{b}{c}" for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    masks = masks.groupBy("scene_id").pivot("combo", combos).agg(F.sum("n"))
    shares = valid_shares(samples).withColumn("name", F.concat(F.lit("percent_"), "surface")).groupBy("scene_id").pivot("name", [f"percent_{s}" for s in SURFACES]).agg(F.first("percent"))
    ranges = samples.groupBy("scene_id").agg(*[f(f"sdf_{s}").alias(f"{f.__name__}_{s}") for s in SURFACES for f in (F.min, F.max)])
    out = threshold_counts(samples, threshold)
    for part in (first_last_mask(samples), shares, ranges, masks):
        out = out.join(part, "scene_id")
    return out.withColumn("status", F.when(F.col("n_total") < least, "failed").otherwise("completed"))
