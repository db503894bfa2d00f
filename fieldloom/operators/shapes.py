"""Neighbours, triangles, thinning, registration and grids: joins within scenes and sums per scene."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldloom.functions.scalars import cross, dot, finite, minus, norm, uniform
from fieldloom.operators.bounding import HIGH, LOW, Reach, Sizes, between, by_scene, least_distance, matrix, met, within_reach
from fieldloom.operators.geometry import SIGN_ERROR, _winding, boxed_triangles, corners, face_table, nearest_row, rigid_fit, rigid_of, winding_number
from fieldloom.operators.spatial import _around, _d2, nearest_join, nearest_places, neighbours, sides
from fieldloom.scratch import drop_written, held, scratch_path, written

KEY = ["scene_id", "point_id"]


def _vec(prefix: str = "") -> list[Column]:
    return [F.col(prefix + k) for k in "xyz"]


def knn_join(left: DataFrame, right: DataFrame, k: int, **options) -> DataFrame:
    """(scene_id, point_id, rank, nearest_id, distance): the k nearest points of right in the scene, ties by id (see neighbours)."""
    found = neighbours(left, right, k, **options).filter("rank is not null")
    return found.select(*KEY, "rank", F.col("r_id").alias("nearest_id"), F.sqrt("d2").alias("distance"))


def transfer_labels(source: DataFrame, target: DataFrame) -> DataFrame:
    """target faces (scene_id, fid, x, y, z) with the tag of the nearest source face centre (scene_id, fid, x, y, z, tag)."""
    point = lambda df: df.withColumn("fid", F.col("fid").cast("bigint")).withColumnRenamed("fid", "point_id")
    near = nearest_join(point(target), point(source))
    tags = source.select("scene_id", F.col("fid").alias("nearest_id"), "tag")
    return near.join(tags, ["scene_id", "nearest_id"], "left").select("scene_id", F.col("point_id").alias("fid"), "tag")


def _to_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of points to segments, row by row."""
    d = b - a
    w = p - a
    size = (d * d).sum(-1)
    t = np.clip(np.divide((w * d).sum(-1), size, out=np.zeros(len(w)), where=size > 0), 0, 1)
    off = w - t[..., None] * d
    return (off * off).sum(-1)


def triangle_d2(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of points to triangles, row by row: the plane's where the foot lies in the triangle, else the nearest edge's."""
    ab, ac, w = b - a, c - a, p - a
    n = np.cross(ab, ac)
    n2 = (n * n).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gamma, beta = (np.cross(ab, w) * n).sum(-1) / n2, (np.cross(w, ac) * n).sum(-1) / n2
        plane = (w * n).sum(-1) ** 2 / n2
    inside = (gamma >= 0) & (beta >= 0) & (gamma + beta <= 1) & (n2 > 0)
    edges = np.minimum(np.minimum(_to_segments(p, a, b), _to_segments(p, b, c)), _to_segments(p, c, a))
    return np.where(inside, np.minimum(plane, edges), edges)


def least_triangle(points: np.ndarray, items: dict[str, np.ndarray], counts: list | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The least squared distance of each point to the triangles (ax .. cz), by boxes and spheres (see bounding.least_distance)."""
    a, b, c = corner = [np.stack([items[q + k] for k in "xyz"], 1) for q in "abc"]
    middle = (a + b + c) / 3
    reach = np.sqrt(np.maximum.reduce([((q - middle) ** 2).sum(1) for q in corner]))
    d2 = least_distance(points, np.minimum.reduce(corner), np.maximum.reduce(corner), middle, reach, lambda i, j: triangle_d2(points[i], a[j], b[j], c[j]), counts)
    return np.arange(len(points)), {"d2": d2}


def triangle_distance(points: DataFrame, vertices: DataFrame, faces: DataFrame, sizes: Sizes | None = None, items: DataFrame | None = None) -> DataFrame:
    """(scene_id, point_id, distance) of each point to the surface; null in a scene without faces. Blocks of points meet the blocks of faces that can be nearest (see bounding.met). items: the faces as boxed_triangles, if they are at hand."""
    p = points.select(*KEY, *[F.col(k).cast("double").alias(k) for k in "xyz"])
    items = boxed_triangles(corners(vertices, faces)) if items is None else items
    near = met(p, items, least_triangle, "d2 double", nearest_row, sizes=sizes)
    return near.select(*KEY, F.sqrt("d2").alias("distance"))


def _signs(points: np.ndarray, corner: dict[str, np.ndarray], vertices: np.ndarray) -> np.ndarray:
    """-1 for points inside the triangles (ax .. cz), else 1, as winding_number has it with SIGN_ERROR; vertices: those of the surface."""
    sign = np.ones(len(points), np.int32)
    if not len(corner["ax"]):
        return sign
    high = vertices.max(0)
    at = np.flatnonzero((points >= np.fmin.reduce(vertices)).all(1) & (points <= np.where(np.isnan(high), np.inf, high)).all(1))
    if len(at):
        w = _winding(points[at], corner, SIGN_ERROR / 2)[1]["w"]
        open_ = np.flatnonzero(np.abs(np.abs(w) - 0.5) <= SIGN_ERROR)
        if len(open_):
            w[open_] = _winding(points[at[open_]], corner, 0.0)[1]["w"]
        sign[at[np.abs(w) > 0.5]] = -1
    return sign


def _by_surfaces(a: pa.Table, b: pa.Table, tables: list[tuple[str, int]], measured: tuple[str, ...], names: list[str], schema: pa.Schema) -> pa.Table:
    """The rows of a pack's points with distances and signs for each surface (its name and the number of its table of faces)."""
    order_a, order_b, at_a, at_b = by_scene(a, b, "scene_id")
    points, place = matrix(a, list("xyz"))[order_a], matrix(b, list("xyz"))[order_b]
    face, of, ids = (b.column(c).to_numpy(zero_copy_only=False)[order_b] for c in ("face", "of", "id"))
    ends = np.stack([b.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)[order_b] for c in ("v0", "v1", "v2")], 1).reshape(-1, 3)
    d, sign = np.full((len(tables), len(points)), np.nan), np.ones((len(tables), len(points)), np.int32)
    for (a0, a1), (b0, b1) in zip(at_a, at_b):
        at = a0 + np.flatnonzero(np.isfinite(points[a0:a1]).all(1))
        if b1 == b0 or not len(at):
            continue
        for s, (name, faces) in enumerate(tables):
            mine = b0 + np.flatnonzero(~face[b0:b1] & (of[b0:b1] == s))
            mine = mine[np.argsort(ids[mine], kind="stable")]
            tri = ends[b0 + np.flatnonzero(face[b0:b1] & (of[b0:b1] == faces))]
            if not len(mine) or not len(tri):
                continue
            row = np.minimum(np.searchsorted(ids[mine], tri), len(mine) - 1)
            tri = place[mine[row[(ids[mine[row]] == tri).all(1)]]]  # faces x corners x coordinates
            tri = tri[np.isfinite(tri).all((1, 2))]
            corner = {q + k: tri[:, i, j] for i, q in enumerate("abc") for j, k in enumerate("xyz")}
            if name in measured and len(tri):
                d[s, order_a[at]] = np.sqrt(least_triangle(points[at], corner)[1]["d2"])
            sign[s, order_a[at]] = _signs(points[at], corner, place[mine])
    out = {c: a.column(c) for c in names}
    for s, (name, _) in enumerate(tables):
        if name in measured:
            out[f"distance_{name}"] = pa.array(d[s], mask=np.isnan(d[s]))
        out[f"sign_{name}"] = pa.array(sign[s])
    return pa.table(out).select(schema.names).cast(schema)


def by_surfaces(points: DataFrame, surfaces: dict[str, tuple[DataFrame, DataFrame]], measured: tuple[str, ...] | None = None, sizes: Sizes | None = None) -> DataFrame:
    """points (scene_id, point_id, x, y, z and more) with sign_* (-1 inside, else 1) for each surface (vertices, faces), and distance_* (null without faces) for all or for the measured ones.

    Points, vertices and faces of scenes of bounded size are dealt to tasks in packs once, for all surfaces, and a face finds its corners in its task.
    Scenes with more rows or pairs go surface by surface (see triangle_distance, winding_number)."""
    sizes = sizes or Sizes()
    names, measured = points.columns, tuple(surfaces) if measured is None else measured
    number = lambda c: F.col(c).cast("bigint")
    listed: list[DataFrame] = []
    tables, parts = [], []
    for s, (name, (v, f)) in enumerate(surfaces.items()):
        parts.append(v.select("scene_id", F.lit(False).alias("face"), F.lit(s).alias("of"), number("vid").alias("id"), *[F.lit(None).cast("bigint").alias(c) for c in ("v0", "v1", "v2")], *[F.col(k).cast("double").alias(k) for k in "xyz"]))
        known = [i for i, other in enumerate(listed) if other is f]
        if not known:  # surfaces that share their faces send them once
            known = [len(listed)]
            listed.append(f)
            none = [F.lit(None).cast("double").alias(k) for k in "xyz"]
            parts.append(f.select("scene_id", F.lit(True).alias("face"), F.lit(known[0]).alias("of"), number("fid").alias("id"), *[number(c).alias(c) for c in ("v0", "v1", "v2")], *none))
        tables.append((name, known[0]))
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    n = points.groupBy("scene_id").agg(F.count("*").alias("n_left")).join(items.groupBy("scene_id").agg(F.count("*").alias("n_right")), "scene_id", "left").fillna(0, ["n_right"])
    big = (F.col("n_left") > sizes.scene_rows) | (F.col("n_right") > sizes.scene_rows) | (F.col("n_left") * F.col("n_right") > sizes.scene_pairs)
    n = held(n.withColumn("big", big))
    total = n.agg(F.sum(F.when(~F.col("big"), F.col("n_left") + F.col("n_right"))).alias("rows"), F.count_if("big").alias("big")).first()
    small, near = points, items
    if total.big:
        small, near = (df.join(n.filter("big").select("scene_id"), "scene_id", "left_anti").select(*df.columns) for df in (points, items))
    packs = F.lit(1 + (total.rows or 0) // sizes.pack_rows)
    pack = lambda df, other: df.withColumn("pack", F.pmod(F.xxhash64(F.coalesce(F.col("scene_id").cast("string"), F.xxhash64(other).cast("string"))), packs)).groupBy("pack")
    added = StructType.fromDDL(", ".join((f"distance_{s} double, " if s in measured else "") + f"sign_{s} int" for s in surfaces))
    schema = StructType([*points.schema.fields, *added.fields])
    arrow = to_arrow_schema(schema)
    out = pack(small, "point_id").cogroup(pack(near, "id")).applyInArrow(lambda a, b: _by_surfaces(a, b, tables, measured, names, arrow), schema)
    if not total.big:
        return out
    of = lambda df: df.join(n.filter("big").select("scene_id"), "scene_id", "left_semi").select(*df.columns)
    large = base = written(of(points), "surface-points")
    for s, (v, f) in surfaces.items():
        v, f = of(v), of(f)
        faces = written(boxed_triangles(corners(v, f)), "surface-faces")
        if s in measured:
            large = large.join(written(triangle_distance(base, v, f, sizes, faces), "surface-distance").withColumnRenamed("distance", f"distance_{s}"), KEY)
        sign = winding_number(base, v, f, SIGN_ERROR, sizes, faces).select(*KEY, F.col("sign").alias(f"sign_{s}"))
        large = large.join(written(sign, "surface-sign"), KEY)
    return out.unionByName(large.select(*out.columns))


def signed_distance(points: DataFrame, vertices: DataFrame, faces: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Distance to the surface, negative inside."""
    p = points.select(*KEY, *[F.col(k).cast("double").alias(k) for k in "xyz"])
    return by_surfaces(p, {"own": (vertices, faces)}, sizes=sizes).select(*KEY, (F.col("distance_own") * F.col("sign_own")).alias("sdf"))


def plane_distance(points: DataFrame, patches: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """points (scene_id, plane_id, point_id, x, y, z and more) with distance: to their own plane's patch (scene_id, plane_id, fid, a*, b*, c*); null without one."""
    one = F.concat_ws("/", "scene_id", "plane_id").alias("plane")  # a plane is a scene of its own
    c = patches.select(one, "fid", *[q + k for q in "abc" for k in "xyz"])
    near = met(points.select(one, *points.columns), boxed_triangles(c, "plane"), least_triangle, "d2 double", nearest_row, sizes=sizes)
    return near.select(*points.columns, F.sqrt("d2").alias("distance"))


def multi_plane_sdf(points: DataFrame, patches: DataFrame, vertices: DataFrame, faces: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """(scene_id, point_id, plane_id, sdf): each point (with plane_id) against its own plane's patch (see plane_distance), with the sign of the whole surface; null without a patch.

    The points are dealt once for their signs and once for their distances; the signs go with them, and are not joined."""
    key = [*KEY, "plane_id"]
    p = points.select(*key, *[F.col(k).cast("double").alias(k) for k in "xyz"])
    signed = written(by_surfaces(p, {"own": (vertices, faces)}, (), sizes), "plane-signs")
    return plane_distance(signed, patches, sizes).select(*key, (F.col("distance") * F.col("sign_own")).alias("sdf"))


def inside_or_near(rows: DataFrame, expansion: float, inside: str = "inside", distance: str = "distance") -> DataFrame:
    """Rows that are inside, whatever their distance, or have a finite distance of no more than expansion."""
    return rows.filter(F.coalesce(F.col(inside), F.lit(False)) | (finite(distance) & (F.col(distance) <= expansion)))


def _in_slab(points: np.ndarray, items: dict[str, np.ndarray], half: float, axis: tuple[float, ...]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The least squared distance of each point to the items that are at most `half` off along the axis; points without one have no result."""
    q = np.stack([items[c] for c in LOW], 1)
    along = lambda p: sum(p[:, k] * a for k, a in enumerate(axis))
    place, index, found = along(q), [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, 2_000_000 // max(1, len(q)))
    for at in range(0, len(points) if len(q) else 0, step):
        part = points[at : at + step]
        i, j = np.nonzero(np.abs(along(part)[:, None] - place[None, :]) <= half)
        if len(i):
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            found.append(np.minimum.reduceat(sum((part[i, k] - q[j, k]) ** 2 for k in range(3)), first))
            index.append(i[first] + at)
    return np.concatenate(index), {"d2": np.concatenate(found)}


def _slab_reach(a: pa.Table, b: pa.Table, half: float, axis: tuple[float, ...], chunk: int) -> pa.Table:
    """PAIRS of the blocks that a slab can join: not those that are farther than one whose rows are all within the slab. A block of points without any has its first, so that its points stay."""
    p, q = matrix(a, LOW + HIGH), matrix(b, LOW + HIGH)
    ends = lambda m: [sum(f(m[:, k] * w, m[:, k + 3] * w) for k, w in enumerate(axis)) for f in (np.minimum, np.maximum)]
    (al, ah), (bl, bh) = ([e[:, None] for e in ends(p)], [e[None, :] for e in ends(q)])
    slack = 1e-9 * (half + np.abs(np.concatenate([ah.ravel(), al.ravel(), bh.ravel(), bl.ravel()])).max())
    near, far = between(p, q)
    sure = np.maximum(ah - bl, bh - al) <= half - slack
    hit = (np.maximum(bl - ah, al - bh) <= half + slack) & (near <= np.where(sure, far, np.inf).min(1)[:, None] * (1 + 1e-9) + 1e-300)
    hit[:, 0] |= ~hit.any(1)
    i, j = np.nonzero(hit)
    many = hit.sum(1)
    place = np.arange(len(i)) - (np.cumsum(many) - many)[i]
    left, right = (t.column("block").to_numpy() for t in (a, b))
    return pa.table({"block": left[i], "r_block": right[j], "chunk": (place // chunk).astype(np.int32), "several": many[i] > chunk})


def slab_vertex_distance(points: DataFrame, vertices: DataFrame, half: float, axis: tuple[float, float, float] = (0.0, 0.0, 1.0), sizes: Sizes | None = None) -> DataFrame:
    """The least distance of each point to vertices that are at most `half` off along the unit axis; null without one, and where a coordinate of the point is null or not finite.

    Scenes are searched whole, in packs; blocks of a large one meet those that the slab can join (see bounding.met). So no row is copied for bins, and no pair leaves its task."""
    sizes = sizes or Sizes()
    p = points.select(*KEY, *[F.col(k).cast("double").alias(k) for k in "xyz"])
    q = vertices.select("scene_id", *[F.col(c).cast("double").alias(n) for c, n in zip("xyz" * 2, LOW + HIGH)])
    for c in LOW:
        q = q.filter(finite(c))
    reach = Reach(lambda a, b: _slab_reach(a, b, half, axis, sizes.chunk), "")
    near = met(p, q, lambda a, b: _in_slab(a, b, half, axis), "d2 double", nearest_row, sizes=sizes, reach=reach)
    return near.select(*KEY, F.sqrt("d2").alias("distance"))


def angle_defect(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(scene_id, vid, mass): two pi less the angles of the faces around each vertex."""
    c = corners(vertices, faces)

    def angle(p, q, r):
        u, w = minus(_vec(q), _vec(p)), minus(_vec(r), _vec(p))
        return F.atan2(norm(cross(u, w)), dot(u, w))

    rows = c.select("scene_id", F.explode(F.array(*[F.struct(F.col(v).alias("vid"), angle(*o).alias("angle")) for v, o in (("v0", "abc"), ("v1", "bca"), ("v2", "cab"))])).alias("t"))
    return rows.groupBy("scene_id", F.col("t.vid").alias("vid")).agg((2 * math.pi - F.sum("t.angle")).alias("mass"))


def edge_bend(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(scene_id, p, q, mass): the length of each edge of two faces times the angle between their normals."""
    t = face_table(vertices, faces).select("scene_id", "fid", "nx", "ny", "nz")
    sides = F.array(*[F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    e = faces.select("scene_id", "fid", F.explode(sides).alias("e")).join(t.hint("merge"), ["scene_id", "fid"]).groupBy("scene_id", "e.p", "e.q")
    e = e.agg(F.count("*").alias("n"), F.min_by(F.struct("nx", "ny", "nz"), "fid").alias("f"), F.max_by(F.struct("nx", "ny", "nz"), "fid").alias("g")).filter("n = 2")
    for v in "pq":
        e = e.join(vertices.select("scene_id", F.col("vid").alias(v), *[F.col(k).alias(v + k) for k in "xyz"]).hint("merge"), ["scene_id", v])
    f, g = ([F.col(f"{s}.n{k}") for k in "xyz"] for s in "fg")
    return e.select("scene_id", "p", "q", (norm(minus(_vec("q"), _vec("p"))) * F.atan2(norm(cross(f, g)), dot(f, g))).alias("mass"))


def signed_bends(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(scene_id, p, q, px .. qz, bend): the edges of two faces, and the angle between their normals, negative where the surface is hollow."""
    t = face_table(vertices, faces)
    sides = F.array(*[F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    e = faces.select("scene_id", "fid", F.explode(sides).alias("e")).join(t.hint("merge"), ["scene_id", "fid"]).groupBy("scene_id", "e.p", "e.q")
    face = F.struct("nx", "ny", "nz", "x", "y", "z")
    e = e.agg(F.count("*").alias("n"), F.min_by(face, "fid").alias("f"), F.max_by(face, "fid").alias("g")).filter("n = 2")
    for v in "pq":
        e = e.join(vertices.select("scene_id", F.col("vid").alias(v), *[F.col(k).alias(v + k) for k in "xyz"]).hint("merge"), ["scene_id", v])
    f, g = ([F.col(f"{s}.n{k}") for k in "xyz"] for s in "fg")
    above = dot(f, minus([F.col(f"g.{k}") for k in "xyz"], _vec("p")))  # of the second face's centre over the first face
    bend = F.atan2(norm(cross(f, g)), dot(f, g))
    return e.select("scene_id", "p", "q", *_vec("p"), *_vec("q"), F.when(above > 0, -bend).otherwise(bend).alias("bend"))


def clipped_length(a: np.ndarray, b: np.ndarray, c: np.ndarray, radius: float) -> np.ndarray:
    """The length of what of the segment from a to b lies in the ball around c, row by row."""
    d, w = b - a, a - c
    dd, dw, ww = (d * d).sum(1), (w * d).sum(1), (w * w).sum(1) - radius * radius
    root = np.sqrt(np.maximum(dw * dw - dd * ww, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.clip((-dw + root) / dd, 0, 1) - np.clip((-dw - root) / dd, 0, 1)
    return np.where((dd > 0) & (dw * dw > dd * ww), share * np.sqrt(dd), 0)


def _in_balls(points: np.ndarray, items: dict[str, np.ndarray], gauss_radius: float, mean_radius: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each point the sum of what vertices in its ball weigh, and half the sum of edge lengths in its ball times what the edges weigh."""
    a, b = (np.stack([items[p + k] for k in "xyz"], 1) for p in "ab")
    weight, edge = items["weight"], items["edge"].astype(bool)
    half = np.sqrt(((b - a) ** 2).sum(1)) / 2
    middle, reach = (a + b) / 2, np.where(edge, (mean_radius + half) * (1 + 1e-9), gauss_radius * (1 + 1e-9))
    sums = np.zeros((2, len(points)))
    step = max(1, 1_000_000 // max(1, len(a)))
    for at in range(0, len(points) if len(a) else 0, step):
        part = points[at : at + step]
        i, j = np.nonzero(sum((part[:, k, None] - middle[None, :, k]) ** 2 for k in range(3)) <= (reach * reach)[None])
        for side in (False, True):
            of = edge[j] == side
            p, q, n = part[i[of]], j[of], i[of]
            if side:
                value = clipped_length(a[q], b[q], p, mean_radius) / 2
                value, n = (value * weight[q])[value > 0], n[value > 0]
            else:
                inside = sum((p[:, k] - a[q, k]) ** 2 for k in range(3)) <= gauss_radius * gauss_radius
                value, n = weight[q][inside], n[inside]
            sums[int(side), at : at + step] = np.bincount(n, value, len(part))
    return np.arange(len(points)), {"gauss": sums[0], "mean": sums[1]}


def ball_curvature(points: DataFrame, vertices: DataFrame, faces: DataFrame, gauss_radius: float, mean_radius: float, sizes: Sizes | None = None) -> DataFrame:
    """(scene_id, point_id, gauss, mean): in a ball around each point the sum of angle defects of vertices, and half the sum of edge lengths, clipped to the ball, times signed bends.

    Scenes are searched whole, in packs; blocks of a large one meet those that a ball can reach (see bounding.met). So no row is copied for cells, and no pair leaves its task.
    Vertices and edges are made once, in a table of the shared folder."""
    sizes = sizes or Sizes()
    ends = [p + k for p in "ab" for k in "xyz"]
    item = lambda edge, first, last, weight: [F.lit(edge).alias("edge"), *[F.col(c).cast("double").alias(n) for c, n in zip(first + last, ends)], F.col(weight).cast("double").alias("weight")]
    at = [list("xyz"), ["px", "py", "pz"], ["qx", "qy", "qz"]]
    items = angle_defect(vertices, faces).join(vertices.select("scene_id", "vid", *_vec()).hint("merge"), ["scene_id", "vid"]).select("scene_id", *item(False, at[0], at[0], "mass"))
    items = items.unionByName(signed_bends(vertices, faces).select("scene_id", *item(True, at[1], at[2], "bend"))).filter("weight is not null")
    for c in ends:
        items = items.filter(finite(c))
    box = [f("a" + k, "b" + k).alias(n) for f, names in ((F.least, LOW), (F.greatest, HIGH)) for k, n in zip("xyz", names)]
    items = written(items, "curvature").select("*", *box)

    def merge(rows):
        first = [F.first(c).alias(c) for c in rows.columns if c not in ("row", "several", "gauss", "mean")]
        return rows.groupBy("row").agg(*first, F.sum("gauss").alias("gauss"), F.sum("mean").alias("mean"))

    p = points.select(*KEY, *[F.col(k).cast("double").alias(k) for k in "xyz"])
    reach = Reach(lambda a, b: within_reach(a, b, max(gauss_radius, mean_radius), sizes.chunk), "")
    out = met(p, items, lambda a, b: _in_balls(a, b, gauss_radius, mean_radius), "gauss double, mean double", merge, sizes=sizes, reach=reach)
    return out.select(*KEY, "gauss", "mean").na.fill(0.0, ["gauss", "mean"])


def curvature_weight(curvatures: DataFrame, power: float = 0.75, share: float = 0.1) -> DataFrame:
    """(scene_id, point_id, weight): of each scene's points the shares of |gauss| ** power and of |mean| ** power, mixed by `share` of the second; 0 where a scene has none. They add up to 1."""
    of = lambda c: F.pow(F.abs(F.col(c)), F.lit(power))
    total = curvatures.groupBy("scene_id").agg(F.sum(of("gauss")).alias("all_gauss"), F.sum(of("mean")).alias("all_mean"))
    both = lambda g, m: (1 - share) * F.coalesce(g / F.nullif(F.col("all_gauss"), F.lit(0.0)), F.lit(0.0)) + share * F.coalesce(m / F.nullif(F.col("all_mean"), F.lit(0.0)), F.lit(0.0))
    whole = both(F.col("all_gauss"), F.col("all_mean"))
    return curvatures.join(total, "scene_id").select(*KEY, F.coalesce(both(of("gauss"), of("mean")) / F.nullif(whole, F.lit(0.0)), F.lit(0.0)).alias("weight"))


def tagged_landmarks(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Centres of each tag's faces; of two tags whose centres are nearest to each other, the mean: (scene_id, tag, other, x, y, z)."""
    centres = face_table(vertices, faces).join(faces.select("scene_id", "fid", "tag").hint("merge"), ["scene_id", "fid"]).groupBy("scene_id", "tag").agg(*[F.avg(k).alias(k) for k in "xyz"])
    other = centres.select("scene_id", F.col("tag").alias("other"), *[F.col(k).alias("r_" + k) for k in "xyz"])
    near = centres.join(other, "scene_id").filter("tag != other").groupBy("scene_id", "tag").agg(F.min_by(F.struct("other", "r_x", "r_y", "r_z"), F.struct(_d2(), "other")).alias("n"))
    near = near.join(centres, ["scene_id", "tag"])
    back = near.select("scene_id", F.col("tag").alias("other"), F.col("n.other").alias("tag"))
    pairs = near.select("scene_id", "tag", F.col("n.other").alias("other"), *[((F.col(k) + F.col("n.r_" + k)) / 2).alias(k) for k in "xyz"])
    return pairs.filter("tag < other").join(back, ["scene_id", "tag", "other"], "left_semi")


def grid_axis(half: Column | float, step: float, offset: str | None, key: list[Column | str]) -> Column:
    """The places of a grid's points along an axis from -half to half as an array: from -half on (offset None), from up to a step farther (step), or from up to half a step on either side (centred), drawn by the key."""
    if step <= 0:
        raise ValueError("the step of a grid has to be positive")
    half = half if isinstance(half, Column) else F.lit(float(half))
    if offset is None:
        first, last = F.lit(0.0), F.floor(2 * half / step + 1e-9)
    elif offset == "step":
        first = uniform(*key, F.lit("offset")) * step
        last = F.floor((2 * half - first) / step + 1e-12 / step)
    elif offset == "centred":
        first = (uniform(*key, F.lit("offset")) - 0.5) * step
        last = F.ceil((2 * half - first) / step + 0.5) - 1
    else:
        raise ValueError(f"an offset is None, step or centred, not {offset}")
    return F.when(last < 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0))), lambda i: i * step - half + first))


def _lattice(planes: DataFrame, step: float, offset: str | None, axes: list[tuple[str, str, Column | float]]) -> DataFrame:
    """Points of planes on a lattice of these axes: (name of the place, prefix of the direction, half extent)."""
    rows = planes
    for place, _, half in axes:
        values = grid_axis(half, step, offset, ["scene_id", "plane_id", F.lit(place)])
        rows = rows.select("*", F.posexplode(values).alias(place, "at_" + place))
    at = [(F.col("o" + c) + sum(F.col("at_" + place) * F.col(d + c) for place, d, _ in axes)).alias(c) for c in "xyz"]
    return rows.select("scene_id", "plane_id", *[F.col(place).cast("bigint").alias(place) for place, _, _ in axes], *at)


def planar_grid(planes: DataFrame, step: float, offset: str | None = None) -> DataFrame:
    """Points of a square grid on planes (scene_id, plane_id, o*, u*, v*, side): i and j from 0, within side / 2 of the centre; offsets of both axes as in grid_axis."""
    return _lattice(planes, step, offset, [("i", "u", F.col("side") / 2), ("j", "v", F.col("side") / 2)])


def volume_grid(planes: DataFrame, step: float, half_width: float, offset: str | None = None) -> DataFrame:
    """Points of a lattice in the slab of planes (scene_id, plane_id, o*, u*, v*, n*: unit normal, side): i, j and k from 0, within side / 2 along u and v and half_width along the normal."""
    return _lattice(planes, step, offset, [("i", "u", F.col("side") / 2), ("j", "v", F.col("side") / 2), ("k", "n", half_width)])


def box_grid(scenes: DataFrame, res: int, half: float = 1.05) -> DataFrame:
    """res ** 3 points of each scene's cube from -half to half, with their places ix, iy, iz."""
    rows = scenes.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(res**3 - 1))).alias("i"))
    place = {"ix": F.floor(F.col("i") / res**2), "iy": F.floor(F.col("i") / res) % res, "iz": F.col("i") % res}
    rows = rows.select("scene_id", *[p.cast("int").alias(n) for n, p in place.items()])
    return rows.select("*", *[(F.col("i" + k) * (2 * half / (res - 1)) - half).alias(k) for k in "xyz"])


def normal(*key: Column | str) -> Column:
    """A standard normal number that depends on the key alone."""
    return F.sqrt(-2 * F.ln(uniform(*key, F.lit("r")))) * F.cos(2 * math.pi * uniform(*key, F.lit("a")))


def jitter(points: DataFrame, sigma: float) -> DataFrame:
    """Each point twice: moved by N(0, sigma) (near = 0) and by N(0, sigma / 10) (near = 1) along each axis."""
    rows = points.select(*KEY, "x", "y", "z", F.explode(F.array(F.lit(0), F.lit(1))).alias("near"))
    size = F.when(F.col("near") == 0, sigma).otherwise(sigma / 10)
    return rows.select(*KEY, "near", *[(F.col(k) + size * normal(*KEY, "near", F.lit(k))).alias(k) for k in "xyz"])


def ball_points(scenes: DataFrame, n: int) -> DataFrame:
    """n points of each scene (scene_id, x, y, z: the centre) uniform in the unit ball around its centre."""
    rows = scenes.select("scene_id", "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    r, h, a = (uniform("scene_id", "draw", F.lit(k)) for k in ("radius", "height", "turn"))
    rows = rows.select("*", F.cbrt(r).alias("r"), (2 * h - 1).alias("h"), (2 * math.pi * a).alias("turn"))
    flat = F.col("r") * F.sqrt(1 - F.col("h") * F.col("h"))
    return rows.select("scene_id", "draw", (F.col("x") + flat * F.cos("turn")).alias("x"), (F.col("y") + flat * F.sin("turn")).alias("y"), (F.col("z") + F.col("r") * F.col("h")).alias("z"))


def most_in_square(side: float, least: float) -> int:
    """At most so many points of a square can be `least` apart, by the hexagonal packing."""
    if side <= 0 or least <= 0:
        raise ValueError("the side and the least distance have to be positive")
    return int(2 / math.sqrt(3) * side**2 / least**2)


def _first_apart(p: np.ndarray, least: float, share: int = 256) -> np.ndarray:
    """The places of the points (in their order) that stay if one after another is taken that is not nearer than `least` to one taken before."""
    within = lambda a, b: sum((a[:, c, None] - b[None, :, c]) ** 2 for c in range(3)) < least * least
    left, kept = np.arange(len(p)), []
    while len(left):
        part, left = left[:share], left[share:]
        near, free = within(p[part], p[part]), np.ones(len(part), bool)
        taken = []
        for i in range(len(part)):
            if free[i]:
                taken.append(i)
                free &= ~near[i]
        kept.append(part[taken])
        step = max(1, 1_000_000 // len(taken))
        left = np.concatenate([left[at : at + step][~within(p[left[at : at + step]], p[kept[-1]]).any(1)] for at in range(0, len(left), step)] or [left])
    return np.concatenate([*kept, np.zeros(0, np.int64)])


def _thinned(table: pa.Table, least: float, names: list[str]) -> pa.Table:
    """The rows of whole scenes (scene_id, point_id, x, y, z, h) that stay; those without a scene, or with a coordinate that is null or not finite, all do."""
    table = table.sort_by([(c, "ascending") for c in ("scene_id", "h", "point_id", "x", "y", "z")]).combine_chunks()
    points = matrix(table, list("xyz"))
    scene = table.column("scene_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    sound = (scene >= 0) & np.isfinite(points).all(1)
    at = np.flatnonzero(sound)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(scene[at])) + 1, [len(at)]])
    kept = [at[i:j][_first_apart(points[at[i:j]], least)] for i, j in zip(cuts[:-1], cuts[1:])]
    return table.take(pa.array(np.concatenate([np.flatnonzero(~sound), *kept]))).select(names)


def _apart_in_rounds(p: DataFrame, least: float) -> DataFrame:
    """The rows of p (scene_id, point_id, x, y, z, h) that _first_apart keeps, by a table of all pairs nearer than `least`.

    In each round points before all neighbours that are still open stay, and their neighbours go. The first open point of all always stays, so rounds end."""
    p = p.withColumn("order", F.struct("h", "point_id"))
    cells = p.select("scene_id", F.col("order").alias("r_order"), *[F.col(k).alias("r_" + k) for k in "xyz"], *[F.floor(F.col(k) / least).alias("c" + k) for k in "xyz"])
    pairs = written(_around(p, least).join(cells.hint("merge"), ["scene_id", "cx", "cy", "cz"]).filter((_d2() < least * least) & (F.col("order") != F.col("r_order"))).select("scene_id", "order", "r_order"), "thin-pairs")
    left, kept = written(p.select("scene_id", "order"), "thin-left"), []
    while True:
        first = pairs.groupBy("scene_id", "order").agg(F.min("r_order").alias("first"))
        stay = written(left.join(first, ["scene_id", "order"], "left").filter("first is null or order < first").select("scene_id", "order"), "thin-stay")
        kept.append(stay)
        gone = pairs.join(stay, ["scene_id", "order"], "left_semi").select("scene_id", F.col("r_order").alias("order")).unionByName(stay).distinct()
        gone = written(gone, "thin-gone")
        now = written(left.join(gone, ["scene_id", "order"], "left_anti"), "thin-left")
        drop_written(left)
        left = now
        if not left.limit(1).count():
            break
        out = gone.withColumnRenamed("order", "r_order")
        now = written(pairs.join(gone, ["scene_id", "order"], "left_anti").join(out, ["scene_id", "r_order"], "left_anti").select("scene_id", "order", "r_order"), "thin-pairs")
        for table in (pairs, gone):
            drop_written(table)
        pairs = now
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return p.join(out, ["scene_id", "order"], "left_semi").drop("order")


def _thin_large(p: DataFrame, least: float, most: int, scene_rows: int) -> DataFrame:
    """The rows of p (scene_id, point_id, x, y, z, h) that stay, for scenes of up to `most` rows.

    The first points of each scene in the keyed order, about scene_rows at most, are taken by a task for each scene; then twice as many
    in each step. Before a step, points near one that stays go, so a point has few neighbours among those of its step, however dense a place is."""
    names, share = p.columns, scene_rows / most
    sound = finite("x") & finite("y") & finite("z")
    parts, left = [p.filter(~sound)], written(p.filter(sound), "thin-open")
    first = True
    while True:
        step = left.filter(F.col("h") < share)
        kept = step.groupBy("scene_id").applyInArrow(lambda t: _thinned(t, least, names), p.schema) if first else _apart_in_rounds(step, least).select(*names)
        kept = written(kept, "thin-kept")
        parts.append(kept)
        rest = left.filter(F.col("h") >= share)
        if share >= 1 or not rest.limit(1).count():
            break
        far = neighbours(rest.select(*KEY, "x", "y", "z"), kept).filter(F.coalesce(F.col("d2") >= least * least, F.lit(True)))
        now = written(rest.join(far.select(*KEY), KEY, "left_semi").select(*names), "thin-open")
        drop_written(left)
        left, share, first = now, 2 * share, False
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def min_distance_thin(
    points: DataFrame, least: float, salt: str = "thin", n: int | None = None, side: float | None = None, scene_rows: int = 10_000, pack_rows: int = 40_000,
) -> DataFrame:
    """A largest-possible choice of each scene's points no two of which are nearer than `least` (none can be added), or its first n in the keyed order.

    An n beyond what a square of that side can hold (most_in_square) is an error.

    Points have a keyed order, and one after another is taken that is not nearer than `least` to one taken before. Scenes of at most scene_rows rows are
    dealt to tasks in packs, each scene whole, and no pair is written. Larger ones are taken in steps (see _thin_large). Points without a scene, or with a coordinate that is null or not finite, stay."""
    if n is not None and side is not None and n > most_in_square(side, least):
        raise ValueError(f"{n} points {least} apart don't fit a square of side {side}, which holds {most_in_square(side, least)} at most")
    p = points.select(*KEY, *[F.col(k).cast("double").alias(k) for k in "xyz"], uniform(*KEY, F.lit(salt)).alias("h"))
    sizes = held(points.groupBy("scene_id").agg(F.count("*").alias("many")))
    large = F.col("scene_id").isNotNull() & (F.col("many") > scene_rows)
    total = sizes.agg(F.sum(F.when(~large, F.col("many"))).alias("rows"), F.max(F.when(large, F.col("many"))).alias("most")).first()
    big = sizes.filter(large).select("scene_id")
    small = p.join(big, "scene_id", "left_anti") if total.most else p
    names = [*KEY, "h"]
    schema = p.select(*names).schema
    packs = F.lit(1 + (total.rows or 0) // pack_rows)
    small = small.select("*", F.pmod(F.xxhash64(F.coalesce(F.col("scene_id").cast("string"), F.xxhash64("point_id").cast("string"))), packs).alias("pack"))
    out = small.groupBy("pack").applyInArrow(lambda t: _thinned(t, least, names), schema)
    if total.most:
        out = out.unionByName(_thin_large(p.join(big, "scene_id", "left_semi"), least, total.most, scene_rows).select(*names))
    if n is not None:
        out = out.withColumn("rank", F.row_number().over(W.partitionBy("scene_id").orderBy("h", "point_id"))).filter(F.col("rank") <= n)
    return out.select(*KEY)


def cross_covariance(pairs: DataFrame) -> DataFrame:
    """Per scene the means of sources (x, y, z) and targets (tx, ty, tz), and the nine sums of target times source about them."""
    n = F.count("*")
    return pairs.groupBy("scene_id").agg(n.alias("n"), *[F.avg(c).alias("mean_" + c) for c in ("x", "y", "z", "tx", "ty", "tz")], *[(F.covar_pop("t" + a, b) * n).alias(f"h_{a}{b}") for a in "xyz" for b in "xyz"])


def plane_equations(pairs: DataFrame) -> DataFrame:
    """Per scene the normal equations of point-to-plane alignment: 21 sums of products and 6 right-hand sides.

    A pair (x, y, z; tx, ty, tz; nx, ny, nz) has the row [p x n, n] and the right-hand side n . (t - p)."""
    row = [*cross(_vec(), _vec("n")), *_vec("n")]
    b = dot(_vec("n"), minus(_vec("t"), _vec()))
    rows = pairs.select("scene_id", *[r.alias(f"r{i}") for i, r in enumerate(row)], b.alias("b"))
    products = [F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"a{i}{j}") for i in range(6) for j in range(i, 6)]
    return rows.groupBy("scene_id").agg(*products, *[F.sum(F.col(f"r{i}") * F.col("b")).alias(f"b{i}") for i in range(6)])


def plane_of(a: np.ndarray, b: np.ndarray, most_turn: float = math.inf, most_shift: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """The turn and the shift that solve the normal equations of point-to-plane alignment (6 x 6), each cut to its most; where they leave a direction open, the least solution."""
    x = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    angle, size = np.linalg.norm(x[:3]), np.linalg.norm(x[3:])
    k = x[:3] / angle if angle > 0 else np.zeros(3)
    angle = min(angle, most_turn)
    skew = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + math.sin(angle) * skew + (1 - math.cos(angle)) * skew @ skew, x[3:] * (min(size, most_shift) / size if size > 0 else 1)


def plane_fit(pairs: DataFrame, most_turn: float = math.inf, most_shift: float = math.inf) -> DataFrame:
    """Rotation (9) and translation (3) per scene of the point-to-plane step: 27 sums per scene (plane_equations), then a 6 x 6 problem of one row (plane_of)."""

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
                turn, shift = plane_of(a, np.array([r[f"b{i}"] for i in range(6)]), most_turn, most_shift)
                out.append((r["scene_id"], turn.ravel().tolist(), shift.tolist()))
            yield pd.DataFrame(out, columns=["scene_id", "rotation", "translation"])

    return plane_equations(pairs).mapInPandas(solve, "scene_id bigint, rotation array<double>, translation array<double>")


RESIDUALS = ["rmse", "mean_abs", "rmse_moved", "mean_moved", "angle", "shift"]
ALIGNED = f"scene_id bigint, point_id bigint, x double, y double, z double, round int, {', '.join(c + ' double' for c in RESIDUALS)}"


@dataclass
class Steps:
    """How register_all moves: at most so many rounds, until turn and shift are below tolerance; to planes, with steps that are cut."""

    rounds: int = 20
    tolerance: float = 1e-6
    to_plane: bool = False
    most_turn: float = math.radians(10)
    most_shift: float = 0.05


def align(p: np.ndarray, q: np.ndarray, normals: np.ndarray | None, steps: Steps) -> tuple[np.ndarray, list[list[float]]]:
    """Sources p moved onto targets q (in the order of their ids), and the RESIDUALS of each round."""
    log = []
    for _ in range(steps.rounds):
        near, d2 = nearest_places(p, q)
        t, before = q[near], np.sqrt(d2)
        if steps.to_plane:
            n = normals[near]
            rows = np.concatenate([np.cross(p, n), n], 1)
            turn, shift = plane_of(rows.T @ rows, rows.T @ (n * (t - p)).sum(1), steps.most_turn, steps.most_shift)
        else:
            turn, shift = rigid_of((p - p.mean(0)).T @ (t - t.mean(0)) / len(p), p.mean(0), t.mean(0))
        p = p @ turn.T + shift
        after = np.abs((normals[near] * (t - p)).sum(1)) if steps.to_plane else np.sqrt(((t - p) ** 2).sum(1))
        angle, size = math.acos(max(-1.0, min(1.0, (np.trace(turn) - 1) / 2))), float(np.sqrt((shift**2).sum()))
        log.append([math.sqrt((before**2).mean()), before.mean(), math.sqrt((after**2).mean()), after.mean(), angle, size])
        if angle < steps.tolerance and size < steps.tolerance:
            break
    return p, log


def _aligned(a: pa.Table, b: pa.Table, steps: Steps) -> pa.Table:
    """The scenes of a pack to their end: moved points, and a row without a point for each round."""
    order_a, order_b, at_a, at_b = by_scene(a, b, "scene_id")
    points = matrix(a, ["x", "y", "z"])[order_a]
    ids, scenes = (a.column(c).take(pa.array(order_a)).combine_chunks() for c in ("point_id", "scene_id"))
    targets, names = matrix(b, ["x", "y", "z"])[order_b], b.column("point_id").to_numpy()[order_b]
    normals = matrix(b, ["nx", "ny", "nz"])[order_b] if steps.to_plane else None
    log = []
    for (a0, a1), (b0, b1) in zip(at_a, at_b):
        if b1 > b0:
            by_id = b0 + np.argsort(names[b0:b1], kind="stable")
            points[a0:a1], rounds = align(points[a0:a1], targets[by_id], normals[by_id] if steps.to_plane else None, steps)
            log += [[scenes[int(a0)].as_py(), k, *r] for k, r in enumerate(rounds)]
    n, m = len(points), len(log)
    column = lambda values, empty, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(empty, kind)])
    later = lambda values, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array(values, kind)])
    out = {"scene_id": pa.concat_arrays([scenes, pa.array([r[0] for r in log], pa.int64())]), "point_id": pa.concat_arrays([ids, pa.nulls(m, pa.int64())])}
    out |= {c: column(points[:, k], m, pa.float64()) for k, c in enumerate("xyz")} | {"round": later([r[1] for r in log], pa.int32())}
    return pa.table(out | {c: later([float(r[2 + k]) for r in log], pa.float64()) for k, c in enumerate(RESIDUALS)})


def register_all(
    sources: DataFrame, targets: DataFrame, rounds: int = 20, tolerance: float = 1e-6, to_plane: bool = False, most_turn: float = math.radians(10), most_shift: float = 0.05,
    scene_rows: int = 10_000, scene_pairs: int = 9_000_000, pack_rows: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """(moved sources, residuals by scene and round): alignment of all scenes at once, point to point, or point to plane (targets with normals n*; steps of at most most_turn and most_shift).

    In each round the sources of a scene look up their nearest targets, are summed up, and turn and shift. A scene rests once its turn and its shift are
    below tolerance. residuals: round, rmse and mean_abs of the distances looked up, rmse_moved and mean_moved of what is left after the move (to planes:
    along the normals), angle, shift. A scene without targets stays where it is, without residuals; so do rows with a coordinate that is null or not finite.

    Scenes of at most scene_rows rows a side and scene_pairs pairs go through all their rounds inside a task, many in a task. The others go round by round
    as tables in the shared folder: a round reads the last one's table only, and scenes that rest are appended to the result, so the plan is as large in the last round as in the first."""
    steps = Steps(rounds, tolerance, to_plane, most_turn, most_shift)
    spark = sources.sparkSession
    number = lambda df, *more: df.select("scene_id", F.col("point_id").cast("bigint").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *more)])
    sound = finite("x") & finite("y") & finite("z")
    normals = ("nx", "ny", "nz") if to_plane else ()
    every, t = sides(number(sources), number(targets, *normals).filter(sound), *normals)
    a = every.filter(sound)
    t = t.select(*[F.col(c).alias(c) for c in t.columns])
    n = a.groupBy("scene_id").agg(F.count("*").alias("n_a")).join(t.groupBy("scene_id").agg(F.count("*").alias("n_b")), "scene_id", "left").fillna(0, ["n_b"])
    big = (F.col("n_b") > 0) & ((F.greatest("n_a", "n_b") > scene_rows) | (F.col("n_a") * F.col("n_b") > scene_pairs))
    n = held(n.withColumn("big", big))
    total = n.agg(F.sum(F.when(~F.col("big"), F.col("n_a") + F.col("n_b"))).alias("rows"), F.count_if("big").alias("big")).first()
    small_a, small_t = a, t
    if total.big:
        small_a, small_t = (df.join(n.filter("big").select("scene_id"), "scene_id", "left_anti").select(*df.columns) for df in (a, t))
    packs = 1 + (total.rows or 0) // pack_rows
    pack = lambda df: df.withColumn("pack", F.pmod(F.xxhash64(F.coalesce("scene_id", "point_id")), F.lit(packs))).groupBy("pack")
    done = written(pack(small_a).cogroup(pack(small_t)).applyInArrow(lambda p, q: _aligned(p, q, steps), ALIGNED), "aligned")
    out, log = done.filter("round is null").select(*KEY, "x", "y", "z"), done.filter("round is not null").select("scene_id", "round", *RESIDUALS)
    out = out.unionByName(every.filter(~sound))
    if total.big:
        of = lambda df: df.join(n.filter("big").select("scene_id"), "scene_id", "left_semi").select(*df.columns)
        path = _rounds(of(a), of(t), steps)
        out = out.unionByName(spark.read.schema(out.schema).parquet(f"{path}/rested"))
        log = log.unionByName(spark.read.schema(log.schema).parquet(f"{path}/residuals"))
    return out, log


def _rounds(sources: DataFrame, targets: DataFrame, steps: Steps) -> str:
    """The folder of the tables `rested` and `residuals` of large scenes, to which each round appends."""
    path = scratch_path(sources.sparkSession, "registration")
    t = written(targets, "registration-targets")
    matched = t.select("scene_id", F.col("point_id").alias("nearest_id"), *[F.col(k).alias("t" + k) for k in "xyz"], *(_vec("n") if steps.to_plane else []))
    now = written(sources, "registration-round")
    r, s = F.col("rotation"), F.col("translation")
    turned = [r[3 * i] * F.col("x") + r[3 * i + 1] * F.col("y") + r[3 * i + 2] * F.col("z") + s[i] for i in range(3)]
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0] + r[4] + r[8] - 1) / 2)))
    for k in range(steps.rounds):
        near = nearest_join(now, t).select(*KEY, "nearest_id", "distance").filter("nearest_id is not null")
        pairs = written(now.join(near, KEY).join(matched, ["scene_id", "nearest_id"]), "registration-pairs")
        fit = plane_fit(pairs, steps.most_turn, steps.most_shift) if steps.to_plane else rigid_fit(pairs)
        fit = written(fit.select("scene_id", "rotation", "translation", angle.alias("angle"), F.sqrt(s[0] * s[0] + s[1] * s[1] + s[2] * s[2]).alias("shift")), "registration-fit")
        rests = (F.col("angle") < steps.tolerance) & (F.col("shift") < steps.tolerance)
        moved = pairs.join(fit, "scene_id").withColumns({c: m for m, c in zip(turned, "xyz")}).withColumn("rests", rests if k + 1 < steps.rounds else F.lit(True))
        moved = written(moved, "registration-moved")
        left = minus(_vec("t"), _vec())
        after = F.abs(dot(_vec("n"), left)) if steps.to_plane else norm(left)
        size = lambda d: [F.sqrt(F.avg(d * d)), F.avg(d)]
        log = moved.groupBy("scene_id", "angle", "shift").agg(*[c.alias(n) for c, n in zip((*size(F.col("distance")), *size(after)), RESIDUALS)])
        log.select("scene_id", F.lit(k).alias("round"), *RESIDUALS).write.mode("append").parquet(f"{path}/residuals")
        moved.filter("rests").select(*KEY, "x", "y", "z").write.mode("append").parquet(f"{path}/rested")
        for table in (now, pairs, fit):
            drop_written(table)
        now = written(moved.filter("not rests").select(*KEY, "x", "y", "z"), "registration-round")
        drop_written(moved)
        if not now.limit(1).count():
            break
    for table in (now, t):
        drop_written(table)
    return path
