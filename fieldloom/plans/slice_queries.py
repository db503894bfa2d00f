"""Queries of planes, contours, sectors, budget picks, hole patches and the jobs composed of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldloom.operators import geometry as G
from fieldloom.operators import picks as K
from fieldloom.operators import slices as Z
from fieldloom.operators import tables as T
from fieldloom.plans.queries import _PATCHES, U, contour_sql, level_plane, patches, query, r6, z6
from fieldloom.plans.shape_queries import nested
from fieldloom.plans.views import SAMPLES, TORUS, samples, table, torus

XYZ = ("x", "y", "z")


def _scenes(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"))


def _fixed(df, **values):
    """df with vectors of numbers or columns."""
    return df.withColumns({k + a: v if hasattr(v, "alias") else F.lit(float(v)) for k, vs in values.items() for a, v in zip("xyz", vs)})


# -- planes


_LANDMARKS = "l AS (SELECT s_suppkey AS scene_id, 2.1 + s_suppkey % 3 AS n, 50.0 + s_suppkey % 5 AS scale FROM supplier)"


def landmarks(spark, sf):
    n = 2.1 + F.col("scene_id") % 3
    s = _scenes(spark, sf).withColumn("scale_mm", 50.0 + F.col("scene_id") % 5)
    return _fixed(s, c=(0, 0, 0), a=(n * 0.6, n * 0.8, 0), e1=(0.6, 0.8, 0), e2=(-0.8, 0.6, 0), e3=(0, 0, 1))


@query("G6_all_planes", f"WITH {_LANDMARKS}, sa AS (SELECT scene_id, k + 1 AS plane_id, 'short_axis' AS plane_type, k::double * 0.3 AS ox, k::double * 0.4 AS oy, "
    f"0.6::double AS nx, 0.0::double AS nz FROM l, range(-1, 30) a(k) WHERE k <= floor(n / 0.5) + 1), m AS (SELECT scene_id, count(*) c FROM sa"
    f" GROUP BY 1) SELECT scene_id, plane_id, plane_type, round(ox, 6) + 0.0 AS ox, round(oy, 6) + 0.0 AS oy, nx, nz FROM sa"
    f" UNION ALL SELECT scene_id, c + i, 'long_axis_' || (i + 1), round(25.0::double / scale * 0.6, 6), round(25.0::double / scale * 0.8, 6), "
    f"CASE i WHEN 0 THEN -0.8::double ELSE 0 END, i::double FROM l JOIN m USING (scene_id), range(2) b(i)")
def _(spark, sf):
    return z6(Z.all_planes(landmarks(spark, sf), 0.5, 1, 1), "ox", "oy", "nx", "nz").select("scene_id", "plane_id", "plane_type", "ox", "oy", "nx", "nz")


@query("G20_square_frame", f"WITH {SAMPLES}, n AS (SELECT scene_id, point_id, x / sqrt(x*x + y*y + z*z) AS nx, y / sqrt(x*x + y*y + z*z) AS ny, "
    f"z / sqrt(x*x + y*y + z*z) AS nz FROM s"
    f" WHERE x*x + y*y + z*z > 0.01), u AS (SELECT *, CASE WHEN abs(nx) > 0.9 THEN -nz / sqrt(nx*nx + nz*nz) ELSE 0 END AS ux, "
    f"CASE WHEN abs(nx) > 0.9 THEN 0 ELSE nz / sqrt(ny*ny + nz*nz) END AS uy, "
    f"CASE WHEN abs(nx) > 0.9 THEN nx / sqrt(nx*nx + nz*nz) ELSE -ny / sqrt(ny*ny + nz*nz) END AS uz"
    f" FROM n) SELECT scene_id, point_id, round(ux, 6) + 0.0 AS ux, round(uy, 6) + 0.0 AS uy, round(uz, 6) + 0.0 AS uz, round(ny*uz - nz*uy, 6) + 0.0 AS vx, "
    f"round(nz*ux - nx*uz, 6) + 0.0 AS vy, round(nx*uy - ny*ux, 6) + 0.0 AS vz FROM u")
def _(spark, sf):
    p = samples(spark, sf).filter("x*x + y*y + z*z > 0.01").select("scene_id", "point_id", *[F.col(k).alias("n" + k) for k in "xyz"])
    out = Z.square_frame(p)
    columns = [a + k for a in "uv" for k in "xyz"]
    return z6(out, *columns).select("scene_id", "point_id", *columns)


@query("G20_square_corners", "SELECT s_suppkey AS scene_id, i::int AS corner, round((0.1 + 2.0 * (CASE WHEN i IN (1, 2) THEN 0.5 ELSE -0.5 END + 0.25))::double, "
    "6) + 0.0 AS x, round((0.2 + 2.0 * (CASE WHEN i > 1 THEN 0.5 ELSE -0.5 END + 0.25))::double, 6) + 0.0 AS y FROM supplier, range(4) a(i)")
def _(spark, sf):
    p = _fixed(_scenes(spark, sf).withColumns({"plane_id": F.lit(0), "side": F.lit(2.0)}), o=(0.1, 0.2, 0.3), u=(1, 0, 0), v=(0, 1, 0))
    return z6(Z.square_corners(p, 0.25), "x", "y").select("scene_id", "corner", "x", "y")


# -- what planes cut


_BELOW = "CASE WHEN {0} <= d1 THEN 0 WHEN {0} >= d3 THEN area WHEN {0} <= d2 THEN area * ({0}-d1)*({0}-d1) / ((d2-d1)*(d3-d1)) ELSE area * (1 - (d3-{0})*(d3-{0}) / ((d3-d1)*(d3-d2))) END"


@query("G11_slab_clip", f"WITH {TORUS}, q AS (SELECT scene_id, area, list_sort([az - 0.11, bz - 0.11, cz - 0.11]) AS d FROM t"
    f" JOIN c USING (scene_id, fid)), r AS (SELECT scene_id, area, d[1] AS d1, d[2] AS d2, d[3] AS d3"
    f" FROM q) SELECT scene_id, round(sum({_BELOW.format('0.2')} - ({_BELOW.format('(-0.2)')})), 5) AS area FROM r GROUP BY 1")
def _(spark, sf):
    v, f = torus(spark, sf)
    c = Z.slab_clip(v, f, level_plane(spark, sf, 0.11), 0.2)
    a, b, q = (Z.vec(p) for p in "abc")
    area = Z.norm(Z.cross(Z.minus(b, a), Z.minus(q, a))) / 2
    return c.groupBy("scene_id").agg(F.round(F.sum(area), 5).alias("area"))


_CURVED = contour_sql(0.11) + """, e AS (SELECT scene_id, fid, round(ax, 9) + 0.0 kx, round(ay, 9) + 0.0 ky, round(az, 9) + 0.0 kz, bx - ax dx, "by" - ay dy, bz - az dz FROM k UNION ALL SELECT scene_id, fid, round(bx, 9) + 0.0, round("by", 9) + 0.0, round(bz, 9) + 0.0, ax - bx, ay - "by", az - bz FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, kx, ky, kz ORDER BY fid) AS rn, sqrt(dx*dx + dy*dy + dz*dz) AS len FROM e),
w AS (SELECT p.scene_id, p.kx, p.ky, p.kz, (pi() - acos(greatest(-1, least(1, (p.dx*q.dx + p.dy*q.dy + p.dz*q.dz) / (p.len * q.len))))) / ((p.len + q.len) / 2) AS v FROM r p JOIN r q ON p.scene_id = q.scene_id AND p.kx = q.kx AND p.ky = q.ky AND p.kz = q.kz AND p.rn = 1 AND q.rn = 2)"""


@query("G12_contour_curvature", f'WITH {TORUS}, {_CURVED} SELECT k.scene_id, fid, round((coalesce(wa.v, 0) + coalesce(wb.v, 0)) / 2, 5) AS curvature FROM k LEFT'
    f' JOIN w wa ON wa.scene_id = k.scene_id AND wa.kx = round(ax, 9) + 0.0 AND wa.ky = round(ay, 9) + 0.0 AND wa.kz = round(az, 9) + 0.0 LEFT'
    f' JOIN w wb ON wb.scene_id = k.scene_id AND wb.kx = round(bx, 9) + 0.0 AND wb.ky = round("by", 9) + 0.0 AND wb.kz = round(bz, 9) + 0.0')
def _(spark, sf):
    v, f = torus(spark, sf)
    return Z.contour_curvature(G.plane_contours(v, f, level_plane(spark, sf, 0.11))).select("scene_id", "fid", F.round("curvature", 5).alias("curvature"))


@query("G12_curvature_on_grid", f"""WITH {SAMPLES}, {TORUS}, {_CURVED}, cu AS (SELECT k.scene_id, fid, (ax + bx) / 2 mx, (ay + "by") / 2 my, (coalesce(wa.v, 0) + coalesce(wb.v, 0)) / 2 AS curvature FROM k
LEFT JOIN w wa ON wa.scene_id = k.scene_id AND wa.kx = round(ax, 9) + 0.0 AND wa.ky = round(ay, 9) + 0.0 AND wa.kz = round(az, 9) + 0.0
LEFT JOIN w wb ON wb.scene_id = k.scene_id AND wb.kx = round(bx, 9) + 0.0 AND wb.ky = round("by", 9) + 0.0 AND wb.kz = round(bz, 9) + 0.0)
SELECT s.scene_id, point_id, round(arg_min(curvature, ((x - mx)*(x - mx) + (y - my)*(y - my), fid)), 5) AS curvature FROM s JOIN cu USING (scene_id) GROUP BY 1, 2""")
def _(spark, sf):
    v, f = torus(spark, sf)
    curved = Z.contour_curvature(G.plane_contours(v, f, level_plane(spark, sf, 0.11)))
    points = samples(spark, sf).select("scene_id", F.lit(0).alias("plane_id"), "point_id", "x", "y", F.lit(0.11).alias("z"))
    return Z.curvature_on_grid(points, curved).select("scene_id", "point_id", F.round("curvature", 5).alias("curvature"))


def crossing_planes(spark, sf):
    """Four short-axis planes along z, and two long-axis planes."""
    k = F.col("plane_id")
    p = _scenes(spark, sf).withColumn("plane_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    p = p.withColumn("plane_type", F.when(k < 4, "SA").otherwise("LA"))
    pick = lambda sa, four, five: F.when(k < 4, sa).when(k == 4, four).otherwise(five)
    o = (pick(0.0, 0.1, 0.2), pick(0.0, 0.0, 0.1), pick(k * 0.2 - 0.3, F.lit(0.0), F.lit(0.0)))
    return _fixed(p, o=o, n=(pick(0.0, 1.0, 0.6), pick(0.0, 0.0, 0.8), pick(1.0, 0.0, 0.0)))


@query("G17_plane_line_samples", f"WITH {TORUS}, e AS (SELECT scene_id, min(y) - 0.1 a4, max(y) + 0.1 b4, min(-0.8 * (x - 0.12) + 0.6 * (y - 0.16)) - 0.1 a5, "
    f"max(-0.8 * (x - 0.12) + 0.6 * (y - 0.16)) + 0.1 b5 FROM v"
    f" GROUP BY 1), q AS (SELECT scene_id, sa, la, CASE la WHEN 4 THEN a4 ELSE a5 END AS low, CASE la WHEN 4 THEN b4 ELSE b5 END AS high"
    f" FROM e, range(4) a(sa), range(4, 6) b(la)), i AS (SELECT *, low + i * 0.25 AS t FROM (SELECT *, unnest(range(0, ceil((high + 0.125 - low) / 0.25)::bigint)) AS i"
    f" FROM q)) SELECT scene_id, sa AS sa_plane, la AS la_plane, i, round(t, 6) + 0.0 AS t, round(CASE la WHEN 4 THEN 0.1 ELSE 0.12 - 0.8 * t END, 6) + 0.0 AS x, "
    f"round(CASE la WHEN 4 THEN t ELSE 0.16 + 0.6 * t END, 6) + 0.0 AS y, round((sa * 0.2 - 0.3)::double, 6) + 0.0 AS z FROM i")
def _(spark, sf):
    return z6(Z.plane_line_samples(crossing_planes(spark, sf), torus(spark, sf)[0], 0.25, 0.1), "t", "x", "y", "z")


def spheres(spark, sf):
    return _fixed(_scenes(spark, sf).withColumn("radius", 2.5 + F.col("scene_id") % 3 * 0.5), c=(0.1, 0.2, 0.3), w=(3, 4, 0), l=(1, 0, 2))


_L = [0.64 / math.sqrt(0.64**2 + 0.48**2 + 4), -0.48 / math.sqrt(0.64**2 + 0.48**2 + 4), 2 / math.sqrt(0.64**2 + 0.48**2 + 4)]


@query("G21_sector_geometry", "WITH q AS (SELECT s_suppkey AS scene_id, 2.5 + s_suppkey % 3 * 0.5 AS r, i, -pi() / 3 + 2 * pi() / 3 * i / 6 AS a"
    " FROM supplier, range(-1, 7) t(i)) SELECT scene_id, CASE WHEN i < 0 THEN 'apex' ELSE 'arc' END AS part, "
    "i::int AS i, " + ", ".join(f"round({c} + r * CASE WHEN i < 0 THEN {w} ELSE -cos(a) * {w} + sin(a) * {q}::double END, "
    f"6) + 0.0 AS {k}" for k, c, w, q in zip("xyz", (0.1, 0.2, 0.3), (0.6, 0.8, 0.0), _L)) + " FROM q")
def _(spark, sf):
    return z6(Z.sector_geometry(spheres(spark, sf), 60, 7), "x", "y", "z")


@query("G22_sector_contours")
def _(spark, sf):
    out = Z.sector_contours(*torus(spark, sf), spheres(spark, sf), 60)
    return z6(out, *[p + k for p in "ab" for k in "xyz"])


@query("G19_multi_plane_sdf")
def _(spark, sf):
    v, f = torus(spark, sf)
    planes = crossing_planes(spark, sf)
    points = samples(spark, sf).withColumn("plane_id", F.col("point_id") % 6).select("scene_id", "point_id", "plane_id", "x", "y", "z")
    return z6(Z.multi_plane_sdf(points, Z.slab_clip(v, f, planes, 0.05), v, f), "sdf")


# -- budget picks


def pick_sql(source, need, salt, bins=5, most=None):
    """SQL of (scene_id, point_id, rank): `need` rows of each scene of a CTE, one per cell of x and y in turn."""
    h = U("scene_id::varchar", "point_id::varchar", f"'{salt}'")
    ch = U("scene_id::varchar", "cell", f"'{salt}'")
    cells = ", ".join(f"min({a}) l{a}, max({a}) h{a}" for a in "xy")
    cell = " || '_' || ".join(f"least(floor(({a} - l{a}) / greatest(h{a} - l{a}, 1e-12) * {bins}), {bins - 1})::bigint" for a in "xy")
    return f"SELECT scene_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY turn, ch, cell) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, cell ORDER BY {h}, point_id) AS turn, {ch} AS ch FROM (SELECT q.*, {cell} AS cell FROM {source} q JOIN (SELECT scene_id, {cells} FROM {source} GROUP BY 1) USING (scene_id)))) WHERE rank <= {need}"


_DIST = SAMPLES + ", p0 AS (SELECT scene_id, point_id, x, y, abs(sdf_epi) AS dist_epi, abs(sdf_lv) AS dist_lv, abs(sdf_rv) AS dist_rv, count(*) OVER (PARTITION BY scene_id) AS size FROM s)"
_BANDS = (0.005, 0.02, 0.05)


def _budget_sql(n, quota, labelled):
    ctes, parts, left = [_DIST, f"l0 AS (SELECT * FROM p0{'' if labelled else f' WHERE size > {n}'})"], [], "l0"
    for i, (s, need) in enumerate(zip(("epi", "lv", "rv"), quota)):
        band = "CASE " + " ".join(f"WHEN count(*) FILTER (WHERE dist_{s} <= {b}) >= {need} THEN {b}" for b in _BANDS) + f" ELSE {_BANDS[-1]} END"
        ctes += [f"n{i} AS (SELECT q.* FROM {left} q JOIN (SELECT scene_id, {band} AS band FROM {left} GROUP BY 1) USING (scene_id)"
            f" WHERE dist_{s} <= band)", f"k{i} AS ({pick_sql(f'n{i}', need, f'budget_{s}')})", f"l{i + 1} AS (SELECT * FROM {left} ANTI JOIN k{i} USING (scene_id, point_id))"]
        parts.append((f"k{i}", s, 1))
        left = f"l{i + 1}"
    fills = [(f"fill_{s}", s, f" AND dist_{s} <= {_BANDS[-1]}") for s in ("epi", "lv", "rv")] if labelled else [("budget_background", "background", "")]
    for j, (salt, s, near) in enumerate(fills):
        got = " UNION ALL ".join(f"SELECT scene_id FROM {p}" for p, _, _ in parts)
        ctes += [f"m{j} AS (SELECT q.*, {n} - coalesce(got, 0) AS need FROM {left} q LEFT JOIN (SELECT scene_id, count(*) AS got FROM ({got}) GROUP BY 1) USING (scene_id)"
            f" WHERE coalesce(got, 0) < {n}{near})", f"f{j} AS ({pick_sql(f'm{j}', 'need', salt)})", f"g{j} AS (SELECT * FROM {left} ANTI JOIN f{j} USING (scene_id, point_id))"]
        parts.append((f"f{j}", s, 2))
        left = f"g{j}"
    out = " UNION ALL ".join(f"SELECT scene_id, point_id, '{s}' AS source_surface, {t} AS pass FROM {c}" for c, s, t in parts)
    return "WITH " + ", ".join(ctes) + " " + out + ("" if labelled else f" UNION ALL SELECT scene_id, point_id, 'all', 0 FROM p0 WHERE size <= {n}")


def _distances(spark, sf):
    return samples(spark, sf).select("scene_id", "point_id", "x", "y", *[F.abs(f"sdf_{s}").alias(f"dist_{s}") for s in ("epi", "lv", "rv")])


@query("W3_budget_pick", _budget_sql(100, Z.budgets(80, (2, 1, 1), "largest"), False))
def _(spark, sf):
    out = Z.budget_pick(_distances(spark, sf), 100, list(_BANDS), ["x", "y"], 5, weights=(2, 1, 1))
    return out.select("scene_id", "point_id", "source_surface", "pass")


@query("W4_labelled_budget_pick", _budget_sql(200, Z.budgets(200, (3, 2, 2), "each"), True))
def _(spark, sf):
    out = Z.budget_pick(_distances(spark, sf), 200, list(_BANDS), ["x", "y"], 5, weights=(3, 2, 2), remainder="each", labelled=True)
    return out.select("scene_id", "point_id", "source_surface", "pass")


_HEAVY = "h0 AS (SELECT *, max(abs(sdf_rv)) OVER (PARTITION BY scene_id) AS most FROM s), h1 AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY -ln(" + U("scene_id::varchar", "point_id::varchar", "'weighted'") + ") / (abs(sdf_rv) + 1e-6 * most), point_id) AS rank FROM h0 WHERE abs(sdf_rv) + 1e-6 * most > 0), h AS (SELECT scene_id, point_id FROM h1 WHERE rank <= 24), r0 AS (SELECT * FROM s ANTI JOIN h USING (scene_id, point_id))"


@query("W5_curvature_mixed_pick", f"WITH {SAMPLES}, {_HEAVY}, r1 AS ({pick_sql('r0', 36, 'pick')}) SELECT scene_id, point_id, 'weight' AS part FROM h UNION ALL SELECT scene_id, point_id, 'cells' FROM r1")
def _(spark, sf):
    return K.curvature_mixed_pick(samples(spark, sf).withColumn("bend", F.abs("sdf_rv")), "bend", ["x", "y"], 5, 60, 0.4)


@query("W6_curvature_weight", f"WITH {SAMPLES} SELECT scene_id, point_id, round(0.7 * pow(abs(sdf_rv), 0.5) / sum(pow(abs(sdf_rv), 0.5)) OVER w + 0.3 * pow(abs(sdf_lv), "
    f"0.5) / sum(pow(abs(sdf_lv), 0.5)) OVER w, 9) AS weight FROM s WINDOW w AS (PARTITION BY scene_id)")
def _(spark, sf):
    from fieldloom.operators.samples import curvature_weight

    return curvature_weight(samples(spark, sf), "sdf_rv", "sdf_lv", 0.3, 0.5).select("scene_id", "point_id", F.round("weight", 9).alias("weight"))


# -- hole patches, apexes, landmarks


_SCORES = _PATCHES + """, k0 AS (SELECT scene_id, component, sum(area) AS area, sum(area * x) / sum(area) AS gx, sum(area * y) / sum(area) AS gy, sum(area * z) / sum(area) AS gz FROM t JOIN h USING (scene_id, fid) GROUP BY 1, 2),
k1 AS (SELECT DISTINCT scene_id, component, unnest([v0, v1, v2]) AS vid FROM h), k2 AS (SELECT scene_id, component, arg_min(x, vid) fx, arg_min(y, vid) fy, avg(x) mx, avg(y) my, avg(z) mz FROM k1 JOIN v USING (scene_id, vid) GROUP BY 1, 2),
k3 AS (SELECT scene_id, 'mitral' AS kind, component, (fy - fx) * sqrt(0.5) AS projection, area, fy + fx AS prior FROM k0 JOIN k2 USING (scene_id, component) UNION ALL SELECT scene_id, 'tricuspid', component, (my - mx) * sqrt(0.5), area, -mz FROM k0 JOIN k2 USING (scene_id, component) UNION ALL SELECT scene_id, 'pulmonary', component, (gy - gx) * sqrt(0.5), area, gz FROM k0),
k4 AS (SELECT *, CASE WHEN max(area) OVER w = min(area) OVER w THEN 1 ELSE (area - min(area) OVER w) / (max(area) OVER w - min(area) OVER w) END AS na, CASE WHEN max(prior) OVER w = min(prior) OVER w THEN 1 ELSE (prior - min(prior) OVER w) / (max(prior) OVER w - min(prior) OVER w) END AS np, greatest(0, least(1, (projection + 1) / 2)) AS sp, greatest(0, least(1, area / 0.2)) AS sa, greatest(0, least(1, (prior + 1) / 2)) AS sr FROM k3 WINDOW w AS (PARTITION BY scene_id, kind)),
k AS (SELECT *, CASE kind WHEN 'mitral' THEN 0.45 * sp + 0.25 * sa + 0.3 * sr WHEN 'tricuspid' THEN 0.45 * sp + 0.4 * sa + 0.15 * sr ELSE 0.1 * na + 0.9 * np END AS likelihood FROM k4)"""


def _tilted(spark, sf):
    """The patches of a torus that is bent upwards along x and y, so that no two patches are alike."""
    v, f = patches(spark, sf)
    return v.withColumn("z", F.col("z") + F.col("x") * 0.11 + F.col("y") * 0.07), f


_TILTED = _SCORES.replace("AS x, (2 + r * cos(j * (2 * pi() / 8))) * sin(i * (2 * pi() / 12)) AS y, r * sin(j * (2 * pi() / 8)) AS z"
    " FROM g)", "AS x, (2 + r * cos(j * (2 * pi() / 8))) * sin(i * (2 * pi() / 12)) AS y, "
    "r * sin(j * (2 * pi() / 8)) + (2 + r * cos(j * (2 * pi() / 8))) * (cos(i * (2 * pi() / 12)) * 0.11 + sin(i * (2 * pi() / 12)) * 0.07) AS z FROM g)")


@query("G4_hole_patch_scores", f"WITH {_TILTED} SELECT scene_id, kind, component, round(projection, 6) + 0.0 AS projection, round(area, 6) AS area, round(prior, "
    f"6) + 0.0 AS prior, round(likelihood, 5) AS likelihood FROM k")
def _(spark, sf):
    v, f = _tilted(spark, sf)
    faces = G.component_faces(f)
    out = [Z.hole_patch_scores(v, faces, k).withColumn("kind", F.lit(k)) for k in ("mitral", "tricuspid", "pulmonary")]
    return z6(out[0].unionByName(out[1]).unionByName(out[2]), "projection", "area", "prior").withColumn("likelihood", F.round("likelihood", 5))


@query("C5_landmark_table", f"WITH {_TILTED}, b AS (SELECT scene_id, kind, arg_min(component, (-round(likelihood, 9), component)) AS component FROM k"
    f" GROUP BY 1, 2), c5 AS (SELECT b.scene_id, kind, b.component, gx, gy, gz FROM b JOIN k0 ON k0.scene_id = b.scene_id AND k0.component = b.component), m AS (SELECT *"
    f" FROM c5 WHERE kind = 'mitral'), d AS (SELECT v.scene_id, vid, (x-gx)*(x-gx) + (y-gy)*(y-gy) + (z-gz)*(z-gz) AS d2 FROM v"
    f" JOIN m USING (scene_id)), a AS (SELECT scene_id, arg_min(vid, (-round(d2, 9), vid)) AS apex_id FROM d"
    f" GROUP BY 1) SELECT m.scene_id, m.component AS mitral_patch, t.component AS tricuspid_patch, p.component AS pulmonary_patch, round(m.gx, 6) + 0.0 AS mitral_x, "
    f"round(t.gy, 6) + 0.0 AS tricuspid_y, round(p.gz, 6) + 0.0 AS pulmonary_z, apex_id FROM m JOIN c5 t ON t.scene_id = m.scene_id AND t.kind = 'tricuspid'"
    f" JOIN c5 p ON p.scene_id = m.scene_id AND p.kind = 'pulmonary' JOIN a ON a.scene_id = m.scene_id")
def _(spark, sf):
    out = Z.landmark_table(*_tilted(spark, sf))
    return z6(out, "mitral_x", "tricuspid_y", "pulmonary_z").select("scene_id", "mitral_patch", "tricuspid_patch", "pulmonary_patch", "mitral_x", "tricuspid_y", "pulmonary_z", "apex_id")


#: The leading axis by squaring the covariance again and again: its columns turn into it.
_LEADING = """co AS (SELECT scene_id, avg(x) mx, avg(y) my, avg(z) mz, covar_samp(x, x) a, covar_samp(x, y) b, covar_samp(x, z) c, covar_samp(y, y) d, covar_samp(y, z) e, covar_samp(z, z) f FROM s GROUP BY 1),
pw AS (SELECT scene_id, 0 AS k, a / (a + d + f) a, b / (a + d + f) b, c / (a + d + f) c, d / (a + d + f) d, e / (a + d + f) e, f / (a + d + f) f FROM co
  UNION ALL SELECT scene_id, k + 1, (a*a + b*b + c*c) / t, (a*b + b*d + c*e) / t, (a*c + b*e + c*f) / t, (b*b + d*d + e*e) / t, (b*c + d*e + e*f) / t, (c*c + e*e + f*f) / t
  FROM (SELECT *, a*a + 2*b*b + 2*c*c + d*d + 2*e*e + f*f AS t FROM pw) WHERE k < 24),
ax AS (SELECT scene_id, CASE WHEN a >= greatest(d, f) THEN a WHEN d >= f THEN b ELSE c END ux, CASE WHEN a >= greatest(d, f) THEN b WHEN d >= f THEN d ELSE e END uy,
  CASE WHEN a >= greatest(d, f) THEN c WHEN d >= f THEN e ELSE f END uz FROM pw WHERE k = 24)"""


@query("G5_apex_gap", f"""WITH RECURSIVE {SAMPLES}, {_LEADING},
t AS (SELECT *, CASE WHEN (mx - 0.1) * ux + (my - 0.2) * uy + (mz - 0.3) * uz < 0 THEN -1 ELSE 1 END AS turn FROM ax JOIN co USING (scene_id)),
p AS (SELECT s.scene_id, point_id, x, y, z, ((x - 0.1) * ux + (y - 0.2) * uy + (z - 0.3) * uz) * turn AS along, (x - 0.1)*(x - 0.1) + (y - 0.2)*(y - 0.2) + (z - 0.3)*(z - 0.3) AS d2 FROM s JOIN t USING (scene_id)),
b AS (SELECT scene_id, arg_min(struct_pack(point_id, x, y, z), (-d2, point_id)) AS f, arg_min(struct_pack(point_id, x, y, z), (-along, point_id)) AS g FROM p GROUP BY 1)
SELECT scene_id, f.point_id AS far_id, g.point_id AS pca_id,
  round(sqrt((f.x - g.x)*(f.x - g.x) + (f.y - g.y)*(f.y - g.y) + (f.z - g.z)*(f.z - g.z)) * (50.0 + scene_id % 5), 6) AS gap_mm FROM b""")
def _(spark, sf):
    base = _fixed(_scenes(spark, sf), b=(0.1, 0.2, 0.3))
    meta = _scenes(spark, sf).withColumn("scale_mm", 50.0 + F.col("scene_id") % 5)
    return r6(Z.apex_gap(samples(spark, sf), base, meta), "gap_mm")


# -- composed jobs


def _slice_planes(spark, sf):
    """One plane across the torus and one along its axis, with squares that hold both."""
    k = F.col("plane_id")
    p = _scenes(spark, sf).withColumn("plane_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))).withColumn("side", F.lit(7.0))
    flat = k == 0
    at = lambda a, b: F.when(flat, float(a)).otherwise(float(b))
    return _fixed(p, o=(at(0, 0.05), at(0, 0), at(0.11, 0)), n=(at(0, 1), at(0, 0), at(1, 0)), u=(at(1, 0), at(0, 1), at(0, 0)), v=(at(0, 0), at(1, 0), at(0, 1)))


def _slices(mode):
    def run(spark, sf):
        out = Z.build_slice_samples(nested(spark, sf), _slice_planes(spark, sf), 0.35, 60, mode, half=0.1, expansion=0.2)
        return z6(out, *[f"sdf_{s}" for s in ("epi", "lv", "rv")], "x", "y", "z")

    return run


for _mode in ("slab", "contour", "volume"):
    query(f"C2_build_slice_samples_{_mode}")(_slices(_mode))


@query("C8_exact_compatibility")
def _(spark, sf):
    rows = Z.line_compatibility(crossing_planes(spark, sf), *torus(spark, sf), 0.25, 0.1).withColumn("organ", F.lit("epi"))
    out = T.intersection_summary(rows, ["sa_plane", "la_plane", "organ"], [0.05, 0.2])
    return z6(out, "mean", "most", "mean_inside", "sign_mismatch", "median", "p95", "median_inside", "p95_inside")
