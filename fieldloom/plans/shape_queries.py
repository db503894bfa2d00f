"""More queries of the library: neighbours, triangles, thinning, registration, grids, specs and composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.operators import geometry as G
from fieldloom.operators import latent as L
from fieldloom.operators import picks as K
from fieldloom.operators import shapes as H
from fieldloom.operators import slices as Z
from fieldloom.operators import spatial as N
from fieldloom.operators import tables as T
from fieldloom.plans.queries import _DRAW, _SCORED, PAIR, WINDING, U, _two, query, r6, wide, z6
from fieldloom.plans.views import METRICS, SAMPLES, TORUS, metrics, samples, table, torus


def _scenes(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"))


@query("J8_knn_join", PAIR + ", r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, point_id ORDER BY d2, r) AS rank"
    " FROM d) SELECT scene_id, point_id, rank, r AS nearest_id, round(sqrt(d2), 6) AS distance FROM r WHERE rank <= 3")
def _(spark, sf):
    return r6(H.knn_join(*_two(spark, sf), k=3), "distance")


@query("G2_transfer_labels", f"WITH {TORUS} SELECT a.scene_id, a.fid, arg_min(b.fid % 5, ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z+0.05-b.z)*(a.z+0.05-b.z), "
    f"b.fid)) AS tag FROM t a JOIN t b USING (scene_id) GROUP BY 1, 2")
def _(spark, sf):
    t = G.face_table(*torus(spark, sf)).select("scene_id", "fid", "x", "y", "z")
    return H.transfer_labels(t.withColumn("tag", F.col("fid") % 5), t.withColumn("z", F.col("z") + 0.05))


def _edge(p, q):
    """The squared distance of (px, py, pz) to the segment from p to q in SQL."""
    d = [f'("{q}{k}" - "{p}{k}")' for k in "xyz"]
    w = [f'(p{k} - "{p}{k}")' for k in "xyz"]
    t = f"greatest(0, least(1, ({' + '.join(a + ' * ' + b for a, b in zip(w, d))}) / ({' + '.join(a + ' * ' + a for a in d)})))"
    return " + ".join(f"({a} - {t} * {b}) * ({a} - {t} * {b})" for a, b in zip(w, d))


#: CTE td (scene_id, point_id, distance): the spread samples' distances to the torus.
_TRIANGLES = f"""t0 AS (SELECT s.scene_id, point_id, s.x*3 px, s.y*3 py, s.z pz, ax, ay, az, bx, by_ AS "by", bz, cx, cy, cz FROM s JOIN c USING (scene_id)),
t1 AS (SELECT *, ("by"-ay)*(cz-az) - (bz-az)*(cy-ay) nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) ny, (bx-ax)*(cy-ay) - ("by"-ay)*(cx-ax) nz,
  ("by"-ay)*(pz-az) - (bz-az)*(py-ay) gx, (bz-az)*(px-ax) - (bx-ax)*(pz-az) gy, (bx-ax)*(py-ay) - ("by"-ay)*(px-ax) gz,
  (py-ay)*(cz-az) - (pz-az)*(cy-ay) hx, (pz-az)*(cx-ax) - (px-ax)*(cz-az) hy, (px-ax)*(cy-ay) - (py-ay)*(cx-ax) hz FROM t0),
t2 AS (SELECT *, nx*nx + ny*ny + nz*nz n2, gx*nx + gy*ny + gz*nz gamma, hx*nx + hy*ny + hz*nz beta, (px-ax)*nx + (py-ay)*ny + (pz-az)*nz wn FROM t1),
td AS (SELECT scene_id, point_id, sqrt(min(least(CASE WHEN gamma >= 0 AND beta >= 0 AND gamma + beta <= n2 THEN wn * wn / n2 END, {_edge("a", "b")}, {_edge("b", "c")}, {_edge("c", "a")}))) AS distance FROM t2 GROUP BY 1, 2)"""


@query("G7_triangle_distance", f"WITH {SAMPLES}, {TORUS}, {_TRIANGLES} SELECT scene_id, point_id, round(distance, 6) AS distance FROM td")
def _(spark, sf):
    return r6(H.triangle_distance(wide(spark, sf), *torus(spark, sf)), "distance")


@query("G19_signed_distance", f"WITH {SAMPLES}, {TORUS}, {_TRIANGLES}, {WINDING} SELECT scene_id, point_id, round(distance * CASE WHEN abs(w) > 0.5 THEN -1 ELSE 1 END, "
    f"6) + 0.0 AS sdf FROM td JOIN wn USING (scene_id, point_id)")
def _(spark, sf):
    return z6(H.signed_distance(wide(spark, sf), *torus(spark, sf)), "sdf")


@query("P11_inside_or_near", f"WITH {SAMPLES} SELECT scene_id, point_id FROM s WHERE sdf_lv <= 0 OR (x <> 0 AND sdf_epi <= 0.012)")
def _(spark, sf):
    rows = samples(spark, sf).withColumns({"inside": F.col("sdf_lv") <= 0, "distance": F.when(F.col("x") == 0, F.lit(float("nan"))).otherwise(F.col("sdf_epi"))})
    return H.inside_or_near(rows, 0.012).select("scene_id", "point_id")


@query("G18_slab_vertex_distance", f"WITH {SAMPLES}, {TORUS} SELECT s.scene_id, point_id, "
    f"round(sqrt(min((s.x-v.x)*(s.x-v.x) + (s.y-v.y)*(s.y-v.y) + (s.z-v.z)*(s.z-v.z))), 6) AS distance FROM s LEFT JOIN v ON v.scene_id = s.scene_id AND abs(s.z - v.z) <= 0.103 GROUP BY 1, 2")
def _(spark, sf):
    return r6(H.slab_vertex_distance(samples(spark, sf), torus(spark, sf)[0], 0.103), "distance")


_ANGLE = "acos((({0}x-{1}x)*({2}x-{1}x) + ({0}y-{1}y)*({2}y-{1}y) + ({0}z-{1}z)*({2}z-{1}z)) / sqrt((({0}x-{1}x)*({0}x-{1}x) + ({0}y-{1}y)*({0}y-{1}y) + ({0}z-{1}z)*({0}z-{1}z)) * (({2}x-{1}x)*({2}x-{1}x) + ({2}y-{1}y)*({2}y-{1}y) + ({2}z-{1}z)*({2}z-{1}z))))"


@query("G16_angle_defect", f"WITH {TORUS}, w AS (SELECT f.scene_id, unnest([v0, v1, v2]) AS vid, "
    f"unnest([{_ANGLE.format('b', 'a', 'c').replace('by', 'by_')}, {_ANGLE.format('a', 'b', 'c').replace('by', 'by_')}, {_ANGLE.format('a', 'c', 'b').replace('by', 'by_')}]) AS angle"
    f" FROM f JOIN c USING (scene_id, fid)) SELECT scene_id, vid, round(2 * pi() - sum(angle), 6) + 0.0 AS mass FROM w GROUP BY 1, 2")
def _(spark, sf):
    return z6(H.angle_defect(*torus(spark, sf)), "mass")


_BEND = "e0 AS (SELECT f.scene_id, f.fid, unnest([least(v0, v1), least(v1, v2), least(v2, v0)]) p, unnest([greatest(v0, v1), greatest(v1, v2), greatest(v2, v0)]) q FROM f), e1 AS (SELECT e0.*, nx, ny, nz FROM e0 JOIN t USING (scene_id, fid))"


@query("G16_edge_bend", f"WITH {TORUS}, {_BEND} SELECT a.scene_id, a.p, a.q, "
    f"round(sqrt((v.x-w.x)*(v.x-w.x) + (v.y-w.y)*(v.y-w.y) + (v.z-w.z)*(v.z-w.z)) * atan2(sqrt((a.ny*b.nz-a.nz*b.ny)*(a.ny*b.nz-a.nz*b.ny) + (a.nz*b.nx-a.nx*b.nz)*(a.nz*b.nx-a.nx*b.nz) + (a.nx*b.ny-a.ny*b.nx)*(a.nx*b.ny-a.ny*b.nx)), "
    f"a.nx*b.nx + a.ny*b.ny + a.nz*b.nz), 6) AS mass FROM e1 a JOIN e1 b ON a.scene_id = b.scene_id AND a.p = b.p AND a.q = b.q AND a.fid < b.fid"
    f" JOIN v ON v.scene_id = a.scene_id AND v.vid = a.p JOIN v w ON w.scene_id = a.scene_id AND w.vid = a.q")
def _(spark, sf):
    return r6(H.edge_bend(*torus(spark, sf)), "mass")


_CLIPPED = """ed AS (SELECT a.scene_id, v.x px, v.y py, v.z pz, w.x - v.x dx, w.y - v.y dy, w.z - v.z dz,
  atan2(sqrt((a.ny*b.nz-a.nz*b.ny)*(a.ny*b.nz-a.nz*b.ny) + (a.nz*b.nx-a.nx*b.nz)*(a.nz*b.nx-a.nx*b.nz) + (a.nx*b.ny-a.ny*b.nx)*(a.nx*b.ny-a.ny*b.nx)), a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)
    * CASE WHEN a.nx * (b.x - v.x) + a.ny * (b.y - v.y) + a.nz * (b.z - v.z) > 0 THEN -1 ELSE 1 END AS bend
  FROM e2 a JOIN e2 b ON a.scene_id = b.scene_id AND a.p = b.p AND a.q = b.q AND a.fid < b.fid JOIN v ON v.scene_id = a.scene_id AND v.vid = a.p JOIN v w ON w.scene_id = a.scene_id AND w.vid = a.q),
ab AS (SELECT t.scene_id, t.vid, bend, dx*dx + dy*dy + dz*dz AS dd, (px-t.x)*dx + (py-t.y)*dy + (pz-t.z)*dz AS dw, (px-t.x)*(px-t.x) + (py-t.y)*(py-t.y) + (pz-t.z)*(pz-t.z) - 0.49 AS ww FROM v t JOIN ed USING (scene_id)),
m AS (SELECT scene_id, vid, sum(CASE WHEN dw * dw > dd * ww THEN bend * sqrt(dd) * (greatest(0, least(1, (-dw + sqrt(dw*dw - dd*ww)) / dd)) - greatest(0, least(1, (-dw - sqrt(dw*dw - dd*ww)) / dd))) ELSE 0 END) / 2 AS mean FROM ab GROUP BY 1, 2),
w AS (SELECT f.scene_id, unnest([v0, v1, v2]) AS vid, unnest([ANGLE_A, ANGLE_B, ANGLE_C]) AS angle FROM f JOIN c USING (scene_id, fid)),
k AS (SELECT scene_id, vid, 2 * pi() - sum(angle) AS mass FROM w GROUP BY 1, 2),
g AS (SELECT t.scene_id, t.vid, sum(mass) AS gauss FROM v t JOIN v u ON t.scene_id = u.scene_id AND (t.x-u.x)*(t.x-u.x) + (t.y-u.y)*(t.y-u.y) + (t.z-u.z)*(t.z-u.z) <= 0.81 JOIN k ON k.scene_id = u.scene_id AND k.vid = u.vid GROUP BY 1, 2)"""
for _name, _corners in (("ANGLE_A", "bac"), ("ANGLE_B", "abc"), ("ANGLE_C", "acb")):
    _CLIPPED = _CLIPPED.replace(_name, _ANGLE.format(*_corners).replace("by", "by_"))


@query("G16_ball_curvature", f"WITH {TORUS.replace('g AS', 'g0 AS', 1).replace('FROM g)', 'FROM g0)').replace('FROM g' + chr(10), 'FROM g0' + chr(10))}, {_BEND.replace('e1 AS (SELECT e0.*, nx, ny, nz', 'e2 AS (SELECT e0.*, nx, ny, nz, x, y, z')}, {_CLIPPED} SELECT scene_id, "
    f"vid AS point_id, round(gauss, 6) + 0.0 AS gauss, round(mean, 6) + 0.0 AS mean FROM g JOIN m USING (scene_id, vid)")
def _(spark, sf):
    v, f = torus(spark, sf)
    return z6(H.ball_curvature(v.withColumnRenamed("vid", "point_id"), v, f, 0.9, 0.7), "gauss", "mean")


@query("G23_tagged_landmarks", f"WITH {TORUS}, m AS (SELECT scene_id, fid // 50 AS tag, avg(x) x, avg(y) y, avg(z) z FROM t"
    f" GROUP BY 1, 2), o AS (SELECT a.scene_id, a.tag, arg_min(b.tag, ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.tag)) AS other FROM m a"
    f" JOIN m b USING (scene_id) WHERE a.tag <> b.tag"
    f" GROUP BY 1, 2) SELECT p.scene_id, p.tag, p.other, round((a.x + b.x) / 2, 6) + 0.0 AS x, round((a.y + b.y) / 2, 6) + 0.0 AS y, round((a.z + b.z) / 2, 6) + 0.0 AS z"
    f" FROM o p JOIN o q ON q.scene_id = p.scene_id AND q.tag = p.other AND q.other = p.tag JOIN m a ON a.scene_id = p.scene_id AND a.tag = p.tag"
    f" JOIN m b ON b.scene_id = p.scene_id AND b.tag = p.other WHERE p.tag < p.other")
def _(spark, sf):
    v, f = torus(spark, sf)
    return z6(H.tagged_landmarks(v, f.withColumn("tag", F.floor(F.col("fid") / 50))), "x", "y", "z")


@query("G13_planar_grid", "SELECT s_suppkey AS scene_id, p AS plane_id, i, j, round((i * 0.25 - 1)::double, 6) + 0.0 AS x, round((0.6 * (j * 0.25 - 1))::double, "
    "6) + 0.0 AS y, round((p * 0.5 + 0.8 * (j * 0.25 - 1))::double, 6) + 0.0 AS z FROM supplier, range(3) a(p), range(9) b(i), range(9) c(j)")
def _(spark, sf):
    planes = _scenes(spark, sf).select("scene_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("plane_id"))
    fixed = {"ox": 0.0, "oy": 0.0, "ux": 1.0, "uy": 0.0, "uz": 0.0, "vx": 0.0, "vy": 0.6, "vz": 0.8, "side": 2.0}
    return z6(H.planar_grid(planes.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()], (F.col("plane_id") * 0.5).alias("oz")), 0.25), "x", "y", "z")


def _tilted(spark, sf):
    """Planes of two tilts for each scene, with their frame."""
    planes = _scenes(spark, sf).select("scene_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("plane_id"))
    fixed = {"ox": 0.0, "oy": 0.0, "ux": 1.0, "uy": 0.0, "uz": 0.0, "vx": 0.0, "vy": 0.6, "vz": 0.8, "nx": 0.0, "ny": -0.8, "nz": 0.6, "side": 1.0}
    return planes.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()], (F.col("plane_id") * 0.5).alias("oz"))


def _axis(name, half, last):
    first = f"{U('scene_id::varchar', 'p::varchar', chr(39) + name + chr(39), chr(39) + 'offset' + chr(39))} * 0.25"
    return f"{name}r AS (SELECT scene_id, p, {name}, {name} * 0.25 - {half} + {first} AS a{name} FROM pl, range(12) r({name}) WHERE {name} <= {last.format(first=first)})"


@query("G13_volume_grid", "WITH pl AS (SELECT s_suppkey AS scene_id, p FROM supplier, range(2) a(p)), "
    + ", ".join(_axis(n, h, f"floor(({2 * h} - {{first}}) / 0.25 + 4e-12)") for n, h in (("i", 0.5), ("j", 0.5), ("k", 0.3)))
    + """ SELECT scene_id, p AS plane_id, i, j, k, round(ai, 6) + 0.0 AS x, round(0.6 * aj - 0.8 * ak, 6) + 0.0 AS y, round(p * 0.5 + 0.8 * aj + 0.6 * ak, 6) + 0.0 AS z
FROM ir JOIN jr USING (scene_id, p) JOIN kr USING (scene_id, p)""")  # fmt: skip
def _(spark, sf):
    return z6(H.volume_grid(_tilted(spark, sf), 0.25, 0.3, "step"), "x", "y", "z")


@query("G13_centred_offset", "WITH pl AS (SELECT s_suppkey AS scene_id, p FROM supplier, range(2) a(p)), "
    + ", ".join(_axis(n, h, f"ceil(({2 * h} - ({{first}} - 0.125)) / 0.25 + 0.5) - 1").replace(f"- {h} +", f"- {h} - 0.125 +", 1) for n, h in (("i", 0.5), ("j", 0.5)))
    + """ SELECT scene_id, p AS plane_id, i, j, round(ai, 6) + 0.0 AS x, round(0.6 * aj, 6) + 0.0 AS y, round(p * 0.5 + 0.8 * aj, 6) + 0.0 AS z FROM ir JOIN jr USING (scene_id, p)""")
def _(spark, sf):
    return z6(H.planar_grid(_tilted(spark, sf), 0.25, "centred"), "x", "y", "z")


@query("G13_box_grid", "SELECT s_suppkey AS scene_id, i::int AS ix, j::int AS iy, k::int AS iz, round((i * 0.3 - 1.05)::double, 6) + 0.0 AS x, "
    "round((j * 0.3 - 1.05)::double, 6) + 0.0 AS y, round((k * 0.3 - 1.05)::double, 6) + 0.0 AS z FROM supplier, range(8) a(i), range(8) b(j), range(8) c(k)")
def _(spark, sf):
    return z6(H.box_grid(_scenes(spark, sf), 8), "x", "y", "z")


def _gauss(*key):
    return "sqrt(-2 * ln(" + U(*key, "'r'") + ")) * cos(2 * pi() * " + U(*key, "'a'") + ")"


@query("G15_jitter", f"WITH {SAMPLES} SELECT scene_id, point_id, "
    f"k::int AS near, " + ", ".join(f"round({c} + CASE k WHEN 0 THEN 0.1 ELSE 0.01 END * {_gauss('scene_id::varchar', 'point_id::varchar', 'k::varchar', chr(39) + c + chr(39))}, "
    f"6) + 0.0 AS {c}" for c in "xyz") + " FROM s, range(2) a(k)")
def _(spark, sf):
    return z6(H.jitter(samples(spark, sf), 0.1), "x", "y", "z")


def _ball(k):
    return U("scene_id::varchar", "draw::varchar", f"'{k}'")


@query("G15_ball_points", f"WITH {SAMPLES}, c AS (SELECT scene_id, avg(x) cx, avg(y) cy, avg(z) cz FROM s"
    f" GROUP BY 1), u AS (SELECT *, cbrt({_ball('radius')}) r, 2 * {_ball('height')} - 1 h, 2 * pi() * {_ball('turn')} t"
    f" FROM c, range(40) a(draw)) SELECT scene_id, draw::int AS draw, round(cx + r * sqrt(1 - h * h) * cos(t), 6) + 0.0 AS x, round(cy + r * sqrt(1 - h * h) * sin(t), "
    f"6) + 0.0 AS y, round(cz + r * h, 6) + 0.0 AS z FROM u")
def _(spark, sf):
    return z6(H.ball_points(T.centroid(samples(spark, sf)), 40), "x", "y", "z")


_SIGNS = " UNION ALL ".join(f"SELECT scene_id, point_id, {i} AS surface, sign(sdf_{s})::int AS sign FROM s WHERE sdf_{s} <> 0" for i, s in enumerate(("epi", "lv", "rv")))


@query("W7_balanced_resample", f"""WITH {SAMPLES}, q AS ({_SIGNS}), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, surface, sign ORDER BY point_id) AS rank FROM q),
c AS (SELECT scene_id, surface, count(*) FILTER (WHERE sign > 0) AS pos, count(*) FILTER (WHERE sign < 0) AS neg FROM q GROUP BY 1, 2),
e AS (SELECT scene_id, surface, surface * 10 + draw AS slot, CASE WHEN draw < 5 THEN CASE WHEN pos > 0 THEN 1 ELSE -1 END ELSE CASE WHEN neg > 0 THEN -1 ELSE 1 END END AS sign, pos, neg FROM c, range(10) a(draw)),
d AS (SELECT e.scene_id, slot, point_id FROM e JOIN r ON r.scene_id = e.scene_id AND r.surface = e.surface AND r.sign = e.sign AND r.rank = floor({U('e.scene_id::varchar', 'slot::varchar', chr(39) + 'balance' + chr(39))} * CASE e.sign WHEN 1 THEN pos ELSE neg END)::bigint + 1),
x AS (SELECT scene_id, n AS new, floor({U('scene_id::varchar', 'n::varchar', chr(39) + 'extra' + chr(39))} * 30)::bigint AS slot FROM (SELECT DISTINCT scene_id FROM s), range(30, 32) a(n))
SELECT scene_id, slot, point_id FROM d UNION ALL SELECT x.scene_id, new, point_id FROM x JOIN d ON d.scene_id = x.scene_id AND d.slot = x.slot""")
def _(spark, sf):
    return K.balanced_resample(samples(spark, sf), 32)


@query("W10_lhs_thin", f"""WITH {SAMPLES}, e AS (SELECT scene_id, count(*) many, min(x) ax, max(x) bx, min(y) ay, max(y) b_y, min(z) az, max(z) bz FROM s GROUP BY 1),
b AS (""" + " UNION ALL ".join(f"SELECT scene_id, point_id, '{k}' AS axis, floor(({k} - a{k}) / ({m} - a{k}) * 12) AS bin FROM s JOIN e USING (scene_id)"
    f" WHERE many > 25" for k, m in (("x", "bx"), ("y", "b_y"), ("z", "bz"))) + f"""),
o AS (SELECT DISTINCT scene_id, point_id FROM (SELECT scene_id, axis, bin, arg_min(point_id, ({U('scene_id::varchar', 'point_id::varchar', 'axis', chr(39) + 'lhs' + chr(39))}, point_id)) AS point_id FROM b WHERE bin < 12 GROUP BY 1, 2, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {U('scene_id::varchar', 'point_id::varchar', chr(39) + 'cap' + chr(39))}, point_id) AS rank FROM o)
SELECT scene_id, point_id FROM r WHERE rank <= 25 UNION ALL SELECT scene_id, point_id FROM s JOIN e USING (scene_id) WHERE many <= 25""")
def _(spark, sf):
    return K.lhs_thin(samples(spark, sf), 12, 25)


@query("W11_min_distance_thin")
def _(spark, sf):
    return H.min_distance_thin(samples(spark, sf), 0.35)


_TARGET = {"tx": "x + 0.1 * y", "ty": "y - 0.1", "tz": "z - 0.2 * x"}


def _pairs(spark, sf):
    return samples(spark, sf).select("scene_id", "x", "y", "z", *[F.expr(e).alias(c) for c, e in _TARGET.items()], F.lit(0.6).cast("double").alias("nx"), F.lit(0.8).cast("double").alias("ny"), F.lit(0.0).cast("double").alias("nz"))


_PAIRS = SAMPLES + ", p AS (SELECT scene_id, x, y, z, " + ", ".join(f"{e} AS {c}" for c, e in _TARGET.items()) + ", 0.6::double AS nx, 0.8::double AS ny, 0.0::double AS nz FROM s)"


@query("A26_cross_covariance", f"WITH {_PAIRS} SELECT scene_id, count(*) AS n, " + ", ".join(f"round(avg({c}), "
    f"5) + 0.0 AS mean_{c}" for c in ("x", "y", "z", "tx", "ty", "tz")) + ", " + ", ".join(f"round(covar_pop(t{a}, {b}) * count(*), "
    f"5) + 0.0 AS h_{a}{b}" for a in "xyz" for b in "xyz") + " FROM p GROUP BY 1")
def _(spark, sf):
    out = H.cross_covariance(_pairs(spark, sf))
    return out.select("scene_id", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in out.columns[2:]])


_ROW = ["(y * nz - z * ny)", "(z * nx - x * nz)", "(x * ny - y * nx)", "nx", "ny", "nz"]


@query("A27_plane_equations", f"WITH {_PAIRS} SELECT scene_id, " + ", ".join(f"round(sum({_ROW[i]} * {_ROW[j]}), "
    f"5) + 0.0 AS a{i}{j}" for i in range(6) for j in range(i, 6)) + ", " + ", ".join(f"round(sum({_ROW[i]} * (nx * (tx - x) + ny * (ty - y) + nz * (tz - z))), "
    f"5) + 0.0 AS b{i}" for i in range(6)) + " FROM p GROUP BY 1")
def _(spark, sf):
    out = H.plane_equations(_pairs(spark, sf))
    return out.select("scene_id", *[(F.round(c, 5) + 0.0).alias(c) for c in out.columns[1:]])


@query("G25_register_all")
def _(spark, sf):
    a, b = _two(spark, sf)
    return r6(H.register_all(a, b)[1], *H.RESIDUALS)


@query("A28_first_residuals", PAIR + ", n AS (SELECT scene_id, point_id, min(d2) AS d2 FROM d"
    " GROUP BY 1, 2) SELECT scene_id, 0 AS round, round(sqrt(avg(d2)), 6) AS rmse, round(avg(sqrt(d2)), 6) AS mean_abs FROM n GROUP BY 1")
def _(spark, sf):
    a, b = _two(spark, sf)
    return r6(H.register_all(a, b)[1].filter("round = 0").select("scene_id", "round", "rmse", "mean_abs"), "rmse", "mean_abs")


_MEASURED = f"{TORUS}, q AS (SELECT scene_id, sum(sqrt(nx*nx + ny*ny + nz*nz) / 2) a, abs(sum(ax * (by_*cz - bz*cy) + ay * (bz*cx - bx*cz) + az * (bx*cy - by_*cx)) / 6) v FROM n GROUP BY 1)"


@query("A4_myocardium", f"WITH {_MEASURED} SELECT scene_id, round(v - v * 0.125 - v * 0.064, 6) AS myocardium, round((v - v * 0.125 - v * 0.064) / ((a + a * 0.25 + a * 0.16) / 2), 6) AS thickness FROM q")
def _(spark, sf):
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("surface"), (F.col("area") * k * k).alias("area"), (F.col("volume") * k**3).alias("volume")) for s, k in (("epi", 1.0), ("lv", 0.5), ("rv", 0.4))]))
    return r6(K.myocardium(G.measures(*torus(spark, sf)).select("scene_id", parts.alias("p")).select("scene_id", "p.*")), "myocardium", "thickness")


@query("A8_percentiles", f"WITH {METRICS} SELECT organ, split, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM m GROUP BY 1, 2")
def _(spark, sf):
    return r6(T.percentiles(metrics(spark, sf), ["organ", "split"], "value", {"median": 0.5, "p95": 0.95}), "median", "p95")


# -- scalar functions and specs


@query("F5_gender_from_id", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM part")
def _(spark, sf):
    id_ = F.concat(F.when(F.col("p_partkey") % 2 == 0, "leu_norm_f").otherwise("leu_norm_"), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", S.gender_from_id(id_).alias("gender"))


@query("F8_flatten_keys", "SELECT user_id, (props->>'k')::int AS \"net.k\", [(props->>'k')::int, 1] AS \"net.inner.dims\" FROM events")
def _(spark, sf):
    k = F.from_json("props", "k int")["k"]
    e = table(spark, sf, "events").select("user_id", F.struct(k.alias("k"), F.struct(F.array(k, F.lit(1)).alias("dims")).alias("inner")).alias("net"))
    return e.select(*K.flat_columns(e.schema))


@query("F9_deep_update", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::varchar ELSE '7' END AS size, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN 'other,size' ELSE 'other' END AS bad FROM part")
def _(spark, sf):
    size = F.col("p_size").cast("string")
    base = F.create_map(F.lit("size"), size, F.lit("brand"), F.col("p_brand"))
    over = F.create_map(F.lit("size"), F.when(F.col("p_size") % 3 != 0, "7"), F.lit("other"), F.lit("1"))
    new = K.deep_update(base, over)
    return table(spark, sf, "part").select("p_partkey", new["size"].alias("size"), new["brand"].alias("brand"), F.array_join(K.bad_overrides(base, over), ",").alias("bad"))


@query("F13_vector_maths", f"WITH {SAMPLES} SELECT scene_id, point_id, round(x * 0.5 + y * 0.25 - z, 6) + 0.0 AS d, round(-y - 0.25 * z, 6) + 0.0 AS cx, round(sqrt(x*x + y*y + z*z), 6) AS size, sign(z)::int AS s FROM s")
def _(spark, sf):
    p, q = [F.col(k) for k in "xyz"], [F.lit(0.5), F.lit(0.25), F.lit(-1.0)]
    return samples(spark, sf).select("scene_id", "point_id", (F.round(S.dot(p, q), 6) + 0.0).alias("d"), (F.round(S.cross(p, q)[0], 6) + 0.0).alias("cx"), F.round(S.norm(p), 6).alias("size"), F.signum("z").cast("int").alias("s"))


@query("F16_anatomical_axes", f"WITH {SAMPLES}, d AS (SELECT scene_id, point_id, 1.5 - x AS dx, 0.2 - y AS dy, 0.3 - z AS dz, 0.1 - x AS wx, 1.7 - y AS wy, 0.4 - z AS wz"
    f" FROM s), c AS (SELECT *, dy * wz - dz * wy AS ex, dz * wx - dx * wz AS ey, dx * wy - dy * wx AS ez"
    f" FROM d) SELECT scene_id, point_id, round(dx / sqrt(dx*dx + dy*dy + dz*dz), 6) + 0.0 AS e1x, round(ex / sqrt(ex*ex + ey*ey + ez*ez), 6) + 0.0 AS e3x, "
    f"round(ez / sqrt(ex*ex + ey*ey + ez*ez), 6) + 0.0 AS e3z FROM c")
def _(spark, sf):
    e1, _, e3 = S.anatomical_axes([F.col(k) for k in "xyz"], [F.lit(1.5), F.lit(0.2), F.lit(0.3)], [F.lit(0.1), F.lit(1.7), F.lit(0.4)])
    return z6(samples(spark, sf).select("scene_id", "point_id", e1[0].alias("e1x"), e3[0].alias("e3x"), e3[2].alias("e3z")), "e1x", "e3x", "e3z")


# -- sorts and sets


@query("O1_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey")


@query("O2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("O6_cohort_union", "SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'AF' ELSE 'NORM' END AS cohort FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return K.cohort_union(*[c.filter(F.col("c_nationkey") % 2 == k).select(F.col("c_custkey").alias("id"), F.lit(n).alias("cohort")) for k, n in ((0, "AF"), (1, "NORM"))])


@query("O7_mask_union", f"WITH {SAMPLES} SELECT scene_id, point_id, abs(x - 0.2) <= 0.11 OR abs(x + 0.6) <= 0.11 AS hit FROM s")
def _(spark, sf):
    return T.mask_union(samples(spark, sf), "x", [0.2, -0.6], 0.11)


@query("O8_column_layout", f"WITH {METRICS} SELECT version AS combination, organ, max(value) AS most, min(value) AS least FROM m GROUP BY 1, 2")
def _(spark, sf):
    m = metrics(spark, sf).groupBy("organ", "version").agg(F.min("value").alias("least"), F.max("value").alias("most")).withColumnRenamed("version", "combination")
    head = ["combination", "organ"]
    return m.select(*head, *sorted((c for c in m.columns if c not in head), reverse=True))


# -- latent codes and composed jobs


@query("L2_effective_dimension")
def _(spark, sf):
    codes = table(spark, sf, "embeddings").withColumnRenamed("embedding", "code")
    width = len(codes.select("code").first()["code"])
    shares = L.pca(codes, width)[1]
    return spark.createDataFrame([(i, float(s), L.effective_dimension(shares)) for i, s in enumerate(shares)], "component int, share double, effective int")


_SCALES = "(VALUES (0, 1.0::double, 'epi'), (1, 0.9::double, 'lv'), (2, 0.8::double, 'rv'))"
_MOVED = ", ".join(f"{k} + CASE n WHEN 0 THEN 0.1 ELSE 0.01 END * {_gauss('scene_id::varchar', 'point_id::varchar', 'n::varchar', chr(39) + k + chr(39))} AS {k}" for k in "xyz")
#: The points of the build as pt; s has each of them three times, as the torus sees it if a scaled one is put in its place.
_BUILT = f"""{TORUS}, {_DRAW.replace('range(50)', 'range(40)')},
base AS (SELECT u0.scene_id, draw, (1 - a) * ax + a * (1 - b) * bx + a * b * cx AS x, (1 - a) * ay + a * (1 - b) * by_ + a * b * cy AS y, (1 - a) * az + a * (1 - b) * bz + a * b * cz AS z
  FROM u0 JOIN l USING (scene_id) JOIN c USING (scene_id, fid) WHERE u > low AND u <= high),
dp AS (SELECT scene_id, draw * 3 + i AS point_id, x * scale AS x, y * scale AS y, z * scale AS z, source_surface FROM base, {_SCALES} sf(i, scale, source_surface)),
jt AS (SELECT scene_id, point_id * 2 + n AS pid, {_MOVED}, source_surface FROM dp, range(2) r(n)),
ce AS (SELECT scene_id, avg(x) cx, avg(y) cy, avg(z) cz FROM v GROUP BY 1),
bu AS (SELECT *, cbrt({_ball('radius')}) r, 2 * {_ball('height')} - 1 h, 2 * pi() * {_ball('turn')} a FROM ce, range(20) d(draw)),
pt AS (SELECT * FROM jt UNION ALL SELECT scene_id, 240 + draw, cx + r * sqrt(1 - h * h) * cos(a), cy + r * sqrt(1 - h * h) * sin(a), cz + r * h, 'ball' FROM bu),
s AS (SELECT scene_id, pid * 3 + i AS point_id, x / (3 * scale) AS x, y / (3 * scale) AS y, z / scale AS z FROM pt, {_SCALES} sg(i, scale, name)), {_TRIANGLES}, {WINDING},
q AS (SELECT scene_id, point_id // 3 AS pid, point_id % 3 AS i, distance * CASE WHEN abs(w) > 0.5 THEN -1 ELSE 1 END AS sdf FROM td JOIN wn USING (scene_id, point_id))"""


@query("C1_build_samples", f"WITH {_BUILT} SELECT scene_id, pid AS point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, source_surface, "
    + ", ".join(f"round({g} * max(sdf) FILTER (WHERE i = {i}), 6) + 0.0 AS sdf_{n}" for i, (g, n) in enumerate(((1.0, "epi"), (0.9, "lv"), (0.8, "rv"))))
    + " FROM pt JOIN q USING (scene_id, pid) GROUP BY scene_id, pid, x, y, z, source_surface")
def _(spark, sf):
    return z6(Z.build_samples(nested(spark, sf), 40, 0.1, 20), "x", "y", "z", *[f"sdf_{s}" for s in ("epi", "lv", "rv")])


def nested(spark, sf):
    """Three tori of each scene, one in another."""
    v, f = torus(spark, sf)
    return {s: (v.withColumns({k: F.col(k) * g for k in "xyz"}), f) for s, g in (("epi", 1.0), ("lv", 0.9), ("rv", 0.8))}


_METRICS6 = ["chamfer", "chamfer_sum", "hausdorff", "precision", "recall", "f1", "dice", "iou"]


@query("C6_score_rows", _SCORED + ", o AS (SELECT scene_id, count(*) FILTER (WHERE sdf_epi <= 0 AND sdf_lv <= 0) b, count(*) FILTER (WHERE sdf_epi <= 0) p, "
    "count(*) FILTER (WHERE sdf_lv <= 0) g FROM s"
    " GROUP BY 1), w AS (SELECT scene_id, (m1 + m2) / 2 AS chamfer, m1 + m2 AS chamfer_sum, greatest(h1, h2) AS hausdorff, pr AS precision, rc AS recall, "
    "CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1, (2 * b + 1e-8) / (p + g + 1e-8) AS dice, (b + 1e-8) / (p + g - b + 1e-8) AS iou FROM o LEFT"
    " JOIN (ff JOIN gg USING (scene_id)) USING (scene_id)) " + " UNION ALL ".join(f"SELECT scene_id, '{m}' AS metric, round({m}, 6) AS value FROM w" for m in _METRICS6))
def _(spark, sf):
    grid = samples(spark, sf).select("scene_id", F.col("sdf_epi").alias("sdf_pred"), F.col("sdf_lv").alias("sdf_gt"))
    return r6(Z.score_rows(*_two(spark, sf), grid, tau=0.15), "value")


_APART = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z{0})*(a.z-b.z{0})"
_KERNEL = "SELECT a.scene_id, sum(exp(-0.5 * (" + _APART + ")) * (a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) * a.area * b.area) k FROM t a JOIN t b USING (scene_id) GROUP BY 1"
_NEAREST = "SELECT a.scene_id, a.fid, sqrt(min(" + _APART + ")) AS d FROM t a JOIN t b USING (scene_id) GROUP BY 1, 2"


@query("C6_with_varifold", f"""WITH {SAMPLES}, {TORUS}, ka AS ({_KERNEL.format('')}), kb AS ({_KERNEL.format('-0.1')}), da AS ({_NEAREST.format('-0.1')}), db AS ({_NEAREST.format('+0.1')}),
tau AS (SELECT scene_id, 0.01 * sqrt((max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y)) + (max(z)-min(z))*(max(z)-min(z))) AS tau FROM t GROUP BY 1),
fa AS (SELECT scene_id, avg(d) m1, max(d) h1, avg((d < tau)::int) rc FROM da JOIN tau USING (scene_id) GROUP BY 1), fb AS (SELECT scene_id, avg(d) m2, max(d) h2, avg((d < tau)::int) pr FROM db JOIN tau USING (scene_id) GROUP BY 1),
o AS (SELECT scene_id, count(*) FILTER (WHERE sdf_epi <= 0 AND sdf_lv <= 0) b, count(*) FILTER (WHERE sdf_epi <= 0) p, count(*) FILTER (WHERE sdf_lv <= 0) g FROM s GROUP BY 1),
w AS (SELECT scene_id, (m1 + m2) / 2 AS chamfer, m1 + m2 AS chamfer_sum, greatest(h1, h2) AS hausdorff, pr AS precision, rc AS recall, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1,
  (2 * b + 1e-8) / (p + g + 1e-8) AS dice, (b + 1e-8) / (p + g - b + 1e-8) AS iou, 2 * ka.k - 2 * kb.k AS varifold
  FROM fa FULL JOIN fb USING (scene_id) FULL JOIN o USING (scene_id) FULL JOIN ka USING (scene_id) FULL JOIN kb USING (scene_id))
""" + " UNION ALL ".join(f"SELECT scene_id, '{m}' AS metric, round({m}, 5) + 0.0 AS value FROM w" for m in (*_METRICS6, "varifold")))
def _(spark, sf):
    t = G.face_table(*torus(spark, sf))
    points = t.withColumnRenamed("fid", "point_id")
    moved = lambda df: df.withColumn("z", F.col("z") + 0.1)
    grid = samples(spark, sf).select("scene_id", F.col("sdf_epi").alias("sdf_pred"), F.col("sdf_lv").alias("sdf_gt"))
    out = Z.score_rows(points, moved(points), grid, faces=(t, moved(t)), gamma=0.5)
    return out.withColumn("value", F.round("value", 5) + 0.0)


@query("C8_slice_compatibility", PAIR + ", f AS (SELECT scene_id, point_id, sqrt(min(d2)) AS d FROM d"
    " GROUP BY 1, 2) SELECT thr, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95"
    " FROM f, (VALUES (0.1::double), (0.2::double), (0.4::double)) t(thr) WHERE d <= thr GROUP BY 1")
def _(spark, sf):
    near = T.explode_thresholds(N.nearest_join(*_two(spark, sf)), "distance", [0.1, 0.2, 0.4])
    out = near.groupBy("thr").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")).join(T.percentiles(near, ["thr"], "distance", {"median": 0.5, "p95": 0.95}), "thr")
    return r6(out, "mean", "median", "p95")


_COMBOS = ", ".join(f"count(*) FILTER (WHERE mask_epi = {a} AND mask_lv = {b} AND mask_rv = {c}) AS n_{a}{b}{c}" for a in (0, 1) for b in (0, 1) for c in (0, 1))


@query("C9_dataset_qa", f"WITH {SAMPLES} SELECT scene_id, count(*) FILTER (WHERE source_surface = 'epi' AND abs(sdf_epi) < 0.03) AS n_epi, "
    f"count(*) FILTER (WHERE source_surface = 'lv' AND abs(sdf_lv) < 0.03) AS n_lv, count(*) FILTER (WHERE source_surface = 'rv' AND abs(sdf_rv) < 0.03) AS n_rv, "
    f"count(*) AS n_total, arg_min((mask_epi + mask_lv + mask_rv = 0)::int, point_id) AS first_zero, arg_max((mask_epi + mask_lv + mask_rv = 0)::int, "
    f"point_id) AS last_zero, " + ", ".join(f"round(100 * count(*) FILTER (WHERE mask_{s} = 1) / count(*), 6) AS percent_{s}, min(sdf_{s}) AS min_{s}, "
    f"max(sdf_{s}) AS max_{s}" for s in ("epi", "lv", "rv")) + f", {_COMBOS}, CASE WHEN count(*) < 500 THEN 'failed' ELSE 'completed' END AS status FROM s GROUP BY 1")
def _(spark, sf):
    out = Z.dataset_qa(samples(spark, sf), 0.03, 500)
    return r6(out, *[f"percent_{s}" for s in ("epi", "lv", "rv")])