"""One query for each operator that runs on the supplied tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.operators import experiments as X
from fieldloom.operators import geometry as G
from fieldloom.operators import latent as L
from fieldloom.operators import picks as K
from fieldloom.operators import samples as P
from fieldloom.operators import spatial as N
from fieldloom.operators import tables as T
from fieldloom.plans.views import METRICS, SAMPLES, TORUS, metrics, samples, table, torus
from fieldloom.sources import io

QUERIES, SQL = {}, {}
SURFACES = ("epi", "lv", "rv")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def z6(df, *columns):
    """Rounded, without a sign on zero."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def U(*key):
    """The keyed uniform number in SQL."""
    return "(('0x' || substr(md5(concat_ws('|', " + ", ".join(key) + ")), 1, 8))::bigint + 0.5) / 4294967296.0"


# -- sources and sinks


@query("S5_split_keys", "WITH k AS (SELECT s_suppkey AS line_no, "
    "regexp_replace(regexp_extract(trim('a/' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN '.npy' ELSE '' END), '[^/]*$'), '\\.npy$', '') AS key FROM supplier"
    " WHERE s_suppkey % 5 <> 0) SELECT key, min(line_no) AS line_no FROM k GROUP BY key")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    value = F.when(F.col("s_suppkey") % 5 == 0, "# none").otherwise(F.concat(F.lit("a/"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, ".npy").otherwise("")))
    return io.split_keys(s.select(F.col("s_suppkey").alias("line_no"), value.alias("value")))


@query("S6_align_codes", "WITH k AS (SELECT s_name AS key, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier) SELECT position, key, label FROM embeddings JOIN k ON vec_id = position")
def _(spark, sf):
    codes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("position"), "label")
    return io.align_codes(codes, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line_no"), F.col("s_name").alias("key")))


@query("S11_split_lists", "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, to_json(list(s_name ORDER BY s_name))::varchar AS files FROM supplier GROUP BY 1")
def _(spark, sf):
    return io.split_lists(table(spark, sf, "supplier").select(F.col("s_name").alias("key"), F.when(F.col("s_suppkey") % 4 == 0, "test").otherwise("train").alias("split")))


@query("S12_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf):
    return io.pending(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# -- projections and filters


@query("P1_normalise_units", f"WITH {SAMPLES} SELECT scene_id, point_id, round(x / (1 + scene_id % 5), 6) AS x, round(sdf_epi / (1 + scene_id % 5), 6) AS sdf_epi FROM s")
def _(spark, sf):
    meta = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), (1 + F.col("s_suppkey") % 5).cast("double").alias("scale_mm"))
    return r6(T.normalise_units(samples(spark, sf), meta, ["x", "sdf_epi"]), "x", "sdf_epi").select("scene_id", "point_id", "x", "sdf_epi")


@query("P2_center_scale", f"WITH {SAMPLES}, c AS (SELECT scene_id, avg(x) cx, avg(y) cy, avg(z) cz FROM s"
    f" GROUP BY 1), m AS (SELECT scene_id, point_id, x - cx x, y - cy y, z - cz z FROM s JOIN c USING (scene_id)), r AS (SELECT scene_id, max(sqrt(x*x + y*y + z*z)) r"
    f" FROM m GROUP BY 1) SELECT scene_id, point_id, round(x / r, 6) + 0.0 x, round(y / r, 6) + 0.0 y, round(z / r, 6) + 0.0 z FROM m JOIN r USING (scene_id)")
def _(spark, sf):
    return P.center_scale(samples(spark, sf)).select("scene_id", "point_id", *[(F.round(k, 6) + 0.0).alias(k) for k in "xyz"])


@query("P3_apply_rigid", f"WITH {SAMPLES} SELECT scene_id, point_id, round(0.6 * x - 0.8 * y + 1, 6) AS x, round(0.8 * x + 0.6 * y + 2, 6) AS y, round(z + 3, 6) AS z, "
    f"round(0.6 * x + 0.8 * y + 1, 6) AS rx, round(-0.8 * x + 0.6 * y + 2, 6) AS ry FROM s")
def _(spark, sf):
    p, turn, shift = samples(spark, sf).select("scene_id", "point_id", "x", "y", "z"), [0.6, -0.8, 0, 0.8, 0.6, 0, 0, 0, 1], [1, 2, 3]
    left, right = (r6(T.apply_rigid(p, turn, shift, right=r), "x", "y", "z") for r in (False, True))
    return left.join(right.select("scene_id", "point_id", F.col("x").alias("rx"), F.col("y").alias("ry")), ["scene_id", "point_id"])


def _with_plane(df, **values):
    """df with the columns of one plane."""
    return df.withColumns({k + a: F.lit(float(v)) for k, vs in values.items() for a, v in zip("xyz", vs)})


@query("P4_plane_coords", f"WITH {SAMPLES} SELECT scene_id, point_id, round(((x - 0.1) + (y - 0.2)) / sqrt(2), 6) AS u, round(z - 0.3, 6) AS v FROM s")
def _(spark, sf):
    p = _with_plane(samples(spark, sf), o=(0.1, 0.2, 0.3), u=(1, 1, 0), v=(0, 0, 2))
    return r6(T.plane_coords(p), "u", "v").select("scene_id", "point_id", "u", "v")


@query("P5_project_to_plane", f"WITH {SAMPLES}, d AS (SELECT *, (x - 0.1) * 0.6 + (z - 0.05) * 0.8 AS depth"
    f" FROM s) SELECT scene_id, point_id, round(depth, 6) AS depth, round(x - depth * 0.6, 6) AS fx, round(y, 6) AS fy, round(z - depth * 0.8, 6) AS fz FROM d")
def _(spark, sf):
    p = T.project_to_plane(_with_plane(samples(spark, sf), o=(0.1, 0, 0.05), n=(3, 0, 4)))
    return r6(p, "depth", "fx", "fy", "fz").select("scene_id", "point_id", "depth", "fx", "fy", "fz")


@query("P6_near_surface", f"WITH {SAMPLES} SELECT scene_id, point_id FROM s WHERE abs(sdf_epi) <= 0.021")
def _(spark, sf):
    return P.near_surface(samples(spark, sf), "epi", 0.021).select("scene_id", "point_id")


@query("P7_near_surface_strict", f"WITH {SAMPLES} SELECT scene_id, point_id FROM s WHERE abs(sdf_rv) < 0.02")
def _(spark, sf):
    return P.near_surface(samples(spark, sf), "rv", 0.02, strict=True).select("scene_id", "point_id")


@query("P8_clamp_sdf", f"WITH {SAMPLES} SELECT scene_id, point_id, round(greatest(least(sdf_rv, 0.05), -0.05), 6) AS sdf_rv FROM s")
def _(spark, sf):
    return samples(spark, sf).select("scene_id", "point_id", F.round(P.clamp(F.col("sdf_rv"), 0.05), 6).alias("sdf_rv"))


@query("P9_mask_filter", f"WITH {SAMPLES} SELECT scene_id, point_id FROM s WHERE mask_lv > 0.5")
def _(spark, sf):
    return T.mask_filter(samples(spark, sf), "lv").select("scene_id", "point_id")


@query("P10_periodic_slabs", f"WITH {SAMPLES}, e AS (SELECT scene_id, min(y) lo, max(y) hi FROM s"
    f" GROUP BY 1), k AS (SELECT s.scene_id, point_id, y - lo AS rel, hi - lo AS span, floor((y - lo) / 0.21) AS k FROM s"
    f" JOIN e USING (scene_id)) SELECT scene_id, point_id FROM k WHERE (k * 0.21 < span AND abs(rel - k * 0.21) <= 0.025) OR ((k + 1) * 0.21 < span AND abs(rel - (k + 1) * 0.21) <= 0.025)")
def _(spark, sf):
    return P.periodic_slabs(samples(spark, sf), "y", 0.05, 0.21).select("scene_id", "point_id")


@query("P12_near_any_band", f"WITH {SAMPLES} SELECT scene_id, point_id FROM s WHERE coalesce(abs(sdf_epi) <= 0.011, false) OR coalesce(abs(sdf_lv) <= 0.011, false) OR coalesce(abs(sdf_rv) <= 0.011, false)")
def _(spark, sf):
    return T.near_any_band(samples(spark, sf), 0.011).select("scene_id", "point_id")


@query("P13_supervision_mask", f"WITH {SAMPLES} SELECT scene_id, point_id, 'hybrid' AS mode, (source_surface = 'epi')::int AS mask_epi, "
    f"1 AS mask_lv, (x <> 0)::int AS mask_rv FROM s UNION ALL SELECT scene_id, point_id, 'local', mask_epi, mask_lv, mask_rv FROM s"
    f" UNION ALL SELECT scene_id, point_id, 'finite', 1, 1, (x <> 0)::int FROM s")
def _(spark, sf):
    s = samples(spark, sf).withColumn("sdf_rv", F.when(F.col("x") == 0, F.lit(float("inf"))).otherwise(F.col("sdf_rv")))
    out = [s.select("scene_id", "point_id", F.lit(m).alias("mode"), *P.supervision_mask(m)) for m in ("hybrid", "local", "finite")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("P14_zero_masked", f"WITH {SAMPLES} SELECT scene_id, point_id, CASE WHEN mask_epi = 1 THEN round(sdf_epi, 6) ELSE 0.0 END AS sdf_epi, mask_epi FROM s")
def _(spark, sf):
    gap = F.when(F.col("mask_lv") == 1, F.lit(float("-inf")))
    s = samples(spark, sf).withColumn("sdf_epi", F.when(F.col("mask_epi") == 1, F.round("sdf_epi", 6)).otherwise(gap))
    return s.select("scene_id", "point_id", *P.zero_masked("epi"))


@query("P15_status", "SELECT s_suppkey, CASE WHEN s_nationkey IN (1, 2, 3) THEN 'excluded' ELSE 'ok' END AS status FROM supplier")
def _(spark, sf):
    return T.with_status(table(spark, sf, "supplier"), "s_nationkey", [1, 2, 3]).select("s_suppkey", "status")


@query("P16_degenerate_runs", "WITH b AS (SELECT user_id FROM events GROUP BY user_id, event_type HAVING min(value) <= 0.2) SELECT user_id AS version, count(*) AS n"
    " FROM events WHERE user_id NOT IN (SELECT user_id FROM b) GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("version"), F.col("event_type").alias("tag"), "value")
    return X.degenerate_free(e, 0.2).groupBy("version").agg(F.count("*").alias("n"))


@query("P17_select_tags", "SELECT p_partkey FROM part WHERE p_size IN (SELECT p_size FROM part WHERE p_size IN (3, 7, 999))")
def _(spark, sf):
    return T.select_tags(table(spark, sf, "part"), [3, 7, 999], "p_size").select("p_partkey")


# -- joins

@query("J1_match_metadata", "WITH l AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS gender FROM orders GROUP BY 1) SELECT c_custkey AS id, gender FROM customer LEFT JOIN l ON id = c_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("LEU_BBB_"), "o_custkey").alias("raw"), F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("gender"))
    o = o.withColumn("id", S.norm_id(F.col("raw"), F.lit("BBB")).cast("bigint"))
    return X.match_metadata(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), o, "id", "gender")


@query("J2_merge_landmarks", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders"
    " WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer)) ON o_custkey = c_custkey")
def _(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status")
    return T.merge_landmarks(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), status), "c_custkey")


@query("J3_combine_metrics", f"WITH {METRICS} SELECT organ, round(avg(value), 6) AS chamfer_mean, round(stddev_samp(value), 6) AS chamfer_std, round(avg(other), "
    f"6) AS hausdorff_mean, round(stddev_samp(other), 6) AS hausdorff_std FROM m GROUP BY 1")
def _(spark, sf):
    m = metrics(spark, sf)
    rows = m.select("organ", F.lit("chamfer").alias("metric"), "value").unionByName(m.select("organ", F.lit("hausdorff").alias("metric"), F.col("other").alias("value")))
    out = X.combine_metrics(X.mean_std(rows, ["organ", "metric"]), ["chamfer", "hausdorff"])
    return r6(out, *out.columns[1:])


@query("J4_attach_specs", f"WITH {METRICS} SELECT version, patient, organ, value, p_brand, p_size::varchar AS p_size FROM m LEFT JOIN part ON p_partkey = version")
def _(spark, sf):
    specs = table(spark, sf, "part").withColumn("version", F.col("p_partkey").cast("int"))
    return X.attach_specs(metrics(spark, sf).select("version", "patient", "organ", "value"), specs, ["p_brand", "p_size"])


@query("J5_assign_split", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'train' WHEN c_custkey % 2 = 0 THEN 'test' ELSE 'unknown' END AS split FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return X.assign_split(c, c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 2 = 0"), "c_custkey")


@query("J6_existing_and_missing", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS there FROM customer")
def _(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return T.existing(c, o, "c_custkey").withColumn("there", F.lit(True)).unionByName(T.missing(c, o, "c_custkey").withColumn("there", F.lit(False)))


PAIR = f"WITH {SAMPLES}, a AS (SELECT * FROM s WHERE mask_epi = 1), b AS (SELECT * FROM s WHERE mask_lv = 1), d AS (SELECT a.scene_id, a.point_id, b.point_id AS r, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM a JOIN b USING (scene_id))"


def _two(spark, sf):
    s = samples(spark, sf)
    return s.filter("mask_epi = 1"), s.filter("mask_lv = 1")


@query("J7_nearest_join", PAIR + " SELECT scene_id, point_id, arg_min(r, (d2, r)) AS nearest_id, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY 1, 2"
    " UNION ALL SELECT scene_id, point_id, NULL, NULL FROM a WHERE scene_id NOT IN (SELECT scene_id FROM b)")
def _(spark, sf):
    return r6(N.nearest_join(*_two(spark, sf)), "distance")


@query("J9_points_in_slab", f"WITH {SAMPLES} SELECT scene_id, plane_id, count(*) AS n, round(avg(d), 6) + 0.0 AS depth"
    f" FROM (SELECT s.scene_id, plane_id, CASE WHEN plane_id < 5 THEN z - c ELSE 0.6 * x + 0.8 * y - c END AS d FROM s"
    f" JOIN (SELECT s_suppkey AS scene_id, k AS plane_id, k * 0.33 - 1.003 AS c FROM supplier, range(7) t(k)) USING (scene_id)) WHERE abs(d) <= 0.1 GROUP BY 1, 2")
def _(spark, sf):
    planes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("plane_id")).withColumn("c", F.col("plane_id") * 0.33 - 1.003)
    up = F.col("plane_id") < 5
    n = {"nx": F.when(up, 0.0).otherwise(0.6), "ny": F.when(up, 0.0).otherwise(0.8), "nz": F.when(up, 1.0).otherwise(0.0)}
    planes = planes.withColumns(n).withColumns({"o" + k: F.col("c") * F.col("n" + k) for k in "xyz"})
    hit = N.points_in_slab(samples(spark, sf), planes, 0.1)
    return hit.groupBy("scene_id", "plane_id").agg(F.count("*").alias("n"), (F.round(F.avg("depth"), 6) + 0.0).alias("depth"))


PLANES = "p AS (SELECT s_suppkey AS scene_id, k AS plane_id, CASE WHEN k < 4 THEN 'SA' ELSE 'LA' END AS t, CASE WHEN k < 4 THEN 0.0 ELSE 1.0 END AS nx, CASE WHEN k = 5 THEN 1.0 ELSE 0.0 END AS ny, CASE WHEN k < 4 THEN 1.0 ELSE 0.0 END AS nz FROM supplier, range(6) a(k))"


@query("J10_plane_pairs", f"WITH {PLANES} SELECT a.scene_id, a.plane_id AS sa_plane, b.plane_id AS la_plane FROM p a JOIN p b USING (scene_id) WHERE a.t = 'SA' AND b.t = 'LA'")
def _(spark, sf):
    k = F.col("plane_id")
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("plane_id"))
    p = p.select("scene_id", "plane_id", F.when(k < 4, "SA").otherwise("LA").alias("plane_type"), F.when(k < 4, 0.0).otherwise(1.0).alias("nx"), F.when(k == 5, 1.0).otherwise(0.0).alias("ny"), F.when(k < 4, 1.0).otherwise(0.0).alias("nz"))
    return G.plane_pairs(p)


@query("J11_radius_sum", PAIR + " SELECT scene_id, d.point_id, count(*) AS n, round(sum(b.sdf_rv), 6) + 0.0 AS mass FROM d JOIN b USING (scene_id) WHERE b.point_id = d.r AND d2 <= 0.2::double * 0.2::double GROUP BY 1, 2")
def _(spark, sf):
    a, b = _two(spark, sf)
    return N.radius_sum(a, b.withColumn("mass", F.col("sdf_rv")), 0.2).select("scene_id", "point_id", "n", (F.round("mass", 6) + 0.0).alias("mass"))


@query("J12_broadcast_dimension", f"WITH {SAMPLES} SELECT s.scene_id, point_id, s_name FROM s JOIN supplier ON s_suppkey = s.scene_id")
def _(spark, sf):
    return T.with_dimension(samples(spark, sf).select("scene_id", "point_id"), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), "s_name"))


@query("J13_explode_thresholds", f"WITH {SAMPLES} SELECT scene_id, thr, count(*) AS n FROM s, (VALUES (0.01::double), (0.021::double), (0.055::double)) t(thr) WHERE abs(sdf_epi) <= thr GROUP BY 1, 2")
def _(spark, sf):
    rows = T.explode_thresholds(samples(spark, sf).withColumn("d", F.abs("sdf_epi")), "d", [0.01, 0.021, 0.055])
    return rows.groupBy("scene_id", "thr").agg(F.count("*").alias("n"))


# -- aggregations


@query("A1_centroid", f"WITH {SAMPLES} SELECT scene_id, round(avg(x), 6) + 0.0 x, round(avg(y), 6) + 0.0 y, round(avg(z), 6) + 0.0 z FROM s GROUP BY 1")
def _(spark, sf):
    return z6(T.centroid(samples(spark, sf)), "x", "y", "z")


@query("A2_area_weighted_centroid", f"WITH {TORUS}, "
    f"g2 AS (SELECT f.scene_id, (a.x * (1 + a.x / 5) + b.x * (1 + b.x / 5) + c.x * (1 + c.x / 5)) / 3 AS x, (a.z + b.z + c.z) / 3 AS z, "
    f"b.x * (1 + b.x / 5) - a.x * (1 + a.x / 5) AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x * (1 + c.x / 5) - a.x * (1 + a.x / 5) AS wx, c.y - a.y AS wy, c.z - a.z AS wz"
    f" FROM f JOIN v a ON a.scene_id = f.scene_id AND a.vid = v0 JOIN v b ON b.scene_id = f.scene_id AND b.vid = v1"
    f" JOIN v c ON c.scene_id = f.scene_id AND c.vid = v2), q AS (SELECT *, "
    f"sqrt((uy*wz-uz*wy)*(uy*wz-uz*wy) + (uz*wx-ux*wz)*(uz*wx-ux*wz) + (ux*wy-uy*wx)*(ux*wy-uy*wx)) / 2 AS area"
    f" FROM g2) SELECT scene_id, round(sum(area * x) / sum(area), 6) + 0.0 AS x, round(sum(area * z) / sum(area), 6) + 0.0 AS z FROM q GROUP BY 1")
def _(spark, sf):
    v, f = torus(spark, sf)  # stretched along x, so that the centroid is not the origin
    return z6(G.area_weighted_centroid(v.withColumn("x", F.col("x") * (1 + F.col("x") / 5)), f), "x", "z").select("scene_id", "x", "z")


@query("A3_area_volume", f"WITH {TORUS} SELECT scene_id, round(sum(sqrt(nx*nx + ny*ny + nz*nz) / 2), 6) AS area, "
    f"round(abs(sum(ax * (by_*cz - bz*cy) + ay * (bz*cx - bx*cz) + az * (bx*cy - by_*cx)) / 6), 6) AS volume FROM n GROUP BY 1")
def _(spark, sf):
    return r6(G.measures(*torus(spark, sf)), "area", "volume")


@query("A5_mean_std", f"WITH {METRICS} SELECT organ, split, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM m GROUP BY 1, 2")
def _(spark, sf):
    return r6(X.mean_std(metrics(spark, sf), ["organ", "split"]), "mean", "std")


@query("A6_mean_std_pop", f"WITH {METRICS} SELECT organ, version, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM m GROUP BY 1, 2")
def _(spark, sf):
    return r6(X.mean_std(metrics(spark, sf), ["organ", "version"], population=True), "mean", "std")


@query("A7_describe", f"WITH {METRICS} SELECT organ, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS least, "
    f"round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, "
    f"0.95), 6) AS p95, max(value) AS most FROM m GROUP BY 1")
def _(spark, sf):
    return r6(X.describe(metrics(spark, sf), ["organ"], "value"), "mean", "std", "p25", "p50", "p75", "p95")


_COMPAT = ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(median({c}), 6) AS median_{c}, round(quantile_cont({c}, 0.95), 6) AS p95_{c}" for c in ("distance", "delta", "ratio"))


@query("A9_compat_summary", f"WITH {SAMPLES}, q AS (SELECT source_surface, abs(sdf_epi) AS distance, abs(sdf_lv - sdf_rv) AS delta, "
    f"abs(sdf_lv - sdf_rv) / nullif(abs(sdf_epi), 0) AS ratio, (sign(sdf_lv) <> sign(sdf_rv))::int AS differ FROM s), g AS (SELECT surface, thr"
    f" FROM (VALUES ('epi'), ('lv'), ('rv'), ('none')) a(surface), (VALUES (0.01::double), (0.03::double)) b(thr)) SELECT surface, thr, count(distance) AS n, {_COMPAT}, "
    f"round(max(delta), 6) AS max_delta, round(avg((ratio > 1)::int), 6) AS ratio_above_1, round(avg(differ), 6) AS sign_mismatch FROM g LEFT"
    f" JOIN q ON source_surface = surface AND distance <= thr GROUP BY 1, 2")
def _(spark, sf):
    rows = samples(spark, sf).select(F.col("source_surface").alias("surface"), F.abs("sdf_epi").alias("distance"), F.col("sdf_lv").alias("sdf_a"), F.col("sdf_rv").alias("sdf_b"))
    out = T.compat_summary(rows, {"surface": ["epi", "lv", "rv", "none"]}, [0.01, 0.03])
    return r6(out, *[c for c in out.columns if c not in ("surface", "thr", "n")])


@query("A10_intersection_summary", f"WITH {SAMPLES}, q AS (SELECT scene_id % 4 AS sa_plane, scene_id % 3 AS lax_plane, source_surface AS organ, "
    f"abs(sdf_lv - sdf_rv) AS d, CASE WHEN sdf_lv <= 0 OR sdf_rv <= 0 THEN abs(sdf_lv - sdf_rv) END AS i, (sign(sdf_lv) <> sign(sdf_rv))::int AS differ"
    f" FROM s) SELECT sa_plane, lax_plane, organ, count(*) AS n, count(i) AS n_inside, round(avg(d), 6) AS mean, round(max(d), 6) AS most, round(avg(i), "
    f"6) AS mean_inside, round(avg(differ), 6) AS sign_mismatch, count(*) FILTER (WHERE d <= 0.02) AS within_0, count(*) FILTER (WHERE d <= 0.05) AS within_1, "
    f"round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(median(i), 6) AS median_inside, round(quantile_cont(i, 0.95), 6) AS p95_inside FROM q GROUP BY 1, 2, 3")
def _(spark, sf):
    keys = (F.col("scene_id") % 4).alias("sa_plane"), (F.col("scene_id") % 3).alias("lax_plane"), F.col("source_surface").alias("organ")
    rows = samples(spark, sf).select(*keys, F.col("sdf_lv").alias("sdf_sa"), F.col("sdf_rv").alias("sdf_lax"))
    out = T.intersection_summary(rows, ["sa_plane", "lax_plane", "organ"], [0.02, 0.05])
    return r6(out, "mean", "most", "mean_inside", "sign_mismatch", "median", "p95", "median_inside", "p95_inside")


@query("A11_mask_stats", f"WITH {SAMPLES}, k AS (SELECT DISTINCT scene_id, a, b, c"
    f" FROM s, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), (VALUES (0), (1)) z(c)) SELECT k.scene_id, a AS mask_epi, b AS mask_lv, c AS mask_rv, count(point_id) AS n"
    f" FROM k LEFT JOIN s ON s.scene_id = k.scene_id AND mask_epi = a AND mask_lv = b AND mask_rv = c GROUP BY ALL")
def _(spark, sf):
    return P.mask_stats(samples(spark, sf))


@query("A11_valid_shares", f"WITH {SAMPLES} " + " UNION ALL ".join(f"SELECT scene_id, '{s}' AS surface, count(*) FILTER (WHERE mask_{s} = 1) AS n_valid, "
    f"round(100 * count(*) FILTER (WHERE mask_{s} = 1) / count(*), 6) AS percent FROM s GROUP BY 1" for s in SURFACES))
def _(spark, sf):
    return r6(P.valid_shares(samples(spark, sf)), "percent")


@query("A12_sample_counts", f"WITH {SAMPLES}, p AS (SELECT scene_id, count(*) n, count(*) FILTER (WHERE mask_epi + mask_lv > 0) v FROM s"
    f" GROUP BY 1) SELECT round(avg(n), 6) AS mean_n, min(n) AS min_n, max(n) AS max_n, round(avg(v), 6) AS mean_valid, round(100 * avg(v) / avg(n), 6) AS mean_percent FROM p")
def _(spark, sf):
    return r6(P.sample_counts(samples(spark, sf).withColumn("mask_rv", F.lit(0))), "mean_n", "mean_valid", "mean_percent")


@query("A13_threshold_counts", f"WITH {SAMPLES} SELECT scene_id, " + ", ".join(f"count(*) FILTER (WHERE source_surface = '{s}' AND abs(sdf_{s}) < 0.03) AS n_{s}" for s in SURFACES) + ", "
    "count(*) AS n_total FROM s GROUP BY 1")
def _(spark, sf):
    s = samples(spark, sf)
    return T.requested_guard(P.threshold_counts(s, 0.03), s)


@query("A14_profile", f"WITH {SAMPLES} SELECT " + ", ".join(f"min({k}) AS min_{k}, max({k}) AS max_{k}" for k in "xyz") + ", " + ", ".join(f"min(sdf_{s}) AS min_{s}, "
    f"max(sdf_{s}) AS max_{s}, round(avg(sdf_{s}), 6) AS avg_{s}" for s in SURFACES) + " FROM s")
def _(spark, sf):
    return P.profile(samples(spark, sf))


@query("A14_mask_values", f"WITH {SAMPLES} " + " UNION ALL ".join(f"SELECT 'mask_{s}' AS mask, mask_{s} AS value, count(*) AS n FROM s GROUP BY 2" for s in SURFACES))
def _(spark, sf):
    return P.mask_values(samples(spark, sf))


@query("A15_crosstab", "SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey % 2 = 0) AS F, count(*) FILTER (WHERE c_nationkey % 2 = 1) AS M FROM customer WHERE c_nationkey <> 7 GROUP BY 1")
def _(spark, sf):
    return X.crosstab(_genders(spark, sf), "c_mktsegment", "gender", ["F", "M"])


def _genders(spark, sf):
    k = F.col("c_nationkey")
    return table(spark, sf, "customer").select("c_mktsegment", F.when(k == 7, None).when(k % 2 == 0, "F").otherwise("M").alias("gender"))


_TOTALS = "count(*) FILTER (WHERE c_nationkey % 2 = 0) AS F, count(*) FILTER (WHERE c_nationkey % 2 = 1 AND c_nationkey <> 7) AS M, count(*) FILTER (WHERE c_nationkey <> 7) AS total, count(*) FILTER (WHERE c_nationkey = 7) AS missing FROM customer"


@query("A15_totals", f"SELECT c_mktsegment, {_TOTALS} GROUP BY 1 UNION ALL SELECT 'all', {_TOTALS}")
def _(spark, sf):
    return T.grand_table(_genders(spark, sf), "c_mktsegment", "gender", ["F", "M"])


@query("A16_histogram", "WITH e AS (SELECT floor(min(o_totalprice) / 10000) * 10000 lo, ceil(max(o_totalprice) / 10000) * 10000 hi"
    " FROM orders) SELECT least(floor((o_totalprice - lo) / 10000), greatest(round((hi - lo) / 10000), 1) - 1)::int AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def _(spark, sf):
    return X.histogram(table(spark, sf, "orders"), "o_totalprice", 10000)


_DIRECTED = PAIR + ", f AS (SELECT scene_id, point_id, sqrt(min(d2)) d FROM d GROUP BY 1, 2), g AS (SELECT scene_id, r, sqrt(min(d2)) d FROM d GROUP BY 1, 2), ff AS (SELECT scene_id, avg(d) m1, max(d) h1, avg((d < 0.15)::int) rc FROM f GROUP BY 1), gg AS (SELECT scene_id, avg(d) m2, max(d) h2, avg((d < 0.15)::int) pr FROM g GROUP BY 1)"


_SCORED = _DIRECTED + ", sc AS (SELECT DISTINCT scene_id FROM s WHERE mask_epi = 1 OR mask_lv = 1)"


@query("A17_surface_scores", _SCORED + " SELECT scene_id, round((m1 + m2) / 2, 6) AS chamfer, round(m1 + m2, 6) AS chamfer_sum, round(greatest(h1, h2), 6) AS hausdorff, "
    "round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1 FROM sc LEFT JOIN (ff JOIN gg USING (scene_id)) USING (scene_id)")
def _(spark, sf):
    return r6(N.surface_scores(*_two(spark, sf), tau=0.15), "chamfer", "chamfer_sum", "hausdorff", "precision", "recall", "f1")


@query("A20_f1_at_share_of_diagonal", PAIR + ", t AS (SELECT scene_id, "
    "0.1 * sqrt((max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y)) + (max(z)-min(z))*(max(z)-min(z))) AS tau FROM a"
    " GROUP BY 1), f AS (SELECT scene_id, point_id, sqrt(min(d2)) d FROM d GROUP BY 1, 2), g AS (SELECT scene_id, r, sqrt(min(d2)) d FROM d"
    " GROUP BY 1, 2), ff AS (SELECT scene_id, avg((d < tau)::int) rc FROM f JOIN t USING (scene_id) GROUP BY 1), gg AS (SELECT scene_id, avg((d < tau)::int) pr FROM g"
    " JOIN t USING (scene_id) GROUP BY 1) SELECT scene_id, round(pr, 6) AS precision, round(rc, 6) AS recall FROM ff JOIN gg USING (scene_id)")
def _(spark, sf):
    gt, pred = N.sides(*_two(spark, sf))
    tau = N.share_of_diagonal(gt, 0.1)
    f, b = (N.directed(p, q, tau).filter("share is not null").select("scene_id", F.round("share", 6).alias(n)) for p, q, n in ((gt, pred, "recall"), (pred, gt, "precision")))
    return f.join(b, "scene_id").select("scene_id", "precision", "recall")


@query("A21_overlap", f"WITH {SAMPLES}, n AS (SELECT scene_id, count(*) FILTER (WHERE sdf_epi <= 0 AND sdf_lv <= 0) b, count(*) FILTER (WHERE sdf_epi <= 0) p, "
    f"count(*) FILTER (WHERE sdf_lv <= 0) g FROM s GROUP BY 1) SELECT scene_id, round((2 * b + 1e-8) / (p + g + 1e-8), 6) AS dice, round((b + 1e-8) / (p + g - b + 1e-8), 6) AS iou FROM n")
def _(spark, sf):
    cell = [(F.col("point_id") / 1000).cast("long").alias("ix"), (F.col("point_id") % 1000 / 10).cast("long").alias("iy"), (F.col("point_id") % 10).alias("iz")]
    s = samples(spark, sf).select("scene_id", *cell, "sdf_epi", "sdf_lv")
    both = N.on_grid(s.withColumnRenamed("sdf_epi", "sdf"), s.withColumnRenamed("sdf_lv", "sdf"))
    return r6(N.overlap(both), "dice", "iou")


@query("A22_varifold", f"WITH {TORUS}, k AS (SELECT a.scene_id, "
    f"sum(exp(-0.5 * ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) * (a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) * a.area * b.area) k FROM t a"
    f" JOIN t b USING (scene_id)"
    f" GROUP BY 1), q AS (SELECT a.scene_id, "
    f"sum(exp(-0.5 * ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z-0.1)*(a.z-b.z-0.1))) * (a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) * a.area * b.area) k FROM t a"
    f" JOIN t b USING (scene_id) GROUP BY 1) SELECT scene_id, round(2 * k.k - 2 * q.k, 5) AS distance FROM k JOIN q USING (scene_id)")
def _(spark, sf):
    t = G.face_table(*torus(spark, sf))
    return G.varifold(t, t.withColumn("z", F.col("z") + 0.1), 0.5).select("scene_id", F.round("distance", 5).alias("distance"))


def _pred(spark, sf):
    s = samples(spark, sf)
    return s.select("scene_id", F.explode(F.array(*[F.struct(F.lit(x).alias("surface"), F.col(f"sdf_{x}").alias("gt"), F.col(f"mask_{x}").alias("mask"), (F.col(f"sdf_{x}") + F.col("x") / 100).alias("pred")) for x in SURFACES])).alias("p")).select("scene_id", "p.*")


PRED = SAMPLES + ", p AS (" + " UNION ALL ".join(f"SELECT scene_id, '{x}' AS surface, sdf_{x} AS gt, mask_{x} AS mask, sdf_{x} + x / 100 AS pred FROM s" for x in SURFACES) + ")"


@query("A23_masked_loss", f"WITH {PRED}, k AS (SELECT *, 'l1' AS kind, abs(pred - gt) AS e FROM p UNION ALL SELECT *, 'mse', (pred - gt) * (pred - gt) FROM p"
    f" UNION ALL SELECT *, 'smooth', CASE WHEN abs(pred - gt) < 1 THEN 0.5 * (pred - gt) * (pred - gt) ELSE abs(pred - gt) - 0.5 END"
    f" FROM p), l AS (SELECT scene_id, kind, surface, sum(e * mask) / (sum(mask) + 1e-8) AS loss FROM k GROUP BY 1, 2, 3) SELECT scene_id, kind, round(avg(loss), 8) AS loss FROM l GROUP BY 1, 2")
def _(spark, sf):
    out = [N.masked_loss(_pred(spark, sf), k).select("scene_id", F.lit(k).alias("kind"), F.round("loss", 8).alias("loss")) for k in ("l1", "mse", "smooth")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("A24_error_summary", f"WITH {PRED} SELECT surface, count(*) AS n, round(avg(abs(pred - gt)), 6) AS mae, round(sqrt(avg((pred - gt) * (pred - gt))), 6) AS rmse, "
    f"round(avg(pred - gt), 6) AS bias FROM p WHERE mask > 0.5 GROUP BY 1")
def _(spark, sf):
    return r6(N.error_summary(_pred(spark, sf), "surface"), "mae", "rmse", "bias")


@query("A25_covariance", f"WITH {SAMPLES} SELECT scene_id, " + ", ".join(f"round(avg({k}), "
    f"6) AS mean_{k}" for k in "xyz") + ", " + ", ".join(f"round(covar_samp({a}, {b}), "
    f"6) AS c{a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))) + " FROM s GROUP BY 1")
def _(spark, sf):
    c = G.covariance(samples(spark, sf))
    return r6(c, *c.columns[1:])


@query("A29_edge_audit", f"WITH {TORUS}, e AS (SELECT scene_id, least(v0, v1) p, greatest(v0, v1) q FROM f WHERE fid <> 5"
    f" UNION ALL SELECT scene_id, least(v1, v2), greatest(v1, v2) FROM f WHERE fid <> 5 UNION ALL SELECT scene_id, least(v2, v0), greatest(v2, v0) FROM f"
    f" WHERE fid <> 5), ec AS (SELECT scene_id, p, q, count(*) n FROM e"
    f" GROUP BY 1, 2, 3) SELECT scene_id, count(*) AS edges, count(*) FILTER (WHERE n = 1) AS boundary, count(*) FILTER (WHERE n = 1) = 0 AS watertight FROM ec GROUP BY 1")
def _(spark, sf):
    return G.edge_audit(torus(spark, sf)[1].filter("fid <> 5"))


@query("A30_unique_tags", "SELECT p_brand, list_sort(list_distinct(list(p_size))) AS tags FROM part GROUP BY 1")
def _(spark, sf):
    return T.unique_tags(table(spark, sf, "part"), "p_brand", "p_size")


_STATUS = "SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'skipped_existing' WHEN 2 THEN 'failed' ELSE 'skipped_missing' END AS status FROM supplier"


def _statuses(spark, sf):
    k = F.col("s_nationkey") % 4
    return table(spark, sf, "supplier").select("s_suppkey", F.when(k == 0, "completed").when(k == 1, "skipped_existing").when(k == 2, "failed").otherwise("skipped_missing").alias("status"))


@query("A31_batch_report", f"WITH r AS ({_STATUS}) SELECT count(*) FILTER (WHERE status = 'completed') AS completed, "
    f"count(*) FILTER (WHERE status LIKE 'skipped%') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed FROM r")
def _(spark, sf):
    return X.batch_report(_statuses(spark, sf))


@query("A31_failures", f"WITH r AS ({_STATUS}) SELECT * FROM r WHERE status = 'failed'")
def _(spark, sf):
    return T.failures(_statuses(spark, sf), "s_suppkey")


@query("A32_extremes", "SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS least, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS most FROM supplier GROUP BY 1")
def _(spark, sf):
    return T.extremes(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal")


@query("A33_extent", f"WITH {SAMPLES} SELECT scene_id, round(max(0.6*x + 0.8*y) - min(0.6*x + 0.8*y), 6) AS du, round(max(z) - min(z), 6) AS dv, "
    f"round(greatest(max(0.6*x + 0.8*y) - min(0.6*x + 0.8*y), max(z) - min(z)), 6) AS larger FROM s GROUP BY 1")
def _(spark, sf):
    return r6(T.extent(samples(spark, sf), [0.6, 0.8, 0], [0, 0, 1]), "du", "dv", "larger")


# -- selections

_H = U("scene_id::varchar", "point_id::varchar", "'{}'")


@query("W1_stratified_pick", f"WITH {SAMPLES}, e AS (SELECT scene_id, min(x) ax, max(x) bx, min(y) ay, max(y) by_ FROM s"
    f" GROUP BY 1), c AS (SELECT s.scene_id, point_id, least(floor((x - ax) / greatest(bx - ax, 1e-12) * 5), "
    f"4)::bigint || '_' || least(floor((y - ay) / greatest(by_ - ay, 1e-12) * 5), 4)::bigint AS cell FROM s"
    f" JOIN e USING (scene_id)), t AS (SELECT *, row_number() OVER (PARTITION BY scene_id, cell"
    f" ORDER BY {_H.format('pick')}, point_id) AS turn, {U('scene_id::varchar', 'cell', chr(39) + 'pick' + chr(39))} AS ch"
    f" FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY turn, ch, cell) AS rank FROM t) SELECT scene_id, point_id, cell, rank FROM r WHERE rank <= 40")
def _(spark, sf):
    return P.stratified_pick(samples(spark, sf), ["x", "y"], 5, 40).select("scene_id", "point_id", "cell", "rank")


@query("W2_band_pick", f"WITH {SAMPLES}, n AS (SELECT scene_id, "
    f"CASE WHEN count(*) FILTER (WHERE abs(sdf_epi) <= 0.005) >= 60 THEN 0.005 WHEN count(*) FILTER (WHERE abs(sdf_epi) <= 0.015) >= 60 THEN 0.015 ELSE 0.035 END AS band"
    f" FROM s GROUP BY 1) SELECT scene_id, point_id, band::double AS band FROM s JOIN n USING (scene_id) WHERE abs(sdf_epi) <= band")
def _(spark, sf):
    return P.band_pick(samples(spark, sf).withColumn("d", F.abs("sdf_epi")), "d", [0.005, 0.015, 0.035], 60).select("scene_id", "point_id", "band")


@query("W6_weighted_sample", f"WITH {SAMPLES}, k AS (SELECT scene_id, point_id, -ln({_H.format('weighted')}) / abs(y) AS key FROM s"
    f" WHERE abs(y) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY key, point_id) AS rank FROM k) SELECT scene_id, point_id FROM r WHERE rank <= 25")
def _(spark, sf):
    return P.weighted_sample(samples(spark, sf), F.abs("y"), 25).select("scene_id", "point_id")


@query("W8_resample", f"WITH {SAMPLES}, r AS (SELECT scene_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) AS rank"
    f" FROM s), d AS (SELECT scene_id, draw, floor({U('scene_id::varchar', 'draw::varchar', chr(39) + 'draw' + chr(39))} * n)::bigint + 1 AS rank"
    f" FROM (SELECT scene_id, count(*) n FROM s GROUP BY 1), range(20) a(draw)) SELECT scene_id, draw, point_id FROM d JOIN r USING (scene_id, rank)")
def _(spark, sf):
    return P.resample(samples(spark, sf), 20).select("scene_id", "draw", "point_id")


@query("W9_fraction_subsample", f"WITH {SAMPLES}, n AS (SELECT scene_id, floor(count(*) * 0.3) q FROM s WHERE mask_epi = 1 AND abs(sdf_epi) <= 0.021"
    f" GROUP BY 1), r AS (SELECT scene_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY {_H.format('fraction')}, point_id) AS rank FROM s"
    f" WHERE mask_epi = 1 AND abs(sdf_epi) <= 0.021) SELECT scene_id, point_id FROM r JOIN n USING (scene_id) WHERE rank <= q")
def _(spark, sf):
    near = P.near_surface(samples(spark, sf).filter("mask_epi = 1"), "epi", 0.021)
    return P.fraction_subsample(near, 0.3).select("scene_id", "point_id")


@query("W12_top_n", f"WITH {METRICS}, a AS (SELECT organ, version, round(avg(value), 6) AS mean FROM m"
    f" GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY organ ORDER BY mean, version) AS rank FROM a) SELECT organ, version, mean, rank FROM r WHERE rank <= 3")
def _(spark, sf):
    m = r6(X.mean_std(metrics(spark, sf), ["organ", "version"]), "mean")
    return X.top_n(m.select("organ", "version", "mean"), ["organ"], "mean", "version", 3)


@query("W12_top_overall", f"WITH {METRICS} SELECT version, round(avg(value), 6) AS mean FROM m GROUP BY 1 ORDER BY 2, 1 LIMIT 3")
def _(spark, sf):
    return X.top_overall(r6(X.mean_std(metrics(spark, sf), ["version"]), "mean").select("version", "mean"), "mean", "version", 3)


@query("W13_rank_incompatible", f"WITH {SAMPLES} SELECT scene_id, round(quantile_cont(abs(sdf_lv), 0.95), 6) AS p95, round(avg(abs(sdf_lv)), 6) AS mean FROM s GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def _(spark, sf):
    return r6(T.rank_incompatible(samples(spark, sf).withColumn("d", F.abs("sdf_lv")), ["scene_id"], "d", 20), "p95", "mean")


@query("W14_latest_version", "SELECT c_mktsegment, max(regexp_extract('version_' || c_custkey, '(\\d+)$', 1)::int) AS latest FROM customer GROUP BY 1")
def _(spark, sf):
    return X.latest_version(table(spark, sf, "customer").withColumn("v", F.concat(F.lit("version_"), "c_custkey")), "c_mktsegment", "v")


@query("W15_best_patch", "SELECT p_brand, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS best FROM part GROUP BY 1")
def _(spark, sf):
    return T.best_patch(table(spark, sf, "part"), "p_brand", "p_partkey", "p_retailprice")


@query("W16_first_last_mask", f"WITH {SAMPLES} SELECT scene_id, arg_min((mask_epi + mask_lv = 0)::int, point_id) AS first_zero, arg_max((mask_epi + mask_lv = 0)::int, point_id) AS last_zero FROM s GROUP BY 1")
def _(spark, sf):
    return P.first_last_mask(samples(spark, sf).withColumn("mask_rv", F.lit(0)))


@query("W17_cap_points", f"WITH {SAMPLES}, r AS (SELECT scene_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS pos"
    f" FROM s), d AS (SELECT DISTINCT scene_id, floor(i * (n - 1) / 14)::bigint AS pos FROM (SELECT scene_id, count(*) n FROM s"
    f" GROUP BY 1), range(15) a(i)) SELECT scene_id, point_id FROM r JOIN d USING (scene_id, pos)")
def _(spark, sf):
    return P.cap_points(samples(spark, sf), 15).select("scene_id", "point_id")


@query("W18_dedupe_ids", "SELECT o_custkey AS id, min(o_orderkey) AS line_no, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1")
def _(spark, sf):
    return T.dedupe_ids(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("priority")), "id", "line_no")


# -- sets and pivots


@query("O3_inclusion_report", "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'included' ELSE 'excluded' END AS status FROM customer")
def _(spark, sf):
    return T.inclusion_guard(X.inclusion_report(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id"))


@query("O4_concat_unlike", "SELECT c_custkey AS id, c_name AS name, NULL::double AS price FROM customer UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), allowMissingColumns=True)


@query("O5_version_set_check", "SELECT coalesce(a, b) AS version, CASE WHEN a IS NULL THEN 'test' ELSE 'train' END AS only_in FROM (SELECT DISTINCT o_custkey a"
    " FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT DISTINCT o_custkey b FROM orders WHERE o_orderstatus = 'P') ON a = b WHERE a IS NULL OR b IS NULL")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "version")
    return X.version_set_check(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"))


@query("O9_heatmap", f"WITH {METRICS} SELECT version, round(avg(value) FILTER (WHERE organ = 'A'), 6) AS A, round(avg(value) FILTER (WHERE organ = 'N'), 6) AS N, "
    f"round(avg(value) FILTER (WHERE organ = 'R'), 6) AS R FROM m GROUP BY 1")
def _(spark, sf):
    m = r6(X.mean_std(metrics(spark, sf), ["version", "organ"]), "mean")
    return X.heatmap(m, "version", "organ", ["A", "N", "R"], "mean")


# -- scalar functions


@query("F1_ids", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey::varchar WHEN 1 THEN 'YRM' || c_custkey ELSE 'S' || c_custkey END AS id,
CASE WHEN c_custkey % 2 = 0 THEN 'AF' || c_custkey || '.0' ELSE c_custkey::varchar END AS clean,
CASE WHEN c_custkey % 6 IN (0, 2, 4) THEN 'F' WHEN c_custkey % 6 IN (1, 5) THEN 'M' END AS gender,
CASE c_custkey % 3 WHEN 0 THEN 'Leuven_BBB' WHEN 1 THEN 'SickValve' ELSE 'ilearnHeart' END AS cohort FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("LEU_BBB_"), k)).when(k % 3 == 1, F.concat(F.lit("yrm"), k, F.lit("_v1"))).otherwise(F.concat(F.lit("s"), k))
    cohort = S.cohort_of(raw)
    text = F.element_at(F.array(*[F.lit(t) for t in ("1;;;", "0", "Female", "nan", " donna ", "uomo")]), (k % 6 + 1).cast("int"))
    clean = S.clean_id(F.concat(F.when(k % 2 == 0, "\t af").otherwise(" "), k, F.lit(".0 ")))
    return table(spark, sf, "customer").select("c_custkey", S.norm_id(raw, cohort).alias("id"), clean.alias("clean"), S.parse_gender(text).alias("gender"), cohort.alias("cohort"))


@query("F6_scene_of", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 4 THEN s_name END AS scene,
CASE WHEN s_suppkey % 5 = 4 THEN 'unexpected file name: d/' || s_name || '.npy' END AS error FROM supplier""")
def _(spark, sf):
    ends = ("-epi_lv_rv_5000_coords.npy", "_MRI_like_samples.npy", "_three_axis_mri_grid_samples.npy", "-part.npy", ".npy")
    name = F.concat(F.lit("d/"), "s_name", F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("s_suppkey") % 5 + 1).cast("int")))
    return table(spark, sf, "supplier").select("s_suppkey", S.scene_of(name).alias("scene"), S.scene_error(name).alias("error"))


@query("F7_parse_value", "SELECT o_orderkey, o_totalprice AS value FROM orders")
def _(spark, sf):
    price = F.col("o_totalprice").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), price, F.lit(", 1.0]"))).otherwise(price)
    return table(spark, sf, "orders").select("o_orderkey", S.parse_value(text).alias("value"))


@query("F10_combinations", """SELECT p_partkey, (p_size / 10.0)::double AS sigma, 0.75::double AS lambda, 0.5::double AS rho, p_size AS depth, 128 AS width, 16 AS latent,
CASE WHEN p_size NOT IN (3, 5, 7) THEN 'invalid depth: 5k_D' || p_size || '_W128_L16' END AS error FROM part""")
def _(spark, sf):
    a = F.concat(F.lit("S_"), (F.col("p_size") / 10).cast("string"), F.lit("-L_0.75-R_0.5"))
    b = F.concat(F.lit("5k_D"), "p_size", F.lit("_W128_L16"))
    sampling = [c.alias(n) for c, n in zip(S.sampling_combination(a), ("sigma", "lambda", "rho"))]
    network = [c.alias(n) for c, n in zip(S.network_combination(b), ("depth", "width", "latent"))]
    return table(spark, sf, "part").select("p_partkey", *sampling, *network, S.combination_error(b).alias("error"))


@query("F11_nearest_label", "SELECT p_partkey, CASE WHEN p_size <= 7 THEN 5.0 WHEN p_size <= 20 THEN 10.0 ELSE 30.0 END::double AS label FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.nearest_label(F.col("p_size") * 1.0, [5.0, 10.0, 30.0]).alias("label"))


@query("F12_rename_suffix", "SELECT s_suppkey, [s_name || '_new.npy'] AS files FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", S.rename_suffix(F.array(F.concat("s_name", F.lit("_old.npy"))), "_old", "_new").alias("files"))


@query("F14_minmax_norm", "SELECT s_suppkey, "
    "round(CASE WHEN max(s_acctbal) OVER w = min(s_acctbal) OVER w THEN 1 ELSE (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) END, "
    "6) AS v FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def _(spark, sf):
    return r6(T.minmax_norm(table(spark, sf, "supplier").withColumn("v", F.col("s_acctbal")), "v", "s_nationkey"), "v").select("s_suppkey", "v")


@query("F15_positional_encode", f"WITH {SAMPLES} SELECT scene_id, point_id, round(x, 6) AS e0, round(sin(pi() * x), 6) + 0.0 AS e1, round(cos(pi() * x), 6) + 0.0 AS e2, "
    f"round(sin(2 * pi() * x), 6) + 0.0 AS e3, round(cos(2 * pi() * x), 6) + 0.0 AS e4 FROM s")
def _(spark, sf):
    e = samples(spark, sf).select("scene_id", "point_id", S.positional_encode(F.col("x"), 2).alias("e"))
    return e.select("scene_id", "point_id", F.round(F.col("e")[0], 6).alias("e0"), *[(F.round(F.col("e")[i], 6) + 0.0).alias(f"e{i}") for i in range(1, 5)])


# -- geometry


@query("G1_face_table", f"WITH {TORUS} SELECT scene_id, fid, round(x, 6) + 0.0 AS x, round(nx, 6) + 0.0 AS nx, round(nz, 6) + 0.0 AS nz, round(area, 6) AS area FROM t")
def _(spark, sf):
    t = G.face_table(*torus(spark, sf))
    return t.select("scene_id", "fid", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "nx", "nz")], F.round("area", 6).alias("area"))


_PATCHES = TORUS + ", h AS (SELECT *, fid // 16 // 4 * 32 AS component FROM f WHERE fid // 16 % 4 < 2 AND NOT (fid // 16 = 9 AND scene_id % 2 = 0))"


def patches(spark, sf):
    """Three strips of each torus that do not touch; the last one is narrower in every second scene."""
    v, f = torus(spark, sf)
    strip = F.floor(F.col("fid") / 16)
    return v, f.filter((strip % 4 < 2) & ~((strip == 9) & (F.col("scene_id") % 2 == 0)))


@query("G3_connected_components", f"WITH {_PATCHES}, c3 AS (SELECT DISTINCT scene_id, component, unnest([v0, v1, v2]) AS vid FROM h) SELECT scene_id, component, count(*) AS n FROM c3 GROUP BY 1, 2")
def _(spark, sf):
    return G.connected_components(patches(spark, sf)[1]).groupBy("scene_id", "component").agg(F.count("*").alias("n"))


@query("G3_largest", f"WITH {_PATCHES}, n3 AS (SELECT scene_id, component, count(*) AS n FROM h"
    f" GROUP BY 1, 2), b AS (SELECT scene_id, arg_min(component, (-n, component)) AS component FROM n3 GROUP BY 1) SELECT scene_id, fid, component FROM h JOIN b USING (scene_id, component)")
def _(spark, sf):
    return G.component_faces(patches(spark, sf)[1], largest=True).select("scene_id", "fid", "component")


@query("G5_apex", f"WITH {SAMPLES}, d AS (SELECT *, (x - 0.1)*(x - 0.1) + (y - 0.2)*(y - 0.2) + (z - 0.3)*(z - 0.3) AS d2"
    f" FROM s) SELECT scene_id, arg_min(point_id, (-d2, point_id)) AS point_id, round(sqrt(max(d2)), 6) AS distance FROM d GROUP BY 1")
def _(spark, sf):
    base = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), F.lit(0.1).alias("bx"), F.lit(0.2).alias("by"), F.lit(0.3).alias("bz"))
    return G.apex(samples(spark, sf), base).select("scene_id", "point_id", F.round("distance", 6).alias("distance"))


@query("G6_plane_stack", "SELECT s_suppkey AS scene_id, k + 1 AS plane_id, round(k::double * 0.5 * 0.6, 6) AS ox, round(k::double * 0.5 * 0.8, 6) AS oy"
    " FROM supplier, range(-1, 30) a(k) WHERE k <= floor((2.1 + s_suppkey % 3) / 0.5)")
def _(spark, sf):
    n = 2.1 + F.col("s_suppkey") % 3
    marks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), *[F.lit(0.0).alias("c" + k) for k in "xyz"], (n * 0.6).alias("ax"), (n * 0.8).alias("ay"), F.lit(0.0).alias("az"))
    return r6(G.plane_stack(marks, 0.5, before=1), "ox", "oy").select("scene_id", "plane_id", "ox", "oy")


def contour_sql(level):
    """CTE of the segments where the torus meets the plane z = level."""
    ends = ", ".join(
        f"CASE WHEN (d{p} < 0) <> (d{q} < 0) THEN [" + ", ".join(f"{p}{u} + d{p} / (d{p} - d{q}) * ({q}{v} - {p}{u})" for u, v in zip(*[[{"by": "y_"}.get(e + k, k) for k in "xyz"] for e in (p, q)])) + "] END" for p, q in ("ab", "bc", "ca")
    )
    cut = f"k0 AS (SELECT *, az - {level} AS da, bz - {level} AS db, cz - {level} AS dc FROM c), k1 AS (SELECT scene_id, fid, list_filter([{ends}], lambda p: p IS NOT NULL) AS s FROM k0 WHERE least(da, db, dc) < 0 AND greatest(da, db, dc) >= 0)"
    return cut + ", k AS (SELECT scene_id, fid, " + ", ".join(f"s[{i}][{j}] AS \"{e}{c}\"" for i, e in ((1, "a"), (2, "b")) for j, c in ((1, "x"), (2, "y"), (3, "z"))) + " FROM k1)"


def level_plane(spark, sf, level):
    at = {"ox": 0.0, "oy": 0.0, "oz": level, "nx": 0.0, "ny": 0.0, "nz": 1.0}
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), F.lit(0).alias("plane_id"), *[F.lit(v).alias(k) for k, v in at.items()])


_ENDS = [p + k for p in "ab" for k in "xyz"]


@query("G10_plane_contours", f"WITH {TORUS}, {contour_sql(0.11)} SELECT scene_id, fid, " + ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in _ENDS) + " FROM k")
def _(spark, sf):
    v, f = torus(spark, sf)
    return z6(G.plane_contours(v, f, level_plane(spark, sf, 0.11)).drop("plane_id"), *_ENDS)


@query("G8_segment_distance", f"WITH {SAMPLES}, g AS (SELECT s_suppkey AS scene_id, k * 0.3 AS au, 0.1 AS av, k * 0.3 + 0.2 AS bu, 0.4 AS bv"
    f" FROM supplier, range(3) a(k)), t AS (SELECT s.scene_id, point_id, x, y, au, av, greatest(0, least(1, ((x - au) * 0.2 + (y - av) * 0.3) / 0.13)) AS t FROM s"
    f" JOIN g USING (scene_id)) SELECT scene_id, point_id, round(min(sqrt((x - au - t * 0.2)*(x - au - t * 0.2) + (y - av - t * 0.3)*(y - av - t * 0.3))), 6) AS distance FROM t GROUP BY 1, 2")
def _(spark, sf):
    k = F.col("k")
    seg = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("scene_id", (k * 0.3).alias("au"), F.lit(0.1).alias("av"), (k * 0.3 + 0.2).alias("bu"), F.lit(0.4).alias("bv"))
    pts = samples(spark, sf).select("scene_id", "point_id", F.col("x").alias("u"), F.col("y").alias("v"))
    return r6(G.segment_distance(pts, seg, "scene_id"), "distance")


def wide(spark, sf):
    """The samples spread over the torus."""
    return samples(spark, sf).select("scene_id", "point_id", (F.col("x") * 3).alias("x"), (F.col("y") * 3).alias("y"), "z")


#: CTE wn (scene_id, point_id, w): the winding numbers of the spread samples.
WINDING = "w0 AS (SELECT s.scene_id, point_id, ax - x*3 ax, ay - y*3 ay, az - z az, bx - x*3 bx, by_ - y*3 by_, bz - z bz, cx - x*3 cx, cy - y*3 cy, cz - z cz FROM s JOIN c USING (scene_id)), w1 AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) la, sqrt(bx*bx + by_*by_ + bz*bz) lb, sqrt(cx*cx + cy*cy + cz*cz) lc FROM w0), wn AS (SELECT scene_id, point_id, sum(2 * atan2(ax * (by_*cz - bz*cy) + ay * (bz*cx - bx*cz) + az * (bx*cy - by_*cx), la * lb * lc + (ax*bx + ay*by_ + az*bz) * lc + (bx*cx + by_*cy + bz*cz) * la + (cx*ax + cy*ay + cz*az) * lb)) / (4 * pi()) AS w FROM w1 GROUP BY 1, 2)"


@query("G9_inside_sign", f"WITH {SAMPLES}, {TORUS}, {WINDING} SELECT scene_id, point_id, round(w, 6) + 0.0 AS w, CASE WHEN abs(w) > 0.5 THEN -1 ELSE 1 END AS sign FROM wn")
def _(spark, sf):
    return z6(G.winding_number(wide(spark, sf), *torus(spark, sf)), "w")


@query("G24_rigid_fit", f"WITH {SAMPLES} SELECT DISTINCT scene_id, [0.6::double, -0.8, 0, 0.8, 0.6, 0, 0, 0, 1] AS rotation, [1.0::double, 0, 2] AS translation FROM s")
def _(spark, sf):
    s = samples(spark, sf)
    plain = lambda c: F.transform(c, lambda x: F.round(x, 6) + 0.0).alias(c)
    return _rigid(s).select("scene_id", plain("rotation"), plain("translation"))


def _rigid(s):
    return G.rigid_fit(s.select("scene_id", "x", "y", "z", (0.6 * F.col("x") - 0.8 * F.col("y") + 1).alias("tx"), (0.8 * F.col("x") + 0.6 * F.col("y")).alias("ty"), (F.col("z") + 2).alias("tz")))


_DRAW = f"u0 AS (SELECT scene_id, draw, {U('scene_id::varchar', 'draw::varchar', chr(39) + 'area' + chr(39))} AS u, sqrt({U('scene_id::varchar', 'draw::varchar', chr(39) + 'u' + chr(39))}) AS a, {U('scene_id::varchar', 'draw::varchar', chr(39) + 'v' + chr(39))} AS b FROM (SELECT DISTINCT scene_id FROM t), range(50) q(draw)), h AS (SELECT scene_id, fid, sum(area) OVER w / sum(area) OVER (PARTITION BY scene_id) AS high FROM t WINDOW w AS (PARTITION BY scene_id ORDER BY fid)), l AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY scene_id ORDER BY fid), 0) AS low FROM h)"


@query("G14_surface_points", f"WITH {TORUS}, {_DRAW} SELECT scene_id, draw::int AS draw, fid, round((1 - a) * ax + a * (1 - b) * bx + a * b * cx, 6) + 0.0 AS x, "
    f"round((1 - a) * ay + a * (1 - b) * by_ + a * b * cy, 6) + 0.0 AS y, round((1 - a) * az + a * (1 - b) * bz + a * b * cz, 6) + 0.0 AS z FROM u0"
    f" JOIN l USING (scene_id) JOIN c USING (scene_id, fid) WHERE u > low AND u <= high")
def _(spark, sf):
    return z6(G.surface_points(*torus(spark, sf), 50), "x", "y", "z")


# -- latent codes


@query("L1_pca2")
def _(spark, sf):
    return L.pca(table(spark, sf, "embeddings").withColumnRenamed("embedding", "code"))[0].select("vec_id", "label", "scores")


_TURNED = """two AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings), mo AS (SELECT avg(x) mx, avg(y) my, var_samp(x) a, covar_samp(x, y) b, var_samp(y) d FROM two),
ei AS (SELECT *, 0.5 * atan2(2 * b, a - d) AS turn, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS l2 FROM mo)"""


def _two_wide(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("code"))


@query("L1_pca_of_two", f"WITH {_TURNED} SELECT vec_id, round(abs((x - mx) * cos(turn) + (y - my) * sin(turn)), 6) AS first, round(abs((y - my) * cos(turn) - (x - mx) * sin(turn)), 6) AS second FROM two, ei")
def _(spark, sf):
    scores = L.pca(_two_wide(spark, sf))[0]
    return scores.select("vec_id", *[F.round(F.abs(F.col("scores")[i]), 6).alias(n) for i, n in enumerate(("first", "second"))])


@query("L2_shares_of_two", f"WITH {_TURNED} SELECT i AS component, round(CASE i WHEN 0 THEN l1 ELSE l2 END / (l1 + l2), 9) AS share, "
    f"CASE WHEN l1 / (l1 + l2) >= 0.95 THEN 1 ELSE 2 END AS effective FROM ei, range(2) r(i)")
def _(spark, sf):
    shares = L.pca(_two_wide(spark, sf))[1]
    return spark.createDataFrame([(i, round(float(s), 9), L.effective_dimension(shares)) for i, s in enumerate(shares)], "component long, share double, effective int")


@query("L3_mahalanobis")
def _(spark, sf):
    return r6(L.mahalanobis(table(spark, sf, "embeddings").withColumnRenamed("embedding", "code"), "vec_id"), "distance")


_SHORT = "s AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings)"


@query("L3_mahalanobis_of_three", f"""WITH {_SHORT}, m AS (SELECT avg(x) mx, avg(y) my, avg(z) mz, var_samp(x) + 1e-6 a, covar_samp(x, y) b, covar_samp(x, z) c, var_samp(y) + 1e-6 d, covar_samp(y, z) e, var_samp(z) + 1e-6 f FROM s),
i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
v AS (SELECT vec_id, x - mx AS x, y - my AS y, z - mz AS z, i.* EXCLUDE (mx, my, mz) FROM s, i)
SELECT vec_id, round(sqrt((x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * x * y * (c * e - b * f) + 2 * x * z * (b * e - c * d) + 2 * y * z * (b * c - a * e)) / det), 6) AS distance FROM v""")
def _(spark, sf):
    short = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("code"))
    return r6(L.mahalanobis(short, "vec_id"), "distance")


@query("A25_code_covariance", f"WITH {_SHORT}, n AS (SELECT vec_id, unnest([0, 1, 2]) AS i, unnest([x, y, z]) AS v"
    f" FROM s) SELECT a.i, b.i AS j, round(covar_samp(a.v, b.v), 9) + 0.0 AS c FROM n a JOIN n b USING (vec_id) WHERE a.i <= b.i GROUP BY 1, 2")
def _(spark, sf):
    short = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("code"))
    return L.covariance_table(short).select("i", "j", (F.round("c", 9) + 0.0).alias("c"))


@query("L4_category", "SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'AF' ELSE 'LEU_NORM' END AS category FROM embeddings")
def _(spark, sf):
    id_ = F.when(F.col("label") % 2 == 0, F.concat(F.lit("AF"), "vec_id")).otherwise(F.concat(F.lit("LEU_NORM_"), "vec_id"))
    return table(spark, sf, "embeddings").select("vec_id", F.when(id_.contains("AF"), "AF").otherwise("LEU_NORM").alias("category"))


# -- composite jobs


@query("C3_cohort_table", """WITH raw AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'yrm' || c_custkey || '_v1' ELSE 'S' || c_custkey END AS pid, c_custkey, c_nationkey FROM customer)
SELECT pid AS "Patient_ID", CASE WHEN c_custkey % 2 = 0 THEN 'SickValve' ELSE 'ilearnHeart' END AS "Cohort",
CASE WHEN c_nationkey % 4 = 0 THEN 'F' WHEN c_nationkey % 4 = 1 THEN 'M' WHEN c_nationkey % 4 = 2 THEN 'F' END AS "Gender" FROM raw""")
def _(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    c, pairs = table(spark, sf, "customer"), []
    for rest, pid, other in ((0, F.concat(F.lit("yrm"), k, F.lit("_v1")), F.concat(F.lit(" YRM"), k)), (1, F.concat(F.lit("S"), k), F.concat(F.lit("s"), k))):
        rows = c.filter(k % 2 == rest)
        text = F.when(n == 0, "1;;;").when(n == 1, "uomo").when(n == 2, "Woman").otherwise("nan")
        pairs.append((rows.select(other.alias("ERA ID "), text.alias("sex")), rows.select(pid.alias("Included Patients")), "YRM" if rest == 0 else ""))
    return K.cohort_table(pairs)


@query("C4_cohort_measures", f"WITH {TORUS}, q AS (SELECT scene_id, sum(sqrt(nx*nx + ny*ny + nz*nz) / 2) a, "
    f"abs(sum(ax * (by_*cz - bz*cy) + ay * (bz*cx - bx*cz) + az * (bx*cy - by_*cx)) / 6) v FROM n"
    f" GROUP BY 1) SELECT s_nationkey, count(*) AS n, round(avg(v * pow(1000 + scene_id % 9, 3) / 1e12), 6) AS mean_ml, round(avg(a * pow(1000 + scene_id % 9, 2) / 1e6), "
    f"6) AS mean_mm2 FROM q JOIN supplier ON s_suppkey = scene_id GROUP BY 1")
def _(spark, sf):
    m = G.measures(*torus(spark, sf)).join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), "s_nationkey"), "scene_id")
    scale = 1000 + F.col("scene_id") % 9
    return m.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.avg(F.col("volume") * F.pow(scale, F.lit(3)) / 1e12), 6).alias("mean_ml"), F.round(F.avg(F.col("area") * F.pow(scale, F.lit(2)) / 1e6), 6).alias("mean_mm2"))


@query("C7_experiment_report", f"WITH {METRICS}, a AS (SELECT version, organ, split, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n"
    f" FROM m GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY organ, split ORDER BY mean, version) AS rank"
    f" FROM a) SELECT version, organ, split, mean, std, n, rank, p_brand, p_size::varchar AS p_size FROM r LEFT JOIN part ON p_partkey = version WHERE rank <= 3")
def experiment_report(spark, sf):
    m = metrics(spark, sf).withColumn("value", S.parse_value(F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]"))))
    summary = r6(X.mean_std(m, ["version", "organ", "split"]), "mean", "std")
    best = X.top_n(summary, ["organ", "split"], "mean", "version", 3)
    return X.attach_specs(best, table(spark, sf, "part").withColumn("version", F.col("p_partkey").cast("int")), ["p_brand", "p_size"])


@query("C10_make_splits", "WITH k AS (SELECT DISTINCT s_name AS name FROM supplier"
    " WHERE s_suppkey % 5 <> 0), w AS (SELECT name, CASE WHEN " + U("name", "'split'") + " < 0.25 THEN 'test' ELSE 'train' END AS split FROM k"
    " WHERE name IN (SELECT s_name FROM supplier WHERE s_nationkey <> 3)) SELECT split, to_json(list(name ORDER BY name))::varchar AS files FROM w GROUP BY 1")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    value = F.when(F.col("s_suppkey") % 5 == 0, "# none").otherwise(F.concat(F.lit("a/"), "s_name", F.lit(".npy")))
    keys = io.split_keys(s.select(F.col("s_suppkey").alias("line_no"), value.alias("value")))
    keys = T.existing(keys, s.filter("s_nationkey <> 3").select(F.col("s_name").alias("key")), "key")
    drawn = keys.withColumn("u", S.uniform("key", F.lit("split")))
    return io.split_lists(X.assign_split(keys, drawn.filter("u >= 0.25"), drawn, "key"))


@query("C11_fold_compare", f"WITH {METRICS} SELECT organ, " + ", ".join(f"round(avg(value) FILTER (WHERE version = {i}), 6) AS f{i}_mean, "
    f"round(stddev_pop(value) FILTER (WHERE version = {i}), 6) AS f{i}_std" for i in range(1, 8)) + " FROM m GROUP BY 1")
def _(spark, sf):
    out = T.fold_compare(metrics(spark, sf).withColumn("fold", F.concat(F.lit("f"), "version")), "fold", [f"f{i}" for i in range(1, 8)], "organ", "value")
    return r6(out, *out.columns[1:])