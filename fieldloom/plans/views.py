"""The tables that stand in for samples, metrics, specs, cohorts, surfaces and codes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark, sf):
    """The points of every supplier. They are dealt by scene once, before their grouping: what follows within a scene needs no further shuffle, and a scan's task holds no rows.

    The number of parts is given, so that small ones are not merged: a task's memory is its share of the rows."""
    keys, values = ["l_suppkey", "l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_returnflag"]
    t = table(spark, sf, "lineitem").select(*keys, *values).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_suppkey")
    t = t.groupBy(*keys).agg(*[F.min(c).alias(c) for c in values])  # a few keys occur twice: the least value of each column stays
    flag = F.col("l_returnflag")
    surface = F.when(flag == "A", "epi").when(flag == "N", "lv").otherwise("rv")
    return t.select(
        F.col("l_suppkey").alias("scene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"),
        ((F.col("l_quantity") - 25) / 25).alias("x"), ((F.col("l_extendedprice") - 52500) / 52500).alias("y"), ((F.col("l_tax") - 0.04) / 0.04).alias("z"),
        (F.col("l_discount") - 0.05).alias("sdf_epi"), (F.col("l_tax") - 0.04).alias("sdf_lv"), ((F.col("l_quantity") - 25) / 250).alias("sdf_rv"),
        surface.alias("source_surface"), *[(surface == s).cast("int").alias(f"mask_{s}") for s in ("epi", "lv", "rv")],
    )


SAMPLES = """li AS (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_quantity) l_quantity, min(l_extendedprice) l_extendedprice, min(l_tax) l_tax, min(l_discount) l_discount, min(l_returnflag) l_returnflag FROM lineitem GROUP BY ALL),
s AS (SELECT l_suppkey AS scene_id, l_orderkey * 10 + l_linenumber AS point_id, (l_quantity - 25) / 25 AS x, (l_extendedprice - 52500) / 52500 AS y, (l_tax - 0.04) / 0.04 AS z,
  l_discount - 0.05 AS sdf_epi, l_tax - 0.04 AS sdf_lv, (l_quantity - 25) / 250 AS sdf_rv, CASE l_returnflag WHEN 'A' THEN 'epi' WHEN 'N' THEN 'lv' ELSE 'rv' END AS source_surface,
  (l_returnflag = 'A')::int AS mask_epi, (l_returnflag = 'N')::int AS mask_lv, (l_returnflag NOT IN ('A', 'N'))::int AS mask_rv FROM li)"""


def metrics(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select(F.col("l_linenumber").alias("version"), F.col("l_suppkey").alias("patient"), F.col("l_returnflag").alias("organ"), F.col("l_linestatus").alias("split"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("other"))


METRICS = "m AS (SELECT l_linenumber AS version, l_suppkey AS patient, l_returnflag AS organ, l_linestatus AS split, l_extendedprice AS value, l_quantity AS other FROM lineitem)"


def torus(spark, sf, nu=12, nv=8):
    """A closed surface for every supplier: (vertices, faces). Suppliers are few bytes in one task of a scan, so they are dealt out before each gets its 288 rows."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id")).repartition(4 * spark.sparkContext.defaultParallelism, "scene_id").withColumn("r", 0.5 + F.col("scene_id") % 7 * 0.1)
    a, b = F.col("i") * (2 * math.pi / nu), F.col("j") * (2 * math.pi / nv)
    grid = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nu - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    ring = 2 + F.col("r") * F.cos(b)
    v = grid.select("scene_id", (F.col("i") * nv + F.col("j")).alias("vid"), (ring * F.cos(a)).alias("x"), (ring * F.sin(a)).alias("y"), (F.col("r") * F.sin(b)).alias("z"))
    at = lambda di, dj: (F.col("i") + di) % nu * nv + (F.col("j") + dj) % nv
    tri = F.array(F.struct(at(0, 0).alias("v0"), at(1, 0).alias("v1"), at(1, 1).alias("v2"), F.lit(0).alias("t")), F.struct(at(0, 0).alias("v0"), at(1, 1).alias("v1"), at(0, 1).alias("v2"), F.lit(1).alias("t")))
    f = grid.select("scene_id", "i", "j", F.explode(tri).alias("f")).select("scene_id", ((F.col("i") * nv + F.col("j")) * 2 + F.col("f.t")).alias("fid"), "f.v0", "f.v1", "f.v2")
    return v, f


TORUS = """g AS (SELECT s_suppkey AS scene_id, 0.5 + s_suppkey % 7 * 0.1 AS r, i, j FROM supplier, range(12) a(i), range(8) b(j)),
v AS (SELECT scene_id, i * 8 + j AS vid, (2 + r * cos(j * (2 * pi() / 8))) * cos(i * (2 * pi() / 12)) AS x, (2 + r * cos(j * (2 * pi() / 8))) * sin(i * (2 * pi() / 12)) AS y, r * sin(j * (2 * pi() / 8)) AS z FROM g),
f AS (SELECT scene_id, (i * 8 + j) * 2 AS fid, i * 8 + j AS v0, (i + 1) % 12 * 8 + j AS v1, (i + 1) % 12 * 8 + (j + 1) % 8 AS v2 FROM g
  UNION ALL SELECT scene_id, (i * 8 + j) * 2 + 1, i * 8 + j, (i + 1) % 12 * 8 + (j + 1) % 8, i * 8 + (j + 1) % 8 FROM g),
c AS (SELECT f.scene_id, fid, a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz FROM f JOIN v a ON a.scene_id = f.scene_id AND a.vid = v0 JOIN v b ON b.scene_id = f.scene_id AND b.vid = v1 JOIN v c ON c.scene_id = f.scene_id AND c.vid = v2),
n AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM c),
t AS (SELECT scene_id, fid, (ax + bx + cx) / 3 AS x, (ay + by_ + cy) / 3 AS y, (az + bz + cz) / 3 AS z, nx / sqrt(nx*nx+ny*ny+nz*nz) AS nx, ny / sqrt(nx*nx+ny*ny+nz*nz) AS ny, nz / sqrt(nx*nx+ny*ny+nz*nz) AS nz, sqrt(nx*nx+ny*ny+nz*nz) / 2 AS area FROM n)"""
