"""J11: pairs whose distance is the radius but for rounding count alike in the query and in its SQL."""

import duckdb
from pyspark.sql import functions as F

from fieldloom.operators.spatial import radius_sum
from fieldloom.plans.queries import QUERIES, SQL


def test_pairs_at_the_radius(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT 1::bigint l_suppkey, (q * 2 + r)::bigint l_orderkey, 1::int l_linenumber, q::double l_quantity, 30000.5::double l_extendedprice, 0.03::double l_tax, "
        "0.01::double l_discount, CASE r WHEN 0 THEN 'A' ELSE 'N' END l_returnflag, 'O' l_linestatus FROM range(1, 51) a(q), range(2) b(r)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    want = con.execute(SQL["J11_radius_sum"]).fetchall()
    got = QUERIES["J11_radius_sum"](spark, str(tmp_path)).select("scene_id", "point_id", "n", "mass").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_pair_is_lost_between_cells(spark):
    x = [k / 25 for k in range(-24, 26)]
    p = spark.createDataFrame([(1, i, v, 0.0, 0.0) for i, v in enumerate(x)], "scene_id int, point_id bigint, x double, y double, z double")
    got = {r.point_id: r.n for r in radius_sum(p, p.withColumn("mass", F.lit(1.0)), 0.2).collect()}
    assert got == {i: sum((v - u) ** 2 <= 0.2 * 0.2 for u in x) for i, v in enumerate(x)}
