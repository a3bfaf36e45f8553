"""A made-up geography over the star-schema tables, in whole numbers, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

SALT = {"customer": 0, "supplier": 101, "part": 2003}


def wide(k: Column, salt: int) -> tuple[Column, Column]:
    return (F.lit(400000000) + ((k * 7919 + salt) % 4999) * 10000 + 5000).cast("int"), (((k * 104729 + salt * 31) % 4993) * 10000 + 5000).cast("int")


def dense(k: Column, salt: int) -> tuple[Column, Column]:
    return (F.lit(500000000) + ((k * 7919 + salt) % 499) * 1000 + 500).cast("int"), (F.lit(80000000) + ((k * 104729 + salt * 31) % 491) * 1000 + 500).cast("int")


def placed(s: SparkSession, d: str, name: str, key: str, where=wide) -> DataFrame:  # noqa: ANN001
    lat, lng = where(F.col(key), SALT[name])
    return table(s, d, name).withColumn("lat_e7", lat).withColumn("lng_e7", lng)


def _box(south: Column, west: Column, side_lat: float, side_lng: float) -> Column:
    e7 = lambda c: (c * 10_000_000).cast("int")
    p = lambda a, b: F.struct(e7(a).alias("lat_e7"), e7(b).alias("lng_e7"))
    ring = F.array(p(south, west), p(south, west + side_lng), p(south + side_lat, west + side_lng), p(south + side_lat, west))
    return F.array(F.struct(ring.alias("outer"), F.array().cast("array<array<struct<lat_e7:int,lng_e7:int>>>").alias("inners")))


def areas(s: SparkSession, d: str) -> DataFrame:
    """(area_id, name, admin_level, population, timezone, country_code, polygons)."""
    none = F.lit(None).cast("string")
    def row(df: DataFrame, i: Column, name: Column, level: int, south: Column, west: Column, h: float, w: float, tz: Column = none, cc: Column = none) -> DataFrame:
        return df.select(i.cast("long").alias("area_id"), name.alias("name"), F.lit(level).alias("admin_level"), (i * 1000).cast("long").alias("population"), tz.alias("timezone"), cc.alias("country_code"), _box(south, west, h, w).alias("polygons"))

    region, nation = table(s, d, "region"), table(s, d, "nation")
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    nlat, nlng = F.lit(40) + n % 5, F.floor(n / 5)
    quarter = nation.withColumn("q", F.explode(F.array(*map(F.lit, range(4)))))
    q = F.col("q")
    cells, zones = s.range(400), s.range(5)
    i = F.col("id")
    out = row(region, r, F.col("r_name"), 2, F.lit(40) + r, F.lit(0), 1, 5, cc=F.concat(F.lit("R"), r.cast("string")))
    out = out.unionByName(row(nation, 100 + n, F.col("n_name"), 4, nlat, nlng, 1, 1))
    out = out.unionByName(row(quarter, 1000 + 4 * n + q, F.concat("n_name", F.lit(" City "), q.cast("string")), 8, nlat + F.floor(q / 2) * 0.5, nlng + q % 2 * 0.5, 0.5, 0.5))
    out = out.unionByName(row(cells, 10000 + i, (i + 10000).cast("string"), 12, F.lit(40) + F.floor(i / 20) * 0.25, i % 20 * 0.25, 0.25, 0.25))
    return out.unionByName(row(zones, 20000 + i, F.concat(F.lit("Zone/"), i.cast("string")), 13, F.lit(40), i, 5, 1, tz=F.concat(F.lit("Zone/"), i.cast("string"))))


def segments(s: SparkSession, d: str) -> DataFrame:
    """(entity_id, line): a line of three corners through each part's dense position."""
    p = placed(s, d, "part", "p_partkey", dense)
    at = lambda a, b: F.struct((F.col("lat_e7") + a).cast("int").alias("lat_e7"), (F.col("lng_e7") + b).cast("int").alias("lng_e7"))
    return p.select(F.col("p_partkey").alias("entity_id"), F.array(at(-20000, -20000), at(0, 0), at(20000, -20000)).alias("line"))


def sql_wide(k: str, salt: int) -> str:
    return f"400000000 + (({k} * 7919 + {salt}) % 4999) * 10000 + 5000 AS lat_e7, (({k} * 104729 + {salt * 31}) % 4993) * 10000 + 5000 AS lng_e7"


def sql_dense(k: str, salt: int) -> str:
    return f"500000000 + (({k} * 7919 + {salt}) % 499) * 1000 + 500 AS lat_e7, 80000000 + (({k} * 104729 + {salt * 31}) % 491) * 1000 + 500 AS lng_e7"


SQL_AREAS = """boxes AS (
  SELECT r_regionkey::BIGINT AS area_id, r_name AS name, 2 AS admin_level, 40 + r_regionkey AS s, 0.0 AS w, 1.0 AS h, 5.0 AS l, NULL AS timezone, 'R' || r_regionkey AS country_code FROM region
  UNION ALL SELECT 100 + n_nationkey, n_name, 4, 40 + n_nationkey % 5, n_nationkey // 5, 1, 1, NULL, NULL FROM nation
  UNION ALL SELECT 1000 + 4 * n_nationkey + q, n_name || ' City ' || q, 8, 40 + n_nationkey % 5 + (q // 2) * 0.5, n_nationkey // 5 + (q % 2) * 0.5, 0.5, 0.5, NULL, NULL FROM nation, range(4) t(q)
  UNION ALL SELECT 10000 + i, (i + 10000)::VARCHAR, 12, 40 + (i // 20) * 0.25, (i % 20) * 0.25, 0.25, 0.25, NULL, NULL FROM range(400) t(i)
  UNION ALL SELECT 20000 + i, 'Zone/' || i, 13, 40, i, 5, 1, 'Zone/' || i, NULL FROM range(5) t(i)),
areas AS (SELECT *, s * 10000000 AS s7, w * 10000000 AS w7, (s + h) * 10000000 AS n7, (w + l) * 10000000 AS e7 FROM boxes)"""
