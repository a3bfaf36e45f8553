"""Map extracts in XML, read by Spark's own reader with stated schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAGS = "tag array<struct<_k:string,_v:string>>"
_SCHEMAS = {
    "node": f"_id long, _lat double, _lon double, {_TAGS}",
    "way": f"_id long, nd array<struct<_ref:long>>, {_TAGS}",
    "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {_TAGS}",
}


def _tags() -> Column:
    pairs = F.transform(F.filter("tag", lambda t: t["_k"].isNotNull()), lambda t: F.struct(t["_k"], F.coalesce(t["_v"], F.lit(""))))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>")).alias("tags")


def _rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(_SCHEMAS[tag]).load(path)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat_e7, lng_e7, tags)."""
    e7 = lambda c: F.round(F.col(c) * 1e7).cast("int")
    return _rows(spark, path, "node").select(F.col("_id").alias("id"), e7("_lat").alias("lat_e7"), e7("_lon").alias("lng_e7"), _tags())


def ways(spark: SparkSession, path: str) -> DataFrame:
    """(id, nodes, tags)."""
    refs = F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<bigint>"))
    return _rows(spark, path, "way").select(F.col("_id").alias("id"), refs.alias("nodes"), _tags())


def relations(spark: SparkSession, path: str) -> DataFrame:
    """(id, members, tags)."""
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return _rows(spark, path, "relation").select(F.col("_id").alias("id"), members.alias("members"), _tags())
