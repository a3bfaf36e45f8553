"""Command line: python -m wayfold.jobs extract|suggest|reverse|stats|verify ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Geocoder
from .sources import osm_xml
from .sources.osm_pbf import PbfSource


def _features(spark: SparkSession, path: str) -> tuple:
    if not path.endswith(".pbf"):
        return osm_xml.nodes(spark, path), osm_xml.ways(spark, path), osm_xml.relations(spark, path)
    spark.dataSource.register(PbfSource)
    return tuple(spark.read.format("osm_pbf").option("kind", k).load(path) for k in ("node", "way", "relation"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="wayfold")
    p.add_argument("job", choices=("extract", "suggest", "reverse", "stats", "verify"))
    p.add_argument("-i", "--input", required=True, help="map extract, or database folder")
    p.add_argument("-o", "--output", help="folder to write to")
    p.add_argument("-g", "--guess", nargs="*", default=[], help="query text, or latitude and longitude in turn")
    p.add_argument("-f", "--file", help="text file of queries, one a line")
    p.add_argument("-n", type=int, default=10)
    p.add_argument("-r", "--runs", type=int, default=1)
    p.add_argument("-l", "--languages", nargs="*", default=["default"])
    p.add_argument("--lat", type=float)
    p.add_argument("--lng", type=float)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("wayfold").getOrCreate()
    if a.job == "extract":
        Geocoder.build(*_features(spark, a.input)).write(a.output)
        return
    g = Geocoder.open(spark, a.input)
    if a.job in ("stats", "verify"):
        out = g.stats() if a.job == "stats" else g.verify()
    elif a.job == "suggest":
        asked = spark.read.text(a.file).withColumnRenamed("value", "text") if a.file else spark.createDataFrame([(" ".join(a.guess),)], "text string")
        asked = asked.withColumn("query_id", F.monotonically_increasing_id()).withColumn("lat", F.lit(a.lat)).withColumn("lng", F.lit(a.lng)).withColumn("bias", F.lit(1.0 if a.lat is not None else None))
        out = g.suggest(asked, a.n, languages=tuple(a.languages)).select("query_id", "rank", "description", "score").orderBy("query_id", "rank")
    else:
        v = [float(x) for x in a.guess]
        out = g.reverse(spark.createDataFrame([(i, *p) for i, p in enumerate(zip(v[::2], v[1::2], strict=True))], "point_id long, lat double, lng double"), a.n).orderBy("point_id", "rank")
    for _ in range(a.runs):
        began = time.time()
        if a.output:
            out.write.mode("overwrite").parquet(a.output)
        else:
            out.show(1000, truncate=False)
        print(f"{(time.time() - began) * 1000:.0f} ms")


if __name__ == "__main__":
    main()
