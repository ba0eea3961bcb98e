"""Queries of the general training-data problem: points near points and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milap.operators.slabs import near_pairs, points_inside
from milap.session import table

#: Coordinates outside this box are taken for mistakes: latitudes, then longitudes.
BOX = ((26.0, 31.0), (79.5, 89.0))


def p1_found(spark: SparkSession, sf_dir: str, radius_km: float = 0.05) -> DataFrame:
    """kind ``near``: places at most 50 m apart; kind ``inside``: places in a locality's disc."""
    places = table(spark, sf_dir, "places").select("row_id", "place_id", "latitude", "longitude")
    placed = places.where(F.col("latitude").between(*BOX[0]) & F.col("longitude").between(*BOX[1]))
    near = near_pairs(placed, radius_km, id_col="row_id", lat_col="latitude", lng_col="longitude", apart_col="place_id")
    discs = table(spark, sf_dir, "localities").select("locality_id", F.col("centroid.lat").alias("lat"), F.col("centroid.lng").alias("lng"), "max_radius_km")
    inside = points_inside(placed, discs, id_col="row_id", lat_col="latitude", lng_col="longitude", region_col="locality_id", centre_lat="lat", centre_lng="lng", radius_col="max_radius_km")
    return near.select(F.lit("near").alias("kind"), "left_id", "right_id").unionByName(inside.select(F.lit("inside").alias("kind"), F.col("point_id").alias("left_id"), F.col("region_id").alias("right_id")))


P1_SQL = """
WITH p AS (SELECT row_id, place_id, latitude AS lat, longitude AS lng FROM places
           WHERE latitude BETWEEN 26 AND 31 AND longitude BETWEEN 79.5 AND 89),
cells AS (SELECT *, floor(lat / 0.001) AS cy, floor(lng / 0.001) AS cx FROM p),
spread AS (SELECT c.*, c.cy + dy AS ny, c.cx + dx AS nx FROM cells c, (VALUES (-1), (0), (1)) AS a(dy), (VALUES (-1), (0), (1)) AS b(dx)),
near AS (SELECT 'near' AS kind, a.row_id AS left_id, b.row_id AS right_id
         FROM spread a JOIN cells b ON a.ny = b.cy AND a.nx = b.cx AND a.row_id < b.row_id AND a.place_id <> b.place_id
         WHERE 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
             + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 0.05),
inside AS (SELECT 'inside' AS kind, a.row_id AS left_id, l.locality_id AS right_id
           FROM p a JOIN localities l ON l.centroid.lat IS NOT NULL AND abs(l.centroid.lat - a.lat) <= l.max_radius_km / 100
           WHERE 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(l.centroid.lat - a.lat) / 2), 2)
             + cos(radians(a.lat)) * cos(radians(l.centroid.lat)) * pow(sin(radians(l.centroid.lng - a.lng) / 2), 2)))) <= l.max_radius_km)
SELECT * FROM near UNION ALL SELECT * FROM inside
"""

QUERIES = {"p1_found": p1_found}
ORACLE = {"p1_found": P1_SQL}
