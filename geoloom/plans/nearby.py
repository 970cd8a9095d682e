"""Queries of the proximity operators, over sites and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.proximity import near_points, places_of, point_pairs, points_inside, usable_points
from geoloom.sources.tables import table

RADIUS = 0.005


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_points(table(spark, sf_dir, "sites"), "site_id", F.col("centroid.lat"), F.col("centroid.lon"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sites near each other, and sites with the zones that contain them."""
    sites = places_of(_sites(spark, sf_dir))
    near = point_pairs(near_points(sites, RADIUS)).withColumn("kind", F.lit("near"))
    inside = points_inside(sites, table(spark, sf_dir, "zones"), "zone_id", "geoshape")
    return near.unionByName(inside.withColumn("kind", F.lit("inside"))).select("kind", "a_id", "b_id")


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable site with its place and the number of other places nearby."""
    near = near_points(_sites(spark, sf_dir), RADIUS)
    ends = near.links.select(F.explode(F.array("a", "b")).alias("place"))
    counts = ends.groupBy("place").agg(F.count(F.lit(1)).alias("n_near"))
    return near.members.join(counts, "place", "left").select(
        F.col("id").alias("site_id"), "place", F.coalesce("n_near", F.lit(0)).alias("n_near")
    )


_SITES = """
WITH s AS (
  SELECT site_id, min(centroid.lat) AS lat, min(centroid.lon) AS lon FROM sites
  WHERE site_id IS NOT NULL AND centroid.lat BETWEEN -90 AND 90 AND centroid.lon BETWEEN -180 AND 180
    AND NOT (centroid.lat = 0 AND centroid.lon = 0)
  GROUP BY site_id
)"""

_LINKS = """, p AS (SELECT lat, lon, min(site_id) AS place FROM s GROUP BY lat, lon),
l AS (
  SELECT a.place AS a, b.place AS b FROM p a JOIN p b
    ON a.place <> b.place AND b.lat BETWEEN a.lat - 0.006 AND a.lat + 0.006
   AND sqrt((a.lat - b.lat) ** 2 + least(abs(a.lon - b.lon), 360 - abs(a.lon - b.lon)) ** 2) <= 0.005
), n AS (SELECT a AS place, count(*) AS n_near FROM l GROUP BY a)
"""

#: Zones are read ring by ring, from WKT or from GeoJSON.
_FOUND = r""", w AS (SELECT site_id, lat, lon, floor(lat / 0.005) AS lat_row FROM s),
o AS (SELECT *, unnest([lat_row - 1, lat_row, lat_row + 1]) AS near_row FROM w),
rings AS (
  SELECT zone_id, unnest(regexp_extract_all(CASE WHEN left(trim(geoshape), 1) = '{'
    THEN replace(regexp_replace(regexp_replace(geoshape, '\]\s*,\s*\[', '];[', 'g'), '\s+', '', 'g'), ']];[[', ']]#[[') ELSE geoshape END,
    CASE WHEN left(trim(geoshape), 1) = '{' THEN '\[\[[^\[\]]+\](?:;\[[^\[\]]+\])*\]' ELSE '\([^()]+\)' END)) AS ring
  FROM zones WHERE geoshape IS NOT NULL
), numbers AS (
  SELECT zone_id, list_transform(regexp_extract_all(ring, '-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?'), lambda x: x::DOUBLE) AS v FROM rings
), edges AS (
  SELECT zone_id, v[2 * i - 1] AS xa, v[2 * i] AS ya, v[2 * i + 1] AS xb, v[2 * i + 2] AS yb
  FROM (SELECT zone_id, v, unnest(range(1, len(v) // 2)) AS i FROM numbers)
)
SELECT 'near' AS kind, least(a.site_id, b.site_id) AS a_id, greatest(a.site_id, b.site_id) AS b_id
FROM o a JOIN w b ON a.near_row = b.lat_row AND a.site_id < b.site_id
 AND sqrt((a.lat - b.lat) ** 2 + least(abs(a.lon - b.lon), 360 - abs(a.lon - b.lon)) ** 2) <= 0.005
UNION ALL
SELECT 'inside', site_id, zone_id FROM s JOIN edges ON (ya > lat) <> (yb > lat) AND lon < xa + (lat - ya) * ((xb - xa) / (yb - ya))
GROUP BY site_id, zone_id HAVING count(*) % 2 = 1"""

QUERIES = {"p5_found": p5_found, "p5_links": p5_links}

ORACLE_SQL = {
    "p5_found": _SITES + _FOUND,
    "p5_links": _SITES
    + _LINKS
    + """SELECT s.site_id, p.place, coalesce(n.n_near, 0) AS n_near
FROM s JOIN p USING (lat, lon) LEFT JOIN n ON n.place = p.place""",
}
