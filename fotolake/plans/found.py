"""Queries p2, p3 and p5 over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fotolake.operators.places import near_and_inside
from fotolake.operators.sessions import sessionize
from fotolake.operators.timeline import field_values, resolve_instants
from fotolake.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present media rows within 50 m of each other, and the regions around them."""
    media = table(spark, sf_dir, "media").where("not missing")
    return near_and_inside(media, table(spark, sf_dir, "geo_regions"), radius_m=50.0)


def p2_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same between spots: rows at the very same coordinates are one spot, named by its smallest id, and listed as `same`."""
    media = table(spark, sf_dir, "media").where("not missing")
    return near_and_inside(media, table(spark, sf_dir, "geo_regions"), radius_m=50.0, expand=False)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamp texts that mean exactly one instant under the stated conventions."""
    chosen = resolve_instants(field_values(table(spark, sf_dir, "file_meta")))
    return chosen.where("n_instants = 1").selectExpr("ord AS meta_id", "field_name", "utc_us")


def p3_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with the reading that best fits its device's record order, no date order taken for granted."""
    chosen = resolve_instants(field_values(table(spark, sf_dir, "file_meta")), conventions=frozenset())
    return chosen.selectExpr("ord AS meta_id", "field_name", "utc_us", "format_name", "n_instants")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shooting sessions of two or more shots per camera."""
    media = table(spark, sf_dir, "media").where("not missing")
    s = sessionize(media, table(spark, sf_dir, "dup_config"))
    return s.where("n_shots >= 2").select("camera", "start_s", "end_s", "n_shots")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_spots": p2_spots, "p3_found": p3_found, "p3_resolved": p3_resolved, "p5_found": p5_found}

_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"

# Latitude bands of 0.0005 degrees (over 50 m) meet their neighbours; longitude is left to the exact distance.
_NEAR_AND_INSIDE = f"""band AS (SELECT *, CAST(floor(lat / 0.0005) AS BIGINT) AS k FROM p),
     other AS (SELECT id, lat, lon, k + d AS k FROM band, (VALUES (-1), (0), (1)) v(d)),
     near AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM band a JOIN other b ON a.k = b.k AND a.id < b.id WHERE {_HAV} <= 50),
     side AS (SELECT region_id, ring_lat[i] AS lat1, ring_lon[i] AS lon1, ring_lat[CASE WHEN i = len(ring_lat) THEN 1 ELSE i + 1 END] AS lat2,
                     ring_lon[CASE WHEN i = len(ring_lat) THEN 1 ELSE i + 1 END] AS lon2
              FROM (SELECT *, unnest(range(1, len(ring_lat) + 1)) AS i FROM geo_regions)),
     span AS (SELECT *, (lon2 - lon1) - 360 * floor((lon2 - lon1 + 180) / 360) AS w FROM side),
     hit AS (SELECT p.id, s.region_id, (p.lon - s.lon1) - 360 * floor((p.lon - s.lon1 + 180) / 360) AS t, s.w, s.lat1, s.lat2, p.lat FROM p, span s WHERE s.w <> 0),
     inside AS (SELECT id, region_id FROM hit
                WHERE ((w > 0 AND t >= 0 AND t < w) OR (w < 0 AND t < 0 AND t >= w)) AND lat1 + (lat2 - lat1) * (t / w) > lat
                GROUP BY ALL HAVING count(*) % 2 = 1)"""

ORACLE: dict[str, str] = {
    "p2_found": f"""
WITH p AS (SELECT DISTINCT id, lat, lon FROM media WHERE NOT missing AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)),
     {_NEAR_AND_INSIDE}
SELECT 'near' AS relation, id_a, id_b FROM near UNION ALL SELECT 'inside', id, region_id FROM inside
""",
    "p2_spots": f"""
WITH q AS (SELECT DISTINCT id, lat, lon FROM media WHERE NOT missing AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)),
     p AS (SELECT min(id) AS id, lat, lon FROM q GROUP BY lat, lon),
     {_NEAR_AND_INSIDE}
SELECT 'near' AS relation, id_a, id_b FROM near UNION ALL SELECT 'inside', id, region_id FROM inside UNION ALL SELECT 'same', p.id, q.id FROM p JOIN q USING (lat, lon) WHERE p.id <> q.id
""",
    # Zones shift by half an hour or an hour, so a wall time's other instants lie that far from the one found.
    "p3_found": r"""
WITH v AS (UNPIVOT (SELECT DISTINCT meta_id, tz_name, date_taken, date_created, mtime FROM file_meta) ON date_taken, date_created, mtime INTO NAME field_name VALUE raw),
     t AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS x FROM v),
     n AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9]{10}(\.[0-9]+)?') THEN CAST(x[1:10] AS BIGINT) * 1000000 + CAST(rpad(x[12:17], 6, '0') AS BIGINT)
                          WHEN regexp_full_match(x, '[0-9]{13}') THEN CAST(x AS BIGINT) * 1000 WHEN regexp_full_match(x, '[0-9]{16}') THEN CAST(x AS BIGINT) END AS num,
                  regexp_extract(x, '\s*(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})(\[[^\]]*\])?$', 1) AS mark, regexp_replace(x, '\s*(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})(\[[^\]]*\])?$', '') AS rest FROM t),
     p AS (SELECT *, try_strptime(regexp_replace(regexp_replace(rest, '(:[0-9]{2})\.[0-9]+', '\1'), '^[A-Z][a-z]{2}, ', ''),
                       ['%Y:%m:%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y%m%dT%H%M%S', '%d.%m.%Y %H:%M:%S', '%Y/%m/%d %H:%M', '%m/%d/%Y %I:%M %p', '%d %b %Y %H:%M', '%d %b %Y %H:%M:%S', '%b %d, %Y %I:%M:%S %p'])
                     + to_microseconds(CAST(rpad(regexp_extract(rest, ':[0-9]{2}\.([0-9]{1,6})', 1), 6, '0') AS BIGINT)) AS wall,
                  CASE WHEN mark <> '' THEN mark ELSE trim(tz_name) END AS zone FROM n),
     z AS (SELECT *, CASE WHEN zone IN ('Z', 'UTC', 'GMT') THEN 0 WHEN regexp_full_match(zone, '[+-][0-9]{2}:?[0-9]{2}')
                          THEN (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (CAST(zone[2:3] AS BIGINT) * 3600 + CAST(zone[-2:] AS BIGINT) * 60) END AS off FROM p),
     c AS (SELECT meta_id, field_name, num AS us FROM z WHERE num IS NOT NULL
           UNION SELECT meta_id, field_name, epoch_us(wall) - off * 1000000 FROM z WHERE wall IS NOT NULL AND off IS NOT NULL AND num IS NULL
           UNION SELECT meta_id, field_name, epoch_us(wall AT TIME ZONE zone) + CAST(d AS BIGINT) * 1800000000 FROM z, (VALUES (-2), (-1), (0), (1), (2)) s(d)
                 WHERE wall IS NOT NULL AND off IS NULL AND zone <> '' AND num IS NULL AND ((wall AT TIME ZONE zone) + to_microseconds(CAST(d AS BIGINT) * 1800000000)) AT TIME ZONE zone = wall)
SELECT meta_id, field_name, CAST(min(us) AS BIGINT) AS utc_us FROM c GROUP BY ALL HAVING count(DISTINCT us) = 1
""",
    "p5_found": """
WITH rule AS (SELECT nullif(lower(trim(camera_model)), '') AS camera, arg_min(burst_window_secs, profile) AS w FROM dup_config WHERE burst_window_secs IS NOT NULL GROUP BY 1),
     e AS (SELECT DISTINCT lower(trim(camera_model)) AS camera, id, date_taken AS t FROM media WHERE NOT missing AND trim(camera_model) <> '' AND date_taken > 0),
     g AS (SELECT e.*, coalesce(r.w, (SELECT w FROM rule WHERE camera IS NULL)) AS w, lag(t) OVER (PARTITION BY e.camera ORDER BY t, id) AS prev FROM e LEFT JOIN rule r ON r.camera = e.camera),
     s AS (SELECT *, sum(CASE WHEN t - prev <= w THEN 0 ELSE 1 END) OVER (PARTITION BY camera ORDER BY t, id) AS k FROM g)
SELECT camera, CAST(min(t) AS BIGINT) AS start_s, CAST(max(t) AS BIGINT) AS end_s, CAST(count(*) AS BIGINT) AS n_shots FROM s GROUP BY camera, k HAVING count(*) >= 2
""",
}
