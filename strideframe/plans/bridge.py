"""Views of the engine's input shapes over the driver's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Inputs:
    """nodes, ways, features, manifests, events of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey AS node_id", "CAST(53.30D + (p_partkey % 40) * 0.0005D AS FLOAT) AS lat", "CAST(-6.40D + (p_partkey div 40) * 0.00075D AS FLOAT) AS lon")

    @property
    def ways(self) -> DataFrame:
        refs = self.table("lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
        tags = self.table("orders").selectExpr(
            "o_orderkey AS way_id",
            """map_filter(map('highway', CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'trunk' WHEN '3' THEN 'residential' WHEN '5' THEN 'footway' ELSE 'path' END,
              'access', CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'Private' END, 'foot', CASE WHEN o_orderkey % 17 = 0 THEN 'no' END), (k, v) -> v IS NOT NULL) AS tags""",
        )
        return tags.join(refs, "way_id", "left").select("way_id", "tags", F.coalesce(F.transform("r", lambda x: x["l_partkey"]), F.array().cast("array<bigint>")).alias("refs"))

    @property
    def features(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "element_at(array('N', 'W', 'R'), CAST(c_custkey % 3 + 1 AS INT)) AS osm_type",
            "c_custkey AS osm_id",
            "c_name AS name",
            """map_filter(map('shop', CASE WHEN c_mktsegment = 'FURNITURE' THEN 'furniture' WHEN c_custkey % 11 = 0 THEN 'no' END, 'highway', CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'bus_stop' END,
              'railway', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'signal' END, 'amenity', CASE WHEN c_mktsegment = 'BUILDING' THEN 'pharmacy' END,
              'leisure', CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'park' END), (k, v) -> v IS NOT NULL) AS tags""",
            "53.30D + (((c_custkey * 4) div 3) % 40) * 0.0005D + ((c_custkey * 7919) % 400) / 1000000D AS lat",
            "-6.40D + (((c_custkey * 4) div 3) div 40) * 0.00075D + ((c_custkey * 104729) % 600) / 1000000D AS lon",
        )

    @property
    def manifests(self) -> DataFrame:
        return self.table("orders").selectExpr("concat('b', o_orderkey) AS build_key", "concat('x', o_custkey % 10) AS extract_path", "concat('c', o_custkey % 7) AS config_hash", "CASE WHEN o_orderstatus = 'F' THEN 'building' ELSE 'complete' END AS status", "CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS completed_at", "o_orderdate AS created_at")

    @property
    def events(self) -> DataFrame:
        return self.table("events")


#: DuckDB: name -> (needs, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "nodes": ((), "SELECT p_partkey AS node_id, CAST(53.30::DOUBLE + (p_partkey % 40) * 0.0005::DOUBLE AS FLOAT) AS lat, CAST(-6.40::DOUBLE + (p_partkey // 40) * 0.00075::DOUBLE AS FLOAT) AS lon FROM part"),
    "way_refs": ((), "SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_partkey AS node_id FROM lineitem"),
    "ways": ((), """SELECT o_orderkey AS way_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'trunk' WHEN '3' THEN 'residential' WHEN '5' THEN 'footway' ELSE 'path' END AS highway,
      CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'Private' END AS access, CASE WHEN o_orderkey % 17 = 0 THEN 'no' END AS foot FROM orders"""),
    "walkable": (("ways", "way_refs"), """SELECT way_id FROM ways WHERE highway IS NOT NULL AND highway NOT IN ('construction', 'motor', 'motorway', 'motorway_link', 'planned', 'proposed', 'raceway', 'trunk', 'trunk_link')
      AND lower(coalesce(access, '')) NOT IN ('private', 'no') AND lower(coalesce(foot, '')) NOT IN ('private', 'no') AND way_id IN (SELECT way_id FROM way_refs GROUP BY way_id HAVING count(*) >= 2)"""),
    "segments": (("walkable",), """SELECT way_id, unnest([a, b]) AS src, unnest([b, a]) AS dst FROM (SELECT way_id, node_id AS a, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS b FROM way_refs WHERE way_id IN (SELECT way_id FROM walkable)) WHERE b IS NOT NULL"""),
    "measured": (("segments", "nodes"), """SELECT src, dst, CAST(12742000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS FLOAT) AS length_m FROM (
      SELECT s.src, s.dst, pow(sin(radians(b.lat::DOUBLE - a.lat::DOUBLE) / 2), 2) + cos(radians(a.lat::DOUBLE)) * cos(radians(b.lat::DOUBLE)) * pow(sin(radians(b.lon::DOUBLE - a.lon::DOUBLE) / 2), 2) AS h
      FROM segments s LEFT JOIN nodes a ON a.node_id = s.src LEFT JOIN nodes b ON b.node_id = s.dst)"""),
    "edges": (("measured",), "SELECT * FROM measured WHERE length_m > 0"),
    "features": ((), """SELECT ['N', 'W', 'R'][c_custkey % 3 + 1] AS osm_type, c_custkey AS osm_id, c_name AS name, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'furniture' WHEN c_custkey % 11 = 0 THEN 'no' END AS shop,
      CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'bus_stop' END AS highway, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'signal' END AS railway, CASE WHEN c_mktsegment = 'BUILDING' THEN 'pharmacy' END AS amenity,
      CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'park' END AS leisure, 53.30::DOUBLE + (((c_custkey * 4) // 3) % 40) * 0.0005::DOUBLE + ((c_custkey * 7919) % 400) / 1000000::DOUBLE AS lat,
      -6.40::DOUBLE + (((c_custkey * 4) // 3) // 40) * 0.00075::DOUBLE + ((c_custkey * 104729) % 600) / 1000000::DOUBLE AS lon FROM customer"""),
    "classified": (("features",), """SELECT osm_type, osm_id, lat, lon, CASE WHEN shop IS NOT NULL THEN 'shops' WHEN highway = 'bus_stop' THEN 'transport' WHEN railway IN ('station', 'tram_stop', 'halt') THEN 'transport'
      WHEN amenity IN ('pharmacy', 'hospital', 'clinic', 'doctors', 'dentist', 'health_centre') THEN 'healthcare' WHEN leisure IN ('park', 'playground', 'nature_reserve', 'garden') THEN 'parks' END AS category FROM features"""),
    "amenities": (("classified",), "SELECT * FROM classified WHERE category IS NOT NULL"),
    "manifests": ((), """SELECT 'b' || o_orderkey AS build_key, 'x' || (o_custkey % 10) AS extract_path, 'c' || (o_custkey % 7) AS config_hash, CASE WHEN o_orderstatus = 'F' THEN 'building' ELSE 'complete' END AS status,
      CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS completed_at, o_orderdate AS created_at FROM orders"""),
}


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"12742000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h}))"


def nearest_sql(points: str, keys: str) -> str:
    """The nearest node of each point (lat, lon): rows of ``keys``, node_id and distance_m."""
    d = haversine_sql("p.lat::DOUBLE", "p.lon::DOUBLE", "n.lat::DOUBLE", "n.lon::DOUBLE")
    return f"SELECT {keys}, m.node_id, m.d AS distance_m FROM (SELECT {keys}, min({{'d': round({d}, 6), 'node_id': n.node_id}}) AS m FROM {points} p, nodes n GROUP BY {keys})"


VIEWS["snapped"] = (("amenities", "nodes"), nearest_sql("amenities", "osm_type, osm_id, category"))
VIEWS["weights"] = (("snapped",), "SELECT node_id, category, count(*) AS n FROM snapped GROUP BY ALL")
VIEWS["hops"] = (("edges",), "SELECT src, dst, min(length_m::DOUBLE) AS hop FROM edges WHERE length_m <= 500 GROUP BY ALL")


def sql(body: str, *needs: str, **more: str) -> str:
    """``body`` under the views it needs; ``more`` are views of its own, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in order] + [f"{name} {text if text.startswith('USING') else f'AS ({text})'}" for name, text in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


#: From the rows (origin) of a view ``origins``: nodes within 500 m.
REACHED = """USING KEY (origin, node_id) AS (
  SELECT origin, origin AS node_id, 0.0::DOUBLE AS d FROM origins
  UNION SELECT r.origin, h.dst, min(r.d + h.hop) FROM reached r JOIN hops h ON h.src = r.node_id LEFT JOIN recurring.reached k ON k.origin = r.origin AND k.node_id = h.dst
  WHERE r.d + h.hop <= 500 AND (k.d IS NULL OR r.d + h.hop < k.d) GROUP BY r.origin, h.dst)"""
COUNTS = "SELECT r.origin, w.category, sum(w.n)::BIGINT AS n FROM reached r JOIN weights w USING (node_id) GROUP BY ALL"
