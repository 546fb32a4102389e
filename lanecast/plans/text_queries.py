"""Registered queries over the re-aimed text inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanecast import oracle as O
from lanecast.operators import text as TX
from lanecast.registry import register
from lanecast.sources.text import extraction_view, geocoder_view

_GEO_SQL = f"""
g AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS response_id,
    CASE WHEN l_linenumber = 7 THEN substr(string_split(p_name, ' ')[1], 1, 1)
         ELSE ' ' || string_split(p_name, ' ')[1] || ' ' END AS query,
    string_split(p_name, ' ') AS words, l_orderkey, l_partkey, l_suppkey, l_discount, l_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
f AS (
  SELECT response_id, query, i AS pos,
    CASE WHEN (l_partkey + i) % 5 = 0 THEN 'Nepal' ELSE 'India' END AS country,
    CASE (l_suppkey + i) % 6 WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN upper(words[(i % len(words)) + 1])
      WHEN 4 THEN lower(words[(i % len(words)) + 1])
      WHEN 5 THEN upper(substr(words[(i % len(words)) + 1], 1, 1)) || lower(substr(words[(i % len(words)) + 1], 2, 1000))
    END AS name,
    CASE WHEN i % 2 = 0 THEN 'City' || i END AS city,
    'Town' || (l_orderkey % 3) AS town,
    CAST(NULL AS VARCHAR) AS village,
    CASE WHEN i % 4 <> 3 THEN 'STATE_' || (l_suppkey % 7) END AS state,
    CASE WHEN i % 3 <> 0 THEN l_partkey * 10 + i END AS osm_id,
    CASE WHEN i <> 9 THEN {O.d(10)} + l_discount * 100 + CAST(i AS DOUBLE) * {O.d(0.1)} END AS lat,
    CASE WHEN i <> 9 THEN {O.d(70)} + l_tax * 100 + CAST(i AS DOUBLE) * {O.d(0.1)} END AS lon
  FROM g, range(10) t(i)
),
c AS (
  SELECT *, {O.strip("coalesce(nullif(name, ''), nullif(city, ''), nullif(town, ''), nullif(village, ''))")} AS nm
  FROM f WHERE length({O.strip('query')}) >= 2
),
c1 AS (
  SELECT *, row_number() OVER (PARTITION BY response_id, lower(nm) ORDER BY pos) AS rn_name
  FROM c WHERE country = 'India' AND nm IS NOT NULL AND nm <> ''
),
c2 AS (
  SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY pos) - 1 AS rank FROM c1 WHERE rn_name = 1
),
geo AS (
  SELECT response_id, query, rank, coalesce(CAST(osm_id AS VARCHAR), lower(nm)) AS id, nm AS city,
    coalesce(state, '') AS state, lat, lon
  FROM c2 WHERE rank < 7
)"""

GEO = [("response_id", "s"), ("query", "s"), ("rank", "i"), ("id", "s"), ("city", "s"), ("state", "s"),
       ("lat", "d"), ("lon", "d")]


@register("A11_geocode_candidates", GEO, lambda s: f"WITH {_GEO_SQL} SELECT {s} FROM geo")
def q_a11(spark, sf_dir):
    """India-only geocoder candidates, first per lower-case name, at most 7 per response."""
    return TX.geocode_candidates(geocoder_view(spark, sf_dir))


@register("F3_topk_candidates", [("response_id", "s"), ("n_candidates", "i")],
          lambda s: f"WITH {_GEO_SQL}, n AS (SELECT response_id, count(*) AS n_candidates FROM geo GROUP BY 1) "
                    f"SELECT {s} FROM n")
def q_f3(spark, sf_dir):
    """number of candidates kept per response (the top-7 cut)."""
    return TX.geocode_candidates(geocoder_view(spark, sf_dir)).groupBy("response_id").agg(
        F.count(F.lit(1)).alias("n_candidates"))


EX = [("id", "s"), ("authentic_diesel", "d"), ("authentic_competitor", "d"), ("timestamp", "s"), ("source_type", "s"),
      ("confidence_level", "s"), ("notes", "s"), ("error", "s")]
_EX_SQL = """
r AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
    CASE o_orderkey % 5
      WHEN 0 THEN 'Diesel board photo unreadable (' || o_orderpriority || ')'
      WHEN 1 THEN 'Here you go: {"authentic_diesel": ' || CAST(CAST(90 AS DOUBLE) + CAST(o_orderkey % 10 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS VARCHAR)
        || ', "authentic_competitor": ' || CAST(o_totalprice / CAST(10 AS DOUBLE) AS VARCHAR) || ', "timestamp": "'
        || strftime(o_orderdate, '%Y-%m-%d') || '", "source_type": "fuel_board", "confidence_level": "High", "notes": "cash price"} thanks'
      WHEN 2 THEN '{"authentic_diesel": null, "authentic_competitor": ' || CAST(o_totalprice / CAST(10 AS DOUBLE) AS VARCHAR)
        || ', "timestamp": null, "source_type": "chat_screenshot", "confidence_level": "Low", "notes": "quote {route '
        || CAST(o_custkey AS VARCHAR) || '}"}'
      WHEN 3 THEN '{"authentic_diesel": ' || CAST(CAST(90 AS DOUBLE) + CAST(o_orderkey % 10 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS VARCHAR) || ', oops}'
      ELSE 'first {"x": 1} then {"y": 2}' END AS raw
  FROM orders
),
s AS (SELECT id, regexp_extract(trim(raw), '\\{.*\\}', 0, 's') AS span FROM r),
v AS (SELECT id, span, span <> '' AS has,
         CASE WHEN span <> '' AND json_valid(span) THEN json_type(span) = 'OBJECT' ELSE false END AS ok FROM s),
ex AS (
  SELECT id,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(span, '$.authentic_diesel') AS DOUBLE) END AS authentic_diesel,
    CASE WHEN ok THEN TRY_CAST(json_extract_string(span, '$.authentic_competitor') AS DOUBLE) END AS authentic_competitor,
    CASE WHEN ok THEN json_extract_string(span, '$.timestamp') END AS timestamp,
    CASE WHEN ok THEN json_extract_string(span, '$.source_type') END AS source_type,
    CASE WHEN NOT has THEN 'Low' WHEN ok THEN json_extract_string(span, '$.confidence_level') END AS confidence_level,
    CASE WHEN NOT has THEN 'Could not parse structured response from image.' WHEN ok THEN json_extract_string(span, '$.notes') END
      AS notes,
    CASE WHEN has AND NOT ok THEN 'invalid JSON between braces' END AS error
  FROM v
)"""


@register("A12_extract_json_fields", EX, lambda s: f"WITH {_EX_SQL} SELECT {s} FROM ex")
def q_a12(spark, sf_dir):
    """First '{' to last '}' of a free-text reply parsed to the fixed record; invalid JSON -> error."""
    return TX.extract_json_fields(extraction_view(spark, sf_dir))
