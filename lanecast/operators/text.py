"""Re-aimed text inputs: geocoder response rows (A11, F3) and free-text extraction.

Both work inside one row with higher-order array/JSON functions, so they never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanecast.functions import expr as E

MAX_CANDIDATES = 7

GEOCODER_SCHEMA = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("properties", T.StructType([T.StructField(n, T.StringType()) for n in
                                              ("country", "name", "city", "town", "village", "state")]
                                             + [T.StructField("osm_id", T.LongType())])),
    T.StructField("geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
])))])


def _non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def geocode_candidates(df: DataFrame, query: str = "query", body: str = "body", key: str = "response_id") -> DataFrame:
    """A11 + F3: India-only candidates from a geocoder JSON body, first per lower-case name, at most 7.

    name = first non-empty of name/city/town/village, then stripped (blank after the strip:
    skipped); id = osm_id, else the lower-case name; state NULL -> ''; coordinates only when
    at least two numbers are given; a query shorter than 2 characters (stripped) gives nothing.
    """
    feats = F.from_json(F.col(body), GEOCODER_SCHEMA)["features"]
    cand = F.transform(feats, lambda f, i: F.struct(
        i.alias("pos"), f["properties"]["country"].alias("country"),
        E.strip(F.coalesce(*[_non_empty(f["properties"][n]) for n in ("name", "city", "town", "village")])).alias("name"),
        F.coalesce(f["properties"]["state"], F.lit("")).alias("state"),
        f["properties"]["osm_id"].alias("osm_id"),
        f["geometry"]["coordinates"].alias("coords")))
    ok_query = F.length(E.strip(F.col(query))) >= 2
    # one column per step, so the body is parsed once per row and not once per compared pair
    staged = df.select(key, query, F.when(ok_query, cand).alias("_cand"))
    staged = staged.select(key, query, F.filter(
        "_cand", lambda c: (c["country"] == "India") & c["name"].isNotNull() & (c["name"] != "")).alias("_valid"))
    staged = staged.withColumn("_names", F.transform("_valid", lambda c: F.lower(c["name"])))
    top = F.slice(F.filter("_valid", lambda c, i: F.array_position(F.col("_names"), F.lower(c["name"])) == i + 1),
                  1, MAX_CANDIDATES)
    rows = staged.select(key, query, F.posexplode(top).alias("rank", "c"))
    has_xy = F.size(F.col("c.coords")) >= 2
    return rows.select(
        key, query, "rank",
        F.coalesce(F.col("c.osm_id").cast("string"), F.lower(F.col("c.name"))).alias("id"),
        F.col("c.name").alias("city"), F.col("c.state").alias("state"),
        F.when(has_xy, F.col("c.coords")[1]).alias("lat"), F.when(has_xy, F.col("c.coords")[0]).alias("lon"))


EXTRACTION_SCHEMA = T.StructType([
    T.StructField("authentic_diesel", T.DoubleType()), T.StructField("authentic_competitor", T.DoubleType()),
    T.StructField("timestamp", T.StringType()), T.StructField("source_type", T.StringType()),
    T.StructField("confidence_level", T.StringType()), T.StructField("notes", T.StringType()),
])
NO_BRACES_NOTE = "Could not parse structured response from image."


def extract_json_fields(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Text from the first '{' to the last '}' parsed to the fixed record.

    No braces -> all-NULL record with confidence 'Low' and a note; braces around invalid
    JSON -> ``error`` is set (the record stays NULL) instead of a default.
    """
    text = F.trim(F.col(raw))
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    has = span != ""
    # one complete JSON object and nothing after it (a parser that stops early would accept
    # '{...} more {...}'); wrapping in [...] makes the parser read up to the closing bracket
    valid = has & F.coalesce(F.json_array_length(F.concat(F.lit("["), span, F.lit("]"))) == 1, F.lit(False)) & \
        F.json_object_keys(span).isNotNull()
    rec = F.from_json(span, EXTRACTION_SCHEMA)
    out = df.withColumn("_span", span).withColumn("_rec", F.when(valid, rec))
    cols = []
    for f in EXTRACTION_SCHEMA.fields:
        v = F.col("_rec")[f.name]
        if f.name == "confidence_level":
            v = F.when(~has, F.lit("Low")).otherwise(v)
        if f.name == "notes":
            v = F.when(~has, F.lit(NO_BRACES_NOTE)).otherwise(v)
        cols.append(v.alias(f.name))
    err = F.when(has & ~valid, F.lit("invalid JSON between braces"))
    return out.select(*[c for c in df.columns], *cols, err.alias("error"))
