"""Stand-in text inputs shaped from the driver's tables (input shaping only).

``geocoder_view``: one geocoder response body per line item (10 features built from the
part name and keys: other countries, blank / empty / missing names, case-only duplicates,
missing ids and states, a one-number coordinate list).
``extraction_view``: one free-text reply per order (no braces, a JSON object inside
prose, nested braces inside a string, invalid JSON, two objects).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geocoder_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                             "l_discount", "l_tax")
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    # a merge join deals the line items over all tasks at every size, as one file may be one task
    df = li.join(p.hint("merge"), li.l_partkey == p.p_partkey)
    words = F.split("p_name", " ")
    w1 = words[0]

    def feature(i):
        w = F.element_at(words, (F.pmod(i, F.size(words)) + 1).cast("int"))
        sel = F.pmod(F.col("l_suppkey") + i, F.lit(6))
        name = (F.when(sel == 1, F.lit("")).when(sel == 2, F.lit("  ")).when(sel == 3, F.upper(w))
                .when(sel == 4, F.lower(w)).when(sel == 5, F.concat(F.upper(F.substring(w, 1, 1)),
                                                                    F.lower(F.substring(w, 2, 1000)))))
        di = i.cast("double")
        lon = F.lit(70.0) + F.col("l_tax") * 100 + di * F.lit(0.1)
        lat = F.lit(10.0) + F.col("l_discount") * 100 + di * F.lit(0.1)
        props = F.struct(
            F.when(F.pmod(F.col("l_partkey") + i, F.lit(5)) == 0, F.lit("Nepal")).otherwise(F.lit("India")).alias("country"),
            name.alias("name"),
            F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit("City"), i.cast("string"))).alias("city"),
            F.concat(F.lit("Town"), (F.col("l_orderkey") % 3).cast("string")).alias("town"),
            F.lit(None).cast("string").alias("village"),
            F.when(F.pmod(i, F.lit(4)) != 3, F.concat(F.lit("STATE_"), (F.col("l_suppkey") % 7).cast("string"))).alias("state"),
            F.when(F.pmod(i, F.lit(3)) != 0, F.col("l_partkey") * 10 + i).alias("osm_id"))
        coords = F.when(i == 9, F.array(F.col("l_discount"))).otherwise(F.array(lon, lat))
        return F.struct(props.alias("properties"), F.struct(coords.alias("coordinates")).alias("geometry"))

    feats = F.transform(F.sequence(F.lit(0), F.lit(9)), feature)
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("response_id"),
        F.when(F.col("l_linenumber") == 7, F.substring(w1, 1, 1)).otherwise(F.concat(F.lit(" "), w1, F.lit(" ")))
         .alias("query"),
        F.to_json(F.struct(feats.alias("features"))).alias("body"))


def extraction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey") % 5
    diesel = (F.lit(90.0) + (F.col("o_orderkey") % 10).cast("double") * F.lit(0.5)).cast("string")
    comp = (F.col("o_totalprice") / 10).cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = (F.when(k == 0, F.concat(F.lit("Diesel board photo unreadable ("), F.col("o_orderpriority"), F.lit(")")))
           .when(k == 1, F.concat(F.lit('Here you go: {"authentic_diesel": '), diesel,
                                  F.lit(', "authentic_competitor": '), comp, F.lit(', "timestamp": "'), day,
                                  F.lit('", "source_type": "fuel_board", "confidence_level": "High", '
                                        '"notes": "cash price"} thanks')))
           .when(k == 2, F.concat(F.lit('{"authentic_diesel": null, "authentic_competitor": '), comp,
                                  F.lit(', "timestamp": null, "source_type": "chat_screenshot", '
                                        '"confidence_level": "Low", "notes": "quote {route '),
                                  F.col("o_custkey").cast("string"), F.lit('}"}')))
           .when(k == 3, F.concat(F.lit('{"authentic_diesel": '), diesel, F.lit(", oops}")))
           .otherwise(F.lit('first {"x": 1} then {"y": 2}')))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), raw.alias("raw"))
