import json
import os

import pytest
from pyspark.sql import functions as F

from lanecast.operators import scaling as S
from lanecast.plans import quote as Q
from lanecast.sources import requests as RQ
from lanecast.sources import trips as TR


def test_scan_csv_trim_and_coerce(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "trips")
    os.makedirs(path)
    with open(os.path.join(path, "part.csv"), "w") as fh:
        fh.write(" BookingID ,vehicle_no,Origin_Location,Destination_Location,TRANSPORTATION_DISTANCE_IN_KM,"
                 "trip_start_date,trip_end_date,Planned_ETA,actual_eta,Market/Regular\n")
        fh.write("B1,V1,\"A, N, India\",\"B, S, India\",12.5,2024-01-02 03:04:05,2024-01-02T08:00,2024-01-02,"
                 "not a date,Regular\n")
    df = TR.coerce_timestamps(TR.scan_trips(spark, path))
    r = df.first()
    assert df.columns[0] == "BookingID"
    assert str(r.trip_start_date) == "2024-01-02 03:04:05"
    assert str(r.trip_end_date) == "2024-01-02 08:00:00"
    assert str(r.Planned_ETA) == "2024-01-02 00:00:00"
    assert r.actual_eta is None
    assert dict(df.dtypes)["trip_start_date"] == "timestamp_ntz"


def _csv(folder, name, *lines):
    path = os.path.join(folder, name)
    os.makedirs(path)
    with open(os.path.join(path, "part.csv"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return path


def test_csv_columns_are_found_by_name(spark, tmpdir_path):
    p = _csv(tmpdir_path, "shuffled", "extra, trip_start_date,TRANSPORTATION_DISTANCE_IN_KM , BookingID,vehicle_no,"
             "trip_end_date,Destination_Location,Origin_Location",
             'X,2024-01-02,NaN,B1,V1,2024-01-03,"B, S, India","A, N, India"',
             "Y,2024-01-02,abc,B2,V1,2024-01-03,D,O", "Z,2024-01-02,12.5,B3,V1,2024-01-03,D,O")
    df = TR.scan_trips(spark, p)
    assert df.columns == ["BookingID", "vehicle_no", "Origin_Location", "Destination_Location",
                          "TRANSPORTATION_DISTANCE_IN_KM", "trip_start_date", "trip_end_date", "extra"]
    rows = sorted((r.BookingID, r.TRANSPORTATION_DISTANCE_IN_KM, r.Origin_Location, r.extra) for r in df.collect())
    assert rows == [("B1", None, "A, N, India", "X"), ("B2", None, "O", "Y"), ("B3", 12.5, "O", "Z")]
    short = _csv(tmpdir_path, "short", "BookingID,vehicle_no", "B1,V1")
    with pytest.raises(ValueError, match="Origin_Location"):
        TR.scan_trips(spark, short)


def test_date_layouts_by_option(spark):
    df = spark.createDataFrame([("8/17/2020 14:59", "17-08-2020 14:59"), ("2020-08-17 14:59:00", "17/8/2020"),
                                ("13/1/2020", "x"), ("3/29/2020 2:30", "29-03-2020 02:30:07")], "a string, b string")
    us = [str(r[0]) for r in df.select(TR.parse_timestamp("a", TR.MONTH_FIRST)).collect()]
    eu = [str(r[0]) for r in df.select(TR.parse_timestamp("b", TR.DAY_FIRST)).collect()]
    assert us == ["2020-08-17 14:59:00", "2020-08-17 14:59:00", "None", "2020-03-29 02:30:00"]
    assert eu == ["2020-08-17 14:59:00", "2020-08-17 00:00:00", "None", "2020-03-29 02:30:07"]
    assert df.select(TR.parse_timestamp("a")).first()[0] is None


def test_one_nan_distance_does_not_spoil_the_build(spark):
    from lanecast.plans.features import build_features
    from tests.conftest import SF_SMALL
    trips = TR.load_trips(spark, SF_SMALL).limit(400)
    one = F.when(F.col("BookingID") == trips.agg(F.min("BookingID")).first()[0], F.lit(float("nan")))
    spoilt = trips.withColumn("TRANSPORTATION_DISTANCE_IN_KM", F.coalesce(one, "TRANSPORTATION_DISTANCE_IN_KM"))
    frame = build_features(spoilt).frame
    assert frame.where("isnan(dist_norm) OR isnan(efficiency_score)").count() == 0
    assert frame.select("dist_norm").distinct().count() > 10


def test_feature_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([("B1", 1.5, "High")], "BookingID string, x double, efficiency_label string")
    for fmt in ("parquet", "csv"):
        p = os.path.join(tmpdir_path, f"f_{fmt}")
        TR.write_features(df, p, ["BookingID", "x"], fmt)
        back = TR.read_features(spark, p, fmt).collect()
        assert [(r.BookingID, float(r.x)) for r in back] == [("B1", 1.5)]


def test_scaler_roundtrip(spark, tmpdir_path):
    state = {"a": (0.0, 2.0), "b": (1.0, 1.0)}
    p = os.path.join(tmpdir_path, "scaler")
    S.save_scaler(spark, state, p)
    assert S.load_scaler(spark, p) == state
    df = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    out = S.minmax_apply(df, state, ["a", "b"], ["sa", "sb"]).first()
    assert (out.sa, out.sb) == (0.5, 0.0)     # zero range divides by 1


def test_scan_requests_keeps_corrupt_lines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "req")
    os.makedirs(p)
    with open(os.path.join(p, "r.json"), "w") as fh:
        fh.write(json.dumps({"request_id": "1", "origin": "Delhi", "destination": "Pune", "trip_date": "2026-01-01",
                             "weight_tonnes": 3, "addons": ["extra_rope"]}) + "\n")
        fh.write("{not json\n")
    rows = RQ.scan_requests(spark, p).collect()
    assert rows[0].weight_tonnes == 3.0 and rows[0].addons == ["extra_rope"]
    assert rows[1]._corrupt_record == "{not json"


def test_write_quote_documents(spark, tmpdir_path):
    from tests.test_pricing import GOLDEN, SCHEMA
    from lanecast.operators import pricing as P
    df = P.add_temporal(spark.createDataFrame(GOLDEN, SCHEMA))
    df = df.withColumn("origin", F.lit("Delhi")).withColumn("destination", F.lit("Mumbai")) \
        .withColumn("diesel_source", F.lit("default"))
    doc = Q.quote_document(Q.price(df))
    p = os.path.join(tmpdir_path, "quotes")
    RQ.write_quotes(doc, p)
    back = {r.request_id: r for r in spark.read.json(p).collect()}
    assert back["G1"].final_price == 76619
    assert back["G4"].pricing.feasibility.note.startswith("Price raised to survival floor Rs 91,756")
    assert back["G3"].addons.breakdown.extra_rope.amount == 150


def test_quote_documents_are_compressed_json_lines(spark, tmpdir_path):
    """The documents repeat their field names: on disk they take a fraction of their text, and every line comes back."""
    p = os.path.join(tmpdir_path, "quotes")
    rows = spark.range(2000).select(F.col("id").cast("string").alias("request_id"), F.struct(
        F.lit("Trip covers driver survival earnings.").alias("note"), F.rand(1).alias("p_min")).alias("pricing"))
    text = rows.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    RQ.write_quotes(rows, p)
    size = sum(os.path.getsize(os.path.join(p, f)) for f in os.listdir(p) if f.startswith("part-"))
    assert size < text / 3
    assert spark.read.schema(rows.schema).json(p).exceptAll(rows).count() == 0
    assert sorted(r.value for r in spark.read.text(p).collect()) == sorted(
        r[0] for r in rows.select(F.to_json(F.struct("*"))).collect())
