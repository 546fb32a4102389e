import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    batch = sorted(q["J18_quote_requests"](spark, SF_SMALL).collect())
    stream = sorted(q["L1_quote_stream"](spark, SF_SMALL).collect())
    assert batch == stream and len(batch) > 0


def test_broken_lines_and_invalid_requests_are_rejected(spark):
    """Every line of the request files ends as a quote or a rejected row."""
    from lanecast.plans import quote_queries as QQ
    from lanecast.sources.requests import requests_view, stream_requests
    from lanecast.streaming.quotes import read_quotes, read_rejected, scratch_dir, start_quote_stream
    source, sink = scratch_dir(spark, "requests"), scratch_dir(spark, "sink")
    lines = QQ.request_documents(requests_view(spark, SF_SMALL))
    lines.union(spark.createDataFrame([("[1, 2]",), ("no json",), ('{"weight_tonnes": "heavy"}',)], "value string")) \
        .repartition(3).write.text(source)
    start_quote_stream(stream_requests(spark, source, QQ.SCORES, files=1), QQ._index(spark, SF_SMALL), None, sink,
                       f"{sink}/_checkpoint").awaitTermination()
    quotes, rejected = read_quotes(spark, sink), read_rejected(spark, sink)
    total, n = lines.count() + 3, requests_view(spark, SF_SMALL).count()
    assert quotes.count() + rejected.count() == total
    broken = rejected.where("error LIKE 'Malformed%'")
    assert broken.count() == total - n and broken.where("_corrupt_record IS NULL").count() == 0
    assert rejected.where("error LIKE 'Validation%'").count() > 0
    assert len(spark.read.text(f"{sink}/commits").collect()) == 3


def test_commits_hide_half_an_epoch(spark, tmpdir_path, monkeypatch):
    """Readers see an epoch once both parts are committed; a replay after the commit changes nothing."""
    from lanecast.streaming import quotes as S
    log = S.CommitLog(spark, f"{tmpdir_path}/sink")
    one = lambda v: spark.range(3).withColumn("v", F.lit(v))
    S.write_epoch(log, 0, {"quotes": one("a"), "rejected": one("b")})
    commit = S.CommitLog.commit
    monkeypatch.setattr(S.CommitLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver gone")))
    with pytest.raises(RuntimeError):
        S.write_epoch(log, 1, {"quotes": one("half"), "rejected": one("half")})
    assert {r.v for r in S.read_quotes(spark, log.sink).collect()} == {"a"}
    monkeypatch.setattr(S.CommitLog, "commit", commit)
    S.write_epoch(log, 1, {"quotes": one("c"), "rejected": one("d")})
    S.write_epoch(log, 1, {"quotes": one("again"), "rejected": one("again")})
    assert sorted(r.v for r in S.read_quotes(spark, log.sink).collect()) == ["a"] * 3 + ["c"] * 3
    assert sorted(r.v for r in S.read_rejected(spark, log.sink).collect()) == ["b"] * 3 + ["d"] * 3


def test_batches_read_the_stored_index_only(spark):
    """One index per knowledge base; the plan of a micro-batch scans its tables and never the knowledge base."""
    from lanecast.operators import lanes as L
    from lanecast.operators.lane_index import stored_index
    from lanecast.plans import quote_queries as QQ
    from lanecast.sources.requests import requests_view
    kb, g = QQ._kb(spark, SF_SMALL)
    index = QQ._index(spark, SF_SMALL)
    assert stored_index(kb.repartition(5), g).path == index.path
    assert stored_index(kb.limit(3), g).path != index.path
    plan = L.lookup_lane(requests_view(spark, SF_SMALL), index)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "ok#" in plan


def test_lists_of_common_grams_are_split(spark, monkeypatch):
    """100,000 lanes share their grams: a name still meets a bounded number of them."""
    from lanecast.operators import lane_index as X
    ctx = [F.lit(0.5).alias(c) for c in X.LANE_CTX]
    code = F.lpad(F.col("id").cast("string"), 5, "0")
    kb = spark.range(100_000).select(F.concat(F.lit("hub"), code).alias("ok"), F.lit("port").alias("dk"), *ctx)
    index = X.stored_index(kb, kb.limit(1))
    pairs = spark.createDataFrame([("hub04217", "port"), ("b0421", "po"), ("1234", "port"), ("hub9", "port"), ("hubx", "port"),
                                   ("0000000", "port"), ("", "port")], "ok string, dk string")
    seen = {r.ok: r.n for r in X.candidates(pairs, index).groupBy("ok").agg(F.count("*").alias("n")).collect()}
    assert seen["hub04217"] <= X.LIST_MAX and seen["b0421"] <= X.LIST_MAX and seen["1234"] <= X.LIST_MAX
    assert seen["hub9"] == 10_000 and "hubx" not in seen          # all of them match
    first = {r.ok: tuple(r._first) for r in X.contains_matches(pairs, index).collect()}
    assert first == {"hub04217": ("hub04217", "port"), "b0421": ("hub04210", "port"), "1234": ("hub01234", "port"),
                     "hub9": ("hub90000", "port")}


def test_batches_leave_nothing_persisted(spark, tmpdir_path):
    from lanecast.sources.requests import REQUEST_SCHEMA
    from lanecast.streaming.quotes import read_quotes, start_quote_stream
    from tests.test_requests import KB_SCHEMA, _global, base
    kb = spark.createDataFrame([("asia", "europe", 0.5, 0.1, 0.2, 10, 100.0)], KB_SCHEMA)
    source, sink = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    assert read_quotes(spark, sink).count() == 0
    before, counts = held(), []
    for i in range(5):
        row = base(request_id=str(i), origin=["asi", "Delhi", "x1", "asia", "zz"][i], destination="europe")
        spark.createDataFrame([row], REQUEST_SCHEMA).selectExpr("*", "0.1 p_delay", "0.5 eff").write.mode(
            "append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        start_quote_stream(stream, kb, _global(spark), sink, f"{sink}/_checkpoint").awaitTermination()
        counts.append(held())
    assert counts == [before] * 5
    assert sorted(r.request_id for r in read_quotes(spark, sink).collect()) == list("01234")


def test_every_label_occurs(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    values = lambda key, col: {r[0] for r in q[key](spark, "/root/testdata/sf0.01").select(col).distinct().collect()}
    assert values("J1_distance_cascade", "distance_method") == {"osrm", "haversine", "historical_avg", "default_fallback"}
    assert values("J11_layer5_gate", "is_feasible") == {True, False}
    assert values("J12_trip_status", "status") == {"Healthy", "Low Margin"}     # Infeasible cannot occur (see J11)
    assert values("J6_decision_confidence", "confidence_label") == {"Elite", "High", "Moderate", "Low"}
    assert values("C3_lane_global_fallback", "lane_match") == {"exact", "contains", "global"}
    notes = values("H11_survival_note", "note")
    assert len(notes) > 5
    errors = " ".join(e for e in values("B4_validate_requests", "error") if e)
    for part in ("origin: String should have at least 2", "origin: String should have at most 120", "trip_date: Field required",
                 "trip_date must be in YYYY-MM-DD", "weight_tonnes: Input should be greater than 0", "less than or equal to 50",
                 "competitor_price: Input should be greater", "diesel_price: Input should be less", "origin_lat"):
        assert part in errors, part
