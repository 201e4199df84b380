"""Ingest from files with the traps that the published ones carry, and streams with late rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing
from tidemark.operators import estimates, overview
from tidemark.sources import ingest, reports
from tidemark.streaming import jobs

FACILITIES = "﻿FacilityName,FacilityShortName,FacilityId,FacilityType,OperatingState,OperatingStateDate,OperatorId\nPipe One,P1,530110,PIPE,ACTIVE,01-02-2020,7\nOld Store,OS,530200.0,STOR,INACTIVE,,x\n,none,530300,PIPE,ACTIVE,,\nNo Id,,abc,PIPE,ACTIVE,,\n\"Quoted, name\",,5,PIPE,,2020/02/01,\n"
FLOWS = "GasDate,FacilityId,LocationId,Demand,Supply,TransferIn,TransferOut,HeldInStorage,State,LastUpdated\n2026/08/06,530110,540030,10.5,,,,,SA ,2026/08/07 04:00:00\n2026/08/06,530110,540032,,3,x,,14474.3,,07 Aug 2026 04:00:00\nsometime,530110,1,1,1,1,1,,,\n"


def read(spark, tmp_path, text, required=frozenset()):
    (tmp_path / "file.csv").write_text(text, encoding="utf-8")
    return ingest.read_text_csv(spark, f"file://{tmp_path}/file.csv", required)


def test_reference_tables(spark, tmp_path):
    good, bad = reports.parse_reference(read(spark, tmp_path, FACILITIES, {"FacilityId"}), "facilities")
    rows = {r["facility_id"]: r for r in good.collect()}
    assert set(rows) == {530110, 530200, 5} and rows[5]["name"] == "Quoted, name" and rows[5]["short_name"] == ""
    assert rows[530110]["operating_state_date"] == datetime.date(2020, 2, 1) == rows[5]["operating_state_date"] and rows[530200]["operator_id"] is None
    report = ingest.import_summary(good, bad).first()
    assert (report["parsed"], report["skipped"]) == (3, 2) and report["issues"] == ["line 4: no name", "line 5: no facility_id"]
    with pytest.raises(ValueError, match="facilitytype"):
        read(spark, tmp_path, "FacilityName,FacilityId\na,1\n", {"FacilityType"})
    with pytest.raises(ValueError, match="facilityname"):
        reports.parse_reference(spark.createDataFrame([(2, "1")], "line int, facilityid string"), "facilities")


def test_points_ratings_and_zones(spark):
    points = spark.createDataFrame([(2, "1", "9", "-1"), (3, "2", "9", "7.0"), (4, "", "9", "1")], "line int, connectionpointid string, facilityid string, locationid string")
    assert [r["location_id"] for r in reports.parse_reference(points, "connection_points")[0].orderBy("line").collect()] == [None, 7]
    ratings = spark.createDataFrame([(2, "530110", "MDQ", "100", "01 Jan 2024 00:00:00"), (3, "530110", "", "100", "01 Jan 2024"), (4, "530110", "MDQ", "-1", "2024-01-01")], "line int, facilityid string, capacitytype string, capacityquantity string, effectivedate string")
    good, bad = reports.parse_reference(ratings, "nameplate")
    assert [(r["capacity_tj"], r["effective_date"]) for r in good.orderBy("line").collect()] == [(100.0, datetime.date(2024, 1, 1)), (-1.0, datetime.date(2024, 1, 1))] and bad.count() == 1
    zones = spark.createDataFrame([(2, " Z1 ", "op"), (3, "", "op"), (4, "Z1", "op")], "line int, linepackzone string, operator string")
    assert [r["code"] for r in reports.parse_reference(zones, "linepack_zones")[0].collect()] == ["Z1", "Z1"]


def test_daily_series(spark, tmp_path):
    good, bad = reports.parse_flows(read(spark, tmp_path, FLOWS))
    rows = {r["location_id"]: r for r in good.collect()}
    assert (rows[540030]["demand_tj"], rows[540030]["supply_tj"], rows[540030]["held_in_storage_tj"], rows[540030]["state"]) == (10.5, 0.0, None, "SA")
    assert (rows[540032]["transfer_in_tj"], rows[540032]["held_in_storage_tj"], rows[540032]["source_last_updated"]) == (0.0, 14474.3, datetime.datetime(2026, 8, 7, 4)) and bad.count() == 1
    flags = spark.createDataFrame([(2, "2026/08/06 15:15", "1", " green "), (3, "2026/08/06", "1", "")], "line int, gasdate string, facilityid string, flag string")
    assert [(r["gas_date"], r["flag"]) for r in reports.parse_adequacy(flags)[0].collect()] == [(datetime.date(2026, 8, 6), "GREEN")]
    lost = spark.createDataFrame([(2, "2026/08/06", "1", "-1"), (3, "2026/08/06", "2", "")], "line int, gasdate string, facilityid string, connectionpointid string")
    assert [r["connection_point_id"] for r in reports.parse_missing(lost)[0].collect()] == [-1, -1]


def test_scalars(spark):
    texts = [None, "", " $1,234.5 ", "12.9", "-7", "nan", "abc", "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(parsing.safe_float(F.col("t")), parsing.safe_float(F.col("t"), 0, 100), parsing.safe_int(F.col("t"))).collect()
    assert [r[0] for r in rows] == [None, None, 1234.5, 12.9, -7.0, None, None, 1000.0] and [r[1] for r in rows] == [None, None, 100.0, 12.9, 0.0, None, None, 100.0] and [r[2] for r in rows] == [None, None, 1234, 12, -7, None, None, 1000]
    times = spark.createDataFrame([("28/07/2025 17:55",), ("25/06/2026 10:10 AM",), ("junk",)], "t string").select(parsing.multi_format_timestamp(F.col("t"), parsing.UPLOAD_FORMATS).cast("string")).collect()
    assert [r[0] for r in times] == ["2025-07-28 17:55:00", "2026-06-25 10:10:00", None]


def test_tagged_records(spark, tmp_path):
    text = "C,HEADER,x\nI,DISPATCH,UNIT_SOLUTION,1,SETTLEMENTDATE,DUID,INTERVENTION,INITIALMW,TOTALCLEARED\nD,DISPATCH,UNIT_SOLUTION,1,\"2026/07/01 00:05:00\",A,0,1.5\nD,DISPATCH,PRICE,1,x\nD,DISPATCH,UNIT_SOLUTION,1,2026/07/01 00:05:00,A,1,99,99\nI,DISPATCH,UNIT_SOLUTION,2,DUID,SETTLEMENTDATE,INTERVENTION,TOTALCLEARED\r\nD,DISPATCH,UNIT_SOLUTION,2,A,2026/07/01 00:05:00,0,7\nD,DISPATCH,UNIT_SOLUTION,2,B,2026/07/01 00:10:00,0,8,extra\n"
    (tmp_path / "one.csv").write_text(text)
    rows = reports.read_record_tagged(reports.read_lines(spark, f"file://{tmp_path}/*.csv"), "DISPATCH", "UNIT_SOLUTION")
    fields = {r["line"]: r["fields"] for r in rows.collect()}
    assert set(fields) == {3, 5, 7, 8} and fields[3] == {"SETTLEMENTDATE": "2026/07/01 00:05:00", "DUID": "A", "INTERVENTION": "0", "INITIALMW": "1.5", "TOTALCLEARED": ""} and fields[8]["TOTALCLEARED"] == "8"
    got = {(r["id"], r["ts"]): r for r in reports.dispatch_records(rows).collect()}
    a = got[("A", datetime.datetime(2026, 7, 1, 0, 5))]
    assert len(got) == 2 and (a["dispatch_target_mw"], a["initial_mw"], a["fcas_enablement_mw"]["raise_6s"]) == (7.0, None, 0.0)
    assert reports.dispatch_records(rows, ["B"]).count() == 1 and reports.read_record_tagged(reports.read_lines(spark, f"file://{tmp_path}/*.csv"), "DISPATCH", "NONE").count() == 0


def test_prices_and_readings(spark):
    rows = spark.createDataFrame([("f", 1, {"REGIONID": "R", "SETTLEMENTDATE": "2026/07/01 00:05:00", "INTERVENTION": "0", "RRP": "50", "LOWERREGRRP": "3"}), ("f", 2, {"REGIONID": "R", "SETTLEMENTDATE": "2026/07/01 00:05:00", "INTERVENTION": "1", "RRP": "51"})], "file string, line int, fields map<string,string>")
    (row,) = reports.price_records(rows).collect()
    assert (row["rrp"], row["fcas_prices"]["lower_reg"], row["fcas_prices"]["raise_1s"]) == (50.0, 3.0, 0.0)
    read = spark.createDataFrame([("f", 1, {"DUID": "A", "SETTLEMENTDATE": "2026/07/01 00:05:00", "SCADAVALUE": "-"}), ("f", 2, {"DUID": "A", "SETTLEMENTDATE": "bad", "SCADAVALUE": "1"})], rows.schema)
    assert [r["scada_mw"] for r in reports.scada_records(read).collect()] == [None]


def test_accounts_from_text(spark):
    columns = "line int, account_id string, account_name string, segment string, industry string, csm_owner string, customer_since string, contract_start string, renewal_date string, auto_renew string, avg_monthly_revenue_6mo string, total_revenue_36mo string"
    rows = [(2, "a", "A", "SMB", "Healthcare", "o", "2020-01-01", "2020-01-01", "2027-01-01", "yes", "$1,000", "1"), (3, "a", "A2", "Odd", "Odd", "o", "2020-01-01", "2020-01-01", "2027-01-01", "0", "2", "1"), (4, "b", "B", "SMB", "x", "o", "2020/01/01", "2020-01-01", "2027-01-01", "yes", "2", "1"), (5, "", "C", "SMB", "x", "o", "2020-01-01", "2020-01-01", "2027-01-01", "yes", "2", "1"), (6, "d", "D", "SMB", "x", "o", "2020-01-01", "2020-01-01", "2027-01-01", "yes", "", "1")]
    good, bad = reports.parse_snapshot(spark.createDataFrame(rows, columns))
    assert [(r["account_name"], r["segment"], r["industry"], r["current_arr"], r["auto_renew"]) for r in good.collect()] == [("A2", "Mid-Market", "Other", 24.0, False)]
    assert {r["line"]: r["reject_reason"] for r in bad.collect()} == {4: "no customer_since", 5: "no account_id", 6: "no current_arr"}
    with pytest.raises(ValueError, match="current_arr"):
        reports.parse_snapshot(spark.createDataFrame(rows, columns).drop("total_revenue_36mo"))
    months = spark.createDataFrame([(2, "a", "2024-02", "10", None, "150"), (3, "z", "2024-02", "1", None, None), (4, "a", "2024-2x", "1", None, None), (5, "a", "2024-03", "", "2", None)], "line int, account_id string, month string, arr string, mrr string, seat_utilisation_pct string")
    kept, wrong, orphans = reports.parse_timeline(months, good)
    assert sorted((r["month"], r["arr"], r["seat_utilisation_pct"]) for r in kept.collect()) == [(datetime.date(2024, 2, 1), 10.0, 100.0), (datetime.date(2024, 3, 1), 24.0, None)] and wrong.count() == 1 and orphans.count() == 1


def test_service_documents(spark):
    hourly = json.dumps({"hourly": {"time": ["2026-08-01T00:00", "2026-08-01T01:00"], "temperature_2m": [10.5, None]}})
    got = ingest.flatten_hourly_json(spark.createDataFrame([("r", hourly), ("s", "broken"), ("t", None)], "region string, payload string"), "payload", ["region"]).collect()
    assert [(r["region"], r["time"], r["temperature_c"]) for r in got] == [("r", datetime.datetime(2026, 8, 1), 10.5)]
    places = json.dumps([{"page": 1}, [{"id": "AAA", "name": "A", "region": {"id": "X", "value": "Xland"}}, {"id": "EUU", "name": "Union", "region": {"id": "NA", "value": "Aggregates"}}]])
    values = json.dumps([{"page": 1, "x": "[,]"}, [{"countryiso3code": "AAA", "date": "2020", "value": 1.5, "indicator": {"id": "i"}}, {"countryiso3code": "AAA", "date": "2021", "value": None, "indicator": {"id": "i"}}, {"countryiso3code": "EUU", "date": "2020", "value": 2, "indicator": {"id": "i"}}]])
    one = lambda x: spark.createDataFrame([(x,), ("[]",), (None,)], "payload string")
    place, rows = ingest.flatten_indicator_json(one(places), one(values))
    assert [tuple(r) for r in place.collect()] == [("AAA", "A", "Xland")] and [tuple(r) for r in rows.collect()] == [("AAA", "i", 2020, 1.5)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "region string, v int")
    ingest.write_csv_exports({"prices": df, "scores": df}, f"file://{tmp_path}/out")
    assert sorted(map(tuple, spark.read.csv(f"file://{tmp_path}/out/scores", header=True, inferSchema=True).select("region", "v").collect())) == [("a", 1), ("b", 2)]


def test_estimates_by_hand(spark):
    countries = spark.createDataFrame([(c, "r", k) for k, c in enumerate("abcdefg")], "country string, region string, place int")
    values = spark.createDataFrame([(c, "i", float(10 * k)) for k, c in enumerate("abcdef", 1)], "country string, indicator string, raw double")
    sizes = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0), ("e", None), ("f", 50.0), ("g", 3.5)], "country string, per_head double")
    history = spark.createDataFrame([("g", "i", 2005, 4.0), ("c", "i", 2005, 20.0), ("d", "i", 2005, 60.0)], "country string, indicator string, year int, value double")
    (row,) = estimates.estimate_missing(values, countries, history, sizes, ["i"]).collect()
    assert (row["country"], row["basis"], row["projected"], row["baseline_year"]) == ("g", ["e", "c", "d", "b", "a"], True, 2005)
    assert abs(row["raw"] - 4.0 * 30.0 / 40.0) < 1e-12
    assert estimates.estimate_missing(values.where("raw < 25"), countries.where("country IN ('a', 'b', 'g')"), history, sizes, ["i"]).count() == 0


def test_whole_cohort(spark):
    df = spark.createDataFrame([("CHN",), ("IND",)], "country string")
    assert estimates.whole_cohort(df, "country", 2, ("CHN",)) is df
    with pytest.raises(ValueError, match="3 are required"):
        estimates.whole_cohort(df, "country", 3)
    with pytest.raises(ValueError, match="lacks USA"):
        estimates.whole_cohort(df, "country", 2, ("USA",))


def test_tiles(spark):
    day = datetime.date(2026, 8, 9)
    series = spark.createDataFrame([(day, 5.0), (day - datetime.timedelta(days=7), 4.0), (datetime.date(2025, 8, 5), 3.0), (datetime.date(2024, 8, 5), 5.0), (datetime.date(2023, 12, 5), 9.0)], "day date, value double")
    got = {r["tile"]: r for r in overview.headline_tiles({"one": series, "none": series.where("value > 8")}, F.lit(day)).collect()}
    assert set(got) == {"one"} and (got["one"]["change"], got["one"]["change_pct"], got["one"]["direction"], got["one"]["percentile"]) == (1.0, 25.0, "up", 75.0)
    held = spark.createDataFrame([("a", day, 1.0), ("b", day, 2.0), ("a", datetime.date(2025, 8, 9), 7.0), ("a", datetime.date(2024, 8, 9), 1.0), ("b", datetime.date(2024, 8, 9), 1.0), ("c", datetime.date(2024, 8, 9), 50.0)], "facility string, day date, v double")
    assert sorted(map(tuple, overview.steady_storage(held, "facility", "day", "v", F.lit(day)).collect())) == [(datetime.date(2024, 8, 9), 2.0), (day, 3.0)]


# Streams


def drained(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def batches(spark, tmp_path, schema, *parts):
    """A file source with one file per micro-batch, in this order."""
    import os
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (file,) = [f for f in os.listdir(f"{tmp_path}/part{k}") if f.endswith(".parquet")]
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/part{k}/{file}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (time.time() - 1000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_stream_rollup_takes_late_ticks_and_drops_too_late_ones(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2026, 8, 1, h, m)
    ticks = batches(spark, tmp_path, "region string, ts timestamp, rrp double", [("r", at(0, 5), 10.0), ("r", at(0, 31), 100.0)], [("r", at(0, 30), 20.0)], [("r", at(2, 0), 1.0)], [("r", at(2, 5), 3.0)], [("r", at(0, 10), 999.0)], [("r", at(5, 0), 1.0)])
    drained(jobs.stream_half_hour_rollup(ticks, ["region"], "ts", ["rrp"]), "rollup")
    # Spark drops what is later than the watermark that the batch before this one began with
    got = {r["interval_end"]: r["rrp"] for r in spark.table("rollup").collect()}
    assert got == {at(0, 30): 15.0, at(1, 0): 100.0, at(2, 0): 1.0, at(2, 30): 3.0}


def test_stream_newest_revision(spark, tmp_path):
    from tidemark.operators import merging

    schema = "k int, at int, v string, day int"
    path, staging = f"file://{tmp_path}/table", f"file://{tmp_path}/staging"
    merging.write_days(spark.createDataFrame([(1, 5, "stored", 1), (9, 1, "other day", 2)], schema), path, "day")
    sink = jobs.newest_revision_sink(path, staging, ["k", "day"], "at", "day")
    stream = batches(spark, tmp_path, schema, [(1, 4, "stale", 1), (2, 1, "new", 1)], [(1, 9, "newer", 1), (1, 8, "older in the batch", 1)], [(2, 0, "late", 1)])
    stream.writeStream.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination(120)
    held = lambda: sorted(tuple(r) for r in merging.read_table(spark, path, spark.createDataFrame([], schema).schema).collect())
    want = [(1, 9, "newer", 1), (2, 1, "new", 1), (9, 1, "other day", 2)]
    assert held() == want
    sink(spark.createDataFrame([(1, 9, "newer", 1)], schema), 7)
    assert held() == want


def test_stream_interval_value(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 8, 1, 0, m)
    dispatch = batches(spark, tmp_path / "d", "unit string, region string, ts timestamp, mw double", [("u", "r", at(5), 120.0)], [("u", "r", at(10), -60.0)])
    prices = batches(spark, tmp_path / "p", "region string, ts timestamp, rrp double", [("r", at(10), -100.0)], [("r", at(5), 100.0)])
    drained(jobs.stream_interval_value(dispatch, prices, "region", "ts", "mw", "rrp"), "valued")
    assert {(r["ts"], r["energy_value"]) for r in spark.table("valued").collect()} == {(at(5), 1000.0), (at(10), 500.0)}


def test_typed_csv(spark, tmp_path):
    (tmp_path / "typed.csv").write_text("﻿Region,RRP,Extra\nR, 1.5 ,x\nS,oops,y\n", encoding="utf-8")
    casts = {"region": lambda c: F.trim(c), "rrp": parsing.safe_float, "periodtype": lambda c: c}
    got = ingest.read_typed_csv(spark, f"file://{tmp_path}/typed.csv", casts, {"region", "rrp"})
    assert got.columns == ["region", "rrp", "periodtype"] and sorted(map(tuple, got.collect())) == [("R", 1.5, None), ("S", None, None)]
    good, bad = ingest.split_valid_rejects(got, {"no price": F.col("rrp").isNotNull()})
    assert [r["region"] for r in good.collect()] == ["R"] and [tuple(r) for r in ingest.import_report(bad).collect()] == [("no price", 1)]
    with pytest.raises(ValueError, match="totaldemand"):
        ingest.read_typed_csv(spark, f"file://{tmp_path}/typed.csv", casts, {"totaldemand"})


def test_rollup_of_a_bad_row_and_market_without_demand(spark):
    from tidemark.operators import price

    rows = [("a", datetime.datetime(2026, 8, 1, 0, 30), None, 5.0), ("b", datetime.datetime(2026, 8, 1, 0, 30), 7.0, 0.0), ("ALL", datetime.datetime(2026, 8, 1, 0, 30), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "region string, ts timestamp_ntz, rrp double, demand double")
    assert price.market_aggregate(df, "region", "ts", "rrp", "demand").count() == 0
    assert price.demand_shares(df.where("false"), "region", "demand").count() == 0


def test_report_days_are_read_once_and_by_shape(spark):
    texts = ["2020/02/01 10:30:00", "2020/02/01 10:30", "2020/02/01", "01 Feb 2020 10:30:11", "01 FEB 2020", "01-02-2020", "2020-02-01", "+12020/02/01", "-0001/02/01", "2020/2/1", "2020/02/30", "soon", "", None, "2020/02/01  10:30", "01/02/2020 10:30 PM", "01/02/2020 10:30pm"]
    df = spark.createDataFrame([(i, t, "1", "2", "", "") for i, t in enumerate(texts)], "line long, gasdate string, facilityid string, locationid string, demand string, supply string")
    for forms in (parsing.DAILY_FORMATS, parsing.UPLOAD_FORMATS):
        plain = F.coalesce(*[F.try_to_timestamp(F.trim("gasdate"), F.lit(f)) for f in forms])
        assert df.where(~plain.eqNullSafe(parsing.multi_format_timestamp(F.col("gasdate"), forms))).count() == 0
    good, _ = reports.parse_flows(df)
    assert [r["line"] for r in good.select("line").orderBy("line").collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert good._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") <= len(parsing.DAILY_FORMATS)
