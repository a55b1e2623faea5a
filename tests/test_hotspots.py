"""FX3 hot-spots, FX4 weather replies, J5 site assignment."""

import datetime as dt
import json
import math

from pyspark.sql import functions as F

from embercast.operators import hotspots as hs
from embercast.sources import files

D = dt.date(2023, 8, 1)
HOT = [(-17.3, -66.1, D, 80, 310.0, 10.0), (-17.1, -65.8, D, 95, 330.0, 30.0),
       (-17.3, -66.1, D, 79, 300.0, 5.0), (-17.0, -66.1, D, 90, 300.0, 5.0)]
HOT_SCHEMA = "latitude double, longitude double, acq_date date, confidence int, brightness double, frp double"


def test_bbox_and_daily_aggregate(spark):
    df = spark.createDataFrame(HOT, HOT_SCHEMA)
    kept = hs.filter_bbox(df, date="2023-08-01")
    assert kept.count() == 2  # edges inclusive; 79 and north of the box are out
    a = hs.daily_hotspots(kept, keys=("acq_date",)).first()
    assert (a.fire_count, a.Incendio, a.avg_brightness, a.avg_frp, a.max_confidence) == (2, 1, 320.0, 20.0, 95)


def test_join_fills_only_ingested_days(spark):
    fires = hs.daily_hotspots(hs.filter_bbox(spark.createDataFrame(HOT, HOT_SCHEMA)), keys=("acq_date",))
    weather = spark.createDataFrame([(D, 20.0), (dt.date(2023, 8, 2), 21.0), (dt.date(2023, 8, 3), 22.0)],
                                    "date date, t double")
    ingested = spark.createDataFrame([(D,), (dt.date(2023, 8, 2),)], "date date")
    out = {r.date: r for r in hs.join_weather_fires(weather, fires, ("date",), ingested).collect()}
    r2 = out[dt.date(2023, 8, 2)]
    assert (r2.fire_count, r2.Incendio, r2.avg_brightness, r2.avg_frp, r2.max_confidence) == (0, 0, None, None, None)
    r3 = out[dt.date(2023, 8, 3)]
    assert r3.fire_count is None and r3.Incendio is None  # not ingested: unknown, not "no fire"


def test_assign_sites_matches_box_test(spark):
    pts = spark.createDataFrame([(i, -17.8 + (i % 100) / 100 + 0.005, -66.7 + (i * 7 % 120) / 100 + 0.005)
                                 for i in range(500)], "id int, latitude double, longitude double")
    boxes = spark.createDataFrame([(0, -17.6, -17.1, -66.5, -65.8), (1, -17.7, -17.0, -66.6, -66.0),
                                   (2, -17.05, -16.9, -65.9, -65.6)],
                                  "site_id int, south double, north double, west double, east double")
    got = sorted((r.id, r.site_id) for r in hs.assign_sites(pts, boxes, cell=0.05).collect())
    b = boxes.collect()
    want = sorted((p.id, x.site_id) for p in pts.collect() for x in b
                  if x.south <= p.latitude <= x.north and x.west <= p.longitude <= x.east)
    assert got == want


def test_hourly_reply_flatten(spark):
    body = json.dumps({"hourly": {"variables": [{"name": "temperature_2m", "values": [1, 2, 3, 10]}]}})
    df = spark.createDataFrame([(1, D, body)], "site_id int, date date, body string")
    r = files.flatten_hourly(df, "body", ("site_id", "date"), ["temperature_2m"]).first()
    assert (r.temperature_2m_mean, r.temperature_2m_max, r.temperature_2m_min) == (4.0, 10.0, 1.0)
    assert math.isclose(r.temperature_2m_std, 4.0825, abs_tol=1e-4)


def test_daily_reply_flatten_all_days(spark):
    daily = {"time": ["2023-08-01", "2023-08-02"]}
    for i, n in enumerate(["temperature_2m_mean", "temperature_2m_max", "temperature_2m_min", "relative_humidity_2m",
                           "precipitation_sum", "shortwave_radiation_sum", "et0_fao_evapotranspiration",
                           "vapor_pressure_deficit_mean"]):
        daily[n] = [float(i), float(i) + 0.5]
    df = spark.createDataFrame([(7, json.dumps({"daily": daily}))], "site_id int, body string")
    out = files.flatten_daily(df, "body", ("site_id",)).orderBy("date").collect()
    assert len(out) == 2 and out[1].Temperature == 0.5 and out[0].Vapor_Pressure_Deficit == 7.0


def test_score_requests_quarantine(spark):
    good = json.dumps({"data": [[1.0] * 24, [2.0] * 24]})
    short = json.dumps({"data": [[1.0] * 24, [1.0] * 23]})
    named = json.dumps({"data": [{f"f{i}": 1.0 for i in range(3)}, {"f0": 1.0}, {"f0": None, "f1": 1.0, "f2": 1.0}]})
    df = spark.createDataFrame([("a", good), ("b", short), ("c", json.dumps({"x": 1})), ("d", json.dumps({"data": []})),
                                ("e", named)], "request_id string, body string")
    rows, bad = files.parse_score_requests(df, "body", "request_id")
    assert rows.filter(F.col("request_id") == "a").count() == 2
    assert rows.filter(F.col("request_id") == "b").count() == 1
    reasons = {(r.request_id, r.row_idx): r.reason for r in bad.collect()}
    assert reasons[("b", 1)].startswith("expected 24") and reasons[("c", None)] == "missing data"
    assert reasons[("d", None)] == "empty data"
    rows3, bad3 = files.parse_score_requests(df.filter("request_id = 'e'"), "body", "request_id",
                                             features=["f0", "f1", "f2"])
    assert rows3.count() == 1 and bad3.count() == 2  # every row is checked, not only the first
    assert {r.reason for r in bad3.collect()} == {"missing columns", "null value"}
