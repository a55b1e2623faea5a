"""Landed files: each is read once, and failed, absent and late replies are told apart."""

import datetime as dt
import json

import pytest

from embercast.session import checkpoint_path
from embercast.sources import files, manifest


def line(site, day, values=(1.0, None, 3.0), body=None):
    reply = body if body is not None else json.dumps({"hourly": {"variables": [{"name": "t", "values": list(values)}]}})
    return json.dumps({"site_id": site, "date": f"2024-03-{day:02d}", "body": reply})


@pytest.fixture
def load(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def land(name, *lines):
        (folder / name).write_text("".join(x + "\n" for x in lines))

    def run():
        manifest.load_new(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ledger"), max_files=1)
        return spark.read.parquet(str(tmp_path / "out"))
    return land, run


def test_read_failed_absent_and_unasked(spark, load):
    land, run = load
    land("a.json", line(1, 1), line(1, 2, body='{"hourly": {"vari'), line(2, 1, values=[None, None]), line(9, 5), "not a line",
         json.dumps({"site_id": 1, "date": "2024-03-04"}), json.dumps({"date": "2024-03-01", "body": "{}"}))
    (rows := run()).cache()
    sites = spark.createDataFrame([(1, dt.date(2024, 3, 1), dt.date(2024, 3, 4)), (2, dt.date(2024, 3, 1), dt.date(2024, 3, 1))] * 2,
                                  "site_id int, start date, end date")
    got = {(r["site_id"], r["date"].day): (r["expected"], r["status"], r["replies"], r["failed"], r["files"], r["reason"])
           for r in manifest.manifest(rows, manifest.expected_days(sites)).collect()}
    assert got == {(1, 1): (True, "read", 1, 0, 1, None), (1, 2): (True, "failed", 1, 1, 1, "reply is not JSON"),
                   (1, 3): (True, "absent", 0, 0, 0, None), (1, 4): (True, "failed", 1, 1, 1, "no reply"),
                   (2, 1): (True, "failed", 1, 1, 1, "reply has no values"), (9, 5): (False, "read", 1, 0, 1, None)}
    (f,) = manifest.by_file(rows).collect()
    assert (f["lines"], f["failed"], f["without_key"]) == (7, 5, 2) and f["file"].endswith("a.json")


def test_a_second_load_reads_new_files_only_and_the_latest_reply_counts(spark, load):
    land, run = load
    land("a.json", line(1, 1, [5.0]), line(1, 2, body="{"))
    assert run().count() == 2
    assert run().count() == 2  # nothing new
    land("b.json", line(1, 2, [7.0, 9.0]), line(1, 1, body="{"))
    land("empty.json")
    rows = run()
    assert rows.count() == 4 and sorted(r["lines"] for r in manifest.by_file(rows).collect()) == [2, 2]
    stats = files.flatten_hourly(manifest.readable(rows), variables=["t"]).collect()
    assert {(r["date"].day, r["t_mean"]) for r in stats} == {(1, 5.0), (2, 8.0)}
    none = spark.createDataFrame([], "site_id int, date date")
    got = {r["date"].day: (r["status"], r["replies"], r["failed"], r["files"], r["expected"]) for r in manifest.manifest(rows, none).collect()}
    assert got == {1: ("read", 2, 1, 2, False), 2: ("read", 2, 1, 2, False)}


def test_a_lost_ledger_doubles_no_row_of_its_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(line(1, 1) + "\n" + line(1, 2) + "\n")
    out = checkpoint_path(spark, f"manifest-{tmp_path.name}")
    for ledger in ("one", "two"):  # the second ledger starts anew and sends batch 0 again
        manifest.load_new(spark, str(tmp_path / "in"), out, str(tmp_path / ledger))
    assert spark.read.parquet(out).count() == 2


def test_nothing_landed(spark):
    loaded = spark.createDataFrame([], "file string, landed_at timestamp, site_id int, date date, body string, reason string")
    asked = spark.createDataFrame([(1, dt.date(2024, 3, 1))], "site_id int, date date")
    (r,) = manifest.manifest(loaded, asked).collect()
    assert (r["status"], r["replies"], r["reason"]) == ("absent", 0, None)
    assert manifest.readable(loaded).count() == 0 and manifest.by_file(loaded).count() == 0
