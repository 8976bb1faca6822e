"""Keyed state, polls and dumps: what a stream or a split reading gives equals the batch."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.versioned import latest_with_plan
from tallyforge.sources import readers
from tallyforge.streaming import latest as streaming
from tallyforge.streaming import state as st

SCHEMA = "k long, day string, channel string, ts timestamp, id long, plan int, fact int, extra string"


def entries(seed=3, n=160):
    """Entries of two channels, some late, some twice, some without a plan."""
    rng = random.Random(seed)
    rows = [(rng.randrange(8), rng.choice("ab"), rng.choice(["excel", "web"]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60)), i, rng.choice([None, rng.randrange(9)]), rng.choice([None, rng.randrange(3)]), "x") for i in range(n)]
    return [*rows, *rng.sample(rows, 30)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return tmp_path_factory.mktemp("entries")


def in_turns(spark, folder, make, name):
    """A stream over parts of the rows, stopped and started again between them."""
    rows, got = entries(), None
    source = folder / name
    for part in range(3):
        spark.createDataFrame(rows[part * 64 : (part + 1) * 64], SCHEMA).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        got = make(stream, str(folder / f"{name}-state"))
    return rows, got


def test_two_channels_equal_the_batch_merge(spark, folder):
    make = lambda stream, at: st.run_to_end(st.merge_channels(stream, ["k", "day"], "channel", ["ts", "id"], "plan", "fact"), "update", at)
    rows, got = in_turns(spark, folder, make, "channels")
    want = latest_with_plan(spark.createDataFrame(rows, SCHEMA), ["k", "day"], ["ts", "id"], ["plan"]).select("k", "day", "ts", "id", "fact", "plan")
    assert sorted(map(str, st.last_of(got, ["k", "day"]).select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.groupBy("k", "day", "batch").count().where("count > 1").count() == 0


def test_audit_of_changes(spark, folder):
    make = lambda stream, at: st.run_to_end(st.audit_feed(stream, ["k", "day"], ["ts", "id"], ["plan", "fact"]), "append", at)
    rows, got = in_turns(spark, folder, make, "audit")
    held, want = {}, []
    for part in range(3):
        for r in sorted(rows[part * 64 : (part + 1) * 64], key=lambda r: (r[3], r[4])):
            key, at, new = r[:2], (r[3], r[4]), {"plan": r[5], "fact": r[6]}
            old = held.get(key)
            if old is None or at > old[0]:
                if old is None or old[1] != new:
                    want.append((*key, r[4], "update" if old else "insert", json.dumps(old[1]) if old else None, json.dumps(new)))
                held[key] = (at, new)
    assert sorted(map(str, (tuple(r) for r in got.select("k", "day", "id", "op", "old_row", "new_row").collect()))) == sorted(map(str, want))
    again = make(spark.readStream.schema(SCHEMA).parquet(str(folder / "audit")), str(folder / "audit-state"))
    assert again.count() == len(want)  # nothing new came


def test_keys_of_streams_need_no_python(spark, tmp_path):
    """Newest rows are held by Spark's own aggregation; a row that comes again sends nothing out."""
    at = dt.datetime(2024, 1, 1)
    parts = [[(1, "a", "web", at, 1, 5, 2, "x"), (2, "a", "web", at, 2, None, 1, "x")], [(1, "a", "web", at, 1, 5, 2, "x"), (2, "a", "excel", at - dt.timedelta(1), 0, 7, 0, "x")]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = st.merge_channels(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["k", "day"], "channel", ["ts", "id"], "plan", "fact")
        assert "TransformWithState" not in stream._jdf.queryExecution().analyzed().toString()
        got = st.run_to_end(stream, "update", str(tmp_path / "at"))
    assert sorted((r.k, r.batch, r.id, r.plan) for r in got.collect()) == [(1, 0, 1, 5), (2, 0, 2, None), (2, 1, 2, 7)]


def test_audit_steps_need_no_python(spark, tmp_path):
    spark.createDataFrame([(1, "a", "web", dt.datetime(2024, 1, 1), 1, None, 2, 'é"')], SCHEMA).write.parquet(str(tmp_path / "in"))
    feed = st.audit_feed(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["k", "day"], ["ts", "id"], ["plan", "extra", "ts"])
    events, newest = feed.step(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")).select(feed.entries.columns), None)
    assert "Python" not in events._jdf.queryExecution().executedPlan().toString()
    assert [r.new_row for r in events.collect()] == ['{"plan": null, "extra": "é\\"", "ts": "2024-01-01 00:00:00"}'] and newest.count() == 1


def test_a_day_polled_twice_is_one_row(spark, tmp_path):
    def put(n, days, at, reply=None):
        body = reply or json.dumps({"daily": {"time": days, "precipitation_sum": [at] * len(days), "temperature_2m_min": [1.5] * len(days), "temperature_2m_max": [4.0] * len(days), "weathercode": [61] * len(days)}, "hourly": {"time": [f"{days[0]}T09:00"], "temperature_2m": [2.5], "weathercode": [3]}})
        spark.createDataFrame([(dt.date.fromisoformat(days[0]), dt.date.fromisoformat(days[-1]), body, at)], "first_day date, last_day date, reply string, fetched_at double").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("first_day date, last_day date, reply string, fetched_at double").parquet(str(tmp_path / "in"))
        q = streaming.poll_days(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        return {str(r.date): (r.status, r.precipitation, r.note) for r in spark.read.parquet(str(tmp_path / "out" / f"v={n}")).collect()}

    assert put(0, ["2024-01-01", "2024-01-02"], 1.0) == {"2024-01-01": ("ok", 1.0, None), "2024-01-02": ("ok", 1.0, "no reading at 09:00")}
    assert put(1, ["2024-01-02", "2024-01-03"], 2.0)["2024-01-02"] == ("ok", 2.0, None)
    assert put(2, ["2024-01-03", "2024-01-04"], 3.0, "<html>busy</html>") == {"2024-01-01": ("ok", 1.0, None), "2024-01-02": ("ok", 2.0, None), "2024-01-03": ("error", None, "unreadable reply"), "2024-01-04": ("error", None, "unreadable reply")}


@pytest.mark.parametrize("size", ["128m", "700"])
def test_dumps_are_read_from_any_split(spark, tmp_path, size):
    rng = random.Random(2)
    want = []
    for f in range(3):
        text = "-- a dump\nCOPY public.other (id) FROM stdin;\n" + "".join(f"{i}\tCOPY work\n" for i in range(40)) + "\\.\n\n"
        rows = [(str(i), rng.choice([None, "one", "tab\there", "line\nend", "back\\slash", "", "\\N?"])) for i in range(f * 200, f * 200 + 200)]
        code = lambda v: "\\N" if v is None else v.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
        text += "COPY public.work (id, name) FROM stdin;\n" + "".join(f"{i}\t{code(v)}\n" for i, v in rows) + "\\.\n\nCOPY public.work2 (id, name) FROM stdin;\n7\tno\n\\.\n"
        (tmp_path / f"d{f}.sql").write_text(text)
        want += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = readers.read_copy(spark, str(tmp_path), "work", ["id", "name"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert readers.read_copy(spark, str(tmp_path), "absent", ["id"]).where(F.lit(True)).count() == 0
