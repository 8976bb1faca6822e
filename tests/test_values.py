"""Known values of scalar expressions, similarity and assignment, and of readers and streams."""

import datetime as dt
import difflib
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import calendar as cal
from tallyforge.functions import expressions as ex
from tallyforge.operators import evm, forecast, matching, merge, reports, versioned
from tallyforge.session import shared_folder
from tallyforge.sources import readers
from tallyforge.streaming import latest as streaming


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def d(x):
    return F.lit(x).cast("date")


def test_working_days(spark):
    got = one(spark, a=cal.working_days(d("2024-01-01"), d("2024-01-07")), b=cal.working_days(d("2024-01-05"), d("2024-01-08")), c=cal.working_days(d("2024-01-08"), d("2024-01-05")), e=cal.add_working_days(d("2024-01-05"), F.lit(1)), f=cal.add_working_days(d("2024-01-06"), F.lit(0)))
    assert tuple(got) == (4, 1, 0, dt.date(2024, 1, 8), dt.date(2024, 1, 6))


def test_working_days_against_a_walk(spark):
    @settings(max_examples=30, deadline=None)
    @given(st.dates(dt.date(1990, 1, 1), dt.date(2040, 1, 1)), st.integers(0, 300))
    def check(start, n):
        end = start + dt.timedelta(n)
        walk = [x for k in range(1, n + 1) if (x := start + dt.timedelta(k)).weekday() < 5]
        got = one(spark, a=cal.working_days(d(str(start)), d(str(end))), b=cal.add_working_days(d(str(start)), F.lit(len(walk))))
        assert got.a == len(walk) and got.b == (walk[-1] if walk else start)

    check()


def test_dates_and_weeks(spark):
    got = one(spark, a=cal.parse_date(F.lit("03.02.2024")), b=cal.parse_date(F.lit("2024-02-03")), c=cal.parse_date(F.lit("soon")), e=cal.monday(d("2024-02-04")), f=cal.show_date(F.lit(None).cast("date")))
    assert tuple(got) == (dt.date(2024, 2, 3), dt.date(2024, 2, 3), None, dt.date(2024, 1, 29), "—")
    assert cal.viewport(10, 52) == (6, 19) and cal.viewport(0, 52) == (0, 13) and cal.viewport(51, 52) == (39, 52)


@pytest.mark.parametrize(("pct", "status"), [(None, "not_started"), (0, "not_started"), (1, "in_progress"), (99, "in_progress"), (100, "done_physically"), (120, "done_physically")])
def test_status(spark, pct, status):
    assert one(spark, s=ex.work_status(F.lit(pct).cast("int"))).s == status


@pytest.mark.parametrize(("text", "tier"), [("Signed", 2), ("signed in pencil", 1), (None, 0), ("", 0), ("in progress", 1), ("sent for signature", 1), ("yes", 0)])
def test_pencil_signature_is_none(spark, text, tier):
    assert one(spark, t=ex.status_tier(F.lit(text).cast("string"))).t == tier


@pytest.mark.parametrize(("text", "value", "review"), [("12", 12, False), ("10-15", 15, False), ("7 people", 7, False), ("contractor", None, True), ("", None, False), (None, None, False)])
def test_crew(spark, text, value, review):
    got = one(spark, c=ex.crew(F.lit(text).cast("string"))).c
    assert (got.value, got.needs_review) == (value, review)


def test_more_expressions(spark):
    got = one(spark, a=ex.money(F.lit(1234567.5)), b=ex.number_or_raw(F.lit("1\u00a0234,5"))["value"].cast("double"), c=ex.number_or_raw(F.lit("16 sht"))["raw"], e=ex.group_status(F.lit(4), F.lit(2), F.lit("x")), f=ex.deviation_class(F.lit(8)), g=ex.first_match(F.lit("no crane today"), {"equipment": "crane", "people": "crew"}, "material"), h=ex.weather_text(F.lit(61), F.lit(4.4), F.lit(2.0)), i=ex.violation_status(F.lit(False), F.lit(True), F.lit(True), F.lit(False)))
    assert tuple(got) == ("1\u00a0234\u00a0567,50", 1234.5, "16 sht", "signed 50%", "danger", "equipment", "light rain, +4°, 2.0 mm", "rejected")


def test_forecasts(spark):
    got = one(spark, a=forecast.people_for_date(F.lit(100), d("2024-01-01"), d("2024-01-12")), b=forecast.people_for_date(F.lit(100), d("2024-01-12"), d("2024-01-01")), c=forecast.date_for_people(F.lit(10), F.lit(3), d("2024-01-05")), e=forecast.position(d("2024-01-01"), d("2024-01-11"), d("2024-01-06")), f=forecast.position(d("2024-01-01"), d("2024-01-01"), d("2024-01-06")))
    assert tuple(got) == (12, None, dt.date(2024, 1, 11), 50.0, None)


def test_decreases_with_several_rows_a_day(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1), 50), (1, dt.date(2024, 1, 1), 60), (1, dt.date(2024, 1, 2), 55), (1, dt.date(2024, 1, 3), None)], "k int, date date, v int")
    assert [tuple(r) for r in versioned.decreases(rows, "k", "date", "v").collect()] == [(1, dt.date(2024, 1, 1), 60, dt.date(2024, 1, 2), 55)]


def test_similarity_is_difflib(spark):
    a, b = "the quick brown fox" * 20, "the quick red fox" * 15
    got = spark.createDataFrame([(a, b), (None, "x")], "a string, b string").select(matching.sequence_similarity("a", "b").alias("s")).collect()
    assert got[0].s == difflib.SequenceMatcher(None, a, b).ratio() and got[1].s == 0.0


def judged(pairs, decided=()):
    """The assignment by its rule, one pair after another."""
    claimed_r, claimed_c, out = {r for r, _ in decided}, {c for _, c in decided if c is not None}, {r: ("new" if c is None else "confirmed", c) for r, c in decided}
    for score, r, c in sorted(((s, r, c) for r, c, s in pairs), key=lambda x: (-x[0], x[1], x[2])):
        if r in claimed_r or c in claimed_c:
            continue
        rest = [s for q, d, s in pairs if q == r and d != c and d not in claimed_c]
        if score >= 0.97 or (score >= 0.80 and (not rest or score - max(rest) >= 0.08)):
            claimed_r.add(r)
            claimed_c.add(c)
            out[r] = ("confident", c)
    for r in {r for r, _, _ in pairs} - claimed_r:
        left = [c for q, c, _ in pairs if q == r and c not in claimed_c]
        out[r] = ("ambiguous" if left else "new", None)
    return out


def test_assignment_in_rounds(spark):
    shared_folder(spark)
    rng = random.Random(4)
    pairs = [(r, c, rng.choice([0.6, 0.75, 0.82, 0.85, 0.9, 0.93, 0.98, 1.0])) for r in range(12) for c in range(12) if rng.random() < 0.4]
    decided = [(3, 5), (4, None)]
    for fixed in ([], decided):
        want = judged(pairs, fixed)
        df = spark.createDataFrame(pairs, "record int, candidate int, score double")
        records = spark.createDataFrame([(r,) for r in range(14)], "record int")
        got = {r.record: (r.verdict, r.candidate) for r in matching.assign(df, records, decided=spark.createDataFrame(fixed, "record int, candidate int") if fixed else None).collect()}
        assert got == {r: want.get(r, ("new", None)) for r in range(14)}


def test_assignment_of_many_like_candidates_takes_few_rounds(spark, monkeypatch):
    """Of pairs that must fail one after the other, all are judged in one round."""
    shared_folder(spark)
    pairs = [(r, c, 0.9 - 0.02 * r) for r in range(3) for c in range(40)] + [(4, c, 0.75) for c in range(40)] + [(5, 50, 0.9), (5, 51, 0.85), (6, 51, 0.88), (6, 52, 0.5)]
    rounds, checkpoint = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a: rounds.append(1) or checkpoint(df, *a))
    got = {r.record: (r.verdict, r.candidate) for r in matching.assign(spark.createDataFrame(pairs, "record int, candidate int, score double"), spark.createDataFrame([(r,) for r in range(7)], "record int")).collect()}
    want = judged(pairs, [])
    assert got == {r: want.get(r, ("new", None)) for r in range(7)} and len(rounds) < 12


def test_token_set_ratio(spark):
    def brute(a, b):
        s, t = set((a or "").split()), set((b or "").split())
        x = [" ".join(sorted(v)) for v in (s & t, s, t)]
        return max(difflib.SequenceMatcher(None, x[i], x[j]).ratio() for i, j in ((0, 1), (0, 2), (1, 2)))

    rows = [("fix the wall", "the wall fix"), ("fix the wall", "the wall"), ("", None), ("a b", "c d"), ("Crack in wall 3", "crack in wall 3"), ("x x y", "y x")]
    got = spark.createDataFrame(rows, "a string, b string").select(matching.token_set_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([brute(a, b) for a, b in rows]) and got[0].s == 1.0 and got[2].s == 1.0


def test_codes_are_gapless_over_all_rows(spark):
    shared_folder(spark)
    got = merge.renumber(spark.range(5000).withColumn("k", F.col("id") % 7).repartition(6), ["k", "id"], "F-").collect()
    assert [r.code for r in sorted(got, key=lambda r: (r.k, r.id))] == [f"F-{n:09d}" for n in range(1, 5001)]


def test_merges(spark):
    old, new = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a"), (2, "b")], [(2, "B"), (3, "c")]))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(merge.upsert(old, new, ["k"])) == {(1, "a"), (2, "B"), (3, "c")}
    assert as_set(merge.insert_if_absent(old, new, ["k"])) == {(1, "a"), (2, "b"), (3, "c")}
    assert as_set(merge.upsert(merge.upsert(old, new, ["k"]), new, ["k"])) == as_set(merge.upsert(old, new, ["k"]))
    assert as_set(merge.audit(old, new, "k", "v")) == {(2, '{"v":"b"}', '{"v":"B"}')}
    assert merge.invalid(old, {"short": F.col("k") < 2}).select("k", "errors").collect()[0].errors == ["short"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿k;v\n1;x\n2;\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x"), ("2", None)]
    (tmp_path / "b.txt").write_text("1|x|rest|of it\n")
    assert tuple(readers.read_pipe(spark, str(tmp_path / "b.txt"), ["a", "b", "c"]).first()) == ("1", "x", "rest|of it")
    (tmp_path / "c.sql").write_text("SET x;\nCOPY public.work (id, name) FROM stdin;\n1\tone\n2\t\\N\n\\.\nCOPY other (a) FROM stdin;\n9\n\\.\n")
    assert [tuple(r) for r in readers.read_copy(spark, str(tmp_path / "c.sql"), "work", ["id", "name"]).collect()] == [("1", "one"), ("2", None)]
    reply = '{"hourly":{"time":["2024-01-01T08:00","2024-01-01T09:00"],"temperature_2m":[1.0,2.5],"precipitation":[0.0,0.1],"weathercode":[0,61]}}'
    assert tuple(readers.weather_at_nine(spark.createDataFrame([(reply,)], "reply string")).first()) == (dt.date(2024, 1, 1), 2.5, 0.1, 61)
    html = "<table><tr><th colspan=2>A</th></tr><tr><td>1</td><td><b>2</b></td></tr></table><ul><li>x</li></ul>"
    got = readers.html_rows(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html").collect()
    assert [(r.block, r.row, r.cells) for r in got] == [(1, 0, ["A", "A"]), (1, 1, ["1", "2"]), (2, 0, ["x"])]


def test_export(spark, tmp_path):
    readers.write_export(spark.createDataFrame([(1, dt.date(2024, 2, 3), None)], "k int, d date, v string"), str(tmp_path / "out"))
    texts = [p.read_bytes().decode() for p in (tmp_path / "out").glob("part-*")]
    assert max(texts, key=len) == "﻿k;d;v\r\n1;03.02.2024;\r\n"


def test_streaming_latest(spark, tmp_path):
    rows = pd.DataFrame({"k": [1, 1, 2], "ts": pd.to_datetime(["2024-01-01 10:00", "2024-01-01 11:00", "2024-01-02 09:00"]), "v": [1.0, 2.0, 3.0]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = streaming.latest_facts(stream, ["k"], "ts").writeStream.format("memory").queryName("latest_facts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.v) for r in spark.table("latest_facts").collect()} == {(1, 2.0), (2, 3.0)}
    q = streaming.upsert_into(stream, str(tmp_path / "out"), ["k"], ["ts"], str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out" / "v=0")).collect()} == {(1, 2.0), (2, 3.0)}


def test_losses_count_a_days_deficit_once_for_every_blocker(spark):
    day = lambda k: dt.date(2024, 1, k)
    rows = spark.createDataFrame([(1, day(1), 5, 3), (2, day(1), 5, 4), (1, day(2), 5, 9), (1, day(3), 5, None)], "work_id int, date date, planned int, actual int")
    blockers = spark.createDataFrame([(1, "a", day(1), None), (2, "a", day(1), day(2)), (3, "b", day(1), None), (1, "b", day(2), None), (1, "c", day(4), None), (1, "d", dt.date(2023, 1, 1), None)], "work_id int, kind string, raised date, resolved date")
    assert {x.kind: (x.lost, x.blockers) for x in evm.losses(rows, blockers, "2024-01-05").collect()} == {"a": (6, 2), "b": (3, 2), "c": (0, 1)}
    assert tuple(evm.loss_overlap(blockers, "2024-01-05").first()) == (5, 3, 2)


TERMS = "work_id string, current_start date, plan_start date, current_finish date, plan_finish date, status string, confidence string, pct int, executor_type string, subcontractor_id int"


def test_known_vectors_of_forecasts(spark):
    """The reference inputs of FIXTURES.md, part A."""
    date = dt.date.fromisoformat
    rows = [("A", None, None, None, date("2026-07-31"), "in_progress", "high"), ("B", None, None, None, date("2026-08-31"), "not_started", "medium"), ("C", None, None, None, date("2026-07-01"), "done_physically", "high"), ("D", None, None, None, None, "not_started", "high"), ("E", None, None, None, date("2026-07-01"), None, "low")]
    terms = forecast.resolved_terms(spark.createDataFrame([(*r, None, None, None) for r in rows], TERMS))
    assert [(r.work_id, r.lag_days) for r in forecast.overdue(terms, "2026-08-15", "finish").collect()] == [("A", 15)]
    assert tuple(forecast.baseline_lag(terms, "2026-08-15").first()) == (date("2026-08-31"), 1, 15, date("2026-09-15"))
    assert tuple(forecast.baseline_lag(terms.where("work_id = 'B'"), "2026-08-15").first()) == (date("2026-08-31"), 0, 0, date("2026-08-31"))
    assert tuple(forecast.baseline_lag(terms.where("false"), "2026-08-15").first()) == (None, 0, 0, None)
    late = terms.where("work_id = 'A'").withColumn("status", F.lit(None).cast("string"))
    assert forecast.overdue(late, "2026-08-15", "finish").count() == 1  # a work without a status is not done
    mon, fri = F.lit("2026-08-17").cast("date"), F.lit("2026-08-21").cast("date")
    one = spark.range(1).select(
        forecast.position(F.lit("2026-07-01").cast("date"), F.lit("2026-11-28").cast("date"), F.lit("2026-08-27").cast("date")), forecast.position(mon, mon, mon), forecast.people_for_date(F.lit(100), mon, fri), forecast.people_for_date(F.lit(100), mon, mon),
        forecast.date_for_people(F.lit(40), F.lit(10), mon), forecast.date_for_people(F.lit(40), F.lit(0), mon), *evm.deficit(F.lit(30), F.lit(12)).values(), *evm.deficit(F.lit(0), F.lit(5)).values(),
    ).first()
    assert [float(x) if not isinstance(x, (dt.date, type(None))) else x for x in one] == [38.0, None, 25.0, None, date("2026-08-21"), None, 18.0, None, 40.0, None, 5.0, None]


def test_known_vectors_of_earned_value(spark):
    works = spark.createDataFrame([(1, 100), (2, 50), (3, None)], "work_id int, pct int")
    weighted = evm.weights(works, spark.createDataFrame([(1, 30, 5), (2, None, 10)], "work_id int, effort int, crew int"))
    assert {(r.work_id, r.weight, r.weight_source) for r in weighted.collect()} == {(1, 30, "effort"), (2, 10, "crew"), (3, 1, "one")}
    day = lambda k: dt.date(2024, 1, k)
    rows = spark.createDataFrame([(day(30), 5, 5), (day(30), 3, 1), (day(30), 0, 2), (day(30), 4, 4), (day(2), 20, 10), (day(31), 50, None)], "date date, planned int, actual int")
    got = evm.earned_value(rows, rows, weighted).first()
    assert (got.progress, got.total_weight, got.unknown, got.promised, got.met, got.ppc) == (85.4, 41, 1, 3, 2, 66.7)
    assert (got.last_date, got.planned_value, got.actual_cost, got.earned_value) == (day(30), 32, 22, 35.0)


def test_critical_works(spark):
    date = dt.date.fromisoformat
    rows = [("late", date("2026-08-01"), "in_progress", 50), ("after", date("2027-01-10"), "not_started", None), ("blocked", date("2026-08-28"), "in_progress", 0), ("fine", date("2026-08-28"), "in_progress", 0), ("done", date("2026-08-01"), "accepted", 100)]
    terms = forecast.resolved_terms(spark.createDataFrame([(w, None, None, None, f, s, "high", p, None, None) for w, f, s, p in rows], TERMS))
    blockers = spark.createDataFrame([("blocked", None), ("blocked", None), ("fine", date("2026-08-02"))], "work_id string, resolved date")
    effort, last = spark.createDataFrame([("late", 40), ("after", 1000), ("blocked", 100)], "work_id string, effort int"), spark.createDataFrame([("blocked", 3)], "work_id string, actual int")
    got = {r.work_id: (r.reasons, r.extra_people) for r in forecast.critical(terms, blockers, effort, last, "2026-08-17", "2026-12-31").collect()}
    assert got["late"] == ("overdue", None) and got["blocked"] == ("blocked 2", 9) and got["after"][0] == "after directive" and got["after"][1] == -(-1000 // 98) and set(got) == {"late", "after", "blocked"}


def test_remarks_with_a_common_prefix(spark):
    rows = spark.createDataFrame([("g", "crack in wall 1"), ("g", "crack in wall 2"), ("g", "crack in wall 2"), ("g", None)], "g string, t string")
    assert reports.remarks(rows, "g", "t", 5).first().remarks == "crack…; crack…"


def test_islands_of_a_large_table_take_more_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, dt.date(2024, 1, 1) + dt.timedelta(days=3 * d)) for k in range(40) for d in range(5)] * 2, "k int, day date")
    want = sorted(versioned.islands(rows, "k", "day").collect())
    monkeypatch.setattr(versioned, "ROWS_EACH", 20, raising=False)
    got = versioned.islands(rows, "k", "day")
    assert sorted(got.collect()) == want and got.rdd.getNumPartitions() == 21
