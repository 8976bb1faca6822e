"""Similarity search, closure review, phrases and renamings against brute force."""

import datetime as dt
import difflib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import bench
from tallyforge.functions import text as tx
from tallyforge.operators import matching, similarity
from tallyforge.operators.phrases import frequent_phrases
from tallyforge.plans import QUERIES
from tallyforge.session import shared_folder


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def tokens(a, b):
    s, t = set(a.split()), set(b.split())
    base, one, other = (" ".join(sorted(w)) for w in (s & t, s, t))
    return max(ratio(base, one), ratio(base, other), ratio(one, other))


MEASURES = {"chars": ratio, "tokens": tokens, "both": lambda a, b: max(ratio(a, b), tokens(a, b))}


def texts(n, seed):
    """Texts of a small vocabulary, some of them edited, cut or shuffled copies, some long, empty or null."""
    rng = random.Random(seed)
    words = ["wall", "crack", "pipe", "weld", "joint", "not", "done", "cover", "sheet", "of", "the", "in", "шов", "труба"]
    out = [None, "", "wall"]
    while len(out) < n:
        if len(out) > 6 and rng.random() < 0.5:
            w = (rng.choice(out) or "x").split() or ["x"]
            w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.4:
                rng.shuffle(w)
            out.append(" ".join(w[: rng.randrange(1, len(w) + 1)] if rng.random() < 0.3 else w))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 20, 90]))))
    return out


@pytest.mark.parametrize("measure", MEASURES)
@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_scan_equals_all_pairs(spark, measure, block_bytes):
    a = texts(22, 1)
    b = [*texts(30, 2), *(f"{t} not" for t in a[3:15])]
    records, pool = [(i, t, f"s{i % 5}") for i, t in enumerate(a)], [(i, t, f"s{i % 3}") for i, t in enumerate(b)]
    got = similarity.scan(spark.createDataFrame(records, "record long, a string, section string"), spark.createDataFrame(pool, "candidate long, b string, section string").repartition(3), 0.55, measure, block_bytes=block_bytes).collect()
    held = {s for _, _, s in pool}
    want = {(i, j): MEASURES[measure](x or "", y or "") for i, x, s in records for j, y, p in pool if s not in held or s == p}
    want = {k: v for k, v in want.items() if v >= 0.55}
    assert {(r.record, r.candidate): r.score for r in got} == pytest.approx(want) and len(got) == len(want) > 12


@pytest.mark.parametrize("first", [True, False])
def test_scan_keeps_the_top(spark, first):
    a, b = texts(25, 3), texts(30, 4)
    got = similarity.scan(spark.createDataFrame(list(enumerate(a)), "record long, a string"), spark.createDataFrame(list(enumerate(b)), "candidate long, b string"), 0.3, "both", top=3, first=first, digits=3, block_bytes=400).collect()
    found = {}
    for r in got:
        found.setdefault(r.candidate, []).append((-r.score, r.record))
    for j, y in enumerate(b):
        scores = [(MEASURES["both"](x or "", y or "") if first else MEASURES["both"](y or "", x or ""), i) for i, x in enumerate(a)]
        want = sorted((-round(s, 3), i) for s, i in scores if s >= 0.3)[:3]
        assert sorted(found.get(j, [])) == want


def test_token_query_holds_every_pair(spark, sf_dir):
    clean = lambda t: re.sub(r"\s+", " ", t.lower()).strip(" ")
    items = [(r.item_id, clean(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, clean(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {(r.record, r.candidate): r.score for r in QUERIES["token_set_ratio"](spark, sf_dir).collect()}
    want = {(i, j): s for i, x in items for j, y in docs if (s := tokens(x, y)) >= 0.55}
    assert got == pytest.approx(want) and want


def reviewed(old, items, phrases, top=4):
    """The review of one old text by the letter: single items first, then neighbours as one."""

    def clean(t):
        out = t
        for p in phrases:
            out = out.replace(p, " ")
        out = " ".join(out.split())
        return t if len(out.split()) < 5 else out

    number, text = old
    found = []
    for i, (item, no, t, claimed) in enumerate(items):
        score = MEASURES["both"](clean(text), clean(t))
        if score >= 0.40 or no == number:
            found.append((round(score, 3), 0, item, None, no == number, not claimed))
    for (item, _, t, _), (other, _, u, _) in zip(items, items[1:]):
        score = MEASURES["both"](clean(text), clean(f"{t} {u}"))
        if score >= 0.40 and score > max((f[0] for f in found), default=0):
            found.append((round(score, 3), 1, item, other, False, False))
    return [(f[2], f[3], f[0], f[4], f[5]) for f in sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:top]]


def test_closure_review_by_the_letter(spark):
    a, b = [t for t in texts(40, 5) if t], [t for t in texts(45, 6) if t]
    phrases = ["not done", "of the"]
    items = [(i, i * 3 % 17, t, i % 4 == 0) for i, t in enumerate([*a[:16], "alpha beta gamma delta", "epsilon zeta eta theta"])]
    old = [(j, None if j % 7 == 0 else j, t) for j, t in enumerate([*b, f"{a[3]} {a[4]}", "alpha beta epsilon zeta"])]
    got = similarity.closure_review(spark.createDataFrame(old, "old_id long, number long, text string"), spark.createDataFrame(items, "item_id long, number long, text string, claimed boolean"), phrases).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.old_id, r.place)):
        found.setdefault(r.old_id, []).append((r.item_id, r.joined_with, r.score, r.same_number, r.selectable))
    want = {j: reviewed((no, t), items, phrases) for j, no, t in old}
    assert found == {j: v for j, v in want.items() if v}
    assert any(r.joined_with is not None for r in got)


def test_closure_audit(spark):
    a, b = [t for t in texts(20, 7) if t], [t for t in texts(30, 8) if t]
    got = similarity.closure_audit(spark.createDataFrame([(j, j % 2 == 0, t) for j, t in enumerate(b)], "old_id long, resolved boolean, text string"), spark.createDataFrame(list(enumerate(a)), "item_id long, text string")).collect()
    for r in got:
        best = max(((MEASURES["both"](b[r.old_id], t), -i) for i, t in enumerate(a)))
        assert (r.score, r.item_id) == (pytest.approx(round(best[0], 3)), -best[1]) and r.flagged == (r.old_id % 2 == 1 or best[0] >= 0.40)
    assert len(got) == len(b)


def mined(rows, share, least):
    seen = Counter()
    for t in rows:
        w = (t or "").split()
        seen.update({tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)})
    often = {g: n for g, n in seen.items() if n >= share * len(rows)}
    inside = {g[i:j] for g in often for i, j in ((0, len(g) - 1), (1, len(g)))}
    return {(" ".join(g), len(g), n) for g, n in often.items() if g not in inside and len(g) >= least}


def test_phrases(spark):
    rows = [*texts(30, 9), *["x y z the joint of the wall is not done"] * 9, "the the the the the", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    for share, least in ((0.2, 2), (0.1, 1), (0.05, 3)):
        assert {tuple(r) for r in frequent_phrases(df, "id", "text", share, least).collect()} == mined(rows, share, least)
    assert frequent_phrases(df.limit(0), "id", "text").count() == 0


def test_phrases_shuffle_no_ids(spark, monkeypatch):
    """Runs are counted without their texts' ids where ids are single; repeated ids count once."""
    from pyspark.sql import DataFrame

    plans, of = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a: plans.append(self._jdf.queryExecution().executedPlan().toString()) or of(self, *a))
    rows = [(i, "a b c d" if i % 2 else "x a b c") for i in range(10)]
    want = [("a b c", 3, 10)]
    once = frequent_phrases(spark.createDataFrame(rows, "id int, text string"), "id", "text", 0.6, 2)
    assert [tuple(r) for r in once.collect()] == want
    assert not [p for p in plans if "hashpartitioning(_id" in p]
    twice = frequent_phrases(spark.createDataFrame([*rows, *rows[:2]], "id int, text string"), "id", "text", 0.6, 2)
    assert [tuple(r) for r in twice.collect()] == want


def test_stripping_falls_back(spark):
    got = spark.createDataFrame([("a b the wall is wet and old a b",), ("a b c d",), (None,)], "t string").select(similarity.strip_phrases(F.col("t"), ["a b", "zz"]).alias("s")).collect()
    assert [r.s for r in got] == ["the wall is wet and old", "a b c d", None]


def test_renamings_end(spark):
    shared_folder(spark)
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(37)] + [("p", "q"), ("q", "r"), ("r", "p"), ("s", "p"), ("t", "t"), ("u", "w"), ("u", "v")]
    got = {r.name: r.stands_for for r in matching.alias_ends(spark.createDataFrame(pairs, "name string, other string")).collect()}
    assert got == {f"n{i:02}": "n37" for i in range(37)} | {"p": "p", "q": "p", "r": "p", "s": "p", "u": "v"}


def test_numbers_of_a_large_group(spark):
    shared_folder(spark)
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 3000).alias("o")).repartition(5)
    got = matching.part_numbers(rows, ["g"], "o", "n").collect()
    for g in (0, 1):
        own = sorted((r.o, r.n) for r in got if r.g == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_ranges_of_any_length(spark):
    ranges = [(1, 5, 5), (1, 0, 1_000_000), (1, 90, 110), (2, -40, -3), (2, 7, 6)]
    points = [(k, p) for k in (1, 2) for p in (-40, -3, 0, 5, 6, 7, 99, 110, 111, 1_000_000)]
    got = matching.range_join(spark.createDataFrame(points, "k int, p int"), spark.createDataFrame(ranges, "k int, low int, high int"), "k", "p", "low", "high")
    want = sorted((k, p, a, b) for k, p in points for j, a, b in ranges if j == k and a <= p <= b)
    assert sorted(map(tuple, got.select("k", "p", "low", "high").collect())) == want and "_width" not in got.columns


def test_texts_of_states_and_places(spark):
    states = {"Снято 5.8.26": dt.date(2026, 8, 5), "будет снято 05.08.26": None, "будет, снята 5.8.26; снята 6.8.26": dt.date(2026, 8, 6), "снято, затем СНЯТО 01.02.2026": dt.date(2026, 2, 1), "снято 32.13.26, снята 1.1.27": dt.date(2027, 1, 1), "снятое 1.1.27": None, "не снято": None, "": None, None: None, "будет  снято 1.1.26": None}
    df = spark.createDataFrame([(t,) for t in states], "t string").select("t", tx.closed_on(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == states
    places = {"на УТ13": "УТ13", "на ут 2.1, далее": "УТ2.1", "УТ-13": None, "кд-4.1": "КД-4.1", "КД 4": "КД4", "ВУТ1": None, "ТЭЦ": "ТЭЦ", "УУСА": None}
    df = spark.createDataFrame([(t,) for t in places], "t string").select("t", tx.place_code(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == places


def test_bench_selects_every_kind_of_query():
    names = ["op10_b", "open_blocks", "scurve", "op2_a", "pipeline", "op_x", "options"]
    assert bench.selected(names) == ["scurve", "op2_a", "op10_b", "pipeline"]


def test_ratio_is_difflibs_or_less_than_needed():
    rng = random.Random(5)
    for _ in range(600):
        letters = rng.choice(["ab", "abcde", "abcdefghijklmnopqrstuvwxyz     eee", "é€x y"])
        a, b = ("".join(rng.choices(letters, k=rng.choice([0, 1, 7, 8, 9, 16, 40, 199, 200, 260]))) for _ in range(2))
        if a and rng.random() < 0.5:  # a copy with its halves exchanged and a few letters more
            k = rng.randrange(len(a))
            b = a[k:] + rng.choice(letters) + a[:k]
        want, need = ratio(a, b), rng.random()
        assert similarity.ratio(a, b) == want
        assert similarity.ratio(a, b, need) == want if want >= need else similarity.ratio(a, b, need) < need


def test_equal_texts_of_a_pool_meet_in_one_task(spark):
    records = spark.createDataFrame([(1, "crack in the wall"), (2, "pipe")], "record int, a string")
    pool = spark.createDataFrame([(n, "crack in a wall" if n % 2 else "pipes") for n in range(40)], "candidate long, b string").repartition(8, "candidate")
    got = similarity.scan(records, pool, 0.5)
    assert got.groupBy("record", "score").count().count() == 2 and got.count() == 40
    dealt = got.select(F.spark_partition_id().alias("part"), (F.col("candidate") % 2).alias("odd")).distinct()
    assert dealt.count() == 2  # equal texts meet in one task


def test_words_of_norms_are_found_once(spark):
    """However often a match needs them, each norm's text is looked at once."""
    shared_folder(spark)
    looked = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        looked.add(1)
        return text.split()

    side = lambda rows, key: spark.createDataFrame(rows, f"{key} int, text string, unit string").select(key, split("text").alias("words"), F.array(F.lit("1")).alias("numbers"), "unit", F.lit(None).cast("string").alias("polarity"), F.array().cast("array<int>").alias("materials"))
    items = spark.createDataFrame([(1, ["brick", "wall"], "m2"), (2, ["pipe", "weld", "joint"], None)], "item_id int, words array<string>, unit string").withColumns({"numbers": F.array(F.lit("1")), "polarity": F.lit(None).cast("string"), "materials": F.array().cast("array<int>")})
    rows = [(k, t, u) for k, (t, u) in enumerate([("brick wall", "m2"), ("brick wall", "m3"), ("pipe weld", "m3"), ("joint", "m2"), ("roof", "m2")])]
    got = [(r.item_id, r.norm_id) for r in matching.jaccard_match(items, side(rows, "norm_id")).orderBy("item_id").collect()]
    assert got == [(1, 0), (2, 2)] and looked.value == len(rows)
    got = [(r.item_id, r.norm_id) for r in matching.overlap_match(items, side(rows, "norm_id")).orderBy("item_id").collect()]
    assert got == [(1, 0), (2, 2)] and looked.value == 2 * len(rows)


def test_runs_bound_what_difflib_matches():
    """A long record's bound is never below the score, and far below the common subsequence's where texts only share letters."""
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    tight = 0
    for n in range(300):
        b = " ".join(rng.choices(words, k=rng.randrange(60, 120)))
        a = rng.choice([lambda: " ".join(rng.choices(words, k=rng.randrange(90))), lambda: b[: rng.randrange(len(b))] + "x" + b[rng.randrange(len(b)) :], lambda: " ".join(sorted(b.split())), lambda: "ab" * rng.randrange(300), lambda: ""])()
        b = rng.choice([b, "ab" * 150, "a" * 230, "abc" + b])
        score = ratio(a, b)
        assert similarity.ratio(a, b) == score
        block = similarity.Block([0], [b])
        bound = similarity.Scorer(block, a, "chars", False, 0.0).bound[0]
        assert bound >= score
        common = block.tighter("whole", np.ones(1), a, 0.0, True)[0]
        tight += bound < 0.6 * common
    assert tight > 30


def test_one_file_is_dealt_to_all_cores(spark):
    from tallyforge.session import spread

    cores = spark.sparkContext.defaultParallelism
    rows = spread(spark.range(100).coalesce(1))
    assert rows.rdd.getNumPartitions() >= cores and {r.id for r in rows.collect()} == set(range(100))
    assert spread(spark.range(100, numPartitions=cores + 1)).rdd.getNumPartitions() == cores + 1


def test_equal_texts_are_scored_once_over_all_batches(spark, tmp_path, monkeypatch):
    """Copies of a text in many batches cost one comparison, and each still gets its pair."""
    log = tmp_path / "scored"
    scorer = similarity.Scorer.__init__

    def noted(self, block, text, *args):
        with log.open("a") as out:
            out.write(f"{text}\n")
        scorer(self, block, text, *args)

    monkeypatch.setattr(similarity.Scorer, "__init__", noted)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pool = spark.range(120).select(F.col("id").alias("candidate"), F.concat(F.lit("a wall with crack "), F.col("id") % 3).alias("b"))
        found = similarity.scan(spark.createDataFrame([(1, "a wall with crack 1")], "record long, a string"), pool, 0.55).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(r.candidate for r in found) == list(range(120))
    assert len(log.read_text().split("\n")) - 1 == 3
