"""Substring and suffix dedup and the Jaccard join against brute force, on awkward rows and whole small tables."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_pipeline import keep_one_of_each_group
from tallyforge.llm.arrays import NOT_SPACE, buffers, ids, window_hashes, window_starts, word_bounds, word_hashes
from tallyforge.llm.cells import deal, shared
from tallyforge.llm.components import components
from tallyforge.llm.jaccard_join import jaccard_groups, tile_links
from tallyforge.llm.queries import QUERIES
from tallyforge.llm.substring_dedup import COVERS, dedup_substrings
from tallyforge.llm.suffix_array import suffix_array
from tallyforge.llm.suffix_dedup import dedup_suffixes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("v", COVERS)
def test_covers(v):
    d = COVERS[v]
    assert all(any((i + k) % v in d and (j + k) % v in d for k in range(v)) for i in range(v) for j in range(v))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=12) | st.none(), max_size=6))
def test_words(texts):
    import pyarrow as pa

    data, offsets = buffers(pa.array(texts, pa.string()))
    starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
    raw = data.tobytes()
    got = [[raw[s:e] for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    h = word_hashes(data, starts, ends)
    words = [w for g in got for w in g]
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(i))
    at, two = window_starts(first, 2), window_hashes(h, 2)
    assert [words[i : i + 2] for i in at] == [g[i : i + 2] for g in got for i in range(len(g) - 1)]
    assert all((two[i] == two[j]) == (words[i : i + 2] == words[j : j + 2]) for i in at for j in at)


def by_rows(rows, big, cut, window):
    """Brute force: kept units, counts and runs of each row."""
    key = lambda r: big if r[0] is None else r[0]
    own = {}
    for r in sorted(rows, key=key):
        u = cut(r[1])
        for k in range(len(u) - window + 1):
            own.setdefault(tuple(u[k : k + window]), key(r))
    out = []
    for r in rows:
        u = cut(r[1])
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if own[tuple(u[k : k + window])] < key(r):
                gone[k : k + window] = [True] * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(u), sum(gone), runs, [x for x, g in zip(u, gone) if not g]))
    return out


def key(r):
    return tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("window", [50, 9, 2])
def test_substrings(nasty, rows, big, window):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(nasty, window).collect()]
    want = [(i, n, g, b" ".join(k).decode()) for i, n, g, _, k in by_rows(rows, big, lambda t: (t or "").encode().split(), window)]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffixes(nasty, rows, big, hot):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_suffixes(nasty, 50, hot_docs=hot).collect()]
    want = [(i, n, g, s, bytes(k)) for i, n, g, s, k in by_rows(rows, big, lambda t: (t or "").encode(), 50)]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffixes_of_an_id_with_a_copy_and_another_text(spark, big, hot):
    rng = random.Random(11)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(30)) for x in "abc")
    rows = [(5, a), (7, a), (7, b), (9, f"start {b} end"), (7, None), (3, c), (7, c), (None, b), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_suffixes(docs, 50, hot_docs=hot).collect()]
    want = [(i, n, g, s, bytes(k)) for i, n, g, s, k in by_rows(rows, big, lambda t: (t or "").encode(), 50)]
    assert (7, len(b), 0, 0, b.encode()) in want and sorted(got, key=key) == sorted(want, key=key)


def groups(pairs_of, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs_of:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def shingles(text, size=5):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def expected_groups(rows, big, percent=75):
    sets = [(big if r[0] is None else r[0], shingles(r[1])) for r in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    label = groups(links, {i for i, _ in sets})
    null = lambda x: None if x == big else x
    return sorted(((null(i), len(s), null(label[i] if s else i)) for i, s in sets), key=key)


@pytest.mark.parametrize("tile", [1000, 2])
def test_jaccard(nasty, rows, big, tile):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(nasty, tile_docs=tile).collect()]
    assert sorted(got, key=key) == expected_groups(rows, big)


def test_jaccard_broadcasts_no_table(spark, nasty, rows, sf_dir, tmp_path):
    """Tables that grow with the input meet by merge; none passes through the driver, however small it is here."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert jaccard_groups(nasty).count() == len(rows)
    nasty.write.parquet(str(tmp_path / "docs"))
    keep_one_of_each_group(spark, spark.read.parquet(str(tmp_path / "docs")), sf_dir).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())][before:]
    assert plans and any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)


def test_tile_bound_loses_nothing():
    rng = random.Random(3)
    sets = []
    for _ in range(60):
        base = rng.sample(range(10_000), rng.randrange(4, 40))
        for _ in range(2):
            sets.append(np.array(sorted(set(base[: rng.randrange(len(base) * 3 // 4, len(base) + 1)] + rng.sample(range(10_000), rng.randrange(3)))), np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sets = [np.sort(s) for s in sets]
    ids = np.arange(len(sets))
    found = tile_links(ids, np.full(len(sets), 2), sets, 75)
    true = [(i, j) for i in ids for j in ids[:i] if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    assert groups(found, ids) == groups(true, ids)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100}


def test_empty_tables(empty):
    assert dedup_substrings(empty).count() == dedup_suffixes(empty).count() == jaccard_groups(empty).count() == 0


def test_queries_on_whole_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op10_substring_dedup"](spark, sf_dir).collect()}
    assert got == {(i, n, g, hashlib.sha256(b" ".join(k)).hexdigest()) for i, n, g, _, k in by_rows(docs, 1 << 62, lambda t: (t or "").encode().split(), 50)}
    got = sorted((tuple(r) for r in QUERIES["op8_jaccard_join"](spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()), key=key)
    assert got == expected_groups(docs, 1 << 62)
    got = {tuple(r) for r in QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()}
    assert got == {(i, n, g, s, hashlib.sha256(bytes(k)).hexdigest()) for i, n, g, s, k in by_rows(docs, 1 << 62, lambda t: (t or "").encode(), 50)}


def test_relay_of_the_exchange_changes_nothing(nasty):
    """Fingerprints that cells share are the same whether a cell writes to buckets or to routes."""
    texts, _ = deal(nasty)
    texts = texts.withColumn("cell", F.pmod(F.xxhash64("text"), F.lit(5)).cast("int"))

    def keys_of(table):
        at, out = ids(table["doc_id"]), [(d, w) for d, t in zip(ids(table["doc_id"]).tolist(), table["text"].to_pylist()) for w in (t or "").split()]
        data, offsets = buffers(pa.array([" ".join(w for _, w in out)]))
        starts, ends, _ = word_bounds(data, offsets, NOT_SPACE)
        return np.array([d for d, _ in out], at.dtype), word_hashes(data, starts, ends)

    def told(routes):
        return {(r.cell, int(k), int(n)) for r in shared(texts, keys_of, 37, routes=routes).collect() for k, n in zip(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r.df, np.uint32))}

    assert told(4096) == told(37) == told(4) and len(told(4)) > 100


def test_rows_without_an_id_are_spread(spark):
    docs = spark.createDataFrame([(None, f"{i} " + "long text " * 20_000) for i in range(80)], "doc_id long, text string")
    assert deal(docs)[0].groupBy("cell").count().count() > 2


def test_the_driver_returns_memory_at_steps_and_within_long_ones(spark, monkeypatch):
    from tallyforge.llm import cells

    cells.driver_gives_back(spark)  # the whole of it runs on this JVM
    times = []
    monkeypatch.setattr(cells, "driver_gives_back", times.append)
    assert cells.settle(spark.range(10)).count() == 10
    assert times == [spark]
    monkeypatch.setattr(cells, "QUIET_S", 0.05)
    with cells.quiet_driver(spark):
        time.sleep(0.5)
    assert len(times) > 3
