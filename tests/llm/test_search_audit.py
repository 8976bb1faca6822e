"""Lexical search, toxicity and the filter audit against brute force and SQL."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm.filter_audit import filter_audit
from tallyforge.llm.lexical_search import SPAN, lexical_search, max_score
from tallyforge.llm.queries import ORACLE_SQL, QUERIES
from tallyforge.llm.quality_classifier import fold_zero
from tallyforge.llm.toxicity import CLEAN, TOXIC, VOTERS, estimate, score_toxicity

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, rank string, score string"


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def best(texts, query, k):
    """[(score, row)] of the k best rows by the formula, term by term."""
    terms = [TERM.findall((t or "").translate(FOLD)) for t in texts]
    n_docs, total = sum(map(bool, terms)), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(x for c in counts for x in c)
    scores = [0] * len(texts)
    for x in TERM.findall((query or "").translate(FOLD)):
        w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
        for i, c in enumerate(counts):
            if c[x]:
                m = 100 - 75 + (75 * len(terms[i]) * n_docs) // total
                scores[i] += w * ((1000000000 * c[x]) // (1000 * c[x] + 8 * m))
    return scores


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 60, "shard_bytes": 900}])
def test_search_on_awkward_rows(spark, nasty, rows, sizes):
    items = [(1, "w1 w2 W3 w3 w17"), (2, None), (3, ""), (4, "nothing-known"), (5, rows[3][1]), (1, "ONE two"), (6, "é same"), (None, "w5 w5 w5"), (7, "w1 " * 40)]
    got = lexical_search(nasty, spark.createDataFrame([(*i, "r", "s") for i in items], ITEMS), k=5, **sizes).collect()
    texts = [r[1] for r in rows]
    found = defaultdict(list)
    for r in got:
        found[r.item_id].append((r["rank"], r.doc_id, r.score))
    want = defaultdict(list)
    for item, text in items:
        ranked = sorted(((-s, r[0] is None, r[0] or 0) for s, r in zip(best(texts, text, 5), rows) if s > 0))[:5]
        want[item] += [(k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(ranked)]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert {k: sorted(v, key=order) for k, v in found.items()} == {k: sorted(v, key=order) for k, v in want.items() if v}


def test_search_of_empty_tables(spark, nasty, empty):
    some = spark.createDataFrame([(1, "w1", None, None)], ITEMS)
    assert lexical_search(empty, some).count() == 0 and lexical_search(nasty, some.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 12))
def test_max_score_equals_all_sums(seed, n_lists, k):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3 * SPAN))
    lists = []
    for i in range(n_lists):
        places = np.flatnonzero(rng.random(n) < rng.choice([0.002, 0.05, 0.6]))
        lists.append((places, rng.integers(1, 2 + 4**i, len(places))))
    sums = np.zeros(n, np.int64)
    for places, adds in lists:
        sums[places] += adds
    want = sorted((-int(s), i) for i, s in enumerate(sums) if s)[:k]
    for floor in (0, -want[-1][0] if len(want) == k else 0):
        places, scores = max_score(lists, np.arange(n), k, floor)
        assert list(zip((-scores).tolist(), places.tolist())) == want


def test_label_model_finds_accuracies_and_correlated_voters():
    """Voters of known accuracy, of which one repeats another: its copy must not count as a second opinion."""
    rng = np.random.default_rng(1)
    n = 20000
    y = rng.random(n) < 0.3
    votes = np.zeros((n, len(VOTERS)), np.int64)
    hit = {0: (0.7, 0.02), 2: (0.6, 0.05), 3: (0.5, 0.01), 4: (0.4, 0.2)}
    for v, (of_toxic, of_clean) in hit.items():
        votes[rng.random(n) < np.where(y, of_toxic, of_clean), v] = TOXIC
    votes[:, 5] = votes[:, 4]
    votes[(votes == TOXIC).sum(1) == 0, VOTERS.index("nothing")] = CLEAN
    label = np.where(rng.random(n) < 0.2, y, -1)
    model = estimate(votes, label, np.ones(n))
    p = model.posterior(votes)
    assert ((p >= 0.5) == y).mean() > 0.9 and abs(model.prior - 0.3) < 0.05
    assert 4 in (model.parent[5],) or 5 in (model.parent[4],)
    accuracy = model.accuracies(votes, np.ones(n))
    for v, (of_toxic, of_clean) in hit.items():
        right = 0.3 * of_toxic / (0.3 * of_toxic + 0.7 * of_clean)
        assert abs(accuracy[VOTERS[v]] - right) < 0.15
    twice = np.zeros((1, len(VOTERS)), np.int64)
    twice[0, [4, 5]] = TOXIC
    assert model.posterior(twice)[0] < 0.5  # toxic if these were two opinions


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.toxic is not None]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([np.mean(np.array(clean) < t) for t in toxic]) > 0.95
    assert np.mean([t >= 0.5 for t in toxic]) > 0.85 and np.mean([c >= 0.5 for c in clean]) < 0.02


def test_held_out_labels_teach_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(fold_zero(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in score_toxicity(docs, x, held_out=fold_zero()).collect()} for x in (labels, turned))
    assert a == b


def test_toxicity_on_awkward_rows(spark, nasty, rows, empty, sf_dir):
    labels = spark.createDataFrame([(r[0], int(k % 5 == 0), int(k % 3 == 0)) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = score_toxicity(nasty, labels, held_out=fold_zero()).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(empty, labels).count() == 0
    assert score_toxicity(nasty, labels.limit(0)).count() == len(rows)


def audit(rows, labels):
    """The audit by the letter: every order applied to every document."""
    first, fails = {}, []
    key = lambda i: (i is None, i or 0)
    for r in rows:
        text = r[1] or ""
        first[text] = min(first.get(text, (True, 1)), key(r[0]))
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": first[text] < key(r[0])}
        fails.append((r[2] or "", {f for f, x in tests.items() if x}, *labels.get(r[0], (0, 0))))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(own)))
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in own[i][0]]
                failing = [i for i in range(len(own)) if f in own[i][0]]
                left = [i for i in left if f not in own[i][0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(own[i][0] == {f} for i in failing), sum(own[i][1] == 1 for i in gone), sum(own[i][2] == 1 for i in gone)]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def test_audit_on_awkward_rows(spark, nasty, rows, empty):
    extra = [(500, "AB " * 250 + "#", "x", None, 1, None, None, None), (500, "AB " * 250 + "#", "x", None, 1, None, None, None), (501, "AB " * 250 + "#", "x", None, 1, None, None, None), (None, "AB " * 250 + "#", "y", None, 1, None, None, None), (502, " ".join(f"v{i}" for i in range(300)), "x", None, 1, None, None, None)]
    ids = sorted({r[0] for r in [*rows, *extra] if r[0] is not None})
    labels = {i: (k % 2, k % 3 % 2) for k, i in enumerate(ids) if k % 4}
    docs = nasty.unionByName(spark.createDataFrame(extra, nasty.schema))
    table = spark.createDataFrame([(i, *x) for i, x in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit(docs, table).collect()}
    assert got == audit([*rows, *extra], labels)
    assert filter_audit(empty, table).count() == 0


def test_audit_reads_files_of_any_columns(spark, tmp_path, nasty, rows):
    nasty.write.parquet(str(tmp_path / "d"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit(spark.read.parquet(str(tmp_path / "d")), none, part_col="source").where("filter_order = 'EDCBA'").collect()
    want = audit([(r[0], r[1], r[3]) for r in rows], {})
    assert {(r.part, r.filter_order, r.step): r.removed for r in got} == {k: v[1] for k, v in want.items() if k[1] == "EDCBA"}
