"""Quality classifier learnt from trusted positives and unlabelled web text.

A small network minimises the non-negative unbiased risk of positive-unlabelled
learning: with class prior p, p * loss(P as good) + max(0, loss(U as bad) -
p * loss(P as bad)).  The prior is estimated from the same two samples: no region
can hold a smaller share of the unlabelled text than p times its share of the
positives, so the smallest such ratio bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_SPACE, buffers, give_back, runs, window_hashes, window_starts, word_bounds, word_hashes
from .cells import settle

#: Most rows of each sample that the network is fitted on.
SAMPLE_ROWS = 20_000
HIDDEN, STEPS, RATE, SEED = 16, 400, 0.02, 7
#: The prior's region holds this share of the positives at least.
LEAST_REGION = 0.25

_CLASS = np.full(256, 7, np.uint8)  # 7: other bytes of other scripts
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[:9], _CLASS[14:32], _CLASS[127] = 6, 6, 6
for _c in b"#*$%&|<>@^~`_=+{}[]\\/":
    _CLASS[_c] = 5
for _c in b".,;:!?'\"()-":
    _CLASS[_c] = 6
_CLASSES = 8


def distinct_by(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each document has."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return np.bincount(d[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text: its length, kinds of characters, words, lines and repetition."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc_of * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
    n_words = np.diff(first)
    word_doc = np.repeat(np.arange(n), n_words)
    words = word_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    per = lambda x: np.bincount(word_doc, x, minlength=n) / np.maximum(n_words, 1)
    end_kind, begin_kind = _CLASS[data[ends - 1]] if len(ends) else ends, _CLASS[data[starts]] if len(ends) else ends
    inner = _CLASS[data[np.minimum(starts + 1, ends - 1)]] if len(ends) else ends
    mean = per(length)
    spread = np.sqrt(np.maximum(per(length**2) - mean**2, 0))
    at = window_starts(first, 3)
    grams = distinct_by(word_doc[at], window_hashes(words, 3)[at], n)
    n_grams = np.bincount(word_doc[at], minlength=n)
    is_line = np.ones(256, bool)
    is_line[10] = False
    l_starts, l_ends, l_first = word_bounds(data, offsets, is_line)
    n_lines = np.diff(l_first)
    lines = distinct_by(np.repeat(np.arange(n), n_lines), word_hashes(data, l_starts, l_ends), n)
    share = kinds / np.maximum(size, 1)[:, None]
    columns = [
        np.log1p(n_words), np.log1p(n_lines), np.log1p(n_words / np.maximum(n_lines, 1)), *np.sqrt(share).T, mean / 8, spread / 8, per((length > 20).astype(float)), per((length <= 1).astype(float)),
        per((end_kind == 5).astype(float)), per((end_kind == 6).astype(float)), per((begin_kind == 1).astype(float)), per(((begin_kind == 1) & (inner == 1)).astype(float)), per((begin_kind == 5).astype(float)),
        distinct_by(word_doc, words, n) / np.maximum(n_words, 1), 1 - grams / np.maximum(n_grams, 1), 1 - lines / np.maximum(n_lines, 1),
    ]
    return np.column_stack(columns)


@dataclass
class Model:
    """A network with one hidden layer over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def minimise(model: Model, x: np.ndarray, slope, decay: float, steps: int = STEPS) -> None:
    """Full-batch Adam; slope gives the risk's derivative by each row's margin."""
    x = np.clip((x - model.centre) / model.scale, -8, 8)
    names, m, v = ("w1", "b1", "w2", "b2"), {}, {}
    for step in range(1, steps + 1):
        h = np.tanh(x @ model.w1 + model.b1)
        g = slope(h @ model.w2 + model.b2)
        back = np.outer(g, model.w2) * (1 - h * h)
        for k, d in zip(names, (x.T @ back + decay * model.w1, back.sum(0), h.T @ g + decay * model.w2, g.sum())):
            m[k] = 0.9 * m.get(k, 0) + 0.1 * d
            v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
            setattr(model, k, getattr(model, k) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model of the positive class; without positives or unlabelled rows, one that scores everything 1."""
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 30.0)
    x, n = np.vstack([positive, unlabelled]), len(positive)
    rng = np.random.default_rng(SEED)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    fresh = lambda: Model(centre, scale, rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0)
    decay = 0.02 * np.sqrt(1000 / len(x))
    z = np.empty(len(x))
    for fold in (0, 1):  # rough models of positives against the unlabelled rank the rows they have not seen, for the prior
        seen = np.arange(len(x)) % 2 == fold
        if seen[:n].all() or seen[n:].all() or not seen[:n].any() or not seen[n:].any():
            seen = np.ones(len(x), bool)
        k = int(seen[:n].sum())

        def logistic(m, k=k):
            p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
            return np.concatenate([(p[:k] - 1) / k, p[k:] / (len(m) - k)])

        rough = fresh()
        minimise(rough, x[seen], logistic, decay, STEPS // 4)
        rest = ~seen if not seen.all() else seen
        z[rest] = rough.margin(x[rest])
    at = np.quantile(z[:n], np.linspace(0, 1 - LEAST_REGION, 50))
    prior = float(np.clip(min((z[n:] >= t).mean() / (z[:n] >= t).mean() for t in at), 0.05, 0.99))
    model = fresh()

    def pu(z):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # the sigmoid loss of a row taken as bad; as good it is 1 - p
        d = p * (1 - p)
        gap = p[n:].mean() - prior * p[:n].mean()
        turn = 1.0 if gap >= 0 else -1.0  # a negative part is pushed up, not followed
        good = -d[:n] * prior / n if gap >= 0 else np.zeros(n)
        return np.concatenate([good - turn * prior * d[:n] / n, turn * d[n:] / (len(z) - n)])

    minimise(model, x, pu, decay)
    model.prior = prior
    return model


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(data, offsets) for _, _, data, offsets in runs(*buffers(batch["text"]))]
            x = np.concatenate(rows) if rows else np.empty((0, 1))
            yield pa.record_batch({"doc_id": batch["doc_id"], "x": pa.array(list(x), pa.list_(pa.float64()))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def first_by_hash(ids: DataFrame, most: int, salt: int) -> DataFrame:
    """At most so many of the ids (column doc_id), the first by a hash; only about so many leave their partitions."""
    h = F.xxhash64("doc_id", F.lit(salt))
    share = 1.2 * most / max(ids.count(), 1) + 1e-4
    some = ids if share >= 1 else ids.where(h < int((2 * share - 1) * 2**63))
    return some.orderBy(h, "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most sample_rows trusted positives (quality 1 and never 0) and as many rows taken as unlabelled, the first by a hash of their id.

    The ids are chosen first, so only the chosen texts are looked at; an id with several
    rows teaches by one of them.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null").where(may_learn)
    ids = rows.select("doc_id").distinct()
    trusted = settle(ids.join(known, "doc_id"))
    chosen = settle(first_by_hash(trusted, sample_rows, 1).withColumn("positive", F.lit(True)).unionByName(first_by_hash(settle(ids), sample_rows, 2).withColumn("positive", F.lit(False))))
    roles = chosen.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.min("positive").alias("both"))
    texts = rows.join(F.broadcast(roles), "doc_id").groupBy("doc_id", "positive", "both").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most two samples of ids are broadcast
    stats = statistics(texts).join(F.broadcast(roles), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    take = lambda want: np.array([r.x for r in stats if want(r)])
    positive, unlabelled = take(lambda r: r.positive), take(lambda r: not r.both)
    width = max(x.shape[1] if x.ndim == 2 else 1 for x in (positive, unlabelled))
    return fit(positive.reshape(-1, width), unlabelled.reshape(-1, width))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher is better), predicted (1 if score >= threshold).

    Only labelled rows outside held_out (a condition on doc_id) teach the model; scores
    come from the text alone.  Empty and null texts are scored like any other.  Rows
    that repeat an id are scored each; a null id is never learnt from.  Other columns
    are ignored; an empty table gives no rows; without usable labels every score is 1.
    """
    model = train(docs, labels, ~held_out if held_out is not None else F.lit(True), id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.score(features(data, offsets)) for _, _, data, offsets in runs(*buffers(batch["text"]))]
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(np.concatenate(rows) if rows else [], pa.float64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold_zero(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0; not those without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def keep_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more; otherwise as score_quality."""
    model = train(docs, labels, ~held_out if held_out is not None else F.lit(True), id_col=id_col, text_col=text_col)

    def good(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in runs(*buffers(batch[text_col])):  # a run at a time, so no second batch stands beside the first
            yield batch.slice(i, j - i).filter(pa.array(model.score(features(data, offsets)) >= threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from good(batch)
            del batch
            give_back()

    return docs.mapInArrow(run, docs.schema)
