"""Ranked lexical search: MaxScore over the shards of an inverted index.

Tasks turn their documents into shards of bounded size: for each term the shard's
documents and counts, as plain arrays in one row.  The rows give the corpus counts; a
query's terms get their weights from these.  Then each shard is searched by itself.
Terms are ordered by the most that they can add to a score in this shard; those whose
bounds together stay below the current k-th best score are non-essential: documents come
only from the other terms' lists, and are looked up in a non-essential list only while
they can still reach that score.  The shards' best are merged per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, NO_ID, buffers, group_bounds, ids, isin_sorted, runs, word_bounds, word_hashes
from .cells import settle

#: A shard holds about this many bytes of text.
SHARD_BYTES = 16 << 20
#: Queries are searched in blocks of about this many bytes of text; only such a block is sent to the tasks.
BLOCK_BYTES = 1 << 20
#: Documents of a shard that are scored together; the k-th best score grows from one span to the next.
SPAN = 2048

INDEX = "n_docs long, n_terms long, terms array<long>, df array<int>, doc_ids binary, lengths binary, docs binary, tfs binary"
FOUND = "query int, doc_id long, score long"


def counted_terms(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many terms each text has, and (text, term, occurrences) of those wanted (None: of all)."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    terms = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if wanted is not None:
        keep = isin_sorted(terms, wanted)
        terms, doc = terms[keep], doc[keep]
    order = np.lexsort((terms, doc))
    terms, doc = terms[order], doc[order]
    at = group_bounds(doc, terms)
    return np.diff(first), doc[at[:-1]], terms[at[:-1]], np.diff(at)


class Shard:
    """Documents gathered for one row of the index."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.docs, self.terms, self.tfs, self.size, self.bytes = [], [], [], [], [], 0, 0

    def add(self, ids_: np.ndarray, lengths: np.ndarray, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, size: int) -> None:
        self.ids.append(ids_), self.lengths.append(lengths.astype(np.uint32)), self.docs.append((docs + self.size).astype(np.uint32)), self.terms.append(terms), self.tfs.append(tfs.astype(np.uint32))
        self.size += len(ids_)
        self.bytes += size

    def row(self) -> pa.RecordBatch:
        ids_, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        by_id = np.argsort(ids_, kind="stable")
        place = np.empty(len(by_id), np.uint32)
        place[by_id] = np.arange(len(by_id), dtype=np.uint32)
        docs, terms, tfs = place[np.concatenate(self.docs)], np.concatenate(self.terms), np.concatenate(self.tfs)
        order = np.lexsort((docs, terms))
        docs, terms, tfs = docs[order], terms[order], tfs[order]
        at = group_bounds(terms)
        lengths = lengths[by_id]
        one = lambda x, kind: pa.array([x], kind)
        columns = [one(int((lengths > 0).sum()), pa.int64()), one(int(lengths.sum(dtype=np.int64)), pa.int64()), one(terms[at[:-1]].view(np.int64), pa.list_(pa.int64())), one(np.diff(at).astype(np.int32), pa.list_(pa.int32()))]
        blobs = [one(x.tobytes(), pa.binary()) for x in (ids_[by_id], lengths, docs, tfs)]
        return pa.record_batch([*columns, *blobs], names=[c.split()[0] for c in INDEX.split(", ")])


def lexical_index(docs: DataFrame, wanted: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per shard: its counts, its terms (fingerprints, sorted by their bits) with their documents, and its postings.

    Every document is in one shard.  With `wanted`, a sorted array of fingerprints, only
    the lists of these terms are kept; the counts are those of all terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            doc_ids = ids(batch["doc_id"])
            for i, j, data, offsets in runs(*buffers(batch["text"])):
                shard.add(doc_ids[i:j], *counted_terms(data, offsets, wanted), len(data))
                if shard.bytes >= shard_bytes:
                    yield shard.row()
                    shard = Shard()
        if shard.size:
            yield shard.row()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX)


class Queries:
    """A block of queries: each one's terms and what a term's weight is multiplied by."""

    def __init__(self, numbers: list[int], texts: list[str | None]) -> None:
        data, offsets = buffers(pa.array(texts, pa.string()))
        _, of, terms, times = counted_terms(data, offsets, None)
        self.numbers, self.of, self.terms, self.times = numbers, of, terms, times
        self.vocabulary = np.unique(terms)
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        """floor(1000 * ln((2 N + 2) / (2 df + 1))) of each term."""
        for k, term in enumerate(self.vocabulary.view(np.int64).tolist()):
            self.weights[k] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(term, 0) + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count adds to a score, before the term's weight."""
    m = 100 - 75 + (75 * lengths.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], doc_ids: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents (places in doc_ids, scores) by the sum of their entries in the lists (sorted places, what each adds).

    Equal scores go by ascending doc_id, in which order the places are; only scores above 0
    count.  floor is a score that the k-th best is known to reach.
    """
    bounds = np.array([x.max() if len(x) else 0 for _, x in lists], np.int64)
    lists = [lists[i] for i in np.argsort(bounds, kind="stable")]
    total = np.concatenate(([0], np.cumsum(np.sort(bounds, kind="stable"))))  # the most that the first lists add together
    best, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    least = max(floor, 1)
    for lo in range(0, len(doc_ids), SPAN):
        hi = min(lo + SPAN, len(doc_ids))
        essential = int(np.searchsorted(total, least, "left")) - 1  # lists before this one can't reach the score together
        if essential >= len(lists):
            break
        sums, seen = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
        for places, adds in lists[essential:]:
            a, b = np.searchsorted(places, (lo, hi))
            at = places[a:b] - lo
            sums[at] += adds[a:b]
            seen[at] = True
        at = np.flatnonzero(seen)
        own = sums[at]
        for i in range(essential - 1, -1, -1):
            can = own + total[i + 1] >= least
            at, own = at[can], own[can]
            if not len(at):
                break
            places, adds = lists[i]
            a, b = np.searchsorted(places, (lo, hi))
            p = a + np.searchsorted(places[a:b], at + lo)
            hit = np.flatnonzero(p < b)
            hit = hit[places[p[hit]] == at[hit] + lo]
            own[hit] += adds[p[hit]]
        can = own >= least
        if can.any():
            best, scores = np.concatenate((best, at[can] + lo)), np.concatenate((scores, own[can]))
            order = np.lexsort((best, -scores))[:k]
            best, scores = best[order], scores[order]
            if len(best) == k:
                least = max(least, int(scores[-1]))
    return best, scores


def search_shard(row: dict, queries: Queries, k: int, n_docs: int, n_terms: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, doc_ids, scores) of the best of one shard for each query."""
    terms = np.array(row["terms"], np.int64).view(np.uint64)
    ends = np.cumsum(np.array(row["df"], np.int64))
    doc_ids, lengths, docs, tfs = (np.frombuffer(row[c], kind) for c, kind in (("doc_ids", np.int64), ("lengths", np.uint32), ("docs", np.uint32), ("tfs", np.uint32)))
    held: dict[int, tuple[np.ndarray, np.ndarray, int] | None] = {}

    def postings(number: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """A term's places, what each adds, and the k-th largest of that."""
        if number not in held:
            at = int(np.searchsorted(terms, queries.vocabulary[number]))
            if at == len(terms) or terms[at] != queries.vocabulary[number] or not queries.weights[number]:
                held[number] = None
            else:
                b = int(ends[at])
                a = b - row["df"][at]
                places = docs[a:b].astype(np.int64)
                adds = queries.weights[number] * impacts(tfs[a:b], lengths[places], n_docs, n_terms)
                held[number] = places, adds, int(np.partition(adds, b - a - k)[b - a - k]) if b - a >= k else 0
        return held[number]

    numbers = np.searchsorted(queries.vocabulary, queries.terms).tolist()
    edges = np.searchsorted(queries.of, np.arange(len(queries.numbers) + 1)).tolist()
    for q, (a, b) in enumerate(zip(edges, edges[1:])):
        found = [(postings(t), times) for t, times in zip(numbers[a:b], queries.times[a:b].tolist())]
        found = [(p, times) for p, times in found if p]
        if found:
            best, scores = max_score([(p[0], p[1] * times) for p, times in found], doc_ids, k, max(p[2] * times for p, times in found))
            yield queries.numbers[q], doc_ids[best], scores


def search(index: DataFrame, queries: Queries, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(query, doc_id, score): each shard's k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].values.to_numpy() if c in ("terms", "df") else batch[c][i].as_py() for c in batch.schema.names}
                some = list(search_shard(row, queries, k, n_docs, n_terms))
                if some:
                    doc_id = np.concatenate([x for _, x, _ in some])
                    yield pa.record_batch({"query": pa.array(np.repeat([q for q, _, _ in some], [len(x) for _, x, _ in some]), pa.int32()), "doc_id": pa.array(doc_id, mask=doc_id == NO_ID), "score": pa.array(np.concatenate([x for _, _, x in some]))})

    return index.mapInArrow(run, FOUND)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's k best documents: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII digits, letters (upper case folded) and all characters beyond
    ASCII.  Only scores above 0 count, so an item may have fewer rows or none; equal scores
    go by ascending doc_id, a null id last.  Null and empty texts have no terms.  Every row
    of items is a query of its own, rows that repeat an id too; rows of docs that repeat an
    id are ranked each.  Other columns are ignored; empty tables give no rows.

    Items are dealt by hash into blocks of about block_bytes of text.  Each block is sent
    to all shards; where there is one block, shards keep its terms' lists only.
    """
    rows = settle(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id()))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    index, found = None, []
    for block in range(blocks):
        own = dealt.where(F.col("block") == block).orderBy("query").select("query", "text").collect()  # of a bounded size
        queries = Queries(list(range(len(own))), [r.text for r in own])
        if index is None:
            index = settle(lexical_index(docs, queries.vocabulary if blocks == 1 else None, shard_bytes, id_col, text_col))
            n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        spark = docs.sparkSession
        terms = spark.createDataFrame(pa.table({"term": pa.array(queries.vocabulary.view(np.int64))}))
        held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
        held = held.join(F.broadcast(terms), "term") if blocks > 1 else held
        queries.weigh({r.term: r.df for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}, n_docs or 0)
        numbers = spark.createDataFrame(pa.table({"query": pa.array(range(len(own)), pa.int32()), "of": pa.array([r["query"] for r in own], pa.int64())}))
        found.append(search(index, queries, k, n_docs or 0, n_terms or 1).join(F.broadcast(numbers), "query").select("of", "doc_id", "score"))
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    best = Window.partitionBy("of").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(rows.select(F.col("query").alias("of"), "item_id"), "of").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
