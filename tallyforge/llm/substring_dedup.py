"""Substring dedup by difference-cover anchors.

A word is removed if a window of `window` consecutive words that covers it also
starts in a document with a smaller id.  Two equal windows at word places i and
j share a shift d below the period with both i+d and j+d in the difference
cover, so it is enough to fingerprint anchors of window-period+1 words at cover
places.  Anchors that two documents share are then extended: every whole window
that holds one gets a 128-bit fingerprint, and the smallest document that owns
each decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import NO_ID, NOT_SPACE, buffers, covered, ids, isin_sorted, runs, window_hashes, window_starts, word_bounds, word_hashes
from .cells import BUCKETS_EACH, by_key, deal, group_edges, joined, shared, short

#: Perfect difference sets, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

OWNED = "bucket int, cell int, hi binary, lo binary, doc binary"
REPLY = "cell int, hi binary, lo binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def period_for(window: int) -> int:
    """The longest period whose anchors keep at least a third of the window."""
    return max(v for v in COVERS if v == 1 or 3 * v <= 2 * window)


def anchors(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors (word indexes at cover places of their document) and their fingerprints."""
    v = period_for(window)
    size = window - v + 1
    at = window_starts(first, size)
    doc = np.searchsorted(first, at, "right") - 1
    cover = np.zeros(v, bool)
    cover[list(COVERS[v])] = True
    at = at[cover[(at - first[doc]) % v]]
    return at, window_hashes(words, size)[at]


def reached(words: np.ndarray, first: np.ndarray, window: int, known: np.ndarray, buckets: int) -> np.ndarray:
    """First words of the windows that hold a shared anchor."""
    at, key = anchors(words, first, window)
    hit = at[isin_sorted(short(key, buckets), known)]
    if not len(hit):
        return hit
    v, n = period_for(window), len(words)
    near = np.zeros(n + v, bool)
    near[v - 1 :] = True  # place p of a window stands at p + v - 1
    near &= covered(n + v, hit, v)
    ok = window_starts(first, window)
    return ok[near[ok + v - 1]]


def removals(doc: np.ndarray, hi: np.ndarray, lo: np.ndarray, told_hi: np.ndarray, told_lo: np.ndarray) -> np.ndarray:
    """Which windows a smaller document owns: one of another cell (told) or of this one."""
    n = len(hi)
    h, low = np.concatenate([hi, told_hi]), np.concatenate([lo, told_lo])
    d = np.concatenate([doc, np.full(len(told_hi), np.iinfo(np.int64).min)])
    order = np.lexsort((low, h))
    a, b = h[order], low[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    least = np.empty(len(a), np.int64)
    if len(at):
        least[order] = np.repeat(np.minimum.reduceat(d[order], at), np.diff(np.append(at, len(a))))
    return least[:n] < doc


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and kept_text (kept words joined by one space).

    Words are runs of bytes other than ASCII white space.  A null text has no words
    and gives an empty kept_text.  A null id counts as after all others.  Rows that
    repeat an id do not remove each other's words.  Other columns are ignored, an
    empty table gives no rows, and texts of any length are treated whole.
    """
    texts, buckets = deal(docs, id_col, text_col)

    def hashed(data, offsets):
        starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
        return starts, ends, first, word_hashes(data, starts, ends)

    def keys_of(table: pa.Table):
        doc_id, out = ids(table["doc_id"]), []
        for i, _, data, offsets in runs(*buffers(table["text"])):
            _, _, first, words = hashed(data, offsets)
            at, key = anchors(words, first, window)
            out.append((doc_id[i + np.searchsorted(first, at, "right") - 1], key))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def windows(table: pa.Table, known: np.ndarray):
        """(run, document, place, fingerprint) of the windows that hold a shared anchor."""
        doc_id, known = ids(table["doc_id"]), np.unique(known)
        for i, j, data, offsets in runs(*buffers(table["text"])):
            starts, ends, first, words = hashed(data, offsets)
            at = reached(words, first, window, known, buckets)
            doc = doc_id[i + np.searchsorted(first, at, "right") - 1]
            lo = window_hashes(word_hashes(data, starts, ends, 2), window, 0xC2B2AE3D27D4EB4F)[at] if len(at) else np.empty(0, np.uint64)
            yield i, j, data, starts, ends, first, at, doc, window_hashes(words, window)[at] if len(at) else np.empty(0, np.uint64), lo

    def claim(table: pa.Table, told: pa.Table) -> pa.Table:
        found = [x[-3:] for x in windows(table, joined(told["keys"], np.uint64))] if told.num_rows and table.num_rows else []
        doc, hi, lo = (np.concatenate([x[k] for x in found]) if found else np.empty(0, kind) for k, kind in enumerate((np.int64, np.uint64, np.uint64)))
        bucket = hi % np.uint64(buckets)
        order = np.lexsort((doc, lo, hi, bucket))
        doc, hi, lo, bucket = doc[order], hi[order], lo[order], bucket[order]
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        doc, hi, lo, bucket = doc[new], hi[new], lo[new], bucket[new]
        edges = np.append(group_edges(bucket), len(bucket)).tolist()
        out = [(int(bucket[a]), hi[a:b].tobytes(), lo[a:b].tobytes(), doc[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
        cell = table["cell"][0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "cell": pa.array([cell] * len(out), pa.int32())} | {c: pa.array([x[k] for x in out], pa.binary()) for k, c in ((1, "hi"), (2, "lo"), (3, "doc"))})

    def meet(table: pa.Table) -> pa.Table:
        size = [len(x) // 8 for x in table["hi"].to_pylist()]
        hi, lo, doc = joined(table["hi"], np.uint64), joined(table["lo"], np.uint64), joined(table["doc"], np.int64)
        none = np.empty(0, np.uint64)
        lost, out, i = removals(doc, hi, lo, none, none), [], 0
        for cell, n in zip(table["cell"].to_pylist(), size):
            s = lost[i : i + n]
            if s.any():
                out.append((cell, hi[i : i + n][s].tobytes(), lo[i : i + n][s].tobytes()))
            i += n
        return pa.table({"cell": pa.array([x[0] for x in out], pa.int32()), "hi": pa.array([x[1] for x in out], pa.binary()), "lo": pa.array([x[2] for x in out], pa.binary())})

    def settle(table: pa.Table, told: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": []}
        known = joined(told["keys"].drop_null(), np.uint64) if told.num_rows else np.empty(0, np.uint64)
        told_hi, told_lo = (joined(told[c].drop_null(), np.uint64) for c in ("hi", "lo"))
        kept_runs = list(windows(table, known))
        lost = removals(*(np.concatenate([x[k] for x in kept_runs]) for k in (-3, -2, -1)), told_hi, told_lo) if kept_runs else None
        at0, texts_ = 0, table["text"]
        for i, j, data, starts, ends, first, at, *_ in kept_runs:
            hit = at[lost[at0 : at0 + len(at)]]
            at0 += len(at)
            gone = covered(int(first[-1]), hit, window)
            n_words = np.diff(first)
            n_gone = np.diff(np.concatenate(([0], np.cumsum(gone)))[first])
            raw = data.tobytes()
            for k in range(j - i):
                a, b = int(first[k]), int(first[k + 1])
                if n_gone[k]:
                    keep = a + np.flatnonzero(~gone[a:b])
                    text = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())])
                else:
                    text = b" ".join((texts_[i + k].as_py() or "").encode().split())
                out["kept_text"].append(text.decode())
            out["n_words"] += n_words.tolist()
            out["n_removed"] += n_gone.tolist()
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["kept_text"], pa.string())})

    known = shared(texts, keys_of, buckets)
    by_cell = texts.groupBy("cell")
    owned = by_cell.cogroup(known.groupBy("cell")).applyInArrow(claim, OWNED)
    replies = known.select("cell", "keys").unionByName(by_key(owned, "bucket", buckets // BUCKETS_EACH).groupBy("bucket").applyInArrow(meet, REPLY), allowMissingColumns=True)
    return by_cell.cogroup(replies.groupBy("cell")).applyInArrow(settle, RESULT)


def kept_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
