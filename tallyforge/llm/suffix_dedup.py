"""Suffix-array dedup of repeated byte strings across documents.

Every window of `window` bytes is represented by its minimizer, the smallest
fingerprint of its `gram`-byte substrings, so equal windows meet at equal
minimizers.  Neighbouring windows with the same minimizer make one piece of text.
Pieces whose minimizer two documents share are sent, each distinct piece once per
cell, to the task of that minimizer; where pieces differ, a suffix array over
them brings equal windows together, and the smallest document that owns each
decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NO_ID, buffers, covered, ids, isin_sorted, mix, runs, window_hashes, word_hashes
from .cells import BUCKETS_EACH, CELLS_EACH, by_key, dealt, group_edges, joined, shared, short
from .suffix_array import suffix_array

PIECES = "bucket int, cell int, keys binary, sids binary, least binary, most binary, sizes binary, bytes binary"
OWNERS = "cell int, sids binary, a binary, b binary, owner binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

#: A minimizer that so many documents have is split: each of its windows is a piece and a group of its own.
HOT_DOCS = 2000

_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED00))
_PLACE = 24
#: Stands for a piece's minimizer, which its key already tells; no UTF-8 text holds this byte.
MARK = b"\xff"


def pieces(data: np.ndarray, offsets: np.ndarray, use: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one minimizer: first window, last window, minimizer's place, its fingerprint."""
    n = len(data) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, np.empty(0, np.uint64)
    grams = window_hashes(_BYTE[data], gram)
    spread, begin, at = window - gram + 1, [], []
    block = (1 << _PLACE) - 4 * window
    for base in range(0, n, block):
        v = grams[base : base + block + spread - 1]
        v = (v & ~np.uint64((1 << _PLACE) - 1)) | np.arange(len(v), dtype=np.uint64)
        size = 1
        while size < spread:
            step = min(size, spread - size)
            v = np.minimum(v[:-step], v[step:])
            size += step
        at.append((v & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + base)
    at = np.concatenate(at)[:n]
    change = np.zeros(len(data) + 1, np.int32)  # windows within one document
    length = np.diff(offsets)
    some = (length >= window) & use
    np.add.at(change, offsets[:-1][some], 1)
    np.add.at(change, offsets[1:][some] - window + 1, -1)
    whole = np.cumsum(change)[:n] > 0
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    begin = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole)
    return begin, stop, at[begin], grams[at[begin]]


def apart(strings: list[bytes], window: int, parts: int = 6) -> list[list[int]]:
    """Groups of strings such that two of different groups share no window.

    Each string holds MARK once and each of its windows holds it too.  A window that begins
    o before MARK, with o in one of a few ranges, has the range's least o before it and
    so much after it that the range's greatest o leaves; strings without that context
    in common share no such window.
    """
    group, first, bounds = list(range(len(strings))), {}, [window * k // parts for k in range(parts + 1)]

    def top(k: int) -> int:
        while group[k] != k:
            group[k] = k = group[group[k]]
        return k

    for k, s in enumerate(strings):
        m = s.index(MARK)
        for low, high in zip(bounds, bounds[1:]):
            after = window - high
            if m >= low and len(s) - m - 1 >= after:
                other = first.setdefault((low, s[m - low : m + 1 + after]), k)
                if other != k:
                    group[top(k)] = top(other)
    found: dict[int, list[int]] = {}
    for k in range(len(strings)):
        found.setdefault(top(k), []).append(k)
    return list(found.values())


def owners_of(strings: list[bytes], least: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """For each of several distinct strings with one MARK, runs of window places and the smallest owner of each: (from, to, owner)."""
    own = [[d] * (len(s) - window + 1) for s, d in zip(strings, least)]
    for some in apart(strings, window):
        if len(some) == 1:
            continue
        text, string, place = [], [], []
        for k in some:
            s = strings[k]
            text += s
            text.append(-1 - k)  # ends differ, so no match crosses strings
            n = len(s) - window + 1
            string += [k] * n + [-1] * window  # -1: no window begins there
            place += range(len(s) + 1)
        last, run = None, []
        for i in suffix_array(text):
            k = string[i]
            if k < 0:
                continue
            p = place[i]
            s = strings[k][p : p + window]
            if s == last:
                run.append((k, p))
                continue
            if len(run) > 1:
                d = min(least[k] for k, _ in run)
                for x, y in run:
                    own[x][y] = d
            run, last = [(k, p)], s
        if len(run) > 1:
            d = min(least[k] for k, _ in run)
            for x, y in run:
                own[x][y] = d
    out = []
    for o in own:
        edges = [0, *(i for i in range(1, len(o)) if o[i] != o[i - 1]), len(o)]
        out.append([(a, b, o[a]) for a, b in zip(edges, edges[1:])])
    return out


def dedup_suffixes(docs: DataFrame, window: int = 50, gram: int = 24, hot_docs: int = HOT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay).

    A byte is removed if a string of `window` bytes that covers it also starts in a
    document with a smaller id.  A null text is empty.  A null id counts as after all
    others.  Rows that repeat an id do not remove each other's bytes.  Other columns
    are ignored, an empty table gives no rows, and texts are treated whole.
    """
    rows, cells, buckets = dealt(docs, id_col, text_col)
    texts = by_key(rows, "cell", cells // CELLS_EACH)
    marked = window - gram + 1  # a window's length with its minimizer as one symbol

    def keys_of(table: pa.Table, told: pa.Table):
        doc_id, copied, out = ids(table["doc_id"]), later_copies(table, told), []
        for i, j, data, offsets in runs(*buffers(table["text"])):
            begin, _, _, key = pieces(data, offsets, ~copied[i:j], window, gram)
            out.append((doc_id[i + np.searchsorted(offsets, begin, "right") - 1], key))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def found(table: pa.Table, known: np.ndarray, df: np.ndarray, copied: np.ndarray):
        """Pieces with a shared minimizer: run, its bytes, document index, first and last window, minimizer's place, key, piece's fingerprint."""
        known, at = np.unique(known, return_index=True)
        df = df[at]
        for i, j, data, offsets in runs(*buffers(table["text"])):
            begin, stop, place, key = pieces(data, offsets, ~copied[i:j], window, gram)
            tag = short(key, buckets)
            ok = isin_sorted(tag, known)
            begin, stop, place, key, tag = begin[ok], stop[ok], place[ok], key[ok], tag[ok]
            if len(begin):
                hot = df[np.searchsorted(known, tag)] >= hot_docs
                n = (stop - begin + 1)[hot]
                alone = np.repeat(begin[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own_key = word_hashes(data, alone, alone + window, 5) if len(alone) else np.empty(0, np.uint64)
                begin, stop, place, key = np.concatenate([begin[~hot], alone]), np.concatenate([stop[~hot], alone]), np.concatenate([place[~hot], alone]), np.concatenate([key[~hot], own_key])
            sid = word_hashes(data, begin, stop + window, 3) if len(begin) else np.empty(0, np.uint64)
            yield i, j, data, offsets, np.searchsorted(offsets, begin, "right") - 1, begin, stop, place, key, sid

    def claim(table: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and len(heard(told)[0]):
            doc_id, parts = ids(table["doc_id"]), []
            for i, _, data, _, doc, begin, stop, place, key, sid in found(table, *heard(told), later_copies(table, told)):
                order = np.lexsort((sid, key))
                at = order[group_edges_of(key[order], sid[order])]
                first = np.sort(at)
                raw = data.tobytes()
                text = [raw[a:m] + MARK + raw[m + gram : b] for a, m, b in zip(begin[first].tolist(), place[first].tolist(), (stop[first] + window).tolist())]
                parts.append((key, sid, doc_id[i + doc], first, text))
            key, sid, doc = (np.concatenate([p[k] for p in parts]) for k in range(3))
            text: dict[int, bytes] = {}
            base = 0
            for p in parts:
                text.update(zip((p[3] + base).tolist(), p[4]))
                base += len(p[0])
            bucket = (key >> np.uint64(32)) % np.uint64(buckets)
            order = np.lexsort((np.arange(len(key)), sid, key, bucket))
            at = group_edges_of(key[order], sid[order])
            if len(at):
                least, most = np.minimum.reduceat(doc[order], at), np.maximum.reduceat(doc[order], at)
                pick = order[at]
                k, s, b, t = key[pick], sid[pick], bucket[pick], [text[x] for x in pick.tolist()]
                size = np.array([len(x) for x in t], np.uint32)
                edges = np.append(group_edges(b), len(b)).tolist()
                out = [(int(b[x]), *(v[x:y].tobytes() for v in (k, s, least, most, size)), b"".join(t[x:y])) for x, y in zip(edges, edges[1:])]
        cell = table["cell"][0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "cell": pa.array([cell] * len(out), pa.int32())} | {c: pa.array([x[k + 1] for x in out], pa.binary()) for k, c in enumerate(("keys", "sids", "least", "most", "sizes", "bytes"))})

    def meet(table: pa.Table) -> pa.Table:
        counts = [len(x) // 8 for x in table["keys"].to_pylist()]
        key, sid, least, most = (joined(table[c], t) for c, t in (("keys", np.uint64), ("sids", np.uint64), ("least", np.int64), ("most", np.int64)))
        cell = np.repeat(np.asarray(table["cell"].to_numpy(), np.int64), counts)
        size, blob = joined(table["sizes"], np.uint32).astype(np.int64), b"".join(table["bytes"].to_pylist())
        at_byte = np.concatenate(([0], np.cumsum(size)))
        order = np.lexsort((sid, key))
        distinct = group_edges_of(key[order], sid[order])
        many = np.diff(np.append(distinct, len(order)))
        owner = np.minimum.reduceat(least[order], distinct) if len(distinct) else distinct
        top = np.maximum.reduceat(most[order], distinct) if len(distinct) else distinct
        pick = order[distinct]  # one of each distinct piece
        groups = group_edges(key[pick])
        ends = np.append(groups[1:], len(pick))
        low, high = (np.minimum.reduceat(owner, groups), np.maximum.reduceat(top, groups)) if len(groups) else (groups, groups)
        alone = (ends - groups == 1) & (high > low)
        one = groups[alone]
        # told: distinct piece, from, to, owner
        told = [np.column_stack((one, np.zeros(len(one), np.int64), size[pick[one]] - marked + 1, owner[one]))]
        for g, e in zip(groups[(ends - groups > 1) & (high > low)].tolist(), ends[(ends - groups > 1) & (high > low)].tolist()):
            strings = [blob[at_byte[x] : at_byte[x] + size[x]] for x in pick[g:e].tolist()]
            rows = [(g + k, a, b, d) for k, r in enumerate(owners_of(strings, owner[g:e].tolist(), marked)) for a, b, d in r if d < top[g + k]]
            if rows:
                told.append(np.array(rows, np.int64))
        told = np.concatenate(told)
        copies = many[told[:, 0]]
        row = np.repeat(np.arange(len(told)), copies)
        seat = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        to = order[distinct[told[row, 0]] + seat]
        ok = most[to] > told[row, 3]
        row, to = row[ok], to[ok]
        by_cell = np.lexsort((sid[to], cell[to]))
        row, to = row[by_cell], to[by_cell]
        edges = np.append(group_edges(cell[to]), len(to)).tolist()
        out = [(int(cell[to[x]]), sid[to[x:y]].tobytes(), told[row[x:y], 1].astype(np.uint32).tobytes(), told[row[x:y], 2].astype(np.uint32).tobytes(), told[row[x:y], 3].tobytes()) for x, y in zip(edges, edges[1:])]
        return pa.table({"cell": pa.array([x[0] for x in out], pa.int32())} | {c: pa.array([x[k + 1] for x in out], pa.binary()) for k, c in enumerate(("sids", "a", "b", "owner"))})

    def settle(table: pa.Table, told: pa.Table) -> pa.Table:
        doc_id, n_removed, n_spans, kept = ids(table["doc_id"]), [], [], []
        keys, df = heard(told)
        copied = later_copies(table, told)
        sids, a, b, owner = (joined(told[c].drop_null(), t) for c, t in (("sids", np.uint64), ("a", np.uint32), ("b", np.uint32), ("owner", np.int64)))
        order = np.argsort(sids, kind="stable")
        sids, a, b, owner = sids[order], a[order].astype(np.int64), b[order].astype(np.int64), owner[order]
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept": pa.array([], pa.binary())})
        n_bytes = []
        for i, j, data, offsets, doc, begin, _, _, _, sid in found(table, keys, df, copied):
            low, high = np.searchsorted(sids, sid, "left"), np.searchsorted(sids, sid, "right")
            n = high - low
            which = np.repeat(np.arange(len(sid)), n)
            r = np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            ok = doc_id[i + doc[which]] > owner[r]
            which, r = which[ok], r[ok]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, begin[which] + a[r], 1)
            np.add.at(change, begin[which] + b[r] - 1 + window, -1)
            gone = np.cumsum(change)[:-1] > 0
            size = np.diff(offsets)
            gone |= np.repeat(copied[i:j] & (size >= window), size)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            first[offsets[:-1][offsets[:-1] < len(data)]] = gone[offsets[:-1][offsets[:-1] < len(data)]]
            n_removed += np.diff(np.concatenate(([0], np.cumsum(gone)))[offsets]).tolist()
            n_spans += np.diff(np.concatenate(([0], np.cumsum(first)))[offsets]).tolist()
            n_bytes += np.diff(offsets).tolist()
            left = data[~gone].tobytes()
            at = np.concatenate(([0], np.cumsum(~gone)))[offsets].tolist()
            kept += [left[x:y] for x, y in zip(at, at[1:])]
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    # of equal texts only the one with the smallest id need be looked into
    digest = rows.select("cell", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    of_cell = digest.groupBy("digest", "cell").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))  # a hot text has one row a cell
    first = of_cell.groupBy("digest").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first != last").drop("last")
    later = of_cell.join(first, "digest").where("high != first").groupBy("cell").agg(F.collect_list(F.struct("first", "digest")).alias("copies"))
    copies = later.groupBy("cell").applyInArrow(as_binary, "cell int, copies binary, digests binary")
    by_cell = texts.groupBy("cell")
    known = shared(texts, keys_of, buckets, copies).unionByName(copies, allowMissingColumns=True)
    owned = by_cell.cogroup(known.groupBy("cell")).applyInArrow(claim, PIECES)
    replies = known.unionByName(by_key(owned, "bucket", buckets // BUCKETS_EACH).groupBy("bucket").applyInArrow(meet, OWNERS), allowMissingColumns=True)
    return by_cell.cogroup(replies.groupBy("cell")).applyInArrow(settle, RESULT)


def as_binary(table: pa.Table) -> pa.Table:
    copies = table["copies"].to_pylist()
    return pa.table({"cell": table["cell"], "copies": pa.array([np.array([x["first"] for x in c], np.int64).tobytes() for c in copies], pa.binary()), "digests": pa.array([b"".join(bytes.fromhex(x["digest"]) for x in c) for c in copies], pa.binary())})


def heard(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Shared minimizers and their document frequencies."""
    if not told.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    return joined(told["keys"].drop_null(), np.uint64), joined(told["df"].drop_null(), np.uint32)


def later_copies(table: pa.Table, told: pa.Table) -> np.ndarray:
    """For each row, whether a document with a smaller id has the same text; an id may have other texts, which are no copies."""
    doc_id = ids(table["doc_id"])
    copied = np.zeros(len(doc_id), bool)
    if not told.num_rows or not table.num_rows:
        return copied
    digests = b"".join(told["digests"].drop_null().to_pylist())
    first = {digests[32 * k : 32 * k + 32]: d for k, d in enumerate(joined(told["copies"].drop_null(), np.int64).tolist())}
    if first:
        data, offsets = buffers(table["text"])
        for k, (d, a, b) in enumerate(zip(doc_id.tolist(), offsets.tolist(), offsets[1:].tolist())):
            copied[k] = first.get(hashlib.sha256(data[a:b]).digest(), d) != d
    return copied


def group_edges_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where runs of equal pairs begin."""
    if not len(x):
        return np.empty(0, np.int64)
    return np.concatenate(([0], np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1))
