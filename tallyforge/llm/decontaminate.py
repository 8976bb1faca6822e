"""Benchmark decontamination with a generalised suffix automaton.

The test items (words as symbols) are dealt by hash into parts of bounded size.  A task
builds each part's automaton, which is kept as plain arrays.  Documents' words are
streamed through an automaton; the longest matching length at each word tells which
windows of an item end there.  Runs of words that can't reach a window's length (their
word pairs occur in no item) are passed over, which leaves the automaton at its root.

A benchmark of one part goes to all workers.  Of a larger one nothing does but a filter
of fixed size: documents' windows that pass it are joined with the items' by fingerprint,
so each document goes to the parts that it touches and meets only their automata; a part
that many documents touch is dealt to several tasks.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import ALNUM, LOWER, NO_ID, buffers, runs, window_hashes, window_starts, word_bounds, word_hashes
from .cells import numbered, settle

#: Bytes of items' text in a part; an automaton of so many has some 10 MB, and some 100 MB while it is built.
PART_BYTES = 1 << 19
#: Bytes of documents that go through an automaton together.
BLOCK_BYTES = 1 << 20
#: Bytes of documents that one task takes through a part's automaton.
SLICE_BYTES = 16 << 20
#: Bits of the filter for each window of an item, and all its bits at most: beyond, it only lets more through.
FILTER_BITS, MOST_BITS = 16, 1 << 29


class SuffixAutomaton:
    """Of several sequences of integers; a state's length, link and moves, and which items own the windows it stands for."""

    def __init__(self) -> None:
        self.length, self.link, self.moves = [0], [-1], [{}]

    def extend(self, last: int, symbol: int) -> int:
        """The state of last's sequence with one more symbol."""
        length, link, moves = self.length, self.link, self.moves
        if symbol in moves[last]:
            to = moves[last][symbol]
            return to if length[to] == length[last] + 1 else self._split(last, symbol, to)
        new = len(length)
        length.append(length[last] + 1), link.append(0), moves.append({})
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = moves[at][symbol]
            link[new] = to if length[to] == length[at] + 1 else self._split(at, symbol, to)
        return new

    def _split(self, at: int, symbol: int, to: int) -> int:
        length, link, moves = self.length, self.link, self.moves
        new = len(length)
        length.append(length[at] + 1), link.append(link[to]), moves.append(dict(moves[to]))
        link[to] = new
        while at >= 0 and moves[at].get(symbol) == to:
            moves[at][symbol] = new
            at = link[at]
        return new


@dataclass
class Items:
    """An automaton as arrays, with the windows that its states stand for."""

    length: array
    link: array
    moves: array  # state * number of words + word, sorted
    to: array  # the state of each move
    owner: array  # the nearest state by links, itself included, that ends a window; 0 for none
    own_state: array  # sorted, with the next two
    own_size: array
    own_item: array
    vocabulary: np.ndarray
    pairs: np.ndarray
    least: int


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    data, offsets = buffers(pa.array(texts, pa.string()))
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    words = word_hashes(data, starts, ends)
    return [words[a:b] for a, b in zip(first.tolist(), first[1:].tolist())]


def build(item_ids: list[int], texts: list[str | None], window: int) -> Items | None:
    """The automaton of some items; None if none has a word."""
    words = item_words(texts)
    if not sum(map(len, words)):
        return None
    vocabulary = np.unique(np.concatenate(words))
    numbers = [np.searchsorted(vocabulary, w).tolist() for w in words]
    sam = SuffixAutomaton()
    for seq in numbers:
        last = 0
        for x in seq:
            last = sam.extend(last, x)
    found: dict[int, set[tuple[int, int]]] = {}
    for item, seq in zip(item_ids, numbers):
        size, at, n = min(window, len(seq)), 0, 0
        for x in seq:
            at = sam.moves[at][x]
            n += 1
            if n >= size > 0:
                s = at
                while sam.length[sam.link[s]] >= size:
                    s = sam.link[s]
                found.setdefault(s, set()).add((size, item))
    pairs = [np.array(s[:-1], np.int64) * len(vocabulary) + np.array(s[1:], np.int64) for s in numbers if len(s) > 1]
    least = min(min(window, len(s)) for s in numbers if s)
    moves = sorted((state * len(vocabulary) + x, to) for state, out in enumerate(sam.moves) for x, to in out.items())
    owner = array("i", bytes(4 * len(sam.length)))
    for s in sorted(range(1, len(sam.length)), key=sam.length.__getitem__):  # a link is shorter
        owner[s] = s if s in found else owner[sam.link[s]]
    own = sorted((s, size, item) for s, some in found.items() for size, item in some)
    column = lambda kind, k, rows: array(kind, [r[k] for r in rows])
    return Items(array("i", sam.length), array("i", sam.link), column("q", 0, moves), column("i", 1, moves), owner, *(column(t, k, own) for k, t in enumerate("iiq")), vocabulary, np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64), least)


def stream(items: Items, seq: list[int]) -> Iterator[tuple[int, int, int]]:
    """(word, window's length, item) wherever an item's window ends."""
    length, link, moves, to, owner, own = items.length, items.link, items.moves, items.to, items.owner, items.own_state
    words, last, at, n = len(items.vocabulary), len(items.moves), 0, 0
    for i, x in enumerate(seq):
        while x >= 0:
            move = at * words + x
            j = bisect_left(moves, move)
            if j < last and moves[j] == move:
                at, n = to[j], n + 1
                break
            if not at:
                n = 0
                break
            at = link[at]
            n = length[at]
        else:  # a word that no item has
            at = n = 0
        s = owner[at]
        while s > 0:
            k = bisect_left(own, s)
            while k < len(own) and own[k] == s:
                if items.own_size[k] <= n:
                    yield i, items.own_size[k], items.own_item[k]
                k += 1
            s = owner[link[s]]


def hot_runs(items: Items, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Words as symbols (-1: in no item) and the runs of words in which a window can lie."""
    at = np.minimum(np.searchsorted(items.vocabulary, words), len(items.vocabulary) - 1)
    symbol = np.where(items.vocabulary[at] == words, at, -1)
    n = len(words)
    if not n:
        return symbol, []
    tied = np.zeros(n + 1, bool)  # word i goes on from word i - 1
    pair = symbol[:-1] * len(items.vocabulary) + symbol[1:]
    tied[1:n] = (symbol[:-1] >= 0) & (symbol[1:] >= 0)
    maybe = np.flatnonzero(tied[1:n])
    if len(items.pairs):
        p = np.minimum(np.searchsorted(items.pairs, pair[maybe]), len(items.pairs) - 1)
        tied[1 + maybe] = items.pairs[p] == pair[maybe]
    else:
        tied[:] = False
    tied[first[first < n]] = False
    begin = np.flatnonzero(~tied[:n])
    end = np.append(begin[1:], n)
    ok = (end - begin >= items.least) & (symbol[begin] >= 0)
    return symbol, list(zip(begin[ok].tolist(), end[ok].tolist()))


def automata(items: DataFrame, window: int, parts: int) -> DataFrame:
    """(part, automaton, sizes, windows): each part's automaton, and the sizes and fingerprints of its windows."""

    def made(table: pa.Table) -> pa.Table:
        texts = table["text"].to_pylist()
        built = build([NO_ID if x is None else x for x in table["item"].to_pylist()], texts, window)
        sizes, prints = item_windows(item_words(texts), window)
        return pa.table({"part": table["part"].slice(0, 1), "automaton": pa.array([pickle.dumps(tuple(vars(built).values())) if built else None], pa.binary()), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())), "windows": pa.array([prints.view(np.int64).tolist()], pa.list_(pa.int64()))})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int")).repartition(parts, "part")
    return settle(dealt.groupBy("part").applyInArrow(made, "part int, automaton binary, sizes array<int>, windows array<long>").where("automaton is not null"))


def item_windows(words: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and fingerprints of all windows of some items."""
    found = [(min(window, len(w)), window_hashes(w, min(window, len(w)))) for w in words if len(w)]
    sizes = np.repeat([n for n, _ in found], [len(h) for _, h in found]).astype(np.int64)
    return sizes, np.concatenate([h for _, h in found]) if found else np.empty(0, np.uint64)


def hits(automaton: Items, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, first word, end, item) of each window of an item; words are counted over all documents."""
    symbol, hot = hot_runs(automaton, words, first)
    for begin, end in hot:
        doc = int(np.searchsorted(first, begin, "right")) - 1
        for at, size, item in stream(automaton, symbol[begin:end].tolist()):
            yield doc, begin + at + 1 - size, begin + at + 1, item


def outcome(text: str | None, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray, items: set[int], most_share: float) -> dict:
    """The result of one document: its bytes, its words' bounds in them, which words are hit, and the items."""
    n_hit = int(hit.sum())
    if n_hit:
        w = np.flatnonzero(hit)
        new = np.flatnonzero(np.diff(w) > 1) + 1
        a, b = starts[w[np.concatenate(([0], new))]], ends[w[np.append(new - 1, len(w) - 1)]]
        cuts, whole = [0, *np.column_stack((a, b)).ravel().tolist(), len(raw)], raw.tobytes()
        text = b"".join(whole[x:y] for x, y in zip(cuts[::2], cuts[1::2])).decode()
    own = sorted(str(x) for x in items if x != NO_ID)
    return {"n_words": len(hit), "n_hit": n_hit, "n_items": len(own), "items_sha256": hashlib.sha256(",".join(own).encode()).hexdigest(), "contaminated": n_hit > 0, "kept_text": text, "dropped": n_hit > most_share * len(hit)}


FOUND = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "contaminated": T.BooleanType(), "kept_text": T.StringType(), "dropped": T.BooleanType()}
KINDS = {T.LongType: pa.int64(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}


def found_batch(passed: dict, rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch(passed | {c: pa.array([r[c] for r in rows], KINDS[type(kind)]) for c, kind in FOUND.items()})


def with_found(rows: DataFrame, passed: list[str]) -> T.StructType:
    return T.StructType([*(rows.schema[c] for c in passed), *(T.StructField(c, kind) for c, kind in FOUND.items())])


def by_one_part(rows: DataFrame, automaton: bytes | None, most_share: float) -> DataFrame:
    """The result of each row by one automaton, which goes to all workers."""
    cast = rows.sparkSession.sparkContext.broadcast(automaton)  # of one part, so of a bounded size
    passed = [c for c in rows.columns if c != "text"]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Items(*pickle.loads(cast.value)) if cast.value else None
        for batch in batches:
            texts = batch["text"]
            for i, j, raw, offsets in runs(*buffers(texts), BLOCK_BYTES):
                out, data = [], LOWER[raw]
                starts, ends, first = word_bounds(data, offsets, ALNUM)
                owners: dict[int, set[int]] = {}
                change = np.zeros(len(starts) + 1, np.int32)
                for doc, a, b, item in hits(held, word_hashes(data, starts, ends), first) if held else ():
                    change[a] += 1
                    change[b] -= 1
                    owners.setdefault(doc, set()).add(item)
                hit = np.cumsum(change)[:-1] > 0
                for k in range(j - i):
                    w, at = slice(first[k], first[k + 1]), offsets[k]
                    out.append(outcome(texts[i + k].as_py(), raw[at : offsets[k + 1]], starts[w] - at, ends[w] - at, hit[w], owners.get(k, set()), most_share))
                yield found_batch({c: batch[c].slice(i, j - i) for c in passed}, out)

    return rows.mapInArrow(screen, with_found(rows, passed))


def touching(rows: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """(part, row_number): the documents that have a window of a part's item."""
    windows = parts.select("part", F.explode(F.arrays_zip("sizes", "windows")).alias("w")).select("part", F.col("w.sizes").alias("size"), F.col("w.windows").alias("print")).distinct()
    total, sizes = windows.agg(F.count("*"), F.collect_set("size")).first()  # sizes from 1 to window
    bits = min(MOST_BITS, 1 << max(10, (FILTER_BITS * total - 1).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    places = windows.select(F.shiftrightunsigned("print", shift).alias("at")).distinct()
    cell = places.groupBy(F.shiftrightunsigned("at", 16).cast("int").alias("cell")).agg(F.collect_list(F.col("at").bitwiseAND(0xFFFF).cast("int")).alias("bits"))
    held = np.zeros(bits // 8, np.uint8)
    for r in cell.toLocalIterator():  # each cell has 65,536 bits at most, all together MOST_BITS
        b = np.array(r.bits, np.int64) + (r["cell"] << 16)
        np.bitwise_or.at(held, b >> 3, (1 << (b & 7)).astype(np.uint8))
    cast = rows.sparkSession.sparkContext.broadcast(held)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cast.value
        for batch in batches:
            for i, j, raw, offsets in runs(*buffers(batch["text"]), BLOCK_BYTES):
                data = LOWER[raw]
                starts, ends, first = word_bounds(data, offsets, ALNUM)
                words, doc = word_hashes(data, starts, ends), np.repeat(np.arange(i, j), np.diff(first))
                for size in sizes:
                    at = window_starts(first, size)
                    prints = window_hashes(words, size)[at] if len(at) else np.empty(0, np.uint64)
                    b = (prints >> np.uint64(shift)).astype(np.int64)
                    at, prints = at[table[b >> 3] >> (b & 7) & 1 > 0], prints[table[b >> 3] >> (b & 7) & 1 > 0]
                    pairs = np.unique(np.column_stack((doc[at].astype(np.uint64), prints)), axis=0)
                    own = pa.array(pairs[:, 0].astype(np.int64))
                    yield pa.record_batch({"row_number": batch["row_number"].take(own), "size": pa.array(np.full(len(pairs), size, np.int32)), "print": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))})

    met = rows.select("row_number", "text").mapInArrow(screen, "row_number long, size int, print long")
    return met.join(windows, ["size", "print"]).select("part", "row_number").distinct()


def by_many_parts(rows: DataFrame, parts: DataFrame, window: int, most_share: float) -> DataFrame:
    """The result of each row by the automata of the parts that it touches."""
    rows = numbered(rows, "row_number")
    touched = settle(touching(rows, parts, window))
    texts = touched.join(rows.select("row_number", "text"), "row_number")
    slices = touched.join(rows.select("row_number", F.octet_length("text").alias("n")), "row_number").groupBy("part").agg((F.floor(F.sum("n") / SLICE_BYTES) + 1).cast("int").alias("slices"))
    slices = settle(slices)
    visits = texts.join(slices, "part").select("part", F.pmod(F.xxhash64("row_number"), "slices").cast("int").alias("slice"), "row_number", "text")
    copies = parts.select("part", "automaton").join(slices, "part").select(F.col("part").alias("of_part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("of_slice"), "automaton")

    def meet(automaton: pa.Table, docs: pa.Table) -> pa.Table:
        out: dict[str, list] = {"row_number": [], "spans": [], "items": []}
        if automaton.num_rows and docs.num_rows:
            held, numbers = Items(*pickle.loads(automaton["automaton"][0].as_py())), docs["row_number"].to_pylist()
            for i, j, raw, offsets in runs(*buffers(docs["text"]), BLOCK_BYTES):
                data = LOWER[raw]
                starts, ends, first = word_bounds(data, offsets, ALNUM)
                found: dict[int, tuple[list[int], set[int]]] = {}
                for doc, a, b, item in hits(held, word_hashes(data, starts, ends), first):
                    spans, items = found.setdefault(doc, ([], set()))
                    spans += [a - int(first[doc]), b - int(first[doc])]
                    items.add(item)
                for doc, (spans, items) in found.items():
                    out["row_number"].append(numbers[i + doc]), out["spans"].append(merged(spans)), out["items"].append(sorted(items))
        return pa.table({"row_number": pa.array(out["row_number"], pa.int64()), "spans": pa.array(out["spans"], pa.list_(pa.int32())), "items": pa.array(out["items"], pa.list_(pa.int64()))})

    met = copies.groupBy("of_part", "of_slice").cogroup(visits.groupBy("part", "slice")).applyInArrow(lambda a, b: meet(a, b), "row_number long, spans array<int>, items array<long>")
    marks = met.groupBy("row_number").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # of one document
    both = rows.join(marks, "row_number", "left")
    passed = [c for c in rows.columns if c not in ("text", "row_number")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts, spans, items = [], batch["text"], batch["spans"].to_pylist(), batch["items"].to_pylist()
            for i, j, raw, offsets in runs(*buffers(texts), BLOCK_BYTES):
                starts, ends, first = word_bounds(LOWER[raw], offsets, ALNUM)
                for k in range(j - i):
                    w, at = slice(first[k], first[k + 1]), offsets[k]
                    change = np.zeros(first[k + 1] - first[k] + 1, np.int32)
                    np.add.at(change, (spans[i + k] or [])[::2], 1)
                    np.add.at(change, (spans[i + k] or [])[1::2], -1)
                    out.append(outcome(texts[i + k].as_py(), raw[at : offsets[k + 1]], starts[w] - at, ends[w] - at, np.cumsum(change)[:-1] > 0, set(items[i + k] or ()), most_share))
            yield found_batch({c: batch[c] for c in passed}, out)

    return both.select(*passed, "text", "spans", "items").mapInArrow(finish, with_found(rows, passed))


def merged(spans: list[int]) -> list[int]:
    """Ranges (first, end, first, end, ...) as disjoint ones in order."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_share: float = 1.0, carry: bool = False, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, kept_text and dropped.

    Words are lower-cased runs of ASCII digits, letters and all other characters
    beyond ASCII.  An item's windows are its runs of `window` words, or the whole item
    if it has fewer words but not none; a document word inside an occurrence of a
    window is hit.  kept_text is the text without the bytes from a hit span's first
    word to its last one (null stays null); dropped is true where more than most_share of
    the words are hit (the coverage limit).  A null or empty text has no words; items
    without words match nothing; rows that repeat an id stand for themselves; a null
    item id counts as no item in n_items, though its windows hit.  Other columns are
    ignored, or with carry kept in a struct named row; an empty table gives no rows.

    The items are a stated set that is checked against all rows; they may be any number.
    One longer than part_bytes is a part of its own.
    """
    whole: list[Column] = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(*whole, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    n_parts = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes) or 1
    parts = automata(items, window, n_parts)
    if n_parts > 1:
        return by_many_parts(rows, parts, window, most_share)
    one = parts.select("automaton").first()
    return by_one_part(rows, bytes(one.automaton) if one else None, most_share)
