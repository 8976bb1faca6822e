"""Sum-of-squares online packing of documents into token windows.

Each task packs its stream of documents as they come.  A document's full windows
close at once; what remains goes to the fill level that makes the sum of squared
counts of partially filled windows smallest, tracked in an array by level.  When
the stream ends, the emptiest open windows are cut into the gaps of the fullest, so
a task leaves one partly filled window at most.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, NOT_SPACE, buffers, runs, word_bounds, word_hashes

#: A task forgets its words' ids and starts anew when they take this many bytes.
CACHE_BYTES = 32 << 20
#: Rows of pieces are sent on in batches of about this many ids.
BATCH_IDS = 1 << 20
#: Words go to the tokenizer in texts of so many, parted by a word that none of them holds.
JOINED_WORDS, PART = 64, "\x01"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: Texts whose ids must be those of their words, if a tokenizer is to be asked by words.
PROBES = ("ab cd", " ab", "ab ", "ab  cd", "ab\ncd", "\n\nab\t cd.\r\n", "it's 1 2, 34 - a-b\n- \u00e9\u00df x", f"ab {PART} cd {PART} 12")


def tokenizer_of(path: str | None):
    """The tokenizer of a file, read once by a worker.

    Workers may not know this package, so what is held from task to task hangs on the
    tokenizers' own module; functools' caches are sent by name and would not be found.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
    import tokenizers

    held = vars(tokenizers).setdefault("_held_by_path", {})
    if path not in held:
        file = path
        if file is None:
            import public_tokenizers

            file = public_tokenizers.path("word_bpe_49k.json")
        held[path] = tokenizers.Tokenizer.from_file(file)
    return held[path]


def room_for(held: np.ndarray, n: int) -> np.ndarray:
    """held, with place for n entries at least."""
    return held if len(held) >= n else np.concatenate([held, np.empty(max(n, 2 * len(held)) - len(held), held.dtype)])


#: Bytes of a word by kind: ASCII letters, ASCII signs and digits, and what has rules of its own (an apostrophe, other scripts).
LETTER, SIGN, OWN = 1, 2, 3
KIND = np.full(256, SIGN, np.uint8)
KIND[0x61:0x7B] = LETTER
KIND[[0x27, *range(0x80, 0x100)]] = OWN


def finer(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_bounds of the runs of letters and of signs that words fall into; a word with an apostrophe or a byte beyond ASCII stays whole."""
    kind = KIND[data] * NOT_SPACE[data]
    at = np.flatnonzero(kind == OWN)
    whole = np.searchsorted(at, starts) < np.searchsorted(at, ends)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[whole]] = 1
    inside[ends[whole]] -= 1
    kind[np.cumsum(inside[:-1], dtype=np.int8) > 0] = OWN
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    word = kind[at[:-1]] > 0
    starts = at[:-1][word]
    return starts, at[1:][word], np.searchsorted(starts, offsets)


class WordTokens:
    """Ids of texts.  Where white space parts a tokenizer's tokens, each distinct word is asked for once.

    Words are told apart by two 64-bit fingerprints.  A tokenizer for which white space
    counts gets whole texts, and so do texts with a special token's string.
    """

    def __init__(self, path: str | None, cache_bytes: int = CACHE_BYTES) -> None:
        self.tokenizer, self.cache_bytes = tokenizer_of(path), cache_bytes
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] + [PART.encode()]
        part = self.whole(PART)
        self.by_word = len(part) == 1 and all(self.whole(t).tolist() == [x for w in t.split() for x in self.whole(w).tolist()] for t in PROBES)
        self.part = int(part[0]) if len(part) else -1
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.folds = self.whole(letters.upper()).tolist() == self.whole(letters).tolist()
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.direct = self.folds and normal is not None and cut is not None and normal.normalize_str(letters) == letters and [t for t, _ in cut.pre_tokenize_str(letters)] == [letters]
        signs = [chr(x) for x in range(0x21, 0x7F) if KIND[x] == SIGN and not chr(x).isupper()]
        self.direct &= all(self.whole(f"ab{x}cd").tolist() == [y for w in ("ab", x, "cd") for y in self.whole(w).tolist()] for x in signs)
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted fingerprints; the next three go with them
        self.second, self.start, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat, self.used = np.empty(1 << 12, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ask(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        joined = [f" {PART} ".join(w.decode() for w in words[i : i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)]
        got: list[int] = []
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            got += e.ids
            got.append(self.part)
        flat = np.array(got, np.uint32)
        ends = np.flatnonzero(flat == self.part)
        return flat[flat != self.part], np.diff(ends, prepend=-1) - 1

    def learn(self, words: list[bytes], letters: np.ndarray, key: np.ndarray, second: np.ndarray) -> None:
        """Ids of new words; letters tells which are ASCII letters only, so one token before merges."""
        plain = letters & self.direct
        tokenize = self.tokenizer.model.tokenize
        found = [[x.id for x in tokenize(words[i].decode())] for i in np.flatnonzero(plain).tolist()]
        n = np.empty(len(words), np.int64)
        n[plain] = np.fromiter(map(len, found), np.int64, len(found))
        flat, n[~plain] = self.ask([words[i] for i in np.flatnonzero(~plain).tolist()])
        start = np.empty(len(words), np.int64)
        for part, ids in ((plain, np.fromiter((x for f in found for x in f), np.uint32, int(n[plain].sum()))), (~plain, flat)):
            start[part] = self.used + np.cumsum(n[part]) - n[part]
            self.flat = room_for(self.flat, self.used + len(ids))
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        at = np.searchsorted(self.known, key)
        self.known, self.second = np.insert(self.known, at, key), np.insert(self.second, at, second)
        self.start, self.length = np.insert(self.start, at, start), np.insert(self.length, at, n)

    def by_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts one after another, and where each text's begin (one more at the end)."""
        if self.folds:
            data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
        if self.direct and len(starts):
            starts, ends, first = finer(data, offsets, starts, ends)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        key, at, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        second = word_hashes(data, starts, ends, 2)
        if (second != second[at][word]).any():  # two words of one fingerprint; never seen
            key, at, word = np.arange(len(starts), dtype=np.uint64), np.arange(len(starts)), np.arange(len(starts))
            self.clear()
        second = second[at]
        if 28 * len(self.known) + 4 * self.used > self.cache_bytes:
            self.clear()
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.known, key), max(len(self.known) - 1, 0))
            have = self.known[place] == key if len(self.known) else np.zeros(len(key), bool)
            if not (have & (self.second[place] != second)).any() if len(self.known) else True:
                break
            self.clear()
        new = np.flatnonzero(~have)
        if len(new):
            a, b, raw = starts[at[new]], ends[at[new]], data.tobytes()
            other = np.concatenate(([0], np.cumsum((data < 0x61) | (data > 0x7A))))
            self.learn([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], other[a] == other[b], key[new], second[new])
            place = np.searchsorted(self.known, key)
        n = self.length[place][word].astype(np.int64)
        stops = np.cumsum(n)
        flat = self.flat[np.repeat(self.start[place][word] - stops + n, n) + np.arange(int(stops[-1]))]
        return flat, np.concatenate(([0], stops))[first]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Each text's ids, in order."""
        raw = data.tobytes()
        odd = not self.by_word or any(s in raw for s in self.special)
        whole = [i for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())) if odd and (not self.by_word or any(s in raw[a:b] for s in self.special))]
        if whole:  # the others are asked for with these taken out
            keep = np.ones(len(data), bool)
            for i in whole:
                keep[offsets[i] : offsets[i + 1]] = False
            size = np.diff(offsets)
            size[whole] = 0
            flat, edges = self.by_words(data[keep], np.concatenate(([0], np.cumsum(size))))
        else:
            flat, edges = self.by_words(data, offsets)
        apart = set(whole)
        for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            yield self.whole(raw[offsets[i] : offsets[i + 1]].decode()) if i in apart else flat[a:b]


class Packer:
    """Open windows by fill level.  A piece is (doc_id, start, ids, doc_tokens); closed windows are lists of pieces."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: dict[int, list[list]] = {}

    def choose(self, size: int) -> int:
        """The level (0: a new window) that gives the smallest sum of squared counts; of equal ones the fullest."""
        n, w = self.counts, self.window
        change = np.where(n[1 : w - size + 1] > 0, 2 * (n[1 + size :] - n[1 : w - size + 1]) + 2, np.iinfo(np.int64).max)
        if n[w - size] > 0:
            change[w - size - 1] = 1 - 2 * n[w - size]
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        return best + 1 if best >= 0 and change[best] <= 2 * n[size] + 1 else 0

    def add(self, piece: tuple) -> list | None:
        """Place a piece; its window, if that is full now."""
        size = len(piece[2])
        if size == self.window:
            return [piece]
        level = self.choose(size)
        if level:
            self.counts[level] -= 1
            held = self.levels[level].pop()
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            return held
        self.counts[level + size] += 1
        self.levels.setdefault(level + size, []).append(held)
        return None

    def finish(self) -> Iterator[list]:
        """Close the open windows, moving the emptiest ones' pieces, cut where needed, into the fullest ones' gaps."""
        open_ = [w for level in sorted(self.levels) for w in self.levels[level]]
        low = 0
        for high in range(len(open_) - 1, -1, -1):
            if high < low:
                return
            held = open_[high]
            gap = self.window - sum(len(p[2]) for p in held)
            while gap and low < high:
                doc, start, tokens, total = open_[low].pop()
                held.append((doc, start, tokens[:gap], total))
                if len(tokens) > gap:
                    open_[low].append((doc, start + gap, tokens[gap:], total))
                gap -= len(held[-1][2])
                if not open_[low]:
                    low += 1
            yield held


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its text's ids and then end_id; a null or empty text is end_id alone,
    and a null doc_id stays null.  Each input row is packed once, also if rows repeat.
    Documents longer than a window fill windows of their own and pack what is left.
    Other columns are ignored; an empty table gives no rows.  sequence_id is unique: the
    task's number in the upper bits, the window's in the lower 40.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, closed = None, Packer(window), 0
        base = TaskContext.get().partitionId() << 40
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        held_ids = 0

        def emit(pieces: list) -> None:
            nonlocal closed, held_ids
            at = 0
            for doc, start, tokens, total in pieces:
                for c, v in zip(out, (doc, start, len(tokens), tokens.tobytes(), total, base + closed, at)):
                    out[c].append(v)
                at += len(tokens)
            held_ids += at
            closed += 1

        def flush() -> pa.RecordBatch:
            nonlocal held_ids
            made = pa.record_batch({c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()})
            for v in out.values():
                v.clear()
            held_ids = 0
            return made

        for batch in batches:
            words = words or WordTokens(tokenizer_path)
            doc_ids = batch["doc_id"].to_pylist()
            for i, j, data, offsets in runs(*buffers(batch["text"])):
                for doc, tokens in zip(doc_ids[i:j], words.encode(data, offsets)):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(tokens), window):
                        full = packer.add((doc, start, tokens[start : start + window], len(tokens)))
                        if full:
                            emit(full)
                if held_ids >= BATCH_IDS:
                    yield flush()
        for full in packer.finish():
            emit(full)
            if held_ids >= BATCH_IDS:
                yield flush()
        yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)
