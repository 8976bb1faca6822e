"""Toxicity by weak supervision.

Many voters look at a text: lexicons by theme, patterns (an insult near an address, a
disguised or shouted one, many of them, none of all), and lexicons of words and word
beginnings that labelled texts outside the held-out fold bring up, parted by which occur
together.  Each votes toxic, clean or not at all.  A generative model of the votes, in
which a voter may depend on the class and on one other voter (a tree of the strongest
correlations within the classes), estimates their accuracies and correlations from the
counts of all vote patterns, by expectation maximisation; labels fix the class where
they are known.  Its posteriors are the labels of a linear classifier over counts of
words and word beginnings, which scores the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, buffers, mix, powers, runs, word_bounds
from .cells import settle
from .quality_classifier import first_by_hash

#: Most labelled rows of each class that bring up words, and most rows that the classifier is fitted on.
SAMPLE_ROWS = 10_000
#: Bytes of word beginnings, and most words and beginnings that are kept.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
MOST_STEMS = 4096
#: A word counts if so many labelled texts of its class have it, and its shares differ by so many standard errors.
LEAST_TEXTS, LEAST_ERRORS = 3, 4.0

# The themes' words.
THEMES = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile imbeciles cretin dimwit halfwit brainless simpleton dunce retard retarded dumm dummkopf blödmann schwachkopf imbécile crétin débile stupide abruti idiota idiotas imbécil estúpido estúpida tonto",
    "worth": "worthless pathetic loser losers useless failure nobody waste wertlos erbärmlich versager nutzlos minable raté inútil patético perdedor fracasado",
    "dehumanising": "scum trash garbage vermin filth filthy parasite parasites pig pigs cockroach cockroaches subhuman abschaum müll ungeziefer dreck ordure ordures déchet vermine racaille basura escoria alimaña",
    "disgust": "disgusting disgust revolting repulsive vile sickening gross creep nasty ekelhaft widerlich abscheulich dégoûtant répugnant infect asqueroso repugnante",
    "ridicule": "clown clowns joke buffoon jerk freak weirdo coward liar fool fools witzfigur feigling lügner bouffon menteur lâche payaso cobarde mentiroso",
    "hostility": "hate kill shut damn bitch bastard bastards asshole crap shit fuck fucking hasse verrecke scheiße arschloch salaud connard salope putain mierda cabrón puta odio",
}
#: Forms of address.
ADDRESS = "you your youre you're ya u du dich dir dein deine ihr euch tu toi te vous votre ton ta tú ti tu eres usted vosotros"
#: Digits that stand for letters.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}

#: Lexicons that the mined words and beginnings fall into, by the toxic texts in which they occur together.
MINED = 6
#: Texts among which their first centres are sought.
SEEDS = 600
VOTERS = (*THEMES, "address", "disguise", "many", "nothing", *(f"mined{k}" for k in range(MINED)))
ABSTAIN, CLEAN, TOXIC = 0, 1, 2

_DISGUISED = LOWER.copy()
for _a, _b in DISGUISE.items():
    _DISGUISED[ord(_a)] = ord(_b)
_SEED = 0x3C79AC492BA7B653


def hashes(data: np.ndarray, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A fingerprint of the bytes from each start on."""
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(7 << 8))
    up, down = powers(len(data) + 1, _SEED)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * up[: len(data)], out=total[1:])
        return mix((total[starts + size] - total[starts]) * down[starts] + np.asarray(size).astype(np.uint64))


def of_words(words: str) -> np.ndarray:
    some = [np.frombuffer(w.encode(), np.uint8) for w in words.split()]
    return np.array([hashes(w, np.zeros(1, np.int64), len(w))[0] for w in some], np.uint64)


class Table:
    """A sorted set of fingerprints with a small filter before the search."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are in the set, and at what places of it."""
        at = np.flatnonzero(self.maybe[(x >> np.uint64(46)).astype(np.int64)]) if len(self.keys) else np.empty(0, np.int64)
        place = np.searchsorted(self.keys, x[at])
        ok = place < len(self.keys)
        ok[ok] = self.keys[place[ok]] == x[at[ok]]
        return at[ok], place[ok]


@dataclass
class Words:
    """The words of a run of texts: their texts, fingerprints and beginnings."""

    n: int
    doc: np.ndarray
    n_words: np.ndarray
    whole: np.ndarray
    disguised: np.ndarray
    shouted: np.ndarray
    beginnings: list[tuple[np.ndarray, np.ndarray]]  # (word, fingerprint) for each size


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    starts, ends, first = word_bounds(low, offsets, ALNUM)
    size = ends - starts
    low_table, n_words = hashes(low, starts, size), np.diff(first)
    begun = []
    for k in BEGINNINGS:
        long = np.flatnonzero(size > k)
        begun.append((long, hashes(low, starts[long], k)))
    shouted = (size > 2) & (data[starts] != low[starts]) & (data[ends - 1] != low[ends - 1]) if len(starts) else np.zeros(0, bool)
    return Words(len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), n_words), n_words, low_table, hashes(_DISGUISED[data], starts, size), shouted, begun)


class Lexicons:
    """The fixed lexicons as tables."""

    def __init__(self) -> None:
        keys = [of_words(w) for w in THEMES.values()]
        self.table = Table(np.concatenate(keys))
        self.theme = np.zeros(len(self.table.keys), np.int64)
        for k, x in enumerate(keys):
            self.theme[np.searchsorted(self.table.keys, x)] = k
        self.address = Table(of_words(ADDRESS))

    def counts(self, w: Words) -> np.ndarray:
        """For each text, its words in each theme, those near an address, and those disguised or shouted."""
        out = np.zeros((w.n, len(THEMES) + 2))
        at, place = self.table.find(w.whole)
        np.add.at(out, (w.doc[at], self.theme[place]), 1)
        said, _ = self.address.find(w.whole)
        if len(said) and len(at):
            before = np.searchsorted(said, at) - 1
            near = (before >= 0) & (at - said[before] <= 4) & (w.doc[said[before]] == w.doc[at])
            np.add.at(out, (w.doc[at[near]], len(THEMES)), 1)
        hidden, _ = self.table.find(w.disguised)
        hidden = np.union1d(np.setdiff1d(hidden, at), at[w.shouted[at]])
        np.add.at(out, (w.doc[hidden], len(THEMES) + 1), 1)
        return out


@dataclass
class Stems:
    """Words and beginnings that labelled texts bring up, as fingerprints salted by their size (0: whole words)."""

    keys: np.ndarray


def salted(fingerprints: np.ndarray, size: int) -> np.ndarray:
    return fingerprints ^ mix(np.array([size + 1], np.uint64))[0]


def stem_keys(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, words' places, keys) of all words and beginnings."""
    yield 0, np.arange(len(w.whole)), salted(w.whole, 0)
    for size, (at, h) in zip(BEGINNINGS, w.beginnings):
        yield size, at, salted(h, size)


def stem_counts(w: Words, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the table, occurrences), sorted by text."""
    docs, places = [], []
    for _, at, keys in stem_keys(w):
        hit, place = table.find(keys)
        docs.append(w.doc[at[hit]]), places.append(place)
    code = np.concatenate(docs) * max(len(table.keys), 1) + np.concatenate(places)
    code, n = np.unique(code, return_counts=True)
    return code // max(len(table.keys), 1), code % max(len(table.keys), 1), n


@dataclass
class Votes:
    """The mined lexicon of each stem, and what a text's hits of a lexicon must come to for its voter to say toxic."""

    table: Table
    lexicon: np.ndarray
    high: np.ndarray

    def shares(self, w: Words, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Hits of each mined lexicon in each text, by the deviation that chance would give them."""
        doc, place, n = counts
        out = np.bincount(doc * MINED + self.lexicon[place], n, minlength=w.n * MINED).reshape(w.n, MINED)
        return out / np.sqrt(w.n_words + 20)[:, None]


def votes_of(lexical: np.ndarray, shares: np.ndarray, n_words: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One vote of each voter for each text."""
    themes = lexical[:, : len(THEMES)]
    total = themes.sum(1)
    out = np.zeros((len(lexical), len(VOTERS)), np.int8)
    out[:, : len(THEMES)][themes > 0] = TOXIC
    out[:, len(THEMES) : len(THEMES) + 2][lexical[:, len(THEMES) :] > 0] = TOXIC
    out[:, -MINED - 2][(total >= 2) | (total > 0) & (100 * total >= n_words)] = TOXIC
    out[:, -MINED - 1][(total == 0) & (2 * shares < high).all(1)] = CLEAN
    out[:, -MINED:][shares >= high] = TOXIC
    return out


def code_of(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ 3 ** np.arange(votes.shape[1], dtype=np.int64)


def votes_from(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(VOTERS), dtype=np.int64)) % 3


@dataclass
class LabelModel:
    """P(class) and P(vote of a voter | class, vote of the voter it leans on).

    Voters abstain in groups (those of other languages), which the tree can't say in full, so
    abstentions count with a factor from 0 to 1 that suits the labelled patterns best.
    """

    prior: float
    parent: np.ndarray  # -1: leans on none
    tables: np.ndarray  # [voter, class, parent's vote, vote], logarithms
    silence: float = 1.0

    def posterior(self, votes: np.ndarray, told: np.ndarray | float = 0.0) -> np.ndarray:
        """P(toxic) by the votes, and by what else is told as logarithms of odds."""
        margin = np.full(len(votes), np.log(self.prior) - np.log1p(-self.prior)) + told
        for v, p in enumerate(self.parent):
            lean = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            margin += np.where(votes[:, v] == ABSTAIN, self.silence, 1) * (self.tables[v, 1, lean, votes[:, v]] - self.tables[v, 0, lean, votes[:, v]])
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def accuracies(self, votes: np.ndarray, n: np.ndarray) -> dict[str, float]:
        """The share of a voter's votes that the model takes for right."""
        p = self.posterior(votes)
        right = np.where(votes == TOXIC, p[:, None], np.where(votes == CLEAN, 1 - p[:, None], 0))
        return dict(zip(VOTERS, (n @ right / np.maximum(n @ (votes != ABSTAIN), 1e-9)).tolist()))


def tree(votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each voter the one it leans on: a spanning tree of most information between voters within the classes."""
    k = votes.shape[1]
    information = np.zeros((k, k))
    for c in (0, 1):
        one = [(votes == x).astype(float) for x in range(3)]
        joint = np.array([[a.T @ (b * weights[:, c, None]) for b in one] for a in one]) + 0.1
        joint /= joint.sum((0, 1))
        left, right = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
        information += weights[:, c].sum() / weights.sum() * (joint * np.log(joint / (left * right))).sum((0, 1))
    alone = VOTERS.index("nothing")  # follows from the others, so it stands by itself
    information[alone] = information[:, alone] = 0
    parent, inside, nearest, gain = np.full(k, -1), np.zeros(k, bool), np.zeros(k, int), information[0].copy()
    inside[0] = True
    for _ in range(k - 1):
        v = int(np.argmax(np.where(inside, -1, gain)))
        parent[v] = nearest[v] if gain[v] > 1e-3 else -1
        inside[v] = True
        closer = information[v] > gain
        gain, nearest = np.where(closer, information[v], gain), np.where(closer, v, nearest)
    return parent


SILENCES = (0.0, 0.25, 0.5, 0.75, 1.0)


def likelihood(model: LabelModel, votes: np.ndarray, label: np.ndarray, n: np.ndarray) -> float:
    """That of the labels, given the votes."""
    p = np.clip(model.posterior(votes), 1e-6, 1 - 1e-6)
    return float((n * np.where(label == 1, np.log(p), np.where(label == 0, np.log1p(-p), 0))).sum())


#: The weight of all rows without a label, in those with one.
UNLABELLED = 0.25


def estimate(votes: np.ndarray, label: np.ndarray, n: np.ndarray, rounds: int = 60) -> LabelModel:
    """The label model of vote patterns that occur n times each; label is 0, 1, or -1 where it is unknown.

    Patterns without a label weigh together UNLABELLED times what labelled ones do at most,
    so that they can't pull the classes away from what the labels mean.
    """
    known, other = n[label >= 0].sum(), n[label < 0].sum()
    n = np.where(label >= 0, n, n * min(1.0, UNLABELLED * known / max(other, 1e-9)) if known else n)
    toxic, clean = (votes == TOXIC).sum(1), (votes == CLEAN).sum(1)
    p = np.where(label >= 0, np.clip(label, 0.02, 0.98), (toxic + 0.1) / (toxic + clean + 1))
    silence = 0.0
    for step in range(rounds):
        weights = np.column_stack((n * (1 - p), n * p))
        if step % 10 == 0 and step < rounds - 10:
            parent = tree(votes, weights)
        prior = float(np.clip(weights[:, 1].sum() / max(weights.sum(), 1e-9), 1e-4, 1 - 1e-4))
        tables = np.zeros((votes.shape[1], 2, 3, 3))
        for v, lean in enumerate(parent):
            at = votes[:, lean] if lean >= 0 else np.zeros(len(votes), np.int64)
            for c in (0, 1):
                cells = np.bincount(at * 3 + votes[:, v], weights[:, c], minlength=9).reshape(3, 3)
                of_all = (cells.sum(0) + 0.3) / (cells.sum() + 0.9)  # a parent's rare vote says what the class says
                tables[v, c] = np.log((cells + 2 * of_all) / (cells.sum(1, keepdims=True) + 2))
        model = LabelModel(prior, parent, tables, silence)
        if step % 10 == 0 and known:
            model.silence = silence = max(SILENCES, key=lambda x: likelihood(LabelModel(prior, parent, tables, x), votes, label, n))
        new = np.where(label >= 0, label, model.posterior(votes))
        if np.abs(new - p).max(initial=0) < 1e-6 and step > 20:
            break
        p = new
    return model


@dataclass
class Linear:
    """A linear classifier over logarithms of stems' counts, the themes' counts and the mined shares."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], dense: np.ndarray) -> np.ndarray:
        doc, place, n = rows
        z = dense @ self.dense + self.bias
        if len(doc):
            z = z + np.bincount(doc, self.weights[place] * np.log1p(n), minlength=len(dense))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(rows: tuple[np.ndarray, np.ndarray, np.ndarray], dense: np.ndarray, target: np.ndarray, width: int, steps: int = 400, decay: float = 1e-4) -> Linear:
    """Logistic regression on soft labels by full-batch Adam, both classes weighing as they are."""
    doc, place, n = rows
    x = np.log1p(n)
    w = np.zeros(width + dense.shape[1] + 1)
    w[-1] = np.log((target.sum() + 0.5) / ((1 - target).sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = dense @ w[width:-1] + w[-1] + np.bincount(doc, w[place] * x, minlength=len(dense))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        d = np.concatenate((np.bincount(place, g[doc] * x, minlength=width), g @ dense, [g.sum()]))
        d[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Linear(w[:width], w[width:-1], float(w[-1]))


def dense_of(lexical: np.ndarray, shares: np.ndarray, n_words: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The classifier's few dense inputs: counts of the themes' and patterns' words, hits of the mined lexicons, and how far these go beyond what their voters ask for."""
    over = np.where(np.isfinite(high), np.clip(shares / np.where(np.isfinite(high), high, 1), 0, 2), 0)
    return np.column_stack((np.log1p(lexical), np.log1p(lexical[:, : len(THEMES)].sum(1)), np.log1p(shares), over, over >= 1, np.log1p(n_words) / 4))


def each_run(batch: pa.RecordBatch, text: str = "text") -> Iterator[Words]:
    for _, _, data, offsets in runs(*buffers(batch[text])):
        yield words_of(data, offsets)


def mine(texts: DataFrame, most: int = MOST_STEMS) -> Stems:
    """The words and beginnings by which toxic texts differ most, of rows (text, toxic); rare ones of fewer than LEAST_TEXTS are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(bool)
            at = 0
            for w in each_run(batch):
                own = toxic[at : at + w.n]
                at += w.n
                for size, where, keys in stem_keys(w):
                    for side in (False, True):
                        pick = own[w.doc[where]] == side
                        if pick.any():
                            k, n = texts_with(w.doc[where][pick], keys[pick])
                            yield pa.record_batch({"key": pa.array(k.view(np.int64)), "size": pa.array(np.full(len(k), size, np.int32)), "toxic": pa.array(n * side), "clean": pa.array(n * (not side))})

    totals = texts.groupBy("toxic").count().collect()
    n_toxic, n_clean = (sum(r["count"] for r in totals if bool(r.toxic) is side) for side in (True, False))
    if not n_toxic or not n_clean:
        return Stems(np.empty(0, np.uint64))
    counted = texts.mapInArrow(run, "key long, size int, toxic long, clean long").groupBy("key", "size").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    both = (F.col("toxic") + F.col("clean") + 1) / (n_toxic + n_clean + 2)
    errors = (a - b) / F.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_clean))
    best = counted.where(F.col("toxic") >= LEAST_TEXTS).withColumn("errors", errors).where(f"errors >= {LEAST_ERRORS}").orderBy(F.desc("errors"), "key").limit(most).collect()
    return Stems(np.array([r.key for r in best], np.int64).view(np.uint64))


def texts_with(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and in how many texts each occurs."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
    k = k[new]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[at], np.diff(np.append(at, len(k)))


@dataclass
class Model:
    """All that scoring a text needs, and the label model it was taught by."""

    votes: Votes
    linear: Linear
    labels: LabelModel | None
    accuracy: dict[str, float]

    def features(self, w: Words, lexicons: Lexicons) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        counts, lexical = stem_counts(w, self.votes.table), lexicons.counts(w)
        return counts, lexical, self.votes.shares(w, counts)


def sampled(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most sample_rows labelled rows of each class, the first by a hash of their id; equal texts once."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    ids = settle(docs.select("doc_id").where("doc_id is not null").where(may_learn).distinct().join(known, "doc_id"))
    chosen = [first_by_hash(settle(ids.where(F.col("toxic") == c).select("doc_id")), sample_rows, c).withColumn("toxic", F.lit(c)) for c in (0, 1)]
    roles = settle(chosen[0].unionByName(chosen[1]))
    rows = docs.join(F.broadcast(roles), "doc_id")  # at most two samples of ids are broadcast
    return settle(rows.groupBy(F.xxhash64("text").alias("print"), "toxic").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id")).select("doc_id", "text", "toxic"))


def together(rows: list[np.ndarray], width: int, rounds: int = 20) -> np.ndarray:
    """The lexicon of each stem: texts (the places of their stems) are parted by k-means on the sphere, a stem goes where it is commonest."""
    rows = [r for r in rows if len(r)]
    if not rows:
        return np.zeros(width, np.int64)
    doc, place = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    x = np.log(len(rows) / np.bincount(place, minlength=width).clip(1))[place] + 0.1
    x /= np.sqrt(np.bincount(doc, x * x))[doc]
    some = np.zeros((min(len(rows), SEEDS), width))
    every = np.linspace(0, len(rows) - 1, len(some)).astype(int)
    of = np.full(len(rows), -1)
    of[every] = np.arange(len(some))
    pick = of[doc] >= 0
    some[of[doc[pick]], place[pick]] = x[pick]
    like, near = some @ some.T, np.zeros(len(some))
    seeds = []
    for _ in range(MINED):  # each centre starts at the text that brings all texts nearest to a centre
        seeds.append(int(np.argmax(np.maximum(like, near).sum(1))))
        near = np.maximum(near, like[seeds[-1]])
    centres = some[seeds]
    for _ in range(rounds):
        like = np.column_stack([np.bincount(doc, c[place] * x, minlength=len(rows)) for c in centres])
        mine_ = np.argmax(like, 1)
        centres = np.bincount(mine_[doc] * width + place, x, minlength=MINED * width).reshape(MINED, width)
        centres /= np.sqrt((centres**2).sum(1, keepdims=True)) + 1e-9
    held = np.bincount(mine_[doc] * width + place, minlength=MINED * width).reshape(MINED, width)
    return np.argmax(held / (np.bincount(mine_, minlength=MINED)[:, None] + 1), 0)


def thresholds(texts: DataFrame, stems: Stems) -> Votes:
    """The mined lexicons, and the hits from which their voters vote toxic, where these part the sample's classes best."""
    table = Table(stems.keys)
    width = len(table.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, places, counts = [], [], []
            for w in each_run(batch):
                doc, place, n = stem_counts(w, table)
                edges = np.searchsorted(doc, np.arange(w.n + 1)).tolist()
                n_words += w.n_words.tolist()
                places += [place[a:b].astype(np.uint16).tobytes() for a, b in zip(edges, edges[1:])]
                counts += [n[a:b].astype(np.uint32).tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.record_batch({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "n_words": pa.array(n_words, pa.int64()), "places": pa.array(places, pa.binary()), "counts": pa.array(counts, pa.binary())})

    seen = texts.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "doc_id long, toxic int, n_words long, places binary, counts binary").orderBy("doc_id", "n_words").toArrow()  # a bounded sample
    toxic = seen["toxic"].to_numpy() == 1
    places, counts = ([np.frombuffer(x, kind) for x in seen[c].to_pylist()] for c, kind in (("places", np.uint16), ("counts", np.uint32)))
    votes = Votes(table, together([p for p, t in zip(places, toxic) if t], width), np.full(MINED, np.inf))
    if toxic.any() and not toxic.all():
        doc = np.repeat(np.arange(len(places)), [len(p) for p in places])
        hits = np.bincount(doc * MINED + votes.lexicon[np.concatenate(places)], np.concatenate(counts), minlength=len(places) * MINED).reshape(-1, MINED) / np.sqrt(seen["n_words"].to_numpy() + 20)[:, None]
        for k in range(MINED):
            at = np.unique(hits[:, k][hits[:, k] > 0])
            at = at[:: max(1, len(at) // 500)]
            gain = [(hits[toxic, k] >= t).mean() - 6 * (hits[~toxic, k] >= t).mean() for t in at]  # toxic texts are the fewer, so wrong votes cost more
            if len(gain) and max(gain) > 0:
                votes.high[k] = at[int(np.argmax(gain))]
    return votes


FITTED = "doc_id long, code long, label double, places binary, counts binary, dense binary"
#: A label weighs as a voter that is right so often.
LABEL_ACCURACY = 0.98


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Mine, let vote, estimate the label model from all rows that may be learnt from, and fit the classifier on its posteriors."""
    lexicons = Lexicons()
    texts = sampled(docs, labels, may_learn, sample_rows)
    votes = thresholds(texts, mine(texts))
    voting = Model(votes, Linear(np.zeros(len(votes.table.keys)), np.zeros(0), 0.0), None, {})

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for w in each_run(batch):
                _, lexical, shares = voting.features(w, lexicons)
                codes.append(code_of(votes_of(lexical, shares, w.n_words, votes.high)))
            yield pa.record_batch({"doc_id": batch["doc_id"], "code": pa.array(np.concatenate(codes) if codes else [], pa.int64())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("code", "places", "counts", "dense")}
            for w in each_run(batch):
                (doc, place, n), lexical, shares = voting.features(w, lexicons)
                edges = np.searchsorted(doc, np.arange(w.n + 1)).tolist()
                out["code"] += code_of(votes_of(lexical, shares, w.n_words, votes.high)).tolist()
                out["dense"] += [x.tobytes() for x in dense_of(lexical, shares, w.n_words, votes.high).astype(np.float32)]
                out["places"] += [place[a:b].astype(np.uint16).tobytes() for a, b in zip(edges, edges[1:])]
                out["counts"] += [np.minimum(n[a:b], 65535).astype(np.uint16).tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.record_batch({"doc_id": batch["doc_id"], "code": pa.array(out["code"], pa.int64()), "label": batch["label"], **{c: pa.array(out[c], pa.binary()) for c in ("places", "counts", "dense")}})

    allowed = docs.where("doc_id is not null").where(may_learn)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    cast = settle(allowed.mapInArrow(vote, "doc_id long, code long"))
    patterns = cast.join(known, "doc_id", "left").groupBy("code", F.coalesce("toxic", F.lit(-1)).alias("label")).count().collect()  # 3 ** 12 patterns at most
    code, label, n = (np.array([r[k] for r in patterns], np.int64) for k in range(3))
    if not len(code):
        return voting
    pattern = votes_from(code)
    model = estimate(pattern, label, n.astype(float))
    ids = settle(cast.select("doc_id").distinct())
    chosen = F.broadcast(first_by_hash(ids, sample_rows, 2))  # a bounded sample of ids
    some = allowed.join(chosen, "doc_id", "left_semi").select("doc_id", "text", F.lit(0.5).alias("label")).unionByName(texts.select("doc_id", "text", F.col("toxic").cast("double").alias("label")))
    rows = some.mapInArrow(gather, FITTED).orderBy("doc_id", "code").toArrow()
    if not rows.num_rows:
        return voting
    places, counts = ([np.frombuffer(x, np.uint16) for x in rows[c].to_pylist()] for c in ("places", "counts"))
    dense = np.array([np.frombuffer(x, np.float32) for x in rows["dense"].to_pylist()], float)
    entries = np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate(places).astype(np.int64), np.concatenate(counts).astype(np.int64)
    told = (2 * rows["label"].to_numpy() - 1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    target = model.posterior(votes_from(rows["code"].to_numpy()), told)
    linear = fit_linear(entries, dense, target, max(len(votes.table.keys), 1))
    return Model(votes, linear, model, model.accuracies(pattern, n.astype(float)))


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher is more toxic), predicted (1 if score >= threshold).

    Only rows outside held_out (a condition on doc_id) teach the models; scores come from
    the text alone.  Null and empty texts are scored like any other.  Rows that repeat an
    id are scored each; rows without an id teach nothing; an id labelled both ways is
    toxic.  Other columns are ignored; an empty table gives no rows.  Without usable
    labels the fixed lexicons and patterns vote alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model, lexicons = train(rows, labels, ~held_out if held_out is not None else F.lit(True), sample_rows), Lexicons()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for w in each_run(batch):
                counts, lexical, shares = model.features(w, lexicons)
                dense = dense_of(lexical, shares, w.n_words, model.votes.high)
                scores.append(model.linear.score(counts, dense) if len(model.linear.dense) else np.zeros(w.n))
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
