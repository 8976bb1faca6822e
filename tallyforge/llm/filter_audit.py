"""How text filters overlap, in every order of applying them.

Words of each distinct text are exploded, counted by (text, word), then by text for
totals and distinct words.  These two decide filters A and B; the flags that need no
words are joined to them.  What a filter removes in some order follows from how many
documents fail each of the 32 sets of filters, so one aggregation with 32 conditional
counts per part serves all 120 orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import numbered, settle

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Words are cut at these characters.
SPACE = r"[\x20\x09-\x0D]+"
SETS = 1 << len(FILTERS)
#: Stands for a null id: after every other.
LAST = (1 << 63) - 1


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def word_totals(texts: DataFrame, key: list[str]) -> DataFrame:
    """key, n_words and n_distinct of each text with a word; texts are already parted by key, so nothing moves."""
    words = texts.select(*key, F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    return words.groupBy(*key, "word").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failing_sets(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, good, toxic and the numbers c0 to c31 of documents that fail just the filters of each set (bit 0 is A).

    Copies of a text share all flags but E, so texts are counted once each; rows that are
    equal in text, part and labels are one row with a count before anything is joined.
    """
    rows = numbered(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "row")
    rows = rows.select("doc_id", "part", "text", "row", F.unhex(F.md5("text")).alias("digest"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    without_words = ((100 * upper > 3 * F.length("text")).cast("int") * bit("C") + F.col("text").rlike("[#$%&*|]").cast("int") * bit("D")).alias("flags")
    copies = rows.select("doc_id", "part", "digest", "row", without_words).groupBy("doc_id", "digest", "part").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.max("flags").alias("flags"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = copies.where(F.col("doc_id") != LAST).join(marks, "doc_id", "left")
    nameless = copies.where(F.col("doc_id") == LAST).withColumns({"good": F.lit(False), "toxic": F.lit(False)})  # all null ids; not a key to join by
    alike = marked.unionByName(nameless).groupBy("digest", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    groups = settle(alike.agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"), F.min("row").alias("row"), F.max("flags").alias("flags")))
    texts = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.min("row").alias("row"), F.max("flags").alias("flags"))
    wanted = texts.select("digest", "row").hint("shuffle_hash")
    totals = word_totals(rows.select("digest", "row", "text").join(wanted, ["digest", "row"], "left_semi"), ["digest", "row"])
    counted = texts.join(totals, ["digest", "row"], "left").select("digest", "least", "flags", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
    flags = F.col("flags") + (F.col("n_words") < 200).cast("int") * bit("A") + (100 * F.col("n_distinct") < 50 * F.col("n_words")).cast("int") * bit("B")
    failed = groups.drop("flags").join(counted.select("digest", "least", flags.alias("flags")), "digest")
    own = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)  # rows with the smallest id of their text
    counts = []
    for s in range(SETS):
        later = s & bit("E")
        counts.append(F.sum(F.when(F.col("flags") == s - later, F.col("n") - own if later else own).otherwise(0)).cast("long").alias(f"c{s}"))
    return failed.groupBy("part", "good", "toxic").agg(*counts)


def chosen(counts: str, condition) -> Column:
    """The sum of an array of counts over the sets for which the condition holds."""
    return F.aggregate(F.filter(F.transform(counts, lambda x, s: F.when(condition(s), x).otherwise(F.lit(0).cast("long"))), lambda x: x > 0), F.lit(0).cast("long"), lambda a, x: a + x)


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps, removes and costs.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.  Filters: A under 200 words; B fewer than half of the words
    distinct; C over 3 % ASCII capitals; D one of #$%&*|; E a smaller id has the same text.
    A null text is empty, a null part is the empty string.  A null id comes after every
    other one, has no labels, and no copy among null ids is the later one; so with rows
    that repeat both id and text.  Several labels of an id count as 1 if one is 1.  Other
    columns are ignored; an empty table gives no rows.
    """
    sets = failing_sets(docs, labels, part_col, id_col, text_col)
    gathered = lambda when: F.array(*(F.sum(F.when(when, F.col(f"c{s}")).otherwise(0)).cast("long") for s in range(SETS)))
    parts = sets.groupBy("part").agg(gathered(F.lit(True)).alias("all_"), gathered(F.col("good")).alias("good_"), gathered(F.col("toxic")).alias("toxic_"))
    at = F.col("at")
    steps = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) * len(FILTERS) - 1))).alias("at")).select(
        "part", "all_", "good_", "toxic_", F.element_at(F.array(*map(F.lit, ORDERS)), F.floor(at / len(FILTERS)).cast("int") + 1).alias("filter_order"), (at % len(FILTERS) + 1).cast("int").alias("step")
    )
    bit_of = lambda place: sum((F.when(F.substring("filter_order", place, 1) == f, bit(f)).otherwise(0) for f in FILTERS), F.lit(0))
    earlier = sum((F.when(F.col("step") > k, bit_of(k)).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0))
    own = sum((F.when(F.col("step") == k, bit_of(k)).otherwise(0) for k in range(1, len(FILTERS) + 1)), F.lit(0))
    steps = steps.withColumns({"own": own, "earlier": earlier})
    fails, passed = lambda s: s.bitwiseAND(F.col("own")) != 0, lambda s: s.bitwiseAND(F.col("earlier")) == 0
    removed = lambda counts: chosen(counts, lambda s: fails(s) & passed(s))
    share = F.aggregate(F.transform("all_", lambda x, s: F.when(fails(s), x * F.floor(F.lit(120) / F.greatest(F.bit_count(s), F.lit(1)))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return steps.select(
        "part", "filter_order", "step",
        chosen("all_", lambda s: (s.bitwiseAND(F.col("own")) == 0) & passed(s)).alias("kept"), removed("all_").alias("removed"), chosen("all_", lambda s: fails(s) & ~passed(s)).alias("redundant"), chosen("all_", lambda s: s == F.col("own")).alias("unique_fails"),
        removed("good_").alias("good_lost"), removed("toxic_").alias("toxic_lost"), share.alias("shapley"),
    )
