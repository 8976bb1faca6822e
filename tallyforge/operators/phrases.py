"""Phrases that many texts share, mined level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, spread


def run_of(n: int) -> Callable[[Column], Column]:
    """The run of n words that begins at a place of _words (from 1)."""
    return lambda p: F.array_join(F.slice("_words", p, n), " ") if n > 1 else F.element_at("_words", p)


def frequent_phrases(texts: DataFrame, key: str, text: str, least_share: float = 0.2, least_words: int = 2) -> DataFrame:
    """(phrase, words, texts): the longest runs of words that least_share of the texts hold, none inside another.

    Words are what single spaces part in tidy texts.  A run of n + 1 words can only be frequent
    where both its runs of n words are, so each level looks at the places that are left.
    A level's frequent runs are few: all texts together hold at most their words over
    least_share of them, so their list goes into the expression that looks at each row's places;
    only counts of runs are shuffled, and where ids repeat, the runs of each id.
    """
    shared_folder(texts.sparkSession)
    rows = spread(texts.select(key, text)).select(F.col(key).alias("_id"), F.filter(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda w: w != "").alias("_words")).checkpoint()  # else the words would be split anew for each place
    number, ids = rows.agg(F.count("*"), F.count_distinct("_id")).first()
    least, once = least_share * number, number == ids
    places = rows.withColumn("_at", F.sequence(F.lit(1), F.size("_words"))).where(F.size("_words") > 0)
    n, whole, done = 1, None, None
    while True:
        run = run_of(n)
        runs = places.select("_id", F.explode(F.array_distinct(F.transform("_at", run))).alias("phrase"))
        often = (runs if once else runs.distinct()).groupBy("phrase").agg(F.count("*").alias("texts")).where(F.col("texts") >= least).withColumn("words", F.lit(n)).checkpoint()
        if whole is not None:
            inner = often.select(F.explode(F.array(F.regexp_replace("phrase", " [^ ]*$", ""), F.regexp_replace("phrase", "^[^ ]* ", ""))).alias("phrase"))
            whole = whole.unionByName(done.join(inner.distinct(), "phrase", "left_anti"))
        else:
            whole = often.limit(0)
        found = [x.phrase for x in often.select("phrase").collect()]
        if not found:
            break
        done = often
        kept = places.withColumn("_at", F.filter("_at", lambda p: run(p).isin(found)))
        n += 1
        following = F.array_intersect("_at", F.transform("_at", lambda p: p - 1))  # both runs inside the longer one are frequent
        places = kept.select("_id", "_words", following.alias("_at")).where(F.size("_at") > 0).checkpoint()
    return whole.where(F.col("words") >= least_words).select("phrase", "words", "texts")
