"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Word, symbol and repetition statistics of every text are transformed to ratios.  For each
language and source, concentration steps towards the minimum covariance determinant
estimate (mean and covariance of the rows closest to the current ones) begin at two
starts, medians with quartile ranges and the plain mean with covariance, go on until no
determinant falls, and the fit with the smaller determinant is taken: a centre and
scatter that outliers don't move.  A row too far from it in Mahalanobis distance is
rejected.  All of it is DataFrame expressions: sums of fixed-point products, a Cholesky
factor written out, and quantiles from exact histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import settle

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Fixed point of a transformed statistic; products of two, none above 2**24, then add up exactly in a long for 10**11 rows.
UNIT = 1 << 12
#: A covariance's diagonal is raised by this variance, so that a statistic that is constant in a group does not reject what differs by chance.
LEAST_SPREAD = {"chars": 0.05, "symbols": 0.05, "lines": 0.05, "repeats": 0.05}
#: Each group's estimate counts so many rows' worth of its language's, so a small group is drawn towards it and a large one is its own.
LEAST_GROUP = 2
#: Share of rows that the estimate rests on; the most steps towards it, and the fall of a determinant's logarithm that counts.
CORE, STEPS, LEAST_FALL = 0.75, 12, 1e-3
#: A group's fit has some 200 bytes; up to so many are broadcast, more are joined by shuffle.
BROADCAST_GROUPS = 50_000
#: What a fit is for; a start counts as one language more.
KEYS = ("start", "lang", "source")
#: The median and the 99.9 % point of chi-squared with 4 degrees of freedom.
MEDIAN_4, MOST_4 = 3.356694, 18.466827
#: Squared distances are counted in bins of 1/64 of a natural logarithm.
BINS = 64


def base_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and the five counts of each text (null: none)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("t"))
    words = F.filter(F.split("t", SPACE), lambda w: w != "")
    rows = rows.withColumn("w", words).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0))
    n = F.size("w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("g", grams)
    # windows in order of fingerprint and place; those next to an equal one are repeated, and each covers what the one before in the text leaves
    ranked = F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("r", F.when(F.size(F.array_distinct("g")) < F.size("g"), ranked))
    twice = F.sort_array(F.transform(F.filter(F.transform("r", lambda x, k: F.struct(x["i"].alias("i"), ((x["g"] == F.get("r", k - 1)["g"]) | (x["g"] == F.get("r", k + 1)["g"])).alias("again"))), lambda x: x["again"]), lambda x: x["i"]))
    rows = rows.withColumn("p", twice)
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(
        "doc_id", "lang", "source",
        n.cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def transformed() -> dict[str, Column]:
    """The statistics whose vectors are compared, as fixed-point integers."""
    c = F.col
    words, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    values = {"chars": F.log1p(c("word_chars") / words), "symbols": F.sqrt(c("n_symbols") / F.greatest(c("word_chars"), F.lit(1))), "lines": F.sqrt(c("n_dup_lines") / lines), "repeats": F.sqrt(c("n_repeat_words") / words)}
    return {k: F.round(v * UNIT).cast("long") for k, v in values.items()}


NAMES = tuple(LEAST_SPREAD)
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]


def towards_language(groups: DataFrame, languages: DataFrame, names: list[str], weight: float) -> DataFrame:
    """Values of groups of n rows, averaged with `weight` rows' worth of their language's."""
    n, whole = F.col("n"), languages.select("start", "lang", *(F.col(a).alias(f"of_{a}") for a in names))
    return groups.join(whole, ["start", "lang"]).select(*KEYS, *(((n * F.col(a) + weight * F.col(f"of_{a}")) / (n + weight)).alias(a) for a in names))


def scatter(core: DataFrame, sizes: DataFrame, weight: float) -> DataFrame:
    """Mean and Cholesky factor of each group's covariance, from exact integer sums, and half its determinant's logarithm; a group without core rows has its language's."""
    parts = {f"m_{a}": F.col(a) for a in NAMES} | {f"q_{a}_{b}": F.col(a) * F.col(b) for a, b in PAIRS}
    sums = settle(core.groupBy(*KEYS).agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in parts.items())))
    whole = sums.groupBy("start", "lang").agg(F.sum("n").alias("n"), *(F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in parts))
    unit = {k: UNIT if k in [f"m_{a}" for a in NAMES] else UNIT * UNIT for k in parts}
    mean = lambda rows, *keys: rows.select(*keys, "n", *((F.col(k).cast("double") / F.col("n") / unit[k]).alias(k) for k in parts))
    own = sizes.join(mean(sums, *KEYS), list(KEYS), "left").na.fill(0)
    out = towards_language(own, mean(whole, "start", "lang"), list(parts), weight)
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[: i + 1]):
            rest = F.col(f"q_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")
            for k in NAMES[:j]:
                rest = rest - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(0.0)) + LEAST_SPREAD[a] ** 2) if a == b else rest / F.col(f"l_{b}_{b}"))
    return out.drop(*(f"q_{a}_{b}" for a, b in PAIRS)).withColumn("size", sum((F.log(f"l_{a}_{a}") for a in NAMES), F.lit(0.0)))


def quartile_fit(rows: DataFrame, weight: float) -> DataFrame:
    """Medians and interquartile ranges of each group; from counts of rounded values, so exact and small."""
    rounded = {a: F.round(F.col(a) * 128 / UNIT) for a in NAMES}
    names = [f"p{k}_{a}" for a in NAMES for k in range(3)]

    def quartiles(*keys: str) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile(rounded[a], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p_{a}") for a in NAMES))
        return found.select(*keys, "n", *((F.get(f"p_{a}", F.lit(k)) / 128).alias(f"p{k}_{a}") for a in NAMES for k in range(3)))

    found = towards_language(quartiles(*KEYS), quartiles("start", "lang"), names, weight)
    out = found.select(*KEYS, *(F.col(f"p1_{a}").alias(f"m_{a}") for a in NAMES), *(F.sqrt(F.pow((F.col(f"p2_{a}") - F.col(f"p0_{a}")) / 1.349, F.lit(2)) + LEAST_SPREAD[a] ** 2).alias(f"l_{a}_{a}") for a in NAMES))
    return out.withColumns({f"l_{a}_{b}": F.lit(0.0) for a, b in PAIRS if a != b}).withColumn("size", F.lit(float("inf")))


def with_fit(rows: DataFrame, fit: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """rows with their groups' values; a hot group is not gathered where the values are few enough to broadcast."""
    return rows.join(F.broadcast(fit) if small else fit, keys)


def distance(rows: DataFrame, fit: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance from their group's centre, and its bin."""
    out = with_fit(rows, fit, keys, small)
    for i, a in enumerate(NAMES):
        rest = F.col(a) / UNIT - F.col(f"m_{a}")
        for b in NAMES[:i]:
            rest = rest - F.col(f"l_{a}_{b}") * F.col(f"y_{b}")
        out = out.withColumn(f"y_{a}", rest / F.col(f"l_{a}_{a}"))
    out = out.withColumn("d2", sum((F.col(f"y_{a}") * F.col(f"y_{a}") for a in NAMES), F.lit(0.0)))
    return out.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-12) * BINS).cast("long")).select(*dict.fromkeys([*keys, *rows.columns]), "d2", "bin")


def quantile_bin(rows: DataFrame, share: float, name: str, weight: float) -> DataFrame:
    """The bin of d2 by which so large a share of each group's rows is reached, drawn towards the language's."""
    counts = settle(rows.groupBy(*KEYS, "bin").count())

    def reached(*keys: str) -> DataFrame:
        whole = counts.groupBy(*keys, "bin").agg(F.sum("count").alias("count")).groupBy(*keys).agg(F.sum("count").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "count")))).alias("bins"))  # as many bins as a double's logarithm has
        entries = F.array_sort(F.map_entries("bins"))
        reach = F.aggregate(entries, F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("bin")), lambda s, x: F.struct((s["n"] + x["value"]).alias("n"), F.coalesce(s["bin"], F.when(s["n"] + x["value"] >= F.col("n") * share, x["key"])).alias("bin")))
        return whole.select(*keys, "n", reach["bin"].alias(name))

    return towards_language(reached(*KEYS), reached("start", "lang"), [name], weight)


def least_determinants(vectors: DataFrame, core: float, steps: int, weight: float, small: bool) -> DataFrame:
    """The fit of each language and source: of the starts' steps, the one with the smallest determinant."""
    keys = list(KEYS)
    twice = vectors.select(F.explode(F.array(F.lit("mean"), F.lit("median"))).alias("start"), "lang", "source", *NAMES)
    medians = vectors.select(F.lit("median").alias("start"), "*")
    sizes = settle(twice.select(*KEYS).distinct())
    fit = settle(quartile_fit(medians, weight).unionByName(scatter(vectors.select(F.lit("mean").alias("start"), "*"), sizes.where("start = 'mean'"), weight)))
    for step in range(steps):
        near = distance(twice, fit, keys, small)
        cut = quantile_bin(near, core, "cut", weight)
        new = scatter(with_fit(near, cut, keys, small).where("bin <= cut + 1e-6"), sizes, weight)
        old = fit.select(*KEYS, F.struct(*fit.columns).alias("old"))
        falls = (F.col("old.size") - F.col("size") > LEAST_FALL) if step else F.lit(True)  # a start's own determinant is of all rows
        new = settle(new.withColumn("new", F.struct(*fit.columns)).join(old, keys).select(F.when(falls, F.col("new")).otherwise(F.col("old")).alias("fit"), falls.alias("falls")))
        fit = new.select("fit.*")
        if not new.where("falls").limit(1).count():
            break
    return fit.groupBy("lang", "source").agg(F.min_by(F.struct(*fit.columns), F.struct("size", "start")).alias("fit")).select("fit.*")


def quality_rules(docs: DataFrame, most_distance: float = MOST_4, core: float = CORE, steps: int = STEPS, least_group: int = LEAST_GROUP, broadcast_groups: int = BROADCAST_GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2.

    A row fails the base rules with under 50 words or with more than half its words in
    repeated 3-word windows.  Of the others, those whose squared distance (scaled down where
    the group's median is above that of chi-squared) exceeds most_distance are not kept.
    Every language and source is estimated itself, with least_group (above 0) rows' worth
    of its language.  A null
    text has no words; null lang and source count as empty; an empty table gives no rows;
    repeated rows each count; other columns are ignored.  d2 is null where a row failed.
    """
    stats = base_stats(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = settle(stats.withColumn("base_failed", failed).withColumns(transformed()))
    able = rows.where("not base_failed")
    vectors = able.select("lang", "source", *NAMES)
    small = 2 * vectors.select("lang", "source").distinct().limit(broadcast_groups + 1).count() <= broadcast_groups
    fit = settle(least_determinants(vectors, core, steps, least_group, small))
    near = distance(able, fit.drop("start"), ["lang", "source"], small).withColumn("start", F.lit(""))
    scale = settle(quantile_bin(near, 0.5, "mid", least_group)).drop("start")
    judged = with_fit(near, scale, ["lang", "source"], small)
    judged = judged.withColumn("d2", F.col("d2") * F.least(F.lit(1.0), MEDIAN_4 / F.exp((F.col("mid") + 0.5) / BINS)))
    result = judged.select("doc_id", *STATS, "base_failed", (F.col("d2") <= most_distance).alias("kept"), "d2")
    return result.unionByName(rows.where("base_failed").select("doc_id", *STATS, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2")))
