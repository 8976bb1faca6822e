"""Tables out of page layouts: word boxes, positions in lines, nested headings of sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells_of(words: DataFrame, rules: DataFrame, page: Sequence[str], bounds: Sequence[float], line: float = 3.0) -> DataFrame:
    """page, band, col, text: what stands in each cell of pages of words(page, x0, top, text) between rules(page, top).

    A word is in the band of the last rule that is not below it (band 0 is above all rules)
    and in the column whose left bound is the last one up to its x0; words left of the first
    bound are no part of the table.  In a cell words go by lines, `line` units high, then by x0.
    A page's words stand in one task.
    """
    both = words.select(*page, "x0", "top", "text").unionByName(rules.select(*page, F.lit(None).cast("double").alias("x0"), "top", F.lit(None).cast("string").alias("text")))
    above = Window.partitionBy(*page).orderBy("top", F.col("text").isNotNull()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    banded = both.withColumn("band", F.count_if(F.col("text").isNull()).over(above)).where(F.col("text").isNotNull())
    col = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b <= F.col("x0"))) - 1
    placed = banded.withColumn("col", col).where("col >= 0")
    order = F.struct(F.round(F.col("top") / line).alias("line"), "x0", "text")
    return placed.groupBy(*page, "band", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda w: w["text"]), " ").alias("text"))


def records_of(cells: DataFrame, document: str, page: str, anchor_col: int, anchor: str, columns: int) -> DataFrame:
    """document, record, key and the texts c0, c1, ... of records that begin at a band whose anchor column matches a pattern (its first group is the key) and go on to the next such band, over pages too."""
    bands = cells.groupBy(document, page, "band").agg(*(F.max(F.when(F.col("col") == c, F.col("text"))).alias(f"c{c}") for c in range(columns)))
    key = F.nullif(F.regexp_extract(f"c{anchor_col}", anchor, 1), F.lit(""))
    order = Window.partitionBy(document).orderBy(page, "band").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of one document
    numbered = bands.withColumn("key", key).withColumn("record", F.count("key").over(order).cast("int")).where("record > 0")
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(page, "band", c)))), lambda x: x[c]), " ").alias(c)
    return numbered.groupBy(document, "record").agg(F.max("key").alias("key"), *(whole(f"c{c}") for c in range(columns)))


def pieces(line: Column) -> Column:
    """The words of a line that single spaces part, with the places where they begin (from 0)."""
    parts = F.filter(F.split(line, " "), lambda p: p != "")
    begin = lambda chars: F.filter(F.transform(chars, lambda c, i: F.when((c != " ") & (c != "") & ((i == 0) | (F.get(chars, i - 1) == " ")), i)), lambda i: i.isNotNull())
    begins = F.get(F.transform(F.array(F.split(line, "")), begin), 0)  # the characters are bound once, so it is linear in the line
    return F.zip_with(begins, parts, lambda at, word: F.struct(at.alias("at"), word.alias("word")))


def to_columns(lines: DataFrame, document: str, header: str, value: str, tolerance: int) -> DataFrame:
    """document, line, at, value, column of the values in lines(document, line, text) that stand under a column of the header above them.

    A line with a match of `header` is one, its words are the columns; in the lines up to the
    next one, words that match `value` belong to the column that begins nearest, by at most
    `tolerance` characters; of two as near, to the left one.
    """
    order = Window.partitionBy(document).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of one document
    under = lines.withColumn("head", F.last(F.when(F.col("text").rlike(header), F.col("line")), True).over(order)).where(F.col("head").isNotNull())
    words = under.select(document, "line", "head", F.explode(pieces(F.col("text"))).alias("w"))
    columns = words.where(F.col("line") == F.col("head")).select(document, "head", F.col("w.at").alias("begin"), F.col("w.word").alias("column"))
    values = words.where((F.col("line") > F.col("head")) & F.col("w.word").rlike(value)).select(document, "line", "head", F.col("w.at").alias("at"), F.col("w.word").alias("value"))
    near = values.join(columns, [document, "head"]).where(F.abs(F.col("at") - F.col("begin")) <= tolerance)  # of one table
    return near.groupBy(document, "line", "at", "value").agg(F.min_by("column", F.struct(F.abs(F.col("at") - F.col("begin")), "begin")).alias("column"))


def under_headings(rows: DataFrame, sheet: str, order: str, section: Column, subsection: Column) -> DataFrame:
    """rows with section and subsection filled down: a heading holds to the next of its level, a section ends the subsection before it.  section and subsection are the headings' texts, null in other rows; heading rows go."""
    down = Window.partitionBy(sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of one sheet
    marked = rows.withColumns({"_section": section, "_sub": subsection})
    heading = F.when(F.col("_section").isNotNull(), F.struct("_section", F.lit(None).cast("string").alias("_sub"))).when(F.col("_sub").isNotNull(), F.struct(F.lit(None).cast("string").alias("_section"), "_sub"))
    seen = marked.withColumn("section", F.last("_section", True).over(down)).withColumn("_last", F.last(heading, True).over(down))
    # the last heading of any level is a subsection's exactly where one holds
    return seen.withColumn("subsection", F.col("_last._sub")).where("_section is null and _sub is null").drop("_section", "_sub", "_last")
