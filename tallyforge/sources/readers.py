"""Readers of the formats that feed the tables: delimited text, dumps, JSON, HTML tables, weather."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ";") -> DataFrame:
    """Delimited text with a header; a byte-order mark before the first name is dropped."""
    reader = spark.read.option("sep", sep).option("header", True).option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def read_pipe(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines parted by |, the last field of which may hold more of them."""
    part = F.split("value", r"\|", len(names))
    return spark.read.text(path).select(*(F.get(part, F.lit(i)).alias(n) for i, n in enumerate(names)))


#: A table's blocks are sent to all workers if they are no more; beyond, lines are joined with them by file.
FEW_BLOCKS = 10_000


def read_copy(spark: SparkSession, path: str, table: str, names: list[str]) -> DataFrame:
    """The rows of one table's COPY blocks in database dumps; \\N is null, escaped tabs, line ends and backslashes are read.

    A dump is read in as many splits as it has.  A first pass looks only at lines that open or
    close a block; a line belongs to the table if it lies between the two, by its split's
    start and its place in the split.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))  # lines of a split are numbered in their order
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    opens = lines.where(F.col("value").rlike(rf"^COPY (?:\w+\.)?{re.escape(table)} .*FROM stdin;$")).select("file", F.col("at").alias("first"))
    closes = lines.where(F.col("value") == "\\.").select("file", F.col("at").alias("last"))
    blocks = opens.join(closes, "file").where("last > first").groupBy("file", "first").agg(F.min("last").alias("last"))
    shared_folder(spark)
    blocks = blocks.checkpoint()
    if blocks.count() <= FEW_BLOCKS:
        blocks = F.broadcast(blocks)
    rows = lines.join(blocks, "file").where("at > first and at < last and value != ''")
    part = F.split("value", "\t", -1)
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("\\\\"), F.lit("\0")), F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
    return rows.select(*(F.when(F.get(part, F.lit(i)) != "\\N", plain(F.get(part, F.lit(i)))).alias(n) for i, n in enumerate(names)))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


WEATHER = "struct<hourly:struct<time:array<string>,temperature_2m:array<double>,precipitation:array<double>,weathercode:array<int>>>"


def weather_at_nine(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Rows of date, temperature, precipitation and code at 09:00 local from replies with parallel hourly arrays."""
    h = F.from_json(column, WEATHER)["hourly"]
    rows = replies.select(F.explode(F.arrays_zip(h["time"].alias("time"), h["temperature_2m"].alias("temperature"), h["precipitation"].alias("precipitation"), h["weathercode"].alias("code"))).alias("r")).select("r.*")
    return rows.where(F.substring("time", 12, 5) == "09:00").select(F.to_date(F.substring("time", 1, 10)).alias("date"), "temperature", "precipitation", "code")


REPLY = "struct<daily:struct<time:array<string>,precipitation_sum:array<double>,temperature_2m_min:array<double>,temperature_2m_max:array<double>,weathercode:array<int>>,hourly:struct<time:array<string>,temperature_2m:array<double>,weathercode:array<int>>>"


def weather_days(replies: DataFrame) -> DataFrame:
    """A row for each day of replies(first_day, last_day, reply, fetched_at): daily values, those of 09:00, status (ok, error) and note.

    A reply that can't be read gives an error row for each day that was asked for; a day
    without any value is an error too, one without a reading at 09:00 is noted.
    """
    read = replies.withColumn("_r", F.from_json("reply", REPLY)).withColumn("_n", F.size(F.coalesce("_r.daily.time", F.array())))
    bad = read.where("_n < 1").select(F.explode(F.sequence("first_day", "last_day")).alias("date"), F.lit("unreadable reply").alias("note"), "fetched_at")
    day = F.arrays_zip(*(F.coalesce(F.col(f"_r.daily.{c}"), F.array()).alias(c) for c in ("time", "precipitation_sum", "temperature_2m_min", "temperature_2m_max", "weathercode")))
    hour = F.arrays_zip(*(F.coalesce(F.col(f"_r.hourly.{c}"), F.array()).alias(c) for c in ("time", "temperature_2m", "weathercode")))
    days = read.where("_n >= 1").select("fetched_at", hour.alias("_hours"), F.explode(day).alias("_d")).withColumn("_nine", F.get(F.filter("_hours", lambda h: h["time"] == F.concat("_d.time", F.lit("T09:00"))), F.lit(0)))
    values = {"precipitation": "_d.precipitation_sum", "lowest": "_d.temperature_2m_min", "highest": "_d.temperature_2m_max", "code": "_d.weathercode", "temperature_09": "_nine.temperature_2m", "code_09": "_nine.weathercode"}
    empty = F.col("_d.precipitation_sum").isNull() & F.col("_d.temperature_2m_min").isNull() & F.col("_d.temperature_2m_max").isNull() & F.col("_nine").isNull()
    note = F.when(empty, "no values").when(F.col("_nine").isNull(), "no reading at 09:00")
    fine = days.select(F.to_date("_d.time").alias("date"), *(F.col(v).alias(k) for k, v in values.items()), F.when(empty, "error").otherwise("ok").alias("status"), note.alias("note"), "fetched_at")
    return fine.unionByName(bad.withColumn("status", F.lit("error")), allowMissingColumns=True)


def continuation_merge(rows: DataFrame, key: str, order: str, text: str, by: list[str]) -> DataFrame:
    """Rows without a key are glued to the last one that has it; rows before the first key form a group of their own."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = rows.withColumn("record", F.sum(F.when(F.col(key).isNotNull(), 1).otherwise(0)).over(w).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))  # of one record
    return tagged.groupBy(*by, "record").agg(F.min(key).alias(key), F.array_join(F.transform(parts, lambda p: p[text]), " ").alias(text))


def unpivot_calendar(wide: DataFrame, keys: list[str], days: list[str], kinds: tuple[str, ...], month: str | None = None) -> DataFrame:
    """Columns named kind_day become rows of date, kind and value; empty cells are left out.

    A day is a date, or with month (a key with the first day of a row's month) its number in the month.
    """
    long = wide.unpivot(keys, [f"{k}_{d}" for d in days for k in kinds], "cell", "value").where("value is not null")
    day = F.regexp_extract("cell", r"_(.*)$", 1)
    date = F.to_date(day) if month is None else F.date_add(month, day.cast("int") - 1)
    return long.select(*(k for k in keys if k != month), date.alias("date"), F.regexp_extract("cell", r"^(.*?)_", 1).alias("kind"), "value")


def fold_plan_fact(long: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key and date: the last plan, the last fact, comments joined in order."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col(order)))
    comments = F.array_sort(F.collect_list(F.when(F.col("comment").isNotNull(), F.struct(order, "comment"))))
    return long.groupBy(*keys, "date").agg(last("plan").alias("planned"), last("fact").alias("actual"), F.array_join(F.transform(comments, lambda c: c["comment"]), "; ").alias("comment"))


def fill_down(rows: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """Section headings carried down to the rows below them."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, True).over(w))


def stop_after_blanks(rows: DataFrame, by: list[str], order: str, column: str, blanks: int = 3) -> DataFrame:
    """Rows up to the first run of so many blank ones, without the blank ones."""
    w = Window.partitionBy(*by).orderBy(order)
    blank = F.when(F.coalesce(F.trim(column), F.lit("")) == "", 1).otherwise(0)
    run = F.sum(blank).over(w.rowsBetween(-(blanks - 1), 0))
    seen = F.max(F.when(run == blanks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_blank", blank).withColumn("_over", seen).where("_blank = 0 and _over = 0").drop("_blank", "_over")


CELL = re.compile(r"<(/?)(table|tr|td|th|li|ul|ol)\b([^>]*)>", re.I)


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of tables and lists in pages: key, block, row, cells; a cell that spans columns is repeated."""

    def parse(page: str) -> Iterator[tuple[int, int, list[str]]]:
        block, row, cells, at = 0, -1, [], None
        text = lambda a, b: " ".join(re.sub(r"<[^>]*>", " ", page[a:b]).split())
        for m in CELL.finditer(page):
            end, name = m[1], m[2].lower()
            if at is not None:
                span = int((re.search(r"colspan\s*=\s*\"?(\d+)", at[1], re.I) or [0, 1])[1])
                cells += [text(at[0], m.start())] * span
                at = None
            if name in ("tr", "li") or (name in ("table", "ul", "ol") and end):
                if cells:
                    row += 1
                    yield block, row, cells
                cells = []
            if name in ("table", "ul", "ol") and not end:
                block, row = block + 1, -1
            if name in ("td", "th", "li") and not end:
                at = (m.end(), m[3])
        if cells:
            yield block, row + 1, cells

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *r) for k, h in zip(f[key], f[html]) for r in parse(h or "")], columns=[key, "block", "row", "cells"])

    kind = pages.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("block", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])
    return pages.select(key, html).mapInPandas(run, out)


def write_export(df: DataFrame, path: str) -> None:
    """Delimited text for spreadsheets: a byte-order mark before the header, ; between fields, nulls empty, dates as DD.MM.YYYY."""
    shown = df.select(*(F.date_format(c, "dd.MM.yyyy").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))
    shown.toDF("﻿" + shown.columns[0], *shown.columns[1:]).write.mode("overwrite").option("header", True).option("sep", ";").option("nullValue", "").option("emptyValue", "").option("lineSep", "\r\n").csv(path)
