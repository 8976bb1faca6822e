"""Queries that read tables out of layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as ly
from ..sources import roles as r
from .registry import query

BOUNDS = (5.0, 40.0, 90.0, 160.0)
#: Pieces of a text with their places, as the operator's pieces().
PIECES = "pieces as (select doc_id, line, text, w.word as word, w.pos as pos from (select doc_id, line, text, unnest(list_filter(list_transform(parts, lambda p, i: {'word': p, 'pos': cast(coalesce(list_sum(list_transform(parts[1:i - 1], lambda q: length(q) + 1)), 0) as int)}), lambda x: x.word <> '')) as w from (select *, string_split(text, ' ') as parts from lines)))"
LINES = "lines as (select doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as line, unnest(string_split(text, chr(10))) as text from documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


BOXES = f"""{LINES}, {PIECES}, boxes as (select doc_id, line // 20 as page, cast(pos % 200 as double) as x0, cast(line % 20 * 40 + pos // 200 * 6 as double) as top, word as text from pieces),
 rules as (select distinct doc_id, line // 20 as page, cast(line % 20 * 40 as double) as top from lines where line % 3 = 0 or starts_with(text, 'T')),
 banded as (select b.*, (select count(*) from rules u where u.doc_id = b.doc_id and u.page = b.page and u.top <= b.top) as band from boxes b),
 cells as (select doc_id, page, band, col, string_agg(text, ' ' order by round(top / 3), x0, text) as text from (select *, len(list_filter({list(BOUNDS)}, lambda b: b <= x0)) - 1 as col from banded) where col >= 0 group by all)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out on pages: a line is 40 units high and 200 wide, longer ones go on below; every third line, and each that begins with T, has a rule above it."""
    text = lines(spark, sf_dir).withColumn("page", F.floor(F.col("line") / 20))
    rules = text.where((F.col("line") % 3 == 0) | F.col("text").startswith("T")).select("doc_id", "page", (F.col("line") % 20 * 40).cast("double").alias("top")).distinct()
    words = text.select("doc_id", "page", "line", F.explode(ly.pieces(F.col("text"))).alias("w"))
    boxes = words.select("doc_id", "page", (F.col("w.at") % 200).cast("double").alias("x0"), (F.col("line") % 20 * 40 + F.floor(F.col("w.at") / 200) * 6).cast("double").alias("top"), F.col("w.word").alias("text"))
    return ly.cells_of(boxes, rules, ["doc_id", "page"], BOUNDS)


@query(f"with {BOXES} select * from cells")
def box_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables from word boxes."""
    return cells(spark, sf_dir)


@query(f"""with {BOXES}, bands as (select doc_id, page, band, max(case when col = 0 then text end) as c0, max(case when col = 1 then text end) as c1, max(case when col = 2 then text end) as c2, max(case when col = 3 then text end) as c3 from cells group by 1, 2, 3),
 k as (select *, nullif(regexp_extract(c0, '^([A-Z][a-z]+)', 1), '') as key from bands), n as (select *, cast(count(key) over (partition by doc_id order by page, band) as int) as record from k)
 select doc_id, record, max(key) as key, coalesce(string_agg(c0, ' ' order by page, band), '') as c0, coalesce(string_agg(c1, ' ' order by page, band), '') as c1, coalesce(string_agg(c2, ' ' order by page, band), '') as c2, coalesce(string_agg(c3, ' ' order by page, band), '') as c3 from n where record > 0 group by 1, 2""")
def box_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several bands, begun by a capital word in the first column."""
    return ly.records_of(cells(spark, sf_dir), "doc_id", "page", 0, "^([A-Z][a-z]+)", 4)


@query(f"""with {LINES}, {PIECES}, h as (select *, last_value(case when regexp_matches(text, '^(The|Der|Le|El) ') then line end ignore nulls) over (partition by doc_id order by line rows between unbounded preceding and current row) as head from lines),
 w as (select p.doc_id, p.line, head, p.word, p.pos from pieces p join h using (doc_id, line) where head is not null), c as (select doc_id, head, pos as begin, word as col from w where line = head), v as (select * from w where line > head and regexp_matches(word, '^(of|and|der|de|in|la)$'))
 select doc_id, line, pos as "at", word as value, min_by(col, (abs(pos - begin), begin)) as "column" from v join c using (doc_id, head) where abs(pos - begin) <= 3 group by 1, 2, 3, 4""")
def layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some words of lines under the nearest word of the heading line above them."""
    return ly.to_columns(lines(spark, sf_dir), "doc_id", "^(The|Der|Le|El) ", "^(of|and|der|de|in|la)$", 3)


@query("""with s as (select p_partkey, p_brand, case when p_partkey % 11 = 0 then concat('Part ', p_size, '. ', p_type) when p_partkey % 4 = 1 then p_name else concat(p_partkey, '') end as first, case when p_partkey % 11 <> 0 and p_partkey % 4 <> 1 then p_name end as name from part),
 m as (select *, case when name is null and regexp_matches(first, '^Part \\d+\\. ') then first end as sec, case when name is null and not regexp_matches(first, '^Part \\d+\\. ') then first end as sub from s),
 n as (select *, last_value(sec ignore nulls) over w as section, count(sec) over w as part_no from m window w as (partition by p_brand order by p_partkey rows between unbounded preceding and current row)),
 f as (select *, last_value(sub ignore nulls) over (partition by p_brand, part_no order by p_partkey rows between unbounded preceding and current row) as subsection from n)
 select p_partkey, name, section, subsection from f where sec is null and sub is null""")
def estimate_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of estimates under their sections and subsections."""
    k, first = F.col("p_partkey"), F.col("first")
    sheet = r.read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(k % 11 == 0, F.concat(F.lit("Part "), F.col("p_size").cast("string"), F.lit(". "), "p_type")).when(k % 4 == 1, F.col("p_name")).otherwise(k.cast("string")).alias("first"), F.when((k % 11 != 0) & (k % 4 != 1), F.col("p_name")).alias("name"))
    alone, part = F.col("name").isNull(), first.rlike(r"^Part \d+\. ")
    return ly.under_headings(sheet, "p_brand", "p_partkey", F.when(alone & part, first), F.when(alone & ~part, first)).select("p_partkey", "name", "section", "subsection")
