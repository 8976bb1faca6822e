"""Tables out of layouts on small pages."""

from pyspark.sql import functions as F

from tallyforge.operators import layout as ly

WORDS = "page int, x0 double, top double, text string"


def test_cells_of_a_shifted_page(spark):
    words = [(0, 12.0, 105.0, "1.1"), (0, 60.0, 103.0, "Crack"), (0, 75.0, 104.0, "in"), (0, 60.0, 112.0, "wall"), (0, 3.0, 104.0, "margin"), (0, 60.0, 120.0, "next"), (0, 60.0, 90.0, "head"), (1, 60.0, 500.0, "other page")]
    rules = [(0, 100.0), (0, 120.0), (0, 120.0)]  # a word on a rule belongs below it
    cells = ly.cells_of(spark.createDataFrame(words, WORDS), spark.createDataFrame(rules, "page int, top double").distinct(), ["page"], (10.0, 50.0))
    assert {tuple(r) for r in cells.collect()} == {(0, 1, 0, "1.1"), (0, 1, 1, "Crack in wall"), (0, 2, 1, "next"), (0, 0, 1, "head"), (1, 0, 1, "other page")}
    shifted = ly.cells_of(spark.createDataFrame([(p, x + 4, t, w) for p, x, t, w in words], WORDS), spark.createDataFrame(rules, "page int, top double").distinct(), ["page"], (14.0, 54.0))
    assert sorted(map(tuple, shifted.collect())) == sorted(map(tuple, cells.collect()))


def test_records_go_on_over_pages(spark):
    cells = [(7, 0, 0, 0, "head"), (7, 0, 1, 0, "№ 12"), (7, 0, 1, 1, "first"), (7, 0, 2, 1, "more"), (7, 1, 0, 1, "and more"), (7, 1, 1, 0, "№ 13"), (8, 0, 0, 1, "no anchor")]
    got = ly.records_of(spark.createDataFrame(cells, "doc int, page int, band int, col int, text string"), "doc", "page", 0, r"№ (\d+)", 2).collect()
    assert {tuple(r) for r in got} == {(7, 1, "12", "№ 12", "first more and more"), (7, 2, "13", "№ 13", "")}


def test_values_under_columns(spark):
    lines = [(1, 0, "5 before"), (1, 1, "HEAD aa    bb   cc"), (1, 2, "     7   8      9"), (1, 3, ""), (1, 4, "HEAD  x"), (1, 5, "      3            4"), (2, 0, "1 2")]
    got = ly.to_columns(spark.createDataFrame(lines, "doc int, line int, text string"), "doc", "^HEAD", r"^\d+$", 3)
    assert {(r.line, r.value, r.column) for r in got.collect()} == {(2, "7", "aa"), (2, "8", "bb"), (2, "9", "cc"), (5, "3", "x")}


def test_headings_reset_those_below(spark):
    rows = [(1, "S1", None), (2, None, None), (3, "a", None), (4, None, "p"), (5, "S2", None), (6, None, "q"), (7, "b", None), (8, None, "r"), (9, None, "t")]
    df = spark.createDataFrame([("x", *r) for r in rows], "sheet string, n int, head string, name string")
    section = F.when(F.col("head").startswith("S"), F.col("head"))
    got = ly.under_headings(df, "sheet", "n", section, F.when(section.isNull(), F.col("head"))).orderBy("n").collect()
    assert [(r.n, r.section, r.subsection) for r in got] == [(2, "S1", None), (4, "S1", "a"), (6, "S2", None), (8, "S2", "b"), (9, "S2", "b")]


def test_pieces_of_a_long_line(spark):
    """Places take time in proportion to a line; counting each from its line's begin took its square."""
    line = "  é𝄞 b   " + "word " * 40000
    got = spark.createDataFrame([(line,), ("",), (" ",), ("a",)], "line string").select(ly.pieces(F.col("line")).alias("w"))
    rows = [[(x.at, x.word) for x in r.w] for r in got.collect()]
    assert rows[0] == [(2, "é𝄞"), (5, "b"), *((9 + 5 * k, "word") for k in range(40000))] and rows[1:] == [[], [], [(0, "a")]]
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
