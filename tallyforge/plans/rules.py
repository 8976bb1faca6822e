"""Queries of registers and of rules on free texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import matching as m
from ..operators import register as g
from ..sources import roles as r
from .registry import query

TO = r.TODAY_ORDERS


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.read(spark, sf_dir, "orders")


@query("""with s as (select o_orderkey, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%d.%m.%Y') when 1 then strftime(o_orderdate, '%Y-%m-%d') else 'soon' end as a, strftime(cast(o_orderdate as date) + cast(o_orderkey % 40 - 20 as int), '%Y-%m-%d') as b from orders),
 p as (select o_orderkey, coalesce(cast(try_strptime(a, '%d.%m.%Y') as date), cast(try_strptime(a, '%Y-%m-%d') as date), date '1998-01-01') as a, coalesce(cast(try_strptime(b, '%d.%m.%Y') as date), cast(try_strptime(b, '%Y-%m-%d') as date), date '1998-12-31') as b from s) select o_orderkey, least(a, b) as first, greatest(a, b) as last from p""")
def settings_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window by two settings: typed, by default where a text is none, swapped if they are the wrong way round."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    a = F.when(k % 3 == 0, F.date_format(day, "dd.MM.yyyy")).when(k % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise("soon")
    b = F.date_format(F.date_add(F.to_date(day), (k % 40 - 20).cast("int")), "yyyy-MM-dd")
    typed = lambda x, default: F.coalesce(F.try_to_date(x, "dd.MM.yyyy"), F.try_to_date(x, "yyyy-MM-dd"), F.lit(default).cast("date"))
    first, last = typed(a, "1998-01-01"), typed(b, "1998-12-31")
    return orders(spark, sf_dir).select("o_orderkey", F.least(first, last).alias("first"), F.greatest(first, last).alias("last"))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F' and o_totalprice >= 100000")
def filtered_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register by optional filters, of which two are given."""
    given = {"status": F.col("o_orderstatus") == "F", "customer": None, "least": F.col("o_totalprice") >= 100000, "search": None}
    return g.where_given(orders(spark, sf_dir), given).select("o_orderkey", "o_orderstatus")


@query("select o_orderkey from orders where regexp_matches(concat(substr(o_orderpriority, 3, 2), '-', o_orderkey), '^..-\\d+$') and cast(o_custkey as varchar) = '7'")
def code_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a form, with a number searched as text."""
    code = F.concat(F.substring("o_orderpriority", 3, 2), F.lit("-"), F.col("o_orderkey").cast("string"))
    return orders(spark, sf_dir).where(code.rlike(r"^..-\d+$") & (F.col("o_custkey").cast("string") == "7")).select("o_orderkey")


CURRENT = f"""{r.STATUS_LOG}, cur as (select row_id, status from status_log qualify row_number() over (partition by row_id order by status_date desc, created_at desc, id desc) = 1), sections as (select p_partkey as row_id from part), held as (select row_id, status from sections left join cur using (row_id))"""


@query(f"with {CURRENT} select 'all' as wanted, count(*) as n from held union all select 'none', count(*) from held where status is null union all select 'signed', count(*) from held where status = 'signed'")
def current_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sections each of three filters on the current status leaves."""
    from ..operators.versioned import latest

    current = latest(r.status_log(spark, sf_dir), ["row_id"], ["status_date", "created_at", "id"]).select("row_id", "status")
    held = r.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id")).join(current, "row_id", "left")
    return g.hub_counts({w: g.with_status(held, "status", w) for w in ("all", "none", "signed")}).withColumnRenamed("name", "wanted")


BLOCKS = "blocks as (select user_id as row_id, case when event_type <> 'error' then event_type end as work_type, event_id as block_id, case when event_id % 3 = 0 then cast(ts as date) end as unblocked_at from events where event_id % 5 = 0)"


@query(f"with {r.STATUS_LOG}, {BLOCKS} select id, block_id from status_log s join blocks b on s.row_id = b.row_id and s.work_type is not distinct from b.work_type and b.unblocked_at is null where s.status = 'returned'")
def open_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned entries with the blocks that are open for their row and work type, no type being a type too."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    blocks = r.read(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("user_id").alias("row_id"), kind.alias("work_type"), F.col("event_id").alias("block_id"), F.when(F.col("event_id") % 3 == 0, F.to_date("ts")).alias("unblocked_at"))
    log = r.status_log(spark, sf_dir).where("status = 'returned'").select("id", "row_id", "work_type")
    return g.null_safe(log, blocks.where("unblocked_at is null").drop("unblocked_at"), ["row_id", "work_type"]).select("id", "block_id")


@query("""with reg as (select n_name as name, n_nationkey as code from nation union all select 'NATION_3', 99), one as (select name, case when count(*) = 1 then min(code) end as code from reg group by 1),
 c as (select c_custkey, concat('NATION_', c_nationkey, case when c_custkey % 2 = 0 then ' (old)' else '' end) as name from customer)
 select c_custkey, case when a.name is not null then a.code else b.code end as code from c left join one a on a.name = c.name left join one b on b.name = trim(regexp_replace(c.name, '\\s*\\([^)]*\\)', ''))""")
def literal_fallback_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by equal names, else by the names without brackets, none where two are equal."""
    register = r.read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("code"))
    twice = register.where("name = 'NATION_3'").withColumn("code", F.lit(99).cast("long"))
    name = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, " (old)").otherwise(""))
    rows = r.read(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    return g.literal_match(rows, register.unionByName(twice), "c_custkey", "name", "code")


@query("select 'works' as name, count(*) as n from part union all select 'orders', count(*) from orders union all select 'open', count(*) from orders where o_orderstatus = 'O'")
def hub_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.hub_counts({"works": r.read(spark, sf_dir, "part"), "orders": orders(spark, sf_dir), "open": orders(spark, sf_dir).where("o_orderstatus = 'O'")})


@query(f"with {r.TERMS} select least(date '1997-01-01', min(current_start), date '{TO}') as first, greatest(max(current_finish), date '{TO}') as last from terms")
def project_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last day of a project: by its directive dates if set, its schedule, and today."""
    date = lambda x: F.lit(x).cast("date")
    one = r.terms(spark, sf_dir).agg(F.min("current_start").alias("a"), F.max("current_finish").alias("b"))
    return one.select(F.least(date("1997-01-01"), "a", date(TO)).alias("first"), F.greatest(date(None), F.col("b"), date(TO)).alias("last"))


@query("select count(*) as total, count(*) filter (where p_size % 4 <> 0) as matched, round_even(100.0::double * count(*) filter (where p_size % 4 <> 0) / count(*), 1) as percent, cast(sum(case when p_size % 4 <> 0 then p_size end) as bigint) as hours from part")
def match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positions have a norm, and the hours of those."""
    norm = F.when(F.col("p_size") % 4 != 0, F.col("p_size"))
    return r.read(spark, sf_dir, "part").agg(F.count("*").alias("total"), F.count(norm).alias("matched"), F.bround(F.lit(100.0) * F.count(norm) / F.count("*"), 1).alias("percent"), F.sum(norm).cast("long").alias("hours"))


@query("select l_partkey, l_orderkey, l_linenumber, case when l_linestatus = 'F' then l_quantity end as hours from lineitem qualify row_number() over (partition by l_partkey order by case when l_linestatus = 'F' then 0 else 1 end, l_orderkey * 10 + l_linenumber) = 1")
def best_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a norm: the first with hours, else the first."""
    rows = r.read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("hours"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return g.best_filled(rows, "l_partkey", "hours", "seq").drop("seq")


@query(f"""with {r.STATUS_LOG}, a as (select row_id, status as by_date from status_log qualify row_number() over (partition by row_id order by status_date desc, created_at desc) = 1),
 b as (select row_id, status as by_entry from status_log qualify row_number() over (partition by row_id order by created_at desc, id desc) = 1) select row_id, by_date, by_entry from a join b using (row_id)""")
def two_currents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.two_currents(r.status_log(spark, sf_dir), ["row_id"], "status")


@query("""with o as (select p_brand, max(p_size) as last from part where p_partkey % 3 <> 0 group by 1), n as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as n from part where p_partkey % 3 = 0)
 select p_partkey, concat('WK-', p_brand, '-', case when length(cast(coalesce(last, 0) + n as varchar)) < 3 then lpad(cast(coalesce(last, 0) + n as varchar), 3, '0') else cast(coalesce(last, 0) + n as varchar) end) as code from n left join o using (p_brand)""")
def next_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of new works that go on after the largest of their source."""
    part = r.read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws("-", F.lit("WK"), "p_brand", F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("code"))
    return g.next_codes(part.where("p_partkey % 3 = 0").drop("code"), part.where("p_partkey % 3 != 0"), "p_brand", "code", "p_partkey", "WK-").select("p_partkey", "code")


@query("select o_orderkey, o_orderpriority = '1-URGENT' as urgent, round(o_totalprice / 1000, 0) as score from orders order by urgent desc, score desc, o_orderkey limit 200")
def urgent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows by a condition, then by a score, equal ones by id."""
    rows = orders(spark, sf_dir).select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.round(F.col("o_totalprice") / 1000, 0).alias("score"))
    return rows.orderBy(F.desc("urgent"), F.desc("score"), "o_orderkey").limit(200)


@query("select count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_orderstatus = 'P') as going, count(*) filter (where o_orderstatus = 'O') as waiting, count(*) as total, count(*) filter (where o_orderstatus not in ('F','P','O') or o_orderstatus is null) = 0 as holds from orders")
def partition_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.partition_identity(orders(spark, sf_dir), {"done": F.col("o_orderstatus") == "F", "going": F.col("o_orderstatus") == "P", "waiting": F.col("o_orderstatus") == "O"})


ALIASES = [(alias, unit) for unit, names in t.UNITS.items() for alias in names] + [("ведро", "ведро")]


@query(f"""with texts as (select p_partkey, concat(case p_size % 3 when 0 then concat(p_size * 10, ' ') when 1 then concat(p_size, ' 000 ') else '' end, upper({[a for a, _ in ALIASES]}[(p_partkey + p_size) % {len(ALIASES)} + 1]), case when p_size % 2 = 0 then '.' else '' end) as text from part),
 low as (select p_partkey, regexp_replace(lower(trim(text)), '\\.+$', '') as text from texts), cut as (select p_partkey, regexp_extract(text, '^([0-9][0-9\\s]*)', 1) as number, trim(regexp_replace(text, '^[0-9][0-9\\s]*', '')) as rest from low)
 select p_partkey, coalesce(known, rest) as unit, case when number <> '' then cast(replace(number, ' ', '') as double) else 1.0 end as factor from cut left join (values {", ".join(map(str, ALIASES))}) v(alias, known) on alias = rest""")
def unit_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as they are written with a number by the part's size, read back."""
    size = F.col("p_size")
    number = F.when(size % 3 == 0, F.concat((size * 10).cast("string"), F.lit(" "))).when(size % 3 == 1, F.concat(size.cast("string"), F.lit(" 000 "))).otherwise("")
    alias = F.upper(F.element_at(F.array(*(F.lit(a) for a, _ in ALIASES)), ((F.col("p_partkey") + size) % len(ALIASES) + 1).cast("int")))
    rows = r.read(spark, sf_dir, "part").select("p_partkey", F.concat(number, alias, F.when(size % 2 == 0, ".").otherwise("")).alias("text"))
    unit, factor = t.unit_and_factor(F.col("text"))
    return rows.select("p_partkey", unit.alias("unit"), factor.alias("factor"))


@query("select p_partkey, case when p_name ilike 'small%' or p_name ilike 'cold%' then 'neg' when p_name ilike 'large%' or p_name ilike 'hot%' then 'pos' end as polarity, p_name ilike '%widget%' and p_brand = 'Brand#1' as conflict from part")
def polarity_and_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a name takes away or puts up, and whether its material contradicts the brand's."""
    words = m.words(F.col("p_name"))
    other = F.when(F.col("p_brand") == "Brand#1", F.array(F.lit("bolt"))).otherwise(F.array().cast("array<string>"))
    return r.read(spark, sf_dir, "part").select("p_partkey", t.polarity(words, ["small", "cold"], ["large", "hot"]).alias("polarity"), t.material_conflict(words, other, [["widget"], ["bolt"]]).alias("conflict"))


KINDS = [*t.PLACES, *t.HYPHEN_PLACES, "склад"]
MONTHS, MONTHS_OF = list(t.MONTHS), list(t.MONTHS_OF)
PLACE_SQL = f"concat(o_orderpriority, ' ', lower({KINDS}[o_orderkey % {len(KINDS)} + 1]), ['', ' ', '-'][o_custkey % 3 + 1], o_custkey % 40, case when o_orderkey % 2 = 0 then '.1' else '' end, ', ', o_clerk)"
MONTH_SQL = f"case when o_orderkey % 5 = 0 then o_orderpriority else concat(upper({MONTHS}[month(o_orderdate)]), '-', {MONTHS}[month(o_orderdate + interval 60 day)]) end"
DATE_SQL = f"""case o_orderkey % 4 when 0 then concat('от «', day(o_orderdate), '» ', {MONTHS_OF}[month(o_orderdate)], ' ', year(o_orderdate), ' г.') when 1 then concat('до ', day(o_orderdate), '.', month(o_orderdate), '.', strftime(o_orderdate, '%y'))
 when 2 then concat('к ', strftime(o_orderdate, '%d.%m.%Y'), '.') else concat(day(o_orderdate), '.', month(o_orderdate) + 12, '.', year(o_orderdate)) end"""


@query(f"""with texts as (select o_orderkey, {PLACE_SQL} as place, {MONTH_SQL} as months, {DATE_SQL} as day from (select *, concat('Clerk', o_custkey) as o_clerk from orders)),
 cut as (select *, regexp_extract(place, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])((?:(?:{"|".join(t.PLACES)})\\s?|(?:{"|".join(t.HYPHEN_PLACES)})[\\s-]?)[0-9]+(?:\\.[0-9]+)?|ТЭЦ)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) as code,
  list_max(list_filter([case when contains(lower(months), m) then i end for m, i in {MONTHS}], lambda x: x is not null)) as last,
  regexp_extract(day, '([0-9]{{1,2}})[»\\s]+(\\p{{L}}+)\\s+([0-9]{{4}})', ['d', 'm', 'y']) as named, regexp_extract(day, '([0-9]{{1,2}})\\.([0-9]{{1,2}})\\.([0-9]{{2,4}})', ['d', 'm', 'y']) as dotted from texts)
 select o_orderkey, nullif(replace(upper(code), ' ', ''), '') as place, case when last is not null then last_day(make_date(2026, cast(last as int), 1)) end as month_end,
  coalesce(cast(try_strptime(concat(named.y, '-', list_position({MONTHS_OF}, named.m), '-', named.d), '%Y-%m-%d') as date), cast(try_strptime(concat(case when length(dotted.y) = 2 then '20' else '' end, dotted.y, '-', dotted.m, '-', dotted.d), '%Y-%m-%d') as date)) as written from cut""")
def places_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, ends of named months and written dates, read back from texts that orders give."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), at.cast("int"))
    text = lambda *xs: F.concat(*(x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs))
    place = text(F.col("o_orderpriority"), " ", F.lower(pick(KINDS, k % len(KINDS) + 1)), pick(["", " ", "-"], c % 3 + 1), c % 40, F.when(k % 2 == 0, ".1").otherwise(""), ", Clerk", c)
    months = F.when(k % 5 == 0, F.col("o_orderpriority")).otherwise(text(F.upper(pick(MONTHS, F.month(day))), "-", pick(MONTHS, F.month(F.date_add(day, 60)))))
    dates = F.when(k % 4 == 0, text("от «", F.day(day), "» ", pick(MONTHS_OF, F.month(day)), " ", F.year(day), " г.")).when(k % 4 == 1, text("до ", F.day(day), ".", F.month(day), ".", F.date_format(day, "yy")))
    dates = dates.when(k % 4 == 2, text("к ", F.date_format(day, "dd.MM.yyyy"), ".")).otherwise(text(F.day(day), ".", F.month(day) + 12, ".", F.year(day)))
    return orders(spark, sf_dir).select("o_orderkey", t.place_code(place).alias("place"), t.end_of_months(months, 2026).alias("month_end"), t.written_date(dates).alias("written"))


TEAMS = {"пто": "ПТО", "дпр": "ДПР", "икс": "ИКС"}
TEAM_NAMES = [*TEAMS, "склад"]
TRACK_WORDS = [*t.TRACKS, "потом", ""]
TEAM_SQL = f"concat({TEAM_NAMES}[l_linenumber % 4 + 1], ' + ', upper({TEAM_NAMES}[l_suppkey % 4 + 1]), case when l_orderkey % 3 = 0 then concat(' (участок ', l_linenumber, ')') else '' end)"
STATE_SQL = "concat(case when l_orderkey % 2 = 0 then 'будет, снято ' else 'Снято ' end, strftime(l_shipdate, '%d.%m.%y'), case l_linenumber % 3 when 0 then '; снята без даты, затем, после обхода, СНЯТО ' when 1 then '; не снятое ' else '; отклонено ' end, day(l_shipdate), '.', month(l_shipdate), '.', year(l_shipdate))"


@query(f"""with texts as (select l_orderkey, l_linenumber, concat(' ', upper({TRACK_WORDS}[(l_orderkey + l_linenumber) % {len(TRACK_WORDS)} + 1]), ' ') as track, {TEAM_SQL} as team, {STATE_SQL} as state from lineitem),
 tracks as (select * from (values {", ".join(map(str, t.TRACKS.items()))}) v(said, means)), teams as (select * from (values {", ".join(map(str, TEAMS.items()))}) v(said, means)),
 split as (select *, list_filter(list_transform(string_split(regexp_replace(team, '\\([^)]*\\)', '', 'g'), '+'), lambda x: trim(x)), lambda x: x <> '') as members, (select map(list(said), list(means)) from teams) as known from texts),
 hits as (select state, p, state[p + 5:p + 29] as tail, lower(rtrim(regexp_extract(rtrim(state[1:p - 1]), '(\\S*)$', 1), ',;')) as before from (select state, unnest(range(1, length(state) + 1)) as p from (select distinct state from texts)) where regexp_matches(lower(state[p:p + 5]), '^снят[оа]([^\\p{{L}}\\p{{N}}_]|$)')),
 dated as (select state, p, regexp_extract(tail, '([0-9]{{1,2}})\\.([0-9]{{1,2}})\\.([0-9]{{2,4}})', ['d', 'm', 'y']) as x from hits where before <> 'будет'),
 closed as (select state, min_by(day, p) as closed_on from (select *, cast(try_strptime(concat(case when length(x.y) = 2 then '20' else '' end, x.y, '-', x.m, '-', x.d), '%Y-%m-%d') as date) as day from dated) where day is not null group by 1)
 select l_orderkey, l_linenumber, case when trim(track) = '' then 'unknown' when means is null or means = 'fact' then 'other' else means end as track, case when trim(track) = '' then 'unknown' else coalesce(means, 'other') end as physical,
  array_to_string(list_filter([case when not list_contains(members[1:i - 1], m) then known[lower(m)] end for m, i in list_transform(members, lambda x: lower(x))], lambda x: x is not null), '; ') as names,
  nullif(array_to_string(list_transform(regexp_extract_all(team, '\\(([^)]*)\\)', 1), lambda x: trim(x)), '; '), '') as note, array_to_string(list_filter(members, lambda x: known[lower(x)] is null), '; ') as unmapped, closed_on
 from split left join tracks on said = lower(trim(track)) left join closed using (state)""")
def tracks_and_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks, responsible parties and dates of removal, read back from texts that lines give."""
    k, n, day = F.col("l_orderkey"), F.col("l_linenumber"), F.to_date("l_shipdate")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), at.cast("int"))
    text = lambda *xs: F.concat(*(x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs))
    track = text(" ", F.upper(pick(TRACK_WORDS, (k + n) % len(TRACK_WORDS) + 1)), " ")
    team = text(pick(TEAM_NAMES, n % 4 + 1), " + ", F.upper(pick(TEAM_NAMES, F.col("l_suppkey") % 4 + 1)), F.when(k % 3 == 0, text(" (участок ", n, ")")).otherwise(""))
    state = text(F.when(k % 2 == 0, "будет, снято ").otherwise("Снято "), F.date_format(day, "dd.MM.yy"), F.when(n % 3 == 0, "; снята без даты, затем, после обхода, СНЯТО ").when(n % 3 == 1, "; не снятое ").otherwise("; отклонено "), F.day(day), ".", F.month(day), ".", F.year(day))
    rows = r.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.track(track, False).alias("track"), t.track(track, True).alias("physical"), team.alias("team"), t.closed_on(state).alias("closed_on"))
    return rows.withColumns(t.responsible(F.col("team"), TEAMS)).drop("team")


@query(f"""with l as (select doc_id, length(trim(text)) as chars, starts_with(text, 'T') or starts_with(text, 'D') or starts_with(text, 'E') as form, nullif(regexp_extract(text, '([0-9]+)', 1), '') as no, regexp_extract(text, '([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})', 0) as day, string_split(text, chr(10)) as rows from documents),
 c as (select *, len(list_filter(rows, lambda x: length(x) >= 200)) as records, len(list_filter(rows, lambda x: trim(x) = '')) as images, case when no is not null then length(no) end as declared from l)
 select doc_id, case when chars < 200 then 'no text layer' when not form then 'unknown form' when no is null or try_cast(day as date) is null then 'no number or date' when records = 0 then 'no records' when images > 0 then 'image page' when declared is not null and declared <> records then 'declared differs' end as refused,
  case when 100.0 * records / len(rows) < 50 then 'warning' when 100.0 * records / len(rows) >= 80 then 'success' else 'plain' end as ring from c""")
def import_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason to refuse a document as a file of records (its long lines), and the class of their share."""
    text, rows = F.col("text"), F.split("text", "\n")
    number = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))
    records = F.size(F.filter(rows, lambda x: F.length(x) >= 200))
    form = text.startswith("T") | text.startswith("D") | text.startswith("E")
    refused = g.guard(F.length(F.trim(text)), form, number, F.regexp_extract(text, r"(\d{4})-(\d{2})-(\d{2})", 0).try_cast("date"), records, F.size(F.filter(rows, lambda x: F.trim(x) == "")), F.length(number))
    return r.read(spark, sf_dir, "documents").select("doc_id", refused.alias("refused"), t.ring_class(F.lit(100.0) * records / F.size(rows)).alias("ring"))


@query(f"with {r.CHANGES} select change_id, unnest(list_filter([case when due is null then 'no_due_date' end, case when answered is null and status = 'approved' then 'no_answer' end, case when answered < requested then 'bad_date' end, case when status is null then 'no_status' end], lambda x: x is not null)) as issue from changes")
def import_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each imported record."""
    checks = {"no_due_date": F.col("due").isNull(), "no_answer": F.col("answered").isNull() & (F.col("status") == "approved"), "bad_date": F.col("answered") < F.col("requested"), "no_status": F.col("status").isNull()}
    return g.issues(r.changes(spark, sf_dir), "change_id", checks)


@query(f"with {r.CHANGES} select change_id, coalesce(due, requested + cast(change_id % 10 as int)) as due from changes")
def sla_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day an answer is due: as agreed, else the request and its days of service."""
    return r.changes(spark, sf_dir).select("change_id", F.coalesce("due", F.date_add("requested", (F.col("change_id") % 10).cast("int"))).alias("due"))


@query(f"with {r.CREWS} select 'today' as day, order_id, line_no from crews where date = date '{TO}' union all select 'tomorrow', order_id, line_no from crews where date = date '{TO}' + 1")
def today_and_tomorrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is planned for a day and the next one."""
    today = F.lit(TO).cast("date")
    rows = r.crews(spark, sf_dir).where(F.col("date").isin(today, F.date_add(today, 1)))
    return rows.select(F.when(F.col("date") == today, "today").otherwise("tomorrow").alias("day"), "order_id", "line_no")


@query(f"with {r.CREWS}, saved as (select order_id, line_no, planned * 2 as planned, source from crews where date < date '{TO}') select order_id, line_no, planned, source from crews where source <> 'excel' union all select * from saved where source = 'excel'")
def restore_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel's rows as they were saved, the other's as they are."""
    rows = r.crews(spark, sf_dir)
    saved = rows.where(F.col("date") < F.lit(TO).cast("date")).withColumn("planned", F.col("planned") * 2)
    columns = ["order_id", "line_no", "planned", "source"]
    return g.restore_channel(rows.select(columns), saved.select(columns), "source", "excel")


@query("""with w as (select p_partkey as work_id, p_type as paragraph, p_size as n, p_size as volume from part), r as (select p_type as paragraph, p_size as n, cast(min(p_retailprice) as double) as hours from part where p_partkey % 20 = 0 group by 1, 2),
 j as (select work_id, count(hours) as n, count(*) filter (where w.n = r.n) as hits, max(hours) as lone, max(case when w.n = r.n then hours end) as hit, max(volume) as volume from w left join r using (paragraph) group by 1)
 select work_id, (case when n = 1 then lone when hits = 1 then hit end) * volume as hours, case when (case when n = 1 then lone when hits = 1 then hit end) is not null then 'auto' else 'manual' end as how from j""")
def labour_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of works by their paragraph's only row or the one that shares a number."""
    part = r.read(spark, sf_dir, "part")
    works = part.select(F.col("p_partkey").alias("work_id"), F.col("p_type").alias("paragraph"), F.array("p_size").alias("numbers"), F.col("p_size").alias("volume"))
    rows = part.where("p_partkey % 20 = 0").groupBy(F.col("p_type").alias("paragraph"), "p_size").agg(F.min("p_retailprice").alias("hours")).select("paragraph", F.array("p_size").alias("condition_numbers"), "hours")
    return g.labour_hours(works, rows)
