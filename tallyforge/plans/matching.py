"""Queries of matching and of writes as merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.expressions import tidy
from ..operators import matching as m
from ..operators import merge as mg
from ..operators import similarity as s
from ..operators.phrases import frequent_phrases
from ..session import shared_folder
from ..sources import roles as r
from .registry import query

CODES = "select p_partkey, concat('K', p_size % 3, '-', p_size, case when p_size % 2 = 0 then concat('..', p_size + 4) else '' end, '; ', p_size + 7, case when p_size % 5 = 0 then ', see note' else '' end) as codes from part"
TOKENS = f"""codes as ({CODES}), t as (select p_partkey, unnest(list_filter(list_transform(regexp_split_to_array(codes, '[;,+]'), lambda x: trim(x)), lambda x: x <> '')) as token, generate_subscripts(list_filter(list_transform(regexp_split_to_array(codes, '[;,+]'), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 as place from codes),
 f as (select *, nullif(regexp_extract(token, '^(?:(K[0-9]*)-)?([0-9]+)(?:\\s*(?:\\.\\.|-)\\s*([0-9]+))?$', 1), '') as own, try_cast(regexp_extract(token, '^(?:(K[0-9]*)-)?([0-9]+)(?:\\s*(?:\\.\\.|-)\\s*([0-9]+))?$', 2) as int) as low,
 try_cast(regexp_extract(token, '^(?:(K[0-9]*)-)?([0-9]+)(?:\\s*(?:\\.\\.|-)\\s*([0-9]+))?$', 3) as int) as up from t),
 tokens as (select p_partkey, cast(place as int) as place, token, case when low is null then 'literal' when coalesce(up, low) > low then 'range' else 'single' end as kind,
 case when low is not null then last_value(own ignore nulls) over (partition by p_partkey order by place rows between unbounded preceding and current row) end as prefix, low, coalesce(up, low) as high from f)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    text = F.concat(F.lit("K"), (n % 3).cast("string"), F.lit("-"), n.cast("string"), F.when(n % 2 == 0, F.concat(F.lit(".."), (n + 4).cast("string"))).otherwise(""), F.lit("; "), (n + 7).cast("string"), F.when(n % 5 == 0, ", see note").otherwise(""))
    return m.code_tokens(r.read(spark, sf_dir, "part").select("p_partkey", text.alias("codes")), "p_partkey", "codes")


@query(f"with {TOKENS} select * from tokens")
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir)


@query(f"with {TOKENS} select p_partkey, place, l_orderkey, l_linenumber from tokens join lineitem on l_partkey = p_partkey and cast(l_quantity as int) between low and high where kind <> 'literal'")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = r.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("n"))
    return m.range_join(points, tokens(spark, sf_dir).where("kind != 'literal'"), "p_partkey", "n", "low", "high").select("p_partkey", "place", "l_orderkey", "l_linenumber")


@query("""select s_suppkey, (select c_acctbal from customer where c_nationkey = s_nationkey and abs(c_acctbal - s_acctbal) <= 8 order by abs(c_acctbal - s_acctbal), c_acctbal limit 1) as c_acctbal from supplier
 where exists (select 1 from customer where c_nationkey = s_nationkey and abs(c_acctbal - s_acctbal) <= 8)""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = r.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    right = r.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    return m.nearest(left, right, "nation", "s_acctbal", "c_acctbal", "s_suppkey", 8.0)


@query("with o as (select lower(trim(p_name)) as n, min_by(p_partkey, (p_size, p_partkey)) as code from part where p_size > 10 group by 1) select p_partkey, code from part left join o on o.n = lower(trim(p_name)) where p_size <= 10")
def name_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = r.read(spark, sf_dir, "part").withColumn("code", F.col("p_partkey"))
    out = m.reconcile(part.where("p_size <= 10").select("p_partkey", "p_name"), part.where("p_size > 10").select("p_name", "code", "p_size"), "p_name", "code", "p_size")
    return out.select("p_partkey", "code")


ALIASES = "aliases as (select distinct concat('work ', p_partkey) as name, concat('work ', p_partkey - 7) as other from part where p_partkey % 9 in (1, 8) and p_partkey > 7)"
REGISTER = "reg as (select concat('work ', p_partkey) as name, concat(upper(case when p_size % 3 = 0 then 'main' else 'aux' end), '-', lpad(cast(p_partkey as varchar), 6, '0')) as code, case when p_size % 3 = 0 then 'main' else 'aux' end as source from part where p_partkey % 9 in (0, 3, 4, 7) union all select concat('work ', p_partkey), concat('AUX-', lpad(cast(p_partkey + 500000 as varchar), 6, '0')), 'aux' from part where p_partkey % 9 = 3)"


@query(f"""with recursive {ALIASES}, {REGISTER}, best as (select name, min_by(code, (source <> 'main', code)) as code from reg group by 1),
 chain as (select name, other, 1 as n from aliases union all select c.name, a.other, n + 1 from chain c join aliases a on a.name = c.other), ends as (select name, max_by(other, n) as stands_for from chain group by 1),
 w as (select p_partkey as work_id, concat('work ', p_partkey) as name, case when p_size % 2 = 0 then 'main' else 'aux' end as source from part),
 f as (select work_id, w.source, w.name, b.code as exact, c.code as by_alias from w left join best b using (name) left join ends using (name) left join best c on c.name = stands_for),
 last as (select source, max(cast(regexp_extract(code, '(\\d+)$', 1) as bigint)) as n from reg group by 1)
 select work_id, coalesce(exact, by_alias) as code, case when exact is not null then 'exact' else 'alias' end as how from f where coalesce(exact, by_alias) is not null
 union all select work_id, concat(upper(f.source), '-', lpad(cast(coalesce(n, 0) + row_number() over (partition by f.source order by work_id) as varchar), 6, '0')), 'minted' from f left join last using (source) where coalesce(exact, by_alias) is null""")
def reconcile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a new version's works: by name, by chains of renamings, or new ones."""
    part = r.read(spark, sf_dir, "part")
    name, k = F.concat(F.lit(" Work  "), F.col("p_partkey").cast("string")), F.col("p_partkey")
    code = lambda source, n: F.concat(F.upper(source), F.lit("-"), F.lpad(n.cast("string"), 6, "0"))
    source = F.when(F.col("p_size") % 3 == 0, "main").otherwise("aux")
    register = part.where("p_partkey % 9 in (0, 3, 4, 7)").select(name.alias("name"), code(source, k).alias("code"), source.alias("source"))
    twice = part.where("p_partkey % 9 = 3").select(name.alias("name"), code(F.lit("aux"), k + 500000).alias("code"), F.lit("aux").alias("source"))
    aliases = part.where("p_partkey % 9 in (1, 8) and p_partkey > 7").select(name.alias("name"), F.concat(F.lit("work "), (k - 7).cast("string")).alias("other"))
    new = part.select(k.alias("work_id"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, "main").otherwise("aux").alias("source"))
    return m.reconcile_versions(new, register.unionByName(twice), aliases, "main")


@query("with c as (select p_brand, p_size, min(p_partkey) as target, count(*) as candidates from part where p_type <> 'ECONOMY' group by 1, 2) select a.p_partkey, candidates, case when candidates = 1 then target end as target from part a join c using (p_brand, p_size) where a.p_type = 'ECONOMY'")
def unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = r.read(spark, sf_dir, "part").withColumn("k", F.concat_ws("|", "p_brand", F.col("p_size").cast("string")))
    return m.unique_match(part.where("p_type = 'ECONOMY'").select("p_partkey", "k"), part.where("p_type != 'ECONOMY'").select("k", F.col("p_partkey").alias("target")), "k", "p_partkey", "target")


STOP = ("the", "and", "der", "die", "que", "les")
AWAY, UP = ("gear", "dis"), ("with", "for")
MATERIALS = (("idiot", "moron"), ("scum", "trash"), ("clown", "loser"))


def sql_words(text: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')), lambda w: length(w) >= 3 and w not in {STOP})"


def sql_side(table: str, key: str, name: str, unit: str) -> str:
    begins = lambda stems: " or ".join(f"len(list_filter(words, lambda w: starts_with(w, '{x}'))) > 0" for x in stems)
    group = lambda k, g: f"case when list_has_any(words, {list(g)}) then {k} end"
    return f"""(select *, case when ({begins(AWAY)}) and not ({begins(UP)}) then 'neg' when ({begins(UP)}) and not ({begins(AWAY)}) then 'pos' end as pol, list_filter([{", ".join(group(k, g) for k, g in enumerate(MATERIALS))}], lambda x: x is not null) as mat
  from (select {key} as {name}, {sql_words('text')} as words, list_distinct(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?')) as nums, {unit} as unit from {table}))"""


PAIRS = f"""i as {sql_side('benchmark', 'item_id', 'item_id', "['m3', 'm2', null][item_id % 3 + 1]")}, n as {sql_side('documents', 'doc_id', 'norm_id', "['m3', 'm2', null, 'm3'][doc_id % 4 + 1]")},
 hits as (select item_id, norm_id, count(*) as shared from (select item_id, unnest(words) as w from i) join (select norm_id, unnest(words) as w from n) using (w) group by 1, 2)"""


def items_and_norms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as works and documents as norms, with units by their numbers."""

    def side(table: str, key: str, name: str, units: list[str | None]) -> DataFrame:
        rows = r.read(spark, sf_dir, table).select(F.col(key).alias(name), m.words(F.col("text"), stop=STOP).alias("words"), m.numbers(F.col("text")).alias("numbers"), F.element_at(F.array(*(F.lit(u) for u in units)), (F.col(key) % len(units) + 1).cast("int")).alias("unit"))
        return rows.withColumns({"polarity": t.polarity(F.col("words"), AWAY, UP), "materials": t.groups_of(F.col("words"), MATERIALS)})

    return side("benchmark", "item_id", "item_id", ["m3", "m2", None]), side("documents", "doc_id", "norm_id", ["m3", "m2", None, "m3"])


@query(f"""with {PAIRS}, s as (select item_id, norm_id, round(cast(shared as double) / len(i.words) + case when list_has_any(i.nums, n.nums) then 0.5 else 0 end, 6) as score from hits join i using (item_id) join n using (norm_id)
 where (i.unit is null or i.unit = n.unit) and (i.pol is null or n.pol is null or i.pol = n.pol) and not (len(i.mat) > 0 and len(n.mat) > 0 and not list_has_any(i.mat, n.mat)))
 select item_id, norm_id, score from s where score >= 1.0 qualify row_number() over (partition by item_id order by score desc, norm_id) = 1""")
def norm_match_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.overlap_match(*items_and_norms(spark, sf_dir), 1.0)


@query(f"""with {PAIRS}, s as (select item_id, norm_id, i.unit is not null and n.unit is not null and i.unit = n.unit as same, round(cast(shared as double) / (len(i.words) + len(n.words) - shared) + case when i.unit = n.unit then 0.25 else 0 end, 6) as score from hits join i using (item_id) join n using (norm_id)
 where shared >= 2 and (i.pol is null or n.pol is null or i.pol = n.pol)), b as (select * from s where score >= 0.35 qualify row_number() over (partition by item_id order by score desc, norm_id) = 1)
 select item_id, norm_id, score, case when norm_id is null then 'none' when score >= 0.55 and same then 'exact' else 'heuristic' end as verdict from i left join b using (item_id)""")
def norm_match_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.jaccard_match(*items_and_norms(spark, sf_dir), 0.55, 0.35)


@query("with a as (select p_partkey, p_name from part where p_type = 'ECONOMY' and p_name ilike '%ring%'), b as (select p_partkey, p_name from part where p_type <> 'ECONOMY' and p_name ilike '%ring%') select * from a union all select * from b where not exists (select 1 from a)")
def norm_search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = r.read(spark, sf_dir, "part")
    names = lambda c: part.where(c).select("p_partkey", "p_name")
    return m.norm_search(names("p_type = 'ECONOMY'"), names("p_type != 'ECONOMY'"), "p_name", "ring")


@query("select p_partkey, case when p_size = 0 then 'unknown' when p_retailprice / (p_size * 100) between 0.7 and 1.4 then 'close' when p_retailprice / (p_size * 100) between 0.5 and 2.0 then 'differs' else 'far' end as ratio from part")
def catalogue_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.read(spark, sf_dir, "part").select("p_partkey", m.close_ratio(F.col("p_retailprice"), F.col("p_size") * 100).alias("ratio"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("record"), tidy(F.col("text")).alias("a"))


def lines(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """The lines of all texts, each a text of its own: id, text and the row's key."""
    rows = r.read(spark, sf_dir, table).select(F.col(key).alias("of"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows.select((F.col("of") * 1_000_000 + F.col("line")).alias("id"), tidy(F.col("text")).alias("text"), "of").where("text != ''")


@query()
def sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of benchmark items against all lines of documents of the item's section, or of all where that has none."""
    records = lines(spark, sf_dir, "benchmark", "item_id").select(F.col("id").alias("record"), F.col("text").alias("a"), F.when(F.col("of") % 4 == 0, "none").otherwise("en").alias("section"))
    langs = r.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("of"), F.col("lang").alias("section"))
    pool = lines(spark, sf_dir, "documents", "doc_id").join(langs, "of").select(F.col("id").alias("candidate"), F.col("text").alias("b"), "section")
    return s.scan(records, pool, 0.55)


@query()
def token_set_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose words a document has, or nearly."""
    pool = r.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate"), tidy(F.col("text")).alias("b"))
    return s.scan(items(spark, sf_dir), pool, 0.55, "tokens")


@query()
def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line of a benchmark item is among the documents' lines: confident, ambiguous or new."""
    return m.assign(sequence_similarity(spark, sf_dir), lines(spark, sf_dir, "benchmark", "item_id").select(F.col("id").alias("record")))


PHRASES = """texts as (select doc_id as id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(translate(text, chr(160) || chr(8239), '  ')), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') as ws from documents),
 grams as (select n, array_to_string(ws[p:p + n - 1], ' ') as phrase, count(distinct id) as texts from (select id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from (select id, ws, unnest(range(1, 9)) as n from texts)) group by 1, 2 having count(distinct id) >= 0.2 * (select count(*) from documents)),
 phrases as (select phrase, cast(n as int) as words, texts from grams g where n >= 2 and not exists (select 1 from grams l where l.n = g.n + 1 and (regexp_replace(l.phrase, ' [^ ]*$', '') = g.phrase or regexp_replace(l.phrase, '^[^ ]* ', '') = g.phrase)))"""


@query(f"with {PHRASES} select * from phrases")
def boilerplate_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two words or more that a fifth of all documents share."""
    rows = r.read(spark, sf_dir, "documents").select("doc_id", tidy(F.col("text")).alias("text"))
    return frequent_phrases(rows, "doc_id", "text", 0.2, 2)


def phrases(spark: SparkSession, sf_dir: str) -> list[str]:
    """The shared phrases, longest first; they are few: all texts' words over a fifth of the texts."""
    return [x.phrase for x in boilerplate_phrases(spark, sf_dir).orderBy(F.desc("words"), "phrase").collect()]


@query(f"""with {PHRASES}, l as (select list(phrase order by words desc, phrase) as ps from phrases), t as (select doc_id, trim(regexp_replace(lower(translate(text, chr(160) || chr(8239), '  ')), '\\s+', ' ', 'g')) as text from documents),
 s as (select doc_id, text, trim(regexp_replace(list_reduce(list_prepend(text, coalesce(ps, [])), lambda a, p: replace(a, p, ' ')), '\\s+', ' ', 'g')) as out from t, l)
 select doc_id, case when len(list_filter(string_split(out, ' '), lambda w: w <> '')) < 5 then text else out end as stripped from s""")
def stripped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the shared phrases."""
    return r.read(spark, sf_dir, "documents").select("doc_id", s.strip_phrases(tidy(F.col("text")), phrases(spark, sf_dir)).alias("stripped"))


@query()
def closure_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document may still be among the benchmark items, before it is taken for gone."""
    old = r.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") % 1000).alias("number"), tidy(F.col("text")).alias("text"))
    new = r.read(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 11).alias("number"), tidy(F.col("text")).alias("text"), (F.col("item_id") % 3 == 0).alias("claimed"))
    return s.closure_review(old, new, phrases(spark, sf_dir))


VERSIONS = "select conv_id as old_id, max_by(turn, turn) as turn, max_by(text, turn) as text from conversations where turn < 3 group by 1"


@query(VERSIONS)
def prior_version_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last turn strictly before the third."""
    rows = r.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("old_id"), "turn", "text")
    return s.prior_version(rows, "old_id", "turn", F.lit(3))


@query()
def closure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likest benchmark item of what each conversation last said before its third turn."""
    prior = prior_version_best(spark, sf_dir).select("old_id", (F.col("old_id") % 2 == 0).alias("resolved"), tidy(F.col("text")).alias("text"))
    return s.closure_audit(prior, items(spark, sf_dir).select(F.col("record").alias("item_id"), F.col("a").alias("text")))


ORD = "select o_orderkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as amount from orders"
OLD, NEW = f"old as ({ORD} where o_orderstatus <> 'P')", f"new as (select o_orderkey, 'X' as o_orderstatus, amount from ({ORD} where o_orderpriority = '1-URGENT'))"


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = r.read(spark, sf_dir, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    columns = ["o_orderkey", "o_orderstatus", "amount"]
    return rows.where("o_orderstatus != 'P'").select(columns), rows.where("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("X")).select(columns)


@query(f"with {OLD}, {NEW} select * from old where o_orderkey not in (select o_orderkey from new) union all select * from new")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.upsert(*old_and_new(spark, sf_dir), ["o_orderkey"])


@query(f"with {OLD}, {NEW} select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) as o_orderstatus, o.amount from old o full join new n using (o_orderkey)")
def upsert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.upsert_columns(*old_and_new(spark, sf_dir), ["o_orderkey"], ["o_orderstatus"])


@query(f"with {OLD}, {NEW} select * from old union all select * from new where o_orderkey not in (select o_orderkey from old)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.insert_if_absent(*old_and_new(spark, sf_dir), ["o_orderkey"])


@query("select l_partkey, min(l_shipdate) as l_shipdate, min_by(l_orderkey, (l_shipdate, l_orderkey)) as l_orderkey from lineitem group by 1")
def least_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.least_merge(r.read(spark, sf_dir, "lineitem"), ["l_partkey"], "l_shipdate", "l_orderkey")


@query("select o_orderkey, concat('F-', lpad(cast(row_number() over (order by o_orderdate, o_orderkey) as varchar), 9, '0')) as code from orders")
def renumber_gapless(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return mg.renumber(r.read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], "F-").select("o_orderkey", "code")


@query("with p as (select distinct l_suppkey as grp, l_partkey as member from lineitem), f as (select member, min(grp) as owner from p group by 1) select member, grp, case when grp = owner then 'claimed' else 'conflict' end as claim from p join f using (member)")
def claim_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.claim_once(r.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("member")).distinct(), "grp", "member")


@query("select l_orderkey, min(l_suppkey) as l_suppkey from lineitem group by 1 having count(distinct l_suppkey) = 1")
def only_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.only_candidate(r.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("with r as (select distinct l_suppkey as s, l_partkey as k from lineitem), t as (select case s when 1 then 0 when 2 then 0 else s end as to_s, s, k from r) select to_s as s, k from t qualify row_number() over (partition by to_s, k order by case when to_s = s then 1 else 0 end desc, s) = 1")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("k")).distinct()
    return mg.merge_entities(rows, "s", "k", {1: 0, 2: 0})
