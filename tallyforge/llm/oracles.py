"""SQL that gives the same rows as the queries that SQL can express, over whole tables and texts.

The byte windows of op2_suffix_dedup take DuckDB minutes even on a few megabytes, so that query has none.
"""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACE}'), lambda x: x <> '')"


OP10 = f"""with w as (select doc_id, {words('text')} as ws from documents),
 windows as (select doc_id, p, md5(array_to_string(list_slice(ws, p, p + 49), ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w)),
 own as (select h, min(doc_id) as first from windows group by 1), hit as (select doc_id, p from windows join own using (h) where first < doc_id),
 words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
 marked as (select doc_id, word, p, max(case when h.p is not null then 1 else 0 end) over (partition by doc_id order by p rows between 49 preceding and current row) as gone from words left join hit h using (doc_id, p)),
 sums as (select doc_id, count(*) as n_words, count(*) filter (where gone = 1) as n_removed, string_agg(word, ' ' order by p) filter (where gone = 0) as kept from marked group by 1)
 select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join sums using (doc_id)"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP7 = f"""with items as (select item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') as ws from benchmark),
 sized as (select *, least(10, len(ws)) as n from items where len(ws) > 0),
 grams as (select distinct item_id, n, md5(array_to_string(list_slice(ws, p, p + n - 1), ' ')) as h from (select *, unnest(range(1, len(ws) - n + 2)) as p from sized)),
 d as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') as ws from documents),
 windows as (select doc_id, n, p, md5(array_to_string(list_slice(ws, p, p + n - 1), ' ')) as h from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d, (select distinct n from sized))),
 found as (select doc_id, p, n, item_id from windows join grams using (n, h)),
 hit as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + n)) as x from (select distinct doc_id, p, n from found)) group by 1),
 own as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from found) group by 1)
 select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join hit using (doc_id) left join own using (doc_id)"""

OP8 = f"""with recursive w as (select doc_id, {words(LOWER.format('text'))} as ws from documents),
 shingles as (select distinct doc_id, md5(array_to_string(list_slice(ws, p, p + 4), ' ')) as h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as p from w where len(ws) > 0)),
 sizes as (select doc_id, count(*) as n from shingles group by 1),
 pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
 links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
 edges as (select a, b from links union all select b, a from links),
 reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edges e on e.a = r.b)
 select d.doc_id, coalesce(n, 0) as n_shingles, component_id from documents d left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by 1) using (doc_id)"""

OP11 = f"""with d as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') as ws from documents),
 q as (select item_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}')) as term from benchmark),
 size as (select count(*) as n_docs, cast(sum(len(ws)) as bigint) as n_terms from d where len(ws) > 0),
 tf as (select doc_id, n, term, count(*) as tf from (select doc_id, len(ws) as n, unnest(ws) as term from d) where term in (select term from q) group by 1, 2, 3),
 weight as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, size group by term, n_docs),
 scored as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) as score from q join tf using (term) join weight using (term), size group by 1, 2)
 select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10"""

OP13 = f"""with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, {words('text')} as ws from documents),
 flags as (select doc_id, part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
  + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by text))::int as fails from w),
 cells as (select part, fails, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as bad from flags left join labels using (doc_id) group by 1, 2),
 letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as b),
 orders as (select [a.b, b.b, c.b, d.b, e.b] as bits, a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e where a.b + b.b + c.b + d.b + e.b = 31 and a.b | b.b | c.b | d.b | e.b = 31),
 steps as (select filter_order, step, bits[step] as own, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as earlier from orders, (select unnest(range(1, 6)) as step)),
 counted as (select part, filter_order, step, own, coalesce(sum(n) filter (where fails & (own | earlier) = 0), 0) as kept, coalesce(sum(n) filter (where fails & own <> 0 and fails & earlier = 0), 0) as removed,
  coalesce(sum(n) filter (where fails & own <> 0 and fails & earlier <> 0), 0) as redundant, coalesce(sum(n) filter (where fails = own), 0) as unique_fails,
  coalesce(sum(good) filter (where fails & own <> 0 and fails & earlier = 0), 0) as good_lost, coalesce(sum(bad) filter (where fails & own <> 0 and fails & earlier = 0), 0) as toxic_lost from cells, steps group by all)
 select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from counted"""

ORACLE_SQL = {"op7_decontaminate": OP7, "op8_jaccard_join": OP8, "op10_substring_dedup": OP10, "op11_lexical_search": OP11, "op13_filter_audit": OP13}
