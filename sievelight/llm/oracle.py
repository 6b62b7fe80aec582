"""SQL that gives the results of those operators that SQL can express, by comparing everything with everything."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id reachable over the links of the table `link` (a, b, both ways), for all ids of `node` (id).
_COMPONENTS = """reach(id, c) as (
    select id, id from node
    union
    select l.a, r.c from reach r join link l on l.b = r.id where r.c < l.a
), component as (select id, min(c) as c from reach group by id)"""

OP2 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select row_number() over () as k, coalesce(item_id::varchar, 'null') as item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
need as (select k, item, w, least(10, len(w)) as n from b where len(w) > 0),
item_window as (select k, item, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as t from need, unnest(range(1, len(w) - n + 2)) as u(s)),
doc_window as (select r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as t from d, (select distinct n from need), unnest(range(1, len(w) - n + 2)) as u(p)),
hit as (select r, p, i.n, k, item, s from doc_window x join item_window i on x.n = i.n and x.t = i.t),
covered as (select r, count(distinct q) as n_hit from hit, unnest(range(p, p + n)) as u(q) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r),
line as (select r, k, n, p - s as diagonal, p - row_number() over (partition by r, k, p - s order by p) as run from hit),
longest as (select r, max(size) as longest_match from (select r, count(*) + n - 1 as size from line group by r, k, n, diagonal, run) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest_match, 0)::bigint as longest_match
from d left join covered using (r) left join named using (r) left join longest using (r)
"""

OP8 = f"""
with recursive word as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
shingle as (
    select distinct doc_id, array_to_string(list_slice(w, p, p + 1), ' ') as s from word, unnest(range(1, greatest(len(w), 2))) as u(p) where len(w) > 0
), size as (select doc_id, count(*) as n from shingle group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as m from shingle x join shingle y on x.s = y.s and x.doc_id < y.doc_id group by all),
near as (select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
link as (select a, b from near union all select b, a from near),
node as (select distinct doc_id as id from documents),
{_COMPONENTS}
select doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id, doc_id = c as kept from documents left join size using (doc_id) join component on id = doc_id
"""

OP10 = f"""
with recursive whole as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
sound as (
    select vec_id, v, sqrt(list_inner_product(v, v)) as norm from whole
    where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), link as (select x.vec_id as a, y.vec_id as b from sound x join sound y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_inner_product(x.v, y.v) / (x.norm * y.norm) >= 0.9),
node as (select distinct vec_id as id from embeddings),
counts as (select a, count(*) as n from link group by a),
{_COMPONENTS}
select vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, vec_id = c as kept from embeddings left join counts on a = vec_id join component on id = vec_id
"""

ORACLE = {"op2_decontamination": OP2, "op8_neardup": OP8, "op10_embeddings": OP10}
