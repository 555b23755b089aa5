"""DuckDB SQL for the queries, over the same tables."""

from callweave.functions.names import ANGLE_MARKERS
from callweave.functions.text import STOP_WORDS

CALLS = """calls as (select event_id as id, user_id, ts, event_type as callee, value, cast(json_extract_string(props, '$.k') as int) as k from events)"""
SEQ = CALLS + """, seq as (select * from (select id as src, lead(id) over (partition by user_id order by ts, id) as dst, k from calls) where dst is not null)"""
PARTSEQ = """partseq as (select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem) where dst is not null)"""
BRANDSEQ = """brandseq as (select distinct least(a, b) as src, greatest(a, b) as dst from (select l_partkey as a, lead(l_partkey) over (partition by l_orderkey, p_brand order by l_linenumber, l_partkey) as b from lineitem join part on l_partkey = p_partkey) where b is not null and a <> b)"""
TREE = """tree as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders)"""
TURNS = """turns as (select conv_id, turn, role, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))) as inputs, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{6,}'))) as arguments from conversations)"""
PACKAGES = r"""packages as (select page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.') as package from pages)"""
CENTROIDS = """means as (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings where label <> -1) group by all),
    units as (select label, i, x / sqrt(sum(x * x) over (partition by label)) as x from means), cents as (select label, list(x order by i) as c from units group by label)"""
OVERLAP = "case when least(len({a}), len({b})) > 0 then len(list_intersect({a}, {b})) / least(len({a}), len({b})) else 0.0 end"

SQL = {
    "bridge_events": """with kept as (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events where event_type <> 'view')
        select event_type as from_type, nxt as to_type, count(*) as n from kept where nxt is not null group by all""",
    "bridge_guarded": f"""with recursive {SEQ}, e as (select s.src, s.dst, ['g' || (s.k // 10)] as gs, ['g' || (s.k // 10) || '=' || (s.k % 2)] as rs, c.callee = 'view' as hidden from seq s join calls c on c.id = s.dst),
        walk as (select e.* from e join calls c on c.id = e.src where c.callee <> 'view'
          union select w.src, e.dst, case when list_contains(w.gs, e.gs[1]) then w.gs else w.gs || e.gs end, case when list_contains(w.rs, e.rs[1]) then w.rs else w.rs || e.rs end, e.hidden
          from walk w join e on e.src = w.dst where w.hidden and (not list_contains(w.gs, e.gs[1]) or list_contains(w.rs, e.rs[1])))
        select distinct src, dst, array_to_string(rs, ',') as guards from walk where not hidden and src <> dst""",
    "call_pairs": f"""with {CALLS}, kept as (select id as src, lead(id) over (partition by user_id order by ts, id) as dst from calls where callee <> 'view')
        select dst, string_agg(distinct src::varchar, ',' order by src::varchar) as sources from kept where dst is not null group by dst""",
    "noise_filter": f"""with {CALLS}, kept as (select id, callee, user_id, lead(id) over w as next, lag(id) over w as prev from calls where callee not in ('view', 'error') window w as (partition by user_id order by ts, id))
        select id, callee, next from kept where next is not null or prev is not null""",
    "reach_parts": f"""with recursive {BRANDSEQ}, w(root, id) as (select p_partkey, p_partkey from part union select w.root, p.dst from w join brandseq p on p.src = w.id) select root, count(*) as n from w group by root""",
    "reach_tree": f"""with {TREE}, a as (select 'r' || r_regionkey as root, 'r' || r_regionkey as id, 0 as level from region), b as (select root, dst as id, 1 as level from a join tree on src = id), c as (select root, dst as id, 2 as level from b join tree on src = id), d as (select root, dst as id, 3 as level from c join tree on src = id)
        select root, level, count(*) as n from (select * from a union all select * from b union all select * from c union all select * from d) group by all""",
    "depth_capped": f"""with {BRANDSEQ}, a as (select p_partkey as root, p_partkey as id, 0 as level from part), b as (select distinct root, src as id, 1 as level from a join brandseq on dst = id), c as (select distinct root, src as id, 2 as level from b join brandseq on dst = id),
        u as (select root, id, min(level) as level from (select * from a union all select * from b union all select * from c) group by all) select root, count(*) as n, max(level) as deepest from u group by root""",
    "roots_orphans": """select 'c' || c_custkey as id, case when exists (select 1 from orders where o_custkey = c_custkey) then 'root' else 'orphan' end as kind from customer where c_acctbal >= 0""",
    "callers_callees": f"""with {PARTSEQ} select p_partkey as id, count(distinct a.src) as n_callers, min(a.src) as first_caller, (select count(distinct b.dst) from partseq b where b.src = p_partkey and b.dst in (select p_partkey from part)) as n_targets
        from part left join partseq a on a.dst = p_partkey group by p_partkey""",
    "peel_tree": f"""with {TREE}, n as (select src as id from tree union select dst from tree), l as (select id, case left(id, 1) when 'r' then 0 when 'n' then 1 when 'c' then 2 else 3 end as level from n) select level, count(*) as n from l group by level""",
    "part_components": """with recursive p as (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey, p_brand order by l_linenumber, l_partkey) as dst from lineitem join part on p_partkey = l_partkey),
        e as (select src, dst from p where dst is not null and src <> dst union select dst, src from p where dst is not null and src <> dst),
        w(id, root) as (select src, src from e union select e.dst, w.root from w join e on e.src = w.id) select id, min(root) as root from w group by id""",
    "linear_runs": f"""with {CALLS}, o as (select id, user_id, callee <> 'view' as ok, row_number() over (partition by user_id order by ts, id) as r from calls), g as (select id, user_id, r - row_number() over (partition by user_id order by r) as g, r from o where ok),
        h as (select id, first_value(id) over (partition by user_id, g order by r) as run from g) select run, count(*) as n, count(*) - 1 as last from h group by run""",
    "expand_tree": f"""with {TREE}, a as (select 'r' || r_regionkey as root from region), b as (select root, dst from a join tree on src = root), c as (select root, b.dst as mid, t.dst from b join tree t on t.src = b.dst)
        select root, root as method, 0 as depth, root as path from a union all select root, dst, 1, root || '/' || dst from b union all select root, dst, 2, root || '/' || mid || '/' || dst from c union all select root, t.dst, 3, root || '/' || mid || '/' || c.dst || '/' || t.dst from c join tree t on t.src = c.dst""",
    "effective_count": f"""with {TREE}, c as (select distinct src as m, 1 as n from tree where src like 'c%'), n as (select src as m, 1 + 0 as n from tree where src like 'n%' group by src), r as (select distinct src as m, 1 as n from tree where src like 'r%')
        select m as method, n::bigint as count from (select * from c union all select * from n union all select * from r)""",
    "name_predicates": r"""with n as (select p_partkey, (['com.acme.', 'java.util.', 'javax.', 'com.acme.X$1.', 'x.<operator>.'])[p_partkey % 5 + 1] || (['run:void()', 'access$', 'lambda$a$', '<lambda>'])[p_partkey % 4 + 1] || p_size as name from part),
        q as (select *, string_split(string_split(name, ':')[1], '.') as ps from n), z as (select *, ps[-1] as m, coalesce(ps[-2], '') as c, regexp_matches(ps[-1], '^(?:lambda\$.*\$\d+|<lambda>\d+)(?::.*)?$') as l from q)
        select p_partkey, contains(name, '<operator>') or starts_with(m, 'access$') or l or regexp_matches(c, '\$\d+$') as noise, l as lambda, starts_with(name, 'java.util.') or starts_with(name, 'java.io.') as stripped,
        starts_with(name, 'java.') or starts_with(name, 'javax.') as builtin, array_to_string(ps[-2:], '.') as compact from z""",
    "split_identifiers": r"""with t as (select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') || '_HTTPServer2Foo_' || p_type as s from part)
        select p_partkey, lower(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(s, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+'), lambda x: x <> ''), ' ')) as words from t""",
    "doc_dedupe": r"""select doc_id, path from (select doc_id, source || '/' || lang || '/' || doc_id as path, row_number() over (partition by lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) order by lower(source || '/' || lang || '/' || doc_id)) as r from documents) where r = 1""",
    "ctfidf_terms": """with w as (select source as cluster, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) as term from documents), c as (select cluster, term, count(*) as n from w group by all), k as (select count(distinct source) as k from documents),
        f as (select c.* from c join (select term, count(*) as df from c group by term) using (term), k where k < 2 or df <= 0.85 * k), s as (select cluster, sum(n) as size from f group by cluster), t as (select term, sum(n) as total from f group by term), m as (select floor(avg(size)) as mean from s),
        x as (select cluster, term, round(n / size * ln(1 + mean / greatest(total, 1)), 10) as score from f join s using (cluster) join t using (term), m)
        select cluster, term, round(score, 6) as score, rank from (select *, row_number() over (partition by cluster order by score desc, term desc) as rank from x where score > 0) where rank <= 10""",
    "centroids": f"with {CENTROIDS} select label, i - 1 as i, round(x, 6) as x from units",
    "assign_nearest": f"""with {CENTROIDS}, s as (select vec_id, label, similarity from (select vec_id, c.label, list_dot_product(embedding::double[], c.c) as similarity from embeddings e, cents c))
        select vec_id, label, round(similarity, 6) as similarity from (select *, row_number() over (partition by vec_id order by similarity desc, label) as r from s) where r = 1""",
    "knn5": """with s as (select a.vec_id, b.vec_id as neighbour, list_dot_product(a.embedding::double[], b.embedding::double[]) as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id)
        select vec_id, neighbour, r as rank, round(similarity, 6) as similarity from (select *, row_number() over (partition by vec_id order by similarity desc, neighbour) as r from s) where r <= 5""",
    "coverage": """with m as (select d.doc_id as name, case when l.doc_id is null then null when quality = 0 then -1 else toxic end as label from documents d left join labels l using (doc_id)),
        a as (select count(distinct name) as total, count(distinct case when label <> -1 then name end) as clustered, count(distinct case when label = -1 then name end) as noise, count(distinct case when label is not null then name end) as represented, count(distinct case when label is null then name end) as omitted, count(distinct case when label <> -1 then label end) as topics from m)
        select *, round(case when total > 0 then clustered / total else 0 end, 6) as coverage, total < 20 or topics = 0 or noise > 0.7 * total as degenerate from a""",
    "package_attach": f"""with {PACKAGES}, d as (select distinct array_to_string(string_split(package, '.')[:2], '.') as path from packages union select distinct array_to_string(string_split(package, '.')[:3], '.') from packages)
        select distinct page_id as label, path from packages join d on package = path or starts_with(package, path || '.')""",
    "package_prefix": f"""with {PACKAGES}, t as (select *, array_to_string(string_split(package, '.')[:2], '.') as top, string_split(package, '.') as ps from packages), g as (select top, min(ps) as a, max(ps) as b from t group by top)
        select top, array_to_string(list_filter(a, lambda x, i: a[:i] = b[:i]), '.') as prefix from g""",
    "overlap_pairs": f"""with {TURNS}, p as (select *, lag(inputs) over w as p, lag(arguments) over w as q from turns window w as (partition by conv_id order by turn, role, inputs))
        select conv_id, turn, round({OVERLAP.format(a="p", b="inputs")}, 6) as inputs, round({OVERLAP.format(a="q", b="arguments")}, 6) as arguments from p where p is not null""",
    "core_signature": f"""with {TURNS}, s as (select conv_id, count(*) as n from turns group by conv_id), v as (select conv_id, unnest(inputs) as x from turns), c as (select conv_id, x, count(*) as c from v group by all)
        select s.conv_id, coalesce(string_agg(x, ' ' order by x) filter (where c >= case when n = 1 then 1 else greatest(2, ceil(n / 2)) end), '') as core from s left join c using (conv_id) group by s.conv_id""",
    "line_stats": r"""with f as (select doc_id, case when doc_id % 2 = 0 then '/* open' || chr(10) || 'still' || chr(10) || '*/' || chr(10) else '// one' || chr(10) || chr(10) end || text as text from documents), l as (select doc_id, trim(unnest(string_split(text, chr(10))), chr(9) || chr(10) || chr(13) || ' ') as s, generate_subscripts(string_split(text, chr(10)), 1) as i from f)
        select doc_id, count(*) as physical, count(*) filter (s = '') as blank, count(*) filter (s <> '' and ((doc_id % 2 = 0 and i <= 3) or starts_with(s, '//') or starts_with(s, '/*'))) as comment, count(*) filter (s <> '' and not ((doc_id % 2 = 0 and i <= 3) or starts_with(s, '//') or starts_with(s, '/*'))) as source from l group by doc_id""",
    "pack_batches": """with recursive o as (select source, doc_id, strlen(text)::bigint as size, row_number() over (partition by source order by doc_id) as r from documents),
        w as (select source, doc_id, r, size as bytes, 1 as n, 0::bigint as batch from o where r = 1 union all
          select o.source, o.doc_id, o.r, case when w.n + 1 > 32 or ceil((w.bytes + o.size) / 3) > 10000 then o.size else w.bytes + o.size end, case when w.n + 1 > 32 or ceil((w.bytes + o.size) / 3) > 10000 then 1 else w.n + 1 end, case when w.n + 1 > 32 or ceil((w.bytes + o.size) / 3) > 10000 then w.batch + 1 else w.batch end
          from w join o on o.source = w.source and o.r = w.r + 1) select source, doc_id, batch from w""",
    "correlate": """with q as (select distinct conv_id as id from conversations where conv_id % 3 <> 0), a as (select conv_id as id, count(*) as n from conversations where turn < 2 group by all)
        select coalesce(q.id, a.id) as id, case when q.id is null then 'unknown' when n is null then 'missing' when n > 1 then 'duplicate' else 'ok' end as status from q full join a on q.id = a.id""",
    "label_check": r"""with p as (select conv_id, turn, role, unnest(string_split_regex(text, '[.,\n]+')) as phrase, generate_subscripts(string_split_regex(text, '[.,\n]+'), 1) - 1 as pos from conversations),
        s as (select *, regexp_replace(regexp_replace(trim(phrase), '([\p{L}\p{N}_])/([\p{L}\p{N}_])', '\1 / \2', 'g'), '([\p{L}\p{N}_])/([\p{L}\p{N}_])', '\1 / \2', 'g') as spaced from p),
        l as (select conv_id, turn, role, pos, regexp_replace(spaced, '[ \t\n\x0b\f\r]+', ' ', 'g') as label from s)
        select conv_id, turn, role, pos, label, regexp_matches(label, '^[\p{L}\p{N}]+(?:[''’.\-‐-―][\p{L}\p{N}]+)*(?:(?:\s+|\s+[&/\-‐-―]\s+)[\p{L}\p{N}]+(?:[''’.\-‐-―][\p{L}\p{N}]+)*)+$') and len(regexp_extract_all(label, '[\p{L}\p{N}]+(?:[''’.\-‐-―][\p{L}\p{N}]+)*')) between 2 and 6 as phase_ok,
        regexp_matches(label, '^[A-Za-z]+( [A-Za-z]+){1,3}$') as topic_ok from l""",
    "comment_interval": """with s as (select user_id, min(ts) as low, max(ts) as high from events where event_type = 'purchase' group by user_id) select e.user_id, count(*) as n from events e join s on s.user_id = e.user_id and e.ts between s.low and s.high group by e.user_id""",
    "topic_report": """select d.doc_id as op_id, coalesce(toxic, -1) as label, case when l.doc_id is null then 0.0::double else (d.doc_id % 17) / 17.0::double end as similarity, case when l.doc_id is null then 'Unassigned' when toxic = 0 then 'clean' else 'topic ' || toxic end as topic from documents d left join labels l using (doc_id)""",
    "run_totals": """select event_type, count(*) as calls, count(*) filter (event_type <> 'error') as successes, round(sum(value), 3) as duration from events group by event_type""",
    "dangling_edges": f"""with {PARTSEQ}, k as (select p_partkey as id from part where p_size < 40), x as (select src as key from partseq where src not in (select id from k) union all select dst from partseq where dst not in (select id from k)) select key::varchar as key, count(*) as n from x group by key""",
    "data_edges": f"""with {PARTSEQ} select src::varchar as key, count(*) as n from partseq where not src < dst group by src""",
    "token_estimate": """select source, sum(ceil(strlen(text) / 3))::bigint as tokens from documents group by source""",
    "graph_stats": f"""with {SEQ} select 'node' as kind, callee as name, count(*) as n from calls group by callee union all select 'edge', 'sequence', count(*) from seq""",
    "derived_guards": f"""with {CALLS}, s as (select * from (select id as src, k, lead(id) over w as dst, lead(k) over w as d from calls window w as (partition by user_id order by ts, id)) where dst is not null)
        select src, dst, case when k // 10 = d // 10 then 'g' || (k // 10) || '=' || (k % 2) else 'g' || (k // 10) || '=' || (k % 2) || ',g' || (d // 10) || '=' || (d % 2) end as guards from s where k // 10 <> d // 10 or k % 2 = d % 2""",
    "call_resolution": """select 'o' || o_orderkey as src, 'o' || o_orderkey || '_unresolved' as dst, true as leaf, 'unresolved' as reason from orders where o_orderkey % 5 = 0
        union all select 'o' || o_orderkey, 'c' || o_custkey, c_acctbal < 0, null from orders join customer on c_custkey = o_custkey where o_orderkey % 5 <> 0 and (c_acctbal < 0 or c_mktsegment <> 'BUILDING')
        union all select 'o' || o_orderkey, 'sF', false, null from orders where o_orderstatus = 'F'""",
    "phase_keys": f"""with recursive {TREE}, first as (select src, right(dst, 1) as d, arg_min(dst, (length(dst), dst)) as dst from tree group by all),
        w(root, id) as (select 'r' || r_regionkey, 'r' || r_regionkey from region union select w.root, f.dst from w join first f on f.src = w.id)
        select root, count(*) as n from w join (select distinct src, length(dst) as phase from tree) p on p.src = w.id group by root""",
    "nested_items": f"""with {CALLS}, p as (select user_id as method, id, k, callee <> 'view' as ok, (['g' || (k // 30) || '=' || (k % 2), 'h' || (k // 10) || '=' || (k % 2)])[1:k % 3] as path from calls),
        b as (select method, array_to_string(path[1:d - 1], '/') as container, split_part(path[d], '=', 1) as key, min(id) as first from (select *, unnest(generate_series(1, len(path))) as d from p) where ok group by all),
        r as (select method, array_to_string(path, '/') as container, (k % 2)::varchar as key, count(*) as n, min(id) as first from p where ok group by all),
        u as (select method, container, 'run' as kind, key, n, first from r union all select method, container, 'branch', key, 0, first from b)
        select method, container, row_number() over (partition by method, container order by first, kind, key) as ordinal, kind, key, n, first from u""",
    "gate_answers": """with p as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) as pos, length(text) as size from conversations),
        h as (select *, max(case when pos = 1 or size % 3 = 0 then pos end) over (partition by conv_id order by pos) as head from p)
        select conv_id as method, conv_id || '-' || pos as id, conv_id || '-' || head as phase, head as at, pos - head as seq from h""",
    "label_groups": """with p as (select 'c' || c_custkey as phase_id, case when c_mktsegment <> 'BUILDING' and c_nationkey % 3 <> 0 then 'n' || c_nationkey || 'a' else 'c' || c_custkey end as g from customer
        union all select 'n' || n_nationkey || x, 'n' || n_nationkey || x from nation, (values ('a'), ('b')) v(x) where x = 'a' or n_nationkey % 3 = 0), r as (select phase_id, min(phase_id) over (partition by g) as root from p)
        select 'item-' || dense_rank() over (order by root) as item, phase_id from r""",
    "method_bundle": """select o_orderkey as entry_id, count(l_orderkey) as n, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey), '') as nodes from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""",
    "bundle_checks": """with m as (select p_partkey as e from part where p_size < 40), o as (select o_orderkey as id, o_custkey as root from orders where o_orderkey % 2 = 0), found as (
        select 'leaf-type' as check from part where p_size in (10, 11) union all select 'missing-leaf' from lineitem where l_partkey not in (select p_partkey from part where p_size >= 10)
        union all select 'missing-root' from o where root not in (select e from m) union all select 'missing-reached' from lineitem where l_partkey not in (select e from m)
        union all select 'missing-caller' from lineitem where l_partkey in (select e from m) and l_suppkey not in (select e from m)
        union all select 'missing-operation' from lineitem where l_partkey in (select e from m) and l_orderkey not in (select id from o)) select "check", count(*) as n from found group by "check" """,
    "payload_batches": """select doc_id // 32 as batch, '{"schemaVersion":"one","operations":[' || string_agg('{"id":' || doc_id || case when lang is null then '' else ',"entryPoint":"' || lang || '"' end || ',"subsequentMethods":[' || coalesce('"' || source || '"', 'null') || ']}', ',' order by doc_id) || ']}' as payload from documents group by 1""",
    "corpus_text": """select p_partkey as pos, 'Class: ' || p_name || chr(10) || '  Methods: ' || p_type || ', ' || p_brand || chr(10) || '  Members: ' || p_name as text from part""",
    "throw_edges": f"""with {SEQ} select s.src, s.dst from seq s join calls a on a.id = s.src join calls b on b.id = s.dst where a.callee <> 'error' or b.callee = 'purchase'""",
    "lambda_calls": """select 'o' || o_orderkey as id from orders where o_orderpriority like '1-%' and not exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')""",
    "arm_outcomes": """with a as (select l_orderkey as g, l_linenumber as arm, list_sort(list_distinct(list(l_returnflag || '|' || l_linestatus))) as s from lineitem group by all) select g as groupId, count(distinct s) as outcomes from a group by g""",
    "group_methods": """select o_orderkey as "group", 'c' || o_custkey as method from orders where o_orderstatus = 'F' union select o_orderkey, 's' || l_suppkey from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'F'""",
    "direct_flow": f"""with {PARTSEQ} select dst, count(*) as n, min(src) as first, max(src) as last from partseq join part a on a.p_partkey = src join part b on b.p_partkey = dst where a.p_size < 25 and b.p_size < 25 group by dst""",
    "data_attached": f"""with {PARTSEQ}, {BRANDSEQ} select 'data' as type, src as id, count(*) as n from partseq join part a on a.p_partkey = src join part b on b.p_partkey = dst where a.p_size < 40 and b.p_size < 40 group by src union all select 'sequence', src, count(*) from brandseq group by src""",
    "membership": f"""with {TREE}, a as (select n_name as operation, 'n' || n_nationkey as m from nation), b as (select operation, dst as m from a join tree on src = m), c as (select operation, dst as m from b join tree on src = m) select m as method, operation from (select * from a union select * from b union select * from c)""",
    "operation_documents": """with m as (select l_orderkey as operation, l_partkey as k, min(l_linenumber) as pos from lineitem group by all) select operation, pos, 'p' || k as method, coalesce(p_name, 'p' || k) as name from m left join part on p_partkey = k and p_size < 25""",
    "traversal": f"""with {TREE}, a as (select 'r' || r_regionkey as root, 'r' || r_regionkey as id, 0::bigint as rank from region),
        b as (select root, dst as id, row_number() over (partition by root order by rank, length(dst), dst) as rank from a join tree on src = id),
        nb as (select root, count(*) as n from b group by root), c as (select root, dst as id, 0 + (select n from nb where nb.root = b.root) + row_number() over (partition by root order by rank, length(dst), dst) as rank from b join tree on src = id),
        nc as (select root, count(*) as n from c group by root), d as (select root, dst as id, (select n from nb where nb.root = c.root) + (select n from nc where nc.root = c.root) + row_number() over (partition by root order by rank, length(dst), dst) as rank from c join tree on src = id)
        select * from a union all select * from b union all select * from c union all select * from d""",
    "boundaries": f"""with {TURNS}, i as (select conv_id, turn, max(arguments) as a from turns group by all), n as (select conv_id, turn, a, lead(a) over (partition by conv_id order by turn) as b from i),
        l as (select conv_id, turn, b, unnest(a[1:3]) as "left" from n where b is not null) select conv_id as method, turn::bigint as ordinal, "left", unnest(b[1:2]) as "right" from l""",
    "evidence": r"""with w as (select doc_id as owner, unnest(string_split_regex(text, '[ \n\t]+')) as value, generate_subscripts(string_split_regex(text, '[ \n\t]+'), 1) - 1 as pos from documents where text is not null),
        k as (select owner, pos, case when pos % 2 = 0 then 'literal' else 'identifier' end as kind, case when pos % 2 = 0 and regexp_full_match(value, '(".*"|''.*'')', 's') then value[2:-2] else value end as value from w),
        f as (select owner, kind, value, min(pos) as pos from k where trim(value) <> '' group by all) select owner, kind, count(*) as n, sum(pos)::bigint as places from f group by all""",
    "failure_counters": """select user_id, event_type as reason, sum(event_id % 3)::bigint as n from events where event_type <> 'view' and event_id % 3 > 0 group by all""",
    "topic_answers": """with a as (select doc_id, (doc_id % 5 + quality)::int as g from labels), one as (select doc_id, min(g) as g from (select * from a union all select * from a where doc_id % 7 = 0) group by doc_id having count(*) = 1)
        select d.doc_id as id, case when g in (select r_regionkey - 1 from region) and g <> -1 then g end as label from documents d left join one using (doc_id)""",
    "cluster_names": """with c as (select label::int as label, count(*) as n_members from embeddings group by all) select label, case when label <> -1 and regexp_matches('Nation ' || n_name, '^[A-Za-z]+( [A-Za-z]+){1,3}$') then 'Nation ' || list_aggregate(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') else 't' || label end as name,
        n_members, 't' || label as terms, row_number() over (order by label = -1, n_members desc, label) as place from c left join nation on n_nationkey = label""",
    "label_subjects": """with s as (select distinct 's' || (conv_id // 2) as id, conv_id as pos from conversations), f as (select id, min(pos) as pos from s group by id),
        e as (select conv_id as pos, role || case when conv_id % 3 = 0 then '' else turn::varchar end as p, length(text) > 100 as filled from conversations), g as (select pos from e group by pos having count(*) = count(distinct nullif(p, '')) and bool_or(filled)) select id, pos from f where pos in (select pos from g)""",
    "readme_packages": """with r as (select lower(replace(replace(p_type, '#', ''), ' ', '')) as m, lower(replace(replace(p_brand, '#', ''), ' ', '')) as b from part) select 'src/' || m || '/README.md' as path, 'com.' || m || case when count(distinct b) = 1 then '.' || min(b) else '' end as package from r group by m""",
    "anchors_check": """with n as (select l_orderkey as g, l_linenumber as k, min(l_returnflag) as f from lineitem group by all), o as (select o_orderkey as g, case when o_orderstatus = 'F' then 'loop' else 'branch' end as kind from orders),
        a as (select g, 'entry' as role, 1 as k, 'A' as f from o union all select g, 'exit', 2, 'N' from o union all select g, 'decision', 3, 'R' from o where kind = 'branch')
        select 'bad-' || role as "check", count(*) as n, count(*) as told from a left join n using (g, k) where n.f is null or n.f <> a.f group by role
        union all select 'no-decision', count(*), count(*) from o where kind = 'branch' and not exists (select 1 from n where n.g = o.g and n.f = 'R') having count(*) > 0""",
    "exits_check": """with e as (select l_orderkey as g, l_linestatus as a, case when l_linenumber = 1 then 'break' else 'return' end as kind, case when l_returnflag <> 'N' then l_suppkey end as d from lineitem)
        select 'no-exit' as "check", count(*) as n from orders where not exists (select 1 from e where g = o_orderkey and a = o_orderstatus) having count(*) > 0
        union all select 'exit-to-unknown', count(*) from e where d is not null and d not in (select s_suppkey from supplier where s_acctbal > 0) having count(*) > 0
        union all select 'exit-to-nothing', count(*) from e where d is null and kind = 'break' having count(*) > 0""",
    "visible_graph": """with k as (select event_id as src, lead(event_id) over w as dst, bool_or(event_type = 'click') over w as met from events where event_type <> 'view' window w as (partition by user_id order by ts, event_id)) select src, dst from k where dst is not null and met""",
    "unfit_roots": """select 'no-body' as "check", c_custkey::varchar as key from customer where c_custkey not in (select o_custkey from orders) union all select 'no-name', c_custkey::varchar from customer where not c_acctbal > 0""",
    "retained_calls": f"""with {TREE}, m as (select distinct src as method, case when src < 'c5' then 1 else 2 end as own from tree), c as (select method, own as n from m where method like 'c%'),
        k as (select src as method, dst as call, c.n as n from tree join c on c.method = dst), nn as (select m.method, own + coalesce((select sum(n) from k where k.method = m.method and n > 1), 0) as n from m where m.method like 'n%'),
        k2 as (select src as method, dst as call, nn.n as n from tree join nn on nn.method = dst) select method, count(*) as n from (select * from k union all select * from k2) where n > 1 group by method""",
    "scoped_features": """with e as (select user_id, event_type as kind, json_extract_string(props, '$.k') as v from events where event_type in ('click', 'error', 'purchase'))
        select user_id as node_id, coalesce(string_agg(distinct v, ',' order by v) filter (kind = 'click'), '') as click, coalesce(string_agg(distinct v, ',' order by v) filter (kind = 'error'), '') as error, coalesce(string_agg(distinct v, ',' order by v) filter (kind = 'purchase'), '') as purchase, string_agg(distinct kind, ',' order by kind) as observed
        from e where user_id in (select c_custkey from customer where c_acctbal > 0) group by user_id""",
    "preprocess": r"""with w as (select doc_id, unnest(string_split_regex(case when MARKED then '' else text end, '[^a-zA-Z0-9]+')) as part, generate_subscripts(string_split_regex(case when MARKED then '' else text end, '[^a-zA-Z0-9]+'), 1) as i from documents),
        s as (select doc_id, i, unnest(string_split(regexp_replace(regexp_replace(part, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')) as x, generate_subscripts(string_split(regexp_replace(regexp_replace(part, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' '), 1) as k from w),
        j as (select doc_id, string_agg(lower(x), ' ' order by i, k) as words from s where length(x) >= 3 and lower(x) not in (STOPS) group by doc_id)
        select doc_id, length(coalesce(words, ''))::bigint as n_chars, md5(coalesce(words, '')) as digest from documents left join j using (doc_id)""".replace("MARKED", " or ".join(f"contains(text, '{m}')" for m in ANGLE_MARKERS)).replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS)),
}

LINES = """lines as (select distinct l_orderkey as o, l_linenumber as n from lineitem),
    e0 as materialized (select o, o * 100 + n as src, o * 100 + nxt as dst from (select o, n, lead(n) over (partition by o order by n) as nxt from lines) where nxt is not null
        union select l_orderkey, l_orderkey * 100 + l_linenumber, l_orderkey * 100 + 1 + l_suppkey % l_linenumber from lineitem where l_returnflag = 'R')"""
CLOSED = """far(src, dst) as (select src, dst from e0 union select far.src, e0.dst from far join e0 on e0.src = far.dst),
    ids as (select src as id from e0 union select dst from e0),
    part as materialized (select ids.id, least(ids.id, coalesce(min(a.dst), ids.id)) as component from ids left join (select a.src, a.dst from far a join far b on a.src = b.dst and a.dst = b.src) a on a.src = ids.id group by ids.id)"""
SQL["topo_levels"] = f"""with recursive {LINES}, {CLOSED},
    dag as (select distinct a.component as src, b.component as dst from e0 join part a on a.id = src join part b on b.id = dst where a.component <> b.component),
    walk(id, level) as (select component, 0 from part union select dst, level + 1 from walk join dag on src = walk.id), top as (select id, max(level) as level from walk group by id),
    whole as (select part.id, component, level, part.id % 100 as rank, min(part.id % 100) over (partition by component) as first from part join top on top.id = component)
    select id, component, level, row_number() over (partition by id // 100, level order by first, component, rank, id) as place from whole"""
SQL["cycle_report"] = f"""with recursive {LINES}, {CLOSED},
    inner_ as materialized (select src, dst, a.component from e0 join part a on a.id = src join part b on b.id = dst where a.component = b.component),
    shape as (select component, count(distinct src) as nodes, count(*) as edges from inner_ group by component),
    walk(component, here, path) as (select distinct component, component, [component] from inner_ union all select walk.component, dst, path || [dst] from walk join inner_ on inner_.src = here where dst <> walk.component and not list_contains(path, dst)),
    closed as (select walk.component, path, row_number() over (partition by walk.component order by len(path), list_reverse(path)) as r from walk join inner_ on inner_.src = here and inner_.dst = walk.component)
    select component, nodes, edges, len(path) as length, array_to_string(path, '>') as witness from shape join closed using (component) where r = 1"""


def _cut(rounds: int = 8) -> str:
    """Rounds one after the other: closure of each loop's part, first nodes of its cyclic components, edges to them sent to exits."""
    steps = [
        LINES,
        "held as materialized (select o * 100 + n as id, n as rank, loop, depth from lines join orders on o_orderkey = o and o_orderstatus <> 'P' join (values ('o', 0), ('i', 1)) k(loop, depth) on depth = 0 or n between 2 and 4)",
        "c0 as (select src, dst, false as cut from e0)",
    ]
    for k in range(rounds):
        steps += [
            f"k{k} as materialized (select src, dst, a.loop, a.depth, b.rank, src // 100 as o from c{k} join held a on a.id = src join held b on b.id = dst and b.loop = a.loop)",
            f"f{k}(loop, src, dst) as (select loop, src, dst from k{k} union select f{k}.loop, f{k}.src, k{k}.dst from f{k} join k{k} on k{k}.src = f{k}.dst and k{k}.loop = f{k}.loop)",
            f"b{k} as materialized (select a.loop, a.src, min(least(a.src, a.dst)) as part from f{k} a join f{k} b on a.loop = b.loop and a.src = b.dst and a.dst = b.src group by all)",
            f"z{k} as (select k{k}.*, x.part from k{k} join b{k} x on x.loop = k{k}.loop and x.src = k{k}.src join b{k} y on y.loop = k{k}.loop and y.src = k{k}.dst and x.part = y.part)",
            f"h{k} as (select *, first_value(dst) over (partition by loop, part order by rank, dst) as head from z{k})",
            f"d{k} as materialized (select src, dst, arg_max(case loop when 'o' then -o else o * 100 + 5 end, depth) as out from h{k} where dst = head group by src, dst)",
            f"c{k + 1} as materialized (with kept as (select src, dst, cut from c{k} where (src, dst) not in (select (src, dst) from d{k})) select * from kept union all select distinct src, out, true from d{k} where (src, out) not in (select (src, dst) from kept))",
        ]
    return f"with recursive {', '.join(steps)} select src, dst, cut from c{rounds}"


SQL["cycle_cut"] = _cut()

SQL["answer_records"] = """select conv_id, 3 * count(*) as records, sum(1 + len(list_filter(string_split(text, chr(10))[2:], lambda x: trim(x) <> '')))::bigint as malformed,
    count(*) as joined, count(*) as not_object from conversations group by conv_id"""
SQL["span_events"] = """with s as (select user_id, event_id as span, ts as a, coalesce(lead(ts, 2) over (partition by user_id order by ts, event_id), ts) as b from events where event_type = 'purchase')
    select span, count(*) as n, min(event_id) as first, max(event_id) as last from s join events using (user_id) where ts between a and b group by span"""

SQL["topic_drill_down"] = """with o as (select c_custkey as op_id, c_name as root, case when c_acctbal >= 0 then c_nationkey::int else -1 end as topic, case when c_acctbal >= 0 then (c_custkey % 8) / 8.0::double else 0.0 end as similarity,
    case when c_custkey % 3 <> 0 then c_custkey::varchar when c_custkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment end as label from customer)
    select topic, row_number() over (partition by topic order by lower(label), op_id) as place, op_id, label, root, similarity from o"""
SQL["ordered_roots"] = f"""select id, kind, row_number() over (partition by kind order by id) as place from ({SQL["roots_orphans"]})"""
SQL["document_names"] = r"""with n as (select p_partkey, (['', '$', 'access$', 'lambda$a$', '<init>', 'a.<lambda>', 'java.util.'])[p_size % 7 + 1] || case when p_size % 7 = 4 then '' else p_type end || case when p_partkey % 5 = 0 then '$' || p_size else '' end as name from part),
    s as (select *, regexp_matches(name, '<(operator|clinit|unresolvedNamespace|unknownFullName|empty|lambda|init)>') or starts_with(name, 'access$') or regexp_matches(name, '^lambda\$.*\$[0-9]+(:.*)?$') or regexp_matches(name, '\$[0-9]+$') as synthetic from n)
    select p_partkey, synthetic, not synthetic and not starts_with(name, 'java.') as type, not synthetic or name = '<init>' as method, not synthetic and not starts_with(name, '$') as identifier from s"""
SQL["correlated_answers"] = """with t as (select conv_id, turn, conv_id % 4 <> 3 as asked, case when turn = 0 then case when conv_id % 5 = 0 then 'short' else 'plain' end when turn = 1 then 'number' when turn = 2 and conv_id % 2 = 0 then 'glued' else 'none' end as kind from conversations),
    k as (select conv_id, count(*) filter (kind in ('short', 'plain', 'glued')) as n, arg_min(kind, turn) filter (kind in ('short', 'plain', 'glued')) as first from t where asked group by conv_id),
    r as (select 'malformed_json' as reason, count(*) as n from t where kind = 'none' union all select 'concatenated_json', count(*) from t where kind = 'glued'
    union all select 'invalid_value', (select count(*) from t where kind in ('number', 'glued')) + (select count(*) from k where first = 'short') union all select 'invented_id', count(*) from t where not asked and kind in ('short', 'plain', 'glued')
    union all select 'duplicate_id', sum(n - 1) from k where n > 0 union all select 'missing_id', count(*) from k where n = 0 union all select 'resolved', count(*) from k where n = 1 and first <> 'short')
    select reason, n::bigint as n from r where n > 0 or reason = 'resolved'"""
SQL["source_stats"] = r"""with d as (select doc_id, '// first' || chr(10) || chr(10) || text || chr(10) || 'public class A$1 { enum B {} }' || chr(10) as text from documents),
    l as (select trim(unnest(string_split_regex(text, '\r?\n')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as s from d)
    select (select count(*) from d) as files, (select sum(strlen(text)) from d)::bigint as bytes, (select sum(len(regexp_extract_all(text, '\b(?:class|interface|enum|record)\s+[A-Za-z_$][\w$]*'))) from d)::bigint as declared_types,
    count(*) as physical_lines, count(*) filter (s = '') as blank_lines, count(*) filter (starts_with(s, '//') or starts_with(s, '/*')) as comment_lines, count(*) filter (s <> '' and not starts_with(s, '//') and not starts_with(s, '/*')) as source_lines from l"""

SQL["slice_parts"] = f"""with recursive {TREE}, starts as (select 'r' || r_regionkey as root from region union all select 'n' || n_nationkey from nation),
    w(root, id) as (select root, root from starts union select root, dst from w join tree on src = w.id),
    all_edges as (select src, dst from tree union all select 'o' || o_orderkey, 'c' || o_custkey from orders where o_orderstatus = 'F'),
    n as (select root, count(*) as nodes from w group by root), e as (select a.root, count(*) as edges from all_edges join w a on a.id = src join w b on b.id = dst and b.root = a.root group by a.root),
    k as (select w.root, o.* from w join orders o on w.id = 'o' || o_orderkey),
    b as (select root, count(*) as branches from (select root, id from w where id like 'c%' union all select distinct root, 'g' || (o_orderkey % 50) from k where o_orderkey % 50 in (select o_orderkey % 60 from orders)) group by root),
    l as (select root, count(*) as loops from (select root, id from w where id like 'n%' union all select distinct root, o_orderstatus from k) group by root)
    select root, coalesce(nodes, 0) as nodes, coalesce(edges, 0) as edges, coalesce(branches, 0) as branches, coalesce(loops, 0) as loops from starts left join n using (root) left join e using (root) left join b using (root) left join l using (root)"""
SQL["targeted_flow"] = f"""with recursive {BRANDSEQ}, asked as materialized (select src, dst from brandseq union select a.src, b.dst from brandseq a join brandseq b on a.dst = b.src),
    t as (select distinct dst as id, dst in (select p_partkey from part where p_size % 3 <> 1) as known from asked), kept as materialized (select p_partkey as id from part where p_size < 25),
    w(root, id, level) as (select id, id, 0 from t where known union select root, e.src, level + 1 from w join brandseq e on e.dst = w.id where level < 10 and (level = 0 or w.id not in (select id from kept))),
    seen as materialized (select root, id, min(level) as level from w group by root, id),
    met as (select id as src, root as dst from seen where level > 0 and id in (select id from kept) and (id, root) in (select (src, dst) from asked)), v as (select root, count(*) as n from seen group by root)
    select dst, count(*) as n, min(src) as first from met group by dst union all select null, sum(n)::bigint, max(n) from v union all select null, count(*), count(*) filter (not known) from t"""

SQL["retry_batches"] = """select source as key, doc_id as id, case when strlen(text) <= 30000 and doc_id % 4 < 3 then 'a' || doc_id end as answer,
    case when strlen(text) > 30000 then -1 when doc_id % 4 < 3 then doc_id % 4 end as attempt from documents"""

SQL["call_instances"] = """with c as (select *, case when c_mktsegment = 'MACHINERY' then row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey desc) else row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) end as place from customer),
    r as (select 'r' || r_regionkey as i, r_regionkey from region), n as (select i || '/' || n_name || '/0:n' || n_nationkey as j, i, n_name, n_nationkey, n_regionkey from r join nation on n_regionkey = r_regionkey),
    k as (select j || '/' || c_mktsegment || '/' || c_custkey || ':c' || c_custkey as l, j, c_mktsegment, c_custkey, c_acctbal from n join c on c_nationkey = n_nationkey and place = 1),
    g as (select i || '#' || i as id, i as method, 0 as depth, false as expandable, false as cut, 0 as invokes, (select count(*) from n where n.i = r.i) as follows from r
    union all select i || '#' || n_name, i, 0, true, false, 1, 0 from n union all select j || '#n' || n_nationkey, 'n' || n_nationkey, 1, false, false, 0, (select count(*) from k where k.j = n.j) from n where n_nationkey is not null
    union all select j || '#' || c_mktsegment, 'n' || n_nationkey, 1, true, false, 1, 0 from k join n using (j) union all select l || '#c' || c_custkey, 'c' || c_custkey, 2, false, false, 0, (c_acctbal < 0)::int from k
    union all select l || '#back', 'c' || c_custkey, 2, true, true, 0, 0 from k where c_acctbal < 0) select * from g"""
