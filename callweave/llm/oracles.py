"""DuckDB SQL for the operators that SQL can express, over the same tables.

Rules and patterns of the contracts are written out here, not taken from the operators, so that an error in
either shows.
"""

from __future__ import annotations

# Rules of operator 5 (verdict, host, path), its twin hosts and links.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TWIN = "^(?:www[0-9]?|m|mobile|amp|blog|news|shop)[.](.+[.].+)$"
LINK = r"""\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
# Kinds of operator 6, their patterns and the group that holds the secret; lengths are in the SQL.
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
    ("access", "AKIA[A-Z0-9]{12,}", 0),
    ("hex", "[0-9a-f]{32,}", 0),
    ("owned", "[A-Za-z0-9+/_=-]{16,}", 0),
)
OWNED = 3
# Topics of operator 3 in order, their strings, and a pattern with strings that stand in its matches.
DIMENSIONS = ("source", "lang", "topic")
TOPICS = (
    ("legal", ("license ", "licence ", "licensed ", "licenced ", "copyright", "all rights reserved"), ()),
    ("technical", ("password", "secret", "token", "api_key", "apikey", "http://", "https://"), ()),
    ("contact", ("@",), ((), "[0-9]{3}[- ][0-9]{3}")),
    ("tabular", (), (("| ", " |"), "[|] [^|]* [|]")),
)

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality() -> str:
    """Operator 2: base rules, then lines (as strings, not hashes) by documents of all hosts and of one."""
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select r, unnest(regexp_extract_all(text, {WORDS})) as word, generate_subscripts(regexp_extract_all(text, {WORDS}), 1) as i from d),
g as (select r, i, string_agg(word, ' ') over (partition by r order by i rows between current row and 7 following) as gram,
        count(*) over (partition by r order by i rows between current row and 7 following) as size from w),
twice as (select r, gram from g where size = 8 group by r, gram having count(*) > 1),
cover as (select g.r, g.i, max((twice.r is not null)::int) over (partition by g.r order by g.i rows between 7 preceding and current row) as hit
        from g left join twice on g.r = twice.r and g.gram = twice.gram and g.size = 8),
rep as (select r, sum(hit) as n_repeat_words from cover group by r),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
k as (select r, line, {LOWER.format(f"array_to_string(regexp_extract_all(line, {WORDS}), ' ')")} as norm, len(regexp_extract_all(line, {WORDS})) as n from l where len(regexp_extract_all(line, {WORDS})) > 0),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from k group by r),
n as (select d.host, k.r, k.norm, sum(k.n) as size, max(k.n) >= 20 as long from k join d using (r) group by all),
a as (select norm, count(*) as docs from n group by norm),
h as (select host, norm, count(*) as own from n group by all),
hosts as (select host, count(*) as of_host from d group by host),
lost as (select n.r, sum(n.size) as lost from n join a using (norm) join h using (host, norm) join hosts using (host)
        where a.docs > 8 and (n.long or (h.own > 8 and h.own > 0.05::double * of_host) or a.docs > 0.05::double * (select count(*) from d)) group by n.r),
base as (select d.r, doc_id, len(regexp_extract_all(text, {WORDS})) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols from d)
select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    n_words < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * n_words) and n_words - coalesce(lost, 0) >= 0.5::double * n_words as kept,
    coalesce(lost, 0)::bigint as n_removed_words
from base left join dup using (r) left join rep using (r) left join lost using (r)"""


def mixing(rounds: int = 12, power: float = 0.9) -> str:
    """Operator 3: cells, targets, the rounds of raking one after the other, and the draw."""
    cases = []
    for name, strings, pattern in TOPICS:
        tests = [f"contains(low, {quote(s)})" for s in strings]
        if pattern:
            tests.append("(" + " and ".join([*(f"contains(low, {quote(s)})" for s in pattern[0]), f"regexp_matches(low, {quote(pattern[1])})"]) + ")")
        cases.append(f"when {' or '.join(tests)} then '{name}'")
    topic = f"case {' '.join(cases)} when tokens < 100 then 'brief' when tokens < 600 then 'prose' else 'longform' end"
    steps, last = [], "w0"
    for k in range(rounds):
        for d in DIMENSIONS:
            name = f"w{k}_{d}"
            steps.append(f"{name} as materialized (select s, l, t, w * goal_{d}.target / sum(w) over (partition by {d[0]}) as w from {last} join goal_{d} on {d[0]} = v)")
            last = name
    goals = ", ".join(f"goal_{d} as materialized (select v, pow(n, {power}) / sum(pow(n, {power})) over () as target from (select {d[0]} as v, sum(n) as n from cells group by {d[0]}))" for d in DIMENSIONS)
    return rf"""
with d as (select doc_id, source, lang, lower(coalesce(text, '')) as low, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::double as tokens from documents),
marked as materialized (select *, coalesce(source, '(none)') as s, coalesce(lang, '(none)') as l, {topic} as t from d),
cells as materialized (select s, l, t, sum(tokens) as n from marked group by all having sum(tokens) > 0), {goals},
w0 as (select s, l, t, n / sum(n) over () as w from cells), {", ".join(steps)},
share as (select s, l, t, w / n / max(w / n) over () as p from {last} join cells using (s, l, t)),
found as (select doc_id, source, lang, t as topic, tokens, case when tokens > 0 then coalesce(p, 0) else 0 end::double as p from marked left join share using (s, l, t))
select doc_id, source, lang, topic, tokens, round(p, 9) as probability, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix'), 1, 8))::bigint / 4294967296.0::double < p as sampled from found"""


def urls(rounds: int = 120) -> str:
    """Operator 5: rules, then ``rounds`` rounds of both ways over the host links, far beyond the operator's tolerance."""
    host = LOWER.format("regexp_extract(coalesce({}, ''), '://([^/?#]*)', 1)")
    fits, sizes = [], sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    for kind, name, start in sizes:
        fits.append((f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{start}')", kind, name + start))
    rule = "case " + " ".join(f"when {c} then '{r}'" for c, _, r in fits) + " end"
    verdict = "case " + " ".join(f"when {c} then '{k}'" for c, k, _ in fits) + " end"
    return rf"""
with recursive p as materialized (select page_id, {host.format("url")} as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path, coalesce(html, '') as html from pages),
judged as materialized (select page_id, host, path, {rule} as rule, {verdict} as ruled from p),
found as (select host as src, unnest(regexp_extract_all(html, {quote("(?i)" + LINK)}, 1)) as link from p where host <> ''),
linked as (select src, {LOWER.format("regexp_extract(link, '([^@]*)$', 1)")} as dst from found),
l as (select src, dst, count(*) as n from linked where src <> dst and dst <> '' group by all),
known as (select host as h from p where host <> '' union select dst from l),
up as (select h as src, regexp_extract(h, {quote(TWIN)}, 1) as dst from known),
links as materialized (select src, dst, sum(n) as n from (select * from l union all select src, dst, 1 from up where dst <> '' union all select dst, src, 1 from up where dst <> '') group by all),
ways as (select 'trust' as way, src, dst, n from links union all select 'distrust', dst, src, n from links),
steps as materialized (select way, src, dst, n / sum(n) over (partition by way, src) as share from ways),
seeds as (select case ruled when 'allow' then 'trust' else 'distrust' end as way, host, count(*) as n from judged where ruled is not null and host <> '' group by all),
start as materialized (select way, host, n / sum(n) over (partition by way) as score from seeds),
walk as (
    select 0 as k, way, host, score from start
    union all
    select k + 1, way, host, sum(score) from (
        select k, steps.way, steps.dst as host, 0.85::double * score * share as score from walk join steps on steps.way = walk.way and steps.src = walk.host where k < {rounds}
        union all select k, start.way, start.host, 0.15::double * start.score from (select distinct k from walk where k < {rounds}) join start on true) group by all),
last as (select way, host, score / sum(score) over (partition by way) as score from walk where k = {rounds}),
sides as (select host, sum(case way when 'trust' then score else 0 end) as trust, sum(case way when 'distrust' then score else 0 end) as distrust from last group by host)
select page_id, judged.host as host, path, rule, coalesce(ruled, case when distrust > 0 and distrust > trust then 'block' else 'allow' end) as verdict from judged left join sides on judged.host = sides.host"""


def secret_spans() -> str:
    """Operator 6: spans by running sums of gaps and matches, owners and repositories of their hashes."""
    kinds = []
    for k, (_, pattern, group) in enumerate(PATTERNS):
        q = quote(pattern)
        kinds.append(f"select r, {k} as kind, unnest(regexp_extract_all(text, {q}, 0)) as token, unnest(regexp_extract_all(text, {q}, {group})) as value, unnest(list_slice(string_split_regex(text, {q}), 1, len(regexp_extract_all(text, {q})))) as gap, generate_subscripts(regexp_extract_all(text, {q}), 1) as nth from d")
    names = "case kind " + " ".join(f"when {k} then '{p[0]}'" for k, p in enumerate(PATTERNS)) + " end"
    said = f"string_agg({names} || ':' || s || ':' || e, ',' order by s, kind, e)"
    return rf"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(source, '') as owner, coalesce(text, '') as text from documents),
m as ({" union all ".join(kinds)}),
placed as (select *, sum(length(gap) + length(token)) over (partition by r, kind order by nth) as e from m),
spans as materialized (select r, kind, (e - length(token))::bigint as s, e::bigint as e, sha256(value) as hash from placed
    where (kind <> 0 or length(value) >= 8) and (kind <> {OWNED} or (regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')))),
clear as materialized (select * from spans x where kind <> {OWNED} or not exists (select 1 from spans b where b.r = x.r and b.kind <> {OWNED} and b.s < x.e and x.s < b.e)),
owned as (select hash, count(distinct owner) <= 1 and count(distinct (owner, coalesce(doc_id::varchar, ''))) <= 5 as live from clear join d using (r) group by hash),
judged as (select clear.*, live from clear join owned using (hash) where kind <> {OWNED} or live),
by_row as (select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = {OWNED}) as n_owned,
    count(*) filter (kind <> {OWNED} and live) as n_live, count(*) filter (kind <> {OWNED} and not live) as n_copied, {said} filter (kind <> {OWNED}) as base, {said} as spans from judged group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
    coalesce(n_owned, 0) as n_owned, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied from d left join by_row using (r)"""


def phrase_list() -> str:
    """Operator 11: all phrases of one to three words counted as strings; 128-bit integers for the scores."""
    return rf"""
with d as (select coalesce(lang, 'und') as lang, {LOWER.format("coalesce(text, '')")} as low from documents),
p as (select lang, unnest(string_split_regex(low, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
each as (select lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) as phrase
    from w join (values (1), (2), (3)) s(size) on len(words) >= size),
f as materialized (select lang, phrase, size, count(*) as f from each group by all having count(*) >= 10),
n as (select lang, sum(len(words))::bigint as n from w group by lang),
c as materialized (select lang, phrase, f as a, string_split(phrase, ' ') as words from f where size >= 2),
cuts as (select lang, phrase, a, k, array_to_string(words[1:k], ' ') as head, array_to_string(words[k + 1:], ' ') as rest from c join (values (1), (2)) s(k) on k < len(words)),
scored as (select cuts.lang, cuts.phrase, a, k, l.f as l, r.f as r, (1000000::hugeint * a * a // (l.f::hugeint * r.f))::bigint as score
    from cuts join f l on l.lang = cuts.lang and l.phrase = head join f r on r.lang = cuts.lang and r.phrase = rest),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as nth from scored) where nth = 1),
around as (select lang, phrase, max(a) as longer from (select lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) as phrase, a from c where len(words) = 3) group by all),
kept as (select best.* from best left join around using (lang, phrase) where longer is null or 100 * longer < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000"""


def trie() -> str:
    """Operator 13: prefixes as strings of digests, subtrees by the start of these strings."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: {bits}), 4294967295)"
    return rf"""
with o as materialized (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p,
        coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
sizes as (select c, count(*) as size from o group by c),
h as materialized (select c, {crc} % 4 as h, c - ((c % 20) + 20) % 20 as base from sizes),
t as (select h.c, p as d, role, text from h join o on o.c = base and p <= h union all
    select h.c, p - h + least(h, coalesce(size, 0)), role, text from h join o on o.c = h.c left join sizes on sizes.c = base where p > h),
m as materialized (select c, d, string_agg(md5(role) || md5(text), '') over (partition by c order by d) as path, len(regexp_extract_all(text, {WORDS})) as words from t union all select c, 0, '', 0 from h),
nodes as materialized (select path, d, min(c) as conv_id, count(*) as n, max(words) as words, left(path, length(path) - 64) as up from m group by path, d),
kids as materialized (select up as path, count(*) as kids from nodes where d > 0 group by up),
subs as (select v.path, sum((u.n - 1) * u.words)::bigint as saved, count(*) filter (kids is null) as leaves from nodes v join nodes u on starts_with(u.path, v.path) left join kids on kids.path = u.path group by v.path),
ends as (select path, string_agg(c::varchar, ',' order by c) as ends from (select c, arg_max(path, d) as path from m group by c) group by path)
select v.conv_id, v.d as depth, u.conv_id as parent_conv_id, v.n as n_convs, coalesce(kids, 0) as n_children, leaves as n_leaves, saved as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from nodes v left join nodes u on v.d > 0 and u.path = v.up left join kids on kids.path = v.path join subs on subs.path = v.path left join ends on ends.path = v.path"""
