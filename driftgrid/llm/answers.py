"""The queries' answers as DuckDB SQL over the same tables."""

from __future__ import annotations

from driftgrid.llm import block_mix as mix
from driftgrid.llm import ownership, risk_rules
from driftgrid.llm.common import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("wide", "[A-Za-z0-9+/_-]+", 0, 20))

found = " union all ".join(
    f"""select doc_id, source, {k} as kind, i, v[i] as value,
        cast(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as a, length(m[i]) as n, {least} as least
    from (select doc_id, source, p, m, v, unnest(range(1, len(m) + 1)) as i from (
        select doc_id, source, string_split_regex(t, '{pattern}') as p, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as v
        from (select doc_id, source, coalesce(text, '') as t from documents)))"""
    for k, (_, pattern, group, least) in enumerate(KINDS)
)
made_up = " and ".join(f"not contains(lower(value), '{p}')" for p in ownership.PLACEHOLDERS)
OP1 = f"""
with spans as (select *, a + n as b from ({found}) where length(value) >= least),
named as (select * from spans where kind < 3),
candidates as (
    select * from named union all
    select w.* from spans w where kind = 3 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]')
    and not exists (select 1 from named x where x.doc_id = w.doc_id and x.a < w.b and x.b > w.a)),
held as (
    select value, count(distinct source) + count(distinct coalesce(cast(doc_id as varchar), '')) filter (source is null) as owners,
        count(distinct (source, coalesce(cast(doc_id as varchar), ''))) as repos
    from candidates group by value),
judged as (
    select c.*, owners < {ownership.WIDE_OWNERS} and repos <= {ownership.WIDE_REPOS} * owners and len(list_distinct(string_split(value, ''))) >= {ownership.LIVE_CHARS} and regexp_matches(value, '[0-9]') and {made_up} as live
    from candidates c join held using (value)),
listed as (
    select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
        coalesce(string_agg(s, ',' order by a, kind) filter (kind < 3), '') as base, string_agg(s, ',' order by a, kind) as spans, count(*) filter (live) as n_live
    from (select *, ['assign', 'access', 'hex', 'wide'][kind + 1] || ':' || a || ':' || b as s from judged where kind < 3 or live) group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
    coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from documents left join listed using (doc_id)
"""


def mixed(x: str, seed: str, r: str) -> str:
    h = f"((({x}) % {mix.PRIME}) * {mix.A} + ({x}) // {mix.PRIME} * {mix.C} + (({seed}) % {mix.PRIME}) * {mix.B} + ({r}) * 7919 + 1) % {mix.PRIME}"
    return f"list_transform([{h}], lambda h: (h * h + h * {mix.A} + {r}) % {mix.PRIME})[1]"


def permuted(x: str, n: str, seed: str, inverse: bool = False) -> str:
    order = list(range(mix.ROUNDS))[:: -1 if inverse else 1]
    key = f"(({mixed('r', seed, '1')}) * {mix.PRIME} + ({mixed('r', seed, '2')})) % {n}"
    other = f"((({key}) - now + {n}) % {n})"
    coin = mixed("greatest(now, other)", seed, "r")
    return (
        f"list_reduce(list_concat([cast({x} as bigint)], {[o for o in order]}::bigint[]), "
        f"lambda now, r: list_transform([{other}], lambda other: case when (({coin}) // 8) % 2 = 1 then other else now end)[1])"
    )


B = mix.BLOCK
OP5 = f"""
with sizes as (select row_number() over () as row, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size from documents),
named as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source asc nulls last) as rank from sizes group by source),
weighed as (select *, {list(mix.WEIGHTS)}[(rank - 1) % {len(mix.WEIGHTS)} + 1] as weight, sum(source_size) over () as total from named),
room as (
    select *, total - {mix.PASSES} * coalesce(sum(source_size) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0) as open_words,
        sum(weight) over (order by source_size / weight, rank rows between current row and unbounded following) as open_weight from weighed),
marked as (select *, weight * open_words > {mix.PASSES} * source_size * open_weight as stops from room),
shared as (
    select *, total - coalesce(sum(case when stops then {mix.PASSES} * source_size end) over (), 0) as words, coalesce(sum(case when not stops then weight end) over (), 1) as weights from marked),
aimed as (select *, case when stops then cast({mix.PASSES} * source_size as double) else weight * (cast(words as double) / weights) end as target, (source_size + {B - 1}) // {B} as blocks from shared),
goal as (
    select *, source_size - (blocks - 1) * {B} as short, least(cast(floor(target + 0.5) as bigint), {mix.PASSES} * source_size) as goal from aimed where source_size > 0),
passes as (select *, goal // source_size as passes, goal % source_size as part from goal),
whole_passes as (select rank, block, unnest(range(passes)) as pass, {B} as words, false as cut from (select *, unnest(range(blocks)) as block from passes)),
steps as (
    select rank, short, part, blocks, k, {permuted('k', 'blocks', 'rank * 1009 + passes')} as block from (select *, unnest(range(blocks)) as k from passes where part > 0)),
filled as (
    select *, sum(case when block = blocks - 1 then short else {B} end) over (partition by rank order by k) as reach, case when block = blocks - 1 then short else {B} end as room from steps),
part_pass as (
    select rank, block, least(room, part - (reach - room)) as words from filled where reach - room < part),
used as (
    select rank, block, sum(words) as head from part_pass group by all),
placed as (
    select row, s.doc_id, size, rank, source_size, target, passes,
        cast(sum(size) over (partition by rank order by coalesce(s.doc_id, 0) % (select count(*) // {mix.BUCKET_ROWS} + 1 from sizes), s.doc_id nulls last, size, row) as bigint) as stop
    from sizes s join aimed a on s.source is not distinct from a.source left join (select rank, passes from passes) p using (rank)),
pieces as (
    select row, rank, block, greatest(stop - size, block * {B}) as a, least(stop, (block + 1) * {B}) as b
    from (select *, unnest(range((stop - size) // {B}, (stop - 1) // {B} + 1)) as block from placed where size > 0)),
more as (
    select row, sum(greatest(least(b, block * {B} + head) - a, 0)) as words from pieces join used using (rank, block) group by row)
select doc_id, size, source_size, target, cast(size * coalesce(passes, 0) + coalesce(more.words, 0) as bigint) as taken from placed left join more using (row)
"""

OP6 = f"""
with lines as (
    select doc_id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (select *, {low(f'trim(line, {BLANKS})')} as key from lines),
owners as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key),
marked as (select k.*, coalesce(k.doc_id > owner, false) as gone from keyed k left join owners o on k.key = o.key and length(k.key) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

OP7 = """
with recursive rows as (
    select vec_id, label, embedding::double[] as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as norm from embeddings),
good as (select * from rows where label is not null and norm > 0 and isfinite(norm) and len(list_filter(v, lambda x: x is null)) = 0),
links as (
    select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
lowest as (select a, least(a, min(b)) as component from reach group by a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, coalesce(component, vec_id) as component_id, coalesce(component, vec_id) = vec_id as kept
from embeddings left join lowest on a = vec_id
"""

OP8 = f"""
with recursive words as (select doc_id, regexp_extract_all({low("coalesce(text, '')")}, '{WORD}') as w from documents),
shingles as (
    select distinct doc_id, s from (
        select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common.n >= 80 * (x.n + y.n - common.n)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
lowest as (select a, least(a, min(b)) as component from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component, d.doc_id) as component_id, coalesce(component, d.doc_id) = d.doc_id as kept
from documents d left join sizes using (doc_id) left join lowest on a = d.doc_id
"""

rules = risk_rules.RULES
limits = ", ".join(f"('{r}', {i}, {c}::double)" for i, (r, c) in enumerate(risk_rules.PATH))
values = " union all ".join(f"select doc_id, lang, '{r}' as rule, {top} / cast(nullif({below}, 0) as double) as value from measured" for r, (top, below, _) in rules.items())
OP10 = f"""
with split as (
    select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {BLANKS}) <> '') as l from documents),
windows as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from split where len(w) >= 3),
repeated as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from windows) where n > 1),
covered as (select doc_id, count(distinct i + o) as n from repeated, range(3) as g(o) group by doc_id),
measured as (
    select s.doc_id, lang, len(w) as n_words, length(translate(t, {BLANKS}, '')) as word_chars, length(t) - length(translate(t, '{risk_rules.SYMBOLS}', '')) as n_symbols,
        len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(c.n, 0) as n_repeat_words
    from split s left join covered c using (doc_id)),
valued as ({values}),
good as (select doc_id from labels where doc_id is not null and quality is not null group by doc_id having min(quality) = 1),
labelled as (select *, substr(sha256(cast(doc_id as varchar)), 1, 1) < '4' as pilot from measured semi join good using (doc_id)),
strata as (select lang, count(*) as n from labelled where not pilot group by lang),
limits as (select * from (values {limits}) v(rule, i, cutoff)),
sizes as (select lang, count(*) filter (pilot) as n from labelled group by lang),
path as (
    select s.lang, l.rule, l.i, l.cutoff from sizes s, limits l
    where (select count(*) from valued v join labelled g using (doc_id) where g.pilot and v.lang = s.lang and v.rule = l.rule and v.value > l.cutoff) <= {risk_rules.RISK / len(rules)} * s.n),
first as (select doc_id, lang, min(i) filter (value > cutoff) as first from (select v.* from valued v join labelled g using (doc_id) where not g.pilot) join path using (lang, rule) group by all),
counts as (
    select lang, i, (select count(*) from first f where f.lang = s.lang and f.first <= l.i) as k, n
    from strata s, limits l where {1 - risk_rules.RISK} ** n <= {risk_rules.DOUBT}),
walked as (
    select lang, count(*) as steps from counts
    where k <= {risk_rules.RISK} * n and list_sum(list_transform(range(0, k + 1), lambda j:
        exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk_rules.RISK}) + (n - j) * ln({1 - risk_rules.RISK})))) <= {risk_rules.DOUBT} / (select count(distinct lang) from counts)
    group by lang),
passed as (select lang, rule, min(cutoff) as cutoff from walked join path using (lang) where i < steps group by lang, rule),
failed as (select doc_id, string_agg(v.rule, ',' order by o) as rules from valued v join passed p using (lang, rule) join (select unnest({list(rules)}) as rule, unnest(range({len(rules)})) as o) using (rule) where value > cutoff group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and rules is null as kept, coalesce(rules, '') as failed_rules
from measured left join failed using (doc_id)
"""

OP11 = """
with taken as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scores as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
    from taken a join taken b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scores where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 10
"""


def number(eighth: int) -> str:
    return f"cast('0x' || substr(h, {8 * eighth + 1}, 8) as bigint)"


OP13 = f"""
with units as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
    from documents),
drawn as (select *, len(u) as n, {number(0)} as h1, {number(1)} as h2, {number(2)} as h3, {number(3)} as h4 from units),
cut as (
    select doc_id, t, n,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
        array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') as p,
        array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') as m,
        array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') as s
    from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from cut
"""

SQL = {
    "op1_ownership_secrets": OP1,
    "op5_block_mix": OP5,
    "op6_line_runs": OP6,
    "op7_sign_hash_vectors": OP7,
    "op8_minmax_near_dedup": OP8,
    "op10_risk_rules": OP10,
    "op11_anchor_negatives": OP11,
    "op13_rank_index_fim": OP13,
}
