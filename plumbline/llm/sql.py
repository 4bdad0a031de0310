"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from . import secrets as _s
from .chat import ESCAPED, OPEN, TRICKY
from .collocations import INSIDE_PERCENT, LEAST, TOP
from .lloyd import DIMS, K, ROUNDS, SCALE, SEED
from .quality import HOST_LIMIT, MAX_REPEAT_PERCENT, MIN_WORDS, WINDOW
from .substrings import WINDOW as REPEATED

_SPLIT = "[ \\t\\n\\x0B\\x0C\\r]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPLIT}'), lambda x: x <> '')"

SUBSTRINGS = f"""
with d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + {REPEATED - 1}], ' ') as s from d, unnest(range(1, len(w) - {REPEATED - 2})) t(i)),
f as (select s, min(doc_id) as first from g group by s),
r as (select doc_id, list(i) as starts from g join f using (s) where first < doc_id group by doc_id),
c as (select doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + {REPEATED})))) as gone from r),
k as (select d.doc_id, len(w) as n, list_filter(range(1, len(w) + 1), lambda i: gone is null or not list_contains(gone, i)) as keep, w from d left join c using (doc_id))
select doc_id, n as n_words, n - len(keep) as n_removed, sha256(coalesce(array_to_string(list_transform(keep, lambda i: w[i]), ' '), '')) as kept_sha256 from k"""


def _escaped(s: str) -> str:
    return f"replace(replace(replace(replace({s}, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>'), chr(10), '\\n')"


CHAT = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '{TRICKY}' union all select -7, 1, 'assistant', '{TRICKY}'),
m as (select *, contains(text, '{OPEN}') or contains(text, '</turn>') or contains(role, '{OPEN}') or contains(role, '</turn>') or contains(role, chr(10)) as hard from c),
r as (select *, case when hard then '{ESCAPED} ' || {_escaped('role')} || chr(10) || {_escaped('text')} else '{OPEN} ' || role || chr(10) || text end || '</turn>' || chr(10) as rendered from m)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text), '')) as loss_sha256,
  sum(length(rendered))::bigint as formatted_chars, sum(hard::int)::int as n_escaped, true as identical
from r group by conv_id"""

QUALITY = f"""
with d as (select doc_id, source, coalesce(text, '') as text, {_WORDS} as w from documents),
g as (select doc_id, i, count(*) over (partition by doc_id, s) as n from (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as s from d, unnest(range(1, len(w) - {WINDOW - 2})) t(i))),
p as (select doc_id, sum(least({WINDOW}, gap)) as n from (select doc_id, coalesce(lead(i) over (partition by doc_id order by i) - i, {WINDOW}) as gap from g where n > 1) group by doc_id),
m as (select d.doc_id, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{_SPLIT}', '', 'g')) > 0) as lines, coalesce(p.n, 0)::bigint as n_repeat_words from d left join p using (doc_id)),
b as (select *, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m),
h as (select source, count(*) as docs, sum(base_failed::int) as fails from b group by source),
o as (select sum(fails) / sum(docs) as mean, coalesce(var_samp(fails / docs), 0) as spread, avg(1 / docs) as inverse from h),
s as (select mean, least(greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * inverse, 1e-12) - 1, 1), 10000) as strength from o),
v as (select source, (fails + mean * strength) / (docs + strength) as rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= {HOST_LIMIT} as kept, round(rate, 6) as host_rate
from b join v on b.source is not distinct from v.source"""

COLLOCATIONS = f"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from (select lang, unnest(string_split_regex(text, '[.,;:!?\\n\\x0B\\x0C\\r]')) as piece from d)),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from p, unnest([1, 2, 3]) t(k), unnest(range(1, len(w) - k + 2)) u(i)),
f as (select lang, k, phrase, count(*) as a from g group by all),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1 and a >= {LEAST}),
s as (select c.lang, c.k, c.phrase, c.a, j, fl.a as l, fr.a as r, 1000000::hugeint * c.a * c.a // (fl.a::hugeint * fr.a) as score
  from c, unnest(range(1, c.k)) t(j) join f fl on fl.lang = c.lang and fl.phrase = array_to_string(c.w[1:j], ' ') and fl.k = j join f fr on fr.lang = c.lang and fr.phrase = array_to_string(c.w[j + 1:], ' ') and fr.k = c.k - j),
m as (select lang, k, phrase, a, min(row(score, j, l, r)) as x from s group by all),
i as (select lang, phrase, max(a) as most from (select lang, array_to_string(w[1:2], ' ') as phrase, a from c where k = 3 union all select lang, array_to_string(w[2:3], ' '), a from c where k = 3) group by all),
o as (select m.lang, m.phrase, m.a, x[3] as l, x[4] as r, x[1]::bigint as score from m left join i on m.k = 2 and i.lang = m.lang and i.phrase = m.phrase where most is null or 100 * most < {INSIDE_PERCENT} * m.a),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from o join n using (lang) qualify rank <= {TOP}"""


def _secrets() -> str:
    s = _s

    def q(x):
        return "'" + x.replace("'", "''") + "'"

    def matches(kind, pattern):
        pattern = q(pattern)
        gaps, hits = "string_split_regex(text, " + pattern + ")", f"regexp_extract_all(text, {pattern}, 0)"
        return (f"select r, {kind} as kind, hit as raw, {'value' if kind == 0 else 'hit'} as value, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as start, start + length(hit) as stop "
                f"from (select r, gaps, hits, unnest(hits) as hit, unnest({f'regexp_extract_all(text, {pattern}, 2)' if kind == 0 else 'hits'}) as value, unnest(range(1, len(hits) + 1)) as i from (select r, text, {gaps} as gaps, {hits} as hits from d where regexp_matches(text, {pattern})))")

    def there(e):
        return e.replace("regexp_like(", "regexp_matches(")

    value = "list_transform(range(1, length(sym) + 1), lambda i: (instr(" + s._by_encoding(lambda a: f"'{a}'") + ", sym[i]) - 1)::double)"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
base as (select r, kind, start, stop from ({matches(0, s.ASSIGN)}) where length(value) >= {s.LEAST_VALUE} union all select r, kind, start, stop from ({matches(1, s.ACCESS)}) union all select r, kind, start, stop from ({matches(2, s.HEX)})),
cand as (select * from ({matches(3, s.CANDIDATE)}) c where not exists (select 1 from base b where b.r = c.r and b.start < c.stop and c.start < b.stop)),
e1 as (select r, kind, start, stop, raw, {s.BODY} as body from cand),
e2 as (select *, {there(s.ENCODING)} as encoding from e1),
e3 as (select *, {s.SYMBOLS} as sym from e2 where encoding is not null),
e4 as (select *, length(sym)::double as n, {s.SIZE} as k, {s.SQUARES} as squares, {s.HALVES} as halves, {value} as v from e3),
e5 as (select *, {s.RUNS} as runs, {s.ONES} as ones, list_sum(v) as s, list_sum(list_transform(v, lambda x: x * x)) as q, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * v[(i % len(v)) + 1])) as m from e4 where n > 2),
e6 as (select *, {s.Z_CHI} as z_chi, {s.Z_RUNS} as z_runs, {s.Z_SERIAL} as z_serial from e5),
e7 as (select *, {s.FISHER} as half from e6), e8 as (select *, {s.P} as p, {s.LENGTH_CLASS} as length_class from e7), e9 as (select *, {s.BIN} as bin from e8),
c1 as (select encoding, length_class, bin, count(*) as c from e9 group by all),
c2 as (select *, sum(c) over (partition by encoding, length_class order by bin desc) as above, 2 * sum(case when bin >= {s.BINS // 2} then c else 0 end) over (partition by encoding, length_class) + 1 as random from c1),
c3 as (select encoding, length_class, min(bin) as least from c2 where greatest(above - random * (1 - bin / {s.BINS}.0e0), 0.0e0) / above <= {s.FALSE_SHARE} group by all),
a as (select r, kind, start, stop from base union all select r, kind, start, stop from e9 join c3 using (encoding, length_class) where bin >= least and p >= {s.FLOOR}),
t as (select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 3) as n_random,
  string_agg(span, ',' order by start, kind) filter (kind < 3) as base, string_agg(span, ',' order by start, kind) as spans from (select *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop as span from a) group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_random, 0) as n_random, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join t using (r)"""


def _lloyd() -> str:
    def distance(a, b):
        return f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))::bigint"

    parts = [
        f"v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) as x from embeddings where len(embedding) = {DIMS} and len(list_filter(embedding, lambda e: coalesce(isfinite(e), false))) = {DIMS})",
        f"c0 as (select row_number() over (order by h nulls last, x) - 1 as c, x as m from (select sha256('{SEED}:' || vec_id) as h, x from v) qualify c < {K})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} as (select r, any_value(vec_id) as vec_id, any_value(x) as x, min(row({distance('x', 'm')}, c)) as best from v, c{i} group by r)")
        if i < ROUNDS:
            parts.append(f"s{i} as (select best[2] as c, i, sum(x[i]) as s, count(*) as n from a{i}, range(1, {DIMS + 1}) t(i) group by 1, 2)")
            parts.append(f"n{i} as (select c, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as m from s{i} group by c)")
            parts.append(f"c{i + 1} as (select c, coalesce(n{i}.m, c{i}.m) as m from c{i} left join n{i} using (c))")
    return f"""
with {', '.join(parts)}
select vec_id, c::int as cluster, best[1]::bigint as distance, (sum(best[1]) over (partition by c))::bigint as cluster_inertia, (sum(best[1]) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} on c = best[2]"""


ORACLE_SQL = {"op4_substrings": SUBSTRINGS, "op7_chat": CHAT, "op9_quality": QUALITY, "op11_collocations": COLLOCATIONS, "op12_secrets": _secrets(), "op13_lloyd": _lloyd()}
