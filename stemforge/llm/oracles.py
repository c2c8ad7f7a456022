"""DuckDB SQL for the queries of this package that SQL can express."""

MIXING = """
with recursive sizes as (select source, sum(strlen(coalesce(text, ''))) as size, count(*) as documents from documents group by 1),
raws as (select *, pow(size::double, 0.5) as raw from sizes),
rates as (select source, case when size > 0 then raw / (select sum(raw) from raws) * (select sum(size) from raws)::double / size else 1.0 end as rate from raws),
means as (select source, greatest(1, ceil(rate / 32))::bigint as draws, rate / greatest(1.0::double, ceil(rate / 32)) as mean from rates),
cdf(source, mean, k, p, cdf) as (
  select source, mean, 0, exp(-mean), exp(-mean) from means
  union all select source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) from cdf where k < ceil(mean + 10 * sqrt(mean) + 12)),
docs as (select doc_id, source, coalesce(text, '') as text, text as raw_text, coalesce(doc_id::varchar, 'null') as id from documents),
tried as (select d.*, md5(text) as digest, unnest(range(m.draws)) as j, d.row from (select *, row_number() over () as row from docs) d join means m on m.source is not distinct from d.source),
drawn as (select *, (('0x' || substr(md5(id || '|' || digest || '|copies0' || case when j > 0 then ':' || j else '' end), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u from tried),
counted as (select doc_id, source, raw_text, id, digest, sum((select count(*) from cdf c where c.source is not distinct from d.source and c.cdf <= d.u))::bigint as copies from drawn d group by row, doc_id, source, raw_text, id, digest),
copied as (select *, unnest(range(1, copies + 1)) as copy from counted)
select doc_id, source, copy, ('0x' || substr(md5(id || '|' || digest || '|' || copy || '|order0'), 1, 15))::bigint as shuffle_key, length(raw_text) as n_chars, case when raw_text is not null then digest end as text_md5 from copied
"""

TOPK = """
with v as (select row_number() over () as number, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.number, q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.number <> c.number where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by number order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""

CHAT = """
with recursive c as (select conv_id, turn, case role when 'system' then 'configure' else 'answer' end as name, text, role = 'system' and length(text) % 3 = 0 as waits from conversations where role in ('system', 'user')),
a as (select conv_id, turn - 1 as turn, turn as own_turn, text from conversations where role not in ('system', 'user') or role is null),
named as (select conv_id, turn, unnest(case when waits then [turn - 1, turn - 2, turn + 1] else [turn - 1, turn - 2] end) as dep from c),
deps as (select n.conv_id, n.turn, n.dep from named n semi join c on c.conv_id = n.conv_id and c.turn = n.dep),
reach(conv_id, a, b) as (select conv_id, turn, dep from deps union select r.conv_id, r.a, d.dep from reach r join deps d on d.conv_id = r.conv_id and d.turn = r.b),
blocked as (select distinct r.conv_id, r.a as turn from reach r semi join reach k on k.conv_id = r.conv_id and k.a = k.b and k.a in (r.a, r.b)),
lv(conv_id, turn, level) as (
  select conv_id, turn, 0 from c anti join deps using (conv_id, turn)
  union select d.conv_id, d.turn, lv.level + 1 from lv join (select * from deps anti join blocked using (conv_id, turn)) d on d.conv_id = lv.conv_id and d.dep = lv.turn),
levels as (select conv_id, turn, max(level)::int as level from lv group by all),
stray as (select n.conv_id, n.turn, list_sort(list(n.conv_id || ':' || n.dep)) as unknown from named n anti join c d on d.conv_id = n.conv_id and d.turn = n.dep group by 1, 2),
checked as (select *, list_sort(list_concat(
    case when name = 'answer' and length(text) > 200 then ['text is longer than 200'] when name = 'configure' and text = '' then ['text is shorter than 1'] else [] end,
    list_transform(list_filter(range(len(words)), lambda i: length(words[i + 1]) > 20), lambda i: 'words[' || i || '] is longer than 20'))) as errors
  from (select *, string_split(text, ' ') as words from c)),
rows as (
  select c.conv_id, c.turn, c.conv_id || ':' || c.turn as call_id, c.name, l.level,
    case when b.turn is not null then 'circle' when len(c.errors) > 0 then 'invalid' when a.turn is null then 'unanswered' else 'ok' end as status,
    {'text': c.text, 'turn': c.turn, 'words': c.words} as arguments,
    list_transform(case when c.waits then [c.turn - 1, c.turn - 2, c.turn + 1] else [c.turn - 1, c.turn - 2] end, lambda x: c.conv_id || ':' || x) as depends_on, c.errors,
    (case when a.turn is null then 0 else 1 end)::bigint as n_results, a.text as result,
    coalesce(s.unknown, []) as unknown
  from checked c left join levels l using (conv_id, turn) left join blocked b using (conv_id, turn) left join stray s using (conv_id, turn) left join a on a.conv_id = c.conv_id and a.turn = c.turn
  union all
  select a.conv_id, a.own_turn, a.conv_id || ':' || a.turn, null, null, 'orphan result', null, [], [], 1, a.text, [] from a anti join c using (conv_id, turn))
select conv_id, call_id, turn, name, level, status,
  to_json({'arguments': arguments, 'call_id': call_id, 'conv_id': conv_id, 'depends_on': depends_on, 'errors': errors, 'level': level, 'n_results': n_results,
    'name': name, 'raw': null, 'result': result, 'status': status, 'turn': turn, 'unknown': unknown})::varchar as line from rows
"""

FILTER_AUDIT = r"""
with docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
worded as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from docs),
checked as (select doc_id, part, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
    coalesce(min(doc_id) over (partition by text) < doc_id, false) as e from worded),
known as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels where doc_id is not null group by 1),
labelled as (select c.*, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from checked c left join known using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select p.x || q.x || r.x || s.x || t.x as o from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
cells as (select part, (case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end) as failing,
  count(*) as n, sum(good) as good, sum(toxic) as toxic from labelled group by 1, 2),
placed as (select part, o as filter_order, i::int as step, failing, n, good, toxic, o[i] as letter, contains(failing, o[i]) as fails,
  len(list_filter(string_split(failing, ''), lambda f: f <> '' and contains(left(o, i - 1), f))) > 0 as gone from cells, orders, unnest(range(1, 6)) as u(i)),
counts as (select part, filter_order, step, letter,
  sum(case when not fails and not gone then n else 0 end)::bigint as kept, sum(case when fails and not gone then n else 0 end)::bigint as removed,
  sum(case when fails and gone then n else 0 end)::bigint as redundant, sum(case when failing = letter then n else 0 end)::bigint as unique_fails,
  sum(case when fails and not gone then good else 0 end)::bigint as good_lost, sum(case when fails and not gone then toxic else 0 end)::bigint as toxic_lost from placed group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from counts
"""
