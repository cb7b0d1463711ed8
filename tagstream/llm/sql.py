"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op7_exact_duplicates"] = """
with d as (select doc_id, coalesce(text, '') as t from documents),
     g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from d join g using (t)
"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _level(above: str, name: str, keys: list[str], parent: list[str], weight: str) -> str:
    on = " and ".join(f"n.{k} = p.{k}" for k in parent)
    part = f"partition by {', '.join(parent)}" if parent else ""
    source = f"(select n.*, p.alloc as budget from n join {above} p on {on})" if parent else "(select n.*, b.budget from n, b)"
    return f"""
{name} as (
  with n as (select {', '.join(keys)}, sum(tokens) * 3 as cap, {weight} as w from leaves group by {', '.join(keys)}),
  o as (select *, cap / w as ratio,
          (budget - coalesce(sum(cap) over ({part} order by cap / w, {keys[-1]} rows between unbounded preceding and 1 preceding), 0))
          / sum(w) over ({part} order by cap / w, {keys[-1]} rows between current row and unbounded following) as level from {source}),
  t as (select *, max(case when level < ratio then level end) over ({part}) as top from o)
  select {', '.join(keys)}, case when top is null then cap::double else greatest(least(cap::double, top * w), 0) end as alloc from t)"""


ORACLE["op3_mixing"] = f"""
with d as (select doc_id, case when regexp_matches(source, '[02468]$') then 'web' else 'books' end as domain,
                  coalesce(lang, '') as lang, coalesce(source, '') as source, len({_WORDS})::bigint as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by all),
b as (select floor(sum(tokens) * 0.6)::double as budget from leaves),
{_level('', 'l1', ['domain'], [], "case domain when 'web' then 3.0 else 2.0 end::double")},
{_level('l1', 'l2', ['domain', 'lang'], ['domain'],
        "case when domain = 'web' and lang = 'en' then 4.0 when domain = 'web' and lang = 'de' then 2.0 when domain = 'books' and lang = 'en' then 2.0 else 1.0 end::double")},
{_level('l2', 'l3', ['domain', 'lang', 'source'], ['domain', 'lang'],
        "case when domain = 'web' and lang = 'en' and source = 'src0' then 2.0 else 1.0 end::double")},
q as (select domain, lang, source, floor(alloc)::bigint // greatest(tokens, 1) as f, floor(alloc)::bigint % greatest(tokens, 1) as rest
      from leaves join l3 using (domain, lang, source)),
p as (select d.*, f, rest, ('0x' || substr(md5('7:' || f || ':' || doc_id), 1, 13))::bigint as place from d join q using (domain, lang, source)),
s as (select *, sum(n_tokens) over (partition by domain, lang, source order by place) as upto from p)
select doc_id, e::int as epoch, domain, lang, source, n_tokens from p, range(0, 3) r(e) where e < f
union all
select doc_id, f::int as epoch, domain, lang, source, n_tokens from s where f < 3 and rest > 0 and upto <= rest
"""

ORACLE["op11_cap_duplicates"] = """
with recursive d as (
  select vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from d a join d b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
          where list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) as (select vec_id, vec_id from d union select r.a, l.b from reach r join links l on l.a = r.b),
component as (select a as vec_id, min(b) as component_id from reach group by a),
n as (select a as vec_id, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, coalesce(c.component_id, e.vec_id) as component_id,
       coalesce(c.component_id, e.vec_id) is not distinct from e.vec_id as kept
from embeddings e left join component c using (vec_id) left join n using (vec_id)
"""


def _paid(state: str, cost: str, letter: str) -> str:
    """A state's text, cost in nine digits and then the audit, with one more edit; a null state stays null."""
    return f"(lpad((left({state}, 9)::int + {cost})::varchar, 9, '0') || substr({state}, 10) || '{letter}')"


def _inserted(n0: str, n1: str, n2: str, n3: str) -> str:
    """The four states after rows inserted at will."""
    into_u = ", ".join(_paid(s, "2", "I") for s in (n0, n1, n3))
    into_a = ", ".join([_paid(n2, "2", "I"), _paid(n0, "4", "II"), _paid(n1, "4", "II")])
    return f"{n0} as s0, {n1} as s1, least({n2}, {into_u}) as s2, least({n3}, {into_a}) as s3"


def _kept(state: str, initial: str) -> str:
    return f"case when not gone and initial = '{initial}' then {_paid(state, 'cut', 'K')} end"


def _rerole(state: str) -> str:
    return f"case when not gone then {_paid(state, '(2 + cut)', 'R')} end"


_EDITED = f"""select conv, i,
  {_paid('s0', '3', 'D')} as n0,
  least({_paid('s1', '3', 'D')}, {_kept('s0', 's')}) as n1,
  least({_paid('s2', '3', 'D')}, {', '.join(_kept(s, 'u') for s in ('s0', 's1', 's3'))}, {', '.join(map(_rerole, ('s0', 's1', 's3')))}) as n2,
  least({_paid('s3', '3', 'D')}, {_kept('s2', 'a')}, {_rerole('s2')}) as n3
  from (select r.conv, f.i, r.s0, r.s1, r.s2, r.s3, f.initial, f.gone, f.cut from r join f on f.conv = r.conv and f.i = r.i + 1) x"""

ORACLE["op12_repair"] = rf"""
with recursive tab as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
                         lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
            lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::int + 1])), 4294967295) % 20 as kind from conversations, tab),
w as (select coalesce('v' || conv_id::varchar, 'n') as conv, turn, copy, case when kind = 4 then 'user' else role end as role,
        case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
      from k, range(2) c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
f0 as (select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as i, left(role, 1) as initial,
         not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
         row_number() over (partition by conv, role, text order by turn nulls first, copy) > 1 as again from w),
f as (select *, blank or again as gone, case when regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 0 else 1 end as cut,
        coalesce(lag(initial) over (partition by conv order by i) || initial, 'su') not in ('su', 'ua', 'au') as bad from f0),
totals as (select conv, count(*) as n, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (blank) as blank,
             count(*) filter (again and not blank) as duplicate, count(*) filter (not gone and cut = 1) as truncated, count(*) filter (bad) as illegal from f group by conv),
r as (select conv, 0 as i, {_inserted("'000000000'", "cast(null as varchar)", "cast(null as varchar)", "cast(null as varchar)")} from totals
      union all select conv, i, {_inserted('n0', 'n1', 'n2', 'n3')} from ({_EDITED}) y),
done as (select r.conv, left(least(s0, s3), 9)::bigint as cost, substr(least(s0, s3), 10) as audit from r join totals t on t.conv = r.conv and t.n = r.i),
letters as (select conv, p, audit[p] as edit from done, range(1, len(audit) + 1) q(p)),
placed as (select *, count(*) filter (edit <> 'I') over (partition by conv order by p) as i,
             count(*) filter (edit <> 'D') over (partition by conv order by p) as pos from letters),
lines as (select a.conv, a.p, a.pos, a.edit, case when edit <> 'I' then f.role end as own, case when edit = 'I' then '' else f.text end as text
          from placed a left join f on f.conv = a.conv and f.i = a.i and a.edit <> 'I' where a.edit <> 'D'),
shift as (select conv, case when edit = 'K' and left(own, 1) = 's' then 1 else 0 end as off from lines where pos = 1),
said as (select l.conv, sha256(string_agg(case when edit = 'K' then own when (pos - off) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by p)) as h
         from lines l join shift s using (conv) group by l.conv)
select c.conv_id, coalesce(t.gaps, 0)::bigint as gaps, coalesce(t.blank, 0)::bigint as blank, coalesce(t.duplicate, 0)::bigint as duplicate,
       coalesce(t.truncated, 0)::bigint as truncated, coalesce(t.illegal, 0)::bigint as illegal, coalesce(d.cost, 0)::bigint as cost,
       coalesce(d.audit, '') as audit, coalesce(s.h, sha256('')) as repaired_sha256
from (select distinct conv_id, coalesce('v' || conv_id::varchar, 'n') as conv from conversations) c
left join totals t using (conv) left join done d using (conv) left join said s using (conv)
"""

ORACLE["op13_hard_negatives"] = """
with d as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor(256 * x::double)) as q
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id as other, b.label, list_inner_product(a.q, b.q)::bigint as score
      from d a join d b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (select anchor_id, own, other as positive_id, score as positive_score from s where label = own
      qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select p.anchor_id, p.positive_id, p.positive_score, s.other as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as rank
      from p join s on s.anchor_id = p.anchor_id and s.label <> p.own and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
