"""DuckDB statements of the subpackage's queries, written from the contracts."""

from __future__ import annotations

from strom.llm import licenses, secrets

ORACLES: dict[str, str] = {}

ORACLES["op6_exact_dedup"] = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = first_value(doc_id) over w as kept, sha256(norm) as text_sha256
from d window w as (partition by norm order by length(t) desc, doc_id)"""

ORACLES["op7_mixing"] = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':7'), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from d group by source),
o as (
  select *, 1.5::double * (sum(source_size) over ())::double as whole,
         sum(weight) over () - coalesce(sum(weight) over b, 0) as rest, 2.0::double * coalesce(sum(source_size) over b, 0)::double as full_before
  from s window b as (order by source_size::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, (whole - full_before) * weight >= 2.0::double * source_size * rest as is_full from o),
t as (
  select source, source_size,
         case when is_full then 2.0::double * source_size
              else (whole - 2.0::double * (sum(case when is_full then source_size else 0 end) over ())::double) * weight
                   / sum(case when is_full then 0.0::double else weight end) over () end as target
  from f),
b as (select source, length(bin(size)) as appeal, sum(size)::bigint as words from d group by all),
c as (
  select b.*, target, source_size,
         (sum(appeal * words) over (partition by b.source) - coalesce(sum(appeal * words) over k, 0))::double as rest,
         2.0::double * coalesce(sum(words) over k, 0)::double as full_before
  from b join t on b.source is not distinct from t.source
  window k as (partition by b.source order by appeal desc rows between unbounded preceding and 1 preceding)),
g as (select *, (target - full_before) * appeal >= 2.0::double * rest as is_full from c),
e as (
  select *, least(2.0::double, greatest(0.0::double, case when is_full then 2.0::double
         else (target - 2.0::double * (sum(case when is_full then words else 0 end) over (partition by source))::double) * appeal
              / (sum(case when is_full then 0 else appeal * words end) over (partition by source))::double end)) as copies
  from g),
p as (
  select *, floor(copies)::bigint as sure, copies - floor(copies) as odds,
         target - (sum(floor(copies)::bigint * words) over (partition by source))::double as wanted from e),
r as (
  select d.doc_id, d.source, d.size, p.source_size, p.target, p.sure, p.wanted,
         case when p.odds > 0 and d.size > 0 then
           floor(((d.u / (1 - d.u)) / (p.odds / (1 - p.odds))) / (1 + (d.u / (1 - d.u)) / (p.odds / (1 - p.odds))) * 1099511627776.0::double)::bigint end as rank
  from d join p on d.source is not distinct from p.source and length(bin(d.size)) = p.appeal),
x as (
  select *, sum(case when rank is not null then size else 0 end) over (partition by source order by rank nulls last, doc_id nulls last, size rows between unbounded preceding and current row)
            - size / 2.0::double <= wanted and rank is not null as drawn
  from r)
select doc_id, size, source_size, target, (case when size > 0 then (sure + drawn::int) * size else 0 end)::bigint as taken from x"""

_ESCAPE = r"""regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"""
ORACLES["op8_chat"] = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text), '')) as loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || {_ESCAPE.format('text')} || '<|im_end|>' || chr(10)))::bigint as formatted_chars
from c group by conv_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NINE = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op9_decontaminate"] = f"""
with d as materialized (select doc_id, {_NINE} as w from documents),
b as materialized (select item_id, {_NINE} as w from benchmark),
bw as materialized (
  select distinct item_id, array_to_string(list_slice(w, i::bigint, (i + least(13, len(w)) - 1)::bigint), ' ') as phrase, least(13, len(w)) as n
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from b where len(w) > 0)),
lengths as (select distinct n from bw),
dw as materialized (
  select doc_id, i, n, array_to_string(list_slice(w, i::bigint, (i + n - 1)::bigint), ' ') as phrase
  from (select doc_id, w, unnest(generate_series(1, len(w))) as i from d where len(w) > 0), lengths where i + n - 1 <= len(w)),
m as materialized (select doc_id, item_id, i, dw.n from dw join bw on dw.phrase = bw.phrase and dw.n = bw.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from m) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from m) group by doc_id),
terms as (select item_id, t, min(i) as first from (select item_id, unnest(w) as t, unnest(generate_series(1, len(w))) as i from b) group by item_id, t),
postings as materialized (
  select doc_id, t, i from (select doc_id, unnest(w) as t, unnest(generate_series(1, len(w))) as i from d) where t in (select t from terms)),
ranked as (
  select item_id, t, row_number() over (partition by item_id order by n, first) as k
  from terms join (select t, count(*) as n from postings group by t) using (t)),
rare as materialized (select item_id, t, k from ranked where k <= 4),
together as (
  select p.doc_id, r.item_id, p.i
  from rare r join postings p on p.t = r.t join rare o on o.item_id = r.item_id and o.k > 1
  join postings q on q.t = o.t and q.doc_id = p.doc_id and q.i between p.i - 40 and p.i + 40
  where r.k = 1 group by p.doc_id, r.item_id, p.i having count(distinct o.k) = 3),
near as (select doc_id, count(*) as n_near, string_agg(item_id, ',' order by item_id) as near_ids from (select distinct doc_id, item_id::varchar as item_id from together) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
       coalesce(n_near, 0)::bigint as n_near, sha256(coalesce(near_ids, '')) as near_sha256
from d left join hit using (doc_id) left join items using (doc_id) left join near using (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_oracle() -> str:
    kinds = []
    for i, rule in enumerate(secrets.RULES):
        pattern = _quoted(rule.pattern)
        kinds.append(f"""
  select doc_id, {i} as kind, '{rule.kind}' as name, k,
         list_sum(list_transform(list_slice(parts, 1, k), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(hits, 1, k - 1), lambda x: length(x))), 0) as s,
         length(hits[k]) as n, length(vals[k]) as m, {rule.least} as least
  from (select doc_id, parts, hits, vals, unnest(generate_series(1, len(hits))) as k
        from (select doc_id, string_split_regex(t, {pattern}) as parts, regexp_extract_all(t, {pattern}) as hits, regexp_extract_all(t, {pattern}, {rule.group}) as vals from d)
        where len(hits) > 0)""")
    base = len(secrets.BASE_RULES)
    counts = ", ".join(f"coalesce(sum((kind = {i})::int), 0)::bigint as n_{r.kind}" for i, r in enumerate(secrets.BASE_RULES))
    told = "name || ':' || s::bigint || ':' || (s + n)::bigint"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as (select * from ({" union all ".join(kinds)}) where m >= least)
select d.doc_id, {counts},
       sha256(coalesce(string_agg(case when kind < {base} then {told} end, ',' order by s, kind, n), '')) as base_sha256,
       coalesce(string_agg({told}, ',' order by s, kind, n), '') as spans
from d left join f using (doc_id) group by d.doc_id"""


ORACLES["op10_secrets"] = _secret_oracle()


def _license_oracle(least: float = 0.8) -> str:
    notices = ", ".join(f"({_quoted(n)}, [{', '.join(map(_quoted, licenses.bigrams_of(t)))}])" for n, t in sorted(licenses.NOTICES.items()))
    return rf"""
with notice(license, own) as (values {notices}),
d as (select doc_id, coalesce(text, '') as t from documents),
passages as (
  select doc_id, unnest(string_split(t, chr(10))) as p from d
  union all select doc_id, p from (select doc_id, unnest(string_split_regex(t, '\n[\x20\t\r]*\n')) as p from d) where contains(p, chr(10))),
words as (select doc_id, row_number() over () as k, list_filter(string_split(lower(regexp_replace(p, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') as w from passages),
bags as (select doc_id, k, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) as bag from words where len(w) >= 2),
m as (
  select doc_id, license, 2.0::double * len(list_intersect(bag, own)) / (len(bag) + len(own)) as dice from bags, notice
  where len(list_intersect(bag, own)) > 0),
best as (
  select doc_id, count(*) as n, arg_min(license, (-dice, license)) as best_license, max(dice) as best_dice, string_agg(distinct license, ',' order by license) as licenses
  from m where dice >= {least} - 1e-12 group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_matches, best_license, round(best_dice, 6) as best_dice, coalesce(licenses, '') as licenses
from d left join best using (doc_id)"""


ORACLES["op4_license"] = _license_oracle()


def _vector_oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every vector against every entry, round by round; one row per component."""
    def nearest(k: int) -> str:
        return f"""
n{k} as materialized (
  select r, part, min(away) as least from (
    select x.r, x.part, sum((x.x - b.x) * (x.x - b.x)) * {entries} + b.entry as away from x join b{k} b on x.part = b.part and x.pos = b.pos group by x.r, x.part, b.entry)
  group by r, part)"""

    def moved(k: int) -> str:
        return f"""
b{k + 1} as materialized (
  select b.part, b.entry, b.pos, coalesce(m.x, b.x) as x
  from b{k} b left join (
    select part, entry, pos, ((s - ((s % n) + n) % n) // n)::bigint as x
    from (select x.part, n.least % {entries} as entry, x.pos, sum(x.x) as s, count(*) as n from x join n{k} n on x.r = n.r and x.part = n.part group by all)) m
  on b.part = m.part and b.entry = m.entry and b.pos = m.pos)"""

    steps = "".join(f",{nearest(k)},{moved(k)}" for k in range(rounds)) + f",{nearest(rounds)}"
    return f"""
with kept as (
  select row_number() over (order by vec_id) as r, vec_id, label, embedding as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
x as materialized (
  select r, (i - 1) // (len(v) // {parts}) as part, (i - 1) % (len(v) // {parts}) as pos, floor(v[i]::double * 4096)::bigint as x
  from (select r, v, unnest(generate_series(1, len(v))) as i from kept)),
b0 as materialized (select x.part, x.r - 1 as entry, x.pos, x.x as x from x where r <= {entries}){steps},
coded as (
  select kept.vec_id, kept.label, string_agg(lpad(lower(hex(least % {entries})), 2, '0'), '' order by part) as code, sum(least // {entries})::bigint as error
  from n{rounds} n join kept using (r) group by kept.r, kept.vec_id, kept.label)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) from b{rounds}) as codebooks_sha256
from coded"""


ORACLES["op12_vector_codes"] = _vector_oracle()
