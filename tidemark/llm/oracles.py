"""SQL of the license, quality, divergence and hard-negative queries for DuckDB, written from their contracts and the parameters of the operators."""

from __future__ import annotations

from . import divergence as dv
from . import licenses as li
from . import quality as qu
from .common import LOWER, UPPER

_SPACE = r"[\x20\x09-\x0D]"


def quality() -> str:
    def count(pattern: str) -> str:
        return f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"

    classes = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": r"[#*$%&|<>]", "punct": r"[!\"''()+,\-./:;=?@\[\\\]^_`{}~]", "other": r"[^\x09-\x0D\x20-\x7E]"}
    chars = [f"c_{c}" for c in qu.CLASSES]

    def distance(names: list[str]) -> str:
        p, q = (f"({' + '.join(f'{t}.{n}' for n in names)})" for t in ("s", "r"))
        terms = []
        for n in names:
            a, b = f"(s.{n}::double / {p})", f"(r.{n}::double / {q})"
            terms += [f"case when {x} > 0 then {x} * log2({x} / (({a} + {b}) / 2)) else 0 end" for x in (a, b)]
        return f"case when {p} > 0 and {q} > 0 then sqrt(greatest(({' + '.join(terms)}) / 2, 0)) end"

    def part(a: str) -> str:
        return f"case when {a} > 0 then {a} * log2({a} / ((p + q) / 2)) else 0 end"

    sums = ", ".join(f"sum({n}) as {n}" for n in chars)
    return rf"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
i as (select rid, w, unnest(range(1, len(w) - 1)) as i from w),
g as (select rid, i, count(*) over (partition by rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as k from i),
rep as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2]) as j from g where k > 1) group by rid),
m as (select rid, doc_id, lang, len(w)::bigint as n_words, length(text) - ({count(_SPACE)}) as word_chars, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, length(text) as n_all,
             {count(_SPACE)} as c_space, {', '.join(f'{count(p)} as c_{c}' for c, p in classes.items())}
      from d join w using (rid) left join rep using (rid)),
s as (select *, c_symbol as n_symbols, n_all - c_space - c_symbol - c_upper - c_digit - c_punct - c_other as c_lower,
             n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
runs as (select rid, lang, regexp_extract_all(lower(text), '{qu.LETTERS}') as runs from d where lang is not null),
u as (select rid, lang, unnest(runs) as word from runs),
vn as (select lang, word, count(distinct rid) as n from u where length(word) <= {qu.MAX_WORD} group by lang, word),
v as (select lang, word, row_number() over (partition by lang order by n desc, word) as k from vn qualify k <= {qu.N_COMMON}),
kn as (select rid, k, count(*) as n from u join v using (lang, word) group by rid, k),
hist as (select rid, k, n from kn union all select rid, 0, len(runs) - coalesce(seen, 0) from runs left join (select rid, sum(n) as seen from kn group by rid) using (rid)),
rn as (select lang, k, sum(n) as n from hist join s using (rid) where not base_failed group by lang, k),
rk as (select lang, k, n / sum(n) over (partition by lang) as q from rn qualify sum(n) over (partition by lang) > 0),
tot as (select rid, lang, len(runs) as n from runs where len(runs) > 0 and lang in (select lang from v)),
pq as (select tot.rid, tot.n, coalesce(h.n, 0) / tot.n::double as p, coalesce(q, 0) as q from tot join rk using (lang) left join hist h on h.rid = tot.rid and h.k = rk.k
       union all select tot.rid, tot.n, h.n / tot.n::double, 0 from tot join hist h using (rid) where exists (from rk where rk.lang = tot.lang) and not exists (from rk where rk.lang = tot.lang and rk.k = h.k)),
jw as (select rid, n, sqrt(greatest(sum({part('p')} + {part('q')}) / 2, 0)) as wd from pq group by rid, n),
r as (select lang, {sums} from s where not base_failed and lang is not null group by lang union all select null, {', '.join(f'sum({n})' for n in chars)} from s where not base_failed),
e as (select s.*, {distance(chars)} as cd, wd, wd * sqrt(n) as wz from s left join r on s.lang is not distinct from r.lang left join jw using (rid)),
mid as (select lang, quantile_cont(round(cd, 4), {qu.QUANTILE}) filter (n_all >= {qu.MIN_CHARS}) as cm, quantile_cont(least(round(wz, 2), {qu.MAX_SCALED}), {qu.QUANTILE}) filter (n_words >= {qu.MIN_WORDS}) as wm
        from e where not base_failed group by lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or coalesce(n_all >= {qu.MIN_CHARS} and cd > greatest({qu.CLASS_FLOOR}, {qu.CLASS_FACTOR} * cm), false)
            or coalesce(n_words >= {qu.MIN_WORDS} and wd > {qu.WORD_FLOOR} and wz > {qu.WORD_FACTOR} * wm, false)) as kept,
       round(cd, 6) + 0.0 as char_distance, round(wd, 6) + 0.0 as word_distance from e left join mid on e.lang is not distinct from mid.lang
"""


def licenses() -> str:
    rows = [(i, t, label, i < len(li.PHRASES)) for i, (t, label) in enumerate([*li.PHRASES, *li.NOTICES])]
    values = ", ".join(f"({i}, '{t}', '{label}', {str(base).lower()}, {li.SHORT if base else li.LONG})" for i, t, label, base in rows)
    return rf"""
with tpl(template, text, label, base, k) as (values {values}),
tw as (select *, string_split(text, ' ') as w, len(string_split(text, ' ')) - k + 1 as n from tpl),
tg as (select template, label, base, k, n, i - 1 as tpos, array_to_string(w[i:i + k - 1], ' ') as gram from (select *, unnest(range(1, n + 1)) as i from tw)),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (values ({li.SHORT}), ({li.LONG})) v(k)),
h as (select distinct rid, template, label, base, n, i - 1 - tpos as diagonal, tpos from p join tg on tg.k = p.k and tg.gram = array_to_string(w[i:i + p.k - 1], ' ')),
x as (select *, (lag(diagonal) over q is null or diagonal - lag(diagonal) over q > case when base then 0 else {li.NEAR} end)::int as fresh from h window q as (partition by rid, template order by diagonal, tpos)),
y as (select *, sum(fresh) over (partition by rid, template order by diagonal, tpos rows unbounded preceding) as span from x),
z as (select rid, template, label, base, n, span, count(distinct tpos) as votes, min(diagonal) as place, max(diagonal + tpos) - min(diagonal + tpos) + 1 as length from y group by rid, template, label, base, n, span),
f as (select *, least(votes / n::double, 1) as share from z where case when base then votes = n else votes / n::double >= {li.COVER} and length <= 2 * n end),
per as (select rid, count(*) filter (base) as n_base, min(place) filter (base) as first_word, max(place) filter (base) as last_word,
               coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from f group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score from d left join per using (rid)
"""


def divergence() -> str:
    def share(n: str, whole: str) -> str:
        return f"(1 + (1000000000::hugeint * ({n} + 1)) // ({whole}))"

    f = "((p - q) * (p - q)) // q"
    return rf"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{dv.TERM}') as w from documents),
t as (select rid, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as total from t group by lang, term having count(distinct rid) >= {dv.MIN_DOCS}),
c as (select t.lang, source, term, count(*) as n from t join kept using (lang, term) group by t.lang, source, term),
g as (select distinct lang, source from d),
l as (select lang, count(*) as v, sum(total) as nl from kept group by lang),
s as (select lang, source, coalesce(u.n, 0) as ng, coalesce(v, 0) as v, nl from g left join (select lang, source, sum(n) as n from c group by lang, source) u using (lang, source) left join l using (lang)),
p as (select s.lang, s.source, term, coalesce(c.n, 0) as n, {share('coalesce(c.n, 0)', 'ng + v')} as p, {share('total', 'nl + v')} as ql from s join kept using (lang) left join c using (lang, source, term)),
pv as (select a.lang, a.source, b.source as item, sum({f}) as value from (select lang, source, term, p from p) a join (select lang, source, term, p as q from p) b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pa as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
te as (select lang, source, term as item, ({f.replace('q', 'ql')})::bigint as value from p where n > 0 and p > ql),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pa
      union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from te)
select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= {dv.TOP}
"""


def negatives() -> str:
    return """
with e as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as a, b.id as b, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.id % 100 = 0 and a.id <> b.id),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.b as pos, p.score as ps, s.b as neg, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
      from p join s on p.a = s.a and not same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select a as anchor_id, pos as positive_id, rank::int as rank, neg as negative_id, ps as positive_score, ns as negative_score from n where rank <= 10
"""
