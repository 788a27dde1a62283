"""DuckDB SQL for operators of this subpackage, stated from their contracts."""

from __future__ import annotations

from flowloom.llm.url_filter import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _small(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


OP1_SQL = rf"""with recursive d as (select row_number() over () r, doc_id, regexp_extract_all({_small("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct r, g from (select r, unnest(case when len(w) >= 5 then [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d)),
n as (select r, count(*) n from s group by r),
p as (select a.r x, b.r y, count(*) c from s a join s b on a.g = b.g and a.r < b.r group by all),
l as (select x, y from p join n a on a.r = x join n b on b.r = y where 100 * c >= 80 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
c as (select r, r t from d union select c.r, e.y from c join e on e.x = c.t)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.least component_id from d left join n using (r) join (select c.r, min(o.doc_id) least from c join d o on o.r = c.t group by c.r) m using (r)"""

# The pages of the tables declare no aliases, so the rules alone decide.
_FITS = "".join(f" when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])))
OP4_SQL = f"""with a as (select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3 :] else '' end t from pages),
b as (select page_id, coalesce(t, '') t, regexp_extract(coalesce(t, ''), '^[^/?#]*') h from a),
c as (select page_id, {_small("h")} host, regexp_extract(t[length(h) + 1 :], '^[^?#]*') path from b),
f as (select *, case{_FITS} end f from c)
select page_id, host, path, string_split(f, ' ')[2] rule, coalesce(string_split(f, ' ')[1], 'allow') verdict from f"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP8_SQL = f"""with d as (select row_number() over () r, doc_id, regexp_extract_all({_small("coalesce(text, '')")}, {_WORDS}) w from documents),
b as (select item_id::varchar item, regexp_extract_all({_small("text")}, {_WORDS}) w from benchmark where item_id is not null and text is not null),
v as (select item, least(13, len(w)) n, unnest([array_to_string(w[i : i + least(13, len(w)) - 1], ' ') for i in range(1, greatest(1, len(w) - 12) + 1)]) k from b where len(w) > 0),
z as (select distinct n from v),
g as (select r, n, unnest(range(1, len(w) - n + 2)) i from d, z where len(w) >= n),
h as (select g.r, g.i, g.n, v.item from g join d using (r) join v on v.n = g.n and v.k = array_to_string(d.w[g.i : g.i + g.n - 1], ' ')),
c as (select r, count(distinct x) hit from (select r, unnest(range(i, i + n)) x from h) group by r),
t as (select r, count(*) items, string_agg(item, ',' order by item) listed from (select distinct r, item from h) group by r)
select doc_id, len(w)::bigint n_words, coalesce(hit, 0)::bigint n_hit, coalesce(items, 0)::bigint n_items, sha256(coalesce(listed, '')) items_sha256, coalesce(hit, 0) > 0 and 20 * coalesce(hit, 0) >= len(w) contaminated
from d left join c using (r) left join t using (r)"""

OP10_SQL = """with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select r, doc_id, unnest(range(0, length(h) // 2 - 49)) i, h from d where doc_id is not null and length(h) >= 100),
k as (select r, doc_id, i, md5(h[2 * i + 1 : 2 * i + 100]) s from w),
m as (select s, min(doc_id) least from k group by s),
u as (select r, i, i - coalesce(lag(i) over (partition by r order by i), -1000) > 50 fresh from k join m using (s) where doc_id > least),
g as (select *, sum(fresh::int) over (partition by r order by i) span from u),
p as (select r, span, min(i) a, max(i) + 50 b from g group by r, span),
q as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) before from p),
x as (select q.r, count(*) n_spans, sum(b - a) n_removed, max(b) last, string_agg(h[2 * before + 1 : 2 * a], '' order by a) kept from q join d using (r) group by q.r)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(case when x.r is null then h else kept || h[2 * last + 1 :] end)) kept_sha256 from d left join x using (r)"""
