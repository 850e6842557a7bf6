"""DuckDB SQL of the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP1 = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
n as (select doc_id, cast(len(s) as bigint) as n from s),
x as (select doc_id, unnest(s) as g from s),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from o join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b),
c as (select a as doc_id, min(b) as component_id from r group by a),
d as (select a as doc_id, count(*) as links from e group by a)
select n.doc_id, n.n as n_shingles, c.component_id, n.doc_id = c.component_id as kept from n join c using (doc_id)
"""

#: CRC-32 byte by byte and bit by bit, and the jumps of the generator modulo 2**64 up to 25 shards.
OP2 = """
with recursive d as (select doc_id, cast(strlen(coalesce(text, '')) as bigint) + 8 as size, list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: cast(strpos('0123456789ABCDEF', c) - 1 as bigint)) as x from documents),
y as (select doc_id, size, list_transform(range(1, (size - 8) + 1), lambda i: x[2 * i] + 16 * x[2 * i - 1]) as y from d),
c as (select doc_id, size, case when size = 8 then cast(0 as bigint) else xor(list_reduce(y, lambda c, b: xor(c >> 8, list_reduce(range(8), lambda z, k: case when z & 1 = 1 then xor(z >> 1, 3988292384) else z >> 1 end, xor(c, b) & 255)), cast(4294967295 as bigint)), cast(4294967295 as bigint)) end as crc from y),
j as (select doc_id, 0 as step, (cast(doc_id as hugeint) * 2862933555777941757 + 1) % 18446744073709551616 as k, cast(0 as bigint) as j, cast(-1 as bigint) as b, cast(-1 as bigint) as g from documents
  union all select doc_id, step + 1, (k * 2862933555777941757 + 1) % 18446744073709551616, cast(floor((j + 1) * (cast(2147483648 as double) / (cast(k // 8589934592 as double) + 1))) as bigint), case when j < 24 then j else b end, j from j where j < 25),
s as (select doc_id, cast(arg_max(b, step) as integer) as shard, cast(arg_max(g, step) as integer) as grown_shard from j group by doc_id)
select doc_id, size, crc as text_crc32, 'key' as law, shard, row_number() over (partition by shard order by (doc_id % 256 + crc % 256) % 256, doc_id, crc, size) - 1 as slot, grown_shard from c join s using (doc_id)
"""

_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Of the places in {a}, those with the window's word of rank {r} at most two places off its own.
_NEAR = """{b} as (select distinct c.g, c.n, c.doc_id, c.s from {a} c join an a on a.g = c.g and a.r = {r} join (select unnest(range(-2, 3)) as d) q on true
  join dp p on p.doc_id = c.doc_id and p.pos = c.s + a.o + q.d and p.x = a.x union select * from {a} where n < {r})"""

OP3 = f"""
with i as (select item_id, {_WORDS} as w from benchmark), d as (select doc_id, {_WORDS} as w from documents),
p as (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0),
v as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as g from p),
z as (select distinct n from v),
t as (select doc_id, z.n, w, unnest(range(1, len(w) - z.n + 2)) as s from d, z where len(w) >= z.n),
m as (select t.doc_id, t.s, t.n, v.g, v.item_id from t join v on v.n = t.n and v.g = array_to_string(t.w[t.s:t.s + t.n - 1], ' ')),
h as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from m) group by doc_id),
k as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from m) group by doc_id),
dp as (select doc_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as x from d),
fr as (select x, count(*) as f from dp group by x),
wo as (select g, n, unnest(range(0, n)) as o, unnest(string_split(g, ' ')) as x from (select distinct g, n from v)),
ra as (select wo.*, row_number() over (partition by g order by f, o) as r, count(f) over (partition by g) as known from wo left join fr using (x)),
an as (select * from ra where known = n and r <= 3),
c1 as (select a.g, a.n, p.doc_id, p.pos - a.o as s from an a join dp p on p.x = a.x where a.r = 1),
{_NEAR.format(a="c1", b="c2", r=2)},
{_NEAR.format(a="c2", b="c3", r=3)},
nr as (select doc_id, count(*) as n_near from c3 anti join (select distinct doc_id, s, g from m) using (doc_id, s, g) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(k.n_items, 0) as n_items, sha256(coalesce(k.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated, coalesce(nr.n_near, 0) as n_near
from d left join h using (doc_id) left join k using (doc_id) left join nr using (doc_id)
"""

_KEYS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The base patterns of secrets as (kind, pattern, group of the value, its least length). Runs are maximal, so their least length may stand in the pattern.
_SECRETS = (("assign", f"({_KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
#: Matches m and what stands between them, g, give each match's place.
_FOUND = """{kind}_m as (select doc_id, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g from d),
{kind}_s as (select doc_id, unnest(m) as x, unnest(list_transform(range(1, len(m) + 1), lambda i: cast(list_sum(list_transform(g[1:i], lambda y: length(y))) as bigint) + coalesce(cast(list_sum(list_transform(m[1:i - 1], lambda y: length(y))) as bigint), 0))) as a from {kind}_m where len(m) > 0),
{kind} as (select doc_id, '{kind}' as kind, a, a + length(x) as b, regexp_extract(x, '{pattern}', {group}) as v from {kind}_s where length(regexp_extract(x, '{pattern}', {group})) >= {least})"""

OP4 = f"""
with d as (select doc_id, coalesce(source, chr(0) || 'null') as owner, coalesce(text, '') as t from documents),
{",".join(_FOUND.format(kind=k, pattern=p, group=g, least=n) for k, p, g, n in _SECRETS)},
f as (select * from assign union all select * from access union all select * from hex),
c as (select distinct doc_id, b - length(v) as a, b, v from f),
o as (select v, count(distinct owner) as owners from c join d using (doc_id) group by v),
x as (select doc_id, kind, a, b, list_position(['assign', 'access', 'hex'], kind) as r from f union all select doc_id, case when owners >= 3 then 'example' else 'live' end, a, b, case when owners >= 3 then 5 else 4 end from c join o using (v)),
z as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' order by a, r, b) filter (r <= 3) as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, r, b) as spans from x group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join z using (doc_id)
"""

OP6 = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256 from n join g using (t)
"""

OP8 = """
with recursive d as (select doc_id, source, cast(coalesce(strlen(text), 0) as bigint) as size from documents),
b as (select source, sum(size + 1) as n from d group by source),
w as (select source, pow(greatest(n, 1), 0.7) / pow((select sum(n) from b), 0.7) as w from b),
e as (select source, w / (select sum(w) from w) * 4096 as x from w),
f as (select source, x, greatest(1, cast(floor(x) as bigint)) as least, row_number() over (order by greatest(1, cast(floor(x) as bigint)) - x, coalesce(source, 'None')) as r from e),
p as (select source, least + case when r <= 4096 - (select sum(least) from f) then 1 else 0 end as p from f),
q as (select cast(-1 as bigint) as t, cast(null as varchar) as s, list({'s': coalesce(source, 'None'), 'i': cast(1 as bigint), 'p': cast(p as bigint)}) as st from p
  union all select t, s, list_transform(st, lambda x: {'s': x.s, 'i': x.i + case when x.s = s then 1 else 0 end, 'p': x.p})
  from (select t + 1 as t, st, list_min(list_transform(list_filter(st, lambda x: (x.i - 1) * 4096 // x.p <= t + 1), lambda x: {'d': (x.i * 4096 + x.p - 1) // x.p, 's': x.s})).s as s from q where t < 4095)),
a as (select s, t, row_number() over (partition by s order by t) - 1 as k from q where t >= 0),
n as (select doc_id, source, row_number() over o - 1 as mix_place, cast(sum(size) over o as bigint) - size as above from d window o as (partition by source order by md5(cast(doc_id as varchar)), doc_id rows between unbounded preceding and current row))
select n.doc_id, n.source, cast(n.above // 65536 // p.p * 4096 + a.t as bigint) as mix_slot, n.mix_place
from n join p on p.source is not distinct from n.source join a on a.s = coalesce(n.source, 'None') and a.k = n.above // 65536 % p.p
"""

_PART = "array_to_string(list_transform(range(8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(s, {at}, 10) as bigint) >> (35 - 5 * i)) & 31 as bigint) + 1, 1)), '')"

OP10 = f"""
with p as (select page_id, coalesce(html, '') as h from pages), q as (select page_id, strlen(h) as n, h, sha1(h) as s from p),
g as (select h, max(page_id) as top from q group by h)
select q.page_id, cast(q.n as bigint) as payload_bytes, {" || ".join(_PART.format(at=1 + 10 * i) for i in range(4))} as payload_digest,
  case when q.page_id = g.top then 'response' else 'revisit' end as record_type, case when q.page_id <> g.top then g.top end as refers_to
from q join g using (h)
"""
