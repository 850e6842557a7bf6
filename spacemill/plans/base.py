"""Registration of queries with their SQL, and the SQL of the input views."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

DAY = "date_diff('day', date '1995-01-01', cast({} as date))"
IV = f"iv as (select l_suppkey as k, {DAY.format('l_shipdate')} as start, cast(l_quantity as bigint) as len from lineitem where l_quantity <= 20)"
#: Equal intervals are taken once, so that both windows have one order.
_ISLANDS = """{p}m as (select k, start, start + len as e, max(start + len) over (partition by k order by start, start + len rows between unbounded preceding and 1 preceding) as pm from (select distinct k, start, len from {src})),
{p}g as (select *, sum(case when pm is null or start > pm then 1 else 0 end) over (partition by k order by start, e rows between unbounded preceding and current row) as g from {p}m),
{out} as (select k, min(start) as start, max(e) - min(start) as len from {p}g group by k, g)"""


def islands(src: str, out: str) -> str:
    return _ISLANDS.format(src=src, out=out, p=out)


#: Coalesced extents fx(k, start, len), and probes pr(id, k, addr).
FX = f"{IV}, {islands('iv', 'fx')}"
PR = f"pr as (select o_orderkey as id, o_custkey % (select count(*) from supplier) as k, {DAY.format('o_orderdate')} as addr from orders)"
FIT = "rq as (select distinct l_suppkey as k, cast(l_quantity as bigint) as n from lineitem)"
SIZES = "sz as (select l_orderkey as ok, l_linenumber as ln, l_partkey as pk, cast(l_quantity as bigint) * 4096 as size from lineitem)"
FILES = "fl as (select l_orderkey as g, cast(l_quantity as bigint) as size, row_number() over (partition by l_orderkey order by l_quantity) as seq from lineitem)"
BASED = f"{FILES}, fb as (select *, cast(coalesce(sum(size) over (partition by g order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as base from fl)"
BOOKS = "bk as (select s_suppkey as file, s_suppkey % 16 + 1 as nbooks, unnest(range(0, s_suppkey % 16 + 1)) as i from supplier)"
POS = "ps as (select distinct l_suppkey as map, l_partkey as bit from lineitem)"
#: Headers hd(k, idx, type, size) of 4096 blocks a heap, of the coalesced extents.
NBLOCKS = 4096
HD = f"""{FX}, hb as (select k, idx from (select distinct k from fx), (select unnest(range(0, {NBLOCKS})) as idx)),
mk as (select k, start, len, start + unnest(range(0, len)) as idx from fx),
hd as (select hb.k, hb.idx, cast(case when m.k is null then 0 when m.start = hb.idx then 1 else 2 end as integer) as type, cast(case when m.start = hb.idx then m.len else 0 end as bigint) as size
  from hb left join mk m on m.k = hb.k and m.idx = hb.idx)"""


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with SQL that gives the same rows."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put
