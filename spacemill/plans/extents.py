"""Interval algebra and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spacemill.functions import intervals as iv
from spacemill.operators import extents as ex
from spacemill.plans.base import FIT, FX, IV, PR, islands, query
from spacemill.sources import tables as t

#: Days of a bucket of interval joins, near the median length of an area.
WIDTH = 16
#: Days of a stretch that one task coalesces or probes, so that a hot key is several tasks' work.
PART = 512


def _pairs(spark, sf):
    w = W.partitionBy("k").orderBy("start", "len")
    d = t.intervals(spark, sf).select("k", F.col("start").alias("a_start"), F.col("len").alias("a_len"), F.lead("start").over(w).alias("b_start"), F.lead("len").over(w).alias("b_len"))
    return d.where("b_start is not null")


_PAIRS = f"""{IV}, pa as (select k, start as a_start, len as a_len, lead(start) over w as b_start, lead(len) over w as b_len from iv window w as (partition by k order by start, len)),
pp as (select * from pa where b_start is not null)"""
_OV = "a_start <= b_start + b_len and b_start <= a_start + a_len"
AB = ("a_start", "a_len", "b_start", "b_len")


@query("a_i1_overlaps", f"with {_PAIRS} select *, {_OV} as overlaps from pp")
def overlaps(spark, sf):
    return _pairs(spark, sf).withColumn("overlaps", iv.overlaps(*AB))


@query("a_i1_overlap_join", f"with {FX}, o as (select o_custkey % (select count(*) from supplier) as k, date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as start, cast(3 as bigint) as len from orders) select a.k, a.start as a_start, a.len as a_len, b.start as b_start, b.len as b_len from fx a join o b on a.k = b.k and a.start <= b.start + b.len and b.start <= a.start + a.len")
def overlap_join(spark, sf):
    b = t.probes(spark, sf).select("k", F.col("addr").alias("start"), F.lit(3).cast("long").alias("len"))
    return ex.overlap_join(ex.coalesce(t.intervals(spark, sf), width=PART), b, "k", WIDTH)


@query("a_i2_merge", f"with {_PAIRS} select *, case when {_OV} then least(a_start, b_start) else a_start end as m_start, case when {_OV} then greatest(a_start + a_len, b_start + b_len) - least(a_start, b_start) else a_len end as m_len from pp")
def merge(spark, sf):
    m = iv.merge(*AB)
    return _pairs(spark, sf).withColumns({"m_start": m["start"], "m_len": m["len"]})


@query("a_i3_end", f"with {IV} select *, start + len as \"end\" from iv")
def end(spark, sf):
    return t.intervals(spark, sf).withColumn("end", iv.end("start", "len"))


@query("a_i4_equal", f"with {_PAIRS} select *, a_start = b_start and a_len = b_len as equal from pp")
def equal(spark, sf):
    return _pairs(spark, sf).withColumn("equal", iv.equal(*AB))


def free(spark, sf):
    return ex.coalesce(t.intervals(spark, sf), width=PART)


@query("a_i5_coalesce", f"with {FX} select * from fx")
def coalesce(spark, sf):
    return free(spark, sf)


_P = "select p.id, p.k, p.addr, x.start as x_start, x.len as x_len from pr p"


@query("a_i6_prev", f"with {FX}, {PR} {_P} asof left join fx x on p.k = x.k and p.addr > x.start")
def prev(spark, sf):
    return ex.previous(free(spark, sf), t.probes(spark, sf), width=PART)


@query("a_i7_next", f"with {FX}, {PR} {_P} asof left join fx x on p.k = x.k and p.addr < x.start")
def following(spark, sf):
    return ex.following(free(spark, sf), t.probes(spark, sf), width=PART)


@query("a_i6_i7_neighbours", f"with {FX} select k, start, len, lag(start) over w as prev_start, lag(len) over w as prev_len, lead(start) over w as next_start, lead(len) over w as next_len from fx window w as (partition by k order by start)")
def neighbours(spark, sf):
    return ex.neighbours(free(spark, sf))


@query("a_i8_dump", f"with {FX} select *, '(' || start || ', ' || len || ')' as text from fx order by k, start")
def dump(spark, sf):
    return free(spark, sf).withColumn("text", iv.as_text("start", "len")).orderBy("k", "start")


@query("a_i9_dump_by_len", f"with {FX} select * from fx order by k, len, start")
def dump_by_len(spark, sf):
    return free(spark, sf).orderBy("k", "len", "start")


@query("a_i10_size", f"with {FX} select k, count(*) as n from fx group by k")
def size(spark, sf):
    return free(spark, sf).groupBy("k").agg(F.count("*").alias("n"))


_IV10 = "iv10 as (select * from iv where len <= 10)"


@query("a_i11_equal_maps", f"with {FX}, {_IV10}, {islands('iv10', 'fy')}, b as (select *, 1 as d from fx union all select *, -1 from fy), o as (select k, start, len, sum(d) as d from b group by all) select k, max(abs(d)) = 0 as equal from o group by k")
def equal_maps(spark, sf):
    return ex.same_extents(free(spark, sf), ex.coalesce(t.intervals(spark, sf, 10), width=PART))


@query("a_i12_indexes_agree", f"with {FX} select k, count(*) = count(distinct (start, len)) and count(*) = count(distinct start) as agree from fx group by k")
def indexes_agree(spark, sf):
    """An index by start and one by (len, start) hold the same extents when neither key repeats."""
    f = free(spark, sf)
    by_both = f.groupBy("k", "start", "len").agg(F.count("*").alias("n"))
    by_start = by_both.groupBy("k", "start").agg(F.count("*").alias("d"), F.sum("n").alias("n"))
    return by_start.groupBy("k").agg(((F.max("d") == 1) & (F.max("n") == 1)).alias("agree"))


_FIT = "select r.k, r.n, arg_min(f.start, (f.len, f.start)) as start, arg_min(f.len, (f.len, f.start)) as len from rq r left join fx f on f.k = r.k and f.len >= r.n group by r.k, r.n"


@query("a_l1_best_fit", f"with {FX}, {FIT} {_FIT}")
def best_fit(spark, sf):
    return ex.best_fit(free(spark, sf), t.fit_requests(spark, sf))


_ONE = "one as (select k, cast(max(len) // 2 + 1 as bigint) as n from fx group by k)"


@query("a_l2_remove_best_fit", f"with {FX}, {_ONE}, hit as ({_FIT.replace('from rq r', 'from one r')}) select fx.* from fx left join hit h on h.k = fx.k and h.start = fx.start where h.k is null")
def remove_best_fit(spark, sf):
    f = free(spark, sf)
    one = f.groupBy("k").agg((F.expr("max(len) div 2") + 1).alias("n"))
    return ex.remove_best_fit(f, one)


@query("a_l3_exists", f"with {FX}, {FIT}, big as (select k, max(len) as most from fx group by k) select r.k, r.n, coalesce(r.n >= 1 and r.n <= b.most, false) as fits from rq r left join big b on b.k = r.k")
def exists(spark, sf):
    return ex.fits(free(spark, sf), t.fit_requests(spark, sf))


@query("a_l4_descriptor", f"with {FX} select k, start, len, start * 4096 as byte_start, len * 4096 as byte_len from fx")
def descriptor(spark, sf):
    return free(spark, sf).select("k", "start", "len", (F.col("start") * 4096).alias("byte_start"), (F.col("len") * 4096).alias("byte_len"))


_IN = f"with {FX}, {PR}, a as (select p.id, p.k, p.addr, x.start, x.len from pr p left join fx x on x.k = p.k and p.addr >= x.start and p.addr < x.start + x.len)"


@query("a_l5_extent_at", f"{_IN} select *, case when start is null then 'INVALID_ADDRESS' else 'OK' end as status from a")
def extent_at(spark, sf):
    found = ex.containing(free(spark, sf), t.probes(spark, sf), width=PART)
    return found.withColumn("status", F.when(F.col("start").isNull(), "INVALID_ADDRESS").otherwise("OK"))


@query("a_l6_getsize", f"{_IN} select id, k, addr, coalesce(len * 4096, 0) as bytes from a")
def getsize(spark, sf):
    found = ex.containing(free(spark, sf), t.probes(spark, sf), width=PART)
    return found.select("id", "k", "addr", F.coalesce(F.col("len") * 4096, F.lit(0).cast("long")).alias("bytes"))


def _areas(spark, sf):
    return free(spark, sf).select("k", F.col("start").alias("vm_start"), (F.col("start") + F.col("len")).alias("vm_end"), (F.col("start") * 7).alias("base"))


@query("a_l7_find_area", f"{_IN} select id, k, addr, start as vm_start, start + len as vm_end from a")
def find_area(spark, sf):
    """Point in interval as an equi-join on buckets."""
    return ex.interval_join(t.probes(spark, sf), _areas(spark, sf), "k", "addr", WIDTH, "vm_start", "vm_end").select("id", "k", "addr", "vm_start", "vm_end")


@query("a_l8_reverse_translate", f"{_IN} select id, k, addr, case when start is not null then k end as region, addr - start + start * 7 as linear, case when start is null then 'INVALID_ADDRESS' else 'OK' end as status from a")
def reverse_translate(spark, sf):
    d = ex.interval_join(t.probes(spark, sf), _areas(spark, sf), "k", "addr", WIDTH, "vm_start", "vm_end")
    miss = F.col("vm_start").isNull()
    return d.select("id", "k", "addr", F.when(~miss, F.col("k")).alias("region"), (F.col("addr") - F.col("vm_start") + F.col("base")).alias("linear"), F.when(miss, "INVALID_ADDRESS").otherwise("OK").alias("status"))


_REG = "rg as (select s_suppkey as k, s_suppkey * 1000000 as base from supplier)"


def _regions(spark, sf):
    return t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 1000000).alias("base"))


@query("a_l9_translate", f"with {PR}, {_REG} select pr.id, pr.k, pr.addr, base + addr as vm_addr from pr join rg on rg.k = pr.k")
def translate(spark, sf):
    return t.probes(spark, sf).join(_regions(spark, sf), "k").select("id", "k", "addr", (F.col("base") + F.col("addr")).alias("vm_addr"))


@query("a_l10_region", f"with {PR}, {_REG} select pr.id, pr.k * 2 as k, rg.base from pr left join rg on rg.k = pr.k * 2")
def region(spark, sf):
    """Regions by id, null where there is none (half of the ids asked are unknown)."""
    p = t.probes(spark, sf).select("id", (F.col("k") * 2).alias("k"))
    return p.join(_regions(spark, sf), "k", "left").select("id", "k", "base")


@query("a_l11_area_snapshot", f"with {FX} select k, start as vm_start, start + len as vm_end from fx where start % 3 <> 0 union all select s_suppkey, 100000, 100064 from supplier")
def area_snapshot(spark, sf):
    """The interval map after areas were removed (starts divisible by 3) and one a region was put in."""
    areas = _areas(spark, sf).select("k", "vm_start", "vm_end")
    gone = areas.where("vm_start % 3 = 0").select("k", "vm_start")
    new = _regions(spark, sf).select("k", F.lit(100000).cast("long").alias("vm_start"), F.lit(100064).cast("long").alias("vm_end"))
    return areas.join(gone, ["k", "vm_start"], "left_anti").unionByName(new)
