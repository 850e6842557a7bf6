"""Replays of allocation logs, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spacemill.operators import extents as ex
from spacemill.operators import replay as rp
from spacemill.plans.base import SIZES, query
from spacemill.scratch import scratch_path
from spacemill.sources import tables as t
from spacemill.streaming import replay as sr

_LOG = "lg as (select user_id as heap, event_id as seq, case when event_type = 'error' then 'F' else 'A' end as op, cast(1 + cast(floor(value) as bigint) % 16 as bigint) as n from events where event_type in ('signup', 'purchase', 'error'))"


#: The replay of 64 blocks a heap: a heap's free extents and its live ones, oldest first, from step to step.
_REPLAY = f"""with recursive {_LOG}, ev as (select *, row_number() over (partition by heap order by seq) as i from lg),
st as (
  select heap, cast(0 as bigint) as i, cast(null as bigint) as seq, cast(null as varchar) as op, cast(null as bigint) as n, cast(null as varchar) as status, cast(null as bigint) as start, cast(null as bigint) as len,
    [{{'l': cast(64 as bigint), 's': cast(0 as bigint)}}] as free, cast([] as struct(l bigint, s bigint)[]) as live from (select distinct heap from ev)
  union all
  select heap, i, seq, op, n, status, start, len,
    case when start is null then free
      when op = 'A' then list_concat(list_filter(free, lambda x: x.s <> start), case when got.l > len then [{{'l': got.l - len, 's': start + len}}] else [] end)
      else list_append(list_filter(free, lambda x: x.s + x.l <> start and x.s <> start + len),
        {{'l': len + coalesce(list_sum(list_transform(list_filter(free, lambda x: x.s + x.l = start or x.s = start + len), lambda x: x.l)), 0)::bigint, 's': coalesce(list_min(list_transform(list_filter(free, lambda x: x.s + x.l = start), lambda x: x.s)), start)}}) end,
    case when start is null then live when op = 'A' then list_append(live, {{'l': len, 's': start}}) else live[2:] end
  from (
    select *, case when got is not null then '{rp.OK}' when op = 'A' then '{rp.OUT_OF_MEMORY}' else '{rp.INVALID}' end as status, got.s as start, case when got is not null then case when op = 'A' then n else got.l end end as len
    from (select e.heap, e.i, e.seq, e.op, e.n, st.free, st.live, case when e.op = 'A' then list_min(list_filter(st.free, lambda x: x.l >= e.n)) else st.live[1] end as got from st join ev e on e.heap = st.heap and e.i = st.i + 1)))
select heap, seq, op, n, status, start, len from st where i > 0"""


def extent_heap():
    return rp.ExtentHeap(64)


def hybrid_heap():
    return rp.HybridHeap(1024, 64, 8192)


@query("a_m_log", f"with {_LOG} select * from lg")
def log(spark, sf):
    """The log that is replayed."""
    return t.alloc_log(spark, sf).drop("ts")


@query("a_m1_m3_m4_m5_m6_replay", _REPLAY)
def replay(spark, sf):
    """Best-fit allocation and freeing in every heap's own order."""
    return rp.replay(t.alloc_log(spark, sf), extent_heap, rp.EXTENT_ROWS)


@query("a_m2_frees_only", "with d as (select user_id as k, cast(floor(value) as bigint) * 4 as start, cast(3 as bigint) as len from events where event_type = 'error'), m as (select k, start, start + len as e, max(start + len) over (partition by k order by start, start + len rows between unbounded preceding and 1 preceding) as pm from (select distinct * from d)), g as (select *, sum(case when pm is null or start > pm then 1 else 0 end) over (partition by k order by start, e rows between unbounded preceding and current row) as g from m) select k, min(start) as start, max(e) - min(start) as len from g group by k, g")
def frees_only(spark, sf):
    """A log of frees alone needs no order: the free map is what coalescing gives."""
    e = t.read(spark, sf, "events").where("event_type = 'error'")
    d = e.select(F.col("user_id").alias("k"), (F.floor("value") * 4).cast("long").alias("start"), F.lit(3).cast("long").alias("len"))
    return ex.coalesce(d)


@query("a_m9_m16_m18_hybrid_replay")
def hybrid_replay(spark, sf):
    """Slabs for small and extents for big requests, in one heap."""
    g = t.alloc_log(spark, sf).withColumn("size", F.col("n") * 1024)
    return rp.replay(g, hybrid_heap, rp.HYBRID_ROWS, size="size")


@query("a_m17_route", f"with {SIZES} select ok, ln, pk, size, case when size < 65536 then 'small' else 'big' end as route from sz")
def route(spark, sf):
    s = t.size_requests(spark, sf)
    return s.withColumn("route", F.when(F.col("size") < 65536, "small").otherwise("big"))


@query("a_m_streaming_replay", _REPLAY)
def streaming_replay(spark, sf):
    """The extent replay as a stream with a state each heap; its rows are those of the batch form."""
    where = scratch_path(spark)
    out = sr.stream_replay(sr.event_log(spark, sf), extent_heap, rp.EXTENT_ROWS)
    sr.run_to_table(out, f"{where}/out", f"{where}/checkpoint")
    return spark.read.schema(rp.EXTENT_ROWS).parquet(f"{where}/out")


@query("a_m_streaming_hybrid")
def streaming_hybrid(spark, sf):
    """The hybrid replay, slabs and extents, as a stream with a state each heap; its rows are those of the batch form."""
    where = scratch_path(spark)
    log = sr.event_log(spark, sf).withColumn("size", F.col("n") * 1024)
    out = sr.stream_replay(log, hybrid_heap, rp.HYBRID_ROWS, size="size")
    sr.run_to_table(out, f"{where}/out", f"{where}/checkpoint")
    return spark.read.schema(rp.HYBRID_ROWS).parquet(f"{where}/out")


#: Blocks of a heap of the random workload, its live extents at most, and the steps of a heap.
RANDOM_BLOCKS, RANDOM_LIVE, RANDOM_STEPS = 252, 16, 128


@query("a_x15_random_workload", f"with h as (select s_suppkey as heap from supplier) select heap, cast({RANDOM_STEPS} as bigint) as steps, cast(0 as bigint) as overlaps, true as returned from h")
def random_workload(spark, sf):
    """Random allocations and frees of each heap, replayed: no two extents that live at once overlap, and frees give back what was handed out.

    An extent lives from its step to its free's step; the k-th free of a heap takes back the k-th extent handed out.
    """
    s = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("heap"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RANDOM_STEPS - 1).cast("long"))).alias("seq"))
    dice = F.pmod(F.xxhash64("heap", "seq"), F.lit(100))
    log = s.select("heap", "seq", F.when((dice < 50) | (F.col("seq") < 8), "A").otherwise("F").alias("op"), (1 + F.pmod(F.xxhash64("seq", "heap"), F.lit(16))).alias("n"))
    live = rp.lives(rp.replay(log, lambda: rp.ExtentHeap(RANDOM_BLOCKS), rp.EXTENT_ROWS), RANDOM_STEPS)
    twice, same = rp.held_twice(live, RANDOM_BLOCKS), live.groupBy("heap").agg(F.bool_and("returned").alias("returned"))
    steps = log.groupBy("heap").agg(F.count("*").alias("steps"))
    return steps.join(twice, "heap").join(same, "heap").select("heap", "steps", "overlaps", "returned")
