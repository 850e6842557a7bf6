"""Extents: coalescing, neighbours, best fit, and point-in-interval lookup without range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from spacemill.functions.geometry import size_from_class
from spacemill.session import partitions


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps and islands of (start, len) within keys: one shuffle, one sort."""
    e = df.select(*keys, "start", (F.col("start") + F.col("len")).alias("end"))
    w = W.partitionBy(*keys).orderBy("start", "end")
    reached = e.withColumn("_reach", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    island = F.sum(F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    merged = reached.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("_end"))
    return merged.select(*keys, "start", (F.col("_end") - F.col("start")).alias("len"))


def coalesce(df: DataFrame, key: str = "k", width: int | None = None, spread: bool = False) -> DataFrame:
    """key, start, len: the maximal merged extents of each key.

    With a width, intervals are first merged within (key, start div width), which spreads a key that holds a large share of all
    intervals over tasks; what is left of it is merged again by key. Merging parts first changes nothing in the result.
    With spread, adaptive execution does not join the partitions of the keys, for extents of which many rows are made.
    """
    if width:
        df = _islands(df.withColumn("_part", F.floor(F.col("start") / width)), [key, "_part"])
    return _islands(df.repartition(partitions(df), key) if spread else df, [key])


def neighbours(df: DataFrame, key: str = "k") -> DataFrame:
    """Each extent with the one before and after it by address."""
    w = W.partitionBy(key).orderBy("start", "len")
    names = {"prev_start": F.lag("start").over(w), "prev_len": F.lag("len").over(w), "next_start": F.lead("start").over(w), "next_len": F.lead("len").over(w)}
    return df.select(key, "start", "len", *[c.alias(n) for n, c in names.items()])


def previous(extents: DataFrame, probes: DataFrame, key: str = "k", at: str = "addr", inclusive: bool = False, width: int | None = None) -> DataFrame:
    """As-of backward: id, key, ``at``, x_start and x_len of the last extent that starts before (or at) each probe.

    Extents and probes are sorted together once and a running ``last`` carries the extent along, so there is no range join. With a
    width, that is done within (key, place div width), so that a key with a large share of the rows is several tasks' work; a
    stretch's first probes take the last extent of the stretches before it, from a table of one row a stretch.
    """
    a = extents.select(F.col(key), F.col("start").alias("_at"), F.lit(1).alias("_extent"), F.struct("start", "len").alias("_x"), F.lit(None).cast("long").alias("_id"))
    p = probes.select(F.col(key), F.col(at).alias("_at"), F.lit(0).alias("_extent"), F.lit(None).cast(a.schema["_x"].dataType).alias("_x"), F.col("id").cast("long").alias("_id"))
    # of equal places the extent comes first for an inclusive probe
    tie = F.col("_extent").desc() if inclusive else F.col("_extent").asc()
    stretch = F.floor(F.col("_at") / width).cast("long") if width else F.lit(0).cast("long")
    rows = a.unionByName(p).withColumn("_part", stretch)
    w = W.partitionBy(key, "_part").orderBy(F.col("_at"), tie).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("_found", F.last("_x", ignorenulls=True).over(w)).where("_extent = 0")
    if width:
        upto = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        lasts = rows.groupBy(key, "_part").agg(F.max("_x").alias("_x")).select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.last("_x", ignorenulls=True).over(upto).alias("_before"))
        out = out.join(lasts, (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p"))).withColumn("_found", F.coalesce("_found", "_before"))
    return out.select(F.col("_id").alias("id"), key, F.col("_at").alias(at), F.col("_found.start").alias("x_start"), F.col("_found.len").alias("x_len"))


def following(extents: DataFrame, probes: DataFrame, key: str = "k", at: str = "addr", width: int | None = None) -> DataFrame:
    """As-of forward: the first extent that starts after each probe, as the last one before it on the mirrored axis."""
    flipped = extents.select(key, (-F.col("start")).alias("start"), "len")
    back = previous(flipped, probes.withColumn(at, -F.col(at)), key, at, width=width)
    return back.select("id", key, (-F.col(at)).alias(at), (-F.col("x_start")).alias("x_start"), "x_len")


def best_fit(extents: DataFrame, requests: DataFrame, key: str = "k", n: str = "n") -> DataFrame:
    """For each request the shortest extent of at least n blocks, of those the lowest; null on a miss and for n below 1.

    An as-of join on lengths: of each (key, length) only the lowest extent matters, so the sides are small before the one sort.
    """
    lowest = extents.groupBy(key, "len").agg(F.min("start").alias("start"))
    flipped = lowest.select(key, (-F.col("len")).alias("_neg"), "start", "len")
    a = flipped.select(key, F.col("_neg").alias("_at"), F.lit(0).alias("_probe"), F.struct("start", "len").alias("_x"))
    p = requests.select(key, (-F.col(n)).alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast(a.schema["_x"].dataType).alias("_x"))
    w = W.partitionBy(key).orderBy("_at", "_probe").rowsBetween(W.unboundedPreceding, 0)
    out = a.unionByName(p).withColumn("_found", F.last("_x", ignorenulls=True).over(w)).where("_probe = 1").withColumn(n, -F.col("_at"))
    hit = F.when(F.col(n) >= 1, F.col("_found"))
    return out.select(key, n, hit["start"].alias("start"), hit["len"].alias("len"))


def remove_best_fit(extents: DataFrame, requests: DataFrame, key: str = "k", n: str = "n") -> DataFrame:
    """The extents left when each key's single request has taken its best fit."""
    gone = best_fit(extents, requests, key, n).where("start is not null").select(key, "start", "len")
    return extents.join(gone, [key, "start", "len"], "left_anti")


def fits(extents: DataFrame, requests: DataFrame, key: str = "k", n: str = "n") -> DataFrame:
    """Whether any extent of the key holds n blocks."""
    longest = extents.groupBy(key).agg(F.max("len").alias("_most"))
    return requests.join(longest, key, "left").select(key, n, F.coalesce((F.col(n) >= 1) & (F.col(n) <= F.col("_most")), F.lit(False)).alias("fits"))


def containing(extents: DataFrame, probes: DataFrame, key: str = "k", at: str = "addr", width: int | None = None) -> DataFrame:
    """For disjoint extents: the extent that holds each probe's address, else null."""
    p = previous(extents, probes, key, at, inclusive=True, width=width)
    inside = F.col(at) < F.col("x_start") + F.col("x_len")
    return p.select("id", key, at, F.when(inside, F.col("x_start")).alias("start"), F.when(inside, F.col("x_len")).alias("len"))


def stored_size(extents: DataFrame, slabs: DataFrame, probes: DataFrame, block: int, slab_blocks: int, key: str = "k", at: str = "addr", width: int | None = None) -> DataFrame:
    """id, key, ``at``, bytes: the block size of the slab that holds the address where its extent is of a slab's size, else the extent's bytes; 0 where no extent holds it.

    slabs: key, start, cls of the slabs. An extent of a slab's size that is none of them has its own bytes.
    """
    found = containing(extents, probes, key, at, width).join(slabs.select(key, "start", "cls"), [key, "start"], "left")
    whole = F.col("len") * block
    size = F.when(F.col("start").isNull(), F.lit(0).cast("long")).when(F.col("len") == slab_blocks, F.coalesce(size_from_class(F.col("cls")), whole)).otherwise(whole)
    return found.select("id", key, at, size.alias("bytes"))


def interval_join(points: DataFrame, areas: DataFrame, key: str, at: str, width: int, lo: str = "start", hi: str = "end", how: str = "left") -> DataFrame:
    """points joined to areas with lo <= at < hi of the same key, as an equi-join on buckets of ``width`` (near the median length of an area)."""
    bucket = lambda c: F.floor(c / width).cast("long")
    dealt = areas.where(F.col(hi) > F.col(lo)).withColumn("_b", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi) - 1)))).withColumnRenamed(key, "_k")
    p = points.withColumn("_pb", bucket(F.col(at)))
    on = (p[key] == dealt["_k"]) & (p["_pb"] == dealt["_b"]) & (p[at] >= dealt[lo]) & (p[at] < dealt[hi])
    return p.join(dealt, on, how).drop("_b", "_pb", "_k")


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: int, touching: bool = True) -> DataFrame:
    """Pairs (a_start, a_len, b_start, b_len) of a key that overlap, or touch; each once, in the bucket of the later start."""
    reach = 1 if touching else 0
    bucket = lambda c: F.floor(c / width).cast("long")

    def dealt(df: DataFrame, p: str) -> DataFrame:
        d = df.where("len > 0").select(F.col(key).alias(f"{p}k"), F.col("start").alias(f"{p}_start"), F.col("len").alias(f"{p}_len"))
        last = F.col(f"{p}_start") + F.col(f"{p}_len") + (reach - 1)
        return d.withColumn(f"{p}_b", F.explode(F.sequence(bucket(F.col(f"{p}_start")), bucket(last))))

    x, y = dealt(a, "a"), dealt(b, "b")
    a_end, b_end = F.col("a_start") + F.col("a_len"), F.col("b_start") + F.col("b_len")
    meet = (F.col("a_start") < b_end + reach) & (F.col("b_start") < a_end + reach)
    pairs = x.join(y, (F.col("ak") == F.col("bk")) & (F.col("a_b") == F.col("b_b")) & meet)
    return pairs.where(F.col("a_b") == bucket(F.greatest("a_start", "b_start"))).select(F.col("ak").alias(key), "a_start", "a_len", "b_start", "b_len")


def same_extents(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    """key, equal: whether the two maps hold the same extents. One aggregation of both, not two differences."""
    both = a.select(key, "start", "len", F.lit(1).alias("_d")).unionByName(b.select(key, "start", "len", F.lit(-1).alias("_d")))
    off = both.groupBy(key, "start", "len").agg(F.sum("_d").alias("_d"))
    return off.groupBy(key).agg((F.max(F.abs("_d")) == 0).alias("equal"))
