"""Block headers and extents: scanning runs, marking, recovery of the free-space map."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from spacemill.operators.extents import coalesce
from spacemill.session import partitions

#: Types of a block header.
FREE, FIRST, RUN = 0, 1, 2


def mark(extents: DataFrame, key: str = "k", *others: str) -> DataFrame:
    """key, idx, type, size, and other columns: a header for each block of allocated extents; First holds the extent's size, Run 0."""
    e = extents.where("len > 0").select(key, "start", "len", *others, F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("_i"))
    first = F.col("_i") == 0
    return e.select(key, (F.col("start") + F.col("_i")).alias("idx"), F.when(first, FIRST).otherwise(RUN).alias("type"), F.when(first, F.col("len")).otherwise(0).cast("long").alias("size"), *others)


def clear(extents: DataFrame, key: str = "k") -> DataFrame:
    """The same blocks, marked free."""
    return mark(extents, key).select(key, "idx", F.lit(FREE).alias("type"), F.lit(0).cast("long").alias("size"))


def headers(allocated: DataFrame, nblocks: int, key: str = "k") -> DataFrame:
    """All nblocks headers of each key that has extents: its allocated blocks, and the free blocks between them."""
    w = W.partitionBy(key).orderBy("start")
    zero = F.lit(0).cast("long")
    ends = allocated.repartition(partitions(allocated), key).select(key, "start", "len", (F.col("start") + F.col("len")).alias("_end"))
    # of each extent the gap before it and itself, of the last one also the gap behind it; one sort
    near = ends.select("*", F.coalesce(F.lag("_end").over(w), zero).alias("_from"), F.max("_end").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_to"), F.lead("start").over(w).isNull().alias("_last"))
    extent = lambda start, length, held: F.struct(start.alias("start"), length.alias("len"), F.lit(held).alias("held"))
    behind = F.when(F.col("_last"), F.lit(nblocks).cast("long") - F.col("_to")).otherwise(zero)
    around = F.array(extent(F.col("_from"), F.col("start") - F.col("_from"), False), extent(F.col("start"), F.col("len"), True), extent(F.col("_to"), behind, False))
    h = mark(near.select(key, F.explode(around).alias("_x")).select(key, "_x.*"), key, "held")
    return h.select(key, "idx", F.when(F.col("held"), F.col("type")).otherwise(FREE).alias("type"), F.when(F.col("held"), F.col("size")).otherwise(0).cast("long").alias("size"))


#: Headers of a key whose runs are found by themselves.
STRETCH = 4096


def scan(h: DataFrame, key: str = "k", stretch: int = STRETCH) -> DataFrame:
    """key, start, len, is_free: maximal free runs, and allocated extents by their First header.

    The free headers of 64 blocks are packed into a word before anything is moved or sorted. A word's runs are read off its bits; those that
    meet at a word's border are joined within stretches, and then over the borders of stretches.
    """
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("idx").bitwiseAND(63).cast("int"))
    words = h.where(F.col("type") == FREE).groupBy(key, F.shiftright("idx", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    bit = lambda j: F.getbit("_bits", j) == 1
    every = F.sequence(F.lit(0), F.lit(63))
    firsts = F.filter(every, lambda j: bit(j) & ((j == 0) | ~bit(F.greatest(j - 1, F.lit(0)))))
    lasts = F.filter(every, lambda j: bit(j) & ((j == 63) | ~bit(F.least(j + 1, F.lit(63)))))
    run = F.explode(F.arrays_zip(firsts.alias("a"), lasts.alias("b")))
    runs = words.select(key, "_word", run.alias("_r")).select(key, (F.col("_word") * 64 + F.col("_r.a")).alias("start"), (F.col("_r.b") - F.col("_r.a") + 1).cast("long").alias("len"))
    runs = coalesce(runs, key, stretch)
    held = h.where(F.col("type") == FIRST).select(key, F.col("idx").alias("start"), F.col("size").alias("len"), F.lit(False).alias("is_free"))
    return runs.withColumn("is_free", F.lit(True)).unionByName(held)


def recover(h: DataFrame, key: str = "k") -> DataFrame:
    """The free-space map of stored headers."""
    return scan(h, key).where("is_free").select(key, "start", "len")
