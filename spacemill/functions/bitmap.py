"""Bitmaps, least significant bit first: packed BINARY of 32768 bits a bucket, packed words of 64 bits, or positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spacemill.session import partitions

#: Bits of one of Spark's bitmaps.
BUCKET = 32768


def size_of(bits: Column) -> Column:
    return F.call_function("div", (bits + 7).cast("long"), F.lit(8).cast("long"))


def element(bit: Column) -> Column:
    return F.shiftright(bit, 3)


def mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(7).cast("int"))


def empty(bits: int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.lit((bits + 7) // 8)))


def words(df: DataFrame, key: str, bit: str, cleared: Column | None = None) -> DataFrame:
    """key, word, bits: the set positions of each key as words of 64 bits; those of rows where ``cleared`` holds are cleared again.

    Positions move as slim rows and by word, so that memory goes by the positions of a task, and a key with many is several tasks' work.
    """
    b, c = F.col(bit).cast("long"), F.lit(False) if cleared is None else cleared
    p = df.select(key, F.shiftright(b, 6).alias("word"), b.bitwiseAND(63).cast("byte").alias("_j"), c.alias("_c")).where("word is not null")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_j").cast("int"))
    held = F.bit_or(one)
    if cleared is not None:
        held = held.bitwiseAND(F.bitwise_not(F.bit_or(F.when(F.col("_c"), one).otherwise(0))))
    return p.repartition(partitions(df), key, "word").groupBy(key, "word").agg(held.alias("bits"))


def word_positions(df: DataFrame, key: str) -> DataFrame:
    """key, bit: the set positions of packed words, again as rows."""
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: F.getbit("bits", j) == 1))
    return df.select(key, "word", bit.alias("_j")).select(key, (F.col("word") * 64 + F.col("_j")).alias("bit"))


def construct(df: DataFrame, key: str, bit: str) -> DataFrame:
    """key, bucket, bits: the set positions (0-based) of each key as packed buckets.

    A task's positions come to it once each, by way of words, so that buckets are neither moved nor sorted, but made one after another.
    """
    p = word_positions(words(df, key, bit), key).select(key, F.call_function("div", F.col("bit"), F.lit(BUCKET).cast("long")).alias("bucket"), "bit")
    return p.repartition(partitions(df), key, "bucket").groupBy(key, "bucket").agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(BUCKET))).alias("bits"))


def is_set(bits: Column, bit: Column) -> Column:
    """Whether a 0-based bit is set, by its packed word."""
    return F.getbit(bits, bit.bitwiseAND(63).cast("int")) == 1


def positions(df: DataFrame, key: str) -> DataFrame:
    """key, bit: the set positions of packed buckets, again as rows."""
    # eight bytes at a time; words without bits are gone before anything is made of them
    word = lambda i: F.substring("bits", i * 8 + 1, F.lit(8))
    held = F.filter(F.sequence(F.lit(0), F.call_function("div", F.octet_length("bits") - 1, F.lit(8)).cast("int")), lambda i: word(i) != F.lit(bytes(8)))
    words = df.select(key, "bucket", F.explode(F.transform(held, lambda i: F.struct(i.alias("i"), F.conv(F.hex(word(i)), 16, -10).cast("long").alias("v")))).alias("w"))
    # bit j of the word is bit j & 7 of its byte j >> 3, and the first byte is the number's highest
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: F.getbit("w.v", (7 - F.shiftright(j, 3)) * 8 + j.bitwiseAND(7)) == 1))
    return words.select(key, (F.col("bucket") * BUCKET + F.col("w.i") * 64).alias("at"), bit.alias("j")).select(key, (F.col("at") + F.col("j")).alias("bit"))
