"""Sharding by jump consistent hashing, in DataFrame and SQL functions only.

A key walks a chain of growing shard numbers drawn from a 64-bit linear congruential generator seeded with
the key (Lamping and Veach); its shard among n is the chain's last number below n. One more shard therefore
takes only rows whose chain holds the number n, and no ring table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spacemill.llm.common import numbered, others, stage, unused

#: The generator's multiplier, and the modulus of its state.
MULTIPLIER, MODULUS = 2862933555777941757, 2**64
#: Steps of the first walk; a chain to n has about ln(n) numbers. Longer chains are walked on, so results are exact.
STEPS = 48


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of an integral key among ``shards``, and among one more. A null key counts as 0."""
    limit = shards + 1
    k = F.coalesce(key.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    k = F.when(k < 0, (k + F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(k)

    def walk(start: Column, steps: int) -> Column:
        def step(acc: Column, _: Column) -> Column:
            nxt = F.floor((acc.j + 1).cast("double") * (F.lit(2147483648.0) / (F.floor(acc.k / 8589934592).cast("double") + 1.0))).cast("long")
            k2 = ((acc.k * F.lit(MULTIPLIER).cast("decimal(19,0)") + 1) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")
            moved = F.struct(
                k2.alias("k"), nxt.alias("j"), F.when(acc.j < shards, acc.j).otherwise(acc.b).alias("b"), acc.j.alias("g")
            )
            return F.when(acc.j < limit, moved).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    first = ((k * F.lit(MULTIPLIER).cast("decimal(19,0)") + 1) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")
    begin = F.struct(first.alias("k"), F.lit(0).cast("long").alias("j"), F.lit(-1).cast("long").alias("b"), F.lit(-1).cast("long").alias("g"))
    out = walk(begin, min(STEPS, limit))
    if limit > STEPS:
        out = F.when(out.j < limit, walk(out, limit - STEPS)).otherwise(out)
    return F.struct(out.b.cast("int").alias("shard"), out.g.cast("int").alias("grown"))


#: Rows up to which numbered row keys are sent to the rows by broadcast (some 60 MB); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", sequence: tuple[str, str] | None = None, blocks: int = 256, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All columns of docs plus size, text_crc32, law ('key'), shard, slot and grown_shard.

    The integral id alone decides the shard (null counts as id 0). ``size`` is the text's UTF-8 bytes plus 8,
    ``text_crc32`` its unsigned CRC-32; a null text has no bytes. ``slot`` numbers a shard's rows from 0 without
    gaps, block by block of the sum of id and text_crc32 modulo ``blocks`` and by id in these, ties in any order; equal rows are interchangeable. With ``sequence``, the names of
    two columns that tell rows apart and are not given back, it follows their order: rows of one value of the first are
    numbered together, by the second, on these columns alone. Columns of docs with the result's names, in any case, are replaced. An empty table gives no rows.
    """
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    octets = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(*others(docs, names, id_col, text_col))
    walked = unused([*rows.columns, *names], "jump")[0]
    out = rows.withColumns({"size": F.octet_length(octets).cast("long") + 8, "text_crc32": F.crc32(octets), "law": F.lit("key"), walked: jump(F.col(id_col), shards)})
    out = out.withColumns({"shard": F.col(walked)["shard"], "grown_shard": F.col(walked)["grown"]}).drop(walked)
    if not sequence:
        by = [F.col(id_col), F.col("text_crc32"), F.col("size")]
        n = F.lit(blocks)
        block = F.pmod(F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), n) + F.pmod("text_crc32", n), n)
        return numbered(out, "shard", by, {"slot": F.lit(1)}, blocks, [], block=block)
    file, row = sequence
    keys = rows.select(F.col(file).alias("file"), F.col(row).alias("row"), jump(F.col(id_col), shards)["shard"].alias("shard"))
    slots = stage(numbered(keys, "shard", [F.col("row")], {"slot": F.lit(1)}, blocks, [], block=F.col("file")).drop("shard"), "shard-slots")
    f, r, n = unused(out.columns, "file", "row", "slot")
    slots = slots.select(F.col("file").alias(f), F.col("row").alias(r), F.col("slot").alias(n))
    joined = out.join(F.broadcast(slots) if slots.count() <= broadcast_rows else slots, (F.col(file) == F.col(f)) & (F.col(row) == F.col(r)))
    return joined.drop(file, row, f, r) if n == "slot" else joined.drop(file, row, f, r).withColumnRenamed(n, "slot")
