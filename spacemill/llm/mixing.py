"""Mixing sources to target weights by Pfair scheduling.

A source of weight w has release floor((i - 1) / w) and deadline ceil(i / w) for its i-th block. Served earliest
deadline first, one block a slot, every source's blocks served by any time t stay within one block of w * t. Weights are
rounded to parts p of a hyperperiod of Q slots, after which the schedule repeats; so one period of Q slots
is scheduled, and block k of a source has slot (k div p) * Q + pattern[k mod p] wherever it is in the cluster.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F

from spacemill.llm.common import delete, numbered, others, stage, unused

#: Slots of a hyperperiod at least; weights are rounded to its parts.
PERIOD = 4096


def parts(weights: dict, period: int = PERIOD) -> dict:
    """Whole parts of the period, at least one for each positive weight, summing to it (largest remainders)."""
    total = sum(w for w in weights.values() if w > 0)
    if not total:
        return {}
    while period < 4 * len(weights):
        period *= 2
    exact = {s: w / total * period for s, w in weights.items() if w > 0}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    while (short := period - sum(out.values())) != 0:
        for s in order if short > 0 else reversed(order):
            if short > 0 or out[s] > 1:
                out[s] += 1 if short > 0 else -1
                short += -1 if short > 0 else 1
            if not short:
                break
    return out


def schedule(p: dict) -> list:
    """The source served in each slot of one hyperperiod, earliest deadline first among released blocks."""
    period, out, ready = sum(p.values()), [], []
    release = [(0, str(s), s, 1) for s in p]
    heapq.heapify(release)
    for t in range(period):
        while release and release[0][0] <= t:
            _, name, s, i = heapq.heappop(release)
            heapq.heappush(ready, (-(-i * period // p[s]), name, s, i))
        _, name, s, i = heapq.heappop(ready)
        out.append(s)
        if i < p[s]:
            heapq.heappush(release, (i * period // p[s], name, s, i + 1))
    return out


def tempered(sizes: dict, power: float = 0.7) -> dict:
    """Target weights from sizes: shares to the given power, so that small sources come up more often early."""
    total = sum(sizes.values()) or 1
    return {s: max(n, 1) ** power / total**power for s, n in sizes.items()}


#: Rows up to which places are sent to the rows by broadcast (some 100 MB); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of a source that one task numbers.
BLOCK_ROWS = 1_000_000
#: Parts that the slots are dealt into to even out the bytes of the result's partitions: so many, or more for each partition.
BINS, BINS_EACH = 4096, 8


def _row_key(docs: DataFrame) -> list[Column]:
    """128 bits of a row's columns."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return [F.xxhash64(*plain), F.xxhash64(F.lit("second"), *plain)]


def mix(docs: DataFrame, weights: dict | None = None, block_bytes: int = 1 << 16, power: float = 0.7, slots: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs plus mix_slot (the Pfair slot of the row's block) and mix_place (its number in its source), sorted by them over partitions.

    A source's rows come in the order of the MD5 digest of their id, and a block is block_bytes of their text; a row is
    in the block where it begins. Every row has a place: where some sources are used up their slots stay
    empty and the others go on at their mutual rates. With ``slots`` the feature is a cut: only rows of slots below it are
    given. Weights default to tempered shares of bytes; sources of no weight are left out only where weights are given. A null
    source is a source like others; a null text has no bytes. Equal rows have a place each. Sources (not rows) are known to
    the driver. Columns named mix_slot or mix_place, in any case, are replaced. An empty table gives no rows.

    Places are found on row keys, ids and sizes alone; the rows themselves are moved once, to the partition of their slot.
    """
    spark = docs.sparkSession
    docs = docs.select(*[f"`{c}`" for c in others(docs, ("mix_slot", "mix_place"))])
    size = F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long"))
    k1, k2 = _row_key(docs)
    slim = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), size.alias("size"), k1.alias("k1"), k2.alias("k2"))
    staged = slim = stage(slim.groupBy("source", "id", "size", "k1", "k2").agg(F.count("*").alias("n")), "mix-rows")
    sources = {r["source"]: r for r in slim.groupBy("source").agg(F.sum(F.col("n") * (F.col("size") + 1)).alias("bytes"), F.count("*").alias("rows")).collect()}
    if weights is None:
        weights = tempered({s: r["bytes"] for s, r in sources.items()}, power)
    p = parts(weights)
    pattern = schedule(p)
    at: dict = {}
    for t, s in enumerate(pattern):
        at.setdefault(s, []).append(t)
    # PERIOD slots in all, or four times the sources
    table = spark.createDataFrame([(s, p[s], slots_) for s, slots_ in at.items()], "s string, parts long, pattern array<long>")
    blocks = max(64, -(-max([0, *(r["rows"] for r in sources.values())]) // block_rows))
    slim = slim.withColumn("turn", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    # equal stretches of the digests, so that blocks follow one another as the digests do
    block = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") * (blocks / 2**32)).cast("long")
    order = [F.col(c) for c in ("turn", "id", "size", "k1", "k2")]
    counted = numbered(slim, "source", order, {"place": F.col("n"), "above": F.col("n") * F.col("size")}, blocks, [], block=block)

    def slot(above: Column) -> Column:
        block = F.floor(above / block_bytes).cast("long")
        return (F.floor(block / F.col("parts")) * len(pattern) + F.element_at("pattern", (block % F.col("parts") + 1).cast("int"))).cast("long")

    placed = counted.join(F.broadcast(table) if len(at) <= broadcast_rows else table, F.col("source").eqNullSafe(F.col("s")))
    found = stage(placed.select("source", "k1", "k2", "n", "size", "place", "above", slot(F.col("above")).alias("slot")), "mix-places")
    delete(spark, [staged.staged_at])
    many = not found.where("n > 1").isEmpty()
    own = docs.columns
    a, b, x = unused([*own, "mix_slot", "mix_place"], "k1", "k2", "found")
    keyed = docs.withColumns({a: k1, b: k2})

    def joined(rows: DataFrame, places: DataFrame, got: Column, few: bool) -> DataFrame:
        y = places.select(F.col("k1").alias("_y1"), F.col("k2").alias("_y2"), got.alias(x)).withColumnsRenamed({"_y1": a + "_", "_y2": b + "_"})
        return rows.join(F.broadcast(y) if few else y, (F.col(a) == F.col(a + "_")) & (F.col(b) == F.col(b + "_"))).select(*[f"`{c}`" for c in own], x)

    few = found.count() <= broadcast_rows
    place = F.struct(F.col("slot").alias("slot"), F.col("place").alias("place"))
    out = joined(keyed, found.where("n = 1"), place, few)
    if many:  # equal rows: one of them, given a place for each
        copies = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.struct(slot(F.col("above") + i * F.col("size")).alias("slot"), (F.col("place") + i).alias("place")))
        repeated = keyed.join(found.where("n > 1").select(F.col("k1").alias(a), F.col("k2").alias(b)), [a, b], "left_semi").dropDuplicates([a, b])
        again = found.where("n > 1").join(table, F.col("source").eqNullSafe(F.col("s")))
        out = out.unionByName(joined(repeated, again, copies, few).withColumn(x, F.explode(x)))
    out = out.withColumns({"mix_slot": F.col(x)["slot"], "mix_place": F.col(x)["place"]}).drop(x)
    if slots is not None:
        out = out.where(F.col("mix_slot") < slots)
    # partitions are runs of slots of about equal bytes, known from the places
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = (found.agg(F.max("slot")).first()[0] or 0) + 1
    bins = min(last, max(BINS, BINS_EACH * n))
    bin_of = lambda c: F.least(F.floor(c * (bins / last)), F.lit(bins - 1)).cast("int")
    held = {r["bin"]: r["bytes"] for r in found.groupBy(bin_of(F.col("slot")).alias("bin")).agg(F.sum(F.col("n") * (F.col("size") + 100)).alias("bytes")).collect()}
    total, upto, part = sum(held.values()) or 1, 0, []
    for k in range(bins):
        part.append(min(n - 1, upto * n // total))
        upto += held.get(k, 0)
    to = F.element_at(F.lit(part).cast("array<int>"), bin_of(F.col("mix_slot")) + 1)
    return out.repartitionById(n, to).sortWithinPartitions("mix_slot", "mix_place")
