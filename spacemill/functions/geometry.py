"""Size classes, slab and heap geometry, node ids: integer projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The size-class table as (first, last, step) runs, in class order. 16384 comes twice, so class 101 is never the first fit.
SIZE_CLASS_RUNS = [(8, 512, 8), (576, 1024, 64), (1536, 8192, 512), (9216, 16384, 1024), (18432, 30720, 2048), (16384, 245760, 16384)]
SIZE_CLASSES = [b for lo, hi, step in SIZE_CLASS_RUNS for b in range(lo, hi + 1, step)]
# Bytes of a heap's header and of a block's header, the alignment, and the bytes of a slab's header before its bitmap.
HEAP_HEADER, BLOCK_HEADER, ALIGN, SLAB_FIXED = 64, 64, 64, 18
#: Fullness bins of a slab: 0 under half, 1 from half, 2 full.
FULL = 2


def size_classes(spark: SparkSession) -> DataFrame:
    """cls, bytes: the 116-row dimension."""
    return spark.createDataFrame(list(enumerate(SIZE_CLASSES)), "cls int, bytes long")


def sizeclass(size: Column) -> Column:
    """The first class in table order of at least size bytes; null above the largest. Arithmetic on the run that the size falls into."""
    out, base = None, 0
    for lo, hi, step in SIZE_CLASS_RUNS:
        cls = (F.greatest(div(size - lo + step - 1, step), F.lit(0).cast("long")) + base).cast("int")
        out = F.when(size <= hi, cls) if out is None else out.when(size <= hi, cls)
        base += (hi - lo) // step + 1
    return out


def size_from_class(cls: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(b).cast("long") for b in SIZE_CLASSES]), (cls + 1).cast("int"))


def div(a: Column | int, b: Column | int) -> Column:
    """Whole division of longs of one sign, without a detour over doubles."""
    a = F.lit(a).cast("long") if isinstance(a, int) else a.cast("long")
    b = F.lit(b).cast("long") if isinstance(b, int) else b.cast("long")
    return F.call_function("div", a, b)


def align(v: Column, to: int) -> Column:
    """v rounded up to a power of two."""
    return (v + (to - 1)).bitwiseAND(F.lit(-to).cast("long"))


def round_up(x: Column, m: Column | int) -> Column:
    return div(x + m - 1, m) * m


def round_down(x: Column, m: Column | int) -> Column:
    return div(x, m) * m


def is_aligned(x: Column, m: int) -> Column:
    return F.pmod(x, F.lit(m)) == 0


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def block_size(log2: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), log2)


def max_slab_blocks(slab: Column | int, block: Column) -> Column:
    """Blocks that fit were the header not aligned."""
    slab = F.lit(slab).cast("long") if isinstance(slab, int) else slab
    return div((slab - SLAB_FIXED - 1) * 8, block * 8 + 1)


def slab_header(slab: Column | int, block: Column) -> Column:
    """Aligned header bytes: the fixed part and one bit for each block."""
    return align(F.lit(SLAB_FIXED).cast("long") + div(max_slab_blocks(slab, block) + 7, 8), ALIGN)


def slab_blocks(slab: Column | int, block: Column) -> Column:
    s = F.lit(slab).cast("long") if isinstance(slab, int) else slab
    return div(s - slab_header(slab, block), block)


def fullness(used: Column, total: Column) -> Column:
    return div(used * 2, total).cast("int")


def heap_blocks(region: Column, block: Column) -> Column:
    """struct(nblocks, headers_offset, blocks_offset) of a formatted region."""
    most = div(region - HEAP_HEADER, block + BLOCK_HEADER)
    headers = align(most * BLOCK_HEADER, ALIGN)
    return F.struct(
        div(region - HEAP_HEADER - headers, block).alias("nblocks"), F.lit(HEAP_HEADER).cast("long").alias("headers_offset"), (headers + HEAP_HEADER).alias("blocks_offset")
    )


# Enclosures of a rack and nodes of an enclosure.
ENCLOSURES, NODES = 8, 10


def node_parts(node_id: Column) -> Column:
    """struct(rack, encl, node), each from 1."""
    z = node_id - 1
    return F.struct((div(z, ENCLOSURES * NODES) + 1).alias("rack"), (F.pmod(div(z, NODES), F.lit(ENCLOSURES).cast("long")) + 1).alias("encl"), (F.pmod(z, F.lit(NODES)) + 1).cast("long").alias("node"))


def node_id(rack: Column, encl: Column, node: Column) -> Column:
    return (rack - 1) * (ENCLOSURES * NODES) + (encl - 1) * NODES + node


def hops(a: Column, b: Column) -> Column:
    """5 between enclosures, 3 between nodes, 1 within a node. Racks are not compared."""
    return F.when(a["encl"] != b["encl"], 5).when(a["node"] != b["node"], 3).otherwise(1)
