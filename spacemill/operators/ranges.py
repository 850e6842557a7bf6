"""Files back to back as one range, and the placement of their books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from spacemill.errors import SpaceError, check


def offsets(files: DataFrame, group: str = "g") -> DataFrame:
    """files with ``base``: the bytes of the group's files before it."""
    w = W.partitionBy(group).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))


def clip(files: DataFrame, offset: Column, length: Column, group: str = "g") -> DataFrame:
    """group, seq, file_offset, map_offset, length: the part of each file in [offset, offset + length) of its group."""
    f = offsets(files, group).withColumns({"_lo": F.greatest(F.col("base"), offset), "_hi": F.least(F.col("base") + F.col("size"), offset + length)})
    part = f.where("_hi > _lo")
    return part.select(group, "seq", (F.col("_lo") - F.col("base")).alias("file_offset"), (F.col("_lo") - offset).alias("map_offset"), (F.col("_hi") - F.col("_lo")).alias("length"))


def contiguous(parts: DataFrame, group: str = "g") -> DataFrame:
    """group, contiguous: whether each part begins where the one before it ends."""
    w = W.partitionBy(group).orderBy("seq")
    ok = F.coalesce(F.lag("map_offset").over(w) + F.lag("length").over(w) == F.col("map_offset"), F.lit(True))
    return parts.select(group, ok.alias("_ok")).groupBy(group).agg(F.bool_and("_ok").alias("contiguous"))


def place_requested(books: DataFrame, request: Column) -> DataFrame:
    """books (file, i) with ``node``: the requested node of the book, 0 where none is asked."""
    return books.withColumn("node", F.coalesce(F.get(request, F.col("i").cast("int")), F.lit(0)).cast("int"))


def place_round_robin(books: DataFrame, nodes: int) -> DataFrame:
    return books.withColumn("node", F.pmod("i", F.lit(nodes)).cast("int"))


def place_striped(books: DataFrame, stripe: int, book: int, nodes: int) -> DataFrame:
    """books (file, nbooks, i) with ``node``, stripes of ``stripe`` bytes going round the nodes, and ``status``.

    A stripe that is no multiple of a book raises; a file whose size is no multiple of a stripe is refused: its books have no node.
    """
    check(stripe % book == 0, "InvalidParameter", "the stripe must be a multiple of the book")
    fits = F.pmod(F.col("nbooks") * book, F.lit(stripe)) == 0
    node = F.pmod(F.call_function("div", F.col("i"), F.lit(stripe // book).cast("long")), F.lit(nodes)).cast("int")
    return books.withColumns({"node": F.when(fits, node), "status": F.when(fits, "OK").otherwise("InvalidParameter")})


def topology(processes: DataFrame, cpus: DataFrame, per_node: int) -> DataFrame:
    """process, host, max_node, nearest: from the CPU that each process runs on, and the nodes of each host with the first of their per_node CPUs.

    Null where a host has no nodes, or none with that CPU.
    """
    most = cpus.groupBy("host").agg(F.max("node").cast("int").alias("max_node"))
    at = processes.withColumn("first_cpu", F.call_function("div", F.col("cpu").cast("long"), F.lit(per_node).cast("long")) * per_node)
    found = at.join(most, "host", "left").join(cpus.withColumn("first_cpu", F.col("first_cpu").cast("long")), ["host", "first_cpu"], "left")
    return found.select("process", "host", "max_node", F.col("node").cast("int").alias("nearest"))


def with_each(df: DataFrame, few: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """A row of df for each row of the few, which ``name`` holds as a struct; more than ``most`` of them raise."""
    rows = few.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to pair with")
    held = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, few.schema.fields)]) for r in rows]) if rows else F.array().cast(f"array<{few.schema.simpleString()}>")
    return df.withColumn(name, F.explode(held))


class MultiRegionFile:
    """Several files as one range of addresses: it is read by ``clip``, and cannot be made, cut or given attributes."""

    UNSUPPORTED = ("create", "truncate", "getxattr", "setxattr", "set_interleave_group")

    def __init__(self, paths: list[str]):
        self.paths = list(paths)

    def __getattr__(self, name: str):
        if name not in self.UNSUPPORTED:
            raise AttributeError(name)

        def refuse(*_, **__):
            raise SpaceError("NotSupported", name)

        return refuse


def book_range(offset: Column, length: Column, size: Column, book: int) -> tuple[Column, Column]:
    """First book and number of books of a byte range, clipped to the file."""
    end = F.least(offset + length, size)
    first = F.call_function("div", offset, F.lit(book).cast("long"))
    last = F.call_function("div", end + book - 1, F.lit(book).cast("long"))
    return first, F.greatest(last - first, F.lit(0).cast("long"))


def set_nodes(nodes: Column, first: Column, count: Column, wanted: Column) -> Column:
    """The node array with books [first, first + count) set to wanted[book mod its length]; the book number is absolute."""
    inside = lambda i: (i >= first) & (i < first + count)
    return F.transform(nodes, lambda x, i: F.when(inside(i), F.get(wanted, F.pmod(i, F.size(wanted)))).otherwise(x))
