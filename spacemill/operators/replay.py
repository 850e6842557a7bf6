"""Allocation logs replayed heap by heap: the state machines, and their batch form.

A heap is serial by nature, so work is spread over heaps only. The batch form streams each heap's sorted rows
through its machine, so memory holds one heap's state and never its log.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spacemill.functions.geometry import ALIGN, SIZE_CLASSES, SLAB_FIXED
from spacemill.session import partitions

OK, OUT_OF_MEMORY, INVALID = "OK", "OUT_OF_MEMORY", "INVALID_ADDRESS"


class FreeMap:
    """Free extents by address and by (length, address); neighbours that touch are always merged."""

    def __init__(self, nblocks: int = 0):
        self.by_start: list[tuple[int, int]] = []
        self.by_len: list[tuple[int, int]] = []
        if nblocks:
            self.free(0, nblocks)

    def _take(self, at: int) -> tuple[int, int]:
        start, length = self.by_start.pop(at)
        del self.by_len[bisect_left(self.by_len, (length, start))]
        return start, length

    def free(self, start: int, length: int) -> None:
        """Puts the extent in, merged with every extent it overlaps or touches."""
        end, i = start + length, bisect_left(self.by_start, (start, -1))
        if i and sum(self.by_start[i - 1]) >= start:
            i -= 1
        while i < len(self.by_start) and self.by_start[i][0] <= end:
            s, n = self._take(i)
            start, end = min(s, start), max(s + n, end)
        self.by_start.insert(i, (start, end - start))
        insort(self.by_len, (end - start, start))

    def best_fit(self, n: int) -> tuple[int, int] | None:
        i = bisect_left(self.by_len, (n, -1))
        return self.by_len[i][::-1] if n >= 1 and i < len(self.by_len) else None

    def alloc(self, n: int) -> int | None:
        """The start of n blocks from the best fit, whose tail goes back."""
        found = self.best_fit(n)
        if not found:
            return None
        start, length = self._take(bisect_left(self.by_start, found))
        if length > n:
            self.free(start + n, length - n)
        return start

    def total(self) -> int:
        return sum(n for _, n in self.by_start)


class ExtentHeap:
    """Blocks handed out and taken back as extents; the oldest live extent is the one a log frees."""

    def __init__(self, nblocks: int = 64):
        self.map, self.live = FreeMap(nblocks), deque()

    def step(self, op: str, n: int) -> dict:
        if op == "A":
            start = self.map.alloc(n)
            if start is None:
                return {"status": OUT_OF_MEMORY, "start": None, "len": None}
            self.live.append((start, n))
        elif self.live:
            start, n = self.live.popleft()
            self.map.free(start, n)
        else:
            return {"status": INVALID, "start": None, "len": None}
        return {"status": OK, "start": start, "len": n}


def slab_capacity(slab_bytes: int, block: int) -> int:
    most = (slab_bytes - SLAB_FIXED - 1) * 8 // (1 + 8 * block)
    header = -(-(SLAB_FIXED + -(-most // 8)) // ALIGN) * ALIGN
    return (slab_bytes - header) // block


class Slab:
    """Blocks of one class; freed blocks are handed out again last in, first out."""

    def __init__(self, slab_id: int, start: int, slab_bytes: int, cls: int):
        self.id, self.start, self.bytes = slab_id, start, slab_bytes
        self.format(cls)

    def format(self, cls: int) -> None:
        self.cls, self.nblocks = cls, slab_capacity(self.bytes, SIZE_CLASSES[cls])
        self.used, self.fresh, self.back = 0, 0, []

    def alloc(self) -> int | None:
        if self.used == self.nblocks:
            return None
        self.used += 1
        if self.back:
            return self.back.pop()
        self.fresh += 1
        return self.fresh - 1

    def free(self, block: int) -> None:
        self.used -= 1
        self.back.append(block)

    def bin(self) -> int:
        return 2 * self.used // self.nblocks


class SlabHeap:
    """Slabs by class and fullness, fullest first and latest in first; empty slabs wait in a list of their own."""

    def __init__(self, parent: FreeMap, slab_blocks: int, block_bytes: int = 4096):
        self.parent, self.slab_blocks, self.slab_bytes = parent, slab_blocks, slab_blocks * block_bytes
        self.bins: dict[tuple[int, int], list[int]] = {}
        self.slabs: dict[int, Slab] = {}
        self.empty: list[int] = []

    def insert(self, s: Slab) -> None:
        (self.empty if not s.used else self.bins.setdefault((s.cls, s.bin()), [])).append(s.id)

    def remove(self, s: Slab, used: bool, at: int) -> None:
        (self.bins[s.cls, at] if used else self.empty).remove(s.id)

    def find(self, cls: int) -> Slab | None:
        """The latest slab of the fullest bin that has room."""
        return next((self.slabs[self.bins[cls, b][-1]] for b in (1, 0) if self.bins.get((cls, b))), None)

    def acquire(self, cls: int) -> Slab | None:
        """A slab with room: a partial one, an empty one (formatted anew where its class differs), or a new extent."""
        s = self.find(cls)
        if s:
            return s
        if self.empty:
            s = self.slabs[self.empty[-1]]
            if s.cls != cls:
                s.format(cls)
            return s
        start = self.parent.alloc(self.slab_blocks)
        if start is None:
            return None
        s = self.slabs[start] = Slab(start, start, self.slab_bytes, cls)
        self.insert(s)
        return s

    def malloc(self, size: int) -> tuple[int, int, int] | None:
        """(class, slab, block), or None where neither a slab nor an extent is left."""
        cls = next((i for i, b in enumerate(SIZE_CLASSES) if b >= size), None)
        s = self.acquire(cls) if cls is not None else None
        if s is None or slab_capacity(self.slab_bytes, SIZE_CLASSES[cls]) < 1:
            return None
        used, at = bool(s.used), s.bin()
        block = s.alloc()
        if not used or s.bin() != at:
            self.remove(s, used, at)
            self.insert(s)
        return cls, s.id, block

    def free(self, slab: int, block: int) -> None:
        s = self.slabs[slab]
        at = s.bin()
        s.free(block)
        if not s.used or s.bin() != at:
            self.remove(s, True, at)
            self.insert(s)


class HybridHeap:
    """Requests under ``big`` bytes go to slabs, others to extents of the same heap."""

    def __init__(self, nblocks: int = 1024, slab_blocks: int = 64, big: int = 8192, block_bytes: int = 4096):
        self.map = FreeMap(nblocks)
        self.small = SlabHeap(self.map, slab_blocks, block_bytes)
        self.big, self.block_bytes, self.live = big, block_bytes, deque()

    def step(self, op: str, size: int) -> dict:
        none = {"route": None, "cls": None, "slab": None, "block": None, "start": None, "stored": None}
        if op == "A":
            if size < self.big:
                got = self.small.malloc(size)
                if got is None:
                    return none | {"status": OUT_OF_MEMORY, "route": "small"}
                self.live.append(("small", *got))
            else:
                n = -(-size // self.block_bytes)
                start = self.map.alloc(n)
                if start is None:
                    return none | {"status": OUT_OF_MEMORY, "route": "big"}
                self.live.append(("big", start, n))
            return self._row(self.live[-1])
        if not self.live:
            return none | {"status": INVALID}
        x = self.live.popleft()
        if x[0] == "small":
            self.small.free(x[2], x[3])
        else:
            self.map.free(x[1], x[2])
        return self._row(x)

    def _row(self, x: tuple) -> dict:
        if x[0] == "small":
            return {"status": OK, "route": "small", "cls": x[1], "slab": x[2], "block": x[3], "start": None, "stored": SIZE_CLASSES[x[1]]}
        return {"status": OK, "route": "big", "cls": None, "slab": None, "block": None, "start": x[1], "stored": x[2] * self.block_bytes}


EXTENT_ROWS = "heap long, seq long, op string, n long, status string, start long, len long"
HYBRID_ROWS = "heap long, seq long, op string, size long, status string, route string, cls int, slab long, block long, start long, stored long"


def replay(log: DataFrame, machine: Callable, schema: str, key: str = "heap", order: str = "seq", size: str = "n") -> DataFrame:
    """Each log row with what its heap's machine answers, heap by heap in order.

    machine() makes a heap; its step(op, size) answers a row. Rows of one heap must differ in ``order``.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, m = None, None
        for batch in batches:
            out = []
            for k, o, op, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if m is None or k != heap:
                    heap, m = k, machine()
                out.append({key: k, order: o, "op": op, size: n, **m.step(op, n)})
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    rows = log.select(key, order, "op", size)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def lives(rows: DataFrame, end: int, key: str = "heap") -> DataFrame:
    """key, seq, until, start, len, returned: each extent handed out in a replay, with the step that took it back, or the end.

    The k-th free of a heap takes back its k-th extent; returned says whether it is the same blocks. All of a heap is in one partition,
    and adaptive execution does not join the partitions, as rows become many when they are dealt over steps.
    """
    ok = rows.where(F.col("status") == OK).repartition(partitions(rows), key)
    turn = ok.withColumn("_turn", F.row_number().over(W.partitionBy(key, "op").orderBy("seq")))
    one = lambda op: F.max(F.when(F.col("op") == op, F.struct("seq", "start", "len")))
    pairs = turn.groupBy(key, "_turn").agg(one("A").alias("a"), one("F").alias("f")).where("a is not null")
    same = (F.col("a.start") == F.col("f.start")) & (F.col("a.len") == F.col("f.len"))
    return pairs.select(key, "a.seq", F.coalesce("f.seq", F.lit(end).cast("long")).alias("until"), "a.start", "a.len", F.coalesce(same, F.lit(True)).alias("returned"))


def held_twice(live: DataFrame, nblocks: int, key: str = "heap") -> DataFrame:
    """key, overlaps: how many blocks beyond one hold each block at each step from seq to before until, summed.

    An extent is a row each step, not each block: of a step's extents the lengths are summed, and their blocks joined as words of 64 bits.
    """
    start, end = F.col("start"), F.col("start") + F.col("len")

    def mask(i: int):
        lo, hi = F.greatest(start - 64 * i, F.lit(0)), F.least(end - 64 * i, F.lit(64))
        ones = lambda n: F.when(n >= 64, F.lit(-1)).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int"))))
        return F.when(hi > lo, ones(hi).bitwiseAND(F.bitwise_not(ones(lo)))).otherwise(0).cast("long")

    names = [f"_w{i}" for i in range(-(-nblocks // 64))]
    masked = live.select(key, "seq", "until", "len", *[mask(i).alias(n) for i, n in enumerate(names)])
    steps = masked.select(key, F.explode(F.sequence("seq", F.col("until") - 1)).alias("_at"), "len", *names)
    joined = steps.groupBy(key, "_at").agg(F.sum("len").alias("_held"), *[F.bit_or(n).alias(n) for n in names])
    distinct = sum((F.bit_count(n) for n in names), F.lit(0))
    return joined.groupBy(key).agg(F.sum(F.col("_held") - distinct).alias("overlaps"))
