"""Substring deduplication by content-defined chunks.

A gear rolling hash over the text's UTF-8 bytes cuts a chunk where its masked bits are zero, so a cut depends on the
bytes just before it only: after an insertion cuts fall into step again, and a repeated passage is cut alike wherever it
stands. A chunk goes from a cut to the third cut after it, so chunks overlap, are long enough not to recur by chance, and cover
a repeated passage from its first cut to its last. They are deduplicated by a 128-bit digest across the corpus.

What is shuffled is packed: a slice of texts gives each bucket of digests one row, with each of its digests once, and is
answered with the places of those that other slices have too. So a chunk costs some twenty bytes, however many recur, and a
chunk of many copies is one record of each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from spacemill.llm import kernels

U = np.uint64
#: Bytes that a cut depends on, and about the mean, the least and the greatest distance of cuts. A passage of 50 words has some twelve.
GEAR, MEAN, LEAST, MOST = 32, 20, 4, 512
#: Distances between cuts that make a chunk.
SPAN = 3
#: Not used any more, as there is no filter: callers may still give ``filter_hashes``.
FILTER_HASHES = 1 << 24
#: Bytes of text whose digests make a bucket, which one call holds; smaller corpora have up to EVEN buckets of at least SMALL bytes each.
BUCKET, EVEN, SMALL = 16 << 20, 256, 64 << 10


def cuts(data: np.ndarray, off: np.ndarray, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Cuts of all texts of a column, ascending; each text's end is one. A cut never falls inside a character.

    Whether a place is a cut is told by the bytes just before it: its gear hash, and that no other place within ``least`` bytes
    before has such a hash. Only distances over ``most`` bytes are cut evenly. Texts are worked on in segments.
    """
    n = int(off[-1])
    marks, threshold = [], np.uint32(2**32 // mean)
    for a in range(0, n, kernels.SEGMENT):
        lo, hi = max(0, a - GEAR + 1), min(a + kernels.SEGMENT, n)
        marks.append(np.flatnonzero(kernels.gear(data[lo:hi], GEAR)[a - lo :] < threshold) + (a + 1))
    c = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    c = c[c < n]
    # the last GEAR bytes decide, so there is no cut in the first of a text
    start = off[np.searchsorted(off, c, "right") - 1]
    c = c[c - start >= GEAR]
    c = c[np.concatenate(([True], np.diff(c) >= least))] if len(c) else c
    ends = np.union1d(c, off[1:][np.diff(off) > 0])
    size = np.diff(ends, prepend=0)
    long = np.flatnonzero(size > most)
    if len(long):
        parts = -(-size[long] // most) - 1
        first = np.repeat(ends[long] - size[long], parts)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        ends = np.union1d(ends, first + step * most)
    while len(inside := np.flatnonzero((ends < n) & ((data[np.minimum(ends, n - 1)] & 0xC0) == 0x80))):
        ends[inside] -= 1
    return np.unique(ends)


def part_hashes(data: np.ndarray, ends: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes up to each end, from the end before or from the given starts."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)] if starts is None else starts
    return kernels.span_hashes(data, starts, ends, laned=MOST)


def laid(ends: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each chunk that the cuts of a column's texts make. A text of fewer than SPAN parts is one chunk."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
    first = np.searchsorted(begins, off)
    parts = np.diff(first)
    n = np.where(parts >= SPAN, parts - SPAN + 1, parts > 0)
    text = np.repeat(np.arange(len(n)), n)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return begins[at], ends[np.minimum(at + SPAN, first[text + 1]) - 1] if len(at) else at, text


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and 64-bit hash of each chunk of a column's texts.

    The hash is of the chunk's bytes, as its digest is: where equal chunks are cut inside depends on what stands before them.
    """
    start, end, text = laid(cuts(data, off), off)
    return start, end, text, part_hashes(data, end, start)


def grouped(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the digests (rows of two numbers) that brings equal ones together, in the order they had, and where in it another begins."""
    order = np.argsort(digests[:, 0], kind="stable")
    x = digests[order]
    same = x[1:, 0] == x[:-1, 0]
    if (same & (x[1:, 1] != x[:-1, 1])).any():  # two digests that share a half
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        x = digests[order]
    return order, np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1)))[: len(order)]


def binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Lists of numbers below 2**32, given by the place of each one's first, as binaries: a list's lowest bytes, then its next ones, so that the high ones, mostly zero, compress."""
    n = np.repeat(np.diff(first), np.diff(first))
    base = np.arange(len(values)) + 3 * np.repeat(first[:-1], np.diff(first))
    out = np.empty(4 * len(values), np.uint8)
    for k in range(4):
        out[base + k * n] = (values >> (8 * k)) & 0xFF
    return binary(out, 4 * first)


def unpacked(a: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` was given; null is an empty list."""
    data, off = kernels.binaries(a)
    first = off // 4
    n = np.repeat(np.diff(first), np.diff(first))
    base = np.arange(int(first[-1])) + 3 * np.repeat(first[:-1], np.diff(first))
    return sum((data[base + k * n].astype(np.int64) << (8 * k) for k in range(4)), np.zeros(len(base), np.int64)), first


def steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of ascending numbers in lists, the distance to the one before in the list, or to zero."""
    out = np.diff(values, prepend=0)
    at = first[:-1][np.diff(first) > 0]
    out[at] = values[at]
    return out


def climbed(step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The numbers of which ``steps`` are given."""
    total = np.concatenate(([0], np.cumsum(step)))
    return total[1:] - np.repeat(total[first[:-1]], np.diff(first))


def asked(ids: pa.Array, data: np.ndarray, off: np.ndarray, buckets: int, kind: pa.Schema, slice_: int) -> pa.RecordBatch:
    """The rows that a slice of texts, in the order of ids, sends out: one to each bucket, and one with its cuts, which goes through to itself.

    A bucket's row has the digests with their first places among the slice's chunks, and the ids of these places' texts. ``codes``
    are steps of places, doubled, plus one where a text is the first time met; in the row of cuts, the sizes of the parts.
    ``twins`` tells the other places of a digest and how far back the first is.
    """
    ends = cuts(data, off)
    start, end, text = laid(ends, off)
    raw = data.tobytes()
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())]), np.uint64).reshape(-1, 2)
    order, new = grouped(digests)
    of = np.empty(len(order), np.int64)
    of[order] = order[new][np.cumsum(new) - 1]
    place = np.flatnonzero(of == np.arange(len(of)))
    twin = np.flatnonzero(of != np.arange(len(of)))
    bucket = (digests[place, 0] % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    by = np.argsort(bucket, kind="stable")
    place, bucket = place[by], bucket[by].astype(np.int64)
    first = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    rows = len(first) - 1
    head = np.zeros(len(place), bool)
    head[first[:-1]] = True
    fresh = head | (np.diff(text[place], prepend=-1) != 0)
    met = np.concatenate(([0], np.cumsum(fresh)))[first]
    stamp = xxhash.xxh3_64_intdigest(raw + off.tobytes() + repr(ids.to_pylist()).encode()) >> 1
    parts = np.diff(np.searchsorted(ends, off, "right"))
    whole = lambda x: packed(x, np.array([0, len(x)]))
    none = lambda n: pa.nulls(n, pa.binary())
    every = np.concatenate((text[place][fresh], np.arange(len(ids))))
    cols = {
        "bucket": pa.array(np.append(bucket[first[:-1]], stamp % buckets).astype(np.int32)),
        "slice": pa.array(np.full(rows + 1, slice_, np.int64)),
        "stamp": pa.array(np.full(rows + 1, stamp, np.int64)),
        "answers": pa.array([None] * rows + [rows], pa.int32()),
        "ids": pa.ListArray.from_arrays(pa.array(np.append(met, met[-1] + len(ids)).astype(np.int32)), ids.take(pa.array(every))),
        "codes": pa.concat_arrays([packed(2 * steps(place, first) + fresh, first), whole(np.diff(ends, prepend=0))]),
        "digests": pa.concat_arrays([binary(digests[place].view(np.uint8).reshape(-1), 16 * first), none(1)]),
        "parts": pa.concat_arrays([none(rows), whole(parts)]),
        "twins": pa.concat_arrays([none(rows), whole(np.concatenate((np.diff(twin, prepend=0), twin - of[twin])))]),
    }
    return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in kind], schema=kind)


def answered(rows: pa.Table) -> pa.Table:
    """Rows of one bucket: each slice's with the places of its digests that other slices have too, as steps, doubled, plus one where the digest's home is there. Rows of cuts go through."""
    through = rows.filter(pc.is_valid(rows["answers"]))
    rows = rows.filter(pc.is_null(rows["answers"]))
    code, first = unpacked(rows["codes"])
    row, fresh = np.repeat(np.arange(len(first) - 1), np.diff(first)), code & 1
    place, doc = climbed(code >> 1, first), np.cumsum(fresh) - 1
    order, new = grouped(kernels.binaries(rows["digests"])[0].view(np.uint64).reshape(-1, 2))
    group = np.cumsum(new) - 1
    shared = (np.bincount(group) > 1)[group] if len(group) else new
    at, group = order[shared], group[shared]
    ids = pc.list_flatten(rows["ids"]).take(pa.array(doc[at]))
    rank = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64) if len(at) else at
    # a digest is in a row once, and a slice's places are in the order of ids
    by = np.lexsort((rows["slice"].to_numpy()[row[at]], rank, group))
    at, home = at[by], np.diff(group[by], prepend=-1) != 0
    by = np.argsort(at)
    at, home = at[by], home[by]
    found = np.searchsorted(row[at], np.arange(rows.num_rows + 1))
    codes = packed(2 * steps(place[at], found) + home, found)
    rows = rows.set_column(rows.schema.get_field_index("codes"), "codes", codes).set_column(rows.schema.get_field_index("ids"), "ids", pa.nulls(rows.num_rows, rows.schema.field("ids").type))
    return pa.concat_tables([through, rows]).select(["slice", "stamp", "answers", "ids", "codes", "parts", "twins"])


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans, those that overlap or touch joined, ascending."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1]))) if len(start) else np.zeros(0, np.int64)
    return start[new], reach[np.append(new[1:], len(start)) - 1] if len(new) else start[new]


def marked(start: np.ndarray, end: np.ndarray, away: np.ndarray, least: int) -> tuple[tuple, np.ndarray, np.ndarray, tuple]:
    """Of repeated chunks: the joined spans of at least ``least`` bytes, which chunks are in them, which of those are away from home, and the joined spans of these."""
    lo, hi = runs(start, end)
    lo, hi = lo[hi - lo >= least], hi[hi - lo >= least]
    at = np.searchsorted(lo, start, "right") - 1
    inside = (at >= 0) & (end <= hi[at]) if len(lo) else np.zeros(len(start), bool)
    gone = inside & away
    return (lo, hi), inside, gone, runs(start[gone], end[gone])


def counted(start: np.ndarray, end: np.ndarray, away: np.ndarray, least: int) -> tuple[tuple, int, int, tuple]:
    """Of a document's repeated chunks what ``marked`` gives, the chunks counted."""
    joined, inside, gone, removed = marked(start, end, away, least)
    return joined, int(inside.sum()), int(gone.sum()), removed


def assembled(rows: pa.Table, least: int, kind: pa.Schema) -> pa.Table:
    """The result's rows of one slice, from its row of cuts and its answers."""
    own = rows.filter(pc.is_valid(rows["answers"]))
    rows = rows.filter(pc.is_null(rows["answers"]))
    if own.num_rows != 1 or rows.num_rows != own["answers"][0].as_py() or not pc.all(pc.equal(rows["stamp"], own["stamp"][0]), min_count=0).as_py():
        raise RuntimeError("docs gave other rows, or the same in another order, when a lost task was run again: stage them first")
    ids = pc.list_flatten(own["ids"]).combine_chunks()
    ends, parts = np.cumsum(unpacked(own["codes"])[0]), unpacked(own["parts"])[0]
    off = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(parts)))]
    start, end, text = laid(ends, off)
    of, twins = np.arange(len(text)), unpacked(own["twins"])[0]
    step, back = twins[: len(twins) // 2], twins[len(twins) // 2 :]
    twin = np.cumsum(step)
    of[twin] -= back
    code, first = unpacked(rows["codes"])
    place = climbed(code >> 1, first)
    # a digest is repeated where another slice has it or it has a twin here; away is all but the first place in the slice that is its home
    repeated, away = np.zeros(len(text), bool), np.zeros(len(text), bool)
    repeated[place], away[place] = True, (code & 1) == 0
    repeated[of[twin]] = True
    repeated, away = repeated[of], away[of] | (of != np.arange(len(of)))
    # a byte between texts keeps their spans apart
    at = np.flatnonzero(repeated)
    spans_, inside, gone, removed = marked(start[at] + text[at], end[at] + text[at], away[at], least)
    border = off + np.arange(len(off))
    each = lambda x: pa.array(np.bincount(x, minlength=len(ids)).astype(np.int64))

    def listed(spans: tuple[np.ndarray, np.ndarray], t: pa.DataType) -> pa.Array:
        to = np.searchsorted(spans[0], border)
        by = np.repeat(border[:-1], np.diff(to))
        return pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.StructArray.from_arrays([pa.array(spans[0] - by), pa.array(spans[1] - by)], fields=list(t.value_type))).cast(t)

    lists = [listed(s, kind.field(n).type) for s, n in ((spans_, "repeat_spans"), (removed, "removed_spans"))]
    some = pc.greater(pc.list_value_length(lists[0]), 0)
    return pa.Table.from_arrays([ids.cast(kind.field(0).type), each(text), each(text[at[inside]]), each(text[at[gone]]), some, *lists], schema=kind)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = 100, filter_hashes: int = FILTER_HASHES) -> DataFrame:
    """One row per row of docs: id, n_chunks, n_repeated, n_removed, repeated, repeat_spans and removed_spans (arrays of byte spans).

    A chunk is repeated when its digest occurs more than once in the corpus. Repeated chunks that overlap or touch make a span;
    spans of at least least_bytes count: ``repeated`` tells whether there are any, ``n_repeated`` is the chunks in them. Of each
    digest the occurrence with the smallest (id, start) is its home and stays; ``removed_spans`` joins the others that lie in
    counted spans, n_removed of them. Null and empty texts have none; null ids come after others; rows that repeat an id are
    documents of their own, and of equal rows one is home. Other columns are not looked at. An empty table gives no rows. Ids are
    of an atomic type. ``filter_hashes`` has no effect any more: all chunks go the same, packed way.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(EVEN, size // SMALL), size // BUCKET)
    id_type = texts.schema["id"].dataType
    ids, long, blob = ArrayType(id_type), LongType(), BinaryType()
    answer = [("slice", long), ("stamp", long), ("answers", IntegerType()), ("ids", ids), ("codes", blob), ("parts", blob), ("twins", blob)]
    question = StructType([StructField(n, t) for n, t in [("bucket", IntegerType()), *answer, ("digests", blob)]])
    answer = StructType([StructField(n, t) for n, t in answer])
    span = ArrayType(StructType([StructField("start", long), StructField("end", long)]))
    result = [("id", id_type), ("n_chunks", long), ("n_repeated", long), ("n_removed", long), ("repeated", BooleanType()), ("repeat_spans", span), ("removed_spans", span)]
    result = StructType([StructField(n, t) for n, t in result])
    asks, tells = (to_arrow_schema(t) for t in (question, result))

    def ask(batches: Iterator[pa.RecordBatch]):
        slice_ = TaskContext.get().partitionId() << 33
        for batch in kernels.slices(batches, "text"):
            batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_end"))
            yield asked(batch.column(0), *kernels.column(batch, "text"), buckets, asks, slice_)
            slice_ += 1

    def tell(rows: pa.Table) -> pa.Table:
        return assembled(rows, least_bytes, tells)

    found = texts.mapInArrow(ask, question).groupBy("bucket").applyInArrow(answered, answer)
    return found.groupBy("slice").applyInArrow(tell, result).select(F.col("id").alias(id_col), *result.names[1:])
