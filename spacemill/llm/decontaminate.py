"""Benchmark decontamination by a distributed positional inverted index.

1. The index holds every occurrence of every word of the corpus. It is partitioned by documents: a segment covers a slice of
   the corpus and is a row with its dictionary, a position list for each word, and its documents. Segments are
   written by the tasks that read the texts, so building it shuffles nothing, and a frequent word's list is spread over all segments.
2. Benchmark items are cut into windows of words. A window's words are ranked by their frequency in the corpus, which
   is summed from the dictionaries; windows with a word that the corpus lacks are gone by then.
3. Windows are sought in blocks of bounded size. In each segment the list of a window's rarest word gives the places, and the
   lists of its next rarer words, shifted by their offsets in the window, are intersected with them one after the other: all
   words at their places make an exact phrase, and the rarest words at most ``slop`` places off make a proximity match.

Words are compared as words, never as hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from spacemill.llm import kernels
from spacemill.llm.common import dropping, others, stage

#: Bytes of windows and item ids that are sent to every task at once; a larger benchmark is sought in several passes over the index.
BLOCK_BYTES = 8 << 20
#: Places that are looked at at once.
PLACES = 1 << 18


def _strings(raw: bytes, s: np.ndarray, e: np.ndarray) -> list[str]:
    return [raw[a:b].decode() for a, b in zip(s.tolist(), e.tolist())]


def windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """terms, items: each distinct window's words in order, and the ids (as strings, sorted) of the items that have it.

    ``size`` consecutive words of an item are a window; a shorter item is one window if it has words at all. Null ids are no items.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in kernels.slices(batches, "text"):
            data, off = kernels.column(batch, "text")
            _, first, s, e = kernels.words(data, off, kernels.ALNUM, spans=True)
            words = _strings(kernels.LOWER[data].tobytes(), s, e)
            terms, ids = [], []
            for i, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                n = min(size, b - a)
                for k in range(a, b - n + 1 if n else a):
                    terms.append(words[k : k + n])
                    ids.append(i)
                if len(ids) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.string())), pa.array(ids, pa.string())], ["terms", "item"])
                    terms, ids = [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.string())), pa.array(ids, pa.string())], ["terms", "item"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "terms array<string>, item string").groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, of which the upper ones are mostly zero and compress to little."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def build_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The stored index: segment, n_words, terms (its words), counts (places of each), places, and docs (first place, n_words, and ``own``, the columns of docs but for the text).

    ``places`` has the words' ascending places in the segment, word after word, each but a word's first as the distance from
    the one before, in byte planes: some two bytes a word of the corpus. A segment is a slice of at most kernels.SLICE
    bytes of text, or one longer text. Null and empty texts are documents without words.
    """
    own = [f for f in docs.schema.fields if f.name != text_col]
    doc = StructType([StructField("first", IntegerType()), StructField("n_words", LongType()), StructField("own", StructType(own or [StructField("none", IntegerType())]))])
    kind = StructType([
        StructField("segment", LongType()), StructField("n_words", IntegerType()), StructField("terms", ArrayType(StringType())), StructField("counts", ArrayType(IntegerType())),
        StructField("places", BinaryType()), StructField("docs", ArrayType(doc)),
    ])
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]):
        base = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(kernels.slices(batches, text_col)):
            data, off = kernels.column(batch, text_col)
            h, first, s, e = kernels.words(data, off, kernels.ALNUM, spans=True)
            low = kernels.LOWER[data]
            code, at = kernels.vocabulary(low, s, e, h)
            order = np.argsort(code, kind="stable")
            counts = np.bincount(code, minlength=len(at))
            gaps = np.diff(order, prepend=0)
            begins = np.cumsum(counts) - counts
            gaps[begins] = order[begins]
            terms = pa.array([_strings(low.tobytes(), s[at], e[at])], pa.list_(pa.string()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names] or [pa.nulls(batch.num_rows, pa.int32())]
            rows = pa.StructArray.from_arrays([pa.array(first[:-1], pa.int32()), pa.array(np.diff(first), pa.int64()), pa.StructArray.from_arrays(columns, names or ["none"])], ["first", "n_words", "own"])
            listed = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + n], pa.int64()), pa.array([len(h)], pa.int32()), terms, pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([_planes(gaps)], pa.binary()), listed],
                ["segment", "n_words", "terms", "counts", "places", "docs"],
            )

    return stage(docs.select(*names, text_col).mapInArrow(run, kind), "decontaminate-index")


def term_frequencies(index: DataFrame, terms: DataFrame, few: bool = True) -> DataFrame:
    """term, freq: the corpus frequency of each of the given distinct terms that occurs, from the dictionaries alone. ``few`` tells that the terms may be broadcast."""
    rows = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").cast("long").alias("n"))
    rows = rows.join(F.broadcast(terms), "term", "left_semi") if few else rows
    freq = rows.groupBy("term").agg(F.sum("n").alias("freq"))
    return freq if few else freq.join(terms, "term", "left_semi")


def anchors(wins: DataFrame, freq: DataFrame) -> DataFrame:
    """terms, items, and ranked: the offsets of a window's terms, the rarest in the corpus first, ties by offset. Windows with a term of no occurrence are left out."""
    pos = wins.select("terms", F.posexplode("terms").alias("offset", "term"))
    ranked = pos.join(freq, "term").groupBy("terms").agg(F.array_sort(F.collect_list(F.struct("freq", "offset"))).alias("_a"))
    return ranked.where(F.size("_a") == F.size("terms")).select("terms", F.transform("_a", lambda a: a["offset"]).alias("ranked")).join(wins, "terms")


class Block:
    """Windows as arrays: the number of a window's word of each rank, and that word's offset; -1 beyond its size."""

    def __init__(self, rows: list[tuple[list[str], list[int], list[str]]]):
        vocabulary: dict[str, int] = {}
        width = max((len(t) for t, _, _ in rows), default=1)
        self.term, self.offset = np.full((len(rows), width), -1), np.zeros((len(rows), width), np.int64)
        for i, (terms, ranked, _) in enumerate(rows):
            self.term[i, : len(terms)] = [vocabulary.setdefault(terms[o], len(vocabulary)) for o in ranked]
            self.offset[i, : len(terms)] = ranked
        self.size = np.array([len(t) for t, _, _ in rows], np.int64)
        self.terms = pa.array(list(vocabulary), pa.string())
        self.items = [x for _, _, x in rows]


def _found(block: Block, terms: pa.Array, counts: np.ndarray, places: np.ndarray, first: np.ndarray, n_words: int, rarest: int, slop: int) -> tuple[np.ndarray, ...]:
    """Matches of a block's windows in a segment: window, place of its first word, document, and whether exact."""
    numbers = pc.index_in(block.terms, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = np.append(numbers, -1)
    ends = np.cumsum(counts)
    begins = ends - counts
    # which word stands at a place: an intersection with a word's list is a look at this
    standing = np.empty(n_words, np.int64)
    standing[places] = np.repeat(np.arange(len(counts)), counts)
    last = np.append(first[1:], n_words)
    number = np.where(block.term >= 0, numbers[block.term], -2)
    asked = number[:, : rarest if slop else number.shape[1]]
    alive = np.flatnonzero((asked != -1).all(axis=1))
    total = np.cumsum(counts[number[alive, 0]])
    out = []
    a = 0
    while a < len(alive):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PLACES, "right")))
        rare = number[alive[a:b], 0]
        n = counts[rare]
        w = np.repeat(alive[a:b], n)
        at = places[np.repeat(begins[rare] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        a = b
        doc = np.searchsorted(first, at, "right") - 1
        lo, hi = first[doc], last[doc]
        start = at - block.offset[w, 0]
        if slop:
            for r in range(1, min(rarest, number.shape[1])):
                code, place = number[w, r], start + block.offset[w, r]
                near = code == -2
                for d in range(-slop, slop + 1):
                    x = place + d
                    ok = (x >= lo) & (x < hi)
                    near |= ok & (standing[np.where(ok, x, 0)] == code)
                w, start, doc, lo, hi = (x[near] for x in (w, start, doc, lo, hi))
        exact = (start >= lo) & (start + block.size[w] <= hi)
        if not slop:
            w, start, doc, lo, hi, exact = (x[exact] for x in (w, start, doc, lo, hi, exact))
        for r in range(1, number.shape[1]):
            code = number[w, r]
            hit = (code == -2) | (exact & (standing[np.where(exact, start + block.offset[w, r], 0)] == code))
            exact &= hit
            if not slop:
                w, start, doc, exact = w[exact], start[exact], doc[exact], exact[exact]
        out.append((w, start, doc, exact))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)


MATCH = "rid struct<segment:long,doc:int>, start int, size int, exact boolean, items array<string>"


def matches(index: DataFrame, sought: DataFrame, rarest: int = 3, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """Staged, one for each block of windows: rid (segment, and the document's number in it), start (the place in the document of the window's first word), size (of the window), exact, items: a row a match.

    A proximity match (exact false) is a place of a window's rarest word at which its other ``rarest`` words stand in the
    document at most slop places off theirs, but the window not exactly; there are none without a slop. Blocks are made by a hash of
    the window, as many as the windows' bytes ask for, and sent to the tasks one after the other.
    """
    spark = index.sparkSession
    weight = F.octet_length(F.array_join("terms", " ")) + F.octet_length(F.array_join("items", " ")) + 100
    total = sought.agg(F.sum(weight.cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rid = [pa.field("segment", pa.int64()), pa.field("doc", pa.int32())]
    out = []
    for k in range(blocks):
        rows = [(r["terms"], r["ranked"], r["items"]) for r in sought.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == k).select("terms", "ranked", "items").collect()]
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(Block(rows))

        def run(batches, sent=sent):
            block = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    counts = batch.column(3)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    if not len(counts):
                        continue
                    begins = np.cumsum(counts) - counts
                    gaps = _from_planes(batch.column(4)[i].as_buffer())
                    places = np.cumsum(gaps)
                    places -= np.repeat(places[begins] - gaps[begins], counts)
                    first = batch.column(5)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    w, start, doc, exact = _found(block, batch.column(2)[i].values, counts, places, first, batch.column(1)[i].as_py(), rarest, slop)
                    for a in range(0, len(w), 10_000):
                        v, d = w[a : a + 10_000], doc[a : a + 10_000]
                        where = pa.StructArray.from_arrays([pa.array(np.full(len(v), batch.column(0)[i].as_py())), pa.array(d.astype(np.int32))], fields=rid)
                        yield pa.RecordBatch.from_arrays(
                            [where, pa.array((start[a : a + 10_000] - first[d]).astype(np.int32)), pa.array(block.size[v].astype(np.int32)), pa.array(exact[a : a + 10_000]), pa.array([block.items[x] for x in v.tolist()], pa.list_(pa.string()))],
                            ["rid", "start", "size", "exact", "items"],
                        )

        slim = index.select("segment", "n_words", "terms", "counts", "places", F.col("docs.first").alias("first"))
        out.append(stage(slim.mapInArrow(run, MATCH), "decontaminate-matches"))
        sent.unpersist()
    return out


#: Distinct benchmark words up to which they are broadcast to count them (some 10 MB); beyond, the corpus's dictionary is summed whole.
BROADCAST_ROWS = 100_000


def find(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = 3, slop: int = 0, text_col: str = "text", block_bytes: int = BLOCK_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(the index, matches). Null and empty texts have no words and no matches; a null item id is no item; equal items share windows."""
    kept: list[DataFrame] = []
    with dropping(docs.sparkSession, kept):
        wins = stage(windows(items, size), "benchmark-windows")
        index = build_index(docs, text_col)
        terms = wins.select(F.explode("terms").alias("term")).distinct()
        freq = stage(term_frequencies(index, terms, terms.count() <= broadcast_rows), "benchmark-terms")
        sought = stage(anchors(wins, freq), "benchmark-anchors")
        found = matches(index, sought, rarest, slop, block_bytes)
        kept += [index, *found]
    empty = docs.sparkSession.createDataFrame([], MATCH)
    return index, reduce(DataFrame.unionByName, found) if found else empty


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text", slop: int = 2, **more) -> DataFrame:
    """The columns of docs but for the text, with n_words, n_hit, n_items, items_sha256, contaminated and n_near.

    A word inside any occurrence of a window is hit; n_items counts the items with occurring windows, and items_sha256
    is the digest of their ids, sorted as strings and comma-joined. n_near counts proximity matches, which contaminate
    nothing. Null and empty texts have no words and no hits; rows that repeat an id each have their own text's result; an empty table
    gives no rows, an empty benchmark no hits. Columns of docs with these names, in any case, are replaced.
    """
    new = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"}
    docs = docs.select(*[f"`{c}`" for c in others(docs, new, text_col)])
    index, found = find(docs, items, size, text_col=text_col, slop=slop, **more)
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def grow(acc, s):
        end = s["start"] + s["size"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["upto"], s["start"]))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + new).alias("n"))

    # matches of a document are bounded by its length times the windows at a place
    at = F.collect_set(F.when(F.col("exact"), F.struct("start", "size")))
    per = found.groupBy("rid").agg(F.array_sort(at).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("exact"), F.col("items")))))).alias("ids"), F.count_if(~F.col("exact")).alias("n_near"))
    per = per.select("rid", F.aggregate("hit", zero, grow)["n"].alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("ids"), "n_near")
    each = index.select("segment", F.posexplode("docs").alias("doc", "d")).select(F.struct("segment", "doc").alias("rid"), "d.n_words", "d.own")
    out = each.join(per, "rid", "left")
    none = F.lit(0).cast("long")
    own = [F.col(f"own.`{f.name}`").alias(f.name) for f in index.schema["docs"].dataType.elementType["own"].dataType.fields if len(docs.columns) > 1]
    n_hit = F.coalesce("n_hit", none)
    return out.select(
        *own, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"),
    )
