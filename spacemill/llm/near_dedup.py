"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Each document's set of word shingles, as 64-bit hashes; sets equal by 128 bits are one class and are worked on once.
2. A class's sketch is its k smallest hashes. Sketches of similar sets share most values, so by the prefix
   principle it is enough that classes meet in the inverted lists of their few rarest values.
3. Each list links its classes to two leaders; a union-sketch estimate filters, and the exact Jaccard of the full sets,
   on the words of both texts, verifies.
4. Lists whose classes then lie in several components are searched wholly, size band against size band and block against
   block: only estimates run there, and pairs of different components that pass are verified. So links are not cut by any cap on partners.

With ``exact`` sketches and lists hold whole sets, so that the bounds are those of the similarity itself and no pair is missed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spacemill.llm import kernels
from spacemill.llm.common import delete, dropping, lookup, salt_of, stage
from spacemill.llm.components import components

U = np.uint64
#: Values kept of a set for estimates, and those of them that are put into inverted lists; WHOLE keeps all.
SKETCH, LISTED = 256, 32
WHOLE = 1 << 30
#: Standard deviations by which an estimate may fall short before a pair is dropped, and by which listed overlaps may.
SIGMAS = 5.0
#: Classes of a long list that are compared with each other at once, and rows of such groups that are worked on together.
BLOCK, PACK = 512, 1024
#: Rows up to which the documents to verify are found by broadcast (some 80 MB); beyond, by a shuffled join.
BROADCAST_IDS = 1_000_000


def least_overlap(similarity: float, k: int = LISTED) -> int:
    """Listed values that two sketches of full length share, but for a chance of SIGMAS deviations."""
    return max(1, math.floor(k * similarity - SIGMAS * math.sqrt(k * similarity * (1 - similarity))))


def _set_id(full: tuple[np.ndarray, np.ndarray]) -> bytes | None:
    """128 bits of a set, from both hashes of its shingles."""
    return hashlib.blake2b(full[0].tobytes() + full[1].tobytes(), digest_size=16).digest() if len(full[0]) else None


#: What a row is found by again: its id, and its text's hash and length, since ids may repeat.
KEY = ["id", "text_hash", "text_size"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_size"), text.alias("text"))


def sketches(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", sketch: int = SKETCH) -> DataFrame:
    """id, text_hash, text_size, n_shingles, set_id (16 bytes, null for an empty set) and sketch (the smallest hashes, 8 bytes each)."""
    names = [*KEY, "n_shingles", "set_id", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in kernels.slices(batches, "text"):
            n, ids, sk = [], [], []
            for s in kernels.shingle_sets(*kernels.column(batch, "text"), shingle):
                n.append(max(len(s[0]), len(s[1])))
                ids.append(_set_id(s))
                sk.append(s[0][:sketch].tobytes() if len(s[0]) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sk, pa.binary())], names)

    rows = _keyed(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, text_size int, n_shingles long, set_id binary, sketch binary")


def _values(sketch: Column, n: int) -> Column:
    """The first n values of a sketch column, as binaries of 8 bytes each."""
    count = F.least(F.lit(n), (F.octet_length(sketch) / 8).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(sketch, i * 8 + 1, F.lit(8)))


def postings(classes: DataFrame, similarity: float, values: int = LISTED) -> DataFrame:
    """value, set_id, size, rare: the inverted lists, of the values by which classes must meet.

    A class with L listed values that must share s of them with any similar class is put into the lists of its L - s + 1
    rarest values by document frequency. Values of one class only meet nothing; ``rare`` counts them, ``size`` is the set's.
    """
    s = least_overlap(similarity, values)
    listed = F.least(F.lit(values), (F.octet_length("sketch") / 8).cast("int"))
    rows = classes.select("set_id", F.col("n_shingles").alias("size"), listed.alias("_l"), F.explode(_values(F.col("sketch"), values)).alias("value"))
    # staged, so that both sides of the join are plain shuffles, of which hot values can be split
    freq = stage(rows.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1"), "near-freq")
    common = rows.join(freq, "value")
    per = common.groupBy("set_id").agg(F.first("size").alias("size"), F.first("_l").alias("_l"), F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("_v"))
    rare = F.col("_l") - F.size("_v")
    must = F.least(F.lit(s), F.ceil(F.col("_l") * similarity - 1e-9).cast("int"))
    take = F.col("_l") - must + 1 - rare
    return per.select("set_id", "size", rare.alias("rare"), F.explode(F.slice("_v", F.lit(1), F.greatest(F.lit(0), take))).alias("p")).select("p.value", "p.freq", "set_id", "size", "rare")


def union_estimate(a: np.ndarray, b: np.ndarray, sketch: int = SKETCH) -> tuple[float, int]:
    """The Jaccard estimate of two sketches, and the size of the union sample it rests on.

    The sample is what either sketch holds up to the smaller of their largest values; a shorter sketch is its whole set.
    """
    top = U(2**64 - 1)
    limit = min(a[-1] if len(a) == sketch else top, b[-1] if len(b) == sketch else top)
    a, b = a[: np.searchsorted(a, limit, "right")], b[: np.searchsorted(b, limit, "right")]
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 0.0, union


def passes(estimate, union, size_a, size_b, similarity: float):
    """Whether a pair with this estimate may be similar: sizes allow it, and the estimate is not SIGMAS below, for a sample without replacement."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    whole = np.maximum(large, (small + large) / (1 + similarity))
    left = np.clip(1 - union / whole, 0, 1)
    slack = SIGMAS * np.sqrt(similarity * (1 - similarity) / np.maximum(union, 1) * left)
    return (small >= similarity * large - 1e-9) & (estimate >= similarity - slack - 1e-9)


def _filtered(pairs: DataFrame, active: DataFrame, similarity: float, sketch: int) -> DataFrame:
    """The pairs (a, b) whose union-sketch estimate passes."""
    c = active.select("set_id", "n_shingles", "sketch")
    left = c.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = c.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                e, u = union_estimate(np.frombuffer(sa, U), np.frombuffer(sb, U), sketch)
                keep.append(bool(passes(e, u, na, nb, similarity)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary")


def _among(df: DataFrame, ids: DataFrame, key: str | list[str], broadcast_ids: int) -> DataFrame:
    """df joined to the staged, distinct ids: by broadcast up to broadcast_ids of them, by a shuffled join beyond."""
    return df.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, key)


def _verified(pairs: DataFrame, active: DataFrame, docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, broadcast_ids: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union, told on words: the texts of the classes in pairs, and of no others, are read again."""
    ids = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    needed = stage(ids.join(active.select("set_id", "row_key"), "set_id").select("set_id", "row_key.*"), "near-needed")
    texts = stage(_among(_keyed(docs, id_col, text_col), needed, KEY, broadcast_ids).select("set_id", "text"), "near-texts")
    if texts.count() > needed.count():  # rows that repeat id and text
        texts = texts.groupBy("set_id").agg(F.first("text").alias("text"))
    side = lambda x: texts.select(F.col("set_id").alias(x), F.col("text").alias(f"t{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in kernels.slices(batches, "ta", "tb"):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
            which = pa.array(np.unique([at[x] for x in [*a, *b]], return_index=True)[1])
            text = pa.concat_arrays([batch.column(2), batch.column(3)]).take(which)
            sets = kernels.shingle_codes(*kernels.column(pa.RecordBatch.from_arrays([text], ["text"]), "text"), shingle)
            keep = []
            for i, j in zip(a, b):
                x, y = sets[at[i]], sets[at[j]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary").distinct()


def _dealt(lists: DataFrame, similarity: float, broadcast_ids: int) -> DataFrame:
    """Staged: a row for each group that a class of an open list is compared in: value, kind, band, x, y and side of the group, set_id, size and root of the class.

    lists: value, freq, set_id, size, root. A list of up to BLOCK classes is a group. Of a longer one the size bands meet
    themselves (kind 0) and the band below (kind 1), since similar sets lie in the same or in neighbouring bands; bands are dealt into
    blocks of about BLOCK classes, and every pair of blocks is a group. So a group is bounded whatever the list's length.
    """
    cols = ["set_id", "size", "root"]
    zero = F.lit(0)
    short = lists.where(F.col("freq") <= BLOCK).select("value", zero.alias("kind"), zero.cast("long").alias("band"), zero.alias("x"), zero.alias("y"), zero.alias("side"), *cols)
    # a little wider than the similarity asks, against rounding
    band = F.floor(F.log("size") / (math.log(1 / similarity) * (1 + 1e-6) if similarity < 1 else 1e-9)).cast("long")
    rows = lists.where(F.col("freq") > BLOCK).withColumn("band", band)
    n = stage(rows.groupBy("value", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")), "near-bands")
    few = n.count() <= broadcast_ids
    for name, shift in (("own", 0), ("below", 1), ("above", -1)):
        m = n.select("value", (F.col("band") + shift).alias("band"), F.col("n").alias(name))
        rows = rows.join(F.broadcast(m) if few else m, ["value", "band"], "left")
    i, one = F.pmod(F.xxhash64("set_id"), F.col("own")).cast("int"), F.lit(1)
    group = lambda k, band, x, y, side: F.struct(F.lit(k).alias("kind"), band.alias("band"), x.alias("x"), y.alias("y"), side.alias("side"))
    upto = lambda c: F.when(c > 0, F.sequence(zero, c - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.transform(upto(F.col("own")), lambda o: group(0, F.col("band"), F.least(i, o), F.greatest(i, o), F.when(i <= o, zero).otherwise(one)))
    down = F.transform(upto(F.coalesce("below", zero)), lambda o: group(1, F.col("band"), i, o, zero))
    up = F.transform(upto(F.coalesce("above", zero)), lambda o: group(1, F.col("band") + 1, o, i, one))
    long = rows.withColumn("g", F.explode(F.concat(inside, down, up))).select("value", "g.*", *cols)
    return stage(short.unionByName(long), "near-dealt")


def _blocks(dealt: DataFrame, classes: DataFrame, similarity: float, sketch: int) -> DataFrame:
    """Pairs (a, b) of different components that share a group of dealt and pass the estimate; each pair once.

    classes: set_id, sketch, and meets (the class's list values). Groups are packed by a hash, some PACK rows together.
    """
    packs = max(1, -(-dealt.count() // PACK))
    group = ["value", "kind", "band", "x", "y"]
    rows = dealt.withColumn("pack", F.pmod(F.xxhash64(*group), F.lit(packs))).join(classes, "set_id")

    def compare(kind: int, x: int, y: int, value: bytes, side: np.ndarray, ids: list, root: np.ndarray, size: np.ndarray, sk: list, meets: list) -> Iterator[tuple[bytes, bytes]]:
        alone = kind == 0 and x == y
        order = np.argsort(side, kind="stable")
        m, width = len(ids), np.array([len(s) for s in sk])
        vocab = np.unique(np.concatenate(sk))
        # rows of value codes, padded with a code that nothing holds
        codes = np.full((m, int(width.max())), len(vocab), np.int64)
        for i, s in enumerate(sk):
            codes[i, : len(s)] = np.searchsorted(vocab, s)
        limit = np.where(width == sketch, codes[np.arange(m), width - 1], len(vocab) - 1)
        mark = np.zeros(len(vocab) + 1, bool)
        for p, i in enumerate(order):
            rest = order[p + 1 :] if alone else order[side[order] == 1] if side[i] == 0 else order[:0]
            rest = rest[(root[rest] != root[i]) & (np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i]) - 1e-9)]
            if not len(rest):
                continue
            mark[codes[i, : width[i]]] = True
            c = codes[rest]
            both = mark[c].sum(axis=1)
            mark[codes[i, : width[i]]] = False
            upto = np.minimum(limit[rest], limit[i])
            union = (c <= upto[:, None]).sum(axis=1) + np.searchsorted(codes[i, : width[i]], upto, "right") - both
            ok = passes(both / np.maximum(union, 1), union, size[rest], size[i], similarity)
            for j in rest[ok]:
                if min(set(meets[i]) & set(meets[j])) == value:  # in the first list they share, and in no other
                    yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def run(t: pa.Table) -> pa.Table:
        keys = list(zip(*(t.column(c).to_pylist() for c in group)))
        side, size = (t.column(c).to_numpy().astype(np.int64) for c in ("side", "size"))
        ids, roots = t.column("set_id").to_pylist(), t.column("root").to_pylist()
        code = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        root = np.array([code[r] for r in roots], np.int64)
        sk = [np.frombuffer(b, U) for b in t.column("sketch").to_pylist()]
        meets = t.column("meets").to_pylist()
        where: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            where.setdefault(k, []).append(i)
        out: list[tuple[bytes, bytes]] = []
        for (value, kind, _, x, y), at in where.items():
            if len(at) > 1:
                out += compare(kind, x, y, value, side[at], [ids[i] for i in at], root[at], size[at], [sk[i] for i in at], [meets[i] for i in at])
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return rows.groupBy("pack").applyInArrow(run, "a binary, b binary")


def _components(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str, broadcast_ids: int, bounds: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Staged: id, n_shingles and set_id of each row; set_id, component_id and links of each class."""
    spark, similarity = docs.sparkSession, percent / 100
    kept_values, listed = bounds
    full = stage(sketches(docs, shingle, id_col, text_col, kept_values), "near-sketches")
    seen = stage(full.select("id", "n_shingles", "set_id"), "near-rows")
    kept: list[DataFrame] = []
    with dropping(spark, kept):
        # one row per distinct set; equal sets are combined before the shuffle
        named = full.where("set_id is not null and id is not null").groupBy("set_id")
        classes = stage(named.agg(F.min(F.struct(*KEY)).alias("row_key"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "near-classes")
        kept.append(classes)
    delete(spark, [full.staged_at])
    with dropping(spark, kept):
        lists = stage(postings(classes, similarity, listed), "near-lists")
        kept.append(lists)
    met = stage(lists.select("set_id").distinct(), "near-met")
    active = stage(_among(classes, met, "set_id", broadcast_ids), "near-active")
    classes = classes.select("set_id", F.col("row_key.id").alias("least"))

    def confirm(candidates: DataFrame) -> DataFrame:
        kept: list[DataFrame] = []
        with dropping(spark, kept):
            links = stage(_verified(candidates, active, docs, shingle, percent, id_col, text_col, broadcast_ids), "near-links")
            kept.append(links)
        delete(spark, [candidates.staged_at])
        return links

    lead = stage(lists.groupBy("value").agg(F.min(F.struct("rare", "set_id"))["set_id"].alias("first"), F.min(F.struct(F.xxhash64("set_id").alias("h"), F.col("set_id")))["set_id"].alias("second")), "near-leaders")
    near = lists.select("value", "set_id").join(lead, "value").select("set_id", F.explode(F.array("first", "second")).alias("to")).where("set_id <> to")
    pairs = near.select(F.least("set_id", "to").alias("a"), F.greatest("set_id", "to").alias("b")).distinct()
    links = confirm(stage(_filtered(pairs, active, similarity, kept_values), "near-pairs"))
    root = components(links)

    rooted = lists.join(root.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    split = stage(rooted.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("value"), "near-open")
    meets = lists.groupBy("set_id").agg(F.collect_list("value").alias("meets"))
    dealt = _dealt(rooted.join(split, "value", "left_semi"), similarity, broadcast_ids)
    late = stage(_blocks(dealt, active.select("set_id", "sketch").join(meets, "set_id"), similarity, kept_values), "near-pairs")
    delete(spark, [dealt.staged_at])
    if not late.isEmpty():
        more = confirm(late)
        if not more.isEmpty():
            links = stage(links.unionByName(more).distinct(), "near-links")
            root = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    member = classes.join(root.withColumnRenamed("node", "set_id"), "set_id")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = lookup(member.withColumn("salt", salt_of("set_id")), least, "root", "salt", "inner").join(degree.withColumnRenamed("node", "set_id"), "set_id").select("set_id", "component_id", "links")
    # classes without links are their own smallest id
    return seen, stage(classes.join(linked, "set_id", "left").select("set_id", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links")), "near-known")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, exact: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept, and links (verified links of its class, 0 for most).

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable, kept is doc_id = component_id. A text of fewer than ``shingle`` words is one shingle; null and empty texts have
    none, are linked with nothing and keep themselves. A row with a null id takes the component of an equal set and is not
    kept, or has none and is kept. Rows that repeat an id are each given, with the component of their own text. Other columns
    are not looked at. With ``exact`` no bound rests on chance; lists are then as long as sets.
    """
    kept: list[DataFrame] = []
    with dropping(docs.sparkSession, kept):
        seen, known = _components(docs, percent, shingle, id_col, text_col, broadcast_ids, (WHOLE, WHOLE) if exact else (SKETCH, LISTED))
        kept += [seen, known]
    salt = F.when(F.col("set_id").isNull(), F.xxhash64("id")).otherwise(salt_of("id"))
    out = lookup(seen.withColumn("salt", salt), known, "set_id", "salt")
    comp = F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = comp.isNull() | F.coalesce(F.col("id") == comp, F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), kept.alias("kept"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
