"""Small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from spacemill.functions import geometry as geo
from spacemill.functions import scalars as sc
from spacemill.operators import extents as ex
from spacemill.operators import headers as hd
from spacemill.operators import ranges as rg
from spacemill.operators import replay as rp
from spacemill.sources.config import Options


def frame(spark, rows, schema="k long, start long, len long"):
    return spark.createDataFrame(rows, schema)


def tuples(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def nodes(df):
    """The nodes of a plan, before it is run."""
    plan = df._jdf.queryExecution().executedPlan()
    out = [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    for node in out:
        out += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("a, b, want", [((0, 10), (5, 10), (0, 15)), ((5, 4), (0, 10), (0, 10)), ((0, 10), (10, 10), (0, 20)), ((0, 10), (11, 10), (0, 10))])
def test_merge(spark, a, b, want):
    from spacemill.functions import intervals as iv

    d = spark.createDataFrame([(*a, *b)], "a long, al long, b long, bl long")
    assert tuple(d.select(iv.merge("a", "al", "b", "bl").alias("m")).select("m.*").first()) == want


@pytest.mark.parametrize("rows, want", [
    ([(10, 10), (40, 10), (20, 20)], [(10, 40)]),
    ([(10, 10), (40, 10), (21, 10)], [(10, 10), (21, 10), (40, 10)]),
    ([(0, 10), (30, 10), (10, 10), (80, 10), (40, 10)], [(0, 20), (30, 20), (80, 10)]),
])
def test_coalesce(spark, rows, want):
    assert tuples(ex.coalesce(frame(spark, [(1, *r) for r in rows])), "start", "len") == want
    m = rp.FreeMap()
    for r in rows:
        m.free(*r)
    assert m.by_start == want


def test_coalesce_takes_in_all_it_covers(spark):
    rows = [(0, 5), (10, 5), (20, 5), (4, 30)]
    assert tuples(ex.coalesce(frame(spark, [(1, *r) for r in rows])), "start", "len") == [(0, 34)]
    m = rp.FreeMap()
    for r in rows:
        m.free(*r)
    assert m.by_start == [(0, 34)]


def test_coalesce_in_parts_is_coalesce(spark):
    rnd = random.Random(8)
    d = frame(spark, [(rnd.choice((1, 1, 1, 2)), rnd.randint(-300, 300), rnd.randint(1, 9)) for _ in range(200)])
    whole = tuples(ex.coalesce(d), "k", "start", "len")
    assert whole == tuples(ex.coalesce(d, width=7), "k", "start", "len") == tuples(ex.coalesce(d, width=1000), "k", "start", "len")


def test_best_fit(spark):
    free = frame(spark, [(1, 30, 2), (1, 25, 3), (1, 0, 1)])
    asked = spark.createDataFrame([(1, n) for n in (0, 1, 2, 3, 4)], "k long, n long")
    got = {r["n"]: (r["start"], r["len"]) for r in ex.best_fit(free, asked).collect()}
    assert got == {0: (None, None), 1: (0, 1), 2: (30, 2), 3: (25, 3), 4: (None, None)}


def test_alloc_log():
    m = rp.FreeMap(64)
    assert [m.alloc(n) for n in (1, 2, 3)] == [0, 1, 3]
    m.free(0, 1)
    assert m.alloc(4) == 6 and m.alloc(1) == 0
    assert m.by_start == [(10, 54)]
    m = rp.FreeMap(64)
    assert (m.alloc(62), m.alloc(3), m.alloc(2), m.alloc(0)) == (0, None, 62, None)


def test_heap_geometry(spark):
    d = spark.createDataFrame([(1048576, 4096)], "r long, b long")
    assert d.select(geo.heap_blocks(F.col("r"), F.col("b"))["nblocks"]).first()[0] == 252


def test_slab_geometry(spark):
    d = spark.createDataFrame([(131072,), (32768,), (1024,), (136,), (8,)], "b long")
    want = [1, 7, 255, 1925, 32256]
    assert [r[0] for r in d.select(geo.slab_blocks(262144, F.col("b"))).collect()] == want
    assert [rp.slab_capacity(262144, b) for b in (131072, 32768, 1024, 136, 8)] == want


def test_size_classes(spark):
    assert len(geo.SIZE_CLASSES) == 116 and geo.SIZE_CLASSES[93] == geo.SIZE_CLASSES[101] == 16384
    sizes = [1, 8, 9, 512, 513, 16384, 16385, 245760, 245761]
    d = spark.createDataFrame([(s,) for s in sizes], "s long")
    want = [next((i for i, b in enumerate(geo.SIZE_CLASSES) if b >= s), None) for s in sizes]
    assert [r[0] for r in d.select(geo.sizeclass(F.col("s"))).collect()] == want


def test_scan_layout(spark):
    held = frame(spark, [(1, 0, 10), (1, 10, 1), (1, 13, 14), (1, 27, 225)])
    s = hd.scan(hd.headers(held, 252))
    assert tuples(s.where("not is_free"), "start", "len") == [(0, 10), (10, 1), (13, 14), (27, 225)]
    assert tuples(s.where("is_free"), "start", "len") == [(11, 2)]


def test_headers_roundtrip_random(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(5):
        at = 0
        while at < 200:
            n = rnd.randint(1, 9)
            if rnd.random() < 0.5 and at + n <= 200:
                rows.append((k, at, n))
            at += n
    s = hd.scan(hd.headers(frame(spark, rows), 210))
    assert tuples(s.where("not is_free"), "k", "start", "len") == sorted(rows)
    taken = {(k, b) for k, a, n in rows for b in range(a, a + n)}
    free = {(r["k"], b) for r in s.where("is_free").collect() for b in range(r["start"], r["start"] + r["len"])}
    assert free == {(k, b) for k in range(5) for b in range(210)} - taken


def test_interval_lookup(spark):
    base = 0x7F0000000000
    areas = frame(spark, [(1, base + o, base + o + 0x1000) for o in (0, 0x1000, 0x3000)], "k long, start long, end long")
    points = spark.createDataFrame([(i, 1, base + o) for i, o in enumerate((0, 0x10, 0x1000, 0x2000, 0x3FFF))], "id long, k long, addr long")
    got = {r["id"]: r["start"] for r in ex.interval_join(points, areas, "k", "addr", 0x800).collect()}
    assert [got[i] is not None for i in range(5)] == [True, True, True, False, True]


@pytest.mark.parametrize("touching", [True, False])
def test_overlap_join_random(spark, touching):
    rnd = random.Random(5)
    a, b = ([(rnd.randint(0, 2), rnd.randint(0, 90), rnd.randint(1, 12)) for _ in range(60)] for _ in range(2))
    a, b = sorted(set(a)), sorted(set(b))
    t = 1 if touching else 0
    want = sorted((k, s, n, u, m) for k, s, n in a for j, u, m in b if k == j and s < u + m + t and u < s + n + t)
    got = tuples(ex.overlap_join(frame(spark, a), frame(spark, b), "k", 8, touching), "k", "a_start", "a_len", "b_start", "b_len")
    assert got == want


def test_interleave(spark):
    d = spark.range(8).select(F.col("id").alias("i"))
    got = rg.place_requested(d, F.array(*map(F.lit, (2, 3, 2, 3, 2, 3)))).orderBy("i").collect()
    assert [r["node"] for r in got] == [2, 3, 2, 3, 2, 3, 0, 0]


def test_hops(spark):
    nodes = [(1, 1, 4), (1, 1, 5), (1, 4, 5)]
    ids = [(r - 1) * 80 + (e - 1) * 10 + n for r, e, n in nodes]
    d = spark.createDataFrame([(ids[0], ids[1]), (ids[1], ids[2]), (ids[0], ids[0])], "a long, b long")
    assert [r[0] for r in d.select(geo.hops(geo.node_parts(F.col("a")), geo.node_parts(F.col("b")))).collect()] == [3, 5, 1]


def test_scalars(spark):
    d = spark.createDataFrame([("128K", "1-5,8", "a,b,"), ("x", "5-1", "")], "s string, r string, p string")
    rows = d.select(sc.string_to_size(F.col("s")), sc.expand_range(F.col("r")), sc.split_string(F.col("p"), ",")).collect()
    assert tuple(rows[0]) == (131072, [1, 2, 3, 4, 5, 8], ["a", "b"]) and tuple(rows[1]) == (None, [], [])
    h = spark.createDataFrame([(b"aabc",)], "b binary").select(sc.hex_string(F.col("b")), sc.hex_string(F.col("b"), 2)).first()
    assert tuple(h) == ("0x61616263", "0x6161 (2 more bytes)")


def test_slab_picks_fullest_then_latest():
    heap = rp.SlabHeap(rp.FreeMap(1024), 64)
    cls = geo.SIZE_CLASSES.index(1024)
    first = heap.malloc(1024)
    for _ in range(254):
        assert heap.malloc(1024)[1] == first[1]
    second = heap.malloc(1024)
    assert second[1] != first[1] and second[0] == cls and second[2] == 0
    heap.free(first[1], 3)
    heap.free(first[1], 7)
    assert [heap.malloc(1024) for _ in range(2)] == [(cls, first[1], 7), (cls, first[1], 3)]
    heap.free(second[1], 0)
    assert heap.empty == [second[1]]
    assert heap.malloc(2048)[1] == second[1]


def test_hybrid_routes():
    h = rp.HybridHeap(1024, 64, 8192)
    big, small = h.step("A", 16384), h.step("A", 2048)
    assert (big["route"], big["stored"], small["route"], small["stored"]) == ("big", 16384, "small", 2048)


@pytest.mark.parametrize("seed", range(3))
def test_random_workload_never_overlaps(seed):
    rnd, m, live = random.Random(seed), rp.FreeMap(252), []
    for _ in range(400):
        if len(live) < 8 or (len(live) < 16 and rnd.random() < 0.5):
            n = rnd.randint(1, 16)
            start = m.alloc(n)
            if start is not None:
                assert all(start >= s + k or s >= start + n for s, k in live)
                live.append((start, n))
        else:
            m.free(*live.pop(rnd.randrange(len(live))))
        assert m.total() + sum(n for _, n in live) == 252
        assert sorted((n, s) for s, n in m.by_start) == m.by_len
        assert all(s + n < t for (s, n), (t, _) in zip(m.by_start, m.by_start[1:]))


def test_stream_is_batch(spark, sf):
    from spacemill.plans.registry import queries

    q = queries()
    cols = ("heap", "seq", "op", "n", "status", "start", "len")
    assert tuples(q["a_m_streaming_replay"](spark, sf).na.fill(-1), *cols) == tuples(q["a_m1_m3_m4_m5_m6_replay"](spark, sf).na.fill(-1), *cols)


def test_replay_is_the_machine(spark, sf):
    from spacemill.plans import state
    from spacemill.sources import tables as t

    log, machines, want = sorted(tuple(r) for r in t.alloc_log(spark, sf).select("heap", "seq", "op", "n").collect()), {}, []
    for heap, seq, op, n in log:
        want.append((heap, seq, *machines.setdefault(heap, state.extent_heap()).step(op, n).values()))
    got = tuples(state.replay(spark, sf).na.fill(-1), "heap", "seq", "status", "start", "len")
    assert got == [tuple(-1 if x is None else x for x in w) for w in want]


def test_options():
    o = Options.from_text("foo_bool: true\nfoo_string: test_string\nfoo_vector: [1, 2, 3]\nchild:\n  depth: 2\n")
    assert (o.get("foo_bool"), o.get("foo_vector"), o.get("child.depth"), o.get("foo_enum", 2)) == (True, [1, 2, 3], 2, 2)
    assert Options.from_text(o.to_text()) == o
    assert o.with_arguments(["--foo_string=other"]).get("foo_string") == "other"
    with pytest.raises(KeyError):
        o.get("none", required=True)


def test_bitmap_load_counts_all_buckets(spark, tmp_path):
    from spacemill.plans import registry
    from tests import compare

    rows = [(1, 0), (1, 32767), (1, 32768), (1, 32768), (1, 100000), (2, 40000), (3, 7)]
    frame(spark, rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["a_b7_load"](spark, str(tmp_path))
    assert tuples(got, "map", "set_bits", "bytes") == [(1, 4, 4096), (2, 1, 4096), (3, 1, 4096)]
    assert compare.differences(got, compare.duck(tmp_path), registry.oracle_sql()["a_b7_load"]) is None


#: The class sizes one by one, by which both the operator's and the SQL's arithmetic are held.
CLASS_BYTES = """
8 16 24 32 40 48 56 64 72 80 88 96 104 112 120 128 136 144 152 160 168 176 184 192 200 208 216 224 232 240 248 256 264 272 280 288 296 304 312 320 328 336
344 352 360 368 376 384 392 400 408 416 424 432 440 448 456 464 472 480 488 496 504 512 576 640 704 768 832 896 960 1024 1536 2048 2560 3072 3584 4096 4608
5120 5632 6144 6656 7168 7680 8192 9216 10240 11264 12288 13312 14336 15360 16384 18432 20480 22528 24576 26624 28672 30720 16384 32768 49152 65536 81920
98304 114688 131072 147456 163840 180224 196608 212992 229376 245760
"""


def test_class_table_is_the_listed_one(spark):
    listed = [int(x) for x in CLASS_BYTES.split()]
    assert geo.SIZE_CLASSES == listed
    sizes = sorted({s for b in listed for s in (b - 1, b, b + 1) if s > 0})
    got = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", geo.sizeclass(F.col("s"))).collect()
    assert {r[0]: r[1] for r in got} == {s: next((i for i, b in enumerate(listed) if b >= s), None) for s in sizes}


def test_open_flags_and_error_codes_are_the_listed_ones():
    from spacemill.sources import config as cf

    assert dict((n, b) for n, b in sc.OPEN_FLAGS if n in ("O_WRONLY", "O_RDWR", "O_CREAT", "O_TRUNC")) == {"O_WRONLY": 1, "O_RDWR": 2, "O_CREAT": 64, "O_TRUNC": 512}
    names = {0x0002: "Outofmemory", 0x0003: "InvalidParameter", 0x0010: "NotSupported", 0x0202: "FsFailedToOpen", 0x0213: "FsUnlinkFailed", 0x0302: "MemoryDuplicateMapping", 0x0303: "MemoryUnknownMapping"}
    assert {c: cf.ERRORS[c][0] for c in names} == names and len(cf.ERRORS) == 56
    assert [cf.ERRNOS[n] for n in (1, 2)] == ["Operation not permitted", "No such file or directory"]


def test_errors_note_the_places_they_pass():
    from spacemill.errors import SpaceError, check, passing

    check(True, "NotSupported")
    with pytest.raises(SpaceError) as e, passing("outer"), passing("inner"):
        check(False, "NotSupported", "resize")
    assert (e.value.code, e.value.frames) == (0x10, ["inner", "outer"]) and "not supported. resize" in str(e.value)
    assert len(e.value.push("a").push("b").push("c").push("d").push("e").push("f").push("g").frames) == 8


def test_unsupported_operations_raise():
    from spacemill.errors import SpaceError

    f = rg.MultiRegionFile(["a", "b"])
    for name in ("create", "truncate", "getxattr", "setxattr", "set_interleave_group"):
        with pytest.raises(SpaceError, match="NotSupported"):
            getattr(f, name)(1)
    with pytest.raises(AttributeError):
        f.other
    with pytest.raises(SpaceError, match="InvalidParameter"):
        rg.place_striped(None, 5000, 4096, 2)


def test_duplicate_mappings(spark):
    from spacemill.sources import files as src

    asked = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "seq long, region long")
    got = src.map_regions(asked)
    assert tuples(got, "seq", "status") == [(1, "OK"), (2, "MemoryDuplicateMapping"), (3, "OK")]
    assert {r["status"] for r in src.map_regions(asked, allow_duplicates=True).collect()} == {"OK"}
    gone = src.unmap_regions(spark.createDataFrame([(1, 7), (2, 9)], "seq long, region long"), got)
    assert tuples(gone, "seq", "status") == [(1, "OK"), (2, "MemoryUnknownMapping")]


def test_stored_size(spark):
    free = frame(spark, [(1, 0, 16), (1, 20, 16), (1, 40, 3)])
    slabs = spark.createDataFrame([(1, 0, 71)], "k long, start long, cls int")
    probes = spark.createDataFrame([(i, 1, a) for i, a in enumerate((5, 21, 42, 17))], "id long, k long, addr long")
    got = ex.stored_size(free, slabs, probes, 4096, 16)
    assert tuples(got, "id", "bytes") == [(0, geo.SIZE_CLASSES[71]), (1, 65536), (2, 12288), (3, 0)]


def test_bitmap_positions_random(spark):
    from spacemill.functions import bitmap as bm

    rnd = random.Random(4)
    rows = sorted({(k, b) for k in range(3) for b in [0, 7, 8, 62, 63, 64, 127, 32767, 32768, 65535, *(rnd.randrange(100_000) for _ in range(300))]})
    d = spark.createDataFrame(rows, "map long, bit long")
    assert tuples(bm.positions(bm.construct(d, "map", "bit"), "map"), "map", "bit") == rows


@pytest.mark.parametrize("clear", [False, True])
def test_bitmap_words_random(spark, clear):
    from spacemill.functions import bitmap as bm

    rnd = random.Random(14)
    rows = [(k, b) for k in range(3) for b in [-65, -64, -1, 0, 7, 62, 63, 64, 127, 32767, 32768, *(rnd.randrange(3000) for _ in range(300))]]
    d = bm.words(spark.createDataFrame(rows * 2, "map long, bit long"), "map", "bit", F.col("bit") % 7 == 0 if clear else None)
    assert tuples(bm.word_positions(d, "map"), "map", "bit") == sorted({(k, b) for k, b in rows if not clear or b % 7})
    probes = spark.createDataFrame([(b,) for b in range(128)], "bit long").withColumn("word", F.shiftright("bit", 6))
    got = probes.join(d.where("map = 1"), "word").where(bm.is_set(F.col("bits"), F.col("bit")))
    assert tuples(got, "bit") == sorted({(b,) for k, b in rows if k == 1 and 0 <= b < 128 and (not clear or b % 7)})


@pytest.mark.parametrize("name", ["a_b2_set", "a_b3_clear", "a_b4_is_set", "a_b7_load", "a_g5_fullness"])
def test_no_packed_bucket_is_moved_or_sorted(spark, sf, name):
    """A bucket has 4096 bytes however few of its bits are set."""
    from spacemill.plans import registry

    for node in nodes(registry.queries()[name](spark, sf)):
        if node.nodeName() in ("Exchange", "Sort"):
            assert "binary" not in node.schema().simpleString()


def test_topology(spark):
    cpus = spark.createDataFrame([(1, 0, 0), (1, 1, 4), (2, 0, 0)], "host long, node int, first_cpu long")
    p = spark.createDataFrame([(1, 1, 5), (2, 1, 9), (3, 2, 3), (4, 3, 0)], "process long, host long, cpu long")
    assert sorted(tuple(r) for r in rg.topology(p, cpus, 4).na.fill(-1).collect()) == [(1, 1, 1, 1), (2, 1, 1, -1), (3, 2, 0, 0), (4, 3, -1, -1)]


def test_scratch_is_shared_or_local(spark):
    from types import SimpleNamespace

    from spacemill import scratch

    assert scratch.shared_dir(spark) == scratch.shared_dir(spark)
    assert scratch.scratch_path(spark, "x") != scratch.scratch_path(spark, "x")
    far = lambda where: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: where), sparkContext=SimpleNamespace(master="spark://h:1", applicationId="a"))
    assert scratch.shared_dir(far("hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        scratch.shared_dir(far(None))


def _log_files(spark, sf, where, parts, order):
    """The events as part files, by ranges of ``order``, the earlier ones written first."""
    import os
    import time

    e = spark.read.parquet(f"{sf}/events.parquet")
    ids = sorted(r[0] for r in e.select(order).collect())
    ends = [ids[len(ids) * i // parts] for i in range(parts)] + [None]
    for i in range(parts):
        part = e.where(F.col(order) >= ends[i])
        part = part if ends[i + 1] is None else part.where(F.col(order) < ends[i + 1])
        part.coalesce(1).write.parquet(f"{where}/tmp{i}")
        name = next(f for f in os.listdir(f"{where}/tmp{i}") if f.endswith(".parquet"))
        os.makedirs(f"{where}/events.parquet", exist_ok=True)
        os.rename(f"{where}/tmp{i}/{name}", f"{where}/events.parquet/part-{i}.parquet")
        at = time.time() - 1000 + 10 * i
        os.utime(f"{where}/events.parquet/part-{i}.parquet", (at, at))


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_stream_of_a_folder_is_batch(spark, sf, tmp_path, files_per_batch):
    """Three part files, in one micro-batch and in three."""
    from spacemill.plans import state
    from spacemill.streaming import replay as sr

    _log_files(spark, sf, tmp_path, 3, "event_id")
    out = sr.stream_replay(sr.event_log(spark, str(tmp_path), files_per_batch), state.extent_heap, rp.EXTENT_ROWS)
    sr.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    cols = ("heap", "seq", "op", "n", "status", "start", "len")
    got = tuples(spark.read.parquet(f"{tmp_path}/out").na.fill(-1), *cols)
    assert got and got == tuples(state.replay(spark, sf).na.fill(-1), *cols)
    if files_per_batch is None:
        assert state.streaming_replay(spark, str(tmp_path)).count() == len(got) == state.streaming_hybrid(spark, str(tmp_path)).count()


def test_hybrid_stream_is_batch(spark, sf):
    from spacemill.plans import state

    cols = ("heap", "seq", "op", "size", "status", "route", "cls", "slab", "block", "start", "stored")
    fill = lambda df: tuples(df.na.fill(-1).na.fill(""), *cols)
    assert fill(state.streaming_hybrid(spark, sf)) == fill(state.hybrid_replay(spark, sf))


def test_late_rows_are_answered_in_their_place(spark, tmp_path):
    """Rows of later micro-batches that belong before rows already seen, within the lateness; the last row only moves the watermark."""
    import datetime
    import os
    import time

    from spacemill.streaming import replay as sr

    t0 = datetime.datetime(2024, 1, 1)
    row = lambda seq, op, n: (1, seq, op, n, t0 + datetime.timedelta(seconds=seq))
    kind = "heap long, seq long, op string, n long, ts timestamp"
    batches = [[row(1, "A", 3), row(4, "A", 2)], [row(2, "A", 5), row(3, "F", 0)], [row(5, "A", 3)], [(2, 1000, "A", 1, t0 + datetime.timedelta(days=1))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/tmp{i}")
        name = next(f for f in os.listdir(f"{tmp_path}/tmp{i}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/log", exist_ok=True)
        os.rename(f"{tmp_path}/tmp{i}/{name}", f"{tmp_path}/log/part-{i}.parquet")
        os.utime(f"{tmp_path}/log/part-{i}.parquet", (time.time() - 1000 + 10 * i,) * 2)
    log = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    out = sr.stream_replay(log, lambda: rp.ExtentHeap(64), rp.EXTENT_ROWS, event_time="ts", lateness="1 hour")
    sr.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    m = rp.ExtentHeap(64)
    want = [(seq, *m.step(op, n).values()) for seq, op, n in sorted(r[1:4] for b in batches[:3] for r in b)]
    assert tuples(spark.read.parquet(f"{tmp_path}/out").where("heap = 1"), "seq", "status", "start", "len") == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_probes_by_stretches_are_probes(spark, inclusive):
    rnd = random.Random(12)
    taken = sorted({(rnd.choice((1, 1, 1, 2)), rnd.randrange(-300, 300, 3)) for _ in range(120)})
    d = frame(spark, [(k, a, rnd.randint(1, 3)) for k, a in taken])
    p = spark.createDataFrame([(i, rnd.choice((1, 2, 3)), rnd.randint(-350, 350)) for i in range(300)], "id long, k long, addr long")
    cols = ("id", "k", "addr", "x_start", "x_len")
    fill = lambda df: tuples(df.na.fill(-999), *cols)
    whole = fill(ex.previous(d, p, inclusive=inclusive))
    assert all(whole == fill(ex.previous(d, p, inclusive=inclusive, width=n)) for n in (7, 100, 10_000))
    ahead = fill(ex.following(d, p))
    assert all(ahead == fill(ex.following(d, p, width=n)) for n in (7, 10_000))


def test_scan_by_stretches_is_scan(spark):
    held = frame(spark, [(1, 0, 10), (1, 10, 1), (1, 13, 14), (1, 100, 3), (2, 5, 1)])
    cols = ("k", "start", "len", "is_free")
    assert tuples(hd.scan(hd.headers(held, 252), stretch=7), *cols) == tuples(hd.scan(hd.headers(held, 252)), *cols)


def test_scan_reads_runs_off_words(spark):
    held = frame(spark, [(1, 63, 2), (1, 128, 64), (1, 193, 1), (2, 255, 1), (3, 0, 256), (4, 0, 1)])
    free = [(1, 0, 63), (1, 65, 63), (1, 192, 1), (1, 194, 62), (2, 0, 255), (4, 1, 255)]
    assert tuples(hd.recover(hd.headers(held, 256)), "k", "start", "len") == free
    assert all(tuples(hd.scan(hd.headers(held, 256), stretch=n).where("is_free"), "k", "start", "len") == free for n in (7, 64, 100))


@pytest.mark.parametrize("name", ["a_s0_find_extents", "a_s2_iterate", "a_s3_descriptors", "a_s4_recover", "a_s9_slab_extents"])
def test_no_header_is_sorted(spark, sf, name):
    """A heap has 4096 headers however few extents it has."""
    from spacemill.plans import registry

    for node in nodes(registry.queries()[name](spark, sf)):
        if node.nodeName() in ("Exchange", "Sort", "Window"):
            assert "idx" not in node.schema().simpleString()


def test_headers_of_extents_are_made_by_one_sort(spark):
    names = [node.nodeName() for node in nodes(hd.headers(frame(spark, [(1, 0, 10), (1, 13, 14)]), 252))]
    assert [names.count(x) for x in ("Exchange", "Sort", "Union")] == [1, 1, 0]


def test_blocks_held_twice_are_counted(spark):
    rnd = random.Random(9)
    rows = []
    for heap in range(4):
        for _ in range(12):
            seq, start = rnd.randrange(20), rnd.randrange(200)
            rows.append((heap, seq, seq + rnd.randint(1, 9), start, rnd.choice((1, 3, 16, 52) if heap else (1,))))
    rows += [(7, 0, 3, 0, 200), (7, 1, 5, 64, 64), (7, 2, 4, 199, 1)]
    want = {}
    for heap, seq, until, start, n in rows:
        cells = want.setdefault(heap, {})
        for c in ((at, b) for at in range(seq, until) for b in range(start, start + n)):
            cells[c] = cells.get(c, 0) + 1
    d = rp.held_twice(spark.createDataFrame(rows, "heap long, seq long, until long, start long, len long"), 252)
    assert tuples(d, "heap", "overlaps") == sorted((h, sum(n - 1 for n in c.values())) for h, c in want.items())
    assert [node.nodeName() for node in nodes(d)].count("Generate") == 1


def test_lives_pair_frees_in_order(spark):
    rows = [(1, 0, "A", 4, "OK", 0, 4), (1, 1, "A", 99, "OUT_OF_MEMORY", None, None), (1, 2, "A", 2, "OK", 4, 2), (1, 3, "F", 1, "OK", 0, 4), (2, 0, "A", 3, "OK", 0, 3), (2, 5, "F", 1, "OK", 1, 3), (2, 6, "F", 1, "INVALID_ADDRESS", None, None)]
    d = rp.lives(spark.createDataFrame(rows, rp.EXTENT_ROWS), 128)
    assert tuples(d, "heap", "seq", "until", "start", "len", "returned") == [(1, 0, 3, 0, 4, True), (1, 2, 128, 4, 2, True), (2, 0, 5, 0, 3, False)]


def test_session_is_one_and_options_are_layered(spark):
    from spacemill.session import layered_options, session

    assert session() is session(Options({"spark.x": 1})) and session().sparkContext is spark.sparkContext
    file = Options.from_text("spark:\n  sql:\n    session.timeZone: CET\nother: 1\n")
    assert layered_options(Options({"a": 1, "b": 1}), Options({"b": 2}), file).values == {"a": 1, "b": 2, "spark.sql.session.timeZone": "CET", "other": 1}


def test_pairs_with_a_fixed_few_are_bounded(spark):
    few, every = spark.range(3).toDF("a"), spark.range(5).toDF("b")
    assert rg.with_each(every, few, "x", most=3).select("b", "x.a").distinct().count() == 15
    with pytest.raises(ValueError):
        rg.with_each(every, few, "x", most=2)
