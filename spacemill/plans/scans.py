"""Header scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spacemill.errors import SpaceError
from spacemill.functions import geometry as geo
from spacemill.functions.bitmap import positions
from spacemill.operators import headers as hd
from spacemill.operators.extents import coalesce
from spacemill.plans.base import FX, HD, NBLOCKS, query
from spacemill.plans.extents import PART, free
from spacemill.scratch import scratch_path
from spacemill.sources import files as src
from spacemill.sources import tables as t


def headers(spark, sf):
    return hd.headers(coalesce(t.intervals(spark, sf), width=PART, spread=True), NBLOCKS)


@query("a_m7_mark", f"with {FX}, b as (select k, start, len, unnest(range(0, len)) as i from fx) select k, start + i as idx, cast(case when i = 0 then 1 else 2 end as integer) as type, case when i = 0 then len else 0 end as size from b")
def mark(spark, sf):
    return hd.mark(free(spark, sf))


@query("a_m8_clear", f"with {FX}, b as (select k, start, len, unnest(range(0, len)) as i from fx) select k, start + i as idx, 0 as type, cast(0 as bigint) as size from b")
def clear(spark, sf):
    return hd.clear(free(spark, sf))


_SCAN = f"""{HD}, fr as (select k, idx, idx - row_number() over (partition by k order by idx) as g from hd where type = 0),
sc as (select k, min(idx) as start, count(*) as len, true as is_free from fr group by k, g union all select k, idx, size, false from hd where type = 1)"""


@query("a_s0_find_extents", f"with {_SCAN} select * from sc")
def find_extents(spark, sf):
    return hd.scan(headers(spark, sf))


@query("a_s2_iterate", f"with {_SCAN} select * from sc order by k, start")
def iterate(spark, sf):
    return hd.scan(headers(spark, sf)).orderBy("k", "start")


@query("a_s3_descriptors", f"with {_SCAN} select k, start, len, is_free, start * 4096 as byte_start, len * 4096 as byte_len from sc")
def descriptors(spark, sf):
    s = hd.scan(headers(spark, sf))
    return s.select("k", "start", "len", "is_free", (F.col("start") * 4096).alias("byte_start"), (F.col("len") * 4096).alias("byte_len"))


@query("a_s4_recover", f"with {_SCAN} select k, start, len from sc where is_free")
def recover(spark, sf):
    return hd.recover(headers(spark, sf))


@query("a_s5_free_blocks", f"with {HD} select k, count(*) filter (type = 0) as free, count(*) filter (type <> 0) as used from hd group by k")
def free_blocks(spark, sf):
    is_free = F.col("type") == hd.FREE
    return headers(spark, sf).groupBy("k").agg(F.count_if(is_free).alias("free"), F.count_if(~is_free).alias("used"))


@query("a_s6_geometry", """with h as (select s_suppkey as k, (s_suppkey % 64 + 1) * 1048576 as region, cast(1 << (9 + s_suppkey % 4) as bigint) as block from supplier),
m as (select *, ((region - 64) // (64 + block)) * 64 as headers from h) select k, region, block, (region - 64 - headers) // block as nblocks, cast(64 as bigint) as headers_offset, headers + 64 as blocks_offset from m""")
def geometry(spark, sf):
    s = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), ((F.pmod("s_suppkey", F.lit(64)) + 1) * 1048576).alias("region"), geo.block_size((F.pmod("s_suppkey", F.lit(4)) + 9).cast("int")).alias("block"))
    return s.select("*", geo.heap_blocks(F.col("region"), F.col("block")).alias("g")).select("k", "region", "block", "g.*")


@query("a_s8_addresses", f"with {FX} select k, start, 64 + start * 64 as header_addr, 64 + {NBLOCKS} * 64 + start * 4096 as block_addr from fx")
def addresses(spark, sf):
    h = F.lit(64).cast("long")
    return free(spark, sf).select("k", "start", (h + F.col("start") * 64).alias("header_addr"), (h + NBLOCKS * 64 + F.col("start") * 4096).alias("block_addr"))


@query("a_s9_slab_extents", f"with {_SCAN} select k, start, len from sc where not is_free and len >= 16")
def slab_extents(spark, sf):
    """Allocated extents of a slab's size or more, compared in bytes."""
    s = hd.scan(headers(spark, sf)).where(~F.col("is_free") & (F.col("len") * 4096 >= 65536))
    return s.select("k", "start", "len")


@query("a_s10_free_list", """with ps as (select distinct l_suppkey as map, l_partkey as bit from lineitem where l_partkey < 255),
al as (select s_suppkey as map, unnest(range(0, 255)) as bit from supplier) select a.map, list(a.bit order by a.bit) as free_blocks from al a left join ps p on p.map = a.map and p.bit = a.bit where p.map is null group by a.map""")
def free_list(spark, sf):
    """The free block ids of each slab of 255 blocks, in order, from its packed bitmap; bounded by a slab's blocks."""
    from spacemill.functions import bitmap

    used = bitmap.construct(t.positions(spark, sf).where("bit < 255"), "map", "bit")
    s = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("map"))
    held = positions(used, "map").groupBy("map").agg(F.collect_list("bit").alias("_set"))
    full = F.sequence(F.lit(0).cast("long"), F.lit(254).cast("long"))
    return s.join(held, "map", "left").select("map", F.array_sort(F.array_except(full, F.coalesce("_set", F.array().cast("array<bigint>")))).alias("free_blocks"))


@query("a_s7_s11_s12_create_open", "select o_orderkey as id, o_custkey as k, o_orderstatus as status from orders")
def create_open(spark, sf):
    """Writes two region files and opens both as one, by an explicit schema."""
    o = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"))
    where = scratch_path(spark)
    src.create(o.where("id % 2 = 0"), f"{where}/a")
    src.create(o.where("id % 2 = 1"), f"{where}/b")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.LongType()), T.StructField("status", T.StringType())])
    return src.open_many(spark, [f"{where}/a", f"{where}/b"], schema)


_KIND = "case p_type when 'ECONOMY' then 'tmpfs' when 'STANDARD' then 'lfs' else 'ext4' end"


@query("a_s13_dispatch", f"select p_partkey as file, {_KIND} as fstype, coalesce(case {_KIND} when 'tmpfs' then 'TmpfsFile' when 'lfs' then 'LfsFile' end, 'PlainFile') as driver from part")
def dispatch(spark, sf):
    """The driver registered for a file's file system, else that for any."""
    kind = F.when(F.col("p_type") == "ECONOMY", "tmpfs").when(F.col("p_type") == "STANDARD", "lfs").otherwise("ext4")
    files = t.read(spark, sf, "part").select(F.col("p_partkey").alias("file"), kind.alias("fstype"))
    return src.dispatch(files, {"tmpfs": "TmpfsFile", "lfs": "LfsFile", "any": "PlainFile"})


@query("a_s14_data_source", "with b as (select unnest(range(0, 64)) as heap, 8 as n) select heap, unnest(range(0, 8)) * 32 as start, heap % 32 + 1 as len from b")
def data_source(spark, sf):
    """A connector registered with the session: synthetic heaps, a partition each group of heaps."""
    src.register(spark)
    return spark.read.format("heap_extents").option("heaps", "64").option("extents", "8").load()


@query("a_s15_s16_s21_s31_file_sizes")
def file_sizes(spark, sf):
    """Name and length of each stored file of a table, from the reader's metadata."""
    return src.file_sizes(t.read(spark, sf, "supplier"))


_XA = "select c_custkey as file, map(['user.seg', 'user.nation'], [c_mktsegment, cast(c_nationkey as varchar)]) as x from customer"


@query("a_s18_s19_xattrs", f"with a as ({_XA}) select file, x['user.seg'] as seg, left(x['user.nation'], 1) as nation_1, x['user.none'] as none, case when file % 2 = 0 then 'set' else x['user.seg'] end as seg_after from a")
def xattrs(spark, sf):
    """Extended attributes as a map: get (null where absent), a prefix of a value, and upsert."""
    x = F.create_map(F.lit("user.seg"), F.col("c_mktsegment"), F.lit("user.nation"), F.col("c_nationkey").cast("string"))
    d = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("file"), x.alias("x"))
    after = src.set_xattr(F.col("x"), "user.seg", F.when(F.pmod("file", F.lit(2)) == 0, F.lit("set")).otherwise(F.col("x")["user.seg"]))
    return d.select("file", src.get_xattr(F.col("x"), "user.seg").alias("seg"), F.substring(src.get_xattr(F.col("x"), "user.nation"), 1, 1).alias("nation_1"), src.get_xattr(F.col("x"), "user.none").alias("none"), after["user.seg"].alias("seg_after"))


@query("a_s22_truncate", "select s_suppkey as file, s_suppkey * 1000 as size, cast((s_suppkey * 1000 + 4095) // 4096 * 4096 as bigint) as rounded, greatest(0, (s_suppkey * 1000 + 4095) // 4096 - 5) as new_books, greatest(0, 5 - (s_suppkey * 1000 + 4095) // 4096) as cut_books from supplier")
def truncate(spark, sf):
    """Sizes rounded up to books of 4096 bytes, and the books added to or cut from a file of 5."""
    books = geo.div(geo.round_up(F.col("size"), F.lit(4096).cast("long")), 4096)
    s = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_suppkey") * 1000).alias("size"))
    zero = F.lit(0).cast("long")
    return s.select("file", "size", (books * 4096).alias("rounded"), F.greatest(zero, books - 5).alias("new_books"), F.greatest(zero, 5 - books).alias("cut_books"))


@query("a_s23_mount_points", "with m as (select n_nationkey as dev, n_name as mount, case when n_regionkey % 2 = 0 then 'tmpfs' else 'lfs' end as fstype from nation where n_nationkey % 5 <> 0) select c_custkey as file, coalesce(m.mount, '/') as mount, coalesce(m.fstype, 'ext4') as fstype from customer left join m on m.dev = c_nationkey")
def mount_points(spark, sf):
    """The first mount of each file's device and its file system, those of the root where there is none."""
    n = t.read(spark, sf, "nation").where("n_nationkey % 5 <> 0")
    mounts = n.select(F.col("n_nationkey").alias("dev"), F.col("n_name").alias("mount"), F.when(F.pmod("n_regionkey", F.lit(2)) == 0, "tmpfs").otherwise("lfs").alias("fstype"))
    files = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("file"), F.col("c_nationkey").alias("dev"))
    return src.mounted(files, mounts, "/", "ext4").select("file", "mount", "fstype")


@query("a_s15_s16_region_files", "select * from (values (1, 'create a', 'OK', 25), (2, 'create b', 'OK', 5), (3, 'open a', 'OK', 25), (4, 'setxattr a', 'OK', 0), (5, 'getxattr a', 'value', 0), (6, 'create a', 'OK', 5), (7, 'unlink a', 'OK', 0), (8, 'open a', 'FsFailedToOpen', 0), (9, 'getxattr a', 'FsFailedToOpen', 0), (10, 'unlink a', 'FsUnlinkFailed', 0), (11, 'open b', 'OK', 5)) s(step, operation, status, n)")
def region_files(spark, sf):
    """Region files created, opened, given attributes and unlinked, with what each step answers and the rows it holds."""
    files, rows = src.RegionFiles(spark, scratch_path(spark)), []
    n, r = t.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), t.read(spark, sf, "region").select(F.col("r_regionkey").alias("id"))

    def step(operation: str, run) -> None:
        try:
            got = run()
        except SpaceError as e:
            got = e.name
        rows.append((len(rows) + 1, operation, got if isinstance(got, str) else "OK", got if isinstance(got, int) else 0))

    count = lambda name: files.open(name, n.schema).count()
    step("create a", lambda: files.create("a", n) or count("a"))
    step("create b", lambda: files.create("b", r) or count("b"))
    step("open a", lambda: count("a"))
    step("setxattr a", lambda: files.set_xattrs("a", {"user.seg": "value"}))
    step("getxattr a", lambda: files.xattr("a", "user.seg"))
    step("create a", lambda: files.create("a", r) or count("a"))
    step("unlink a", lambda: files.unlink("a"))
    step("open a", lambda: count("a"))
    step("getxattr a", lambda: files.xattr("a", "user.seg"))
    step("unlink a", lambda: files.unlink("a"))
    step("open b", lambda: count("b"))
    return spark.createDataFrame(rows, "step int, operation string, status string, n int")


@query("a_y13_book_size", f"select p_partkey as file, {_KIND} as fstype, case {_KIND} when 'tmpfs' then cast(8388608 as bigint) when 'lfs' then 8589934592 end as booksize from part")
def book_size(spark, sf):
    """The book of each file's file system; null where it has none."""
    kind = F.when(F.col("p_type") == "ECONOMY", "tmpfs").when(F.col("p_type") == "STANDARD", "lfs").otherwise("ext4")
    return src.with_book_size(t.read(spark, sf, "part").select(F.col("p_partkey").alias("file"), kind.alias("fstype")))


_MAPS = "select n_nationkey as line, printf('%x-%x rw-p 00000000 00:00 0 %s', 4096 * (n_nationkey + 1), 4096 * (n_nationkey + 3), case when n_nationkey % 2 = 0 then '[heap]' else n_name end) as text from nation"


@query("a_s24_process_ranges", f"with m as ({_MAPS}) select line, 4096 * (cast(line as bigint) + 1) as lo, 4096 * (cast(line as bigint) + 3) as hi from m where text like '%[heap]' order by line limit 1")
def process_ranges(spark, sf):
    """The address range of the first mapping of a name, parsed from lines of a process's maps."""
    n = t.read(spark, sf, "nation")
    name = F.when(F.pmod("n_nationkey", F.lit(2)) == 0, "[heap]").otherwise(F.col("n_name"))
    lines = n.select(F.col("n_nationkey").alias("line"), F.format_string("%x-%x rw-p 00000000 00:00 0 %s", 4096 * (F.col("n_nationkey") + 1), 4096 * (F.col("n_nationkey") + 3), name).alias("text"))
    return src.parse_maps(lines, "[heap]").orderBy("line").limit(1).select("line", "lo", "hi")


@query("a_s25_list_entries")
def list_entries(spark, sf):
    """Paths and lengths of a directory's entries; contents are not read."""
    return src.list_entries(spark, sf)


@query("a_s26_matched_blocks", "select p_brand, cast(count(*) as bigint) as matched, cast(sum(p_size * 1000 // 4096) as bigint) as blocks from part where regexp_full_match(p_name, 'red .*') group by p_brand")
def matched_blocks(spark, sf):
    """Files whose base name matches a pattern wholly, and the blocks they hold. Nothing is deleted."""
    f = t.read(spark, sf, "part").select("p_brand", F.concat(F.lit("/data/"), "p_name", F.lit(".dat")).alias("path"), (F.col("p_size").cast("long") * 1000).alias("size"))
    return src.matched_blocks(f, "red .*", 4096, "p_brand")


@query("a_s30_xattr_table", f"with a as ({_XA}) select file, cast(cardinality(x) as integer) as n, x['user.seg'] as seg from a")
def xattr_table(spark, sf):
    """Attribute maps stored as a Parquet map column and read back."""
    x = F.create_map(F.lit("user.seg"), F.col("c_mktsegment"), F.lit("user.nation"), F.col("c_nationkey").cast("string"))
    path = scratch_path(spark)
    src.create(t.read(spark, sf, "customer").select(F.col("c_custkey").alias("file"), x.alias("x")), path)
    back = spark.read.schema("file long, x map<string,string>").parquet(path)
    return back.select("file", F.size("x").alias("n"), F.col("x")["user.seg"].alias("seg"))


@query("a_s32_log_severity", "select event_id, event_type from events where event_type in ('error', 'purchase')")
def log_severity(spark, sf):
    """Messages of at least a threshold's severity, by ordinal."""
    e = t.read(spark, sf, "events").select("event_id", "event_type")
    return src.at_least(e, "event_type", ["view", "click", "signup", "purchase", "error"], "purchase")
