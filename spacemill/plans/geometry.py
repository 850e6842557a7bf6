"""Size classes, slabs, bitmaps, scalar functions, pointer arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from spacemill.functions import bitmap as bm
from spacemill.functions import geometry as geo
from spacemill.functions import scalars as sc
from spacemill.operators import extents as ex
from spacemill.plans.base import FX, POS, PR, SIZES, query
from spacemill.sources import tables as t

SLAB = 262144
#: The class table in SQL, by the same runs.
_RUNS = " union all ".join(f"select {i} as run, unnest(range({lo}, {hi + 1}, {step})) as bytes" for i, (lo, hi, step) in enumerate(geo.SIZE_CLASS_RUNS))
DIM = f"dim as (select cast(row_number() over (order by run, bytes) - 1 as integer) as cls, bytes from ({_RUNS}))"
_MOST = "((262144 - 19) * 8 // (1 + 8 * bytes))"
_HEAD = f"((18 + ({_MOST} + 7) // 8 + 63) // 64 * 64)"
GEO = f"{DIM}, geo as (select cls, bytes, {_MOST} as most, {_HEAD} as header, (262144 - {_HEAD}) // bytes as nblocks from dim)"


@query("a_g1_sizeclass", f"with {SIZES}, {DIM}, s as (select *, size // (1 + pk % 512) as ask from sz), c as (select distinct ask from s), f as (select ask, (select min(cls) from dim where bytes >= ask) as cls from c) select ok, ln, pk, s.ask, f.cls from s join f using (ask)")
def sizeclass(spark, sf):
    """The first class, in table order, that holds each request; requests are first spread over small sizes."""
    ask = geo.div(F.col("size"), F.pmod("pk", F.lit(512)) + 1)
    return t.size_requests(spark, sf).withColumn("ask", ask).select("ok", "ln", "pk", "ask", geo.sizeclass(F.col("ask")).alias("cls"))


@query("a_g2_size_from_class", f"with {DIM} select p_partkey, cast(p_partkey % 120 as integer) as cls, dim.bytes from part left join dim on dim.cls = p_partkey % 120")
def size_from_class(spark, sf):
    c = F.pmod("p_partkey", F.lit(120)).cast("int")
    return t.read(spark, sf, "part").select("p_partkey", c.alias("cls"), geo.size_from_class(c).alias("bytes"))


@query("a_g3_g4_slab_geometry", f"with {GEO} select * from geo")
def slab_geometry(spark, sf):
    d, b = geo.size_classes(spark), F.col("bytes")
    return d.select("cls", "bytes", geo.max_slab_blocks(SLAB, b).alias("most"), geo.slab_header(SLAB, b).alias("header"), geo.slab_blocks(SLAB, b).alias("nblocks"))


#: Slabs: one a supplier, of a class by its key, with the parts below its block count as used blocks.
SLABS = f"""{GEO}, sl as (select s_suppkey as slab, g.cls, g.bytes, g.nblocks from supplier join geo g on g.cls = 40 + s_suppkey % 70),
us as (select distinct l_suppkey as slab, l_partkey as bit from lineitem), oc as (select sl.slab, cls, bytes, nblocks, count(us.bit) as used from sl left join us on us.slab = sl.slab and us.bit < sl.nblocks group by all)"""


def slabs(spark, sf):
    """slab, cls, bytes, nblocks, used. A slab's used blocks are counted on packed bitmaps."""
    s = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("slab"), (F.pmod("s_suppkey", F.lit(70)) + 40).cast("int").alias("cls"))
    s = s.withColumn("bytes", geo.size_from_class(F.col("cls")))
    s = s.withColumn("nblocks", geo.slab_blocks(SLAB, F.col("bytes")))
    held = t.positions(spark, sf).withColumnRenamed("map", "slab").join(s.select("slab", "nblocks"), "slab").where("bit < nblocks")
    maps = bm.construct(held, "slab", "bit").groupBy("slab").agg(F.sum(F.bitmap_count("bits")).alias("used"))
    return s.join(maps, "slab", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))


@query("a_g5_fullness", f"with {SLABS} select slab, nblocks, used, cast(2 * used // nblocks as integer) as bin from oc")
def fullness(spark, sf):
    return slabs(spark, sf).select("slab", "nblocks", "used", geo.fullness(F.col("used"), F.col("nblocks")).alias("bin"))


#: Blocks of a slab's extent in the heaps of extents, and the class of the slab in one.
SLAB_BLOCKS = 16
_SLAB_CLASS = "40 + (k * 31 + start) % 70"


@query("a_g6_getsize", f"with {FX}, {PR}, {DIM}, a as (select p.id, p.k, p.addr, x.start, x.len from pr p left join fx x on x.k = p.k and p.addr >= x.start and p.addr < x.start + x.len) select id, a.k, addr, case when start is null then 0 when len = {SLAB_BLOCKS} then dim.bytes else len * 4096 end as bytes from a left join dim on len = {SLAB_BLOCKS} and dim.cls = {_SLAB_CLASS}")
def getsize(spark, sf):
    """Bytes behind an address of a hybrid heap: a slab's block size where its extent is a slab, else the extent's bytes, 0 where none holds it."""
    slab_class = (F.pmod(F.col("k") * 31 + F.col("start"), F.lit(70)) + 40).cast("int")
    free = ex.coalesce(t.intervals(spark, sf), width=512)
    slabs = free.where(F.col("len") == SLAB_BLOCKS).select("k", "start", slab_class.alias("cls"))
    return ex.stored_size(free, slabs, t.probes(spark, sf), 4096, SLAB_BLOCKS, width=512)


@query("a_g7_free_blocks", f"with {SLABS} select slab, nblocks - used as free, used = nblocks as \"full\", used = 0 as empty from oc")
def free_blocks(spark, sf):
    return slabs(spark, sf).select("slab", (F.col("nblocks") - F.col("used")).alias("free"), (F.col("used") == F.col("nblocks")).alias("full"), (F.col("used") == 0).alias("empty"))


@query("a_g8_find_slab", f"with {SLABS}, r as (select *, row_number() over (partition by cls order by 2 * used // nblocks desc, slab desc) as rn from oc where used > 0 and used < nblocks) select cls, slab, used from r where rn = 1")
def find_slab(spark, sf):
    """Of each class the latest slab of the fullest bin with room. A maximum, so it combines before the shuffle."""
    s = slabs(spark, sf).where("used > 0 and used < nblocks")
    best = F.max(F.struct(geo.fullness(F.col("used"), F.col("nblocks")).alias("bin"), "slab", "used"))
    return s.groupBy("cls").agg(best.alias("b")).select("cls", "b.slab", "b.used")


@query("a_g9_occupancy", f"with {SLABS} select cast(case when used = 0 then -1 else 2 * used // nblocks end as integer) as bin, cls, count(*) as slabs, cast(sum(nblocks) as bigint) as blocks, cast(sum(nblocks - used) as bigint) as free from oc group by 1, 2")
def occupancy(spark, sf):
    """Slabs by fullness and class, the empty ones apart (bin -1)."""
    b = F.when(F.col("used") == 0, -1).otherwise(geo.fullness(F.col("used"), F.col("nblocks")))
    return slabs(spark, sf).groupBy(b.alias("bin"), "cls").agg(F.count("*").alias("slabs"), F.sum("nblocks").alias("blocks"), F.sum(F.col("nblocks") - F.col("used")).alias("free"))


@query("a_g10_block_ids", f"with {GEO} select s_suppkey as slab, header + (s_suppkey % nblocks) * bytes as addr, (s_suppkey % nblocks * bytes + bytes // 2) // bytes as block_of_interior from supplier join geo on cls = 40 + s_suppkey % 70")
def block_ids(spark, sf):
    """A block's address from its id, and the id of an address inside it."""
    s = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("slab"), geo.size_from_class((F.pmod("s_suppkey", F.lit(70)) + 40).cast("int")).alias("bytes"))
    n, h = geo.slab_blocks(SLAB, F.col("bytes")), geo.slab_header(SLAB, F.col("bytes"))
    off = F.pmod("slab", n) * F.col("bytes")
    return s.select("slab", (h + off).alias("addr"), geo.div(off + geo.div(F.col("bytes"), 2), F.col("bytes")).alias("block_of_interior"))


@query("a_g11_slab_text", f"with {SLABS} select slab, '(' || bytes || ', ' || nblocks || ', ' || (nblocks - used) || ')' as text from oc")
def slab_text(spark, sf):
    return slabs(spark, sf).select("slab", F.format_string("(%d, %d, %d)", "bytes", "nblocks", F.col("nblocks") - F.col("used")).alias("text"))


@query("a_g12_block_size", "select n_nationkey as k, cast(1 as bigint) << n_nationkey as bytes from nation")
def block_size(spark, sf):
    return t.read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), geo.block_size(F.col("n_nationkey")).alias("bytes"))


@query("a_g13_reset", f"with {GEO} select s_suppkey as slab, g.cls, g.nblocks, g.nblocks as free from supplier join geo g on g.cls = 50 + s_suppkey % 60")
def reset(spark, sf):
    """Slabs formatted anew for another class, all blocks free."""
    cls = (F.pmod("s_suppkey", F.lit(60)) + 50).cast("int")
    s = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("slab"), cls.alias("cls"), geo.slab_blocks(SLAB, geo.size_from_class(cls)).alias("nblocks"))
    return s.withColumn("free", F.col("nblocks"))


@query("a_b1_b5_b6_layout", "select p_partkey as bit, (p_partkey + 7) // 8 as bytes, p_partkey >> 3 as elt, cast(1 << (p_partkey & 7) as integer) as mask, cast((p_size + 7) // 8 as integer) as zero_bytes from part")
def layout(spark, sf):
    p, b = t.read(spark, sf, "part"), F.col("p_partkey")
    zero = F.unhex(F.repeat(F.lit("00"), geo.div(F.col("p_size") + 7, 8).cast("int")))
    return p.select(b.alias("bit"), bm.size_of(b).alias("bytes"), bm.element(b).alias("elt"), bm.mask(b).alias("mask"), F.octet_length(zero).alias("zero_bytes"))


@query("a_b2_set", f"with {POS} select map, count(*) as n, min(bit) as lo, max(bit) as hi from ps group by map")
def bitmap_set(spark, sf):
    """Positions packed into words of bits, and read from them again."""
    bits = bm.word_positions(bm.words(t.positions(spark, sf), "map", "bit"), "map")
    return bits.groupBy("map").agg(F.count("*").alias("n"), F.min("bit").alias("lo"), F.max("bit").alias("hi"))


@query("a_b3_clear", f"with {POS} select map, bit from ps where bit % 7 <> 0")
def bitmap_clear(spark, sf):
    """The bits left after those divisible by 7 were cleared, in the packed words."""
    return bm.word_positions(bm.words(t.positions(spark, sf), "map", "bit", cleared=F.col("bit") % 7 == 0), "map")


@query("a_b4_is_set", f"with {POS}, {PR} select pr.id, pr.k, pr.id % 512 as bit, ps.map is not null as is_set from pr left join ps on ps.map = pr.k and ps.bit = pr.id % 512")
def bitmap_is_set(spark, sf):
    """Probes of single bits, answered on the packed form."""
    maps = bm.words(t.positions(spark, sf), "map", "bit").withColumnRenamed("map", "k")
    p = t.probes(spark, sf).select("id", "k", F.pmod("id", F.lit(512)).alias("bit")).withColumn("word", F.shiftright("bit", 6))
    p = p.join(maps, ["k", "word"], "left")
    return p.select("id", "k", "bit", F.coalesce(bm.is_set(F.col("bits"), F.col("bit")), F.lit(False)).alias("is_set"))


@query("a_b7_load", f"with {POS} select map, count(*) as set_bits, cast(4096 as integer) as bytes from ps group by map")
def bitmap_load(spark, sf):
    """Stored bitmaps taken as they are: the set bits of all buckets of a map, and the bytes of one bucket."""
    m = bm.construct(t.positions(spark, sf), "map", "bit")
    return m.groupBy("map").agg(F.sum(F.bitmap_count("bits")).alias("set_bits"), F.max(F.octet_length("bits")).alias("bytes"))


@query("a_f1_string_to_size", "select p_partkey, p_size || ['', 'k', 'M', 'G'][1 + p_partkey % 4] as s, cast(p_size as bigint) * [1, 1024, 1048576, 1073741824][1 + p_partkey % 4] as bytes from part")
def string_to_size(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ["", "k", "M", "G"])), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    p = t.read(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("s"))
    return p.withColumn("bytes", sc.string_to_size(F.col("s")))


@query("a_f2_split", "select p_partkey, case when p_partkey % 2 = 0 then string_split(p_name, ' ') else string_split(p_name, 'e') end as raw, case when raw[len(raw)] = '' then raw[1:len(raw)-1] else raw end as parts from part")
def split(spark, sf):
    p = t.read(spark, sf, "part").withColumn("even", F.pmod("p_partkey", F.lit(2)) == 0)
    raw = F.when(F.col("even"), F.split("p_name", " ")).otherwise(F.split("p_name", "e"))
    parts = F.when(F.col("even"), sc.split_string(F.col("p_name"), " ")).otherwise(sc.split_string(F.col("p_name"), "e"))
    return p.select("p_partkey", raw.alias("raw"), parts.alias("parts"))


@query("a_f3_expand_range", "select p_partkey, (p_size % 9) || '-' || (p_size % 13) || ',' || p_size as s, list_sort(list_concat(case when p_size % 9 <= p_size % 13 then range(cast(p_size % 9 as bigint), p_size % 13 + 1) else [] end, [cast(p_size as bigint)])) as numbers from part")
def expand_range(spark, sf):
    c = lambda n: F.pmod("p_size", F.lit(n)).cast("string")
    p = t.read(spark, sf, "part").select("p_partkey", F.concat(c(9), F.lit("-"), c(13), F.lit(","), F.col("p_size").cast("string")).alias("s"))
    return p.withColumn("numbers", sc.expand_range(F.col("s")))


@query("a_f4_common_prefix", "with g as (select p_type, p_brand, min(p_name) as lo, max(p_name) as hi from part group by 1, 2) select p_type || p_brand as g, left(lo, cast(coalesce(list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda i: left(lo, i) = left(hi, i))), 0) as bigint)) as prefix from g")
def common_prefix(spark, sf):
    p = t.read(spark, sf, "part").select(F.concat("p_type", "p_brand").alias("g"), "p_name")
    return sc.longest_common_prefix(p, "g", "p_name")


@query("a_f5_hex", "select p_partkey, printf('0x%X', p_partkey) as plain, printf('0x%08X', p_partkey) as padded from part")
def hex_number(spark, sf):
    k = F.col("p_partkey")
    return t.read(spark, sf, "part").select("p_partkey", sc.hex_number(k).alias("plain"), sc.hex_number(k, 8).alias("padded"))


@query("a_f6_hex_string", "select p_partkey, '0x' || rtrim(regexp_replace(substr(hex(encode(p_name)), 1, 16), '(.{16})', '\\1 ', 'g')) || case when strlen(p_name) > 8 then ' (' || (strlen(p_name) - 8) || ' more bytes)' else '' end as text from part")
def hex_string(spark, sf):
    return t.read(spark, sf, "part").select("p_partkey", sc.hex_string(F.col("p_name"), 8).alias("text"))


@query("a_f7_f8_align", "select p_partkey, (p_partkey + 63) // 64 * 64 as aligned, (p_partkey + 99) // 100 * 100 as up, p_partkey // 100 * 100 as down from part")
def align(spark, sf):
    k, m = F.col("p_partkey"), F.lit(100).cast("long")
    return t.read(spark, sf, "part").select("p_partkey", geo.align(k, 64).alias("aligned"), geo.round_up(k, m).alias("up"), geo.round_down(k, m).alias("down"))


@query("a_f9_f10_predicates", "select p_partkey, p_partkey % 8 = 0 as is_aligned, bit_count(p_partkey) = 1 as power_of_two from part")
def predicates(spark, sf):
    k = F.col("p_partkey")
    return t.read(spark, sf, "part").select("p_partkey", geo.is_aligned(k, 8).alias("is_aligned"), geo.is_power_of_two(k).alias("power_of_two"))


_FLAGS = ", ".join(f"case when (f & {bit}) <> 0 then '{name}' end" for name, bit in sc.OPEN_FLAGS)


@query("a_f11_flags", f"with x as (select p_partkey, cast(p_partkey * 37 % 32768 as integer) as f from part) select p_partkey, f as flags, concat_ws('|', {_FLAGS}) as names from x")
def flags(spark, sf):
    f = F.pmod(F.col("p_partkey") * 37, F.lit(32768)).cast("int")
    return t.read(spark, sf, "part").select("p_partkey", f.alias("flags"), sc.flags_to_text(f).alias("names"))


@query("a_f12_unique_names")
def unique_names(spark, sf):
    """Random names of a model; they differ from run to run."""
    return t.read(spark, sf, "nation").select("n_nationkey", sc.unique_name(F.lit("seg-%%%%-%%%%")).alias("name"))


@query("a_f21_interval_text", "select l_orderkey, l_linenumber, l_partkey, '(' || l_partkey || ', ' || cast(l_quantity as bigint) || ')' as text from lineitem")
def interval_text(spark, sf):
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.format_string("(%d, %d)", "l_partkey", F.col("l_quantity").cast("long")).alias("text"))


@query("a_a1_a3_pointers", "select l_orderkey, l_partkey, l_partkey * 1000 + 8 * l_linenumber as p_plus_n, (l_partkey * 1000 + 8 * l_linenumber - l_partkey * 1000) // 8 as n_back, l_partkey * 1000 + 8 as next, l_partkey * 1000 - 8 as prev from lineitem")
def pointers(spark, sf):
    """Element-scaled arithmetic of pointers to elements of 8 bytes."""
    p, n = F.col("l_partkey") * 1000, F.col("l_linenumber")
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (p + n * 8).alias("p_plus_n"), geo.div(p + n * 8 - p, 8).alias("n_back"), (p + 8).alias("next"), (p - 8).alias("prev"))


_A2 = ", ".join(f"l_partkey {op} l_suppkey as {n}" for n, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")))


@query("a_a2_pointer_compare", f"select l_orderkey, l_partkey, l_suppkey, {_A2} from lineitem")
def pointer_compare(spark, sf):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (a == b).alias("eq"), (a != b).alias("ne"), (a < b).alias("lt"), (a <= b).alias("le"), (a > b).alias("gt"), (a >= b).alias("ge"))


_RP = "with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey % 3 as ra, l_partkey as oa, l_suppkey % 2 as rb, l_suppkey as ob from lineitem)"


@query("a_a5_a9_region_pointers", f"{_RP} select *, ra = rb and oa = ob as eq, ra = rb and oa < ob as lt from p")
def region_pointers(spark, sf):
    """(region, offset) pointers: equal as structs, ordered within a region only."""
    li = t.read(spark, sf, "lineitem")
    p = li.select("l_orderkey", "l_linenumber", "l_partkey", F.pmod("l_suppkey", F.lit(3)).alias("ra"), F.col("l_partkey").alias("oa"), F.pmod("l_suppkey", F.lit(2)).alias("rb"), F.col("l_suppkey").alias("ob"))
    a, b = F.struct(F.col("ra").alias("r"), F.col("oa").alias("o")), F.struct(F.col("rb").alias("r"), F.col("ob").alias("o"))
    return p.select("*", (a == b).alias("eq"), ((F.col("ra") == F.col("rb")) & (F.col("oa") < F.col("ob"))).alias("lt"))


@query("a_a6_a7_resolve", f"with {PR}, rg as (select s_suppkey as k, s_suppkey * 100000 as base from supplier) select pr.id, rg.k as region, rg.base + pr.id % 1000 as addr from pr join rg on pr.addr + pr.k * 100000 >= rg.base and pr.addr + pr.k * 100000 < rg.base + 100000")
def resolve(spark, sf):
    """Offsets whose region is that of the address they are stored at: the holder's region by interval join, then base plus offset."""
    from spacemill.operators.extents import interval_join

    r = t.read(spark, sf, "supplier").select(F.lit(0).cast("long").alias("z"), F.col("s_suppkey").alias("region"), (F.col("s_suppkey") * 100000).alias("base"))
    r = r.withColumn("limit", F.col("base") + 100000)
    p = t.probes(spark, sf).select("id", F.lit(0).cast("long").alias("z"), (F.col("addr") + F.col("k") * 100000).alias("holder"))
    j = interval_join(p, r, "z", "holder", 100000, "base", "limit", "inner")
    return j.select("id", "region", (F.col("base") + F.pmod("id", F.lit(1000))).alias("addr"))
