"""Ranges of concatenated files, and the placement of books over nodes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spacemill.errors import SpaceError
from spacemill.functions import geometry as geo
from spacemill.operators import ranges as rg
from spacemill.plans.base import BASED, BOOKS, FILES, query
from spacemill.sources import tables as t

OFFSET, LENGTH = 20, 50
_CLIP = f"""{BASED}, cl as (select g, seq, greatest(base, {OFFSET}) - base as file_offset, greatest(base, {OFFSET}) - {OFFSET} as map_offset, least(base + size, {OFFSET + LENGTH}) - greatest(base, {OFFSET}) as length from fb)"""


def clipped(spark, sf):
    return rg.clip(t.files(spark, sf), F.lit(OFFSET).cast("long"), F.lit(LENGTH).cast("long"))


@query("a_c1_total_size", "select l_orderkey as g, cast(sum(cast(l_quantity as bigint)) as bigint) as size from lineitem group by 1")
def total_size(spark, sf):
    li = t.read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("g")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))


@query("a_c2_map_range", f"with {_CLIP} select cast(g as bigint) as g, cast(seq as integer) as seq, file_offset, map_offset, length from cl where length > 0")
def map_range(spark, sf):
    return clipped(spark, sf)


@query("a_c3_contiguous", f"with {_CLIP} select distinct g, true as contiguous from cl where length > 0")
def contiguous(spark, sf):
    return rg.contiguous(clipped(spark, sf))


@query("a_c4_nodes_of_range", f"with {_CLIP}, x as (select g, seq, cast(seq * 7 % 4 as integer) as node from cl where length > 0) select g, list(node order by seq) as nodes from x group by g")
def nodes_of_range(spark, sf):
    """Placement of a clipped range: each part's node, in file order."""
    p = clipped(spark, sf).withColumn("node", F.pmod(F.col("seq") * 7, F.lit(4)).cast("int"))
    got = p.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("seq", "node"))).alias("n"))
    return got.select("g", F.transform("n", lambda x: x["node"]).alias("nodes"))


@query("a_c7_book_size", f"with {FILES} select g, arg_min(size, seq) as booksize from fl group by g")
def book_size(spark, sf):
    return t.files(spark, sf).groupBy("g").agg(F.min_by("size", "seq").alias("booksize"))


@query("a_p1_precise", f"with {BOOKS} select file, nbooks, i, cast(coalesce([2, 3, 2, 3, 2, 3][i + 1], 0) as integer) as node from bk")
def precise(spark, sf):
    """Books as asked: six nodes are given, further books go to node 0."""
    want = F.array(*[F.lit(x) for x in (2, 3, 2, 3, 2, 3)])
    return rg.place_requested(t.books(spark, sf), want)


@query("a_p2_round_robin", f"with {BOOKS} select *, cast(i % 3 as integer) as node from bk")
def round_robin(spark, sf):
    return rg.place_round_robin(t.books(spark, sf), 3)


@query("a_p3_nodes", f"with {BOOKS}, a as (select file, list(cast(i * 5 % 4 as integer) order by i) as nodes from bk group by file) select file, nodes[2:5] as part from a")
def nodes(spark, sf):
    """The nodes of a byte range of each file, clipped and rounded out to books of 4096."""
    a = rg.place_round_robin(t.books(spark, sf).withColumn("i2", F.col("i") * 5), 4)
    a = a.groupBy("file", "nbooks").agg(F.sort_array(F.collect_list(F.struct("i", F.pmod("i2", F.lit(4)).cast("int").alias("node")))).alias("n"))
    first, count = rg.book_range(F.lit(5000).cast("long"), F.lit(12000).cast("long"), F.col("nbooks") * 4096, 4096)
    return a.select("file", F.slice(F.transform("n", lambda x: x["node"]), (first + 1).cast("int"), count.cast("int")).alias("part"))


@query("a_p4_set_nodes", f"with {BOOKS} select file, list(cast(case when i >= 2 and i < 7 then [5, 6, 7][i % 3 + 1] else 0 end as integer) order by i) as nodes from bk group by file")
def set_nodes(spark, sf):
    """Books 2 to 6 set round three nodes; the book's absolute number picks the node."""
    f = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.array_repeat(F.lit(0), (F.pmod("s_suppkey", F.lit(16)) + 1).cast("int")).alias("nodes"))
    return f.select("file", rg.set_nodes(F.col("nodes"), F.lit(2), F.lit(5), F.array(*map(F.lit, (5, 6, 7)))).alias("nodes"))


@query("a_p5_place_files", "select s_suppkey as file, cast((row_number() over (partition by s_nationkey order by s_suppkey) - 1) % 4 as integer) as node from supplier")
def place_files(spark, sf):
    """Files of a nation round the nodes."""
    w = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    return t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.pmod(F.row_number().over(w) - 1, F.lit(4)).cast("int").alias("node"))


@query("a_p6_striped", f"with {BOOKS} select file, nbooks, i, case when nbooks % 3 = 0 then cast(i // 3 % 4 as integer) end as node, case when nbooks % 3 = 0 then 'OK' else 'InvalidParameter' end as status from bk")
def striped(spark, sf):
    """Stripes of three books over four nodes; files whose size is no multiple of a stripe are refused."""
    return rg.place_striped(t.books(spark, sf), 3 * 4096, 4096, 4)


_HOSTS = """nd as (select s_nationkey as host, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as node from supplier),
mx as (select host, max(node) as top from nd group by host), pc as (select c_custkey as process, c_nationkey as host, c_custkey % 40 as cpu from customer)"""


@query("a_p8_topology", f"with {_HOSTS} select process, pc.host, cast(mx.top as integer) as max_node, cast(nd.node as integer) as nearest from pc left join mx on mx.host = pc.host left join nd on nd.host = pc.host and nd.node = pc.cpu // 4")
def topology(spark, sf):
    """The highest node of each process's host, and the node that has the CPU it runs on: a host's suppliers are its nodes, of four CPUs each."""
    w = W.partitionBy("host").orderBy("s_suppkey")
    nodes = t.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("host"), "s_suppkey").select("host", (F.row_number().over(w) - 1).alias("node"))
    cpus = nodes.select("host", "node", (F.col("node") * 4).alias("first_cpu"))
    c = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("process"), F.col("c_nationkey").alias("host"), F.pmod("c_custkey", F.lit(40)).alias("cpu"))
    return rg.topology(c, cpus, 4)


@query("a_c6_unsupported", "select unnest(['create', 'truncate', 'getxattr', 'setxattr', 'set_interleave_group']) as operation, 'NotSupported' as status")
def unsupported(spark, sf):
    """What a file of several files does not do; each operation raises."""
    file, rows = rg.MultiRegionFile([f"{sf}/supplier.parquet", f"{sf}/nation.parquet"]), []
    for operation in rg.MultiRegionFile.UNSUPPORTED:
        try:
            getattr(file, operation)()
        except SpaceError as e:
            rows.append((operation, e.name))
    return spark.createDataFrame(rows, "operation string, status string")


_NODE = "nd as (select s_suppkey + 1 as id, s_suppkey // 80 + 1 as rack, s_suppkey // 10 % 8 + 1 as encl, s_suppkey % 10 + 1 as node from supplier)"


def _nodes(spark, sf):
    s = t.read(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("id"))
    return s.select("id", geo.node_parts(F.col("id")).alias("n"))


@query("a_p9_node_codec", f"with {_NODE} select *, (rack - 1) * 80 + (encl - 1) * 10 + node as back from nd")
def node_codec(spark, sf):
    n = _nodes(spark, sf)
    return n.select("id", "n.*", geo.node_id(F.col("n.rack"), F.col("n.encl"), F.col("n.node")).alias("back"))


@query("a_p10_hops", f"with {_NODE}, pr as (select cast(n_nationkey + 1 as bigint) as a, id as b from nation, nd) select pr.a as a, pr.b as b, case when x.encl <> y.encl then 5 when x.node <> y.node then 3 else 1 end as hops from pr join nd x on x.id = pr.a join nd y on y.id = pr.b")
def hops(spark, sf):
    """Hops from each of the nations' nodes to every node; the few are counted, and more than a thousand are refused."""
    n = _nodes(spark, sf)
    few = t.read(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"))
    few = few.join(n.select("id"), "id", "left_semi").select(F.col("id").alias("a"))
    pairs = rg.with_each(n.select(F.col("id").alias("b"), F.col("n").alias("y")), few, "x")
    return pairs.select(F.col("x.a").alias("a"), "b", "y").withColumn("x", geo.node_parts(F.col("a"))).select("a", "b", geo.hops(F.col("x"), F.col("y")).alias("hops"))


@query("a_p11_region_nodes", f"with {BOOKS} select s_suppkey as region, bk.i, cast(bk.i % 3 as integer) as node from supplier join bk on bk.file = s_suppkey")
def region_nodes(spark, sf):
    """A region's placement is that of its file."""
    r = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("region"))
    placed = rg.place_round_robin(t.books(spark, sf), 3).select(F.col("file").alias("region"), "i", "node")
    return r.join(placed, "region")
