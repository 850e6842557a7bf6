"""Configuration, error codes and registries as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from spacemill.functions import scalars as sc
from spacemill.plans.base import IV, query
from spacemill.sources import config as cf
from spacemill.sources import files as src
from spacemill.sources import tables as t


@query("a_f13_error_text", "select p_partkey, cast(p_partkey % 5 * 256 + p_partkey % 18 as integer) as code, " + cf.error_sql("p_partkey % 5 * 256 + p_partkey % 18", "name") + " as name, " + cf.error_sql("p_partkey % 5 * 256 + p_partkey % 18", "message") + " as message from part")
def error_text(spark, sf):
    """Names and messages of error codes; unknown codes have none."""
    p = t.read(spark, sf, "part").select("p_partkey", (F.pmod("p_partkey", F.lit(5)) * 256 + F.pmod("p_partkey", F.lit(18))).cast("int").alias("code"))
    return p.join(F.broadcast(cf.error_codes(spark)), "code", "left").select("p_partkey", "code", "name", "message")


@query("a_f14_os_error", "select p_partkey, '[Errno ' || (p_partkey % 5) || '] ' || coalesce(" + cf.errno_sql("p_partkey % 5") + ", 'Unknown error') as text from part")
def os_error(spark, sf):
    p = t.read(spark, sf, "part").select("p_partkey", F.pmod("p_partkey", F.lit(5)).alias("errno"))
    d = p.join(F.broadcast(cf.errnos(spark)), "errno", "left")
    return d.select("p_partkey", F.concat(F.lit("[Errno "), F.col("errno").cast("string"), F.lit("] "), F.coalesce("text", F.lit("Unknown error"))).alias("text"))


@query("a_f16_defaults", "select event_id, coalesce(cast(json_extract_string(props, '$.k') as integer), -1) as k, coalesce(json_extract_string(props, '$.none'), 'default') as missing from events")
def defaults(spark, sf):
    """Elements of a configuration text: present, or the default."""
    e = t.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", sc.config_value(k, F.lit(-1)).alias("k"), sc.config_value(F.get_json_object("props", "$.none"), F.lit("default")).alias("missing"))


@query("a_f17_enum", "select event_id, cast(event_id % 3 as integer) as kind from events")
def enum(spark, sf):
    """Enumeration values, checked; another value is an error."""
    e = t.read(spark, sf, "events").select("event_id", F.pmod("event_id", F.lit(3)).cast("int").alias("kind"))
    return e.select("event_id", sc.config_enum(F.col("kind"), [0, 1, 2], "kind").alias("kind"))


@query("a_f18_size_element", "select p_partkey, coalesce(case when p_partkey % 3 > 0 then cast(p_size as bigint) * 1024 end, 4096) as bytes from part")
def size_element(spark, sf):
    s = F.when(F.pmod("p_partkey", F.lit(3)) > 0, F.concat(F.col("p_size").cast("string"), F.lit("K")))
    return t.read(spark, sf, "part").select("p_partkey", F.coalesce(sc.string_to_size(s), F.lit(4096).cast("long")).alias("bytes"))


@query("a_f19_a_f20_emit", "select s_suppkey, s_name as name, s_nationkey as nation from supplier")
def emit(spark, sf):
    """Nested elements written as text and read from it again."""
    s = t.read(spark, sf, "supplier")
    text = F.to_json(F.struct(F.col("s_suppkey"), F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("child")))
    back = F.from_json(text, "s_suppkey long, child struct<name:string,nation:int>")
    return s.select(back.alias("c")).select("c.s_suppkey", F.col("c.child.name").alias("name"), F.col("c.child.nation").alias("nation"))


@query("a_s27_s28_s29_options", "select * from (values ('child.name', 'test_string'), ('foo_bool', 'True'), ('foo_enum', '1'), ('foo_size', '128K'), ('foo_vector', '[1, 2, 3]')) o(name, value)")
def options(spark, sf):
    """Options from a text, saved, read again and overridden by command-line arguments."""
    text = "foo_bool: true\nfoo_size: 128K\nfoo_vector: [1, 2, 3]\nchild:\n  name: test_string\n"
    first = cf.Options.from_text(text)
    again = cf.Options.from_text(first.to_text()).with_arguments(["--foo_enum=1"])
    return spark.createDataFrame([(str(k), str(v)) for k, v in sorted(again.flat().items())], "name string, value string")


@query("a_x1_layers", "select n_nationkey as k, coalesce(case when n_nationkey % 5 = 0 then 'file' end, case when n_nationkey % 3 = 0 then 'environment' end, 'system') as value from nation")
def layers(spark, sf):
    """Layered configuration, the later layer winning: system, environment, file."""
    k = F.col("n_nationkey")
    return t.read(spark, sf, "nation").select(k.alias("k"), cf.layered(F.lit("system"), F.when(k % 3 == 0, "environment"), F.when(k % 5 == 0, "file")).alias("value"))


@query("a_x3_x4_registry", """with f as (select c_nationkey as region, min(c_custkey) as seq from customer group by 1) select 'map' as operation, c_custkey as seq, cast(c_nationkey as bigint) as region, case when f.seq = c_custkey then 'OK' else 'MemoryDuplicateMapping' end as status from customer join f on f.region = c_nationkey
union all select 'unmap', n_nationkey, n_nationkey * 2, case when f.region is null then 'MemoryUnknownMapping' else 'OK' end from nation left join f on f.region = n_nationkey * 2""")
def registry(spark, sf):
    """Requests to map regions, of which the first of an id is taken and others are refused, and to unmap some."""
    c = t.read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("seq"), F.col("c_nationkey").cast("long").alias("region"))
    u = t.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), (F.col("n_nationkey") * 2).cast("long").alias("region"))
    mapped = src.map_regions(c)
    return mapped.select(F.lit("map").alias("operation"), "*").unionByName(src.unmap_regions(u, mapped).select(F.lit("unmap").alias("operation"), "*"))


@query("a_x16_block_set", f"with {IV}, d as (select distinct * from iv) select a.k, count(*) as overlaps from d a join d b on a.k = b.k and (a.start, a.len) < (b.start, b.len) and a.start < b.start + b.len and b.start < a.start + a.len group by a.k")
def block_set(spark, sf):
    """Live intervals that overlap (touching ones do not): the invariant of a workload, by a bucketed join."""
    from spacemill.operators.extents import overlap_join

    d = t.intervals(spark, sf).distinct()
    pairs = overlap_join(d, d, "k", 16, touching=False)
    once = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a_len") < F.col("b_len")))
    return pairs.where(once).groupBy("k").agg(F.count("*").alias("overlaps"))
