"""Files as tables: creating and opening, drivers by file system, attributes, listings, a registered connector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from spacemill.errors import check


def create(df: DataFrame, path: str) -> None:
    """A new region file; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def open_many(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """One or many region files as one, by an explicit schema."""
    return spark.read.schema(schema).parquet(*paths)


def dispatch(files: DataFrame, drivers: dict[str, str], kind: str = "fstype", fallback: str = "any") -> DataFrame:
    """files with ``driver``: that of the file's kind, else the fallback's."""
    spark = files.sparkSession
    table = spark.createDataFrame([(k, d) for k, d in drivers.items() if k != fallback], f"{kind} string, driver string")
    # as many rows as registered drivers
    return files.join(F.broadcast(table), kind, "left").withColumn("driver", F.coalesce("driver", F.lit(drivers.get(fallback))))


def get_xattr(attrs: Column, name: str) -> Column:
    return F.try_element_at(attrs, F.lit(name))


def set_xattr(attrs: Column, name: str, value: Column) -> Column:
    """The map with the name set or replaced."""
    return F.map_concat(F.map_filter(attrs, lambda k, _: k != name), F.create_map(F.lit(name), value))


def file_sizes(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size")).distinct()


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


# Default bytes of a book of each file system.
BOOKS = {"tmpfs": 8 << 20, "lfs": 8 << 30}


def with_book_size(files: DataFrame, kind: str = "fstype") -> DataFrame:
    """files with ``booksize``, the book of their file system, null where it has none."""
    of = F.create_map(*[F.lit(x) for k, v in BOOKS.items() for x in (k, v)]).cast("map<string,bigint>")
    return files.withColumn("booksize", F.try_element_at(of, F.col(kind)))


def mounted(files: DataFrame, mounts: DataFrame, root: str, root_kind: str) -> DataFrame:
    """files (with dev) with mount and fstype: those of the first mount, by name, of the device, else of the root."""
    first = mounts.groupBy("dev").agg(F.min(F.struct("mount", "fstype")).alias("_m"))
    m = F.col("_m")
    return files.join(first, "dev", "left").withColumns({"mount": F.coalesce(m["mount"], F.lit(root)), "fstype": F.coalesce(m["fstype"], F.lit(root_kind))}).drop("_m")


class RegionFiles:
    """Region files below a folder, each a Parquet table with its attributes in a table beside it; any store that Spark reaches will do."""

    XATTR = ".xattr"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        where, fs = self._at(self.path(name))
        return fs.exists(where)

    def create(self, name: str, df: DataFrame) -> None:
        """A new file, or one emptied and written anew."""
        df.write.mode("overwrite").parquet(self.path(name))

    def open(self, name: str, schema: StructType) -> DataFrame:
        check(self.exists(name), "FsFailedToOpen", name)
        return open_many(self.spark, [self.path(name)], schema)

    def size(self, name: str) -> int:
        """Bytes of the file's parts."""
        check(self.exists(name), "FsFailedToOpen", name)
        where, fs = self._at(self.path(name))
        return fs.getContentSummary(where).getLength()

    def set_xattrs(self, name: str, attrs: dict[str, str]) -> None:
        check(self.exists(name), "FsFailedToOpen", name)
        self.spark.createDataFrame([(attrs,)], "x map<string,string>").write.mode("overwrite").parquet(self.path(name) + self.XATTR)

    def xattr(self, name: str, attr: str) -> str | None:
        check(self.exists(name + self.XATTR), "FsFailedToOpen", name)
        return self.spark.read.parquet(self.path(name) + self.XATTR).select(get_xattr(F.col("x"), attr)).first()[0]

    def unlink(self, name: str) -> None:
        """Deletes the attributes, if any, and the file; a file that is not there is an error."""
        for x in (name + self.XATTR, name):
            where, fs = self._at(self.path(x))
            if not fs.delete(where, True):
                check(x != name, "FsUnlinkFailed", name)


def map_regions(requests: DataFrame, allow_duplicates: bool = False) -> DataFrame:
    """requests (seq, region) with ``status``: the first request for a region is taken, later ones are duplicates unless those are allowed."""
    first = requests.groupBy("region").agg(F.min("seq").alias("_first"))
    taken = (F.col("seq") == F.col("_first")) | F.lit(allow_duplicates)
    return requests.join(first, "region").select("seq", "region", F.when(taken, "OK").otherwise("MemoryDuplicateMapping").alias("status"))


def unmap_regions(requests: DataFrame, mapped: DataFrame) -> DataFrame:
    """requests (seq, region) with ``status``: unknown regions are refused."""
    known = mapped.where("status = 'OK'").select("region", F.lit(True).alias("_known")).distinct()
    return requests.join(known, "region", "left").select("seq", "region", F.when(F.col("_known"), "OK").otherwise("MemoryUnknownMapping").alias("status"))


def parse_maps(lines: DataFrame, name: str, text: str = "text") -> DataFrame:
    """lines of ``lo-hi perms offset dev inode name`` with that name, with lo and hi as numbers."""
    parts = F.split(text, r"\s+", 6)
    ends = F.split(parts[0], "-")
    number = lambda c: F.conv(c, 16, 10).cast("long")
    return lines.where(F.trim(F.get(parts, 5)) == name).withColumns({"lo": number(ends[0]), "hi": number(ends[1])})


def matched_blocks(files: DataFrame, pattern: str, block: int, key: str) -> DataFrame:
    """key, matched, blocks: of files whose base name without extension matches the whole pattern."""
    base = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    hit = files.where(base.rlike(f"^(?:{pattern})$"))
    return hit.groupBy(key).agg(F.count("*").alias("matched"), F.sum(F.call_function("div", F.col("size"), F.lit(block).cast("long"))).alias("blocks"))


def at_least(df: DataFrame, severity: str, order: list[str], threshold: str) -> DataFrame:
    """Rows whose severity stands at or above the threshold in order."""
    return df.where(F.col(severity).isin(order[order.index(threshold) :]))


class HeapExtents(DataSource):
    """``heap_extents``: option heaps and extents; extent j of heap h starts at 32 j and is h mod 32 + 1 long."""

    @classmethod
    def name(cls) -> str:
        return "heap_extents"

    def schema(self) -> str:
        return "heap long, start long, len long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeapExtentsReader(int(self.options.get("heaps", "1")), int(self.options.get("extents", "1")))


class HeapExtentsReader(DataSourceReader):
    def __init__(self, heaps: int, extents: int, per_partition: int = 16):
        self.heaps, self.extents, self.step = heaps, extents, per_partition

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(a + self.step, self.heaps))) for a in range(0, self.heaps, self.step)]

    def read(self, partition: InputPartition):
        lo, hi = partition.value
        return ((h, 32 * j, h % 32 + 1) for h in range(lo, hi) for j in range(self.extents))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HeapExtents)

