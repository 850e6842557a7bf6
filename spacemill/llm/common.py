"""Shared pieces: the cluster's shared folder, staged tables, skew-safe lookups, gapless numbering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from spacemill.scratch import scratch_path, shared_dir  # noqa: F401

#: Salts that a hot key is split into before shuffles.
SALTS = 16

_made: dict[str, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    path = scratch_path(spark, label)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The tables that this application has staged and not deleted."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables, once their readers are done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(conf).delete(where, True)
    own = _made.get(spark.sparkContext.applicationId, [])
    own[:] = [p for p in own if p not in set(paths)]


def clean(spark: SparkSession) -> int:
    """Deletes all tables staged so far by this application, once their readers are done; gives their number."""
    paths = made(spark)
    delete(spark, paths)
    return len(paths)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut and a lost executor costs only a reread."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextmanager
def dropping(spark: SparkSession, kept: list[DataFrame]) -> Iterator[None]:
    """Deletes, at the end, what was staged inside but for the staged tables in ``kept``: those that a result yet to be computed reads."""
    before = set(made(spark))
    yield
    needed = {k.staged_at for k in kept}
    delete(spark, [p for p in made(spark) if p not in before and p not in needed])


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, lengthened where a column has them already, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def others(df: DataFrame, replaced: Iterable[str], *spare: str) -> list[str]:
    """The columns of df but for spare ones and those that a result's names replace, whatever their case."""
    gone = {n.lower() for n in replaced}
    return [c for c in df.columns if c in spare or c.lower() not in gone]


def salt_of(*cols: str | Column) -> Column:
    """A salt in [0, SALTS) that depends on the row only, so recomputed tasks repeat it."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def lookup(left: DataFrame, right: DataFrame, key: str, salt: str, how: str = "left") -> DataFrame:
    """left joined to the unique-keyed right on ``key``; ``salt`` is a column of left.

    A key with a third of all rows is met by SALTS tasks rather than one: the (key, salt) pairs that
    exist are found with map-side combining, take their row of right, and left joins on both columns.
    """
    pairs = left.select(key, salt).distinct()
    return left.join(pairs.join(right, key), [key, salt], how)


def numbered(df: DataFrame, group: str, order: list[Column], sums: dict[str, Column], blocks: int, block_by: list[Column], block: Column | None = None) -> DataFrame:
    """Adds, for each name in sums, the sum of its column over the rows before, within each group; a sum of ones numbers the rows from 0 without gaps.

    No task holds a whole group: rows go to ``blocks`` blocks by a hash of block_by, and a block begins with the sums over
    the blocks before it, from a table of at most groups x blocks rows. A given ``block`` column deals the rows instead, and its
    order is that of the rows. Columns of df may have any names but those in sums.
    """
    no, above, g, b = unused([*df.columns, *sums], "block", "above", "group", "block_of")
    names = unused([*df.columns, *sums, no, above, g, b], *[f"add_{n}" for n in sums])
    dealt = F.pmod(F.xxhash64(*block_by), F.lit(blocks)).cast("int") if block is None else block
    df = df.withColumns({no: dealt} | {a: c.cast("long") for a, c in zip(names, sums.values())})
    upto = W.partitionBy(g).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    per = df.groupBy(F.col(group).alias(g), F.col(no).alias(b)).agg(*[F.sum(a).alias(a) for a in names])
    first = per.select(g, b, F.struct(*[F.coalesce(F.sum(a).over(upto), F.lit(0)).alias(a) for a in names]).alias(above))
    inside = W.partitionBy(group, no).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumns({n: F.coalesce(F.sum(a).over(inside), F.lit(0)) for n, a in zip(sums, names)})
    joined = rows.join(first, F.col(group).eqNullSafe(F.col(g)) & F.col(no).eqNullSafe(F.col(b)))
    return joined.withColumns({n: (F.col(n) + F.col(above)[a]).cast("long") for n, a in zip(sums, names)}).drop(no, above, g, b, *names)
