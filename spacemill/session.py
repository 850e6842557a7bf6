"""The session that queries run in, from layered options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spacemill.sources.config import Options

#: What the plans count on, unless options say otherwise.
DEFAULTS = Options({"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"})


def layered_options(*layers: Options) -> Options:
    """One flat set of options of which later layers win: system, environment, file."""
    out: dict = {}
    for layer in layers:
        out |= layer.flat()
    return Options(out)


def session(options: Options | None = None, name: str = "spacemill") -> SparkSession:
    """The active session as it is, else one with the options over the defaults; asking again gives the same."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(name)
    for k, v in layered_options(DEFAULTS, options or Options()).values.items():
        if k.startswith("spark."):
            builder = builder.config(k, str(v))
    return builder.getOrCreate()


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions. Given to ``repartition``, adaptive execution leaves them as they are; it joins partitions by
    their compressed bytes, which say little of the memory of what is made of the rows.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
