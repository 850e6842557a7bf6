"""The same replay as a stream: one state a heap, kept in the state store."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stream_replay(log: DataFrame, machine: Callable, schema: str, key: str = "heap", order: str = "seq", size: str = "n", event_time: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """A streaming log's rows with the answers of their heaps.

    A micro-batch's rows are answered in ``order``. Without ``event_time`` a row that comes in a later micro-batch than rows
    after it is answered with the state as it is. With it, a row waits in its heap's state until the watermark, ``lateness``
    behind the latest event time seen, has passed it, and rows are then answered in ``order``: those that come up to ``lateness`` late
    are answered in their place. Rows behind the watermark are answered with the state as it is, and those still waiting when a
    finite stream ends are in the state for its next run. A free of an unknown extent is a reported row, never a dropped one.
    """

    def answered(k: tuple, m, rows: pd.DataFrame) -> pd.DataFrame:
        out = [{key: k[0], order: o, "op": op, size: n, **m.step(op, n)} for o, op, n in zip(rows[order], rows["op"], rows[size].astype(int))]
        got = pd.DataFrame(out, columns=names)
        for f in ("start", "len", "cls", "slab", "block", "stored"):
            if f in got:
                got[f] = got[f].astype("Int64")
        return got

    names = [f.name for f in StructType.fromDDL(schema).fields]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, waiting = pickle.loads(state.get[0]) if state.exists else (machine(), [])
        new = [] if state.hasTimedOut else list(frames)
        rows = pd.concat([*waiting, *new]).sort_values(order, kind="stable")
        if event_time:
            ms = rows[event_time].astype("datetime64[ms]").astype("int64")
            due = ms <= state.getCurrentWatermarkMs()
            waiting = [rows[~due]] if (~due).any() else []
            if waiting:
                state.setTimeoutTimestamp(max(int(ms[~due].min()), state.getCurrentWatermarkMs() + 1))
            rows = rows[due]
        out = answered(k, m, rows)
        state.update((pickle.dumps((m, waiting)),))
        if len(out):
            yield out

    if event_time:
        log = log.withWatermark(event_time, lateness)
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return log.groupBy(key).applyInPandasWithState(step, schema, "state binary", "append", timeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is now, into Parquet, exactly once."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def event_log(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table, a file or a folder of part files, as a stream in the form of the allocation log; all its files in one micro-batch unless their number is given."""
    from pyspark.sql import functions as F

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream
    # a pattern, since a stream's plain path has to be a folder; what it matches may be either
    e = stream.parquet(f"{sf_dir}/events.parque[t]")
    op = F.when(F.col("event_type").isin("signup", "purchase"), "A").when(F.col("event_type") == "error", "F")
    return e.select(F.col("user_id").alias("heap"), F.col("event_id").alias("seq"), op.alias("op"), (1 + F.pmod(F.floor("value"), F.lit(16))).cast("long").alias("n"), "ts").where("op is not null")
