"""Spans in texts: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def map_rows(df: DataFrame, row: Callable[..., dict], schema: StructType, rows_per_batch: int = 500) -> DataFrame:
    """A row out for each row in: row(*values) gives its columns. Rows are taken one by one, so memory follows the longest text."""
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in zip(*batch.columns):
                out.append(row(*(v.as_py() for v in values)))
                if len(out) == rows_per_batch:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    return df.mapInArrow(run, schema)
