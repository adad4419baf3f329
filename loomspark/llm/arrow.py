"""Adding columns batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS, BYTES = 512, 1_000_000  # texts can be long, so few are worked on at a time


def pieces(batch: pa.RecordBatch):
    """The batch in slices of at most ROWS rows and, beyond one row, about BYTES bytes of text."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += np.array(pc.fill_null(pc.binary_length(c), 0), np.int64)
    full = np.cumsum(size) // BYTES
    at = 0
    while at < batch.num_rows:
        end = min(at + ROWS, max(at + 1, int(np.searchsorted(full, full[at], side="right"))))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # workers live on, and would hold what their largest batch took


def with_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list], fields: list[T.StructField]) -> DataFrame:
    """``df`` with the columns that ``make`` returns for each batch, in the order of ``fields``.

    Input columns with the same names are replaced.
    """
    new = {f.name for f in fields}
    keep = [f.name for f in df.schema if f.name not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                made = make(b)
                columns = [b.column(c) for c in keep] + [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(f.name).type) for x, f in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(arrow, columns, strict=True)]))

    return df.mapInArrow(run, schema)
