"""Helpers shared by the operators: bounded Arrow slices, tables, seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 21


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes together.

    A longer text is a run of its own, so memory follows the longest text, not the batch.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    column: str = "text",
    last: bool = False,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply a function to bounded Arrow slices.

    ``make`` runs once per task and returns the function; that one gets a slice and returns a
    dict of columns. ``schema`` is the DDL of the result. With ``last`` the function is called once
    more at the end of the task, with None. A slice has about ``limit`` bytes of ``column``.
    """
    target = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
        for batch in batches:
            yield from slices(batch, column, limit)
        if last:
            yield None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in parts(batches):
            found = work(part)
            yield pa.RecordBatch.from_arrays(
                [_array(found[f.name], f.type) for f in arrow], names=[f.name for f in arrow]
            )

    return df.mapInArrow(run, target)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        found = values.cast(kind)
        return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return pa.array(values, type=kind)


ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def arrow_table(columns: list, ddl: str) -> pa.Table:
    """Columns under plain DDL, which tasks cannot have parsed by Spark."""
    fields = [part.rsplit(" ", 1) for part in ddl.split(", ")]
    return pa.table({name: pa.array(c, type=ARROW[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def ragged(flat: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat, type=kind))


def squeezed(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed bytes, all first bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(found: bytes, kind: type = np.int64) -> np.ndarray:
    size = int.from_bytes(found[:8], "little")
    planes = pa.decompress(found[8:], size * 8, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, size).T).view(kind).reshape(size)


def steps(values: np.ndarray) -> np.ndarray:
    """Sorted numbers as their first and their differences; ``np.cumsum`` gives them back."""
    found = values.copy()
    found[1:] -= values[:-1]
    return found


def unsigned(values: np.ndarray) -> np.ndarray:
    """Small numbers of either sign as small ones from 0 on."""
    return (values << 1) ^ (values >> 63)


def signed(values: np.ndarray) -> np.ndarray:
    return (values >> 1) ^ -(values & 1)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the result."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))
