"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that separate words, `[\x20\x09-\x0D]`, are the ones bytes.split() splits at.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null read as the empty text."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def utf8_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string array without nulls."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches where their `column` (string or binary) passes max_bytes; a longer row stands alone. Nothing is dropped."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + (size or 0) > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def trim() -> None:
    """Give a Python worker's free memory back: workers stay, and their peaks would add up over the steps of a job."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
