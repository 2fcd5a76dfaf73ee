"""Shared pieces of the corpus operators: durable intermediate tables, batch slicing, group streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.durable import Temporary, materialize, scratch, written

__all__ = ["Temporary", "materialize", "scratch", "written"]

#: Bytes of text that the numpy kernels work on at once; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


def id_text(docs: DataFrame, lower: bool = True) -> DataFrame:
    """(doc_id, text) of the rows that have both; other columns never take part, so their names cannot clash."""
    text = docs["text"]
    return docs.where(docs["doc_id"].isNotNull() & text.isNotNull()).select(
        docs["doc_id"].cast("long").alias("doc_id"), (F.lower(text) if lower else text).alias("text")
    )


def free_name(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, for a column of our own beside theirs."""
    taken = {c.lower() for c in docs.columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about limit bytes of text, at least one row each."""
    n = batch.num_rows
    if not n:
        return
    import numpy as np

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
    ends, at = np.cumsum(sizes), 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(column: pa.Array):
    """(bytes, offsets) of a string column without nulls, as numpy arrays; offsets count from 0."""
    import numpy as np

    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def binary_column(flat, offsets) -> pa.Array:
    """Rows of bytes cut out of one flat numpy array; offsets count its items."""
    import numpy as np

    width = flat.dtype.itemsize
    off = np.asarray(offsets, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cuts = run_starts(table, keys)
        if len(cuts) > 1:
            yield table.slice(0, int(cuts[-1]))
            table = table.slice(int(cuts[-1]))
        held, count = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_starts(table: pa.Table, keys: list[str]):
    """Row numbers at which a run of equal keys begins."""
    import numpy as np

    change = np.zeros(table.num_rows, dtype=bool)
    if table.num_rows:
        change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)
