"""Packing documents into training sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are spread over groups of about GROUP_DOCS by a hash; each group is packed on its own. A piece
goes to the first bin with room for it, found by descending a tournament tree whose nodes hold the largest
room below them. A document longer than the capacity is cut into full pieces and a rest; nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import run_starts, whole_groups

CAPACITY = 8192
GROUP_DOCS = 4096
SEED = 17


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; sizes must be descending and from 0 to capacity."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = []
    for s in sizes:
        i = 1
        while i < leaves:
            i *= 2
            if tree[i] < s:
                i += 1
        out.append((i - leaves, capacity - tree[i]))
        room = tree[i] - s
        tree[i] = room
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            m = a if a >= b else b
            if tree[i] == m:
                break
            tree[i] = m
    return out


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["group"], rows=GROUP_DOCS):
            starts = np.append(run_starts(t, ["group"]), t.num_rows)
            doc, size, groups = t.column("doc_id"), t.column("length").to_numpy(), t.column("group").to_numpy()
            for a, b in zip(starts[:-1], starts[1:]):
                n = size[a:b]
                pieces = np.maximum(1, -(-n // capacity))
                own = np.repeat(np.arange(a, b), pieces)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, size[own] - nth * capacity)
                order = np.argsort(-length, kind="stable")
                placed = np.array(first_fit_decreasing(length[order].tolist(), capacity), np.int64).reshape(-1, 2)
                own, nth, length = own[order], nth[order], length[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), groups[a], np.int64)),
                        pa.array(placed[:, 0].astype(np.int32)),
                        pa.array(placed[:, 1].astype(np.int32)),
                        doc.take(pa.array(own)).combine_chunks(),
                        pa.array(nth * capacity),
                        pa.array(length.astype(np.int32)),
                    ],
                    names=["group", "bin", "offset", "doc_id", "start", "length"],
                )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(group, bin, offset, doc_id, start, length): where each piece of each document goes.

    length: of a document, UTF-8 bytes unless given (a byte-level model's tokens); null or negative counts
    as 0, and a document of length 0 takes no room of the bin that it is put in. Pieces of equal length are
    placed in order of doc_id, null first, then of start; rows that repeat are each placed. A null doc_id is
    kept as null. An empty table gives no rows. capacity and group_docs must be 1 or more.
    """
    if capacity < 1 or group_docs < 1:
        raise ValueError("capacity and group_docs must be 1 or more")
    size = F.greatest(F.coalesce((F.octet_length(docs["text"]) if length is None else length).cast("long"), F.lit(0)), F.lit(0))
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // group_docs))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), size.cast("long").alias("length"))
    # null ids are spread by their length, so that they don't gather in one group
    own = own.withColumn("group", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), -F.col("length")), F.lit(SEED)), F.lit(groups)))
    n = max(1, min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return own.repartition(n, "group").sortWithinPartitions("group", "doc_id", "length").mapInArrow(_pack(capacity), "group long, bin int, offset int, doc_id long, start long, length int")
