"""Sharding indivisible groups of documents by Karmarkar-Karp differencing, in two levels.

A partial partition is a tuple of k subset sums. Differencing takes the two partial partitions of largest
spread and adds them in opposite orders, until one is left. Groups are hashed into buckets of about
BUCKET_GROUPS; each bucket is differenced on its own, on the executors. The buckets' results are partial
partitions again and are differenced the same way, so the second level sees k sums for each bucket.
A level of more than FAN_IN buckets is reduced in rounds, each on the executors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import materialize, run_starts, whole_groups

SHARDS = 16
BUCKET_GROUPS = 4096
FAN_IN = 512


def differencing(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions: (sums of the k subsets, descending; for each input row, the subset each of its columns ends in).

    parts: (n, k) sums, each row descending. Ties of spread go to the earlier row.
    """
    n, k = parts.shape
    if not n:
        return np.zeros(k, parts.dtype), np.zeros((0, k), np.int32)
    heap = [(-(int(r[0]) - int(r[-1])), i) for i, r in enumerate(parts)]
    heapq.heapify(heap)
    sums = [r for r in parts]
    children: list[tuple] = [()] * n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        s = sums[a] + sums[b][::-1]
        order = np.argsort(-s, kind="stable")
        sums[a] = sums[b] = None
        s = s[order]
        heapq.heappush(heap, (-(int(s[0]) - int(s[-1])), len(sums)))
        sums.append(s)
        children.append((a, b, order))
    where: list = [None] * len(sums)
    where[-1] = np.arange(k, dtype=np.int32)
    for i in range(len(sums) - 1, n - 1, -1):
        a, b, order = children[i]
        inner = np.empty(k, np.int32)
        inner[order] = where[i]
        where[a], where[b] = inner, inner[::-1]
        where[i] = None
    return sums[-1], np.stack(where[:n])


def _local(k: int):
    """Groups of a bucket -> (bucket, group, slot) and the bucket's sums, in one table: rows of kind 1 are sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket"], rows=BUCKET_GROUPS):
            starts = np.append(run_starts(t, ["bucket"]), t.num_rows)
            bucket, group, size = t.column("bucket").to_numpy(), t.column("group").to_numpy(), t.column("bytes").to_numpy()
            for a, b in zip(starts[:-1], starts[1:]):
                parts = np.zeros((b - a, k), np.int64)
                parts[:, 0] = size[a:b]
                sums, where = differencing(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a + 1, bucket[a])), pa.array([*group[a:b].tolist(), None], pa.int64()), pa.array([*where[:, 0].tolist(), None], pa.int32()), pa.array([*([None] * (b - a)), sums.tolist()], pa.list_(pa.int64()))],
                    names=["bucket", "group", "slot", "sums"],
                )

    return run


def _merge(k: int):
    """Buckets of one parent -> their map of slots, and the parent's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["parent"], rows=FAN_IN):
            starts = np.append(run_starts(t, ["parent"]), t.num_rows)
            parent, bucket, sums = t.column("parent").to_numpy(), t.column("bucket").to_pylist(), t.column("sums").to_pylist()
            for a, b in zip(starts[:-1], starts[1:]):
                total, where = differencing(np.array(sums[a:b], np.int64).reshape(-1, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a + 1, parent[a])), pa.array([*bucket[a:b], None], pa.int64()), pa.array([*where.tolist(), None], pa.list_(pa.int32())), pa.array([*([None] * (b - a)), total.tolist()], pa.list_(pa.int64()))],
                    names=["parent", "bucket", "place", "sums"],
                )

    return run


def karmarkar_karp_shards(docs: DataFrame, shards: int = SHARDS, group: Column | None = None, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(doc_id, shard, group): the shard of each document; documents of one group share one.

    group: what must stay together, unless given the copies of a text (by its 64-bit digest). Bytes are UTF-8
    bytes of text; a null text counts 0 and null groups are one group. Rows that repeat are each placed, with
    their group. A null doc_id is kept as null. An empty table gives no rows. With one bucket this is plain
    Karmarkar-Karp; equal spreads go to the smaller group digest.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64(docs["text"] if group is None else group)
    own = materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), key.alias("group"), F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("bytes")), "shard")
    groups = own.groupBy("group").agg(F.sum("bytes").alias("bytes"))
    count = groups.count()
    buckets = max(1, -(-count // bucket_groups))
    spread = groups.withColumn("bucket", F.pmod(F.xxhash64("group", F.lit(5)), F.lit(buckets)))
    placed = materialize(spread.repartition(min(n, buckets), "bucket").sortWithinPartitions("bucket", F.desc("bytes"), "group").mapInArrow(_local(shards), "bucket long, group long, slot int, sums array<long>"), "shard")
    level = placed.where("sums is not null").select("bucket", "sums")
    at = placed.where("group is not null").select("bucket", "group", "slot")
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        up = level.withColumn("parent", F.pmod(F.col("bucket"), F.lit(buckets)))
        up = materialize(up.repartition(min(n, buckets), "parent").sortWithinPartitions("parent", "bucket").mapInArrow(_merge(shards), "parent long, bucket long, place array<int>, sums array<long>"), "shard")
        at = at.join(up.where("place is not null").select("bucket", "parent", "place"), "bucket").select(F.col("parent").alias("bucket"), "group", F.get("place", F.col("slot")).alias("slot"))
        level = up.where("place is null").select(F.col("parent").alias("bucket"), "sums")
    return own.join(at.select("group", "slot"), "group").select("doc_id", F.col("slot").alias("shard"), "group")
