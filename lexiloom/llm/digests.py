"""Document fingerprints: a canonical exact digest, with comparison of bytes inside equal buckets.

Texts are brought to a canonical form (NFKC, case folded, white space runs to one space, ends trimmed) and
hashed to 128 bits by xxh3. Only the texts of buckets with more than one row are read again; they are
sorted by bucket and compared with the bucket's different texts so far, so even equal digests of different
texts would be told apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import binary_column, id_text, materialize, slices

#: Up to so many ids of copies are broadcast to pick their texts (16 bytes each on the wire); beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def canonical(text: str) -> str:
    """NFKC, case folded, normalised again, with runs of white space as one space and none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def _digest(keep_bytes: bool, hasher=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = hasher or xxhash.xxh3_128_digest
        for big in batches:
            for batch in slices(big):
                raw = [canonical(t).encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                halves = np.frombuffer(b"".join(map(digest, raw)), ">i8").astype(np.int64).reshape(-1, 2)
                columns = [batch.column("doc_id"), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))]
                if keep_bytes:
                    flat = np.frombuffer(b"".join(raw), np.uint8)
                    columns.append(binary_column(flat, np.concatenate([[0], np.cumsum([len(x) for x in raw])])))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hi", "lo", "raw"][: len(columns)])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each row's text among the different ones of its bucket; rows come sorted by bucket, only different texts are held."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, out = batch.column("raw"), []
        for i, key in enumerate(zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist())):
            if key != now:
                now, held = key, []
            b = raw[i].as_py()
            k = next((k for k, x in enumerate(held) if x == b), len(held))
            if k == len(held):
                held.append(b)
            out.append(k)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hi"), batch.column("lo"), pa.array(out, pa.int32())], names=["doc_id", "hi", "lo", "variant"])


def canonical_copies(docs: DataFrame, hasher=None, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, keeper, copies): for each row with a doc_id and a text, the smallest doc_id of its canonical text and how many rows have it.

    Rows with a null doc_id or text take no part. Empty and blank texts are copies of each other. Rows that
    repeat are counted and returned each. An empty table gives no rows. Only doc_id and text are read.
    hasher: text bytes to 16 bytes, xxh3_128 unless given (tests give one that collides).
    """
    text = id_text(docs, lower=False)
    rows = materialize(text.mapInArrow(_digest(False, hasher), "doc_id long, hi long, lo long"), "digests")
    sized = rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))
    single = sized.where("copies = 1").select("doc_id", F.col("doc_id").alias("keeper"), "copies")
    shared = materialize(rows.join(sized.where("copies > 1").select("hi", "lo"), ["hi", "lo"]).select(F.col("doc_id").alias("copy_id")).distinct(), "copies")
    wanted = F.broadcast(shared) if shared.count() <= broadcast_ids else shared
    again = text.join(wanted, text["doc_id"] == F.col("copy_id"), "left_semi").mapInArrow(_digest(True, hasher), "doc_id long, hi long, lo long, raw binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a doc_id that has a copy may have other rows, with texts of their own: those are single buckets here
    variants = again.repartition(n, "hi", "lo").sortWithinPartitions("hi", "lo").mapInArrow(_compare, "doc_id long, hi long, lo long, variant int")
    same = Window.partitionBy("hi", "lo", "variant")
    copied = variants.select("doc_id", F.min("doc_id").over(same).alias("keeper"), F.count(F.lit(1)).over(same).alias("copies"), F.count(F.lit(1)).over(Window.partitionBy("hi", "lo")).alias("bucket")).where("bucket > 1").drop("bucket")
    return copied.union(single)


SQL = r"""
with c as (select doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')) t from documents where doc_id is not null and text is not null)
select doc_id, min(doc_id) over (partition by t) as keeper, count(*) over (partition by t) as copies from c
"""
