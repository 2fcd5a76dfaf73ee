"""Token counts by separator scan over flat token files that have no index.

A token file is nothing but fixed-width little-endian ids, documents ended by a separator id. Files are cut
into blocks of BLOCK_TOKENS that are read and searched on their own, wherever documents begin. What a block
can't know, the number of documents that end before it and where the last of those ended, is a prefix scan
over the small rows that the blocks return; only then are boundaries stitched across blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import materialize, scratch, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The id that the vocabulary leaves free ends a document.
SEPARATOR = 50256
#: Ids in a block: 8 MB of 16-bit ids.
BLOCK_TOKENS = 4 << 20


def encoder(ranks: bytes | None = None, pattern: str = PATTERN):
    """The tokenizer of the lines of a file of ranks, that of VOCABULARY unless given, without special tokens."""
    import tiktoken

    ranks = ranks if ranks is not None else _read(VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _read(path: str) -> bytes:
    """A file on the driver's disk, or of any URI."""
    with open(path, "rb") if "://" not in path else _open(path, "r") as f:
        return f.read()


def _open(uri: str, mode: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return where.open_input_file(path)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path)


def _write(folder: str, ranks, pattern: str, separator: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path, out, docs, coder = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}.bin", None, 0, None
        for big in batches:
            for batch in slices(big):
                if out is None:
                    out, coder = _open(path, "w"), encoder(ranks.value, pattern)
                parts, tokens = [], 0
                for text in batch.column("text").to_pylist():
                    ids = coder.encode_ordinary(text) if text else []
                    ids.append(separator)
                    parts.append(np.array(ids, width))
                    tokens += len(ids)
                out.write(np.concatenate(parts).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([tokens], pa.int64()), pa.array([docs], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))], names=["file", "path", "tokens", "first", "doc_ids"])
                docs += batch.num_rows
        if out is not None:
            out.close()

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, separator: int = SEPARATOR, width: str = "<u2") -> tuple[DataFrame, DataFrame]:
    """Write docs as flat token files. Returns (file, path, tokens, documents) of each, tokens counting separators, and the order of writing: (file, doc, doc_id).

    The rows of a task make one file, in their order. A null or empty text is a separator alone. A task that
    is repeated writes a file of another name, and only the files that are returned count. The vocabulary is
    read by the driver and sent to the executors; its file has a fixed size.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(_read(vocabulary))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    pieces = materialize(own.mapInArrow(_write(folder, ranks, pattern, separator, width), "file int, path string, tokens long, first long, doc_ids array<long>"), "tokens")
    files = pieces.groupBy("file", "path").agg(F.sum("tokens").alias("tokens"), F.sum(F.size("doc_ids")).alias("documents"))
    order = pieces.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("doc"), "doc_id")
    return files, order


def _search(separator: int, width: str, block: int):
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path, at, n in zip(*(batch.column(k).to_pylist() for k in ("file", "path", "block", "n"))):
                with _open(path, "r") as f:
                    ids = np.frombuffer(f.read_at(n * size, at * block * size), width)
                ends = np.flatnonzero(ids == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([at], pa.int64()), pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends))], names=["file", "block", "n", "ends"])

    return run


def separator_scan(files: DataFrame, separator: int = SEPARATOR, width: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, doc, start, tokens, closed): the documents of flat token files, each file's counted from 0.

    files: (file, path, tokens). start is a token offset into the file; tokens excludes the separator. Ids
    after a file's last separator are one more document, not closed; an empty document has 0 tokens; two
    separators in a row have one between them. Files without ids give no rows. Null paths are skipped.
    """
    if block_tokens < 1:
        raise ValueError("block_tokens must be 1 or more")
    spark = files.sparkSession
    step = F.lit(block_tokens)
    blocks = files.where(files["path"].isNotNull() & (files["tokens"] > 0)).select("file", "path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / step))).alias("block"))
    blocks = blocks.select("file", "path", "block", F.least(step.cast("long"), F.col("tokens") - F.col("block") * step).alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(n, "file", "block").mapInArrow(_search(separator, width, block_tokens), "file int, block long, n int, ends array<int>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("file").orderBy("block")
    base = F.col("block") * step
    last = F.when(F.size("ends") > 0, base + F.element_at("ends", -1) + 1)
    seen = found.select(
        "file", "n", "ends", base.alias("base"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs"),
        F.coalesce(F.max(last).over(before), F.lit(0)).alias("carried"),
        F.coalesce(last, F.max(last).over(before), F.lit(0)).alias("after"),
        F.lead("block").over(order).isNull().alias("is_last"),
    )
    rest = F.col("is_last") & (F.col("after") < F.col("base") + F.col("n"))
    cuts = F.when(rest, F.concat("ends", F.array("n"))).otherwise(F.col("ends"))
    each = seen.select("file", "base", "docs", "carried", F.size("ends").alias("closed_ones"), F.arrays_zip(cuts.alias("end"), F.slice(F.concat(F.array(F.lit(-1)), cuts), 1, F.greatest(F.size(cuts), F.lit(0))).alias("before")).alias("cuts")).select("*", F.posexplode("cuts").alias("i", "cut"))
    start = F.when(F.col("i") == 0, F.col("carried")).otherwise(F.col("base") + F.col("cut.before") + 1)
    return each.select("file", (F.col("docs") + F.col("i")).cast("long").alias("doc"), start.cast("long").alias("start"), (F.col("base") + F.col("cut.end") - start).cast("long").alias("tokens"), (F.col("i") < F.col("closed_ones")).alias("closed"))


def document_token_counts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, tokens, file, start) of every row: docs written as token files in the shared folder and scanned.

    tokens counts no separator; a null or empty text has 0; rows that repeat and null doc_ids give a row each;
    an empty table gives none. See separator_scan; the files hold no ids of documents, so these are joined by
    their number in the file.
    """
    spark: SparkSession = docs.sparkSession
    files, order = write_token_files(docs, scratch(spark, "ids"), **options)
    found = separator_scan(files)
    of = order.select(F.col("file").alias("of_file"), F.col("doc").alias("nth"), "doc_id")
    # lists of ids are small on disk, so that their size there would let them be broadcast at any number of documents
    return found.join(of.hint("merge"), (F.col("file") == F.col("of_file")) & (F.col("doc") == F.col("nth"))).select("doc_id", "tokens", "file", "start")
