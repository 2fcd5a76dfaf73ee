"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are hashed into blocks of about block_bytes. Block i (from 1) of a source of
weight w is released at floor((i-1)/w) and due at ceil(i/w) (slots from 0); each slot goes to the released
block of earliest deadline. At every slot the blocks of a source then differ from w times the slots so
far by less than one. Weights are fractions p/period, so the schedule repeats with the period: it is
simulated once for one period and every block's slot follows from its number alone, without a global order.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: Weights are shares of its sources' bytes to this power, scaled to sum to 1.
ALPHA = 0.7
PERIOD = 10_000
SEED = 11
#: The tables of sources and of a period's slots are broadcast up to so many rows (about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def integer_shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Shares of a period in proportion to the weights, at least 1 each, by largest remainder; ties go by name.

    What shares below 1 are raised by is taken from the others in proportion to what they have above 1. The
    time is that of sorting the sources.
    """
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError("more sources than slots in a period")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    above = sum(max(x - 1, 0.0) for x in exact.values())
    room = period - len(exact)  # what is left when each has 1
    exact = {s: 1 + (max(x - 1, 0.0) / above * room if above > 0 else room / len(exact)) for s, x in exact.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    short = period - sum(out.values())
    order = sorted(out, key=lambda s: (out[s] - exact[s], s))
    for s in order[: max(0, short)]:
        out[s] += 1
    for s in [s for s in reversed(order) if out[s] > 1][: max(0, -short)]:  # rounding of floats
        out[s] -= 1
    return out


def pfair_period(shares: dict[str, int]) -> list[tuple[str, int]]:
    """(source, number of the block within the period, from 0) of each slot of one period."""
    period = sum(shares.values())
    release: list[list] = [[] for _ in range(period)]
    for s, p in shares.items():
        for i in range(p):
            release[i * period // p].append((-(-(i + 1) * period // p), s, i))
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        for job in release[slot]:
            heapq.heappush(ready, job)
        due, s, i = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append((s, i))
    return out


def _source(docs: DataFrame):
    return F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source")


def _block_count(bytes_, block_bytes: int):
    return F.greatest(F.ceil(bytes_ / F.lit(block_bytes)), F.lit(1)).cast("long")


def plan(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, alpha: float = ALPHA, period: int = PERIOD):
    """(shares, blocks, slots): each source's share of the period, its number of blocks, and the length of the mix.

    The mix ends when the source that lasts longest has been used once; one row per source comes to the driver.
    """
    size = F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long")
    rows = docs.groupBy(_source(docs)).agg(F.sum(size).alias("bytes")).select("source", "bytes", _block_count(F.col("bytes"), block_bytes).alias("blocks")).collect()
    blocks = {r["source"]: r["blocks"] for r in rows if not weights or weights.get(r["source"], 0) > 0}
    wanted = {s: weights[s] for s in blocks} if weights else {r["source"]: max(r["bytes"], 1) ** alpha for r in rows}
    period = max(period, 8 * len(blocks))
    shares = integer_shares(wanted, period) if blocks else {}
    slots = 0
    for slot, (s, i) in enumerate(pfair_period(shares) if blocks else []):
        if (blocks[s] - 1) % shares[s] == i:  # the source's last block
            slots = max(slots, (blocks[s] - 1) // shares[s] * period + slot + 1)
    return shares, blocks, slots


def _scheduled(docs: DataFrame, row: list[Column], weights, block_bytes: int, alpha: float, period: int, max_epochs: int | None) -> DataFrame:
    """(slot, source, block, epoch, release, deadline, row): row is a struct, so its names can't meet those of the schedule."""
    spark: SparkSession = docs.sparkSession
    shares, blocks, slots = plan(docs, weights, block_bytes, alpha, period)
    period = sum(shares.values())
    sources = spark.createDataFrame([(s, blocks[s], shares[s]) for s in shares], "of string, blocks long, share long")
    table = [(s, i, slot) for slot, (s, i) in enumerate(pfair_period(shares))] if shares else []
    slot_of = spark.createDataFrame(table, "slot_of string, nth long, at long")
    if len(table) <= BROADCAST_ROWS:  # a period has at least 8 slots for each source, so this bounds both
        sources, slot_of = F.broadcast(sources), F.broadcast(slot_of)
    # null ids are spread over the blocks by their text
    key = F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["doc_id"].cast("long"), F.lit(SEED))).otherwise(F.xxhash64(docs["text"], F.lit(SEED)))
    d = docs.select(_source(docs), key.alias("key"), F.struct(*row).alias("row")).join(sources, F.col("source") == F.col("of"))
    # runs of a block: its numbers in the endless sequence of its source are block, block + blocks, ...
    last = F.ceil(F.lit(slots) / F.lit(max(period, 1)) * F.col("share") / F.col("blocks")).cast("long")
    last = last if max_epochs is None else F.least(last, F.lit(max_epochs - 1).cast("long"))
    d = d.withColumn("block", F.pmod("key", "blocks")).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    d = d.withColumn("n", F.col("block") + F.col("epoch") * F.col("blocks")).withColumn("mod", F.pmod("n", "share"))
    d = d.join(slot_of, (F.col("source") == F.col("slot_of")) & (F.col("mod") == F.col("nth")))
    whole = ((F.col("n") - F.col("mod")) / F.col("share")).cast("long") * F.lit(period)
    d = d.withColumn("slot", whole + F.col("at")).where(F.col("slot") < F.lit(slots))
    release = whole + F.floor(F.col("mod") * F.lit(period) / F.col("share"))
    due = whole + F.ceil((F.col("mod") + 1) * F.lit(period) / F.col("share"))
    return d.select("slot", "source", "block", F.col("epoch").cast("int").alias("epoch"), release.cast("long").alias("release"), due.cast("long").alias("deadline"), "row")


def pfair_mix(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, alpha: float = ALPHA, period: int = PERIOD, max_epochs: int | None = None) -> DataFrame:
    """(slot, source, block, epoch, release, deadline, doc_id): the slots of the mix, with the documents of each block.

    A source that runs out before the mix ends starts over (epoch 1, 2, ...), so every document of every
    source with a weight is used at least once. max_epochs: how often a document is used at most; a source
    that has been leaves its later slots empty, and only until then the weights hold. weights: by source;
    sources without one are left out. Without weights, shares of bytes to the power alpha. A null source
    counts as the source "", a null text as 0 bytes, and its document is scheduled like any other; rows that
    repeat are scheduled each. Null doc_ids are spread over their source's blocks by text. Ties of deadlines
    go by source name. An empty table gives no rows.
    """
    if max_epochs is not None and max_epochs < 1:
        raise ValueError("max_epochs must be 1 or more")
    out = _scheduled(docs, [docs["doc_id"].alias("doc_id")], weights, block_bytes, alpha, period, max_epochs)
    return out.select("slot", "source", "block", "epoch", "release", "deadline", "row.doc_id")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, alpha: float = ALPHA, period: int = PERIOD, max_epochs: int | None = None) -> DataFrame:
    """The documents of the mix, all columns whatever their names, in files that follow its order of slots."""
    out = _scheduled(docs, [docs[c] for c in docs.columns], weights, block_bytes, alpha, period, max_epochs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.select("slot", "row").repartitionByRange(n, "slot").sortWithinPartitions("slot").select("row.*")
