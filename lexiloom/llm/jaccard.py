"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

Documents are sets of word trigrams (64-bit hashes, sorted). Equal sets are joined by digest alone.
The rest meet in tiles: a tile holds the sets that agree on one of BANDS groups of ROWS min-hashes,
cut into size bands of ratio 1/threshold so that only neighbouring bands can hold a pair, and further
into blocks of BLOCK sets, so that a tile of any size is a grid of bounded tasks. Within a tile a pair
passes if its sizes allow the threshold and if the bit counts of the two signatures leave enough
overlap: |A & B| <= (|A| + |B| - popcount(sigA ^ sigB)) / 2. What is left is decided by intersecting
the sorted arrays. A pair is decided in the first tile its sets share, so no pair is decided twice.

Pairs don't leave the task that decides them: a tile returns how many documents each of its sets is similar
to, and a forest of the sets that it connects. Documents of equal sets are counted, not paired.

Most pairs share a tile, 1 - (1 - J**ROWS)**BANDS of them. Those that share none are found by prefixes: in the
order of how many sets hold a gram, the rarest first, two similar sets share one of the first
size - ceil(threshold * size) + 1 grams of each. So the join is exact. Grams go from task to task as flat
arrays; only those that another set has come back, and only sets with enough of them have a prefix that counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Temporary, binary_column, free_name, id_text, run_starts, slices, text_buffer, whole_groups
from ._words import mix, trigrams, words
from .components import components

THRESHOLD = 0.5
BANDS, ROWS = 64, 4
BLOCK = 2048
#: Bands that go with each gram of a prefix; pairs that agree on one need not be named again.
SEEN = 16
#: So many pairs are looked at in one go.
PAIRS = 1 << 18
_MULT = (np.random.default_rng(20240229).integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_LOW = np.uint64(0xFFFFFFFF)
_SALT = np.random.default_rng(7).integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def sorted_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigram hashes of each document, ascending, in one flat array with offsets."""
    _, _, h, docs = words(data, offsets)
    g, at = trigrams(h, docs)
    parts = []
    for a, b in zip(at[:-1], at[1:]):
        x = np.sort(g[a:b])
        parts.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if b > a + 1 else x)
    sizes = np.array([len(x) for x in parts], np.int64)
    return (np.concatenate(parts) if parts else g[:0]), np.concatenate([[0], np.cumsum(sizes)])


def _digests(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    import xxhash

    raw = flat.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(at[:-1], at[1:])], np.uint64).view(np.int64)


def width(size: int) -> int:
    """Bits of the signature of a set: twice the size or a little more, a power of two from 64 to 65536."""
    return 1 << min(16, max(6, int(2 * size - 1).bit_length()))


def _bitmap(x: np.ndarray) -> np.ndarray:
    w = width(len(x))
    bits = np.zeros(w, np.uint8)
    bits[(x >> np.uint64(40)).astype(np.int64) & (w - 1)] = 1
    return np.packbits(bits, bitorder="little")


def fold(bitmap: np.ndarray, to: int) -> np.ndarray:
    """A signature of fewer bits, the same as if made with them."""
    while len(bitmap) * 8 > to:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] | bitmap[half:]
    return bitmap


def _band_keys(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, BANDS) of 32-bit keys; sets must not be empty."""
    low = flat.astype(np.uint32)
    out = np.empty((len(at) - 1, BANDS), np.int32)
    for band in range(BANDS):
        key = np.full(len(at) - 1, band, np.uint64)
        for r in range(ROWS):
            key = mix(key ^ (np.minimum.reduceat(low * _MULT[band * ROWS + r], at[:-1]).astype(np.uint64) * _SALT[r]))
        out[:, band] = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _sets(batch: pa.RecordBatch):
    """ids, flat sets and offsets of the documents that have a word, and the ids of the others."""
    data, off = text_buffer(batch.column("text"))
    flat, at = sorted_sets(data, off)
    has, ids = np.diff(at) > 0, batch.column("doc_id").to_numpy()
    return ids[has], flat, np.concatenate([at[:-1][has], at[-1:]]), ids[~has]


_SKETCH = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("digest", pa.int64()), ("bands", pa.binary()), ("bitmap", pa.binary())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices(big):
            ids, flat, at, empty = _sets(batch)
            if len(empty):
                yield pa.RecordBatch.from_arrays([pa.array(empty), *(pa.array([x] * len(empty), k) for x, k in ((0, pa.int32()), (0, pa.int64()), (b"", pa.binary()), (b"", pa.binary())))], schema=_SKETCH)
            if not len(ids):
                continue
            maps = [_bitmap(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.diff(at).astype(np.int32)),
                    pa.array(_digests(flat, at)),
                    binary_column(_band_keys(flat, at).reshape(-1), np.arange(len(ids) + 1) * BANDS),
                    binary_column(np.concatenate(maps), np.concatenate([[0], np.cumsum([len(m) for m in maps])])),
                ],
                schema=_SKETCH,
            )


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each band of each set."""
    for b in batches:
        n = b.num_rows
        if n:
            keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.int32).astype(np.int64).reshape(n, BANDS)
            keys = (np.arange(BANDS, dtype=np.int64)[None, :] << 32) | (keys & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(b.column("digest").to_numpy(), BANDS))], names=["tile", "digest"])


def _needed(a: np.ndarray | int, b: np.ndarray | int, t: float):
    """Least overlap of two sets of these sizes whose Jaccard is t or more."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def _partners(t: float):
    """Pairs of a tile that pass first-tile, size and bit-count tests; a row for each set with any, holding its later partners."""

    def tile(size, chunk, bands, maps, band: int, cross: bool) -> dict[int, np.ndarray]:
        n, found = len(size), {}
        w = width(int(size[0]))
        m = np.stack([fold(x, w) for x in maps]) if n > 2 or len(maps[0]) != len(maps[1]) else np.stack(maps)
        m = m.view(np.uint64)
        last = np.searchsorted(size, size / t, side="right")
        for i in range(n - 1):
            j = np.arange(i + 1, last[i])
            if cross:
                j = j[chunk[j] != chunk[i]]
            if band and len(j):
                j = j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]
            if len(j):
                apart = np.bitwise_count(m[j] ^ m[i]).sum(axis=1, dtype=np.int64)
                j = j[(size[i] + size[j] - apart) // 2 >= _needed(size[i], size[j], t)]
            if len(j):
                found[i] = j
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, ["tile", "lo", "hi", "zone"]):
            starts = np.append(run_starts(g, ["tile", "lo", "hi", "zone"]), g.num_rows)
            tiles, lo, hi, zone = (g.column(k).to_numpy() for k in ("tile", "lo", "hi", "zone"))
            home, digest, size, chunk = (g.column(k).to_numpy() for k in ("home", "digest", "size", "chunk"))
            bands = np.frombuffer(b"".join(g.column("bands").to_pylist()), np.int32).reshape(-1, BANDS)
            maps = [np.frombuffer(x, np.uint8) for x in g.column("bitmap").to_pylist()]
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a < 2 or home[a:b].sum() == 0:
                    continue
                order = a + np.lexsort((digest[a:b], size[a:b]))
                found = tile(size[order].astype(np.int64), chunk[order], bands[order], [maps[x] for x in order], int(tiles[a] >> 32), lo[a] != hi[a])
                mine: dict[int, list[int]] = {}
                for i, j in found.items():
                    ok = j[home[order[j]] | home[order[i]]]
                    if len(ok):
                        mine.setdefault(i, []).extend(digest[order[ok]].tolist())
                        for x in ok.tolist():
                            mine.setdefault(x, [])
                out += [(int(tiles[a]), int(lo[a]), int(hi[a]), int(zone[a]), int(digest[order[i]]), js) for i, js in mine.items()]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:4]), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.list_(pa.int64()))], names=["tile", "lo", "hi", "zone", "digest", "partners"]
                )

    return run


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices(big):
            ids, flat, at, _ = _sets(batch)
            if len(ids):
                order = np.concatenate([flat[a:b] for a, b in zip(at[:-1], at[1:])])
                yield pa.RecordBatch.from_arrays([pa.array(_digests(flat, at)), binary_column(order, np.concatenate([[0], np.cumsum(np.diff(at))]))], names=["set", "grams"])


def _verify(t: float, count: bool):
    """For the pairs named in a tile, by exact overlap: a forest of them, and with count how many documents each set is similar to.

    Without count, pairs that the tile's verified pairs already connect are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, ["tile", "lo", "hi", "zone"], rows=2_000):
            starts = np.append(run_starts(g, ["tile", "lo", "hi", "zone"]), g.num_rows)
            digest, partners, raw, weight = (g.column(c).to_pylist() for c in ("digest", "partners", "grams", "weight"))
            links: dict[int, int] = {}
            forest: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1], starts[1:]):
                arrays = {digest[i]: (np.frombuffer(raw[i], np.uint64), weight[i]) for i in range(a, b)}
                parent = {d: d for d in arrays}

                def find(x: int) -> int:
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for i in range(a, b):
                    x, mine = arrays[digest[i]]
                    for d in partners[i]:
                        one, two = find(digest[i]), find(d)
                        if one == two and not count:
                            continue
                        y, theirs = arrays[d]
                        at = np.searchsorted(x, y)
                        both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                        if both / (len(x) + len(y) - both) < t - 1e-12:
                            continue
                        if count:
                            links[digest[i]] = links.get(digest[i], 0) + theirs
                            links[d] = links.get(d, 0) + mine
                        if one != two:
                            forest.append((digest[i], d))
                            parent[two] = one
            if links or forest:
                n = len(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*links, *(x for x, _ in forest)], pa.int64()), pa.array([*links.values(), *([0] * len(forest))], pa.int64()), pa.array([None] * n + [y for _, y in forest], pa.int64())], names=["set", "links", "other"]
                )

    return run


def _spread(n: int):
    """The grams of each set by n parts of the hashes: (high half of the hash) << 32 | low half of the set's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big):
                _, flat, at, _ = _sets(batch)
                if not len(flat):
                    continue
                part = (flat & _LOW).astype(np.int64) % n
                x = (flat & ~_LOW) | np.repeat(_digests(flat, at).view(np.uint64) & _LOW, np.diff(at))
                order = np.argsort(part, kind="stable")
                count = np.bincount(part, minlength=n)
                has = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), binary_column(x[order], np.concatenate([[0], np.cumsum(count[has])]))], names=["part", "grams"])

    return run


def _flat(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind)


_HELD = "part int, home int, grams binary, owners binary, held binary"


def _shared(n: int):
    """Of each part the grams that several sets have, by n homes of the sets: half hashes, half digests, in how many sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["part"], rows=1):
            starts = np.append(run_starts(t, ["part"]), t.num_rows)
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                x = np.unique(_flat(t.column("grams").slice(i, j - i), np.uint64))
                gram = (x >> np.uint64(32)).astype(np.uint32)
                new = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                held = np.repeat(np.diff(np.append(new, len(x))), np.diff(np.append(new, len(x))))
                several = held > 1
                gram, owner, held = gram[several], (x[several] & _LOW).astype(np.uint32), np.minimum(held[several], 0xFFFFFFFF).astype(np.uint32)
                home = owner.astype(np.int64) % n
                order = np.argsort(home, kind="stable")
                count = np.bincount(home, minlength=n)
                has = np.flatnonzero(count)
                if len(has):
                    off = np.concatenate([[0], np.cumsum(count[has])])
                    yield pa.RecordBatch.from_arrays([pa.array([t.column("part")[i].as_py()] * len(has), pa.int32()), pa.array(has.astype(np.int32)), *(binary_column(y[order], off) for y in (gram, owner, held))], names=["part", "home", "grams", "owners", "held"])

    return run


def _prefixes(t: float):
    """The prefix grams of the sets of each home that other sets have, by part: half hash, and the set's digest, size and first bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, ["home"], rows=1):
            starts = np.append(run_starts(g, ["home"]), g.num_rows)
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                rows = g.slice(i, j - i)
                own = rows.filter(rows.column("digest").is_valid())
                rest = rows.filter(rows.column("digest").is_null())
                if not own.num_rows or not rest.num_rows:
                    continue
                digest, size = own.column("digest").to_numpy(), own.column("size").to_numpy().astype(np.int64)
                bands = _flat(own.column("bands"), np.int32).reshape(-1, BANDS)[:, :SEEN]
                gram, owner, held = (_flat(rest.column(c), np.uint32) for c in ("grams", "owners", "held"))
                part = np.repeat(rest.column("part").to_numpy(), [len(x) // 4 for x in rest.column("grams").to_pylist()])
                order = np.lexsort((gram, part, held, owner))
                gram, owner, part = gram[order], owner[order], part[order]
                half = (digest.view(np.uint64) & _LOW).astype(np.uint32)
                a, b = np.searchsorted(owner, half), np.searchsorted(owner, half, side="right")
                # grams that no other set has come first in the order
                take = np.maximum(b - a - np.ceil(t * size - 1e-9).astype(np.int64) + 1, 0)
                k = np.repeat(np.arange(len(take)), take)
                at = np.arange(len(k)) - np.repeat(np.cumsum(take) - take, take) + np.repeat(a, take)
                if not len(k):
                    continue
                by = np.argsort(part[at], kind="stable")
                at, k = at[by], k[by]
                to, first = np.unique(part[at], return_index=True)
                off = np.append(first, len(at))
                out = (gram[at], digest[k], size[k].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(binary_column(x, off) for x in out), binary_column(bands[k].reshape(-1), off * SEEN)], names=["part", "grams", "digests", "sizes", "bands"])

    return run


def _pairs_of(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of rows, PAIRS or so at a time."""
    for c in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == c]
        for d in range(1, c):  # the pairs that are d apart
            here = np.arange(c - d)
            step = max(1, PAIRS // len(here))
            for x in range(0, len(at), step):
                i = (at[x : x + step, None] + here).ravel()
                for y in range(0, len(i), PAIRS):
                    yield i[y : y + PAIRS], i[y : y + PAIRS] + d


def _unmet(t: float):
    """Pairs of sets that share a prefix gram, whose sizes allow the threshold and whose first bands all differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, ["part"], rows=1):
            cuts = np.append(run_starts(g, ["part"]), g.num_rows)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows = g.slice(i, j - i)
                gram, digest, size, bands = (_flat(rows.column(c), k) for c, k in (("grams", np.uint32), ("digests", np.int64), ("sizes", np.int32), ("bands", np.int32)))
                order = np.argsort(gram, kind="stable")
                gram, digest, size, bands = gram[order], digest[order], size[order], bands.reshape(-1, SEEN)[order]
                starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                found = np.zeros((0, 2), np.int64)
                some: list[np.ndarray] = []
                for a, b in _pairs_of(starts, np.diff(np.append(starts, len(gram)))):
                    x, y = size[a], size[b]
                    ok = (np.minimum(x, y) >= t * np.maximum(x, y) - 1e-9) & (digest[a] != digest[b])
                    for k in range(SEEN):
                        ok[ok] = bands[a[ok], k] != bands[b[ok], k]
                    if ok.any():
                        some.append(np.sort(np.stack([digest[a[ok]], digest[b[ok]]], axis=1), axis=1))
                        if sum(map(len, some)) > max(PAIRS, len(found)):
                            found, some = np.unique(np.concatenate([found, *some]), axis=0), []
                found = np.unique(np.concatenate([found, *some]), axis=0)
                for x in range(0, len(found), PAIRS):
                    yield pa.RecordBatch.from_arrays([pa.array(found[x : x + PAIRS, 0]), pa.array(found[x : x + PAIRS, 1])], names=["a", "b"])

    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that agree on no band, so that no tile decides them."""
    for batch in batches:
        if batch.num_rows:
            one, two = (_flat(batch.column(c), np.int32).reshape(-1, BANDS) for c in ("bands_a", "bands_b"))
            yield batch.select(["a", "b"]).filter(pa.array(~(one == two).any(axis=1)))


def _missed(text: DataFrame, sets: DataFrame, kept: Temporary, threshold: float) -> DataFrame:
    """(tile, lo, hi, zone, digest, partners) as of _partners: all pairs that may reach the threshold and share no tile, under the first set of each."""
    n = int(text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = text.mapInArrow(_spread(n), "part int, grams binary").repartition(n, "part").sortWithinPartitions("part")
    held = kept.keep(spread.mapInArrow(_shared(n), _HELD), "held")
    none = F.lit(None)
    own = sets.select(none.cast("int").alias("part"), F.pmod(F.col("digest").bitwiseAND(0xFFFFFFFF), F.lit(n)).cast("int").alias("home"), *(none.cast("binary").alias(c) for c in ("grams", "owners", "held")), "digest", "size", "bands")
    all_ = held.select("*", none.cast("long").alias("digest"), none.cast("int").alias("size"), none.cast("binary").alias("bands")).union(own)
    prefix = all_.repartition(n, "home").sortWithinPartitions("home").mapInArrow(_prefixes(threshold), "part int, grams binary, digests binary, sizes binary, bands binary")
    pairs = prefix.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_unmet(threshold), "a long, b long")
    pairs = kept.keep(pairs.distinct(), "unmet")
    kept.drop("held")
    one, two = (sets.select(F.col("digest").alias(x), F.col("bands").alias(f"bands_{x}")) for x in "ab")
    pairs = kept.keep(pairs.join(one, "a").join(two, "b").select("a", "b", "bands_a", "bands_b").mapInArrow(_apart, "a long, b long"), "apart")
    first = pairs.groupBy("a").agg(F.collect_list("b").alias("partners")).select(F.col("a").alias("tile"), F.col("a").alias("digest"), "partners")
    rest = pairs.select(F.col("a").alias("tile"), F.col("b").alias("digest"), F.array().cast("array<long>").alias("partners"))
    away = [F.lit(-1).alias(c) for c in ("lo", "hi", "zone")]
    return first.union(rest).select("tile", *away, "digest", "partners")


def similar_sets(docs: DataFrame, threshold: float = THRESHOLD, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, decided): members is (doc_id, digest, size) with size 0 for texts without a word.

    decided is (set, links, other): where other is null, links is a number of documents of other sets that
    the documents of set are similar to, to be summed; else set and other are connected. Without count there
    are no links. The connections give the components, not all pairs.
    """
    text, kept = id_text(docs), Temporary(docs.sparkSession)
    sketch = kept.keep(text.mapInArrow(_sketch, "doc_id long, size int, digest long, bands binary, bitmap binary"), "sketch")
    members = kept.keep(sketch.select("doc_id", "digest", "size").distinct(), "members")
    first = members.where("size > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    full = sketch.where("size > 0")
    sets = full.groupBy("digest").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("bitmap").alias("bitmap"))
    keys = full.select("digest", "bands").dropDuplicates(["digest"]).mapInArrow(_keys_of, "tile long, digest long")
    shared = keys.groupBy(F.col("tile").alias("t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keys.join(shared, F.col("tile") == F.col("t")).select("tile", "digest", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = met.join(sets, "digest").withColumn("chunk", F.pmod(F.xxhash64("digest"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"lo": F.least("chunk", "other").cast("int"), "hi": F.greatest("chunk", "other").cast("int")})
    band = F.floor(F.log("size") / float(-np.log(threshold)) + 1e-9).cast("int") if threshold < 1 else F.col("size")
    rows = rows.withColumn("base", band).withColumn("zone", F.explode(F.array(F.col("base"), F.col("base") + 1))).withColumn("home", F.col("zone") == F.col("base"))
    rows = rows.select("tile", "lo", "hi", "zone", "home", "chunk", "digest", "size", "bands", "bitmap")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = ["tile", "lo", "hi", "zone"]
    named = kept.keep(rows.repartition(n, *grid).sortWithinPartitions(*grid).mapInArrow(_partners(threshold), "tile long, lo int, hi int, zone int, digest long, partners array<long>"), "tiles")
    named = named.union(_missed(text, sets, kept, threshold))
    wanted = named.select("digest").distinct().join(first, "digest").select(F.col("digest").alias("set"), "rep", "weight")
    arrays = text.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_arrays, "set long, grams binary").dropDuplicates(["set"])
    held = arrays.join(wanted.select("set", "weight"), "set")
    ready = named.join(held, named["digest"] == held["set"]).select(*grid, "digest", "partners", "grams", "weight")
    decided = kept.keep(ready.repartition(n, *grid).sortWithinPartitions(*grid).mapInArrow(_verify(threshold, count), "set long, links long, other long"), "decided")
    kept.drop("sketch", "tiles", "unmet", "apart")
    return members, decided


def _classes(members: DataFrame, decided: DataFrame) -> DataFrame:
    """(doc_id, digest, class_id, weight) of members that have a word: the smallest doc_id that similar sets and rows of one doc_id connect."""
    has = members.where("size > 0").select("doc_id", "digest")
    first = has.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    a, b = first.select(F.col("digest").alias("set"), F.col("rep").alias("src")), first.select(F.col("digest").alias("other"), F.col("rep").alias("dst"))
    edges = decided.where("other is not null").select("set", "other").join(a, "set").join(b, "other").select("src", "dst")
    several = has.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    own = has.join(several, "doc_id").join(first, "digest").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    group = components(edges.union(own))
    of = first.join(group, F.col("rep") == F.col("node"), "left").select("digest", "weight", F.coalesce("component", "rep").alias("class_id"))
    return has.join(of, "digest")


def ngram_jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every document: links is the number of documents whose sets of word trigrams are similar.

    class_id is the smallest doc_id that similar pairs connect with the document, over any number of them; its
    own if it has no link. Pairs at exactly the threshold count, as do copies. Rows with a null doc_id or text
    give nothing; texts without a word have no link. A text of one or two words has one gram, all of it. Rows
    that repeat a doc_id give one row; where their texts differ, the links of each different one are added up. An empty
    table gives no rows. Only doc_id and text are read.
    """
    members, decided = similar_sets(docs, threshold)
    links = decided.where("other is null").groupBy("set").agg(F.sum("links").alias("near"))
    each = _classes(members, decided)
    each = each.join(links, F.col("digest") == F.col("set"), "left").select("doc_id", "class_id", (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    alone = members.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return each.union(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the near-duplicates of a document with a smaller doc_id; all columns and their names stay.

    Rows with a null doc_id or text stay. Rows that repeat the doc_id of a kept document stay with it.
    """
    name = free_name(docs, "gone")
    gone = _classes(*similar_sets(docs, threshold, count=False)).where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') ws from documents where doc_id is not null and text is not null
), g as (
  select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) gram from w
), s as (select doc_id, count(*) n from g group by 1),
c as (select a.doc_id doc_a, b.doc_id doc_b, count(*) c from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
p as materialized (select doc_a, doc_b from c join s x on x.doc_id = doc_a join s y on y.doc_id = doc_b where c / (x.n + y.n - c)::double >= 0.5 - 1e-12),
e as materialized (select doc_a a, doc_b b from p union all select doc_b, doc_a from p),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
k as (select a, min(b) b from r group by 1),
n as (select a, count(*) links from e group by 1)
select distinct doc_id, least(doc_id, coalesce(k.b, doc_id)) class_id, coalesce(links, 0) links from w left join k on k.a = doc_id left join n on n.a = doc_id
"""
