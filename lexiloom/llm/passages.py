"""Substring deduplication by compact windows.

Every run of at least MIN_WORDS words has, under a hash function, a trigram of least hash. The runs of a
document that share it are one compact window (first, anchor, last): the subtree of the anchor in the
Cartesian tree over the hashes, found as the nearest smaller values on both sides. Only anchors whose
subtree is long enough are kept, about 2 / MIN_WORDS of all positions. The windows of two hash functions
are intersected as intervals, so that a candidate must share both anchors; PAIRS such pairs of functions
are used. Windows of one document that have the same anchors and overlap (repetitions) are one. An exactly
repeated run shares every anchor and is always found; a run with similarity J in trigrams meets with
probability 1 - (1 - J**2)**PAIRS for each of the windows that it spans.

Candidates with the same anchors are first compared with the one of the smallest doc_id, those of one pair
of documents and one offset together. Those that it doesn't confirm are then brought together by their
anchors, and each is compared with the earlier ones that nothing has confirmed either, until one does.
Verification takes the words themselves: a span is a duplicate where at least SIMILARITY of its trigrams
occur in the partner's segment.

Windows stream by key, in order, past the first of their key, so that a hot key needs no memory; what is asked
of a document is distinct ranges of it, and a segment that many ask for is sent to one task for every ASKERS of
them. The unconfirmed candidates of one key meet in one task, by lists of the trigrams that can lead from one to
another: not those that many hold and that make up no span by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Temporary, binary_column, free_name, id_text, run_starts, slices, text_buffer, whole_groups
from ._words import mix, trigrams, words

MIN_WORDS = 50
SIMILARITY = 0.7
#: Pairs of hash functions.
PAIRS = 3
#: So many trigrams in a row may be missing between two parts that qualify on their own.
GAP = 12
#: Segments of the partner are cut at multiples of this many words.
ROUND = 64
#: So many askers of one segment at most meet it in one task.
ASKERS = 4096
#: Words of segments in one batch; bounds the memory of a Python worker.
SEGMENT_WORDS = 1 << 18
#: Words that are compared in one go; their trigrams stay in the processor's cache.
CHUNK_WORDS = 1 << 16
#: So many documents at most are picked by a broadcast of their ids.
BROADCAST_IDS = 1_000_000
_FUNCTIONS = np.random.default_rng(41).integers(1, 1 << 63, 2 * PAIRS, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


def _levels(v: np.ndarray, longest: int) -> list[np.ndarray]:
    """Minima of all blocks of 1, 2, 4, ... items, up to the longest document."""
    out, step = [v], 1
    while step * 2 <= longest:
        m = out[-1]
        out.append(np.minimum(m[:-step], m[step:]))
        step *= 2
    return out


def compact_windows(g: np.ndarray, at: np.ndarray, least: int, factor: np.uint64):
    """(anchor under each start, anchors, firsts, lasts) for the runs of at least so many grams; at: first gram of each document."""
    n = len(g)
    v = ((g * factor) & ~_LOW) | np.arange(n, dtype=np.uint64)
    levels = _levels(v, max(least, int(np.diff(at).max())))
    k = least.bit_length() - 1
    w = np.minimum(levels[k][: n - least + 1], levels[k][least - (1 << k) :][: n - least + 1])
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(owner[: n - least + 1] == owner[least - 1 :])
    under = (w[starts] & _LOW).astype(np.int64)
    c = under[np.concatenate([[True], under[1:] != under[:-1]])] if len(under) else under
    lo, hi = at[owner[c]], at[owner[c] + 1] - 1
    first, last, mine = c.copy(), c.copy(), v[c]
    for k in range(len(levels) - 1, -1, -1):
        m, step = levels[k], 1 << k
        to = first - step
        go = (to >= lo) & (m[np.maximum(to, 0)] > mine)
        first[go] = to[go]
        go = (last + step <= hi) & (m[np.minimum(last + 1, len(m) - 1)] > mine)
        last[go] += step
    return starts, under, c, first, last


def merged_windows(key, doc, pos, lo, hi):
    """The windows of a document with the same key whose ranges overlap, as one; its pos is the first."""
    order = np.lexsort((lo, key, doc))
    key, doc, pos, lo, hi = (x[order] for x in (key, doc, pos, lo, hi))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    lift = np.cumsum(fresh) * (int(hi.max(initial=0)) + 2)
    reach = np.maximum.accumulate(hi + lift)
    fresh[1:] |= lo[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return key[at], doc[at], np.minimum.reduceat(pos, at), lo[at], np.maximum.reduceat(hi, at)


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big):
                data, off = text_buffer(batch.column("text"))
                _, _, h, docs = words(data, off)
                g, at = trigrams(h, docs)
                if not len(g) or np.diff(at).max() < least:
                    continue
                ids = batch.column("doc_id").to_numpy()
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for pair in range(PAIRS):
                    s, u1, c1, f1, l1 = compact_windows(g, at, least, _FUNCTIONS[2 * pair])
                    _, u2, c2, f2, l2 = compact_windows(g, at, least, _FUNCTIONS[2 * pair + 1])
                    new = np.ones(len(s), bool)
                    new[1:] = (u1[1:] != u1[:-1]) | (u2[1:] != u2[:-1])
                    a, b = u1[new], u2[new]
                    x, y = np.searchsorted(c1, a), np.searchsorted(c2, b)
                    doc = owner[a]
                    key = mix(g[a] ^ mix(g[b] + np.uint64(pair)))
                    key, doc, *ends = merged_windows(key.view(np.int64), doc, *(z - at[doc] for z in (a, np.maximum(f1[x], f2[y]), np.minimum(l1[x], l2[y]) + 2)))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[doc], pa.int64()), *(pa.array(z.astype(np.int32)) for z in ends)], names=["key", "doc_id", "pos", "lo", "hi"])

    return run


_MET = "key long, doc_id long, pos int, lo int, hi int, hub long, hub_pos int, hub_lo int, hub_hi int, alone boolean"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows whose key another document has, but for the first of each key, which (hub) stands beside the others.

    Rows come in the order of key, doc_id and pos. Of a key that goes on in the next batch only the first window is
    held, or, while no other document has come, those of its document. alone: no third window has the key.
    """
    names = ["key", "doc_id", "pos", "lo", "hi"]
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy() for k in names]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        key, doc, pos, lo, hi = rows
        n = len(key)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, n))
        several = doc[starts + sizes - 1] != doc[starts]
        two = sizes == 2
        two[[0, -1]] = False  # these may go on before or after this batch
        held = [x[starts[-1] : starts[-1] + 1] if several[-1] else x[starts[-1] :] for x in rows]
        hub = np.repeat(starts, sizes)
        out = np.repeat(several, sizes) & ((doc != doc[hub]) | (pos != pos[hub]))
        if out.any():
            h = hub[out]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in rows), *(pa.array(x[h]) for x in rows[1:]), pa.array(np.repeat(two, sizes)[out])], names=[*names, "hub", "hub_pos", "hub_lo", "hub_hi", "alone"])


_SEGMENT = "hub long, blo int, bhi int, s0 int, s1 int, side int, doc_id long, first int, tokens binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes (32 bits) of the asked-for word ranges of each document, with what they were asked for."""
    for big in batches:
        for batch in slices(big):
            data, off = text_buffer(batch.column("text"))
            _, _, h, docs = words(data, off)
            h = (h >> np.uint64(32)).astype(np.uint32)
            ask = batch.column("asked")
            each = np.repeat(np.arange(batch.num_rows), np.diff(ask.offsets.to_numpy()))
            f = ask.flatten()
            lo, hi = (f.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
            rest = [f.field(k) for k in ("hub", "blo", "bhi", "s0", "s1", "side")]
            base, end = docs[each], docs[each + 1]
            a, b = np.minimum(base + np.maximum(lo, 0), end), np.minimum(base + hi + 1, end)
            sizes = np.maximum(b - a, 0)
            at, i = np.concatenate([[0], np.cumsum(sizes)]), 0
            while i < len(sizes):  # many ranges of one document are sent in pieces
                j = max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT_WORDS, side="right")) - 1)
                off = at[i : j + 1] - at[i]
                take = np.repeat(a[i:j] - off[:-1], sizes[i:j]) + np.arange(off[-1])
                yield pa.RecordBatch.from_arrays(
                    [*(x.slice(i, j - i) for x in rest), pa.array(batch.column("doc_id").to_numpy()[each[i:j]], pa.int64()), pa.array((a[i:j] - base[i:j]).astype(np.int32)), binary_column(h[take], off)],
                    names=["hub", "blo", "bhi", "s0", "s1", "side", "doc_id", "first", "tokens"],
                )
                i = j


def _asked_segments(text: DataFrame, asked: DataFrame) -> DataFrame:
    """The segments that (d, lo, hi, hub, blo, bhi, s0, s1, side) asks for; of one document these are as many as it has windows, or fewer."""
    needs = asked.groupBy("d").agg(F.collect_list(F.struct("lo", "hi", "hub", "blo", "bhi", "s0", "s1", "side")).alias("asked"))
    return text.join(needs, text["doc_id"] == needs["d"]).select("doc_id", "text", "asked").mapInArrow(_segments, _SEGMENT)


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _grams(t: np.ndarray) -> np.ndarray:
    t = t.astype(np.uint64)
    return (t[:-2] * _A ^ t[1:-1]) * _B + t[2:]


def _best_range(at: np.ndarray, least: int, similarity: float) -> tuple[int, int] | None:
    """(first, last) of the matches at[first..last] whose range, at least so long, has the best score of those that reach similarity."""
    q = np.arange(len(at)) - similarity * at
    room = np.searchsorted(at, at - least + 1, side="right")  # matches that a range ending here may begin with
    score = np.where(room > 0, q - np.minimum.accumulate(q)[np.maximum(room, 1) - 1], -np.inf)
    last = int(np.argmax(score))
    if score[last] + 1 - similarity < -1e-9:
        return None
    return int(np.argmin(q[: room[last]])), last


def duplicate_spans(a: np.ndarray, b: np.ndarray, least: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Word spans [start, end) of a, at least so long, of whose trigrams at least that share occur in b.

    A span begins and ends with a trigram that occurs in b. The span of the best score (matches less
    similarity times all trigrams) is taken first, then those in what is left on both sides, so that
    every range that qualifies meets a span. Where more than GAP trigrams in a row are missing and
    both sides qualify on their own, the words between are left out.
    """
    if len(a) < max(3, least) or len(b) < 3:
        return []
    ga, gb = _grams(a), np.sort(_grams(b))
    found = np.searchsorted(gb, ga)
    return _ranges(gb[np.minimum(found, len(gb) - 1)] == ga, least, similarity)


def _ranges(hit: np.ndarray, least: int, similarity: float) -> list[tuple[int, int]]:
    """The spans of duplicate_spans, by which trigrams of a occur in b."""
    at = np.flatnonzero(hit)
    least = max(least - 2, 1)
    if len(at) < similarity * least - 1e-9:
        return []
    if len(at) == len(hit):
        return [(0, len(hit) + 2)]

    def good(x: int, y: int) -> bool:
        n = at[y] - at[x] + 1
        return n >= least and y - x + 1 >= similarity * n - 1e-9

    out: list[tuple[int, int]] = []
    todo, whole = [(0, len(at))], []
    while todo:
        x, y = todo.pop()
        if y - x < similarity * least - 1e-9 or (best := _best_range(at[x:y], least, similarity)) is None:
            continue
        first, last = x + best[0], x + best[1]
        whole.append((first, last))
        todo += [(x, first), (last + 1, y)]
    while whole:
        x, y = whole.pop()
        gaps = np.diff(at[x : y + 1]) - 1
        wide = x + np.flatnonzero(gaps > GAP)
        cut = next((int(k) for k in wide[np.argsort(-gaps[wide - x], kind="stable")] if good(x, k) and good(k + 1, y)), None)
        if cut is None:
            out.append((int(at[x]), int(at[y]) + 3))
        else:
            whole += [(x, cut), (cut + 1, y)]
    return sorted(out)


_SPAN = "doc_id long, start_word int, end_word int, of_doc long"


def _span_batch(out: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64())], names=["doc_id", "start_word", "end_word", "of_doc"])


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all rows, offsets)."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, off = text_buffer(c)
    return data.view(np.uint32), off // 4


def _hits(tokens: np.ndarray, off: np.ndarray, group: np.ndarray, partner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which trigrams of the rows that aren't partners occur in a partner of their group, flat; its first for each row).

    Rows shorter than three words have no trigram; the entries of partners mean nothing.
    """
    sizes = np.maximum(np.diff(off) - 2, 0)
    at = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if not len(owner):
        return np.zeros(0, bool), at
    take = np.arange(len(owner)) - at[owner] + off[owner]
    t = tokens.astype(np.uint64)
    g = (t[take] * _A ^ t[take + 1]) * _B + t[take + 2]
    g ^= group[owner].astype(np.uint64) * _C
    theirs = np.sort(g[partner[owner]])
    if not len(theirs):
        return np.zeros(len(g), bool), at
    return theirs[np.minimum(np.searchsorted(theirs, g), len(theirs) - 1)] == g, at


def _verified(least: int, similarity: float):
    """Spans of the rows of side 1 that occur in the row of side 0 of their gid."""
    enough = similarity * max(least - 2, 1) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["gid"], rows=5_000):
            starts = np.append(run_starts(t, ["gid"]), t.num_rows)
            side, doc, first = (t.column(c).to_numpy() for c in ("side", "doc_id", "first"))
            flat, off = _tokens(t.column("tokens"))
            out: list[tuple] = []
            owners = np.add.reduceat((side == 0).astype(np.int64), starts[:-1])
            for k in np.flatnonzero(owners > 1):  # rows that repeat a doc_id, with texts of their own
                i, j = starts[k], starts[k + 1]
                for x in (x for x in range(i, j) if side[x] == 1):
                    for m in (m for m in range(i, j) if side[m] == 0):
                        out += [(int(doc[x]), int(first[x]) + s, int(first[x]) + e, int(doc[m])) for s, e in duplicate_spans(flat[off[x] : off[x + 1]], flat[off[m] : off[m + 1]], least, similarity)]
            plain = np.flatnonzero(owners == 1)
            a = 0
            while a < len(plain):
                b, n = a, 0
                while b < len(plain) and (b == a or n < CHUNK_WORDS):
                    n += off[starts[plain[b] + 1]] - off[starts[plain[b]]]
                    b += 1
                rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in plain[a:b]])
                group = np.repeat(np.arange(b - a), starts[plain[a:b] + 1] - starts[plain[a:b]])
                sizes = off[rows + 1] - off[rows]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                own = flat[np.repeat(off[rows] - ends[:-1], sizes) + np.arange(ends[-1])]
                partner = side[rows] == 0
                hit, at = _hits(own, ends, group, partner)
                total = np.concatenate([[0], np.cumsum(hit)])
                of = doc[rows[partner]]  # one for each group, in order
                for x in np.flatnonzero(~partner & (total[at[1:]] - total[at[:-1]] >= enough)).tolist():
                    r = rows[x]
                    out += [(int(doc[r]), int(first[r]) + s, int(first[r]) + e, int(of[group[x]])) for s, e in _ranges(hit[at[x] : at[x + 1]], least, similarity)]
                a = b
            if out:
                yield _span_batch(out)

    return run


def _prefixes(hold: np.ndarray, at: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """For each segment the number that its leading trigrams' segments don't exceed; -1 where it has none.

    hold: by how many segments of the key each trigram is held; at: first trigram of each segment. The trigrams
    held by more can't make up a span by themselves, whichever segment they are found in, so a segment that
    confirms shares one that is held by so many or fewer.
    """
    need = similarity * max(least - 2, 1) - 1e-9
    out = np.full(len(at) - 1, -1)
    enough = np.add.reduceat(np.append(hold > 1, False).astype(np.int64), at[:-1]) >= need if len(at) > 1 else np.zeros(0, bool)
    for k in np.flatnonzero(enough & (np.diff(at) > 0)).tolist():
        mine = hold[at[k] : at[k + 1]]
        if not _ranges(mine > 1, least, similarity):
            continue
        steps = np.unique(mine[mine > 1])
        lo, hi = 0, len(steps) - 1  # those held by more than the last step are none
        while lo < hi:
            mid = (lo + hi) // 2
            if _ranges(mine > steps[mid], least, similarity):
                lo = mid + 1
            else:
                hi = mid
        out[k] = steps[lo]
    return out


def _confirmed(parts: list[np.ndarray], doc: np.ndarray, within: np.ndarray, least: int, similarity: float) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(segment, earlier one, spans) of the segments of one key, in order; within: the word of each that a span must hold to confirm it.

    A segment is compared with those before it that are unconfirmed, in order, until one confirms it. Which
    these are comes from lists of the unconfirmed ones by trigram. Left out are only pairs that can't have a span.
    """
    sizes = np.array([max(len(x) - 2, 0) for x in parts])
    at = np.concatenate([[0], np.cumsum(sizes)])
    g = np.concatenate([_grams(x) for x in parts if len(x) > 2] or [np.zeros(0, np.uint64)])
    _, gram = np.unique(g, return_inverse=True)
    del g
    owner = np.repeat(np.arange(len(parts)), sizes)
    each = np.unique(gram * len(parts) + owner)
    held = np.bincount(each // len(parts))
    del each
    hold = held[gram]
    to = _prefixes(hold, at, least, similarity)
    leads = np.zeros(len(held), bool)  # grams that lead from some segment
    leads[gram[hold <= to[owner]]] = True
    lists: dict[int, list[int]] = {}
    need = similarity * max(least - 2, 1) - 1e-9
    for k, a in enumerate(parts):
        mine, count = np.unique(gram[at[k] : at[k + 1]], return_counts=True)
        found = False
        if to[k] > 1:
            mask = (held[mine] > 1) & (held[mine] <= to[k])
            rest = count[held[mine] > to[k]].sum()
            near = [(lists[x], c) for x, c in zip(mine[mask].tolist(), count[mask].tolist()) if x in lists]
            if near:
                who = np.concatenate([np.array(x) for x, _ in near])
                shared = np.bincount(who, np.repeat([c for _, c in near], [len(x) for x, _ in near]))
                for m in np.flatnonzero((shared > 0) & (shared + rest >= need)).tolist():
                    if doc[m] != doc[k] and (spans := duplicate_spans(a, parts[m], least, similarity)):
                        yield k, m, spans
                        if found := any(s <= within[k] < e for s, e in spans):
                            break
        if not found:
            for x in mine[leads[mine] & (held[mine] > 1)].tolist():
                lists.setdefault(x, []).append(k)


def _rest(least: int, similarity: float):
    """Spans among the candidates of each key (hub), which come in the order of doc_id and position (side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["hub"], rows=5_000):
            starts = np.append(run_starts(t, ["hub"]), t.num_rows)
            pos, doc, first = (t.column(c).to_numpy() for c in ("side", "doc_id", "first"))
            flat, off = _tokens(t.column("tokens"))
            out: list[tuple] = []
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                parts = [flat[off[k] : off[k + 1]] for k in range(i, j)]
                for k, m, spans in _confirmed(parts, doc[i:j], pos[i:j] - first[i:j], least, similarity):
                    out += [(int(doc[i + k]), int(first[i + k]) + s, int(first[i + k]) + e, int(doc[i + m])) for s, e in spans]
            if out:
                yield _span_batch(out)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist()):
            now: list = []
            for s in sorted(spans, key=lambda s: (s["start_word"], s["end_word"])):
                if now and s["start_word"] <= now[1]:
                    now[1] = max(now[1], s["end_word"])
                    now[2].add(s["of_doc"])
                else:
                    if now:
                        out.append((doc, now[0], now[1], sorted(now[2])))
                    now = [s["start_word"], s["end_word"], {s["of_doc"]}]
            if now:
                out.append((doc, now[0], now[1], sorted(now[2])))
        if out:
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.list_(pa.int64()))], names=["doc_id", "start_word", "end_word", "kept_in"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start_word, end_word, kept_in): the passages of a document that repeat one of a document with a smaller doc_id.

    Spans count words (see _words) from 0 and exclude end_word; overlapping ones are merged; kept_in lists
    the documents whose passage stays; a passage is compared with those of its anchors' first document, then
    with those that nothing earlier confirmed. The first document of a passage is never listed for it. Rows with a
    null doc_id or text and texts of fewer than min_words words give nothing, nor do passages repeated
    within one document only, nor rows that repeat a doc_id (those of different text are all searched, and
    a span holds for each). An empty table gives no rows. Only doc_id and text are read.
    """
    if min_words < 4:
        raise ValueError("min_words must be 4 or more")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text, kept = id_text(docs), Temporary(spark)
    order = ["key", "doc_id", "pos", "lo", "hi"]
    rows = text.mapInArrow(_windows(min_words - 2), "key long, doc_id long, pos int, lo int, hi int").repartition(n, "key").sortWithinPartitions(*order)
    rows = kept.keep(rows.mapInArrow(_met, _MET), "shared")
    pairs = rows.where("doc_id <> hub").groupBy("doc_id", "hub", (F.col("pos") - F.col("hub_pos")).alias("offset")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("hub_lo").alias("hub_lo"), F.max("hub_hi").alias("hub_hi"))
    low, high = (F.floor(F.col("hub_lo") / ROUND) * ROUND).cast("int"), (F.floor(F.col("hub_hi") / ROUND) * ROUND + ROUND - 1).cast("int")
    pairs = kept.keep(pairs.select("doc_id", "hub", "lo", "hi", low.alias("blo"), high.alias("bhi")).distinct(), "pairs")
    segment = pairs.groupBy("hub", "blo", "bhi").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("salts"))
    hot = segment.where("salts > 1").select(F.col("hub").alias("h"), F.col("blo").alias("l"), F.col("bhi").alias("r"), "salts")
    salted = pairs.join(hot, (F.col("hub") == F.col("h")) & (F.col("blo") == F.col("l")) & (F.col("bhi") == F.col("r")), "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "lo"), F.coalesce("salts", F.lit(1))).cast("int"))
    asked = salted.select(F.col("doc_id").alias("d"), "lo", "hi", "hub", "blo", "bhi", F.col("salt").alias("s0"), F.col("salt").alias("s1"), F.lit(1).alias("side"))
    asked = asked.unionByName(segment.select(F.col("hub").alias("d"), F.col("blo").alias("lo"), F.col("bhi").alias("hi"), "hub", "blo", "bhi", F.lit(0).alias("s0"), (F.col("salts") - 1).alias("s1"), F.lit(0).alias("side")))
    parts = _asked_segments(text, asked).withColumn("salt", F.explode(F.sequence("s0", "s1"))).select(F.xxhash64("hub", "blo", "bhi", "salt").alias("gid"), "side", "doc_id", "first", "tokens")
    spans = kept.keep(parts.repartition(n, "gid").sortWithinPartitions("gid", "side").mapInArrow(_verified(min_words, similarity), _SPAN).distinct(), "spans")
    of_pair = spans.groupBy(F.col("doc_id").alias("d"), F.col("of_doc").alias("o")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    left = rows.where("not alone").select("key", "doc_id", "pos", "lo", "hi", "hub")
    left = left.join(of_pair, (F.col("doc_id") == F.col("d")) & (F.col("hub") == F.col("o")), "left")
    left = kept.keep(left.where(~F.coalesce(F.exists("spans", lambda x: (x["start_word"] <= F.col("pos")) & (F.col("pos") < x["end_word"])), F.lit(False))).select("key", "doc_id", "pos", "lo", "hi"), "left")
    many = left.groupBy(F.col("key").alias("k")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("k")
    left = kept.keep(left.join(many, F.col("key") == F.col("k"), "left_semi"), "unconfirmed")
    kept.drop("shared", "pairs", "left")
    ids = left.select(F.col("doc_id").alias("d")).distinct()
    if left.count() <= BROADCAST_IDS:
        text = text.join(F.broadcast(ids), text["doc_id"] == ids["d"], "left_semi")
    none = F.lit(0)
    asked = left.select(F.col("doc_id").alias("d"), "lo", "hi", F.col("key").alias("hub"), none.alias("blo"), none.alias("bhi"), none.alias("s0"), none.alias("s1"), F.col("pos").alias("side"))
    rest = _asked_segments(text, asked).select("hub", "side", "doc_id", "first", "tokens").repartition(n, "hub").sortWithinPartitions("hub", "doc_id", "side").mapInArrow(_rest(min_words, similarity), _SPAN)
    return spans.union(rest).groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word", "of_doc")).alias("spans")).mapInArrow(_merged, "doc_id long, start_word int, end_word int, kept_in array<long>")


def _without(text: str, spans: list[dict]) -> str | None:
    """text without word spans; null if no word is left."""
    raw = text.encode()
    # lower-casing may change the length of a character, never what separates words
    s, _, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    keep, at, left = [], 0, len(s)
    for x in sorted(spans, key=lambda x: x["start_word"]):
        if x["start_word"] < len(s):
            keep.append(raw[at : s[x["start_word"]]])
            at = s[x["end_word"]] if x["end_word"] < len(s) else len(raw)
            left -= min(x["end_word"], len(s)) - x["start_word"]
    return b"".join([*keep, raw[at:]]).decode() if left else None


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without the word spans in their last column, n_chars counted anew; rows that have none go through untouched."""
    for batch in batches:
        spans = batch.column(batch.num_columns - 1)
        rest = batch.select(range(batch.num_columns - 1))
        hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False) & batch.column("text").is_valid().to_numpy(zero_copy_only=False))
        if not len(hit):
            yield rest
            continue
        pick = pa.array(hit)
        texts = [_without(t, s) for t, s in zip(batch.column("text").take(pick).to_pylist(), spans.take(pick).to_pylist())]
        whole = np.ones(batch.num_rows, bool)
        whole[hit] = False
        yield rest.filter(pa.array(whole))
        left = rest.take(pick).filter(pa.array([t is not None for t in texts]))
        texts = [t for t in texts if t is not None]
        for name, values in (("text", texts), ("n_chars", [len(t) for t in texts])):
            if (i := left.schema.get_field_index(name)) >= 0:
                left = left.set_column(i, left.schema.field(i), pa.array(values, left.schema.field(i).type))
        yield left


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the passages of repeated_passages cut out of text and n_chars counted anew; columns stay.

    A document is dropped only if a cut leaves no word of it. All others, those with a null doc_id or
    text among them, stay as they are. The texts are shuffled once, to meet their spans.
    """
    mine, id_ = free_name(docs, "spans"), free_name(docs, "id")
    spans = repeated_passages(docs, min_words, similarity).groupBy(F.col("doc_id").alias(id_)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(mine))
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans[id_], "left").select(*[docs[c] for c in docs.columns], spans[mine])
    return joined.mapInArrow(_cut, docs.schema)
