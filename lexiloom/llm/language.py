"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Both directions read a window of bytes one by one; every position gets the probabilities of the languages
from both states, and a document's probabilities are the means over all its positions. The network is
trained by backpropagation through time (Adam) on windows of a bounded sample of labelled documents.

Arrays keep the windows in the last axis, sorted by length, so that each step works on a contiguous prefix
of those that are still running; a window's padding is never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import slices, text_buffer

HIDDEN = 8
#: Bytes of a window, and those before and after it that are read with it, so that the states at its ends know
#: their surroundings; the labels of these bytes come from the windows that they are in.
WINDOW, CONTEXT = 512, 32
#: Windows that run side by side.
LANES = 1024
#: The classifier is fitted on windows of at most about so many documents of each language, whatever the table's size.
SAMPLE_ROWS = 1500
TRAIN_WINDOW, TRAIN_BATCH, TRAIN_STEPS, RATE = 64, 256, 160, 0.02
#: A document whose best language has less than this mean probability is rejected.
LEAST = 0.5
SEED = 5


@dataclass
class Model:
    """Weights: for each direction the bytes' input table (3 * hidden, 256) and the recurrence (3 * hidden, hidden); the output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    loops: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.loops, self.out, self.bias]


def new_model(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Model:
    r = np.random.default_rng(seed)
    f = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
    return Model(list(languages), [f(3 * hidden, 256), f(3 * hidden, 256)], [f(3 * hidden, hidden), f(3 * hidden, hidden)], f(len(languages), 2 * hidden), np.zeros(len(languages), np.float32))


def _sigmoid(x: np.ndarray) -> None:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


def _run(table: np.ndarray, loop: np.ndarray, ids: np.ndarray, live: np.ndarray, back: bool, keep: bool):
    """States (steps, hidden, lanes) of one direction; with keep also what training needs of each step."""
    steps, lanes = ids.shape
    hidden = loop.shape[1]
    states = np.zeros((steps, hidden, lanes), np.float32)
    held: list = [None] * steps
    h = np.zeros((hidden, lanes), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        n = live[t]
        now = h[:, :n].copy()  # a view would see the next state
        g = loop @ now
        x = table.take(ids[t, :n], axis=1)
        zr = x[: 2 * hidden]
        zr += g[: 2 * hidden]
        _sigmoid(zr)
        z, r, c = zr[:hidden], zr[hidden:], x[2 * hidden :]
        gn = g[2 * hidden :]
        c += r * gn
        np.tanh(c, out=c)
        nxt = now - c
        nxt *= z
        nxt += c
        if keep:
            held[t] = (now, z, r, c, gn)
        h[:, :n] = nxt
        states[t, :, :n] = nxt
    return states, held


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-2, keepdims=True)
    return x


def probabilities(m: Model, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(steps, languages, lanes) for windows sorted by falling length; positions beyond a window's length mean nothing."""
    live = (lengths[None, :] > np.arange(len(ids))[:, None]).sum(axis=1)
    a, _ = _run(m.tables[0], m.loops[0], ids, live, False, False)
    b, _ = _run(m.tables[1], m.loops[1], ids, live, True, False)
    hidden = m.loops[0].shape[1]
    x = m.out[:, :hidden] @ a
    x += m.out[:, hidden:] @ b
    x += m.bias[:, None]
    return _softmax(x)


def gradients(m: Model, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions and its gradients, by backpropagation through time."""
    steps, lanes = ids.shape
    hidden = m.loops[0].shape[1]
    mask = lengths[None, :] > np.arange(steps)[:, None]
    live, total = mask.sum(axis=1), max(1, int(mask.sum()))
    runs = [_run(m.tables[d], m.loops[d], ids, live, bool(d), True) for d in (0, 1)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=1)
    p = _softmax(m.out @ both + m.bias[:, None])
    own = np.broadcast_to(labels[None, None, :], (steps, 1, lanes))
    loss = float(-(np.log(np.take_along_axis(p, own, axis=1)[:, 0] + 1e-12) * mask).sum() / total)
    d = p
    np.put_along_axis(d, own, np.take_along_axis(d, own, axis=1) - 1, axis=1)
    d *= mask[:, None, :] / np.float32(total)
    g_out, g_bias = np.einsum("tcb,thb->ch", d, both, optimize=True), d.sum(axis=(0, 2))
    from_out = m.out.T @ d
    tables, loops = [], []
    for k in (0, 1):
        loop, held = m.loops[k], runs[k][1]
        g_loop, gx = np.zeros_like(loop), np.zeros((steps, 3 * hidden, lanes), np.float32)
        dh = np.zeros((hidden, lanes), np.float32)
        for t in range(steps) if k else range(steps - 1, -1, -1):
            n = live[t]
            now, z, r, c, gn = held[t]
            e = dh[:, :n] + from_out[t, k * hidden : (k + 1) * hidden, :n]
            ac = e * (1 - z) * (1 - c * c)
            az = e * (now - c) * z * (1 - z)
            ar = ac * gn * r * (1 - r)
            dg = np.concatenate([az, ar, ac * r])
            g_loop += dg @ now.T
            gx[t, : 2 * hidden, :n], gx[t, 2 * hidden :, :n] = dg[: 2 * hidden], ac
            dh[:, :n] = e * z + loop.T @ dg
        flat = ids.ravel()
        tables.append(np.stack([np.bincount(flat, gx[:, i].ravel(), 256) for i in range(3 * hidden)]).astype(np.float32))
        loops.append(g_loop)
    return loss, [*tables, *loops, g_out, g_bias]


def lanes_of(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of steps by lanes, lengths, order): windows sorted by falling length; order gives their former numbers."""
    sizes = np.array([len(w) for w in windows], np.int64)
    order = np.argsort(-sizes, kind="stable")
    ids = np.zeros((max(1, int(sizes.max(initial=0))), len(windows)), np.uint8)
    for j, i in enumerate(order):
        ids[: sizes[i], j] = np.frombuffer(windows[i], np.uint8)
    return ids, sizes[order], order


def fit(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = TRAIN_STEPS, batch: int = TRAIN_BATCH, rate: float = RATE, seed: int = SEED) -> Model:
    """Train on labelled windows, drawn with equal weight for each language; the same input gives the same model."""
    languages = sorted(set(labels))
    m = new_model(languages, hidden, seed)
    if len(languages) < 2:
        return m
    rng = np.random.default_rng(seed)
    by = [[i for i, x in enumerate(labels) if x == lang] for lang in languages]
    first, second = [np.zeros_like(w) for w in m.weights()], [np.zeros_like(w) for w in m.weights()]
    for step in range(steps):
        kinds = rng.integers(0, len(languages), batch)
        ids, sizes, order = lanes_of([windows[by[k][int(rng.integers(len(by[k])))]] for k in kinds])
        _, grads = gradients(m, ids, sizes, kinds[order])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * (1 - step / steps) + rate / 20
        for w, g, a, b in zip(m.weights(), grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (now * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(b / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
    return m


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, window: int = TRAIN_WINDOW, **options) -> Model:
    """A model of the languages in lang, from windows of a hash sample of about sample_rows documents of each.

    Rows with a null lang, doc_id or text and empty texts teach nothing; without any the model has no language.
    """
    labelled = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].alias("text")).where("doc_id is not null and lang is not null and text <> ''")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return new_model([])
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample_rows / n))) for k, n in sorted(counts.items())])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    at = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.greatest(F.length("text") - window + 1, F.lit(1))) + 1
    rows = sorted(labelled.where(draw < share).select("doc_id", "lang", F.substring("text", at.cast("int"), F.lit(window)).alias("w")).collect())
    return fit([r["w"].encode()[:window] for r in rows], [r["lang"] for r in rows], **options)


def _lanes(data: np.ndarray, off: np.ndarray, window: int, lanes: int, context: int = CONTEXT):
    """Cut documents into windows and read them with their context, sorted by falling length, in batches.

    (ids, lengths, starts, documents, which steps of a lane are of its window).
    """
    sizes = np.diff(off)
    parts = -(-sizes // window)
    doc = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = off[doc] + nth * window
    last = np.minimum(first + window, off[doc + 1])
    start = np.maximum(first - context, off[doc])
    length = np.minimum(last + context, off[doc + 1]) - start
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), lanes):
        o = order[a : a + lanes]
        at = start[o][None, :] + np.arange(length[o[0]])[:, None]
        yield data[np.minimum(at, len(data) - 1)], length[o], start[o], doc[o], (at >= first[o]) & (at < last[o])


def pooled(m: Model, data: np.ndarray, off: np.ndarray, window: int = WINDOW, lanes: int = LANES, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """(mean probabilities, shares of positions labelled), each (documents, languages); zero for empty texts."""
    n, k = len(off) - 1, len(m.languages)
    soft, hard = np.zeros((n, k)), np.zeros((n, k))
    if k and len(data):
        for ids, length, _, doc, mine in _lanes(data, off, window, lanes, context):
            p = probabilities(m, ids, length)
            p = np.where(mine[:, None, :], p, np.float32(0))
            top = (p == p.max(axis=1, keepdims=True)) & mine[:, None, :]
            s, t = p.sum(axis=0, dtype=np.float32), top.sum(axis=0, dtype=np.float32)
            for c in range(k):
                soft[:, c] += np.bincount(doc, s[c], n)
                hard[:, c] += np.bincount(doc, t[c], n)
        size = np.maximum(np.diff(off), 1)[:, None]
        soft /= size
        hard /= size
    return soft, hard


def _identify(m: Model, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big):
                text = pc_fill(batch.column("text"))
                soft, hard = pooled(m, *text_buffer(text), window)
                has = np.diff(text_buffer(text)[1]) > 0
                k = len(m.languages)
                best = soft.argmax(axis=1) if k else np.zeros(batch.num_rows, int)
                known = has & bool(k)
                names = [m.languages[i] if ok else None for i, ok in zip(best, known)]
                top = [round(float(soft[i, c]), 6) if ok else None for i, (c, ok) in enumerate(zip(best, known))]
                shares = [[round(float(x), 6) for x in hard[i]] if ok else None for i, ok in enumerate(known)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "language", "probability", "shares"])

    return run


def pc_fill(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.fill_null(column, "")


def identify(docs: DataFrame, model: Model | None = None, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(doc_id, language, probability, shares, accepted) of every row, read whole.

    probability: the mean over all positions for the language, the one of the highest mean (ties: the first
    by name). shares: of the positions labelled with each language, in order of their names. accepted: the
    probability is at least least. A null or empty text has null language, probability and shares and isn't
    accepted, nor is any row if there is no labelled document. Rows that repeat and null doc_ids are kept as
    they are; an empty table gives no rows. model: trained on docs itself unless given.
    """
    m = train(docs) if model is None else model
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_identify(m, window), "doc_id long, language string, probability double, shares array<double>")
    return out.withColumn("accepted", F.coalesce(F.col("probability") >= least, F.lit(False)))


def accepted(docs: DataFrame, model: Model | None = None, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """The rows of docs that identify accepts, all columns as they are, whatever their names; null and empty texts go."""
    m = train(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            text, at = pc_fill(big.column("text")), 0
            for batch in slices(pa.RecordBatch.from_arrays([text], names=["text"])):
                soft, _ = pooled(m, *text_buffer(batch.column("text")), window)
                ok = soft.max(axis=1) >= least if len(m.languages) else np.zeros(batch.num_rows, bool)
                yield big.slice(at, batch.num_rows).filter(pa.array(ok))
                at += batch.num_rows

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def label_positions(docs: DataFrame, model: Model | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, end, language): the runs of bytes of one label; every byte of a text is in one. Null and empty texts have none."""
    m = train(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big):
                data, off = text_buffer(pc_fill(batch.column("text")))
                if not len(data) or not m.languages:
                    continue
                label = np.zeros(len(data), np.int64)
                for ids, length, start, _, mine in _lanes(data, off, window, LANES):
                    p = probabilities(m, ids, length).argmax(axis=1)
                    label[(start[None, :] + np.arange(len(ids))[:, None])[mine]] = p[mine]
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                cut = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
                end = np.append(cut[1:], len(data))
                own = doc[cut]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), pa.array(cut - off[own]), pa.array(end - off[own]), pa.array([m.languages[i] for i in label[cut]])], names=["doc_id", "start", "end", "language"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, start long, end long, language string")
