"""Near-duplicate documents by DartMinHash signatures, banded joining and exact comparison."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.graph import components, stars
from driftmark.llm.tables import sieve, sifted, small_batches, stored, tidied
from driftmark.llm.words import SPACES, U64, Slice, mix, slices, span_hash, prefix_sums, windows, words

DART_DOCS = 256
STEP = U64(0xD1B54A32D192ED03)


def shingle_units(piece: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and id of every unit of weight: the k-th occurrence of a shingle in a document is its own unit.

    A text of fewer than ``size`` words, but some, is one shingle.  Sets of units stand for weighted sets: their
    Jaccard similarity is the weighted one of shingle counts.
    """
    w = words(piece, SPACES)
    at, h = windows(w, size)
    doc = w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        doc = np.r_[doc, short]
        h = np.r_[h, span_hash(prefix_sums(w.hash), w.first[short], w.first[short + 1])]
    key = mix(h + mix(doc.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
    return doc[order], h[order] + nth.astype(U64) * STEP


def signatures(doc: np.ndarray, unit: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k DartMinHash signatures (0 rows for documents without units).

    Darts fall on a unit of weight as a Poisson process in time, drawn from the unit's hash, each into one of k
    coordinates.  A document only throws the darts up to the time at which about k (ln k + 2) have landed on its whole
    weight, so the work hardly grows with its length; if a coordinate is still empty the time is doubled.  The
    earliest dart of each coordinate is kept: two documents agree in a coordinate with their weighted similarity.
    """
    weight = np.bincount(doc, minlength=n)
    best = np.full(n * k, np.inf)
    sig = np.zeros(n * k, U64)
    limit = np.zeros(n)
    limit[weight > 0] = k * (math.log(k) + 2) / weight[weight > 0]
    waiting = weight > 0
    while waiting.any():
        active = np.flatnonzero(waiting[doc])
        time, rank = np.zeros(len(active)), 0
        thrown = []
        while len(active):
            h = mix(unit[active] + U64((rank + 1) * 0x8CB92BA72F3D8DD7 % 2**64))
            time = time - np.log1p(-(h >> U64(11)).astype(float) * 2.0**-53)
            alive = time <= limit[doc[active]]
            active, time, h = active[alive], time[alive], h[alive]
            thrown.append((doc[active] * k + (mix(h + STEP) % U64(k)).astype(np.int64), time, h))
            rank += 1
        cell, when, dart = (np.concatenate(x) for x in zip(*thrown))
        np.minimum.at(best, cell, when)
        first = when == best[cell]
        sig[cell[first]] = dart[first]
        waiting &= np.isinf(best.reshape(n, k)).any(axis=1)
        limit[waiting] *= 2
    return sig.reshape(n, k)


def _bands(batches, size, bands, rows):
    for batch in batches:
        h1, h2, value = [], [], []
        for piece in slices(batch.column(2), docs=DART_DOCS):  # each document throws its own darts
            doc, unit = shingle_units(piece, size)
            some = np.unique(doc)
            if not len(some):
                continue
            sig = signatures(doc, unit, len(piece), bands * rows)[some].reshape(len(some), bands, rows)
            v = np.repeat(np.arange(1, bands + 1, dtype=U64)[None, :], len(some), 0) * STEP
            for r in range(rows):
                v = mix(v + sig[:, :, r])
            at = pa.array(np.repeat(some + piece.first, bands))
            h1.append(batch.column(0).take(at))
            h2.append(batch.column(1).take(at))
            value.append(pa.array(v.view(np.int64).ravel()))
        if value:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (h1, h2, value)], names=["h1", "h2", "band"])


def _similar(own: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which documents (sorted unit arrays) have Jaccard similarity >= threshold, as a matrix."""
    n = len(own)
    size = np.array([len(x) for x in own], float)
    shared = np.zeros((n, n))
    if n <= 12:
        for i in range(n):
            for j in range(i):
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]):
                    shared[i, j] = shared[j, i] = len(np.intersect1d(own[i], own[j], assume_unique=True))
    else:
        doc = np.repeat(np.arange(n), size.astype(int))
        _, inverse, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        often = count[inverse] > 1
        column = (np.cumsum(count > 1) - 1)[inverse[often]]
        doc = doc[often]
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, (low, low + 4096))
            part = np.zeros((n, 4096), np.float32)
            part[doc[a:b], column[a:b] - low] = 1
            shared += part @ part.T
    near = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    near &= shared > 0
    np.fill_diagonal(near, False)
    return near


def _verified(batches, size, threshold):
    """Stars of exact links within each group; rows come ordered by group (component and block pair)."""
    held: dict[tuple, bytes] = {}
    group = None

    def solved():
        ids = list(held)
        own = []
        for piece in slices(pa.array([held[i] for i in ids], pa.binary())):
            doc, unit = shingle_units(piece, size)
            order = np.lexsort((unit, doc))
            unit = unit[order]  # once: a copy for each document would hold all units as often as there are documents
            cut = np.searchsorted(doc[order], np.arange(len(piece) + 1))
            own += [unit[cut[d]:cut[d + 1]] for d in range(len(piece))]
        centre = stars(_similar(own, threshold))
        moved = [(ids[i], ids[c]) for i, c in enumerate(centre.tolist()) if c != i]
        cols = [pa.array([x[s][p] for x in moved], pa.int64()) for s in (0, 1) for p in (0, 1)]
        return pa.RecordBatch.from_arrays(cols, names=["a1", "a2", "b1", "b2"])

    for batch in batches:
        keys = zip(*[batch.column(i).to_pylist() for i in range(6)])
        texts = batch.column(6)
        for at, (c1, c2, i, j, h1, h2) in enumerate(keys):
            if (c1, c2, i, j) != group:
                if len(held) > 1:
                    yield solved()
                held, group = {}, (c1, c2, i, j)
            held[(h1, h2)] = texts[at].as_py().encode()
    if len(held) > 1:
        yield solved()


def fingerprint(text: Column) -> tuple[Column, Column]:
    """Two numbers (h1, h2) that tell texts apart; null counts as empty."""
    given = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(given).alias("h1"), (F.shiftleft(F.crc32(F.encode(given, "UTF-8")), 31) + F.length(given)).alias("h2")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 7,
                    block_docs: int = 192, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, class_id (smallest id of its class), n_class and kept for every row, with the text's fingerprint (h1, h2).

    Classes are the connected components of equal texts and of pairs whose weighted Jaccard similarity on
    ``size``-word shingles (words: runs of bytes other than white space) is ``threshold`` or more.

    1. Equal texts are one node (a 128-bit fingerprint), so groups of copies cost one row each.
    2. Nodes that share a band of ``rows`` signature coordinates in one of ``bands`` meet: each is linked to the
       band's smallest node.  With 32 bands of 7 a pair at 0.8 is met with probability 0.9995, closer pairs more surely.
    3. Nodes so connected are compared exactly, each component in blocks of bounded size, every block with every
       other.  A block pair returns stars, not pairs.  The components of these stars are the classes.

    ``kept`` marks the row with the smallest id of its class (rows that repeat that id and text are all marked); null ids come last.  Null texts count as
    empty; texts without words are only like their own copies.  No rows give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    marked = small_batches(docs).select(F.col(id_col).alias("doc_id"), text, *fingerprint(F.col(text_col)))
    banded = stored(marked.select("h1", "h2", "text").mapInArrow(tidied(lambda b: _bands(b, size, bands, rows)), "h1 long, h2 long, band long"), "bands")
    node = F.struct("h1", "h2")
    crowded = banded.groupBy("band").agg(F.min(node).alias("low"), F.max(node).alias("high")).where("low != high").select("band", "low")
    # both joins grow with the corpus: sort-merge at every size
    met = banded.join(crowded.hint("merge"), "band").select(node.alias("a"), F.col("low").alias("b")).where("a != b").distinct()
    groups = components(met).select(F.col("id.h1").alias("h1"), F.col("id.h2").alias("h2"), F.col("component.h1").alias("c1"), F.col("component.h2").alias("c2"))

    lowest = marked.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("low"))
    chosen = stored(lowest.join(groups, ["h1", "h2"]).select("h1", "h2", "c1", "c2", "low"), "met")
    # few texts have met another: a sieve keeps the others from travelling
    likely = sifted(marked, "h1", sieve(chosen, "h1")).where("let_through").drop("let_through")
    met_as = chosen.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), "c1", "c2", F.col("low.id").alias("m_id"))
    same = (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2")) & F.col("doc_id").eqNullSafe(F.col("m_id"))
    texts = likely.join(met_as.hint("merge"), same).select("c1", "c2", "h1", "h2", "text")
    bulk = texts.select("c1", "c2", F.length("text").alias("n")).groupBy("c1", "c2").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n") / block_bytes)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("h1", "h2"), F.col("parts")).cast("int")
    split = texts.join(bulk, ["c1", "c2"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select("c1", "c2", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "h1", "h2", "text")
    ordered = split.repartition("c1", "c2", "i", "j").sortWithinPartitions("c1", "c2", "i", "j")
    found = ordered.mapInArrow(tidied(lambda b: _verified(b, size, threshold)), "a1 long, a2 long, b1 long, b2 long")
    classes = components(found.select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("b")))
    classes = classes.select(F.col("id.h1").alias("h1"), F.col("id.h2").alias("h2"), "component")

    rows_of = marked.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"], "left").withColumn("component", F.coalesce("component", node))
    best = rows_of.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h1", "h2")).alias("best"), F.count(F.lit(1)).alias("n_class"))
    out = rows_of.join(best, "component")
    kept = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("h1") == F.col("best.h1")) & (F.col("h2") == F.col("best.h2"))
    return out.select("doc_id", "h1", "h2", F.col("best.id").alias("class_id"), "n_class", kept.alias("kept"))
