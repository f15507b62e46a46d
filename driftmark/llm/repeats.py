"""Where sequences of a fixed length may occur twice in a corpus, found without moving the corpus.

Every window of ``size`` units (bytes or words) is keyed by the smallest hash of the ``gram``-unit sequences in it
(its minimiser).  Equal windows have equal minimisers, so a window whose minimiser is met once in the corpus is
unique.  Neighbouring windows share minimisers; a maximal run of them is one record, about one in
(size - gram + 2) / 2 units.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tables import parts_for, small_batches, stored, tidied
from driftmark.llm.words import BYTE_VALUE, SPACES, U64, Slice, mixed, prefix_sums, slices, span_hash, words

#: A run: minimiser, hash of its units, document (id, text hash), first window, number of windows.
RUN = np.dtype([("key", "<u8"), ("seg", "<u8"), ("id", "<i8"), ("h", "<i8"), ("start", "<i4"), ("n", "<i4")])
RUN_SCHEMA = "key long, seg long, id long, h long, start int, n int"
UNDECIDED, SIGNAL, DECIDED = 0, 1, 2
FLUSH = 200_000


def byte_units(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Value of every byte, and where documents begin."""
    return BYTE_VALUE[piece.buf], piece.offsets


def word_units(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    w = words(piece, SPACES)
    return w.hash, w.first


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text with a key without nulls: id (0 for null) and a hash of the text and of whether the id is null.

    The columns in ``keep`` travel along as the struct ``rest``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = F.col(id_col).cast("long")
    return small_batches(docs).select(F.coalesce(given, F.lit(0).cast("long")).alias("id"), F.xxhash64(text, given.isNull()).alias("h"), given.alias("doc_id"), text.alias("text"), *([F.struct(*keep).alias("rest")] if keep else []))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values: running minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(U64).max, U64)
    padded[:len(x)] = x
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def minimiser_runs(values: np.ndarray, bounds: np.ndarray, size: int, gram: int):
    """(document, start, n, key, seg) of all runs and the keys of all minimiser positions."""
    length = np.diff(bounds)
    count = np.maximum(length - size + 1, 0)
    if not count.sum():
        return None
    width = size - gram + 1
    q = prefix_sums(values)
    grams = np.arange(len(values) - gram + 1)
    h = span_hash(q, grams, grams + gram)
    low = sliding_min(h, width)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(doc)) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    key = low[at]
    new = np.r_[True, (np.diff(at) != 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, len(at)])
    start = at[begin]
    # a position is a minimiser if its hash is the largest minimum of the windows around it
    held = np.full(len(low) + 2 * (width - 1), np.iinfo(U64).max, U64)
    held[at + width - 1] = ~key
    places = h[h == ~sliding_min(held, width)[:len(h)]]
    return doc[begin], start - bounds[doc[begin]], n, key[begin], span_hash(q, start, start + n + size - 1), places


def _blob(runs: np.ndarray) -> bytes:
    """Runs column by column; the columns that repeat are compressed."""
    rest = b"".join(np.ascontiguousarray(runs[c]).tobytes() for c in ("id", "h", "start", "n"))
    return struct.pack("<I", len(runs)) + runs["key"].tobytes() + runs["seg"].tobytes() + zstandard.compress(rest, 1)


def _unblob(blob: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", blob)[0]
    runs = np.empty(n, RUN)
    runs["key"] = np.frombuffer(blob, "<u8", n, 4)
    runs["seg"] = np.frombuffer(blob, "<u8", n, 4 + 8 * n)
    rest, at = zstandard.decompress(blob[4 + 16 * n:]), 0
    for c, kind in (("id", "<i8"), ("h", "<i8"), ("start", "<i4"), ("n", "<i4")):
        runs[c] = np.frombuffer(rest, kind, n, at)
        at += n * int(kind[-1])
    return runs


def _sent(parts: list[np.ndarray], places: list[np.ndarray], buckets: int):
    """Rows (bucket, kind, blob) of what a task has gathered.

    A minimiser met twice within the task is decided here: its runs only pass through (dealt by document), and one
    signal tells the other tasks.  So a key that is everywhere sends one record a task to its bucket.
    """
    runs = np.concatenate(parts)
    known, count = np.unique(np.concatenate(places), return_counts=True)
    twice = known[count > 1]
    decided = np.zeros(len(runs), bool)
    if len(twice):
        found = np.minimum(np.searchsorted(twice, runs["key"]), len(twice) - 1)
        decided = twice[found] == runs["key"]
    rows: list[tuple[int, int, bytes]] = []

    def dealt(kind, array, bucket, pack):
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows.extend((b, kind, pack(array[order[cut[b]:cut[b + 1]]])) for b in np.flatnonzero(np.diff(cut)).tolist())

    spread = U64(buckets)
    open_runs, sure = runs[~decided], runs[decided]
    dealt(UNDECIDED, open_runs, (mixed(open_runs["key"]) % spread).astype(np.int64), _blob)
    dealt(SIGNAL, twice, (mixed(twice) % spread).astype(np.int64), lambda k: k.tobytes())
    dealt(DECIDED, sure, (mixed(sure["h"].view(U64)) % spread).astype(np.int64), _blob)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])


def _scan(batches, units, size, gram, buckets):
    parts, places, held = [], [], 0
    for batch in batches:
        ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for piece in slices(batch.column(2)):
            found = minimiser_runs(*units(piece), size, gram)
            if found is None:
                continue
            doc, start, n, key, seg, place = found
            runs = np.empty(len(doc), RUN)
            runs["id"], runs["h"] = ids[piece.first + doc], hashes[piece.first + doc]
            runs["start"], runs["n"], runs["key"], runs["seg"] = start, n, key, seg
            parts.append(runs)
            places.append(place)
            held += len(runs)
            if held >= FLUSH:
                yield _sent(parts, places, buckets)
                parts, places, held = [], [], 0
    if parts:
        yield _sent(parts, places, buckets)


def runs_batch(runs: np.ndarray) -> pa.RecordBatch:
    cols = [np.ascontiguousarray(runs[c]) for c in RUN.names]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in cols], names=list(RUN.names))


def by_bucket(batches, width: int):
    """(bucket, rows) of batches ordered by their first column; rows are tuples of the next ``width`` columns."""
    bucket, rows = None, []
    for batch in batches:
        columns = [batch.column(i + 1).to_pylist() for i in range(width)]
        for b, row in zip(batch.column(0).to_pylist(), zip(*columns)):
            if b != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = b, []
            rows.append(row)
    if rows:
        yield bucket, rows


def _gathered(batches):
    for _, rows in by_bucket(batches, 2):
        waiting = [_unblob(blob) for kind, blob in rows if kind == UNDECIDED]
        signals = [np.frombuffer(blob, "<u8") for kind, blob in rows if kind == SIGNAL]
        for kind, blob in rows:
            if kind == DECIDED:
                yield runs_batch(_unblob(blob))
        if waiting:
            runs = np.concatenate(waiting)
            # a task sends a key as runs of one place or as a signal; a key twice in here is in two tasks
            keys = np.concatenate([np.unique(r["key"]) for r in waiting] + signals)
            known, count = np.unique(keys, return_counts=True)
            yield runs_batch(runs[(count > 1)[np.searchsorted(known, runs["key"])]])


def repeated_runs(docs: DataFrame, units: Callable, size: int, gram: int, bucket_bytes: int = 12 << 20) -> DataFrame:
    """The runs (``RUN_SCHEMA``) whose minimiser stands in at least two places of the corpus, stored.

    docs: the columns of ``keyed``.  Every window that occurs twice is in one of them.  Records travel in blobs,
    one for each task and bucket; the number of buckets follows the size of the texts.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    buckets = parts_for(total or 0, bucket_bytes, spark)
    sent = docs.select("id", "h", "text").mapInArrow(tidied(lambda b: _scan(b, units, size, gram, buckets)), "bucket int, kind int, blob binary")
    met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return stored(met.mapInArrow(tidied(_gathered), RUN_SCHEMA), "runs")


def lists_of(rows: DataFrame, *columns: str) -> DataFrame:
    """``spans`` of each document: its rows' columns as a list (bounded by the document's own length)."""
    return rows.groupBy("id", "h").agg(F.collect_list(F.struct(*columns)).alias("spans"))


def beside(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents with their ``spans`` (null if none).

    Always a left join of the whole ``keyed`` table: within one query its exchange is made once and reused.
    """
    return docs.join(lists, ["id", "h"], "left").select(*docs.columns, "spans")


def span_arrays(spans, width: int) -> np.ndarray:
    """A row's list of structs of ints as an array."""
    return np.array([tuple(s.values()) for s in spans or ()], np.int64).reshape(-1, width)


def covered(spans: np.ndarray, size: int, n: int) -> np.ndarray:
    """Units (mask of n) under the windows (start, count) of ``size`` units."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 0] + spans[:, 1] + size - 1, -1)
    return np.cumsum(edge[:-1]) > 0
