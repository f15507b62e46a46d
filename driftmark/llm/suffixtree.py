"""Repeated passages of words, found in suffix trees that are partitioned by variable-length prefixes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.repeats import beside, by_bucket, covered, keyed, lists_of, repeated_runs, span_arrays, word_units
from driftmark.llm.tables import parts_for, stored, tidied
from driftmark.llm.words import SPACES, U64, mixed, prefix_sums, slices, span_hash, words

#: A suffix: hash of its prefix (its subtree), hash of its first ``size`` words, document and first word.
SUFFIX = np.dtype([("prefix", "<u8"), ("path", "<u8"), ("id", "<i8"), ("h", "<i8"), ("start", "<i4")])
SUFFIXES, LATER = 0, 1


def _counts(batches, bits):
    total = np.zeros(1 << bits, np.int64)
    for batch in batches:
        for piece in slices(batch.column(0)):
            total += np.bincount((words(piece, SPACES).hash >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])


def frequent_slots(docs: DataFrame, capacity: int) -> tuple[np.ndarray, int]:
    """Which hash slots of words hold more than ``capacity`` words of the corpus, over all texts.

    The slots number four times the corpus' words over the capacity (1024 at least), so most hold few words.
    """
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(10, math.ceil(math.log2(4 * max(octets / 6, 1) / capacity + 1)))
    counted = docs.select("text").mapInArrow(lambda b: _counts(b, bits), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    frequent = np.zeros(1 << bits, bool)
    frequent[[r.slot for r in counted.where(F.col("n") > capacity).collect()]] = True
    return frequent, bits


def order_of(s: np.ndarray) -> np.ndarray:
    """Suffixes by subtree and path, the earliest first."""
    return np.lexsort((s["start"], s["h"], s["id"], s["path"], s["prefix"]))


def later_leaves(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subtrees' suffixes as leaves in order, and which of them stand under a deep node after its first leaf.

    A node is deep if its path has the full window length; it is internal if it has two leaves.
    """
    s = s[order_of(s)]
    same = np.r_[False, (s["path"][1:] == s["path"][:-1]) & (s["prefix"][1:] == s["prefix"][:-1])] if len(s) else np.zeros(0, bool)
    return s, same


def _blob(s: np.ndarray) -> bytes:
    s = s[np.argsort(s["id"], kind="stable")]
    hashes = s["prefix"].tobytes() + s["path"].tobytes()
    rest = s["id"].tobytes() + s["h"].tobytes() + s["start"].tobytes()
    return hashes + zstandard.compress(rest, 1)


def _unblob(blob: bytes, n: int) -> np.ndarray:
    s, rest = np.empty(n, SUFFIX), zstandard.decompress(blob[16 * n:])
    s["prefix"], s["path"] = np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<u8", n, 8 * n)
    s["id"], s["h"], s["start"] = np.frombuffer(rest, "<i8", n), np.frombuffer(rest, "<i8", n, 8 * n), np.frombuffer(rest, "<i4", n, 16 * n)
    return s


def _sent(parts, buckets):
    s, later = later_leaves(np.concatenate(parts))
    rows = []
    for kind, some, by in ((SUFFIXES, s[~later], "prefix"), (LATER, s[later], "h")):
        bucket = (mixed(some[by].view(U64)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows += [(b, kind, int(cut[b + 1] - cut[b]), _blob(some[order[cut[b]:cut[b + 1]]])) for b in np.flatnonzero(np.diff(cut)).tolist()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "n", "blob"])


def _suffixes(batches, size, frequent, bits, buckets, flush=200_000):
    """Suffixes of the segments named in each document's spans, with their prefixes.

    A prefix goes on until a word that is not frequent, and no further than ``size`` words.
    """
    parts, held = [], 0
    for batch in batches:
        marked = [i for i, x in enumerate(batch.column("spans")) if x.is_valid]
        if not marked:
            continue
        rows = batch.take(pa.array(marked))
        ids, hashes = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h"))
        for piece in slices(rows.column("text")):
            w = words(piece, SPACES)
            rare = np.flatnonzero(~frequent[(w.hash >> U64(64 - bits)).astype(np.int64)])
            sums = prefix_sums(w.hash)
            for d in range(len(piece)):
                spans = span_arrays(rows.column("spans")[piece.first + d].as_py(), 2)
                start = np.concatenate([np.arange(a, a + n) for a, n in spans.tolist()])
                at = w.first[d] + start
                follow = np.searchsorted(rare, at)
                stop = np.where(follow < len(rare), rare[np.minimum(follow, len(rare) - 1)] if len(rare) else 0, len(w)) + 1
                s = np.empty(len(at), SUFFIX)
                s["id"], s["h"], s["start"] = ids[piece.first + d], hashes[piece.first + d], start
                s["prefix"] = span_hash(sums, at, np.minimum(stop, at + size))
                s["path"] = span_hash(sums, at, at + size)
                parts.append(s)
                held += len(s)
        if held >= flush:
            yield _sent(parts, buckets)
            parts, held = [], 0
    if parts:
        yield _sent(parts, buckets)


def _windows_batch(s: np.ndarray) -> pa.RecordBatch:
    """Single windows as maximal runs (id, h, start, n)."""
    s = np.sort(s, order=["id", "h", "start"])
    new = np.r_[True, (s["id"][1:] != s["id"][:-1]) | (s["h"][1:] != s["h"][:-1]) | (np.diff(s["start"]) > 1)]
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(s)] - 1
    n = s["start"][last] - s["start"][begin] + 1
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(s[c][begin])) for c in ("id", "h", "start")] + [pa.array(n.astype(np.int32))], names=["id", "h", "start", "n"])


def _subtrees(batches):
    for _, rows in by_bucket(batches, 3):
        for kind, n, blob in rows:
            if kind == LATER:
                yield _windows_batch(_unblob(blob, n))
        some = [_unblob(blob, n) for kind, n, blob in rows if kind == SUFFIXES]
        if some:
            s, later = later_leaves(np.concatenate(some))
            if later.any():
                yield _windows_batch(s[later])


def _kept(batches, size):
    for batch in batches:
        cols = [[] for _ in range(5)]
        for doc_id, text, spans in zip(batch.column("doc_id"), batch.column("text"), batch.column("spans")):
            found = text.as_py().encode().split()
            n, removed = len(found), 0
            if spans.is_valid:
                gone = covered(span_arrays(spans.as_py(), 2), size, n)
                removed = int(gone.sum())
                found = [found[i] for i in np.flatnonzero(~gone).tolist()]
            kept = b" ".join(found)
            for c, v in zip(cols, (doc_id.as_py(), n, removed, hashlib.sha256(kept).hexdigest(), kept.decode())):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        yield out.append_column("rest", batch.column("rest")) if "rest" in batch.schema.names else out


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, gram: int = 5, capacity: int = 1_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (words joined by a space) of every document.

    Every word under a window of ``size`` words that also starts earlier (in a smaller id, or before in its document)
    is removed; windows are judged on the input.

    1. ``repeated_runs`` narrows the corpus to runs of windows whose minimiser is met twice.  Runs of equal words are
       one segment; all but its earliest copy are removed at once.
    2. The suffixes of the earliest copies are split by prefixes of variable length: a prefix ends at its first word
       that is not frequent, so no group has more than ``capacity`` suffixes unless its prefix is the whole window.
    3. Each group's suffix tree, cut at the window's length, is built as its sorted leaves; the deep internal nodes
       are the repeats, and all leaves but a node's earliest are removed.  A task first keeps one leaf a node of its
       own, so a passage that is everywhere sends one leaf a task.

    Null texts have no words.  Null ids count as 0 in the order and stay null in the result; equal ids are ordered by
    their texts' hashes.  Rows that repeat id and text wholly are one document: all get its result.  No rows give no
    rows.  Columns named in ``keep`` come back as the struct ``rest``.
    """
    spark = docs.sparkSession
    named = keyed(docs, id_col, text_col, keep)
    runs = repeated_runs(named, word_units, size, gram)
    place = F.struct("id", "h", "start", "n")
    segments = stored(runs.groupBy("key", "seg").agg(F.min(place).alias("one"), F.count(F.lit(1)).alias("times")), "segments")
    copies = runs.join(segments.where("times > 1"), ["key", "seg"]).where(place != F.col("one")).select("id", "h", "start", "n")

    frequent, bits = frequent_slots(named, capacity)
    bulk = segments.agg(F.sum("one.n")).first()[0] or 0
    buckets = parts_for(bulk * SUFFIX.itemsize, 12 << 20, spark)
    sent = beside(named, lists_of(segments.select("one.*"), "start", "n")).mapInArrow(
        tidied(lambda b: _suffixes(b, size, frequent, bits, buckets)), "bucket int, kind int, n int, blob binary")
    later = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_subtrees), "id long, h long, start int, n int")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    if keep:
        schema += f", rest {named.schema['rest'].dataType.simpleString()}"
    return beside(named, lists_of(copies.unionByName(later), "start", "n")).mapInArrow(tidied(lambda b: _kept(b, size)), schema)
