"""Exact substring removal with suffix arrays built by two-stage sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.repeats import beside, byte_units, covered, keyed, lists_of, repeated_runs, sliding_min, span_arrays
from driftmark.llm.tables import sieve, sifted, stored, tidied
from driftmark.llm.words import BYTE_VALUE, U64, mixed, prefix_sums, span_hash


class Text:
    """Bytes whose suffixes are compared to ``depth`` bytes."""

    def __init__(self, raw: np.ndarray, depth: int):
        self.n, self.depth = len(raw), depth
        self.raw = raw
        padded = np.zeros(len(raw) + depth + 16, np.uint8)
        padded[:len(raw)] = raw
        self.padded = padded
        self.eight = np.ndarray((len(raw) + depth + 8,), ">u8", padded, strides=(1,))  # eight bytes from each place
        self.sums = prefix_sums(BYTE_VALUE[padded])

    def smaller_than_next(self) -> np.ndarray:
        """Mask of the suffixes that are smaller than their successor; the last one is larger than the empty one."""
        step = np.sign(np.diff(self.raw.astype(np.int16)))
        step = np.r_[step, -1]
        place = np.where(step != 0, np.arange(self.n), self.n - 1)
        return step[np.minimum.accumulate(place[::-1])[::-1]] > 0

    def sorted_directly(self, at: np.ndarray) -> np.ndarray:
        """Positions ``at`` in the order of their suffixes, to ``depth`` bytes.

        Suffixes that begin with the same ``depth`` bytes are sorted as one; the others eight bytes at a time, each
        round within the ties that are left.
        """
        if not len(at):  # as in a text whose letters only fall
            return at
        same = span_hash(self.sums, at, at + self.depth)
        _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
        pos = at[first]
        group = np.zeros(len(pos), np.int64)
        active = np.arange(len(pos))
        order = np.arange(len(pos))  # order[i]: which representative stands at i; ties occupy consecutive places
        for depth in range(0, self.depth, 8):
            who = order[active]
            key = self.eight[pos[who] + depth].astype(U64)
            by = np.argsort(key, kind="stable")
            by = by[np.argsort(group[active][by], kind="stable")]
            order[active] = who[by]
            key, held = key[by], group[active]
            new = np.r_[True, (key[1:] != key[:-1]) | (held[1:] != held[:-1])]
            begin = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
            group[active] = begin
            alone = new & np.r_[new[1:], True]
            active = active[~alone]
            if not len(active):
                break
        place = np.empty(len(pos), np.int64)
        place[order] = np.arange(len(pos))
        return at[np.argsort(place[inverse], kind="stable")]

    def suffixes(self, wanted: np.ndarray) -> np.ndarray:
        """Suffix array of the positions in ``wanted`` (mask), to ``depth`` bytes.

        Stage one sorts the suffixes smaller than their successor.  Stage two scans the buckets of first bytes upwards:
        a placed suffix puts the one before it, if that is larger than its successor, at the end of the larger part of
        its own bucket, which comes before the sorted part.
        """
        small = self.smaller_than_next()
        # the larger ones are induced along their successors, up to the next smaller one
        need = wanted.copy()
        run = np.flatnonzero(wanted & ~small)
        while len(run):
            run = run + 1
            run = run[run < self.n]
            run = run[~need[run]]
            need[run] = True
            run = run[~small[run]]
        direct = self.sorted_directly(np.flatnonzero(need & small))
        ends = np.searchsorted(self.raw[direct], np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        if self.n and need[self.n - 1]:
            waiting[self.raw[-1]].append(np.array([self.n - 1]))
        out = []
        for c in range(256):
            larger = waiting[c]
            i = 0
            while i < len(larger):
                before = larger[i] - 1
                before = before[(before >= 0)]
                before = before[(self.raw[before] == c) & need[before]]
                if len(before):
                    larger.append(before)
                i += 1
            bucket = np.concatenate([*larger, direct[ends[c]:ends[c + 1]]]) if larger or ends[c] < ends[c + 1] else direct[:0]
            out.append(bucket)
            before = bucket - 1
            before = before[before >= 0]
            before = before[(self.raw[before] > c) & need[before]]
            if len(before):
                first = self.raw[before]
                by = np.argsort(first, kind="stable")
                before, first = before[by], first[by]
                cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
                for a, b in zip(cut, np.r_[cut[1:], len(before)]):
                    waiting[first[a]].append(before[a:b])
        array = np.concatenate(out)
        return array[wanted[array]]

    def common(self, array: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix of the array with the one before it, up to ``depth`` (0 for the first)."""
        lcp = np.zeros(len(array), np.int64)
        pair = np.arange(1, len(array))
        for depth in range(0, self.depth, 8):
            a, b = self.eight[array[pair - 1] + depth].astype(U64), self.eight[array[pair] + depth].astype(U64)
            differ = a ^ b
            equal = differ == 0
            part = differ[~equal]
            # bytes in common: leading zero bits over eight
            lead = np.zeros(len(part), np.int64)
            for k in range(1, 8):
                lead += (part >> U64(64 - 8 * k)) == 0
            lcp[pair[~equal]] = depth + lead
            pair = pair[equal]
            if not len(pair):
                break
        lcp[pair] = self.depth
        return np.minimum(lcp, self.depth)


def repeats_within(segments: list[bytes], counts: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first ``counts[i]`` positions of each segment: class number (equal ``size`` bytes), and segment and offset."""
    length = np.array([len(s) for s in segments])
    begin = np.cumsum(length) - length
    text = Text(np.frombuffer(b"".join(segments), np.uint8), size)
    count = np.array(counts)
    segment = np.repeat(np.arange(len(count)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    wanted = np.zeros(text.n, bool)
    wanted[begin[segment] + offset] = True
    array = text.suffixes(wanted)
    number = np.cumsum(text.common(array) < size)
    of = np.empty(text.n, np.int64)
    of[array] = number
    return of[begin[segment] + offset], segment, offset


def _segments(batches, size):
    """Bytes of the first occurrence of each segment."""
    for batch in batches:
        cols = [[] for _ in range(8)]
        texts = batch.column("text")
        for i, spans in enumerate(batch.column("spans")):
            spans = spans.as_py()
            if not spans:
                continue
            raw = texts[i].as_py().encode()
            for s in spans:
                row = (s["key"], s["part"], s["parts"], s["times"], batch.column("id")[i].as_py(), batch.column("h")[i].as_py(), s["start"], raw[s["start"]:s["start"] + s["n"] + size - 1])
                for c, v in zip(cols, row):
                    c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "part", "parts", "times", "id", "h", "start", "raw"])


def _finer(batches, size, gram, more=4):
    """Runs of crowded minimisers cut by ``more`` further minimisers of each window, of other hashes, and keyed by all."""
    for batch in batches:
        out = []
        for i, h, text, spans in zip(*[batch.column(c).to_pylist() for c in ("id", "h", "text", "spans")]):
            raw = np.frombuffer(text.encode(), np.uint8)
            for s in spans:
                values = BYTE_VALUE[raw[s["start"]:s["start"] + s["n"] + size - 1]]
                sums = prefix_sums(values)
                at = np.arange(len(values) - gram + 1)
                hashes = span_hash(sums, at, at + gram)
                keys = np.full(s["n"], np.int64(s["key"]).view(U64))
                for r in range(1, more + 1):
                    keys = mixed(keys ^ sliding_min(mixed(hashes ^ U64(r * 0x8CB92BA72F3D8DD7 % 2**64)), size - gram + 1))
                begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                n = np.diff(np.r_[begin, len(keys)])
                keys = keys[begin].view(np.int64)
                segs = span_hash(sums, begin, begin + n + size - 1).view(np.int64)
                out += [(k, g, i, h, s["start"] + b, m, s["times"]) for k, g, b, m in zip(keys.tolist(), segs.tolist(), begin.tolist(), n.tolist())]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        names = ["key", "seg", "id", "h", "start", "n", "times"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)


def _spans_of(rows, segment, offset):
    """(id, h, start, n, window) for ascending (segment, offset): maximal runs of offsets."""
    if not len(segment):
        return []
    new = np.r_[True, (np.diff(segment) != 0) | (np.diff(offset) != 1)]
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, len(segment)])
    return [(rows[s][4], rows[s][5], rows[s][6] + int(o), int(k)) for s, o, k in zip(segment[begin].tolist(), offset[begin], n)]


def _sorted_blocks(batches, size, most):
    """Windows that occur twice in a block of segments, and, for keys cut into several blocks, what others must know.

    Rows come with the segments of a key (or of its part) together; many keys make one block.
    """
    out = {"id": pa.int64(), "h": pa.int64(), "start": pa.int32(), "n": pa.int32(), "window": pa.int64(), "open": pa.bool_()}

    def solved(rows):
        counts = [len(r[7]) - size + 1 for r in rows]
        number, segment, offset = repeats_within([r[7] for r in rows], counts, size)
        often = np.bincount(number)[number] > 1
        single = np.array([r[3] == 1 for r in rows])[segment]  # a segment met again elsewhere is removed as a whole
        done = _spans_of(rows, segment[often & single], offset[often & single])
        found = [(*x, None, False) for x in done]
        split = np.array([r[2] > 1 for r in rows])[segment]
        if split.any():
            text = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
            sums = prefix_sums(BYTE_VALUE[text])
            begin = np.cumsum([0] + [len(r[7]) for r in rows])[:-1]
            _, first = np.unique(number, return_index=True)
            for i in first[split[first]].tolist():
                r, o = rows[segment[i]], int(offset[i])
                p = begin[segment[i]] + o
                h = int(span_hash(sums, np.array([p]), np.array([p + size])).view(np.int64)[0])
                found.append((r[4], r[5], r[6] + o, 1, h, bool(not often[i] and r[3] == 1)))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(out.values())], names=list(out))

    held, bulk, group = [], 0, None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if bulk >= most and row[:2] != group:
                yield solved(held)
                held, bulk = [], 0
            group = row[:2]
            held.append(row)
            bulk += len(row[7])
    if held:
        yield solved(held)


def _removed(batches, size):
    for batch in batches:
        cols = [[] for _ in range(6)]
        for doc_id, text, spans in zip(batch.column("doc_id"), batch.column("text"), batch.column("spans")):
            raw = text.as_py().encode()
            gone = covered(span_arrays(spans.as_py(), 2), size, len(raw))
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = raw if not len(edges) else np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for c, v in zip(cols, (doc_id.as_py(), len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept)):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, gram: int = 48, block: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every document.

    Every byte under a ``size``-byte string that also starts anywhere else, in this document or another, is removed.

    1. ``repeated_runs`` narrows the corpus to runs of windows whose minimiser is met twice.
    2. Runs with equal bytes are one segment.  Met twice, all its windows are repeated, wherever it stands.
    3. The segments of a minimiser with more of them than a block holds are cut once more, by four further minimisers of
       each window, into finer runs: equal windows agree in all.  Finer runs with equal bytes are again one segment.
    4. One copy of each segment goes to its minimiser's block.  A block of about ``block`` bytes gets a suffix array by
       two-stage sorting; neighbours in it with a common prefix of ``size`` bytes are repeats.  What is crowded even
       then is cut into parts; what is unique within a part is then matched between parts by a hash of the window.
    5. The windows found meet their documents again, and the rest of the bytes is kept.

    Null texts are empty.  Documents shorter than ``size`` lose nothing.  Rows that repeat an id are separate documents,
    so a row that repeats another wholly is removed like any copy.  Null ids stay null.  No rows give no rows.
    """
    named = keyed(docs, id_col, text_col)
    runs = repeated_runs(named, byte_units, size, gram)
    segments = runs.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "h", "start", "n")).alias("one"))
    segments = stored(segments, "segments")
    def parted(some: DataFrame) -> DataFrame:
        bulk = some.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("one.n") + size - 1) / block)).cast("int").alias("parts"))
        return some.join(bulk, "key")

    dealt = parted(segments)
    crowded = dealt.where("parts > 1").select("one.*", "key", "times")
    likely = sifted(named, "h", sieve(crowded, "h")).where("let_through").select(*named.columns)
    finer = likely.join(lists_of(crowded, "key", "times", "start", "n"), ["id", "h"]).select("id", "h", "text", "spans").mapInArrow(
        tidied(lambda b: _finer(b, size, gram)), "key long, seg long, id long, h long, start int, n int, times long")
    finer = stored(finer, "finer-runs")
    again = finer.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("met"), F.max("times").alias("times"), F.min(F.struct("id", "h", "start", "n")).alias("one"))
    copies_within = finer.join(again.where("met > 1").select("key", "seg"), ["key", "seg"], "left_semi").select("id", "h", "start", "n")
    once = parted(again.select("key", "seg", F.greatest("met", "times").alias("times"), "one"))
    sorted_in = dealt.where("parts = 1").unionByName(once).select("one.*", "key", "times", "parts", F.pmod(F.xxhash64("seg"), F.col("parts")).cast("int").alias("part"))
    raw = beside(named, lists_of(sorted_in, "key", "part", "parts", "times", "start", "n")).mapInArrow(
        lambda b: _segments(b, size), "key long, part int, parts int, times long, id long, h long, start int, raw binary")
    blocks = raw.repartition("key", "part").sortWithinPartitions("key", "part")
    found = blocks.mapInArrow(tidied(lambda b: _sorted_blocks(b, size, block)), "id long, h long, start int, n int, window long, open boolean")
    found = stored(found, "repeats")
    between = found.where("window is not null")
    shared = between.groupBy("window").agg(F.count(F.lit(1)).alias("parts_with")).where("parts_with > 1")
    late = between.where("open").join(shared, "window").select("id", "h", "start", "n")
    copies = runs.join(segments.where("times > 1").select("key", "seg"), ["key", "seg"], "left_semi").select("id", "h", "start", "n")
    gone = found.where("window is null").select("id", "h", "start", "n").unionByName(late).unionByName(copies).unionByName(copies_within)
    return beside(named, lists_of(gone, "start", "n")).mapInArrow(
        lambda b: _removed(b, size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
