"""Packing documents into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tables import small_batches, tidied

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
END_ID = 0

# Character classes of the byte-level BPE's word pattern for texts within Latin-1 (fixed values).
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼½¾"
SPACE = " \t\n\x0b\x0c\r\x85\xa0"
PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
SPECIAL = "<|endoftext|>"


class Pieces(dict):
    """Token ids, as little-endian 32-bit bytes, of the pieces met so far; emptied when it holds ``most``."""

    def __init__(self, encode, most: int = 150_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[piece] = out = np.array(self.encode(piece), "<u4").tobytes()
        return out


class Encoder:
    """Ids of whole texts, equal to those of ``tokenizers`` without special tokens added.

    Texts within Latin-1 are split by one pattern and their pieces looked up; rarer ones, and texts that hold
    a special token's string, go to ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, rank_path: str):
        import tiktoken

        self.json_path, self._full = json_path, None
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        merges = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.pieces = Pieces(merges.encode_ordinary)

    @property
    def full(self):
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.json_path)
        return self._full

    def release(self) -> None:
        """Frees what a task has gathered; the worker lives on."""
        self.pieces.clear()
        self._full = None

    def ids(self, text: str) -> bytes:
        if SPECIAL in text or (not text.isascii() and max(text) > "ÿ"):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(json_name: str, rank_name: str) -> Encoder:
    """One encoder per Python worker; files are found through the installed package."""
    import public_tokenizers

    key = (json_name, rank_name)
    if key not in _encoders:
        _encoders[key] = Encoder(public_tokenizers.path(json_name), public_tokenizers.path(rank_name))
    return _encoders[key]


def differencing(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (0..m-1) of the items and the windows' sums by the largest differencing method.

    A partial partition is a row of m sums.  The two with the widest spread are merged, the largest sums of one
    with the smallest of the other, until one is left.  Equal spreads: the earlier made one first.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(m, np.int64), np.full(m, -1)
        sums[0], nodes[0] = size, i
        heap.append((-size if m > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        sums, b_nodes = a + b[::-1], bn[::-1]
        nodes = np.where(an >= 0, an, b_nodes)
        for i in np.flatnonzero((an >= 0) & (b_nodes >= 0)).tolist():
            left.append(int(an[i]))
            right.append(int(b_nodes[i]))
            nodes[i] = len(left) - 1
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made, sums, nodes))
        made += 1
    window = np.full(n, -1)
    _, _, sums, nodes = heap[0]
    for w, node in enumerate(nodes.tolist()):
        todo = [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                window[x] = w
            else:
                todo += (left[x], right[x])
    return window, sums


def windows_for(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A window for each item (all sizes <= capacity); the count rises until none holds more than the capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = differencing(sizes, m)
        if not len(sums) or sums.max() <= capacity:
            return window, m
        m += max(1, m // 200)


def cut(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the tail in pieces of at most ``grain``."""
    full = n // capacity * capacity
    return [(i, capacity) for i in range(0, full, capacity)] + [(i, min(grain, n - i)) for i in range(full, n, grain)]


def _pack(batches, json_name, rank_name, capacity, grain, group):
    enc = encoder(json_name, rank_name)
    sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    held: list[tuple] = []
    tail = 0

    def solved(rows):
        """Rows of a group with sequence and offset."""
        nonlocal sequence
        size = np.array([r[2] for r in rows], np.int64)
        whole = size == capacity
        window = np.zeros(len(rows), np.int64)
        used = 0
        if (~whole).any():
            window[~whole], used = windows_for(size[~whole], capacity)
        window[whole] = used + np.arange(int(whole.sum()))
        order = np.lexsort((np.arange(len(rows)), window))
        ends = np.cumsum(size[order])
        new = np.r_[True, np.diff(window[order]) != 0]
        before = (ends - size[order])[np.flatnonzero(new)]
        offset = np.empty(len(rows), np.int64)
        offset[order] = ends - size[order] - np.repeat(before, np.diff(np.r_[np.flatnonzero(new), len(rows)]))
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        columns += [pa.array(window + sequence), pa.array(offset)]
        sequence += int(window.max()) + 1
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids = enc.ids(text.as_py() or "") + END_ID.to_bytes(4, "little")
            n = len(ids) // 4
            for start, length in cut(n, capacity, grain):
                held.append((doc_id.as_py(), start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), n))
                tail += length if length < capacity else 0
            # two groups' worth is kept back so that the last group is not a small one
            if tail >= 2 * group or len(held) >= 40_000:
                seen = 0
                for k, row in enumerate(held):
                    seen += row[2] if row[2] < capacity else 0
                    if seen >= group:
                        break
                yield solved(held[:k + 1])
                held = held[k + 1:]
                tail -= seen
    if held:
        yield solved(held)
    enc.release()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, grain: int = 256, group: int = 150_000,
         tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` token ids.

    A document is its ids followed by id 0.  Full windows are cut from its front; the tail is cut into pieces
    of at most ``grain`` ids.  Tails of about ``group`` ids are divided over as few windows as hold them, by
    differencing.  Everything happens in the task that reads the documents: nothing is shuffled, and a task keeps
    two groups of piece descriptions at most.  Sequence ids are unique: the partition, then a running number.

    Null and empty texts are the one id 0.  Null ids, repeated rows and repeated ids are packed row by row as
    they come.  No rows give no rows.  Other columns are not read.
    """
    narrow = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(tidied(lambda batches: _pack(batches, tokenizer, ranks, capacity, grain, group)), SCHEMA)
