"""Benchmark decontamination with a positional inverted index over the documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tables import small_batches
from driftmark.llm.words import NOT_ALNUM, U64, Words, slices, windows, words

SCHEMA = "n_words long, spans binary, items binary, near binary"


def _item_windows(batches, size):
    """Word sequences to search for: ``size`` consecutive words of an item, or all of a shorter one."""
    for batch in batches:
        row, terms = [], []
        for piece in slices(batch.column(1)):
            w = words(piece, NOT_ALNUM, lower=True)
            at, _ = windows(w, size)
            row += (w.doc[at] + piece.first).tolist()
            terms += [w.hash[i:i + size].tobytes() for i in at.tolist()]
            count = np.diff(w.first)
            for d in np.flatnonzero((count > 0) & (count < size)).tolist():
                row.append(d + piece.first)
                terms.append(w.hash[w.first[d]:w.first[d + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(terms, pa.binary())], names=["item_id", "terms"])


class Postings:
    """Positional inverted index of a slice: the positions of each term, in order."""

    def __init__(self, w: Words):
        self.doc, self.n = w.doc, len(w)
        self.position = np.argsort(w.hash, kind="stable")
        ordered = w.hash[self.position]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if self.n else np.zeros(0, bool)
        self.begin = np.flatnonzero(new)
        self.term = ordered[self.begin]
        self.count = np.diff(np.r_[self.begin, self.n])
        # (term, position) pairs as one sorted array, to look up many of them at once
        self.key = np.repeat(np.arange(len(self.term)), self.count) * (self.n + 1) + self.position

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Index of each term, -1 where it does not occur."""
        if not self.n:
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.term, terms), len(self.term) - 1)
        return np.where(self.term[at] == terms, at, -1)

    def holds(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = rank * (self.n + 1) + position
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[at] == key) & (position >= 0) & (position < self.n)

    def nearest(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Distance to the closest position of the term."""
        at = np.searchsorted(self.key, rank * (self.n + 1) + position)
        best = np.full(len(rank), self.n + 1)
        for i in (at - 1, at):
            j = np.clip(i, self.begin[rank], self.begin[rank] + self.count[rank] - 1)
            best = np.minimum(best, np.abs(self.position[j] - position))
        return best


def _search(index: Postings, terms: np.ndarray, slop: int):
    """(window, start) of phrase matches and (window, document) of proximity matches of equally long windows."""
    size = terms.shape[1]
    rank = index.ranks(terms)
    some = np.flatnonzero((rank >= 0).all(axis=1))
    empty = np.zeros(0, np.int64)
    if not len(some):
        return empty, empty, empty, empty
    rank = rank[some]
    order = np.argsort(index.count[rank], axis=1, kind="stable")  # the rarest term first
    rows = np.arange(len(some))
    lead = rank[rows, order[:, 0]]
    count = index.count[lead]
    row = np.repeat(rows, count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    anchor = index.position[index.begin[lead][row] + within]
    near_row, near_at = row, anchor
    start = anchor - order[row, 0]
    inside = (start >= 0) & (start + size <= index.n)
    row, start = row[inside], start[inside]
    whole = index.doc[start] == index.doc[start + size - 1]
    row, start = row[whole], start[whole]
    for k in range(1, size):
        at = order[row, k]
        fits = index.holds(rank[row, at], start + at)
        row, start = row[fits], start[fits]
    if slop >= 0:
        for k in range(1, size):
            fits = index.nearest(rank[near_row, order[near_row, k]], near_at) <= size - 1 + slop
            near_row, near_at = near_row[fits], near_at[fits]
    return some[row], start, some[near_row], index.doc[near_at]


def _blob(per_doc: dict[int, set], d: int) -> bytes:
    return np.array(sorted(per_doc.get(d, ())), "<i8").tobytes()


def _matches(batches, groups, slop):
    """Per document: its words, the spans hit (start, end pairs, merged) and the items found (their numbers)."""
    for batch in batches:
        n_words, spans, items, near = [], [], [], []
        for piece in slices(batch.column(1)):
            w = words(piece, NOT_ALNUM, lower=True)
            index = Postings(w)
            edge = np.zeros(len(w) + 1, np.int64)
            found: dict[int, set] = {}
            close: dict[int, set] = {}
            for size, terms, item in groups:
                window, start, near_window, near_doc = _search(index, terms, slop)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                for d, i in zip(w.doc[start].tolist(), item[window].tolist()):
                    found.setdefault(d, set()).add(i)
                for d, i in set(zip(near_doc.tolist(), item[near_window].tolist())):
                    close.setdefault(d, set()).add(i)
            hit = np.cumsum(edge[:-1]) > 0
            for d in range(len(piece)):
                a, b = w.first[d], w.first[d + 1]
                n_words.append(int(b - a))
                if d in found:
                    inside = np.r_[False, hit[a:b], False]
                    spans.append(np.flatnonzero(inside[1:] != inside[:-1]).astype("<i8").tobytes())
                else:
                    spans.append(b"")
                items.append(_blob(found, d))
                near.append(_blob(close, d))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), *[pa.array(x, pa.binary()) for x in (spans, items, near)]], names=["doc_id", "n_words", "spans", "items", "near"])


def _digest(batches, names):
    """The spans and items of all blocks of a document made one; names: item id by number."""
    for batch in batches:
        cols = {k: [] for k in ("doc_id", "n_words", "n_hit", "spans", "n_items", "items", "n_near", "items_sha256")}
        for row in batch.to_pylist():
            # rows that repeat a document wholly arrive once for each copy and block
            for _ in range(row["copies"]):
                edges = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in row["spans"]]
                line = np.zeros(row["n_words"] + 1, np.int64)
                for e in edges:
                    line[e[:, 0]] += 1
                    line[e[:, 1]] -= 1
                inside = np.r_[False, np.cumsum(line[:-1]) > 0, False]
                items = sorted({names[i] for x in row["items"] for i in np.frombuffer(x, "<i8").tolist()})
                near = {names[i] for x in row["near"] for i in np.frombuffer(x, "<i8").tolist()}
                cols["doc_id"].append(row["doc_id"])
                cols["n_words"].append(row["n_words"])
                cols["n_hit"].append(int(inside.sum()))
                cols["spans"].append(np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).tolist())
                cols["n_items"].append(len(items))
                cols["items"].append(items)
                cols["n_near"].append(len(near))
                cols["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
        kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(cols))


def _grouped(rows) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Windows by their length: (length, terms, number of the item)."""
    by: dict[int, tuple[list, list]] = {}
    for number, terms in rows:
        seq = np.frombuffer(terms, U64)
        held = by.setdefault(len(seq), ([], []))
        held[0].append(seq)
        held[1].append(number)
    return [(size, np.stack(t), np.array(i)) for size, (t, i) in sorted(by.items())]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  size: int = 10, slop: int = 5, block: int = 100_000) -> DataFrame:
    """For every document: n_words, n_hit, spans (hit word ranges), n_items, items, n_near, items_sha256.

    Each task indexes its documents a slice at a time (term -> positions) and answers all windows of the test items
    from that index: the rarest term's positions, shifted by its offset, are intersected with the shifted lists of
    the next rarest terms.  A phrase match hits its words; ``n_near`` counts the items with a window whose terms all
    stand within ``size - 1 + slop`` words of its rarest term.  Postings never leave their task, so nothing is
    shuffled, and a lost task is simply run again.

    The query set travels in blocks of about ``block`` windows (80 bytes each), one scan of the documents a block;
    with more than one, results meet per document.  Words: A-Z lower-cased, runs of letters, digits and bytes above
    0x7F.  Null and empty texts have no words and are not hit; items without words match nothing; items with equal
    ids are one item; null item ids are left out; rows that repeat are judged one by one.
    Other columns are ignored, whatever their names.  No documents give no rows; without items nothing is hit.
    """
    spark = docs.sparkSession
    sought = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked = sought.mapInArrow(lambda b: _item_windows(b, size), "item_id string, terms binary").distinct()
    blocks = max(1, -(-asked.count() // block))
    narrow = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    parts, names = [], []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        own = sorted({r.item_id for r in rows})
        number = {name: len(names) + i for i, name in enumerate(own)}
        names += own
        groups = spark.sparkContext.broadcast(_grouped((number[r.item_id], bytes(r.terms)) for r in rows))
        parts.append(narrow.mapInArrow(lambda x, g=groups: _matches(x, g.value, slop), f"doc_id {kind}, {SCHEMA}") if blocks == 1 else
                     narrow.withColumn("fp", F.sha2(F.col("text"), 256)).transform(lambda d, g=groups: _with_print(d, g, slop, kind)))
    if blocks == 1:
        found = parts[0].select("doc_id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"), F.array("near").alias("near"), F.lit(1).alias("copies"))
    else:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        found = every.groupBy("doc_id", "fp", "n_words").agg(*[F.collect_list(c).alias(c) for c in ("spans", "items", "near")], (F.count(F.lit(1)) / blocks).cast("int").alias("copies")).drop("fp")
    listed = spark.sparkContext.broadcast(names)
    return found.mapInArrow(lambda b: _digest(b, listed.value), f"doc_id {kind}, n_words long, n_hit long, spans array<array<bigint>>, n_items long, items array<string>, n_near long, items_sha256 string")


def _with_print(docs: DataFrame, groups, slop: int, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for out in _matches([batch], groups.value, slop):
                yield out.append_column("fp", batch.column(2))

    return docs.mapInArrow(run, f"doc_id {kind}, {SCHEMA}, fp string")
