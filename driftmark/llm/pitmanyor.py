"""Hierarchical Pitman-Yor language model: seating sampled by Gibbs sweeps over buckets of words."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.repeats import by_bucket
from driftmark.llm.tables import parts_for, small_batches, stored
from driftmark.llm.words import SPACES, U64, mixed, slices, words

END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
FLUSH = 2_000_000
COUNTS, SHARED, TEXTS = 0, 1, 2
TABLE, ASK, SUMS, ANSWER = 0, 1, 2, 3


@dataclass
class Tokens:
    """Tokens of many documents: word, context restaurant (the token before, or a hash of it) and document."""

    word: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray


def restaurants(before: np.ndarray, bits: int | None) -> np.ndarray:
    """The context restaurant of each token before: its own, or one of 2**``bits``."""
    return before if bits is None else mixed(before) >> U64(64 - bits)


def tokens(piece, bits: int | None) -> Tokens:
    w = words(piece, SPACES, lower=True)
    count = np.diff(w.first) + 1
    doc = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count) - 1
    word = np.empty(len(doc), U64)
    word[ends] = END
    inner = np.ones(len(doc), bool)
    inner[ends] = False
    word[inner] = w.hash
    before = np.empty(len(doc), U64)
    before[1:] = word[:-1]
    before[ends - count + 1] = BEGIN
    return Tokens(word, restaurants(before, bits), doc, count)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each led by its type and length and compressed, all first bytes of its numbers first."""
    out = []
    for a in arrays:
        body = zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes(), 1)
        out.append(struct.pack("<2sII", a.dtype.str[1:].encode(), len(a), len(body)) + body)
    return b"".join(out)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(blob):
        kind, n, size = struct.unpack_from("<2sII", blob, at)
        at += struct.calcsize("<2sII")
        width = int(kind[1:])
        raw = np.frombuffer(zstandard.decompress(blob[at:at + size], max_output_size=max(1, n * width)), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view("<" + kind.decode()))
        at += size
    return out


def _rows(rows, names=("bucket", "kind", "chunk", "blob")) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "chunk": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names=list(names))


SCHEMA = "bucket int, kind int, chunk long, blob binary"


def _pairs(word, context, weight):
    """Distinct (word, context) in their order, with the sum of their weights."""
    order = np.lexsort((context, word))
    word, context, weight = word[order], context[order], weight[order]
    new = np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])] if len(word) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return word[begin], context[begin], np.add.reduceat(weight, begin) if len(begin) else weight


def _whole(parts: list[Tokens], ids, valid, held_out, chunk: int):
    """One row with all tokens of some documents, as places in their vocabulary, frequent words first."""
    vocabulary, place, count = np.unique(np.concatenate([p.word for p in parts]), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    per_doc = np.concatenate([p.per_doc for p in parts])
    return _rows([(0, COUNTS, chunk, _packed(vocabulary[order], rank[place], ids, valid.astype(np.uint8), held_out.astype(np.uint8), per_doc.astype(np.int64)))])


def _rises(ordered: np.ndarray) -> np.ndarray:
    """Ascending numbers as steps, which are shorter."""
    return np.diff(ordered, prepend=U64(0))


def _met(own: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each number asked for in the ascending ``own``, and whether it is there."""
    if not len(own):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
    return at, own[at] == asked


def _known(vocabulary: np.ndarray, bits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted restaurants that the tokens of a chunk and the beginning lead to, and each one's place (the beginning's last)."""
    return np.unique(restaurants(np.append(vocabulary, BEGIN), bits), return_inverse=True)


def _divided(keys: np.ndarray, bits: int | None, parts: int):
    """(part, slice) of sorted restaurants: parts are equal ranges, so their order is that of the keys."""
    whole = 1 << (64 if bits is None else bits)
    edge = np.searchsorted(keys, np.array([-(-i * whole // parts) for i in range(parts)], U64))
    return [(p, slice(a, b)) for p, (a, b) in enumerate(zip(edge.tolist(), [*edge[1:].tolist(), len(keys)])) if b > a]


def _questions(batches, bits, parts):
    """Which restaurants each chunk has to know, for each part."""
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
            keys, _ = _known(_unpacked(blob.as_py())[0], bits)
            yield _rows([(p, ASK, chunk, _packed(_rises(keys[x]))) for p, x in _divided(keys, bits, parts)])


def _replies(batches, samples):
    """Customers, and tables of each sample, of the restaurants asked for; nobody sits in those never seen."""
    part, table, keys = None, {}, None
    for batch in batches:
        for b, kind, chunk, blob in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if b != part:
                part, table, keys = b, {}, np.zeros(0, U64)
            if kind == TABLE:
                keys, *table[chunk] = _unpacked(blob)
                continue
            at, hit = _met(keys, np.cumsum(*_unpacked(blob), dtype=U64))
            columns = [table[0][1], *[table[k][0] for k in samples]] if len(keys) else [np.zeros(1, np.int64)] * (1 + len(samples))
            yield _rows([(b, SHARED, chunk, _packed(*[np.where(hit, x[at], 0) for x in columns]))])


@dataclass
class Chunk:
    """The tokens of some documents: distinct (word, context) pairs and words, and what each bucket is asked of them.

    Of each pair: its hash, word (place in the vocabulary) and restaurant (place among the chunk's own); ``pair``: that
    of each token.  ``pairs_by`` and ``words_by``: the pairs and words bucket after bucket, by ascending hash within
    one; a bucket's are between its two cuts.
    """

    key: np.ndarray
    word: np.ndarray
    restaurant: np.ndarray
    pair: np.ndarray
    vocabulary: np.ndarray
    pairs_by: np.ndarray
    words_by: np.ndarray
    pair_cut: np.ndarray
    word_cut: np.ndarray


def _chunk(vocabulary, place, per_doc, bits, buckets) -> Chunk:
    _, of = _known(vocabulary, bits)
    before = np.empty(len(place), np.int64)
    before[1:] = place[:-1]
    before[np.cumsum(per_doc) - per_doc] = len(vocabulary)
    own = mixed(restaurants(np.append(vocabulary, BEGIN), bits))
    key, first, pair = np.unique(mixed(vocabulary[place] + own[before]), return_index=True, return_inverse=True)
    word = place[first].astype(np.int64)
    bucket = (mixed(vocabulary) % U64(buckets)).astype(np.int64)
    pairs_by, words_by = np.argsort(bucket[word], kind="stable"), np.lexsort((vocabulary, bucket))
    edge = np.arange(buckets + 1)
    return Chunk(key, word, of[before[first]], pair, vocabulary, pairs_by, words_by,
                 np.searchsorted(bucket[word[pairs_by]], edge), np.searchsorted(bucket[words_by], edge))


def _wanted(batches, bits, buckets):
    """Which pairs and words each chunk has to know, for each bucket."""
    for batch in batches:
        for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
            vocabulary, place, _, _, _, per_doc = _unpacked(blob.as_py())
            c = _chunk(vocabulary, place, per_doc, bits, buckets)
            pairs, words_of = c.key[c.pairs_by], vocabulary[c.words_by]
            yield _rows([(b, TEXTS, number, _packed(_rises(pairs[c.pair_cut[b]:c.pair_cut[b + 1]]), _rises(words_of[c.word_cut[b]:c.word_cut[b + 1]])))
                         for b in np.flatnonzero(np.diff(c.word_cut)).tolist()])


def _texts(batches, bits):
    """All documents in chunks of about ``FLUSH`` tokens; batches have doc_id, held_out and text."""
    task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    parts, ids, valid, held, n, chunk = [], [], [], [], 0, 0
    for batch in batches:
        own = batch.column(0)
        own_valid = own.is_valid().to_numpy(zero_copy_only=False)
        own_ids, own_held = own.fill_null(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        for piece in slices(batch.column(2)):
            parts.append(tokens(piece, bits))
            rows = slice(piece.first, piece.first + len(piece))
            ids.append(own_ids[rows])
            valid.append(own_valid[rows])
            held.append(own_held[rows])
            n += len(parts[-1].word)
            if n >= FLUSH:
                yield _whole(parts, *map(np.concatenate, (ids, valid, held)), task + chunk)
                parts, ids, valid, held, n, chunk = [], [], [], [], 0, chunk + 1
    if parts:
        yield _whole(parts, *map(np.concatenate, (ids, valid, held)), task + chunk)


def _counted(batches, bits, buckets):
    """(word, context) counts of each task, for each bucket."""
    parts, n = [], 0

    def sent():
        word, context = np.concatenate([p.word for p in parts]), np.concatenate([p.context for p in parts])
        w, c, k = _pairs(word, context, np.ones(len(word), np.int64))
        bucket = (mixed(w) % U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
        return _rows([(b, COUNTS, 0, _packed(w[x], c[x], k[x])) for b in np.flatnonzero(np.diff(cut)).tolist() for x in [by[cut[b]:cut[b + 1]]]])

    for batch in batches:
        for piece in slices(batch.column(0)):
            parts.append(tokens(piece, bits))
            n += len(parts[-1].word)
            if n >= FLUSH:
                yield sent()
                parts, n = [], 0
    if parts:
        yield sent()


def _merged(batches, bits):
    """A bucket's pairs; contexts are places in the bucket's own list of restaurants, or restaurants themselves if hashed."""
    for bucket, rows in by_bucket(batches, 3):
        w, c, k = (np.concatenate(x) for x in zip(*[_unpacked(blob) for _, _, blob in rows]))
        w, c, k = _pairs(w, c, k)
        keys, place = np.unique(c, return_inverse=True)
        yield _rows([(bucket, COUNTS, 0, _packed(w, (place if bits is None else c).astype(np.uint32), k, _rises(keys)))])


@dataclass
class State:
    """What all buckets share.

    n tokens, v words; customers and tables of the parent restaurant.  Customers and tables of each context restaurant
    are here only if contexts are hashed (or, within a task, the tables of a bucket's own restaurants); else they are
    a table dealt by restaurant.
    """

    n: int
    v: int
    customers: np.ndarray | None
    discount: float
    parent_discount: float
    strength: float
    sweeps: list[tuple[np.ndarray, int, int]] = field(default_factory=list)  # tables by context, parent's customers and tables


def seated(customers: np.ndarray, opening: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables after each dish's customers (one or more) sat down one by one.

    A customer opens a table with weight ``opening`` (strength and discounted tables times the parent's probability)
    against the customers of the dish less the discount of its tables.  Beyond 64 customers they come in groups of a
    thirty-second of those seated, each group at one probability, so the steps grow with the logarithm of a count.
    """
    order = np.argsort(-customers, kind="stable")
    c, a = customers[order], opening[order]
    tables = np.ones(len(c), np.int64)
    i = 1
    while True:
        active = int(np.searchsorted(-c, -i, "left"))  # those with more than i customers
        if not active:
            break
        group = 1 if i < 64 else i // 32
        p = a[:active] / (a[:active] + i - discount * tables[:active])
        if group == 1:
            tables[:active] += rng.random(active) < p
        else:
            tables[:active] += rng.binomial(np.minimum(group, c[:active] - i), np.clip(p, 0, 1))
        i += group
    out = np.empty_like(tables)
    out[order] = tables
    return out


class Bucket:
    """The dishes (words) of a bucket, their contexts, and their seating after each sweep."""

    def __init__(self, number: int, blob: bytes):
        self.number = number
        self.word, self.context, self.count, rises = _unpacked(blob)
        self.keys = np.cumsum(rises, dtype=U64)
        new = np.r_[True, self.word[1:] != self.word[:-1]]
        self.begin = np.flatnonzero(new)
        self.words = self.word[self.begin]
        self.of = np.cumsum(new) - 1
        self.total = np.add.reduceat(self.count, self.begin)
        self.tables = np.ones(len(self.word), np.int64)
        self.parent_tables = np.ones(len(self.words), np.int64)

    def parent(self, state: State, sweep: int) -> tuple[np.ndarray, float]:
        """Probability of each word, and of a word never seen, in the parent restaurant."""
        _, customers, tables = state.sweeps[sweep]
        new = (state.strength + state.parent_discount * tables) / (state.v + 1)
        own = np.add.reduceat(self.tables, self.begin)
        return (own - state.parent_discount * self.parent_tables + new) / (state.strength + customers), new / (state.strength + customers)

    def sweep(self, state: State, last: int) -> None:
        """Everyone gets up and is seated again, given the other buckets' seating after sweep ``last``."""
        rng = np.random.default_rng((last, self.number))
        tables, _, parent_tables = state.sweeps[last]
        p, _ = self.parent(state, last)
        opening = (state.strength + state.discount * tables[self.context]) * p[self.of]
        self.tables = seated(self.count, opening, state.discount, rng)
        new = (state.strength + state.parent_discount * parent_tables) / (state.v + 1)
        self.parent_tables = seated(np.add.reduceat(self.tables, self.begin), np.full(len(self.words), new), state.parent_discount, rng)


def _local(state: State | None, rows) -> State | None:
    """The state as a bucket needs it: with the tables of its own restaurants after each sweep."""
    if state is None or state.customers is not None:
        return state
    found: dict[int, list] = {}
    for chunk, blob in rows:
        found.setdefault(chunk >> 32, []).extend(_unpacked(blob))
    return replace(state, sweeps=[(np.concatenate(found[k]), *rest) for k, (_, *rest) in enumerate(state.sweeps)])


def _seatings(batches, state, bits, parts):
    """Tables (at first also customers) by restaurant of each bucket, for each part, and sums."""
    for number, rows in by_bucket(batches, 3):
        b = Bucket(number, next(blob for kind, _, blob in rows if kind == COUNTS))
        local = _local(state, [(chunk, blob) for kind, chunk, blob in rows if kind == SHARED])
        if state is not None:
            for last in range(len(state.sweeps)):
                b.sweep(local, last)
        at = b.context if bits is None else np.searchsorted(b.keys, b.context.astype(U64))
        held = [np.bincount(at, x, len(b.keys)).astype(np.int64) for x in ([b.tables] if state is not None else [b.tables, b.count])]
        own = np.add.reduceat(b.tables, b.begin)
        sums = np.array([b.count.sum(), len(b.words), own.sum(), b.parent_tables.sum(), (b.count == 1).sum(), (b.count == 2).sum(), (own == 1).sum(), (own == 2).sum()], np.int64)
        rows = [(p, ASK, number, _packed(b.keys[x], *[h[x] for h in held])) for p, x in _divided(b.keys, bits, parts)]
        yield _rows([*rows, (number % parts, SUMS, number, _packed(sums))])


def _summed(batches, sweep):
    """The table of a part's restaurants, and for each bucket the tables of those it asked for."""
    for part, rows in by_bucket(batches, 3):
        asked = [(bucket, _unpacked(blob)) for kind, bucket, blob in rows if kind == ASK]
        if asked:
            keys, place = np.unique(np.concatenate([a[0] for _, a in asked]), return_inverse=True)
            total = [np.bincount(place, np.concatenate(x), len(keys)).astype(np.int64) for x in list(zip(*[a for _, a in asked]))[1:]]
            yield _rows([(part, TABLE, sweep, _packed(keys, *total))])
            end = np.cumsum([len(a[0]) for _, a in asked])
            yield _rows([(bucket, ANSWER, sweep << 32 | part, _packed(total[0][place[e - len(a[0]):e]])) for (bucket, a), e in zip(asked, end)])
        sums = [_unpacked(blob)[0] for kind, _, blob in rows if kind == SUMS]
        if sums:
            yield _rows([(part, SUMS, sweep, _packed(np.sum(sums, axis=0)))])


def _gather(counts: DataFrame, shared: list[DataFrame], state: State | None, bits: int | None, buckets: int):
    """Sums after one more sweep; the tables of restaurants are added to ``shared``."""
    sweep, rows = len(shared), _beside(counts, shared if bits is None else [])
    if rows is not counts:
        rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk")
    asked = rows.mapInArrow(lambda b: _seatings(b, state, bits, buckets), SCHEMA)
    shared.append(_stored(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(lambda b: _summed(b, sweep), SCHEMA), "lm-contexts"))
    sums = [_unpacked(bytes(r.blob))[0] for r in shared[-1].where(F.col("kind") == SUMS).select("blob").collect()]
    return np.sum(sums, axis=0) if sums else np.zeros(8, np.int64)


def _stored(df: DataFrame, label: str) -> DataFrame:
    """``stored``, after which the shuffle files of that write go, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, label)
    finally:
        conf.set(key, before)


def _beside(counts: DataFrame, shared: list[DataFrame]) -> DataFrame:
    """Counts with what the buckets know of their restaurants."""
    for table in shared:
        counts = counts.unionByName(table.where(F.col("kind") == ANSWER).withColumn("kind", F.lit(SHARED)))
    return counts


def _hashed(shared: DataFrame, contexts: int) -> list[np.ndarray]:
    """Tables (and customers) of all hashed restaurants as arrays."""
    out = [np.zeros(contexts, np.int64), np.zeros(contexts, np.int64)]
    for r in shared.where(F.col("kind") == TABLE).select("blob").collect():
        keys, *held = _unpacked(bytes(r.blob))
        for x, h in zip(out, held):
            x[keys.astype(np.int64)] = h
    return out


@dataclass
class Model:
    counts: DataFrame
    shared: list[DataFrame]
    state: State
    buckets: int
    bits: int | None
    burn_in: int


def fit(docs: DataFrame, text_col: str = "text", bits: int | None = None, sweeps: int = 3, burn_in: int = 1, strength: float = 1.0, bucket_bytes: int = 24 << 20) -> Model:
    """A word model from all texts of ``docs``.

    Tokens: words (runs of bytes other than white space, A-Z lower-cased) and one end a text.  Each token is a customer in
    the restaurant of the token before it (told by its 64-bit hash); only if ``bits`` is given, contexts are hashed into
    2**``bits`` restaurants, whose tables and customers then are arrays in the model's state.  All restaurants
    share one parent over words, whose base is uniform over the words seen and one more.  Discounts come from the
    counts of counts.

    Counts are summed in the tasks, dealt by word, and kept as one row a bucket; the number of buckets follows the size
    of the texts.  A sweep seats every bucket's customers anew, given the others' seating after the sweep before, and
    sends tables by context to as many parts, which add them up and return to each bucket those it has.  The state of a bucket is not stored: later
    sweeps replay the earlier ones from their seeds, so a lost task is run again to the same seating.

    Null and empty texts are one end token.  No rows give a model that knows nothing.
    """
    narrow = small_batches(docs).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    octets = narrow.agg(F.sum(F.octet_length("text"))).first()[0]
    # each bucket sends to each part: no more of them than the size asks for, however many shuffle partitions are set
    buckets = max(1, min(parts_for(octets or 0, bucket_bytes, docs.sparkSession), -(-int(octets or 0) // (bucket_bytes // 3))))
    sent = narrow.mapInArrow(lambda b: _counted(b, bits, buckets), SCHEMA)
    counts = _stored(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _merged(b, bits), SCHEMA), "lm-counts")
    shared: list[DataFrame] = []
    s = _gather(counts, shared, None, bits, buckets)

    def discount(ones, twos):
        return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))

    tables, customers = (None, None) if bits is None else _hashed(shared[0], 1 << bits)
    state = State(int(s[0]), int(s[1]), customers, discount(s[4], s[5]), discount(s[6], s[7]), strength, [(tables, int(s[2]), int(s[3]))])
    for _ in range(sweeps):
        s = _gather(counts, shared, state, bits, buckets)
        state.sweeps.append((None if bits is None else _hashed(shared[-1], 1 << bits)[0], int(s[2]), int(s[3])))
    return Model(counts, shared, state, buckets, bits, burn_in)


def _answers(batches, state: State, chosen: list[int]):
    """What a bucket holds of the pairs and words that chunks ask for: its counts come first, then the questions.

    Of pairs: customers, and tables of each sample; of words: customers, then tables and the parent's tables of each.
    Whom a bucket does not know has none.
    """
    bucket, samples, number, held = None, [], None, []
    for batch in batches:
        for b, kind, chunk, blob in zip(*[c.to_pylist() for c in batch.columns]):
            if b != number:
                bucket, samples, number, held = None, [], b, []
            if kind == COUNTS:
                bucket = Bucket(b, blob)
                continue
            if kind == SHARED:
                held.append((chunk, blob))
                continue
            pairs, words_of = (np.cumsum(x, dtype=U64) for x in _unpacked(blob))
            if bucket is None:
                nobody = [np.zeros(len(x), np.int64) for x in (pairs, words_of)]
                yield _rows([(b, TEXTS, chunk, _packed(*nobody[:1] * (1 + len(chosen)), *nobody[1:] * (1 + 2 * len(chosen))))])
                continue
            if not samples:
                local, held = _local(state, held), []
                restaurant = bucket.keys[bucket.context] if state.customers is None else bucket.context.astype(U64)
                known = mixed(bucket.word + mixed(restaurant))
                by_pair = np.argsort(known)
                known = known[by_pair]
                for sweep in range(max(chosen) + 1):
                    if sweep:
                        bucket.sweep(local, sweep - 1)
                    if sweep in chosen:
                        samples.append((bucket.tables[by_pair], np.add.reduceat(bucket.tables, bucket.begin), bucket.parent_tables))
            at, hit = _met(known, pairs)
            of_pairs = [np.where(hit, x[at], 0) for x in (bucket.count[by_pair], *[s[0] for s in samples])]
            at, hit = _met(bucket.words, words_of)
            of_words = [np.where(hit, x[at], 0) for x in (bucket.total, *[x for s in samples for x in s[1:]])]
            yield _rows([(b, TEXTS, chunk, _packed(*of_pairs, *of_words))])


def _by_document(batches, state: State, chosen: list[int], bits, buckets):
    """The documents of a chunk, which meets all answers; rows come with the chunk itself first."""
    new = [(state.strength + state.parent_discount * tables) / (state.v + 1) for _, _, tables in state.sweeps]
    for _, rows in by_bucket(batches, 3):
        vocabulary, place, ids, valid, held, per_doc = _unpacked(rows[0][2])
        c = _chunk(vocabulary, place, per_doc, bits, buckets)
        customers, *tables_of = (np.concatenate(x)[c.restaurant] for x in zip(*[_unpacked(blob) for kind, _, blob in rows if kind == SHARED]))
        answers = [np.concatenate(x) for x in zip(*[_unpacked(blob) for kind, _, blob in rows if kind == TEXTS])]
        of_pairs, of_words = answers[:1 + len(chosen)], answers[1 + len(chosen):]
        seen, *own = (_back(x, c.pairs_by) for x in of_pairs)
        known, *seated_at = (_back(x, c.words_by) for x in of_words)
        p = np.zeros(len(c.key))
        for k, tables, own_tables, word_tables, parent_tables in zip(chosen, tables_of, own, seated_at[::2], seated_at[1::2]):
            parent = ((word_tables - state.parent_discount * parent_tables + new[k]) / (state.strength + state.sweeps[k][1]))[c.word]
            sat = np.where(seen > 0, seen - state.discount * own_tables, 0.0)
            p += (sat + (state.strength + state.discount * tables) * parent) / (state.strength + customers)
        p /= len(chosen)
        base = (known + 0.5) / (state.n + 0.5 * (state.v + 1))
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        score, base_score, n_known = (np.bincount(doc, x, len(per_doc)) for x in (np.log10(p)[c.pair], np.log10(base)[place], (known > 0)[place]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=valid == 0), pa.array(held == 1), pa.array(per_doc), pa.array(np.rint(n_known).astype(np.int64)), pa.array(np.full(len(ids), state.n, np.int64)), pa.array(base_score), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _back(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Values given in the order ``by``, in their own."""
    out = np.empty_like(x)
    out[by] = x
    return out


def score(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity of every row.

    A text's probability is the product over its tokens of the predictive probability averaged over the sweeps after
    ``burn_in``.  Documents stay together in chunks.  A chunk asks what its restaurants hold, and each bucket for the
    counts and seating of its distinct words and (word, context) pairs; the answers are counts, and meet the chunk
    again.  So a frequent pair is one entry a chunk in its bucket's stream, and lists of documents do not travel.

    Null texts are the end token alone.  Null and repeated ids are scored row by row.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    state, buckets, bits = docs.sparkSession.sparkContext.broadcast(model.state), model.buckets, model.bits
    last = len(model.state.sweeps) - 1
    chosen = list(range(model.burn_in + 1, last + 1)) or [last]
    # stored: the same chunks are asked about and then scored
    chunks = _stored(narrow.mapInArrow(lambda b: _texts(b, bits), SCHEMA), "lm-chunks")
    asked = chunks.mapInArrow(lambda b: _questions(b, bits, buckets), SCHEMA)
    for k in sorted({0, *chosen}):
        asked = asked.unionByName(model.shared[k].where(F.col("kind") == TABLE))
    # each round of answers is stored, so that its questions' shuffle files go before the next
    replies = _stored(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda b: _replies(b, chosen), SCHEMA), "lm-restaurants")
    wanted = chunks.mapInArrow(lambda b: _wanted(b, bits, buckets), SCHEMA)
    every = _beside(model.counts, model.shared if bits is None else []).unionByName(wanted).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk")
    answers = _stored(every.mapInArrow(lambda b: _answers(b, state.value, chosen), SCHEMA), "lm-answers")
    whole = chunks.unionByName(replies).unionByName(answers).select("chunk", "kind", "bucket", "blob").repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = whole.mapInArrow(lambda b: _by_document(b, state.value, chosen, bits, buckets), schema)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
