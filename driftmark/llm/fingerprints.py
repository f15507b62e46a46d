"""Document fingerprints from prefix polynomial hashes: equality of any spans and longest common extensions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tables import parts_for, small_batches, tidied
from driftmark.llm.words import U64, mix

#: Two primes below 2**31 and a base for each: products fit 64 bits, both together tell spans apart.
MODULI = ((2**31 - 1, 1_402_417_661), (2**31 - 19, 777_767_777))
CHUNK = 1 << 20

WINDOW = 24  # code points of the spans that are sampled
SLOTS = 64
RUNGS = 15
_LENGTH, _WHOLE = slice(0, 8), slice(8, 16)
_FRONT, _BACK, _SAMPLE = slice(16, 76), slice(76, 136), slice(136, 264)
BYTES = 264


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class _Powers:
    """Powers of a base and of its inverse modulo a prime, up to what a chunk needs."""

    def __init__(self, prime: int, base: int):
        self.prime, self.base, self.inverse = prime, base, pow(base, -1, prime)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def grown(self, n: int) -> _Powers:
        while len(self.up) < n:
            more = min(len(self.up), max(n - len(self.up), 1024))
            for name, base in (("up", self.base), ("down", self.inverse)):
                have = getattr(self, name)
                setattr(self, name, np.concatenate([have, have[:more] * U64(pow(base, len(have), self.prime)) % U64(self.prime)]))
        return self


_POWERS = [_Powers(p, b) for p, b in MODULI]


class Prefixes:
    """Prefix hashes of a text of up to ``CHUNK`` code points and some: answers about spans in constant time each."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        self.sums = []
        for powers in _POWERS:
            powers.grown(CHUNK + 2 * WINDOW if self.size <= CHUNK + WINDOW else self.size + 1)
            q = np.zeros(self.size + 1, U64)
            np.cumsum((codes.astype(U64) + U64(1)) * powers.up[: self.size] % U64(powers.prime), out=q[1:])
            self.sums.append(q % U64(powers.prime))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes (62 bits) of the spans [start, end): equal spans have equal hashes wherever they stand."""
        halves = []
        for powers, q in zip(_POWERS, self.sums):
            p = U64(powers.prime)
            halves.append((q[end] + p - q[start]) % p * powers.down[start] % p)
        return halves[0] << U64(31) | halves[1]

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the spans of n code points from i and from j are equal."""
        return self.spans(i, i + n) == self.spans(j, j + n)

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the texts from i and from j agree, up to ``most``: a binary search over equal spans for each pair."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(i, j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def common_extension(a: str, b: str, i: int = 0, j: int = 0, chunk: int = CHUNK // 2) -> int:
    """Length of the longest common extension of ``a`` from i and ``b`` from j, chunk by chunk for texts of any length."""
    total, most = 0, max(0, min(len(a) - i, len(b) - j))
    while total < most:
        n = min(chunk, most - total)
        both = Prefixes(code_points(a[i + total:i + total + n] + b[j + total:j + total + n]))
        found = int(both.extension(np.array([0]), np.array([n]), np.array([n]))[0])
        total += found
        if found < n:
            break
    return total


def extensions_of(pairs: list[tuple[str, str]]) -> list[int]:
    """``common_extension`` of both beginnings for many pairs, with the prefix hashes of about a chunk of them at a time."""
    out: list[int] = []
    for low, high in _slices([a + b if len(a) + len(b) <= CHUNK else "" for a, b in pairs]):
        some = [("", "") if len(a) + len(b) > CHUNK else (a, b) for a, b in pairs[low:high]]
        size = np.array([[len(a), len(b)] for a, b in some], np.int64)
        offset = np.r_[0, np.cumsum(size.ravel())]
        found = Prefixes(code_points("".join(a + b for a, b in some))).extension(offset[:-1:2], offset[1::2], size.min(axis=1))
        out += [common_extension(a, b) if len(a) + len(b) > CHUNK else int(n) for (a, b), n in zip(pairs[low:high], found)]
    return out


def _prefix_hashes(codes: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hash of the prefix of each length in ``at`` (ascending), and base ** -length, for each modulus; in chunks."""
    hashes = [np.zeros(len(at), U64) for _ in MODULI]
    inverse = [np.ones(len(at), U64) for _ in MODULI]
    carry = [0] * len(MODULI)
    for c in range(0, max(len(codes), 1), CHUNK):
        part = Prefixes(codes[c:c + CHUNK])
        low, high = np.searchsorted(at, (c, c + part.size + (c + CHUNK >= len(codes))))
        local = at[low:high] - c
        for m, powers in enumerate(_POWERS):
            p = powers.prime
            shift, back = U64(pow(powers.base, c, p)), U64(pow(powers.inverse, c, p))
            hashes[m][low:high] = (U64(carry[m]) + part.sums[m][local] * shift % U64(p)) % U64(p)
            inverse[m][low:high] = powers.down[local] * back % U64(p)
            carry[m] = (carry[m] + int(part.sums[m][-1]) * int(shift)) % p
    return hashes, inverse


def _span(hashes, inverse, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Span hashes from prefix hashes, start and end being places in their lists."""
    halves = [(h[end] + U64(p) - h[start]) % U64(p) * inv[start] % U64(p) for (p, _), h, inv in zip(MODULI, hashes, inverse)]
    return halves[0] << U64(31) | halves[1]


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of ``BYTES`` bytes for each text.

    Its length in code points and the hash of the whole; hashes (32 bits) of up to 15 prefixes and 15 suffixes whose
    lengths are multiples of a power of two, the rungs; and of each of 64 classes of its 24-point spans the least hash
    (16 bits, 0 for none).  All are read off prefix hashes.  A text shorter than 24 has one span, itself.
    """
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    codes = code_points("".join(texts))
    offset = np.r_[0, np.cumsum(size)]
    out = np.zeros((n, BYTES), np.uint8)
    out[:, _LENGTH] = size.astype("<u8").view(np.uint8).reshape(n, 8)

    step = _steps(size)
    rung = np.arange(1, RUNGS + 1)
    length = rung[None, :] * step[:, None]
    used = length <= size[:, None]
    length = np.where(used, length, 0)
    at = np.concatenate([offset[:-1], offset[1:], (offset[:-1, None] + length).ravel(), (offset[1:, None] - length).ravel()])
    order = np.argsort(at, kind="stable")
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    hashes, inverse = _prefix_hashes(codes, at[order])
    starts, ends = place[:n], place[n:2 * n]
    front, back = place[2 * n:2 * n + n * RUNGS], place[2 * n + n * RUNGS:]
    whole = mix(_span(hashes, inverse, starts, ends))
    out[:, _WHOLE] = whole.astype("<u8").view(np.uint8).reshape(n, 8)
    for where, a, b in ((_FRONT, np.repeat(starts, RUNGS), front), (_BACK, back, np.repeat(ends, RUNGS))):
        h = np.where(used.ravel(), mix(_span(hashes, inverse, a, b)) >> U64(32), U64(0)).astype("<u4")
        out[:, where] = h.view(np.uint8).reshape(n, RUNGS * 4)

    best = np.full(n * SLOTS, np.iinfo(np.uint64).max, U64)
    doc_end = offset[1:]
    for c in range(0, len(codes), CHUNK):
        part = Prefixes(codes[c:c + CHUNK + WINDOW - 1])
        here = np.arange(min(CHUNK, part.size))
        doc = np.searchsorted(doc_end, here + c, "right")
        end = here + np.where(size[doc] < WINDOW, size[doc], WINDOW)
        fits = (end + c <= doc_end[doc]) & ((size[doc] >= WINDOW) | (here + c == offset[doc]))
        here, end, doc = here[fits], end[fits], doc[fits]
        h = mix(part.spans(here, end))
        np.minimum.at(best, doc * SLOTS + (h >> U64(58)).astype(np.int64), h & U64((1 << 58) - 1))
    sample = np.where(best == np.iinfo(np.uint64).max, U64(0), mix(best) % U64(65535) + U64(1)).astype("<u2")
    out[:, _SAMPLE] = sample.view(np.uint8).reshape(n, SLOTS * 2)
    return out


def _steps(size: np.ndarray) -> np.ndarray:
    """Distance of the rungs: the power of two that makes 8 to 15 of them, 1 for shorter texts."""
    bits = np.zeros(len(size), np.int64)
    bits[size > 0] = np.floor(np.log2(size[size > 0])).astype(np.int64) + 1
    return np.int64(1) << np.maximum(bits - 4, 0)


def _rungs_shared(a: np.ndarray, b: np.ndarray, where: slice, size_a, size_b, step_a, step_b) -> np.ndarray:
    """Length up to which prefixes (or suffixes) agree, to within a rung of the coarser ladder, by binary search."""
    wide = np.maximum(step_a, step_b)
    ladder_a = np.ascontiguousarray(a[:, where]).view("<u4")
    ladder_b = np.ascontiguousarray(b[:, where]).view("<u4")
    low, high = np.zeros(len(a), np.int64), np.minimum(size_a, size_b) // wide
    row = np.arange(len(a))
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = ladder_a[row, np.maximum(middle * (wide // step_a) - 1, 0)] == ladder_b[row, np.maximum(middle * (wide // step_b) - 1, 0)]
        low, high = np.where(same | (low >= high), middle, low), np.where(same | (low >= high), high, middle - 1)
        low = np.minimum(low, high)
    return low * wide


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness (0 to 1) of texts, from their fingerprints alone, row by row.

    1 for equal texts.  Else the greater of two estimates of the share of the longer text (of both texts, for samples)
    that is common: what the rungs prove to agree at both ends, and the sampled spans that agree.
    """
    size_a, size_b = (np.ascontiguousarray(x[:, _LENGTH]).view("<u8")[:, 0].astype(np.int64) for x in (a, b))
    step_a, step_b = _steps(size_a), _steps(size_b)
    same = (a[:, :16] == b[:, :16]).all(axis=1)
    longer, shorter = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    ends = sum(_rungs_shared(a, b, where, size_a, size_b, step_a, step_b) for where in (_FRONT, _BACK))
    proven = np.minimum(ends, shorter) / np.maximum(longer, 1)
    sa, sb = (np.ascontiguousarray(x[:, _SAMPLE]).view("<u2") for x in (a, b))
    filled = ((sa > 0) | (sb > 0)).sum(axis=1)
    jaccard = ((sa == sb) & (sa > 0)).sum(axis=1) / np.maximum(filled, 1)
    return np.where(same, 1.0, np.minimum(np.maximum(proven, 2 * jaccard / (1 + jaccard)), 1 - 1e-9))


def text_likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints as written in tables (hexadecimal)."""
    rows = [np.frombuffer(bytes.fromhex(x), np.uint8)[None, :] for x in (a, b)]
    return float(likeness(*rows)[0])


def _slices(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    first = total = 0
    for k, text in enumerate(texts):
        if k > first and total + len(text) > limit:
            yield first, k
            first, total = k, 0
        total += len(text)
    if first < len(texts):
        yield first, len(texts)


def _fingerprinted(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for low, high in _slices(texts):
            marks = [row.tobytes().hex() for row in fingerprints(texts[low:high])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([len(t) for t in texts[low:high]], pa.int64()), pa.array(marks, pa.string())], names=["doc_id", "n_chars", "fingerprint"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every text; nothing is shuffled.

    Equal texts have equal fingerprints.  Null texts count as empty; null and repeated ids are rows like others; very
    long texts are read in chunks; other columns are ignored; no rows give no rows.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidied(_fingerprinted), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def _edited(batches, kind):
    """Fingerprints of texts, of their edited texts and of the texts that follow; rows come ordered within each part."""
    waiting: list[tuple] = []  # id, text, next text
    last = None
    held = 0

    def solved():
        # each text follows the one before it, so most are measured once
        texts, of = [], {}

        def index(text):
            if text not in of:
                of[text] = len(texts)
                texts.append(text)
            return of[text]

        rows = []
        for key, text, following in waiting:
            cut = len(text) // 4
            edited = text[:len(text) - cut] + following[:cut]
            rows.append((key, text, edited, index(text), index(edited), index(following)))
        marks = np.concatenate([fingerprints(texts[low:high]) for low, high in _slices(texts)])
        own, changed, after = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
        words = [row.tobytes().hex() for row in marks]
        cols = [
            pa.array([r[0] for r in rows], kind), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string()),
            pa.array([words[k] for k in own], pa.string()), pa.array([words[k] for k in changed], pa.string()),
            pa.array(likeness(marks[own], marks[changed]), pa.float64()), pa.array(likeness(marks[own], marks[after]), pa.float64()),
            pa.array(extensions_of([(r[1], r[2]) for r in rows]), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"])

    for batch in batches:
        for part, ghost, key, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if last is not None and last[0] == part:
                waiting.append((last[1], last[2], text))
                held += 2 * len(last[2])
                if held > CHUNK or len(waiting) >= 1000:
                    yield solved()
                    waiting, held = [], 0
            last = None if ghost else (part, key, text)
    if waiting:
        yield solved()


def _part_of(key: Column, bounds: list[Column]) -> Column:
    """How many of the sorted bounds are not above ``key``, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    array = F.array(*bounds)
    bits = len(bounds).bit_length()
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.element_at(array, F.least(at + s, F.lit(len(bounds)))) <= key), at + s).otherwise(at))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 2000, most_parts: int = 1 << 14) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's.

    The edited text is the text with its last quarter (floor of its code points by 4) replaced by as many first code
    points of the next document, or all of it if that is shorter; documents are ordered by id, and the first follows
    the last.  Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    common_prefix (the longest common extension of text and edited text from their beginnings).

    Documents are cut into parts of about ``part_rows`` by bounds drawn from a sample, which only lays out the work;
    each part also gets the first document of the next one, so one shuffle of the texts is all, and a task streams over
    its parts.  The bounds and the first documents' ids, ``most_parts`` at most, are all that the driver sees.

    Null texts count as empty.  Null ids come last; rows of one id are ordered by a hash of their texts; rows that
    repeat one another wholly follow one another.  A single document follows itself.  Other columns are ignored; no
    rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.withColumn("none", F.col("doc_id").isNull())
    place = ("none", "doc_id", "h")
    total = docs.count()
    parts = min(most_parts, parts_for(total, part_rows, spark))
    wanted = min(1.0, 20 * parts / max(total, 1))
    hashed = F.pmod(F.xxhash64("h", "doc_id", F.lit(11)), F.lit(2**32))
    sample = sorted({tuple(r) for r in rows.where(hashed < int(wanted * 2**32)).select(*place).collect()}, key=lambda r: (r[0], 0 if r[1] is None else r[1], r[2]))
    cuts = sorted({len(sample) * k // parts for k in range(1, parts)} - {0}) if sample else []
    bounds = [F.struct(F.lit(n).alias("none"), F.lit(i).cast(kind).alias("doc_id"), F.lit(h).cast("long").alias("h")) for n, i, h in (sample[c] for c in cuts)]
    cut = rows.withColumn("part", _part_of(F.struct(*place), bounds))

    first = cut.groupBy("part").agg(F.min(F.struct(*place)).alias("low")).select("part", "low.*").collect()
    first.sort(key=lambda r: r.part)
    before = [(r.part, r.none, r.doc_id, r.h, first[k - 1].part) for k, r in enumerate(first)]
    heads = spark.createDataFrame(before, f"part int, none boolean, doc_id {kind.simpleString()}, h long, dest int")
    same = (cut.part == heads.part) & cut.doc_id.eqNullSafe(heads.doc_id) & (cut.h == heads.h)
    own, copy = F.struct(cut.part.alias("part"), F.lit(False).alias("ghost")), F.struct(F.col("dest").alias("part"), F.lit(True).alias("ghost"))
    dealt = cut.join(F.broadcast(heads), same, "left").select(
        F.explode(F.when(F.col("dest").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to"), cut.none.alias("none"), cut.doc_id.alias("doc_id"), cut.h.alias("h"), cut.text.alias("text"),
    ).select("to.*", "none", "doc_id", "h", "text")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "ghost", "none", "doc_id", "h", "text").select("part", "ghost", "doc_id", "text")
    arrow = _arrow_of(kind)
    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return ordered.mapInArrow(tidied(lambda b: _edited(b, arrow)), schema)


def _arrow_of(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _extended(batches):
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(4)]
        found = [common_extension(a or "", b or "", int(i or 0), int(j or 0)) for a, b, i, j in zip(*cols)]
        yield batch.append_column("extension", pa.array(found, pa.int64()))


def common_extensions(pairs: DataFrame, a: str, b: str, i: str | None = None, j: str | None = None) -> DataFrame:
    """``a``, ``b``, ``i``, ``j`` and ``extension``: how many code points text a from i and text b from j have in common.

    Nulls count as empty texts and as place 0; places beyond the end have nothing in common.
    """
    rows = small_batches(pairs).select(
        F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"),
        (F.col(i) if i else F.lit(0)).cast("long").alias("i"), (F.col(j) if j else F.lit(0)).cast("long").alias("j"),
    )
    return rows.mapInArrow(tidied(_extended), "a string, b string, i long, j long, extension long")
