"""Fingerprints, whitening and conversation repair against brute force and on edge cases."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from edge_rows import CLASH, EDGE
from pyspark.sql import functions as F

from driftmark.llm import conversations, fingerprints, queries, whitening

SMALL = "/root/testdata/sf0.001"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# --- 11 fingerprints

def span_hash(codes):
    """Polynomial hash of a whole span, term by term."""
    halves = [sum((int(c) + 1) * pow(b, k, p) for k, c in enumerate(codes)) % p for p, b in fingerprints.MODULI]
    return halves[0] << 31 | halves[1]


def test_spans_and_extensions_against_loops():
    rng = random.Random(4)
    text = "".join(rng.choice("ab🙂") for _ in range(400)) * 2
    codes = fingerprints.code_points(text)
    p = fingerprints.Prefixes(codes)
    pairs = [(rng.randrange(800), rng.randrange(800)) for _ in range(300)] + [(k, k + 400) for k in range(0, 400, 37)]
    i, j = (np.array(x) for x in zip(*pairs))
    most = 800 - np.maximum(i, j)
    want = [len(os.path.commonprefix([text[a:], text[b:]])) for a, b in pairs]
    assert p.extension(i, j, most).tolist() == [min(w, m) for w, m in zip(want, most)]
    n = np.minimum(most, 5)
    assert p.equal(i, j, n).tolist() == [text[a:a + k] == text[b:b + k] for a, b, k in zip(i, j, n)]
    for a, k in ((0, 7), (3, 30), (400, 1), (9, 0)):
        assert int(p.spans(np.array([a]), np.array([a + k]))[0]) == span_hash(codes[a:a + k])
    for chunk in (1, 3, 64):
        assert all(fingerprints.common_extension(text, text[b:], a, 0, chunk) == w for (a, b), w in zip(pairs[:60], want))


def naive_fingerprint(text):
    """Length, whole, rungs and samples, each span hashed on its own."""
    from driftmark.llm.words import mixed

    def mixed_one(h):
        return int(mixed(np.array([h], np.uint64))[0])

    codes = fingerprints.code_points(text)
    n = len(codes)
    step = 1
    while n >= 16 * step:
        step *= 2
    front = [mixed_one(span_hash(codes[:k * step])) >> 32 if k * step <= n else 0 for k in range(1, 16)]
    back = [mixed_one(span_hash(codes[n - k * step:])) >> 32 if k * step <= n else 0 for k in range(1, 16)]
    best = [None] * 64
    starts = range(n - 23) if n >= 24 else range(min(n, 1))
    for s in starts:
        h = mixed_one(span_hash(codes[s:s + 24]))
        slot, value = h >> 58, h & (1 << 58) - 1
        best[slot] = value if best[slot] is None else min(best[slot], value)
    sample = [0 if b is None else mixed_one(b) % 65535 + 1 for b in best]
    return (
        n.to_bytes(8, "little") + mixed_one(span_hash(codes)).to_bytes(8, "little") + b"".join(x.to_bytes(4, "little") for x in front + back)
        + b"".join(x.to_bytes(2, "little") for x in sample)
    )


def test_fingerprints_against_loops(monkeypatch):
    texts = ["", "a", "abc" * 5, "é🙂" * 8, "x" * 23, "x" * 24, "x" * 200, "".join(chr(97 + k * k % 26) for k in range(500)), "ab" * 16]
    want = [naive_fingerprint(t) for t in texts]
    assert [r.tobytes() for r in fingerprints.fingerprints(texts)] == want
    monkeypatch.setattr(fingerprints, "CHUNK", 50)  # texts longer than a chunk
    assert [r.tobytes() for r in fingerprints.fingerprints(texts)] == want
    assert [r.tobytes() for t in texts for r in fingerprints.fingerprints([t])] == want


def test_likeness():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    base = " ".join(rng.choice(words) for _ in range(600))
    other = " ".join(rng.choice(words) for _ in range(600))

    def like(a, b):
        x = fingerprints.fingerprints([a, b])
        found = fingerprints.likeness(x[:1], x[1:])[0]
        assert found == fingerprints.likeness(x[1:], x[:1])[0]
        assert found == fingerprints.text_likeness(x[0].tobytes().hex(), x[1].tobytes().hex())
        return found

    assert like(base, base) == like("", "") == 1.0
    assert like(base, other) < 0.05 and like(base, "") == 0.0 and like("a", "b") == 0.0
    assert like(base, "x" + base) > 0.9 and like(base, base[:-1] + "?") > 0.9
    assert like(base, base[:1000] + "new words here " + base[1000:]) > 0.8
    assert 0.55 < like(base, base[: len(base) * 3 // 4] + other[: len(base) // 4]) < 0.9
    moved = base[len(base) // 2:] + " " + base[: len(base) // 2]
    assert like(base, moved) > 0.8
    assert like("abcdefgh", "abcdefgx") == pytest.approx(7 / 8)


def edited_rows(rows):
    """Brute force over (doc_id, text), ids unique or null."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        marks = [naive_fingerprint(t) if len(t) < 300 else fingerprints.fingerprints([t])[0].tobytes() for t in (text, edited, after)]
        a, b, c = (np.frombuffer(m, np.uint8)[None, :] for m in marks)
        out[i] = (len(text), sha(edited), marks[0].hex(), marks[1].hex(), fingerprints.likeness(a, b)[0], fingerprints.likeness(a, c)[0], len(os.path.commonprefix([text, edited])))
    return out


def digest(got):
    return [(r.doc_id, (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.common_prefix)) for r in got]


def test_edited_pairs_against_brute_force(spark, small):
    docs, rows = small
    want = edited_rows(rows)
    for got in (fingerprints.edited_pairs(docs.repartition(5), part_rows=7).collect(), queries.op11_fingerprints(spark, SMALL).collect()):
        found = dict(digest(got))
        assert len(got) == len(rows) and found == want
    assert np.mean([w[4] for w in want.values()]) > 0.7


def test_edited_pairs_edges(spark, edge):
    unique = {}
    for i, t in EDGE:
        unique.setdefault(i, t)
    df = spark.createDataFrame([(i, t, "clash") for i, t in unique.items()], "doc_id long, text string, part string")
    for part_rows in (1, 3, 2000):
        assert dict(digest(fingerprints.edited_pairs(df, part_rows=part_rows).collect())) == edited_rows(unique.items())
    got = fingerprints.edited_pairs(edge, part_rows=2).collect()  # repeated ids and rows, clashing columns
    assert len(got) == len(EDGE) and sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in EDGE)
    assert len({(r.n_chars, r.fingerprint) for r in got}) == len({t or "" for _, t in EDGE})
    copies = fingerprints.edited_pairs(spark.createDataFrame([(1, "abcdefgh")] * 5, "doc_id long, text string"), part_rows=1).collect()
    assert [(r.near_edited, r.near_next) for r in copies] == [(fingerprints.text_likeness(copies[0].fingerprint, copies[0].edited_fingerprint), 1.0)] * 5
    alone = fingerprints.edited_pairs(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert alone[0].edited_sha256 == sha("abcdefab") and alone[0].near_next == 1.0
    assert fingerprints.edited_pairs(edge.limit(0)).collect() == []
    assert fingerprints.fingerprint(edge.limit(0)).collect() == []
    assert {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprint(edge).collect()} == {(r.doc_id, r.fingerprint) for r in got}


def test_common_extensions_of_pairs(spark):
    rows = [("abcx", "abcy", 0, 0), ("xxabc", "abcd", 2, 0), (None, "a", 0, 0), ("a", "a", 5, None), ("🙂b", "🙂b", 0, 0)]
    got = fingerprints.common_extensions(spark.createDataFrame(rows, "a string, b string, i long, j long"), "a", "b", "i", "j").collect()
    assert sorted((r.a or "", r.extension) for r in got) == sorted([("abcx", 3), ("xxabc", 3), ("", 0), ("a", 0), ("🙂b", 2)])


# --- 12 whitening

def brute_whitening(rows, most=8):
    x = [[int(np.floor(float(c) * 1024)) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    centred = np.array([[n * a - b for a, b in zip(v, s)] for v in x], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    values, vectors = values[order], vectors[:, order]
    trace = (centred**2).sum() / n
    return n, deviation, centred @ vectors / np.sqrt(np.maximum(values, 1e-300)), values / trace


def check_whitening(got, rows, live=8):
    n, deviation, white, explained = brute_whitening(rows)
    k = min(8, len(rows[0][1]))
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert len(got) == len(rows) * k and set(by) == {i for i, _ in rows}
    signs = np.ones(k)
    for at, (i, _) in enumerate(rows):
        assert set(by[i]) == set(range(1, k + 1))
        for c in range(k):
            r = by[i][c + 1]
            assert (r.n, r.deviation) == (n, deviation[at] if deviation[at] < 2**63 else None)
            if c >= live:
                assert r.whitened is None and r.explained == pytest.approx(0, abs=1e-12)
                continue
            if at == 0:
                signs[c] = np.sign(r.whitened * white[at, c])
            assert r.whitened == pytest.approx(signs[c] * white[at, c], rel=1e-7, abs=1e-7)
            assert r.explained == pytest.approx(explained[c], rel=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_whitening_against_eigenvectors(spark):
    got = queries.op12_whitening(spark, SMALL).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(got, rows)


def test_whitening_of_badly_scaled_and_flat_vectors(spark):
    rng = np.random.default_rng(3)
    scales = 10.0 ** -np.linspace(-4, 2, 12)
    rows = [(i, (rng.normal(size=12) * scales).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    check_whitening(whitening.whiten(df).collect(), rows)
    flat = [(i, [float(v), float(-v), 7.0, float(v * v), 0.5]) for i, v in enumerate(rng.integers(-9, 9, 50).tolist())]
    check_whitening(whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect(), flat, live=2)


def test_whitening_edges(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=10).tolist()) for i in range(60)]
    bad = [(100, None), (101, [None] + [1.0] * 9), (102, [float("nan")] * 10), (103, [float("inf")] + [0.0] * 9), (104, [])]
    schema = "vec_id long, embedding array<double>, n string, component string, dim int"
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows + bad], schema)
    check_whitening(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df.limit(0)).collect() == []
    copies = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(copies) == 8 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (4, 0, None, 0.0, None) for r in copies)
    mixed = whitening.whiten(spark.createDataFrame(rows[:20] + [(500 + i, v[:3]) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    check_whitening([r for r in mixed if r.vec_id < 500], rows[:20])
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(huge).collect()} == {(1, None), (2, None), (3, 3072**2)}


# --- 13 conversations

def legal(letters):
    return re.fullmatch(r"(s?(ua)+)?", letters) is not None


def fault_rows(rows):
    """Rows (turn, role, text) in order -> (role, text, goes, truncated) and counts."""
    seen, out, blank, dup, cut = set(), [], 0, 0, 0
    for _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        if not core:
            out.append((role, text, True, 0))
            blank += 1
        elif (role, text) in seen:
            out.append((role, text, True, 0))
            dup += 1
        else:
            short = core[-1] not in ".!?"
            cut += short
            out.append((role, text, False, int(short)))
        seen.add((role, text))
    return out, blank, dup, cut


def all_audits(rows, most_inserts):
    """Every audit of up to ``most_inserts`` inserts: cost, string, repaired turns (exhaustive)."""
    found = []
    for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(rows) + 1), k) for k in range(most_inserts + 1)):
        for inserted in itertools.product("ua", repeat=len(places)):
            for choice in itertools.product("DKua", repeat=len(rows)):
                cost, audit, roles, turns = 2 * len(places), "", "", []
                at = 0
                for k in range(len(rows) + 1):
                    while at < len(places) and places[at] == k:
                        audit, roles = audit + "I", roles + inserted[at]
                        turns.append(({"u": "user", "a": "assistant"}[inserted[at]], ""))
                        at += 1
                    if k == len(rows):
                        break
                    role, text, goes, short = rows[k]
                    c = choice[k]
                    if c != "D" and goes:
                        break
                    cost += 3 if c == "D" else short + (2 if c in "ua" else 0)
                    audit += {"D": "D", "K": "K"}.get(c, "R")
                    if c != "D":
                        name = role if c == "K" else {"u": "user", "a": "assistant"}[c]
                        roles += name[:1] or "?"
                        turns.append((name, text))
                else:
                    continue
                if k == len(rows) and legal(roles):
                    found.append((cost, audit, turns))
    return min(found, key=lambda f: f[:2])


def plain_audit(rows):
    """The same by carrying whole strings: least (cost, audit) for each state, turns with it."""
    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for q, (cost, audit, turns) in list(best.items()):
                to = conversations.NEXT[q]
                new = (cost + 2, audit + "I", turns + [(conversations.ROLE[to], "")])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {0: (0, "", [])}
    for role, text, goes, short in rows:
        after = {}
        for q, (cost, audit, turns) in inserted(best).items():
            ways = [(q, (cost + 3, audit + "D", turns))]
            if not goes:
                to = conversations.NEXT[q]
                ways.append((to, (cost + 2 + short, audit + "R", turns + [(conversations.ROLE[to], text)])))
                if role[:1] in conversations.KEEP[q]:
                    ways.append((conversations.KEEP[q][role[:1]], (cost + short, audit + "K", turns + [(role, text)])))
            for to, new in ways:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = after
    best = inserted(best)
    return min((best[q] for q in (0, 3) if q in best), key=lambda b: b[:2])


def brute_repair(rows, search=plain_audit):
    """rows (turn, role, text) of one conversation, nulls as spaces already."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    marked, blank, dup, cut = fault_rows(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = search(marked)
    return gaps, blank, dup, cut, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))


def damaged(rows):
    """(conv, turn, role, text) -> rows by conversation after damage, every conversation named."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        out[conv] += []
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def digests(got):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_plain_audit_is_cheapest():
    rng = random.Random(8)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{k}", rng.random() < 0.2, rng.randrange(2)) for k in range(rng.randrange(4))]
        rows = [(r, t, g, 0 if g else s) for r, t, g, s in rows]
        assert all_audits(rows, 3)[:2] == plain_audit(rows)[:2]


def test_damaged_table_against_brute_force(spark):
    got = queries.op13_conversations(spark, "/root/testdata/sf0.01").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: brute_repair(of) for conv, of in damaged(rows).items()}
    assert len(got) == len(want) and digests(got) == want
    assert len({w[6] for w in want.values()}) > 20


def test_random_conversations_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(300):
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            text = rng.choice(["", " ", "ok.", "yes!", "cut off", "one?", "two. ", "é.", "x "]) + ("" if rng.random() < 0.5 else str(rng.randrange(30)))
            rows.append((conv if conv else None, rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(["system", "user", "assistant", "tool", "", None]), text if rng.random() < 0.9 else None))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, kind string, cost string").repartition(5)
    want = {conv: brute_repair(of) for conv, of in damaged(rows).items()}
    assert digests(conversations.audit(conversations.damage(df), dropped_col="dropped").collect()) == want
    spaced = defaultdict(list)
    for conv, turn, role, text in rows:
        spaced[conv].append((turn, " " if role is None else role, " " if text is None else text))
    plain = {conv: brute_repair(of) for conv, of in spaced.items()}
    assert digests(conversations.audit(df).collect()) == plain
    by = defaultdict(list)
    for r in conversations.edits(df).collect():
        by[r.conv_id].append(r)
    for conv, found in by.items():
        found.sort(key=lambda r: r.place)
        assert [r.place for r in found] == list(range(len(found)))
        assert "".join(r.edit for r in found) == plain[conv][6]
        assert sha("\n".join(f"{r.role}:{r.text}" for r in found if r.edit != "D")) == plain[conv][7]


def test_long_conversations_settle():
    """Long ones are committed piece by piece and stay equal to the plain search; the tree stays small."""
    rng = random.Random(6)
    for settle in (1, 7, 256):
        rows = [(rng.choice(["user", "assistant", "assistant", "system"]), f"turn {k}.", rng.random() < 0.1, 0) for k in range(1500)]
        out = []
        repair = conversations.Repair(lambda letter, role, text: out.append((letter, role, text)), settle)
        most = 0
        for role, text, goes, short in rows:
            repair.feed(role, text, goes, short)
            most = max(most, len(repair.pending))
        cost, audit = repair.finish()
        want = plain_audit(rows)
        assert (cost, audit) == want[:2] and [(r, t) for e, r, t in out if e != "D"] == want[2]
        assert most <= settle + 50


def test_audits_are_ordered_as_strings(monkeypatch):
    rng = random.Random(3)
    for prime in (conversations.PRIME, 3):  # with so small a prime nearly all hashes collide
        monkeypatch.setattr(conversations, "PRIME", prime)
        tree, strings = conversations.Audits(), [""]
        for _ in range(400):
            node = rng.randrange(max(0, len(strings) - 40), len(strings))
            letter = rng.choice("DK")
            assert tree.add(node, letter) == len(strings)
            strings.append(strings[node] + letter)
        for _ in range(3000):
            a, b = rng.randrange(len(strings)), rng.randrange(len(strings))
            if strings[a] != strings[b]:
                assert tree.less(a, b) == (strings[a] < strings[b])
        assert tree.text(400) == strings[400]


def test_conversation_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.audit(spark.createDataFrame([], schema)).collect() == []
    gone = spark.createDataFrame([(5, 1, "user", "hi.", True), (5, 2, "user", "hi.", None), (6, 1, "user", "x", True)], schema + ", dropped boolean")
    got = digests(conversations.audit(gone, dropped_col="dropped").collect())
    assert got[6] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got[5] == (0, 0, 0, 0, 0, 2, "KI", sha("user:hi.\nassistant:"))
    wide = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], schema)
    assert digests(conversations.audit(wide).collect())[1][0] == 2**63 - 1
    long = spark.createDataFrame([(1, 0, "user", "a" * 300_000 + "."), (1, 1, "assistant", "b" * 300_000)], schema)
    assert digests(conversations.audit(long).collect())[1][5:7] == (1, "KK")
