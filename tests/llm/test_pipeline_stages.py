"""Each stage of the corpus pipeline against brute force: edge rows, clashing columns, empty tables, whole tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from edge_rows import EDGE
from pyspark.sql import functions as F
from test_llm_operators import classes_by_force, hits_by_force, words_by_force

import corpus_pipeline as pipeline
from driftmark.llm import langid, tables

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents and the edge rows, some of which repeat."""
    small = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    edge = [(None if i is None else i + 100_000, t, "en" if k % 2 else None, "s", None if t is None else len(t)) for k, (i, t) in enumerate(EDGE)]
    return small + edge


def frame(spark, rows):
    """With the columns the operators use as extra columns."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("h1", "h2", "key", "let_through", "component", "spans", "rest", "kept")}).repartition(4)


def found(df):
    assert df.columns == list(pipeline.COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_language_stage(spark, docs):
    df = frame(spark, docs)
    dictionaries = langid.train(df.where(tables.remainder(F.col("doc_id"), 4) != 2))
    compressors = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressors.append(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    want = []
    for i, text, lang, source, n in docs:
        raw = (text or "").lower().encode()
        sizes = [sum(len(c.compress(raw[k:k + (1 << 14)])) for k in range(0, len(raw), 1 << 14)) for c in compressors]
        best = int(np.argmin(sizes))
        second = min(s for k, s in enumerate(sizes) if k != best)
        if any(c.isalpha() for c in text or "") and (second - sizes[best]) / second >= 0.002:
            want.append((i, text, list(dictionaries)[best], source, n))
    assert len(want) > 190
    assert found(pipeline.identify_language(spark, df, SMALL)) == sorted(want, key=str)


def test_near_copies_stage(spark, docs):
    classes = defaultdict(list)
    for row, c in zip(docs, classes_by_force([(r[0], r[1]) for r in docs])):
        classes[c].append(row)
    got = found(pipeline.drop_near_copies(spark, frame(spark, docs), SMALL))
    assert len(got) == len(classes)
    kept = Counter(got)
    for rows in classes.values():
        low = min(rows, key=lambda r: (r[0] is None, r[0] or 0))
        same = [r for r in rows if (r[0], r[1] or "") == (low[0], low[1] or "")]
        assert sum(kept[r] for r in set(same)) == 1


def test_passages_stage(spark, docs):
    unique = list({r[0]: r for r in docs}.values())
    want = {}
    for row, (i, n, removed, digest) in zip(unique, words_by_force([(r[0] if r[0] is not None else 10**9, r[1]) for r in unique], 20)):
        want[row[0]] = (row, removed, digest)
    got = found(pipeline.remove_repeated_passages(spark, frame(spark, unique), SMALL))
    assert len(got) == len(unique)
    import hashlib

    for i, text, lang, source, n in got:
        row, removed, digest = want[i]
        assert (lang, source) == row[2:4]
        if not removed:
            assert (text, n) == (row[1], row[4])
        else:
            assert hashlib.sha256(text.encode()).hexdigest() == digest and n == len(text)
    assert sum(w[1] > 0 for w in want.values()) > 3


def test_benchmark_stage(spark, docs):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    some = docs[:60] + docs[200:]
    hit = [h[2] > 0 for h in hits_by_force([(r[0], (r[1] or "")[:8000]) for r in some], items)]
    short = [r[1] is None or len(r[1]) <= 8000 for r in some]
    some, hit = [r for r, s in zip(some, short) if s], [h for h, s in zip(hit, short) if s]
    got = found(pipeline.drop_contaminated(spark, frame(spark, some), SMALL))
    assert got == sorted((r for r, h in zip(some, hit) if not h), key=str)


def test_packing_stage(spark, docs):
    rows = pipeline.pack_windows(spark, frame(spark, docs), SMALL).toPandas()
    assert rows[rows.start == 0].shape[0] == len(docs)
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 1024


def test_stages_of_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SMALL).collect() == [], name


def test_whole_pipeline(spark):
    """The stages one after another by hand give what run() gives."""
    whole = pipeline.run(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*pipeline.COLUMNS)
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = tables.stored(stage(spark, docs, SMALL), f"test-{name}")
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] and counts[4] < counts[3]
    again = pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert whole.groupby("doc_id").length.sum().to_dict() == again.groupby("doc_id").length.sum().to_dict()
    assert set(zlib.crc32(str(i).encode()) for i in whole.doc_id) == set(zlib.crc32(str(i).encode()) for i in again.doc_id)


def test_sieve_lets_all_keys_through(spark):
    d = spark.range(20_000).select(F.col("id"), F.xxhash64("id").alias("h"))
    keys = d.where("id % 50 = 0")
    for some, most in ((keys, 0.03), (keys.limit(0), 0.0), (d, 1.0)):
        got = tables.sifted(d, "h", tables.sieve(some, "h")).where("let_through")
        assert got.join(some.select("id"), "id", "left_semi").count() == some.count()
        assert got.count() <= max(most * 20_000, some.count())
