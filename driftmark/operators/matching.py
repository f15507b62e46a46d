"""Product matching by embedding similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from driftmark import params
from driftmark.functions import text as T

MATCH_SCHEMA = "id long, match_id long, similarity double"
DIMENSIONS = 256


def embedding_text(title: Column) -> Column:
    return T.clean_title(title)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hashed_vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Offline stand-in for a sentence model: normalised counts of hashed words and letter triples.

    A model is plugged in by passing another iterator function to ``embed_text``; it is set up once
    per Python worker, before the first batch.
    """
    import zlib

    for batch in texts:
        out = []
        for text in batch:
            vec = np.zeros(DIMENSIONS)
            for word in (text or "").lower().split():
                padded = f"#{word}#"
                for gram in [word] + [padded[i:i + 3] for i in range(len(padded) - 2)]:
                    code = zlib.crc32(gram.encode())
                    vec[code % DIMENSIONS] += 1.0 if code & (1 << 20) else -1.0
            norm = np.linalg.norm(vec)
            out.append((vec / norm if norm else vec).astype(np.float32).tolist())
        yield pd.Series(out)


def embed_text(products: DataFrame, known: DataFrame | None = None, model=hashed_vectors, model_name: str = "hashed") -> DataFrame:
    """One vector per product with a title; equal texts are embedded once.

    ``known`` holds ``text_hash, embedding`` computed earlier.
    """
    from pyspark.sql.types import ArrayType, FloatType

    run = F.pandas_udf(model, ArrayType(FloatType()))
    texts = products.select("product_id", embedding_text(F.col("title")).alias("text")).filter(F.length(F.trim("text")) > 0)
    texts = texts.withColumn("text_hash", text_hash(F.col("text")))
    todo = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    if known is not None:
        todo = todo.join(known.select("text_hash"), "text_hash", "left_anti")
    fresh = todo.select("text_hash", run("text").alias("embedding"))
    vectors = fresh if known is None else fresh.unionByName(known.select("text_hash", "embedding"))
    return texts.join(vectors, "text_hash").select("product_id", F.lit(model_name).alias("model_name"), "text_hash", "embedding")


def embedding_backlog(products: DataFrame, stored: DataFrame, model_name: str) -> DataFrame:
    """Products with a text whose embedding is missing or was made from another text."""
    texts = products.select("product_id", embedding_text(F.col("title")).alias("text")).filter(F.length(F.trim("text")) > 0)
    texts = texts.withColumn("model_name", F.lit(model_name)).withColumn("text_hash", text_hash(F.col("text")))
    return texts.join(stored.select("product_id", "model_name", "text_hash"), ["product_id", "model_name", "text_hash"], "left_anti")


def upsert_embeddings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Last write wins per product and model."""
    cols = [c for c in stored.columns if c not in ("product_id", "model_name")]
    both = stored.unionByName(new.select(*stored.columns))
    top = F.max(F.struct("updated_at", *[c for c in cols if c != "updated_at"])).alias("t")
    return both.groupBy("product_id", "model_name").agg(top).select("product_id", "model_name", "t.*")


def _exact_best(a: np.ndarray, b: np.ndarray, rid: np.ndarray, barred: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every row of ``a`` over all of ``b``, in double throughout: ``row, column, similarity``."""
    sim = np.round(a @ b.T, 8)
    ok = (sim >= threshold) & ~barred
    rows, cols, sims = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for i in np.flatnonzero(ok.any(axis=1)):
        hits = np.flatnonzero(ok[i])
        if len(hits) > k:
            hits = hits[sim[i, hits] >= np.partition(sim[i, hits], -k)[-k]]
        best = hits[np.lexsort((rid[hits], -sim[i, hits]))[:k]]
        rows.append(np.full(len(best), i))
        cols.append(best)
        sims.append(sim[i, best])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)


def _best_pairs(a: np.ndarray, lid: np.ndarray, lg: np.ndarray, b: np.ndarray, rid: np.ndarray, rg: np.ndarray, k: int, threshold: float, other_group: bool, width: int = 64):
    """Similarities of one block against another: per left row its k best at or above the threshold.

    Single precision, whose error is bounded, finds the few columns that can be among the k best; these are then
    compared in double.  The bound of a row is the k-th largest of the greatest values of ``width`` columns each, taken at even
    distances: as many columns are at least as similar.  A row with very many columns at the bound (copies) is compared in double as a whole.
    """
    fa, fb = np.isfinite(a).all(axis=1), np.isfinite(b).all(axis=1)
    a, lid, lg, b, rid, rg = a[fa], lid[fa], lg[fa], b[fb], rid[fb], rg[fb]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(a) or not len(b):
        return none
    order = np.argsort(rid, kind="stable")
    b, rid, rg = b[order], rid[order], rg[order]
    longest = float(np.sqrt((a * a).sum(axis=1).max() * (b * b).sum(axis=1).max()))
    slack = 2.0 * (a.shape[1] + 2) * 2.0 ** -24 * longest
    a32, b32 = a.astype(np.float32), b.astype(np.float32).T
    whole = len(b) // width * width
    many = max(64 * k, 1024)
    found = []
    for start in range(0, len(a), 256):
        stop = min(start + 256, len(a))
        sim = a32[start:stop] @ b32
        low, high = np.searchsorted(rid, lid[start:stop]), np.searchsorted(rid, lid[start:stop], "right")
        own = np.repeat(np.arange(stop - start), high - low), np.concatenate([np.arange(x, y) for x, y in zip(low, high)])
        if other_group:
            np.copyto(sim, -np.inf, where=lg[start:stop, None] == rg[None, :])
        sim[own] = -np.inf
        bound = np.full(stop - start, threshold - slack)
        if whole >= k * width:
            tops = sim[:, :whole].reshape(stop - start, width, -1).max(axis=1)
            bound = np.maximum(bound, np.partition(tops, -k, axis=1)[:, -k] - 2 * slack)
        near = sim >= (bound - 1e-7).astype(np.float32)[:, None]
        crowded = np.flatnonzero(np.count_nonzero(near, axis=1) > many)
        near[crowded] = False
        rows, cols = np.divmod(np.flatnonzero(near), len(b))
        exact = np.round(np.einsum("ij,ij->i", a[start + rows], b[cols]), 8)
        ok = exact >= threshold
        rows, cols, exact = rows[ok], cols[ok], exact[ok]
        best = np.lexsort((cols, -exact, rows))
        rows, cols, exact = rows[best], cols[best], exact[best]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((lid[start + rows[first]], rid[cols[first]], exact[first]))
        for at in range(0, len(crowded), 32):
            part = crowded[at:at + 32]
            i, j, s = _exact_best(a[start + part], b, rid, np.isneginf(sim[part]), k, threshold)
            found.append((lid[start + part[i]], rid[j], s))
    return tuple(np.concatenate(x) for x in zip(*found))


def _match(left: DataFrame, right: DataFrame, keys: list[str], k: int, threshold: float, other_group: bool) -> DataFrame:
    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = [(matrix(x["v"], len(x)), x["id"].to_numpy()) for x in (a, b)]
        groups = pd.factorize(np.concatenate([x["g"].to_pandas().to_numpy(object) for x in (a, b)]), use_na_sentinel=False)[0].astype(np.int32)
        pairs = _best_pairs(*sides[0], groups[:len(a)], *sides[1], groups[len(a):], k, threshold, other_group)
        return pa.table(dict(zip(("id", "match_id", "similarity"), pairs)))

    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, MATCH_SCHEMA)
    best = W.partitionBy("id").orderBy(F.desc("similarity"), "match_id")
    # dealt by id first: pairs that met twice and the ranking both need no other shuffle
    ranked = pairs.repartition("id").dropDuplicates(["id", "match_id"]).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k)


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    if not rows:
        return np.zeros((0, 0))
    values = pa.concat_arrays([c.flatten() for c in column.chunks])
    return values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(rows, -1)


def _vectors(df: DataFrame, group: str | None) -> DataFrame:
    g = F.col(group).cast("string") if group else F.lit("")
    return df.select(F.col("product_id").alias("id"), F.col("embedding").alias("v"), g.alias("g"))


def knn(queries: DataFrame, index: DataFrame, k: int, threshold: float, block_rows: int = 32768, other_group: str | None = None) -> DataFrame:
    """Exact k nearest by cosine similarity over normalised vectors; a row without a vector has none and is none.

    Both sides are cut into hash blocks of at most about ``block_rows``, counted first, and of a sixteenth of that where
    this gives fewer than six; every pair of blocks is one task that multiplies two matrices and emits at most k rows per
    query, so neither a cross join nor all pairs appear and a task's memory does not grow with the tables.  A row travels
    once for each block of the other side.  The work is quadratic by nature; see ``InvertedFile`` for large tables.
    """
    rows = max(queries.count(), index.count())
    blocks = max(1, -(-rows // block_rows), min(6, -(-16 * rows // block_rows)))
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    a = _vectors(queries, other_group).filter(F.col("v").isNotNull()).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("ib", F.explode(numbers))
    b = _vectors(index, other_group).filter(F.col("v").isNotNull()).withColumn("ib", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(numbers))
    return _match(a, b, ["qb", "ib"], k, threshold, other_group is not None)


def signatures(vectors: DataFrame, dims: int, tables: int, bits: int, seed: int = 42) -> DataFrame:
    """Random-hyperplane bucket of every vector in every hash table."""
    from pyspark.sql.types import ArrayType, LongType

    planes = np.random.default_rng(seed).normal(size=(dims, tables * bits))

    @F.pandas_udf(ArrayType(LongType()))
    def bucket(v: pd.Series) -> pd.Series:
        on = (np.stack(v.to_numpy()) @ planes > 0).reshape(len(v), tables, bits)
        return pd.Series((on @ (1 << np.arange(bits))).tolist())

    return vectors.select("*", F.posexplode(bucket("v")).alias("table", "bucket"))


def approximate_knn(
    queries: DataFrame, index: DataFrame, k: int, threshold: float, dims: int, tables: int = 16, bits: int = 8,
    block_rows: int = 5000, other_group: str | None = None,
) -> DataFrame:
    """Candidates that share a hash bucket, ranked by exact similarity.

    A crowded bucket is split: its index rows are spread over as many salts as it needs for blocks
    of ``block_rows``, and its query rows visit each salt in blocks of their own.
    """
    a = signatures(_vectors(queries, other_group), dims, tables, bits)
    b = signatures(_vectors(index, other_group), dims, tables, bits)

    def parts(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("table", "bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    sizes = parts(a, "qn").join(parts(b, "inn"), ["table", "bucket"])

    def spread(d: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        own_sizes = sizes.select("table", "bucket", *[F.col(c).alias(f"{own}_{c}") for c in ("qn", "inn")])
        n_own, n_other = f"{own}_{n_own}", f"{own}_{n_other}"
        d = d.join(own_sizes, ["table", "bucket"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))

    left = spread(a, "qb", "qn", "ib", "inn")
    right = spread(b, "ib", "inn", "qb", "qn")
    return _match(left, right, ["table", "bucket", "qb", "ib"], k, threshold, other_group is not None)


class InvertedFile:
    """Vectors stored by k-means cell, searched in the cells nearest to a query.

    ``path`` holds two tables: ``cells`` (cell, centre, rows, blocks) and ``vectors`` (id, v, g, block, partitioned by
    cell).  A cell is cut into blocks of about ``block_rows`` by a hash of the id, so no task holds a whole crowded one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.vectors = spark.read.parquet(f"{path}/vectors")
        self.cells = spark.read.parquet(f"{path}/cells")
        found = self.cells.select("cell", "centre").orderBy("cell").collect()  # as many as cells were asked for
        self.numbers = np.array([r.cell for r in found], np.int64)
        self.centres = np.array([r.centre for r in found], float)

    @staticmethod
    def centres_of(vectors: DataFrame, cells: int, sample: int, seed: int) -> np.ndarray:
        """Centres by k-means on the cosine, fitted in Spark on about ``sample`` vectors of lowest hash."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        total = vectors.count()
        low = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < min(1.0, sample / max(total, 1)) * (1 << 20)
        some = vectors.filter(low).select(array_to_vector("v").alias("features"))
        model = KMeans(k=cells, distanceMeasure="cosine", maxIter=15, seed=seed).fit(some)
        centres = np.array(model.clusterCenters())
        return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    @classmethod
    def build(cls, index: DataFrame, path: str, group: str | None = None, cells: int = 64, block_rows: int = 5000, sample: int = 100_000, seed: int = 42) -> InvertedFile:
        """Stores ``product_id, embedding`` (normalised) and, given, a group of every row of ``index``."""
        rows = _vectors(index, group).filter(F.col("v").isNotNull())
        centres = cls.centres_of(rows, cells, sample, seed)
        placed = rows.withColumn("cell", F.element_at(_nearest(centres, np.arange(len(centres)), 1)("v"), 1))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
        spark = index.sparkSession
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell long, centre array<double>")
        table.join(sizes, "cell").write.parquet(f"{path}/cells")
        blocks = spark.read.parquet(f"{path}/cells").select("cell", "blocks")
        blocked = placed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        blocked.drop("blocks").hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/vectors")
        return cls(spark, path)

    def knn(self, queries: DataFrame, k: int, threshold: float, probes: int = 8, block_rows: int = 32768, other_group: str | None = None) -> DataFrame:
        """The k best of each query among the rows of its ``probes`` nearest cells, with exact similarities.

        Stored blocks of a cell are searched together, up to about ``block_rows``, by as many queries at a time.
        """
        nearest = _nearest(self.centres, self.numbers, probes)
        a = _vectors(queries, other_group).filter(F.col("v").isNotNull()).withColumn("cell", F.explode(nearest("v")))
        asked = a.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("asked"))
        sizes = self.cells.select("cell", F.ceil(F.col("rows") / block_rows).cast("int").alias("parts")).join(asked, "cell")
        parts = F.sequence(F.lit(0), F.col("parts") - 1)
        left = a.join(sizes, "cell").select("id", "v", "g", "cell", F.pmod(F.xxhash64("id"), F.col("asked")).cast("int").alias("qb"), F.explode(parts).alias("part"))
        renamed = sizes.select(F.col("cell").alias("_cell"), F.col("asked").alias("_asked"), F.col("parts").alias("_parts"))
        held = self.vectors.select("id", "v", "g", F.col("cell").cast("long").alias("cell"), "block").join(renamed, F.col("cell") == F.col("_cell"))
        right = held.select("id", "v", "g", "cell", (F.col("block") % F.col("_parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("_asked") - 1)).alias("qb"))
        return _match(left, right, ["cell", "part", "qb"], k, threshold, other_group is not None)


def _nearest(centres: np.ndarray, numbers: np.ndarray, probes: int):
    """The ``probes`` cells nearest to a vector, nearest first; the centres are few and travel with the function."""
    from pyspark.sql.types import ArrayType, LongType

    @F.pandas_udf(ArrayType(LongType()))
    def cells(v: pd.Series) -> pd.Series:
        near = np.stack(v.to_numpy()) @ centres.T
        return pd.Series(numbers[np.argsort(-near, axis=1, kind="stable")[:, :probes]].tolist())

    return cells


def recall(found: DataFrame, exact: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """One row: how many exact matches there are, the share of them that were found and how many with another similarity."""
    mine = found.select("id", "match_id", F.lit(True).alias("hit"), F.col("similarity").alias("_found"))
    hits = exact.select("id", "match_id", "similarity").join(mine, ["id", "match_id"], "left")
    share = F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0))
    return hits.agg(F.count("*").alias("pairs"), share.alias("recall"), F.count_if(F.abs(F.col("similarity") - F.col("_found")) > tolerance).alias("differing"))


def match_confidence(similarity: Column, price_a: Column, price_b: Column, msrp_a: Column, msrp_b: Column) -> Column:
    """Similarity, plus closeness of the prices, plus equal MSRP, within 0 and 1."""
    a, b = (F.nullif(p.cast("double"), F.lit(0.0)) for p in (price_a, price_b))
    ratio = F.abs(a - b) / F.nullif((a + b) / 2, F.lit(0.0))
    close = F.when(ratio < 0.1, 0.1).when(ratio < 0.2, 0.05).otherwise(0.0)
    ma, mb = (F.nullif(m.cast("double"), F.lit(0.0)) for m in (msrp_a, msrp_b))
    same = F.when(F.abs(ma - mb) < 0.01, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), similarity + close + same))


def match_edges(matches: DataFrame) -> DataFrame:
    """Undirected edges, smaller id first, the best score of each."""
    return matches.groupBy(
        F.least("id", "match_id").alias("product_id_1"), F.greatest("id", "match_id").alias("product_id_2")
    ).agg(F.max("similarity").alias("similarity"))


def with_details(matches: DataFrame, products: DataFrame) -> DataFrame:
    """Both products' facts next to each match."""
    facts = products.select("product_id", "store", "sku", "title", "msrp", "baseline_price")
    a = facts.toDF(*[f"a_{c}" for c in facts.columns])
    b = facts.toDF(*[f"b_{c}" for c in facts.columns])
    return matches.join(a, F.col("id") == F.col("a_product_id")).join(b, F.col("match_id") == F.col("b_product_id"))


def cross_store_match(pairs: DataFrame, top_matches: DataFrame, depth: int = 5) -> DataFrame:
    """Pairs whose second product is among the first ``depth`` matches of the first."""
    top = top_matches.filter(F.col("rank") <= depth).select("id", "match_id")
    return pairs.join(top, (F.col("product_1") == F.col("id")) & (F.col("product_2") == F.col("match_id")), "left_semi")


def semantic_duplicates(alerts: DataFrame, edges: DataFrame, ttl_hours: int = params.DEDUPE_TTL_HOURS) -> DataFrame:
    """Alerts kept when no similar product was alerted within the time before them.

    Time is cut into slices of the TTL; each product's alerts are counted per slice with those of the
    slice before as context.
    """
    span = ttl_hours * 3600
    sec = F.unix_micros(F.col("sent_at").cast("timestamp"))
    slice_ = F.floor(sec / (span * 1_000_000))
    both = edges.select(F.col("product_id_1").alias("p"), F.col("product_id_2").alias("q")).unionByName(
        edges.select(F.col("product_id_2").alias("p"), F.col("product_id_1").alias("q"))
    )
    probe = alerts.select("alert_id", "product_id", sec.alias("at"), slice_.alias("s")).join(both, F.col("product_id") == F.col("p"))
    probe = probe.select("q", "s", "at", "alert_id", F.lit(0).alias("past"))
    past = alerts.select(F.col("product_id").alias("q"), sec.alias("at"), slice_.alias("s")).distinct()
    past = past.select("q", F.explode(F.array("s", F.col("s") + 1)).alias("s"), "at", F.lit(None).cast("long").alias("alert_id"), F.lit(1).alias("past"))
    # how many alerts of the similar product lie within the time before: a count, never the pairs
    before = W.partitionBy("q", "s").orderBy("at").rangeBetween(-(span * 1_000_000 - 1), -1)
    seen = probe.unionByName(past).withColumn("near", F.sum("past").over(before))
    doomed = seen.filter(F.col("alert_id").isNotNull() & (F.col("near") > 0)).select("alert_id").distinct()
    return alerts.join(doomed, "alert_id", "left_anti")


def product_sets(products: DataFrame, dependents: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Products and dependent tables without the rows of the removed products."""
    gone = doomed.select("product_id").distinct()
    out = {"products": products.join(gone, "product_id", "left_anti")}
    for name, df in dependents.items():
        out[name] = df.join(gone, "product_id", "left_anti")
    return out
