"""Work that must not grow faster than the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators import matching as M, pages as P


def plan(df, part="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_page_links_are_found_once(spark):
    """Every step of the category search stands in the plan once, not inlined into a filter below the others."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    rows = spark.range(3).select(F.col("id").alias("page_id"), F.lit("target").alias("store"), F.concat(F.lit('<a href="/c/x">Shop x</a>'), F.col("id").cast("string")).alias("html"))
    found = P.page_categories(rows)
    assert plan(found).count("regexp_extract_all") <= 2
    assert sorted((r.page_id, r.category_url, r.category_name) for r in found.collect()) == [(i, "https://www.target.com/c/x", "shop x") for i in range(3)]


def test_norm_of_a_vector_is_summed_once(spark, tables):
    """The norm is no part of the function that runs for each dimension."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    text = plan(tables.embeddings())
    assert text.count("aggregate(") == 1 and "array_repeat(SQRT" in text and "/ SQRT" not in text


def pairs_by_hand(x, ids, groups, k, threshold):
    sim = np.round(x @ x.T, 8)
    out = set()
    for i in range(len(x)):
        ok = np.flatnonzero((sim[i] >= threshold) & (ids != ids[i]) & ((groups != groups[i]) if groups is not None else True))
        out |= {(ids[i], ids[j], sim[i, j], r + 1) for r, j in enumerate(ok[np.lexsort((ids[ok], -sim[i, ok]))[:k]])}
    return out


@pytest.mark.parametrize("grouped", [False, True])
def test_nearest_of_copies_and_near_ties(spark, grouped):
    """Copies beyond the bound on candidates, similarities closer than single precision, ids out of order, a vector that is null or not finite."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 16))
    x = np.concatenate([x, np.repeat(x[:1], 1500, axis=0), x[1:200] + rng.normal(size=(199, 16)) * 1e-5])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(len(x)) * 3
    groups = np.array([f"s{i % 4}" for i in ids])
    rows = [(int(i), g, v.tolist()) for i, g, v in zip(ids, groups, x)] + [(1, "s1", None), (2, "s1", [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "product_id long, store string, embedding array<double>").repartition(3)
    found = M.knn(df, df, 4, 0.3, block_rows=5000, other_group="store" if grouped else None).collect()
    want = pairs_by_hand(x, ids, groups if grouped else None, 4, 0.3)
    assert {(r.id, r.match_id, r["rank"]) for r in found} == {(a, b, r) for a, b, _, r in want}
    value = {(a, b): s for a, b, s, _ in want}
    assert all(abs(r.similarity - value[r.id, r.match_id]) < 2e-8 for r in found)


def test_block_kernel_compares_few_in_double(spark, monkeypatch):
    """Candidates of a block are found in single precision; only they are compared in double."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4096, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    seen = []
    whole = np.einsum
    monkeypatch.setattr(M.np, "einsum", lambda f, a, b: seen.append(len(a)) or whole(f, a, b))
    ids, groups = np.arange(4096), np.zeros(4096, np.int32)
    got = M._best_pairs(x, ids, groups, x, ids, groups, 10, 0.25, False)
    assert sum(seen) < 20 * 4096 and len(got[0]) == len(pairs_by_hand(x, ids, None, 10, 0.25))


def test_keywords_shuffle_texts_not_words(spark, tables):
    """Documents are dealt by their key once; words, counts and ranks stay where their document is."""
    from driftmark.functions import text as T

    found = T.keywords(tables.raw("documents"), "doc_id", "text")
    assert plan(found, "executedPlan").count("Exchange") == 1
    rows = [(1, "red fox red hen"), (1, "hen hen fox fox owl"), (None, "fox"), (None, "owl owl"), (2, None)]
    got = {r.k: r.keywords for r in T.keywords(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got == {1: ["hen", "fox", "red", "owl"], None: ["owl", "fox"]}


def test_forest_rows_are_computed_once(spark):
    """Fitting reads its rows several times; what they come from runs once."""
    from driftmark.operators import learning as L

    runs = spark.sparkContext.accumulator(0)

    @F.udf("long", useArrow=False)
    def seen(x):
        runs.add(1)
        return x

    rows = spark.range(400, numPartitions=2).withColumn("product_id", seen("id"))
    rows = rows.select("product_id", *[(F.hash("product_id", F.lit(i)) / 2.0**31).alias(c) for i, c in enumerate(L.FEATURES)])
    model = L.fit_forest(rows, ["product_id"])
    assert runs.value == 400
    assert L.fit_forest(rows.limit(L.MIN_ROWS - 1), ["product_id"]) is None
    scored = model.depth_score(rows).select(*L.FEATURES, "isolation").limit(40).collect()
    for r in scored:
        total = 0.0
        for _, g in model.nodes.groupby("tree"):
            nodes, at = {n.node: n for n in g.itertuples()}, 0
            while nodes[at].feature >= 0:
                at = nodes[at].left if r[nodes[at].feature] <= nodes[at].threshold else nodes[at].right
            total += nodes[at].path
        assert abs(r.isolation - 2.0 ** (-total / L.TREES / L.mean_path(256.0))) < 1e-12


def test_mixtures_are_fitted_in_bounded_parts(monkeypatch):
    """Rows are fitted in parts of like length; rounds, and so results, are those of all rows together."""
    from driftmark.operators import learning as L

    rng = np.random.default_rng(5)
    size = rng.integers(15, 51, 700)
    used = np.arange(50) < size[:, None]
    x = np.where(used, np.round(rng.normal(100, 20, (700, 50)), 2), 0.0)
    seen, fit = [], L._fit_rows
    monkeypatch.setattr(L, "_fit_rows", lambda *a: seen.append(a[0].shape) or fit(*a))
    weight, mean, var, history = L.fit_mixture(x, used, 3)
    assert max(n for n, _ in seen) <= L.MIXTURE_ROWS and min(w for _, w in seen) < 50
    w, m, v, whole = fit(x, used, 3, min(len(history), 100), 1e-6)
    for a, b in ((weight, w), (mean, m), (var, v)):
        assert np.allclose(a, b, rtol=1e-6)
    assert np.allclose(np.array(history), whole, atol=1e-9) and abs(weight.sum(axis=1) - 1).max() < 1e-6
    *_, one = L.fit_mixture(x, used, 1)
    assert len(one) <= 4  # a single component is at rest after two rounds
