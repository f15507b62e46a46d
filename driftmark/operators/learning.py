"""Learned price anomaly scores: isolation forest, mixture density, reconstruction error."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from driftmark.operators.baseline import recent_with_current
from driftmark.session import stored

# Forest size and sample, expected share of anomalies, seed, least rows.
TREES, SAMPLE, CONTAMINATION, SEED, MIN_ROWS = 100, 256, 0.05, 42, 100
FEATURES = ("f_ratio", "f_discount", "f_stability", "f_min_distance", "f_range")
TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double, rows int"


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


def tree_samples(rows: DataFrame, key: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The rows of each tree: the ``sample`` rows with the smallest seeded hash among those it is offered.

    Large inputs are first thinned by hash to a quarter more rows than all trees together need, each
    offered to one tree; small inputs are offered to several trees, at most to all.  The rows shuffled
    are bounded by the forest's size whatever the input's.
    """
    n = rows.agg(F.count("*")).scalar()
    wanted = F.lit(1.25 * trees * sample) / F.nullif(n, F.lit(0))
    share = F.least(F.lit(1.0), wanted)
    copies = F.least(F.lit(trees), F.greatest(F.lit(1), F.ceil(wanted))).cast("int")
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30))
    thin = rows.filter(draw / float(1 << 30) < share).withColumn("_c", F.explode(F.sequence(F.lit(0), copies - 1)))
    start = F.pmod(F.xxhash64(*key, F.lit(seed + 1)), F.lit(trees))
    thin = thin.withColumn("tree", ((start + F.col("_c")) % trees).cast("int")).drop("_c")
    w = W.partitionBy("tree").orderBy(F.xxhash64(*key, "tree"), *key)
    return thin.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample).drop("_r")


def grow_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree over its sample, as a table of nodes."""
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(SEED + tree)
    data = pdf.sort_values(list(FEATURES))[list(FEATURES)].to_numpy(dtype=float)
    deepest = int(np.ceil(np.log2(max(len(data), 2))))
    nodes: list[list] = []

    def grow(x: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, depth + mean_path(len(x)), len(x)])
        low, high = x.min(axis=0), x.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth < deepest and len(x) > 1 and len(usable):
            f = int(rng.choice(usable))
            cut = float(min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f])))
            on_left = x[:, f] <= cut
            nodes[me][2:6] = [f, cut, grow(x[on_left], depth + 1), grow(x[~on_left], depth + 1)]
        return me

    grow(data, 0)
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path", "rows"])


def forest_table(rows: DataFrame, key: list[str]) -> DataFrame:
    """Node table of the trees, one tree per task."""
    return tree_samples(rows, key).groupBy("tree").applyInPandas(grow_tree, TREE_SCHEMA)


@dataclass
class Forest:
    """A fitted forest; ``nodes`` is its table, at most trees x (2 x sample - 1) rows."""

    nodes: pd.DataFrame
    cut: float

    def _arrays(self):
        """Trees as arrays: a leaf leads to itself, so all rows take as many steps as the tree is deep."""
        trees = []
        for _, g in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            feature, left, right = (g[c].to_numpy() for c in ("feature", "left", "right"))
            leaf, own, depth = feature < 0, np.arange(len(g)), np.zeros(len(g), int)
            for node in np.flatnonzero(~leaf):  # children come after their parent
                depth[left[node]] = depth[right[node]] = depth[node] + 1
            children = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).ravel().astype(np.intp)
            trees.append((np.where(leaf, 0, feature).astype(np.intp), g["threshold"].to_numpy(), children, g["path"].to_numpy(), int(depth.max())))
        return trees, mean_path(float(self.nodes[self.nodes["node"] == 0]["rows"].max()))

    def depth_score(self, df: DataFrame) -> DataFrame:
        """Adds ``isolation``: near 1 for rows that are cut off early."""
        shared = df.sparkSession.sparkContext.broadcast(self._arrays())

        @F.pandas_udf(DoubleType())
        def isolation(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
            trees, unit = shared.value
            x = np.column_stack([a, b, c, d, e]).astype(float)
            total = np.zeros(len(x))
            values, begin = x.ravel(), np.arange(len(x)) * x.shape[1]
            for feature, threshold, children, path, steps in trees:
                at = np.zeros(len(x), np.intp)
                for _ in range(steps):
                    go_right = ~(values.take(begin + feature.take(at)) <= threshold.take(at))
                    at = children.take(2 * at + go_right)
                total += path.take(at)
            return pd.Series(2.0 ** (-total / len(trees) / unit))

        return df.withColumn("isolation", isolation(*FEATURES))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``isolation_score`` within 0 and 1 and ``isolation_hit``."""
        d = self.depth_score(df)
        raw = F.col("isolation") - self.cut
        return d.withColumns({
            "isolation_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw + 0.5)), "isolation_hit": raw > 0,
        })


def tree_checks(nodes: DataFrame) -> DataFrame:
    """Per tree: its rows, whether leaves are one more than splits, and whether the rows of children add up everywhere."""
    child = nodes.select(F.col("tree").alias("c_tree"), F.col("node").alias("c_node"), F.col("rows").alias("c_rows"))
    inner = nodes.filter(F.col("feature") >= 0).withColumn("c", F.explode(F.array("left", "right")))
    added = inner.join(child, (F.col("tree") == F.col("c_tree")) & (F.col("c") == F.col("c_node"))).groupBy("tree", "node", "rows").agg(F.sum("c_rows").alias("below"))
    wrong = added.groupBy("tree").agg(F.count_if(F.col("rows") != F.col("below")).alias("wrong"))
    shape = nodes.groupBy("tree").agg(F.max(F.when(F.col("node") == 0, F.col("rows"))).alias("rows"), (F.count_if(F.col("feature") < 0) == F.count_if(F.col("feature") >= 0) + 1).alias("leaves_fit"))
    return shape.join(wrong, "tree", "left").select("tree", "rows", "leaves_fit", (F.coalesce("wrong", F.lit(0)) == 0).alias("rows_add_up"))


def isolation_by_expression(rows: DataFrame, nodes: pd.DataFrame) -> DataFrame:
    """Adds ``isolation_again``: the score of ``Forest.depth_score``, by walking the node table in expressions.

    The table is one row of a bounded number of nodes.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(nodes.sort_values(["tree", "node"]), TREE_SCHEMA)
    node = F.struct("node", "feature", "threshold", "left", "right", "path")
    trees = table.groupBy("tree").agg(F.sort_array(F.collect_list(node)).alias("nodes")).agg(F.collect_list("nodes")).scalar()
    unit = mean_path(float(nodes[nodes["node"] == 0]["rows"].max()))
    deepest = int(np.ceil(np.log2(SAMPLE))) + 1
    x = F.array(*[F.col(c).cast("double") for c in FEATURES])

    def walked(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            n = F.get(tree, at)
            return F.when(n["feature"] < 0, at).when(F.get(F.col("_x"), n["feature"]) <= n["threshold"], n["left"]).otherwise(n["right"])

        return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), F.lit(0), step))["path"]

    d = rows.withColumns({"_trees": trees, "_x": x})
    total = F.aggregate(F.transform("_trees", walked), F.lit(0.0), lambda a, p: a + p)
    return d.withColumn("isolation_again", F.pow(F.lit(2.0), -total / F.size("_trees") / unit)).drop("_trees", "_x")


def fit_forest(rows: DataFrame, key: list[str]) -> Forest | None:
    """Trains on feature rows; None below the least count. Runs jobs, as every fit does.

    Only the node table, whose size is bounded by the forest's, and one quantile reach the driver.  The rows are read
    four times, so they are stored once with what is used of them.
    """
    rows = stored(rows.select(*key, *FEATURES), "forest-rows")
    if rows.limit(MIN_ROWS).count() < MIN_ROWS:
        return None
    model = Forest(forest_table(rows, key).toPandas(), 0.0)
    cut = model.depth_score(rows).agg(F.percentile_approx("isolation", 1.0 - CONTAMINATION, 10000).alias("q")).first()["q"]
    return Forest(model.nodes, float(cut))


MIXTURE = StructType([
    StructField("log_prob", DoubleType()), StructField("threshold", DoubleType()), StructField("score", DoubleType()),
    StructField("is_anomaly", BooleanType()), *[StructField(c, ArrayType(DoubleType())) for c in ("weights", "means", "variances")],
])


MIXTURE_ROWS = 128  # rows fitted together: their arrays stay in a core's cache


def fit_mixture(x: np.ndarray, used: np.ndarray, k: int, rounds: int = 100, ridge: float = 1e-6):
    """Expectation maximisation of 1-D mixtures for many rows at once; means start at quantiles.

    All rows take as many rounds: up to the first in which no row's likelihood moves.  Rows are fitted in parts of like
    length, each by itself; only where the rounds end early are the parts fitted again for so many.
    """
    order = np.argsort(used.sum(axis=1), kind="stable")
    parts = [order[i:i + MIXTURE_ROWS] for i in range(0, len(order), MIXTURE_ROWS)]

    def fitted(limit: int):
        out, likes = [np.empty((len(x), k)) for _ in range(3)], np.empty((limit, len(x)))
        for rows in parts:
            width = int(used[rows].any(axis=0).nonzero()[0].max()) + 1
            found = _fit_rows(x[rows, :width], used[rows, :width], k, limit, ridge)
            likes[:, rows] = found[3]
            for whole, part in zip(out, found):
                whole[rows] = part
        return out, likes

    for limit in sorted({min(8, rounds), rounds}):  # a single component rests after two
        params, likes = fitted(limit)
        still = np.flatnonzero(np.abs(np.diff(likes, axis=0)).max(axis=1) < 1e-6)
        if len(still):
            break
    if len(still):  # the round that shows no move changes nothing any more
        params, likes = fitted(int(still[0]) + 1)[0], likes[:int(still[0]) + 2]
    return *params, list(likes)


def _fit_rows(x: np.ndarray, used: np.ndarray, k: int, rounds: int, ridge: float):
    """Weights, means and variances after so many rounds, and the mean log likelihood of every row before each round."""
    n = used.sum(axis=1)
    ordered = np.sort(np.where(used, x, np.inf), axis=1)
    spots = np.floor((np.arange(k) + 0.5) / k * n[:, None]).astype(int)
    mean = np.take_along_axis(ordered, spots, axis=1)
    center = np.where(used, x, 0.0).sum(axis=1) / n
    var = np.repeat((np.where(used, (x - center[:, None]) ** 2, 0.0).sum(axis=1) / n + ridge)[:, None], k, axis=1)
    weight = np.full((len(x), k), 1.0 / k)
    likes = np.empty((rounds, len(x)))
    # one component after the other: long runs of memory, and each exponential is taken once
    for turn in range(rounds):
        with np.errstate(divide="ignore"):
            shift = np.log(weight) - 0.5 * np.log(2 * np.pi * var)
        dens = [shift[:, c, None] - 0.5 * (x - mean[:, c, None]) ** 2 / var[:, c, None] for c in range(k)]
        top = dens[0] if k == 1 else np.maximum.reduce(dens)
        raised = [np.exp(d - top) for d in dens]
        total = sum(raised[1:], raised[0])
        likes[turn] = np.where(used, top + np.log(total), 0.0).sum(axis=1) / n
        share = used / total
        resp = [r * share for r in raised]
        mass = np.stack([r.sum(axis=1) for r in resp], axis=1) + 1e-12
        weight = mass / n[:, None]
        mean = np.stack([(r * x).sum(axis=1) for r in resp], axis=1) / mass
        var = np.stack([(r * (x - mean[:, c, None]) ** 2).sum(axis=1) for c, r in enumerate(resp)], axis=1) / mass + ridge
    return weight, mean, var, likes


def log_parts(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        logw = np.log(weight)
    return logw[:, None, :] - 0.5 * (np.log(2 * np.pi * var)[:, None, :] + (x[..., None] - mean[:, None, :]) ** 2 / var[:, None, :])


def log_density(x, weight, mean, var) -> np.ndarray:
    parts = log_parts(x, weight, mean, var)
    top = parts.max(axis=2, keepdims=True)
    return top[..., 0] + np.log(np.exp(parts - top).sum(axis=2))


@F.pandas_udf(MIXTURE)
def mixture_score(prices: pd.Series, current: pd.Series) -> pd.DataFrame:
    """Is the current price less likely than a tenth of the recent prices under their own mixture?"""
    out = pd.DataFrame(index=prices.index, columns=MIXTURE.names, dtype=object)
    sizes = prices.map(len)
    components = np.minimum(3, sizes // 5)
    for k in sorted(set(components)):
        rows = components[components == k].index
        width = int(sizes[rows].max())
        x = np.zeros((len(rows), width))
        used = np.zeros((len(rows), width), dtype=bool)
        for i, r in enumerate(rows):
            x[i, :sizes[r]], used[i, :sizes[r]] = prices[r], True
        w, m, v, _ = fit_mixture(x, used, int(k))
        past = np.where(used, log_density(x, w, m, v), np.nan)
        cut = np.nanpercentile(past, 10, axis=1)
        now = log_density(current[rows].to_numpy(dtype=float)[:, None], w, m, v)[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.clip(np.where(cut < 0, 1.0 - (now - cut) / np.abs(cut), 0.5), 0.0, 1.0)
        out.loc[rows, "log_prob"], out.loc[rows, "threshold"] = now, cut
        out.loc[rows, "score"], out.loc[rows, "is_anomaly"] = score, now < cut
        for name, values in (("weights", w), ("means", m), ("variances", v)):
            out.loc[rows, name] = pd.Series(list(values), index=rows)
    return out.astype({"log_prob": float, "threshold": float, "score": float, "is_anomaly": bool})


def fitted_mixtures(observations: DataFrame, order, newest: int = 50, least: int = 10) -> DataFrame:
    """The ``prices`` (50 at most) before each product's newest one, from ten on, with the ``mixture`` fitted to them."""
    recent = recent_with_current(observations, order, newest)
    lists = recent.groupBy("product_id", "current_price").agg(F.sort_array(F.collect_list(F.col("price").cast("double"))).alias("prices"))
    return lists.filter(F.size("prices") >= least).withColumn("mixture", mixture_score("prices", F.col("current_price").cast("double")))


def mixture_detector(observations: DataFrame, order, newest: int = 50, least: int = 10) -> DataFrame:
    """Mixture score of each product's newest price over the 50 before it, from ten on."""
    parts = [f"mixture.{c}" for c in ("log_prob", "threshold", "score", "is_anomaly")]
    return fitted_mixtures(observations, order, newest, least).select("product_id", "current_price", *parts)


def mixture_log_density(x: Column, mixture: Column) -> Column:
    """Log density of a value under a fitted mixture, as an expression."""
    def part(w: Column, mv: Column) -> Column:
        return F.log(w) - F.lit(0.5) * (F.log(2 * np.pi * mv["v"]) + (x - mv["m"]) * (x - mv["m"]) / mv["v"])

    shapes = F.zip_with(mixture["means"], mixture["variances"], lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    logs = F.zip_with(mixture["weights"], shapes, part)
    top = F.array_max(logs)
    return top + F.log(F.aggregate(logs, F.lit(0.0), lambda a, p: a + F.exp(p - top)))


FEATURE_COUNT = 28


def reconstruction_detector(observations: DataFrame, order, newest: int = 100, compared: int = 30, least: int = 10) -> DataFrame:
    """Squared distance of the features from their mean over the newest 30 rows, against its 90th percentile.

    Of a product's features only deviation, percentile and relative deviation change from row to row;
    the others equal their mean and add nothing.  Each product has at most 100 rows here.
    """
    rows = recent_with_current(observations, order, newest)
    p = F.col("price").cast("double")
    whole = W.partitionBy("product_id")
    upto = whole.orderBy("price").rangeBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({
        "_n": F.count("*").over(whole), "_mean": F.avg(p).over(whole), "_std": F.stddev_pop(p).over(whole), "_below": F.count("*").over(upto),
    })

    def features(price: Column, share: Column) -> dict[str, Column]:
        off = price - F.col("_mean")
        return {"z": off / F.greatest("_std", F.lit(0.01)), "q": share, "d": off / F.greatest("_mean", F.lit(0.01))}

    rows = rows.withColumns({f"_{k}": v for k, v in features(p, F.col("_below") / F.col("_n")).items()})
    now = rows.groupBy("product_id", "current_price").agg(
        F.first("_n").alias("_n"), F.first("_mean").alias("_mean"), F.first("_std").alias("_std"),
        (F.count_if(F.col("price") <= F.col("current_price")) / F.count("*")).alias("_share"),
    )
    now = now.withColumns({f"c_{k}": v for k, v in features(F.col("current_price").cast("double"), F.col("_share")).items()})
    last = rows.filter(F.col("newest_rank") <= compared)
    means = last.groupBy("product_id").agg(F.count("*").alias("m"), *[F.avg(f"_{k}").alias(f"m_{k}") for k in "zqd"]).filter(F.col("m") >= least)

    def error(prefix: str) -> Column:
        return sum(((F.col(f"{prefix}_{k}") - F.col(f"m_{k}")) ** 2 for k in "zqd"), F.lit(0.0)) / FEATURE_COUNT

    cuts = last.join(means, "product_id").groupBy("product_id").agg(F.percentile(error(""), F.lit(0.9)).alias("threshold"))
    d = now.join(means, "product_id").join(cuts, "product_id").withColumn("reconstruction_error", error("c"))
    score = F.when(F.col("threshold") > 0, F.least(F.lit(1.0), F.col("reconstruction_error") / F.nullif("threshold", F.lit(0.0)))).otherwise(0.5)
    return d.select(
        "product_id", "reconstruction_error", "threshold", (F.col("reconstruction_error") > F.col("threshold")).alias("is_anomaly"), score.alias("score")
    )


def learned_scores(observations: DataFrame, order, isolation: DataFrame) -> DataFrame:
    """Scores and verdicts of the learned detectors, a row per product that any of them judged.

    ``isolation`` has the forest's ``product_id, isolation_score, isolation_hit``.
    """
    mixture = mixture_detector(observations, order).select("product_id", F.col("score").alias("mixture_score"), F.col("is_anomaly").alias("mixture_hit"))
    rebuilt = reconstruction_detector(observations, order).select("product_id", F.col("score").alias("reconstruction_score"), F.col("is_anomaly").alias("reconstruction_hit"))
    return isolation.join(mixture, "product_id", "full").join(rebuilt, "product_id", "full")


def ensemble(d: DataFrame) -> DataFrame:
    """Mean of the learned scores where two or more exist, and whether all of them exceed one half."""
    scores = F.array_compact(F.array("isolation_score", "mixture_score", "reconstruction_score"))
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    return d.withColumns({"ensemble_score": F.when(n >= 2, mean), "ensemble_hit": (n >= 2) & F.forall(scores, lambda s: s > 0.5)})
