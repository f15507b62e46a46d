"""Shards of equal row counts that keep equal texts together: balanced label propagation in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.tables import stored

GROUP = ("h1", "h2")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, spread: int) -> DataFrame:
    """``df`` with a gapless rank from 0 within ``keys``, without gathering a key in one task.

    Rows of a key are dealt over ``spread`` parts by a hash of the order columns; the parts' counts (at most
    ``spread`` rows a key) give each part its offset.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    # rows that lie together by their keys alone must not stay so
    placed = dealt.repartition(*keys, "_part").withColumn("_own", own).join(offsets, same)
    return placed.withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_p", "_before", "_own", *[f"_k{i}" for i in range(len(keys))])


def of_shard(values: list[int], shard: Column) -> Column:
    """The value of a shard from one number a shard."""
    return F.array(*[F.lit(int(v)).cast("long") for v in values])[shard]


def loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def granted(asked: DataFrame, quota: list[int], into: str, gain: Column) -> DataFrame:
    """``take`` for each row asking to move ``n`` documents: whole requests in the order of ``gain`` (best first)
    until the quota of shard ``into`` is used up; the one at the limit is granted in part.

    Requests are ordered in classes (the gain's power of two, then one of 64 hash parts), so the running sum over
    classes has a bounded number of rows for each shard, and the sum within a class stays within its part.
    """
    classed = asked.withColumn("_level", F.floor(F.log2(F.greatest(gain, F.lit(1)))).cast("int")).withColumn("_sub", F.pmod(F.xxhash64(*GROUP), F.lit(64)).cast("int"))
    total = classed.groupBy(into, "_level", "_sub").agg(F.sum("n").alias("_sum"))
    earlier = Window.partitionBy(into).orderBy(F.desc("_level"), "_sub").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("_ahead", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy(into, "_level", "_sub").orderBy(F.desc("n"), *GROUP, "shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_ahead") + F.coalesce(F.sum("n").over(within), F.lit(0))
    left = of_shard(quota, F.col(into)) - ahead
    return classed.join(total, [into, "_level", "_sub"]).withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), left))).drop("_level", "_sub", "_ahead")


def propagate(cells: DataFrame, room: list[int]) -> DataFrame:
    """One round: documents move to the shards that hold most of their neighbours and have room.

    cells: how many documents of a text are in a shard.  A text's shards are taken by their number of its documents,
    most first (of equal ones the roomier), until what they hold and have room for is enough for all of the text; documents elsewhere ask to move
    into those rooms in turn.  Returns the new cells with ``moved``.
    """
    whole = Window.partitionBy(*GROUP)
    ranked_cells = whole.orderBy(F.desc("n"), F.desc("room"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    room_of = F.greatest(of_shard(room, F.col("shard")), F.lit(0).cast("long"))
    seen = cells.withColumn("room", room_of).withColumn("held", F.sum("n").over(whole))
    seen = seen.withColumn("wants", F.coalesce(F.sum(F.col("n") + F.col("room")).over(ranked_cells), F.lit(0)) >= F.col("held"))
    asked = F.coalesce(F.sum(F.when(F.col("wants"), F.col("n"))).over(ranked_cells), F.lit(0))
    open_room = F.when(~F.col("wants"), F.col("room"))
    upto = F.coalesce(F.sum(open_room).over(ranked_cells), F.lit(0)) + open_room
    seen = seen.withColumn("asked", asked).withColumn("upto", upto)
    rooms = F.sort_array(F.collect_list(F.when(F.col("upto").isNotNull(), F.struct("upto", "shard"))).over(whole))  # one entry a shard at most
    first = F.get(F.filter(rooms, lambda r: r["upto"] > F.col("asked")), F.lit(0))["shard"]
    seen = seen.withColumn("goal", F.when(F.col("wants"), first)).withColumn("wants", F.col("goal").isNotNull())
    moves = granted(seen.where("wants"), room, "goal", F.col("held"))
    kept = seen.where("not wants").select(*GROUP, "shard", "n", F.lit(0).cast("long").alias("moved"))
    gone = moves.select(*GROUP, "shard", (F.col("n") - F.col("take")).alias("n"), F.lit(0).cast("long").alias("moved"))
    come = moves.select(*GROUP, F.col("goal").alias("shard"), F.col("take").alias("n"), F.col("take").alias("moved"))
    every = kept.unionByName(gone).unionByName(come)
    return every.groupBy(*GROUP, "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")).where("n > 0")


def laid(loose: DataFrame, room: list[int], order: Column) -> DataFrame:
    """``at`` and ``upto`` for each row of ``loose``: its ``n`` documents laid end to end, in the order of ``order`` (best
    first, in classes as in ``granted``), and ``ends``: the rooms laid end to end, the roomiest shard first, with ``shard``."""
    ends, total = [], 0
    for s in sorted(range(len(room)), key=lambda s: (-room[s], s)):
        total += room[s]
        ends.append(F.struct(F.lit(total - room[s]).cast("long").alias("first"), F.lit(total).cast("long").alias("end"), F.lit(s).alias("shard")))
    classed = loose.withColumn("_level", order).withColumn("_sub", F.pmod(F.xxhash64(*GROUP), F.lit(64)).cast("int"))
    earlier = Window.orderBy(F.desc("_level"), "_sub").rowsBetween(Window.unboundedPreceding, -1)
    total = classed.groupBy("_level", "_sub").agg(F.sum("n").alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_level", "_sub").orderBy(F.desc("n"), *GROUP).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_ahead") + F.coalesce(F.sum("n").over(within), F.lit(0))
    placed = classed.join(total, ["_level", "_sub"]).withColumn("at", at).withColumn("upto", F.col("at") + F.col("n"))
    return placed.select(*GROUP, "n", "at", "upto", F.array(*ends).alias("ends"))


def settled(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Cells within their quotas, where no text is cut that fits into a shard's room whole.

    Propagation moves documents into free room only.  Here all texts still cut let go of their shards, and so do whole
    texts (small ones first) of shards beyond their quotas; what is loose is then laid into the rooms, texts of one power
    of two at a time, large ones first, and those that would be cut wait for the next round, until none fits
    anywhere.  In each round the first text laid fits the roomiest shard, so rounds end.  The rest, at last, fills
    the rooms in turn.  A text larger than a shard only lets go of what is beyond a quota.
    """
    shards, most = len(quota), max(quota)
    whole = Window.partitionBy(*GROUP)
    seen = stored(cells.select(*GROUP, "shard", "n", F.sum("n").over(whole).alias("held"), F.count(F.lit(1)).over(whole).alias("k")), "shard-seen")
    cut = (F.col("k") > 1) & (F.col("held") <= most)
    loose, kept = seen.where(cut).select(*GROUP, "n"), seen.where(~cut)
    load = loads(kept, shards)
    over = [max(0, x - q) for q, x in zip(quota, load)]
    if any(over):
        let_go = granted(kept.withColumn("from", F.col("shard")), over, "from", F.floor(F.lit(1 << 40) / F.col("n")))
        gone = F.when((F.col("take") > 0) & (F.col("held") <= most), F.col("n")).otherwise(F.col("take"))
        left = stored(let_go.withColumn("gone", gone), "shard-left")
        loose = loose.unionByName(left.where("gone > 0").select(*GROUP, F.col("gone").alias("n")))
        kept = left.where("n > gone").withColumn("n", F.col("n") - F.col("gone"))
        load = loads(kept, shards)
    kept = kept.select(*GROUP, "shard", "n")
    loose = stored(loose.groupBy(*GROUP).agg(F.sum("n").alias("n")), "shard-loose")
    room = [q - x for q, x in zip(quota, load)]
    level = F.floor(F.log2("n")).cast("int")
    while True:
        top = loose.where(F.col("n") <= max(room)).agg(F.max(level)).first()[0]
        if top is None:
            break
        now = F.coalesce((level == top) & (F.col("n") <= max(room)), F.lit(False))
        try_all = laid(loose.where(now), room, level)
        fitting = F.get(F.filter("ends", lambda e: (e["first"] <= F.col("at")) & (F.col("upto") <= e["end"])), F.lit(0))["shard"]
        tried = stored(try_all.select(*GROUP, "n", fitting.alias("shard")), "shard-tried")
        kept = kept.unionByName(tried.where("shard is not null").select(*GROUP, "shard", "n"))
        loose = loose.where(~now).unionByName(tried.where("shard is null").select(*GROUP, "n"))
        room = [r - x for r, x in zip(room, loads(tried.where("shard is not null"), shards))]
    pieces = laid(loose, room, level).withColumn("e", F.explode("ends"))
    part = F.least("upto", "e.end") - F.greatest("at", "e.first")
    pieces = pieces.select(*GROUP, F.col("e.shard").alias("shard"), part.alias("n")).where("n > 0")
    return stored(kept.unionByName(pieces).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")), "shard-cells")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rounds: int = 8, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, by the law ``rows``.

    Documents with equal texts are linked.  Each starts in a shard by a hash of its id and then moves, in up to
    ``rounds`` joins, to the shards that hold most of its neighbours, as far as their quotas (final row counts) have
    room; the largest groups are served first and a group larger than a shard fills several.  Groups still cut
    then, and those in shards over quota, are placed whole wherever one has room (``settled``), however few rooms the
    rounds found.  Documents without links fill the rest, so that row counts differ by one at most.  Only one number
    a shard comes to the driver.

    Sizes are UTF-8 bytes plus ``overhead``.  A null text has no bytes, its crc is 0, and it counts as the empty
    text.  Null and repeated ids are placed row by row; equal rows are interchangeable.  No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    node = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", (F.length("t") + overhead).cast("long").alias("size"), F.crc32("t").alias("text_crc32"), F.xxhash64("t").alias("h1"),
    ).withColumn("h2", F.shiftleft(F.col("text_crc32"), 31) + F.col("size"))
    nodes = stored(node, "shard-nodes")
    n = nodes.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))

    start = F.pmod(F.xxhash64("doc_id", "h1"), F.lit(shards)).cast("int")
    by_cell = nodes.groupBy(*GROUP, start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    linked = by_cell.withColumn("_all", F.sum("n").over(Window.partitionBy(*GROUP))).where("_all > 1").drop("_all")
    cells = stored(linked, "shard-cells")
    load = loads(cells, shards)
    for _ in range(rounds):
        step = stored(propagate(cells, [q - x for q, x in zip(quota, load)]), "shard-cells")
        cells, load = step.drop("moved"), loads(step, shards)
        if not step.where("moved > 0").take(1):
            break

    cells = settled(cells, quota)
    load = loads(cells, shards)

    # documents of a text take the text's cells in turn; those beyond them, and texts without links, are free
    running = F.sum("n").over(Window.partitionBy(*GROUP).orderBy("shard"))
    plan = cells.withColumn("upto", running).groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("plan"))  # at most one entry a shard
    joined = nodes.join(plan, list(GROUP), "left")
    bound = ranked(joined.where("plan is not null"), list(GROUP), ["doc_id", "size"], "r", spread)
    fitting = F.filter("plan", lambda c: c["upto"] > F.col("r"))
    bound = bound.withColumn("shard", F.get(fitting, F.lit(0))["shard"])
    columns = ["doc_id", "size", "text_crc32", "h1"]
    free = joined.where("plan is null").select(*columns).unionByName(bound.where("shard is null").select(*columns))
    ends, total = [], 0
    for q, x in zip(quota, load):
        total += q - x
        ends.append(total)
    filled = ranked(free.withColumn("all", F.lit(1)), ["all"], ["doc_id", "size", "h1"], "r", 64 * spread)
    filled = filled.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("r"))))
    every = bound.where("shard is not null").select(*columns, "shard").unionByName(filled.select(*columns, "shard"))
    placed = ranked(stored(every, "shard-rows"), ["shard"], ["doc_id", "size", "h1"], "slot", spread)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
