"""Resharding by minimum-cost flow.

Each row has an old shard. Their sizes and the new capacities make a flow network, old
shards to new ones, where bytes that stay cost nothing and each byte that moves costs its
link's price; successive shortest paths find the transfers that move the fewest bytes.
The transfers are then carried out on groups of equal texts: the groups of an old shard stand
in order of size and text, and running sums of bytes say which of them go where, by their
middle. Small ones stand first and are the ones that move, so each transfer is met to within
half of a small group.

A group stays whole unless it has more bytes than ``whole`` of an even shard: a text copied so
often can't stay in one place where sizes are to come out equal. Such a group, and there are
at most shards / whole of them, is dealt by its rows' numbers into parts of that size.

Only sums for each range of groups reach the driver. Running sums and slots are counted
within blocks of rows (Spark's partitions) and then shifted by the sums of earlier blocks.

Null texts count as empty. Very long texts are rows like any other; a transfer that ends in
one is off by half of it. Rows with a repeated or null id, and equal rows, are placed each by
itself, for a row goes by its number and not by its id; ties within a group go by that number.
Other columns, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, id_text, parallelism, stored


def min_cost_flow(supply: list[int], capacity: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one, at least total cost.

    cost(i, j) is the price of a byte; by default 0 where i == j and else 1.
    """
    cost = cost or (lambda i, j: int(i != j))
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than what there is to place")
    room: dict[tuple[int, int], int] = {}
    price: dict[tuple[int, int], int] = {}
    near: list[list[int]] = [[] for _ in range(n + m + 2)]

    def link(a: int, b: int, c: int, p: int) -> None:
        room[a, b], room[b, a], price[a, b], price[b, a] = c, 0, p, -p
        near[a].append(b)
        near[b].append(a)

    for i, s in enumerate(supply):
        link(source, i, s, 0)
        for j in range(m):
            link(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        link(n + j, sink, c, 0)
    level = [0] * (n + m + 2)
    while True:  # shortest paths by Dijkstra's method over reduced prices
        far = [float("inf")] * (n + m + 2)
        far[source], heap, before = 0, [(0, source)], {}
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for b in near[a]:
                x = d + price[a, b] + level[a] - level[b]
                if room[a, b] > 0 and x < far[b]:
                    far[b], before[b] = x, a
                    heapq.heappush(heap, (x, b))
        if far[sink] == float("inf"):
            break
        level = [v + (d if d < float("inf") else 0) for v, d in zip(level, far)]
        path, b = [], sink
        while b != source:
            path.append((before[b], b))
            b = before[b]
        most = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= most
            room[b, a] += most
    return {(i, j): room[n + j, i] for i in range(n) for j in range(m) if room[n + j, i] > 0}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def _running(blocks: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """For each block and group, what the earlier blocks of the group sum to.

    blocks has a row for each block and group: as many as there are partitions.
    """
    w = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("block", by, F.coalesce(F.sum(value).over(w), F.lit(0)).alias(name))


#: A group of equal texts; ``part`` deals out the few that are too large to stay whole.
UNIT = ["old_shard", "size", "text_crc32", "part"]


def reshard(
    df: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    old_shard=None,
    old_shards: int | None = None,
    capacities: list[int] | None = None,
    whole: float = 0.01,
    row_col: str | None = None,
) -> DataFrame:
    """Rows with their old and new shard, and a gapless slot in the new one.

    old_shard: a column, by default crc32(text) modulo ``shards``. capacities: bytes for
    each new shard, by default equal shares. whole: share of an even shard up to which equal
    texts stay together. row_col: a column that numbers the rows, handed on as ``row``.
    """
    spark = df.sparkSession
    more = [old_shard.cast("int").alias("old_shard")] if old_shard is not None else []
    rows = id_text(df, id_col, text_col, (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), *more)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("row", "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), *(["old_shard"] if more else []))
    if not more:
        rows = rows.withColumn("old_shard", F.pmod("text_crc32", F.lit(shards)).cast("int"))
    rows = stored(rows)  # from here on a row's number is fixed

    sizes = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}
    many = old_shards or max([shards, *(k + 1 for k in sizes)])
    supply = [sizes.get(i, 0) for i in range(many)]
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), shards))

    # groups, the largest of them in parts
    most = max(1, int(whole * sum(supply) / shards))
    group = UNIT[:-1]
    groups = rows.groupBy(*group).agg(F.count("*").alias("copies"))
    large = groups.where(F.col("copies") * F.col("size") > most).withColumn("parts", F.ceil(F.col("copies") * F.col("size") / most).cast("int"))
    large = F.broadcast(large.select(*group, "parts"))  # at most shards / whole of them
    rows = rows.join(large, group, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    n = parallelism(spark)
    units = rows.groupBy(*UNIT).agg(F.sum("size").alias("bytes"))
    units = stored(units.repartitionByRange(n, *UNIT).withColumn("block", F.spark_partition_id()))

    # Those that move stand first: each old shard's transfers as ranges of its running sum.
    moves, at = [], [0] * many
    for (i, j), size in sorted(flow.items(), key=lambda x: (x[0][0] == x[0][1], x[0])):
        moves.append((i, j, at[i], at[i] + size))
        at[i] += size
    target = F.lit(None).cast("int")
    middle = F.col("before") + F.col("bytes") / 2
    for i, j, low, high in moves:  # at most old x new shards of them
        target = F.coalesce(target, F.when((F.col("old_shard") == i) & (middle >= low) & (middle < high), F.lit(j)))
    target = F.coalesce(target, F.lit(0))

    sums = units.groupBy("block", "old_shard").agg(F.sum("bytes").alias("bytes"))
    local = Window.partitionBy("block", "old_shard").orderBy(*UNIT[1:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        units.withColumn("inside", F.coalesce(F.sum("bytes").over(local), F.lit(0)))
        .join(F.broadcast(_running(sums, "old_shard", "bytes", "earlier")), ["block", "old_shard"])
        .withColumn("before", F.col("inside") + F.col("earlier"))
        .select(*UNIT, target.alias("shard"))
    )
    placed = stored(rows.join(placed, UNIT).select("row", "doc_id", "size", "text_crc32", "old_shard", "shard", F.spark_partition_id().alias("block")))
    counts = placed.groupBy("block", "shard").agg(F.count("*").alias("rows"))
    local = Window.partitionBy("block", "shard").orderBy("row")
    return (
        placed.withColumn("inside", F.row_number().over(local) - 1)
        .join(F.broadcast(_running(counts, "shard", "rows", "earlier")), ["block", "shard"])
        .select(*(["row"] if row_col else []), "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("inside") + F.col("earlier")).cast("long").alias("slot"))
    )


def rewrite(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", old_shard: str | None = None, **options) -> list[int]:
    """Writes the shards that gain or lose rows below path, one folder each; returns them.

    Shards that keep their rows are not touched: their files stay as they are. The rows are
    numbered in a table in the shared folder first, so that each finds its place whatever its
    id. Files hold a million rows each, in the order of their slots.
    """
    row, shard, slot = (free_name(docs, name) for name in ("__row", "__shard", "__slot"))
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = reshard(docs, shards, id_col, text_col, F.col(old_shard) if old_shard else None, row_col=row, **options)
    plan = stored(plan.select(F.col("row").alias(row), "old_shard", F.col("shard").alias(shard), F.col("slot").alias(slot)))
    moved = plan.where(F.col("old_shard") != F.col(shard))
    touched = sorted({x for r in moved.select("old_shard", shard).distinct().collect() for x in r if x < shards})
    rows = plan.where(F.col(shard).isin(touched)).drop("old_shard")
    (
        docs.join(rows, row)
        .drop(row)
        .repartition(shard, F.floor(F.col(slot) / 1_000_000))
        .sortWithinPartitions(shard, slot)
        .drop(slot)
        .withColumnRenamed(shard, free_name(docs, "shard"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(free_name(docs, "shard"))
        .parquet(path)
    )
    discard(docs, plan)
    return touched
