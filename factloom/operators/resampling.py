"""Exact resampling: every resample draws exactly as many rows as there are, with replacement.

Rows that have the same values are alike to a resample, so they are counted first, where they
lie. The distinct values fall into buckets by hash. How many of a resample's n draws go to a
bucket is settled by splitting: the buckets' range is halved, the left half gets a binomial
share of the draws, and so on down to one bucket. Every task walks the way to its own bucket
with the same seeds, so that no task knows more than the buckets' sizes, and all counts of a
resample sum to n. Within the bucket the draws are split among its values alike.

A task gives one array of sums for all resamples; arrays are added, nothing is multiplied out.
The resamples don't depend on how rows are dealt to tasks. Rows with a null value are left
out. A group without rows gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def _split(draws: np.ndarray, left: int, all_: int, seed: tuple) -> np.ndarray:
    """Of each resample's draws how many go to the left part, by its share of the rows."""
    if left in (0, all_):
        return draws * (left == all_)
    return np.random.default_rng(seed).binomial(draws, left / all_)


def draws_of(sizes: list[int], bucket: int, samples: int, seed: int) -> np.ndarray:
    """How many draws of each resample fall into a bucket; over all buckets they sum to the number of rows."""
    low, high = 0, len(sizes)
    draws = np.full(samples, sum(sizes), dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = _split(draws, sum(sizes[low:mid]), sum(sizes[low:high]), (seed, low, high))
        draws, low, high = (left, low, mid) if bucket < mid else (draws - left, mid, high)
    return draws


def summed(values: np.ndarray, counts: np.ndarray, draws: np.ndarray, seed: tuple) -> np.ndarray:
    """Sums of the drawn values: (resamples, columns). values: a row for each distinct one, with its count."""
    out, rest = np.zeros((len(draws), values.shape[1])), int(counts.sum())
    for i, (value, n) in enumerate(zip(values, counts.tolist())):
        own = _split(draws, n, rest, (*seed, i))
        out += own[:, None] * value
        draws, rest = draws - own, rest - n
    return out


def sums(rows: DataFrame, group: list[str], values: dict[str, Column], samples: int, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(group, n, draws, and an array of sums by resample for each value); draws: how many rows each resample drew."""
    names = list(values)
    own = rows.select(*group, *(c.cast("double").alias(n) for n, c in values.items())).dropna(subset=names)
    counts = own.groupBy(*group, *names).agg(F.count("*").alias("__n")).withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    sized = counts.groupBy(*group, "__bucket").agg(F.sum("__n").alias("__size"))
    sized = sized.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("__bucket", "__size"))).alias("__sizes"))  # ``buckets`` entries
    wide = counts.join(sized, group) if group else counts.join(F.broadcast(sized), F.lit(True))  # one row, where there is one group
    arrays = ", ".join(f"`{n}` array<double>" for n in names)
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    schema = f"{kinds + ', ' if kinds else ''}n long, draws array<long>, {arrays}"

    def drawn(key, frame: pd.DataFrame) -> pd.DataFrame:
        bucket, held = key[-1], dict(frame["__sizes"].iloc[0])
        sizes = [int(held.get(b, 0)) for b in range(buckets)]
        frame = frame.sort_values(names)
        draws = draws_of(sizes, bucket, samples, seed)
        found = summed(frame[names].to_numpy(float), frame["__n"].to_numpy(), draws, (seed, buckets + bucket, buckets))
        return pd.DataFrame([[*key[:-1], int(frame["__n"].sum()), draws, *found.T]], columns=[*group, "n", "draws", *names])

    def added(key, frame: pd.DataFrame) -> pd.DataFrame:
        total = [np.sum(np.stack(frame[c].to_list()), axis=0) for c in ("draws", *names)]
        return pd.DataFrame([[*key, int(frame["n"].sum()), *total]], columns=[*group, "n", "draws", *names])

    each = wide.groupBy(*group, "__bucket").applyInPandas(drawn, schema)
    return each.groupBy(*group).applyInPandas(added, schema) if group else each.groupBy(F.lit(0).alias("one")).applyInPandas(lambda key, frame: added((), frame), schema)


def interval(means: Column, samples: int, alpha: float) -> tuple[Column, Column]:
    """The means at the percentile places of all resamples."""
    ranked = F.array_sort(means)
    low, high = int(samples * alpha / 2), min(int(samples * (1 - alpha / 2)), samples - 1)
    return F.get(ranked, F.lit(low)), F.get(ranked, F.lit(high))


def mean_ci(rows: DataFrame, group: list[str], value: Column, samples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(group, n, mean, lo, hi, least, most): the mean's interval; least and most draws of a resample, which equal n."""
    drawn = sums(rows, group, {"value": value}, samples, seed)
    low, high = interval(F.transform("value", lambda s: s / F.col("n")), samples, alpha)
    mean = rows.groupBy(*group).agg(F.avg(value.cast("double")).alias("mean"))
    out = drawn.select(*group, "n", low.alias("lo"), high.alias("hi"), F.array_min("draws").alias("least"), F.array_max("draws").alias("most"))
    return out.join(mean, group) if group else out.join(F.broadcast(mean), F.lit(True))  # one row


def difference_ci(rows: DataFrame, group: list[str], a: Column, b: Column, samples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The paired difference of the means: both values of a row are drawn together."""
    both = rows.where(a.isNotNull() & b.isNotNull())
    out = mean_ci(both, group, a - b, samples, alpha, seed).withColumnRenamed("mean", "diff")
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def counts(sizes: list[int], samples: int, seed: int = 42) -> Iterator[np.ndarray]:
    """All buckets' draws, one after the other."""
    for bucket in range(len(sizes)):
        yield draws_of(sizes, bucket, samples, seed)
