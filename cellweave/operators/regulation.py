"""Operators on token sequences and regulatory edges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pseudobulk(tokens: DataFrame, by: list[str], longest: int = 2048) -> DataFrame:
    """by, token, mean value over all cells of the group (absent as 0), mean where present, and rank; the longest best.

    tokens(by, cell, token, value); token 0 is padding.
    """
    own = tokens.where("token <> 0")
    cells = tokens.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.count(F.lit(1)).alias("cells"))
    sums = own.groupBy(*by, "token").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    out = sums.join(cells, by).select(*by, "token", (F.col("s") / F.col("cells")).alias("bulk"), (F.col("s") / F.col("n")).alias("mean_present"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("bulk", 9)), "token")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= longest)


def delete_token(ids: Column, values: Column, token: Column) -> tuple[Column, Column]:
    """Padded arrays without a token: survivors move to the left, zeros follow, and the length stays."""
    keep = F.filter(F.arrays_zip(ids.alias("i"), values.alias("v")), lambda t: t["i"] != token)
    pad = lambda a, zero: F.concat(a, F.array_repeat(zero, F.size(ids) - F.size(keep)))
    return pad(F.transform(keep, lambda t: t["i"]), F.lit(0).cast("long")), pad(F.transform(keep, lambda t: t["v"]), F.lit(0.0))


def overexpress_token(ids: Column, values: Column, token: Column, level: Column) -> Column:
    """Values with a token's set to level."""
    return F.zip_with(ids, values, lambda i, v: F.when(i == token, level).otherwise(v))


def aggregate_edges(shifts: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """tf, target and mean shift of edges that enough of the factor's cells support: at least `least` and `share` of them.

    shifts(tf, cell, target, shift).
    """
    cells = shifts.groupBy("tf", "cell").agg(F.count(F.lit(1)).alias("_n")).groupBy("tf").agg(F.count(F.lit(1)).alias("cells"))
    edges = shifts.groupBy("tf", "target").agg(F.avg("shift").alias("delta"), F.count(F.lit(1)).alias("support"))
    return edges.join(cells, "tf").where(F.col("support") >= F.greatest(F.lit(least), share * F.col("cells"))).drop("cells")


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k edges of largest absolute delta of each factor, ties by target."""
    order = Window.partitionBy("tf").orderBy(F.desc(F.abs(F.round("delta", 9))), "target")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def strongest(stats: DataFrame, key: str, stat: str, position: str) -> DataFrame:
    """One statistic for each key: the one of largest absolute value, the earlier on ties."""
    return stats.groupBy(key).agg(F.max_by(stat, F.struct(F.abs(stat), -F.col(position))).alias(stat))


def difference(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """a minus b over the union of their keys, absent as 0, and whether both have the key."""
    left, right = a.select(*key, F.col(value).alias("_a")), b.select(*key, F.col(value).alias("_b"))
    both = left.join(right, key, "full_outer")
    return both.select(*key, (F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("delta"), (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"))


#: Ranges of values that genes are dealt to.
BINS = 128


def _count_bin(within: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """n and below of each focal gene in one range: matched genes, and those of a smaller shift. A range that matches whole is only searched by shift."""

    def run(genes: pa.Table, asked: pa.Table) -> pa.Table:
        v, s = (genes[c].to_numpy().astype(float) for c in ("value", "shift"))
        fv, fs = (asked[c].to_numpy().astype(float) for c in ("fv", "fs"))
        n, below = np.full(len(fv), len(v)), np.where(np.isnan(fs), 0, np.searchsorted(np.sort(s), fs))
        for k in np.flatnonzero(~asked["whole"].to_numpy()):
            met = np.abs(v - fv[k]) < within * fv[k]
            n[k], below[k] = np.count_nonzero(met), np.count_nonzero(met & (s < fs[k]))
        own = pc.index_in(asked["focal"], value_set=genes["gene"].combine_chunks()).combine_chunks()  # a gene is not matched with itself
        at = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
        g = own.drop_null().to_numpy()
        met = np.abs(v[g] - fv[at]) < within * fv[at]
        n[at] -= met
        below[at] -= met & (s[g] < fs[at])
        return pa.table({"focal": asked["focal"], "n": pa.array(n), "below": pa.array(below)})

    return run


def matched_null(genes: DataFrame, focal: DataFrame, within: float = 0.15) -> DataFrame:
    """focal gene, matched genes and the percentile of its shift among those whose mean value is within a share of its own.

    genes and focal (gene, value, shift), a row for each gene. No pair is made: genes are dealt to ranges of the value, a focal gene asks each range
    that its band meets for two counts, and only the ranges at the ends of the band are gone through.
    """
    if not 0 < within < 1:
        raise ValueError("within is a share")
    told = genes.where("value > 0").select("gene", F.col("value").cast("double").alias("value"), F.col("shift").cast("double").alias("shift"))
    cuts = told.agg(F.percentile_approx("value", [k / BINS for k in range(1, BINS)], 10_000).alias("c")).first().c or []
    g = told.withColumn("bin", F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<double>"), lambda c: c < F.col("value"))))
    ranges = g.groupBy("bin").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    f = focal.where("value > 0").select(F.col("gene").alias("focal"), F.col("value").cast("double").alias("fv"), F.col("shift").cast("double").alias("fs"))
    inside = lambda c: F.abs(F.col(c) - F.col("fv")) < within * F.col("fv")
    meets = (F.col("low") <= F.col("fv") * (1 + within) * (1 + 1e-9)) & (F.col("high") >= F.col("fv") * (1 - within) * (1 - 1e-9))
    asked = f.join(F.broadcast(ranges), meets).select("bin", "focal", "fv", "fs", (inside("low") & inside("high")).alias("whole"))
    kind = f.schema["focal"].dataType.simpleString()
    counts = g.toDF(*g.columns).groupBy("bin").cogroup(asked.groupBy("bin")).applyInArrow(_count_bin(within), f"focal {kind}, n long, below long")
    n = F.sum("n")
    return counts.groupBy("focal").agg(n.alias("n_matched"), (100 * (F.sum("below") / n)).alias("percentile")).where("n_matched > 0")
