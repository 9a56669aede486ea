"""Scores of estimates against the truth, separation of groups, resampling, tails of distributions, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import ladder
from ..functions.stats import guarded_corr, spearman


def estimate_scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, Pearson, Spearman, RMSE, bias and means of pairs(by, truth, estimate)."""
    err = F.col("estimate") - F.col("truth")
    out = pairs.groupBy(*by).agg(guarded_corr("truth", "estimate").alias("pearson"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"), F.avg("truth").alias("true_mean"), F.avg("estimate").alias("est_mean"))
    return spearman(pairs, by, "truth", "estimate").withColumnRenamed("rho", "spearman").join(out, by)


def overall_scores(pairs: DataFrame, group: str, drop_dominant: int = 1) -> DataFrame:
    """metric and value: pooled Pearson and RMSE, mean and median of the groups' Pearson, pooled without the dominant groups.

    The groups of largest true mean are dropped; one row for each group decides which.
    """
    per = pairs.groupBy(group).agg(F.avg("truth").alias("m"), guarded_corr("truth", "estimate").alias("r"))
    top = per.orderBy(F.desc(F.round("m", 9)), group).limit(drop_dominant).select(group)
    err = F.col("estimate") - F.col("truth")
    pooled = lambda df, name: df.agg(guarded_corr("truth", "estimate").alias("pearson"), F.sqrt(F.avg(err * err)).alias("rmse")).select(F.stack(F.lit(2), F.lit(f"{name}_pearson"), "pearson", F.lit(f"{name}_rmse"), "rmse").alias("metric", "value"))
    macro = per.agg(F.avg("r").alias("a"), F.median("r").alias("b")).select(F.stack(F.lit(2), F.lit("macro_pearson"), "a", F.lit("median_pearson"), "b").alias("metric", "value"))
    return pooled(pairs, "overall").unionByName(macro).unionByName(pooled(pairs.join(top, group, "left_anti"), "separable"))


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, quartiles (interpolated) and mean of a value."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q"))
    return out.select(*by, "n", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def index_quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The values at places n // 4, n // 2 and 3n // 4 of each sorted group, without interpolation.

    Equal values are folded first; the window sees distinct values of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    counts = counts.withColumn("_until", F.sum("_c").over(group.orderBy(value))).withColumn("_n", F.sum("_c").over(group))
    at = lambda k: F.min(F.when(F.col("_until") > F.floor(F.col("_n") * k / 4), F.col(value)))
    return counts.groupBy(*by).agg(F.max("_n").alias("n"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))


def modality_mix(cells: DataFrame, sample: str, value: str, limit: float = 2.5) -> DataFrame:
    """Each sample's median and whether all medians span more than the limit: samples of unlike depth."""
    per = cells.groupBy(sample).agg(F.median(value).alias("median"))
    span = per.agg(F.min("median").cast("double").alias("least"), F.max("median").cast("double").alias("most")).first()  # two numbers
    least, most = F.lit(span["least"]).cast("double"), F.lit(span["most"]).cast("double")
    return per.select(sample, "median", ((least > 0) & (most > limit * least)).alias("mixed"), (F.col("median") > 2 * least).alias("is_high"))


def scaled(values: DataFrame, by: list[str], value: str, clip: float = 10.0) -> DataFrame:
    """values with z: deviations from the group's mean in population deviations, clipped; 0 where a group does not vary.

    Moments are aggregated and joined back, so a hot group is no window.
    """
    moments = values.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.when(F.col("_s") > 1e-12, F.col("_s"))), F.lit(0.0))
    return values.join(moments, by).withColumn("z", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).drop("_m", "_s")


def multivariate_eta(df: DataFrame, vector: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of a vector's variance between labels, over all dimensions: sums for (label, dimension) only."""
    long = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(*by, label, F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    sums = long.groupBy(*by, label, "dim").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    dims = sums.groupBy(*by, "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g"))
    centre = F.col("s") * F.col("s") / F.col("n")
    return dims.groupBy(*by).agg(F.try_divide(F.sum(F.col("g") - centre), F.sum(F.col("q") - centre)).alias("eta2"))


def draw_order(seed: str, *keys: Column) -> Column:
    """A reproducible random order: md5 of a seed and keys, which any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))


def capped_sample(df: DataFrame, by: list[str], key: str, most: int, seed: str = "0") -> DataFrame:
    """At most so many rows of each group, uniformly and without replacement: the first in a random order.

    The rank filter runs before the shuffle as well (window group limit), so a task sends at most `most` rows a group.
    """
    order = Window.partitionBy(*by).orderBy(draw_order(seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def permuted_labels(df: DataFrame, strata: list[str], key: str, label: str, seed: str) -> DataFrame:
    """df with permuted: labels dealt anew at random inside each stratum, each as often as before.

    Needs the order of a stratum's rows; strata are the samples of one block, not a whole table.
    """
    random = Window.partitionBy(*strata).orderBy(draw_order(seed, F.col(key)), key)
    sorted_ = Window.partitionBy(*strata).orderBy(label, key)
    places = df.select(*strata, F.col(label).alias("permuted"), F.row_number().over(sorted_).alias("_p"))
    return df.withColumn("_p", F.row_number().over(random)).join(places, [*strata, "_p"]).drop("_p")


def permutation_p(observed: Column, null: Column) -> Column:
    """(draws at or above the observed value + 1) / (draws + 1), as an aggregate."""
    return (F.count_if(null >= observed) + 1) / (F.count(null) + 1)


def bootstrap_z(values: DataFrame, by: list[str], key: str, value: str, draws: int, seed: str = "0") -> DataFrame:
    """Mean of each group, its bootstrap deviation and their ratio (0 where the draws do not vary).

    Each row of a group picks, in each draw, a row of the group by a hash; the picks are joined back by place, so
    neither a group nor its draws are collected.
    """
    order = Window.partitionBy(*by).orderBy(key)
    placed = values.select(*by, key, F.col(value).alias("_v"), (F.row_number().over(order) - 1).cast("long").alias("_p"))
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("point"))
    rows = values.select(*by, key).join(sizes.drop("point"), by).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pick = F.pmod(F.conv(F.substring(draw_order(seed, F.col("draw"), F.col(key)), 1, 12), 16, 10).cast("long"), F.col("_n"))
    picked = rows.withColumn("_p", pick).join(placed.drop(key), [*by, "_p"])
    means = picked.groupBy(*by, "draw").agg(F.avg("_v").alias("m")).groupBy(*by).agg(F.stddev_pop("m").alias("sd"))
    z = F.coalesce(F.try_divide(F.col("point"), F.when(F.col("sd") > 1e-12, F.col("sd"))), F.lit(0.0))
    return sizes.join(means, by).select(*by, F.col("_n").alias("n"), "point", "sd", z.alias("z"))


def log_factorial(n: Column) -> Column:
    """ln n!: summed up to 20, Stirling's series beyond."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(20)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    y = F.greatest(x, F.lit(21.0))
    series = y * F.log(y) - y + 0.5 * F.log(F.lit(2 * 3.141592653589793) * y) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(n <= 20, small).otherwise(series)


def _choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def binomial_tail(hits: Column, n: Column, p: Column) -> Column:
    """P(X >= hits) of Binomial(n, p); null where n is not positive."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    term = lambda i: F.exp(_choose(n, i) + i * F.log(p) + (n - i) * F.log(1 - p))
    tail = F.aggregate(F.sequence(hits, F.greatest(n, hits)), F.lit(0.0), lambda s, i: s + F.when(i <= n, term(F.least(i, n))).otherwise(0.0))
    return F.when(n > 0, tail)


def hypergeometric_tail(hits: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= hits) of drawn items out of total, of which marked are marked; 1 where nothing is marked or drawn."""
    most = F.least(marked, drawn)
    low = F.greatest(hits, drawn + marked - total, F.lit(0))
    term = lambda i: F.exp(_choose(marked, i) + _choose(total - marked, drawn - i) - _choose(total, drawn))
    tail = F.aggregate(F.sequence(low, F.greatest(most, low)), F.lit(0.0), lambda s, i: s + F.when(i <= most, term(F.least(i, most))).otherwise(0.0))
    return F.when((marked > 0) & (drawn > 0), F.least(tail, F.lit(1.0))).otherwise(1.0)


def welch(df: DataFrame, by: list[str], value: str, group: Column) -> DataFrame:
    """n, means, Welch's t and its degrees of freedom for rows where group is true against the others."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    out = df.groupBy(*by).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    u, v = F.try_divide("va", "n_a"), F.try_divide("vb", "n_b")
    out = out.withColumns({"u": u, "v": v})
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(F.col("u") + F.col("v")))
    df_ = F.try_divide((F.col("u") + F.col("v")) * (F.col("u") + F.col("v")), F.col("u") * F.col("u") / (F.col("n_a") - 1) + F.col("v") * F.col("v") / (F.col("n_b") - 1))
    enough = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    return out.select(*by, "n_a", "n_b", "mean_a", "mean_b", F.when(enough, t).alias("t"), F.when(enough, df_).alias("df"))


def composition_verdict(n_significant: Column, p_fraction: Column, least: int = 25, alpha: float = 0.05) -> Column:
    """QUIET without a response, FLAG_COMPOSITION where the fraction moves too, else PASS_EXPRESSION."""
    moves = F.coalesce(p_fraction < alpha, F.lit(False))
    return ladder([(F.coalesce(n_significant, F.lit(0)) < least, F.lit("QUIET")), (moves, F.lit("FLAG_COMPOSITION"))], F.lit("PASS_EXPRESSION"))


def miss_ladder(evaluations: DataFrame, key: list[str]) -> DataFrame:
    """Each key's outcome over its blocks, by the first rung that holds.

    evaluations(key, expected, present, powered, significant, direction, confounded, mean_fraction): expected is 1, -1 or
    null where any direction will do. Of the blocks that decide, the one of largest mean fraction tells confounding.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    present, powered, significant = yes("present"), yes("present") & yes("powered"), yes("present") & yes("powered") & yes("significant")
    right = significant & F.coalesce(F.col("expected").isNull() | (F.col("direction") == F.col("expected")), F.lit(False))
    weight = F.coalesce("mean_fraction", F.lit(-1.0))
    best = F.max(F.when(right, F.struct(weight.alias("w"), yes("confounded").alias("confounded"))))
    out = evaluations.groupBy(*key).agg(*[F.bool_or(c).alias(n) for n, c in (("p", present), ("w", powered), ("s", significant), ("r", right))], best.alias("b"))
    rungs = [(~F.col("p"), "not_testable"), (~F.col("w"), "underpowered"), (~F.col("s"), "not_significant"), (~F.col("r"), "wrong_direction"), (F.col("b.confounded"), "recovered_confounded")]
    return out.select(*key, ladder(((c, F.lit(v)) for c, v in rungs), F.lit("recovered")).alias("outcome"))
