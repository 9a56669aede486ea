"""Operators that compare estimates, representations and test results: bias, agreement, separation, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import ladder
from ..functions.stats import benjamini_hochberg, dealt_by_range, folded_auc, guarded_corr, running_sums, spearman


def bias_drivers(biased: DataFrame, plain: DataFrame, by: list[str], kind: str, error: str) -> DataFrame:
    """by, the type whose error grows most under bias, its growth, and the median growth of the other types.

    Types of both tables count; equal growth goes to the smaller name. Without other types the median is null.
    """
    both = biased.select(*by, kind, F.col(error).alias("_b")).join(plain.select(*by, kind, F.col(error).alias("_p")), [*by, kind])
    grown = both.select(*by, kind, F.round(F.col("_b") - F.col("_p"), 9).alias("delta"))
    top = grown.groupBy(*by).agg(F.max("delta").alias("driver_delta"))
    first = grown.join(top, by).where("delta = driver_delta").groupBy(*by, "driver_delta").agg(F.min(kind).alias("driver"))
    rest = grown.join(first.select(*by, F.col("driver").alias(kind)), [*by, kind], "left_anti").groupBy(*by).agg(F.median("delta").alias("rest_median"))
    return first.join(rest, by, "left").select(*by, "driver", "driver_delta", "rest_median")


def dose_slope(points: DataFrame, by: list[str], dose: str, value: str) -> DataFrame:
    """by and slope: (value at the largest dose - value at the smallest) / (difference of doses); null for one dose."""
    told = points.where(F.col(dose).isNotNull() & F.col(value).isNotNull())
    ends = told.groupBy(*by).agg(F.min(dose).alias("_a"), F.max(dose).alias("_z"), F.min_by(value, dose).alias("_va"), F.max_by(value, dose).alias("_vz"))
    return ends.select(*by, F.try_divide(F.col("_vz") - F.col("_va"), F.col("_z") - F.col("_a")).alias("slope"))


def adjusted_slope(values: DataFrame, by: list[str], group: str, x: str, y: str) -> DataFrame:
    """by, n and slope: the least squares coefficient of x on y beside an intercept for each group.

    Sums within (by, group) give it; 0 where x does not vary within any group, as the pseudo-inverse has it.
    """
    told = values.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    inner = told.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_n"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"))
    out = inner.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_c")).alias("_c"), F.sum(F.col("_n") * F.col("_v")).alias("_v"))
    return out.select(*by, "n", F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).otherwise(0.0).alias("slope"))


def expression_scores(profiles: DataFrame, kind: str, sample: str, least_share: float = 0.02) -> DataFrame:
    """kind, Spearman and Pearson of log profiles: of the sums over samples, and medians over samples.

    profiles(kind, sample, gene, truth, estimate); a missing estimate is 0. A sample scores a kind whose share of the
    sample's truth reaches the least share.
    """
    own = profiles.withColumn("estimate", F.coalesce("estimate", F.lit(0.0)))

    def scores(df: DataFrame, by: list[str]) -> DataFrame:
        logs = df.withColumn("_lt", F.log1p("truth")).withColumn("_le", F.log1p(F.greatest("estimate", F.lit(0.0)))).groupBy(*by).agg(guarded_corr("_lt", "_le").alias("logpearson"), F.sum("truth").alias("_t"))
        return spearman(df, by, "truth", "estimate", large=True).join(logs, by)

    # Samples are told by their share after they are scored: one row for each, so profiles need not meet their own sums.
    each = scores(own, [kind, sample]).withColumn("_all", F.sum("_t").over(Window.partitionBy(sample)))
    enough = each.where((F.col("_all") > 0) & (F.col("_t") >= least_share * F.col("_all")))
    per = enough.groupBy(kind).agg(F.median("rho").alias("ps_spearman"), F.median("logpearson").alias("ps_logpearson"), F.count(F.lit(1)).alias("n_samples"))
    whole = own.groupBy(kind, "gene").agg(F.sum("truth").alias("truth"), F.sum("estimate").alias("estimate"))
    out = scores(whole, [kind]).select(kind, F.col("n").alias("n_genes"), F.col("rho").alias("agg_spearman"), F.col("logpearson").alias("agg_logpearson"))
    return out.join(per, kind, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def conserved_edges(ours: DataFrame, theirs: DataFrame, orthologs: DataFrame, least_z: float = 2.0, least_shared: int = 8) -> DataFrame:
    """tf, n_shared and rho of the shifts of targets that both species have.

    ours(tf, target, delta, z), theirs(tf, target, delta), orthologs(gene, target) maps our targets. A factor's edges of
    |z| >= least_z are used where there are least_shared of them, else all; shifts of one mapped target are averaged.
    """
    strong, delta = F.abs("z") >= least_z, F.col("delta")
    mapped = ours.join(orthologs.select(F.col("gene").alias("target"), F.col("target").alias("_t")), "target")
    # Both species' edges are stacked and folded by (tf, target) at once: edges are neither joined with their own counts nor with the other side.
    mine = mapped.select("tf", "_t", delta.alias("_d"), F.when(strong, delta).alias("_z"), strong.cast("int").alias("_k"), F.lit(None).cast("double").alias("_o"))
    other = theirs.select("tf", F.col("target").alias("_t"), F.lit(None).cast("double").alias("_d"), F.lit(None).cast("double").alias("_z"), F.lit(None).cast("int").alias("_k"), delta.cast("double").alias("_o"))
    # They go to their factor's task unfolded, as few of them fold, and in a fixed number of parts: neither map sides nor merged parts hold them in bulk.
    parts = int(ours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = mine.unionByName(other).where("tf is not null and _t is not null").repartition(parts, "tf")
    per = dealt.groupBy("tf", "_t").agg(*[F.avg(c).alias(c) for c in ("_d", "_z", "_o")], F.sum("_k").alias("_k"))
    only = F.coalesce(F.sum("_k").over(Window.partitionBy("tf")), F.lit(0)) >= least_shared
    both = per.select("tf", F.round(F.when(only, F.col("_z")).otherwise(F.col("_d")), 9).alias("_a"), F.round("_o", 9).alias("_b"))
    return spearman(both, ["tf"], "_a", "_b").where(F.col("n") >= least_shared).select("tf", F.col("n").alias("n_shared"), "rho")


def conservation(per_tf: DataFrame, by: list[str]) -> DataFrame:
    """by, factors scored, median rho, and the shares of rho above 0 and from 0.3."""
    told = per_tf.where("rho is not null")
    share = lambda c: F.avg(c.cast("int"))
    return told.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tf"), F.median("rho").alias("median_rho"), share(F.col("rho") > 0).alias("share_positive"), share(F.col("rho") >= 0.3).alias("share_conserved"))


def cosine_silhouette(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label and silhouette by cosine distance, exact and without pairs of rows.

    The mean distance of a unit vector to a class is 1 less its product with the class's sum of unit vectors over the
    class's size. Vectors stay arrays and meet all class sums as one array of them (classes x dimensions), so a row is read once
    and never exploded by dimension. A row alone in its class has 0; null or zero vectors take no part.
    """
    told = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).withColumn("_v", F.transform(vector, lambda x: x.cast("double")))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    unit = told.withColumn("_n", norm).where("_n > 0").select(key, label, F.transform("_v", lambda x: F.try_divide(x, F.col("_n"))).alias("_u"))
    dims = unit.select(F.col(label).alias("_class"), F.posexplode("_u").alias("dim", "u")).groupBy("_class", "dim").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = dims.groupBy("_class").agg(F.max("n").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "s"))), lambda d: d["s"]).alias("sum"))
    every = sums.agg(F.collect_list(F.struct(F.col("_class").alias("class"), "size", "sum")).alias("_all")).withColumn("_", F.lit(0))
    dot = lambda c: F.aggregate(F.zip_with("_u", c["sum"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = unit.withColumn("_", F.lit(0)).join(every, "_").withColumn("_p", F.transform("_all", lambda c: F.struct(c["class"].alias("class"), c["size"].alias("size"), dot(c).alias("p"))))
    own, others = F.filter("_p", lambda c: c["class"] == F.col(label)), F.filter("_p", lambda c: c["class"] != F.col(label))
    a = F.array_max(F.transform(F.filter(own, lambda c: c["size"] > 1), lambda c: F.try_divide(c["size"] - c["p"], (c["size"] - 1).cast("double"))))
    ab = met.select(key, label, a.alias("a"), F.array_min(F.transform(others, lambda c: 1 - F.try_divide(c["p"], c["size"].cast("double")))).alias("b"))
    return ab.select(key, label, F.when(F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def adjusted_rand(rows: DataFrame, first: str, second: str) -> DataFrame:
    """One row: n and the adjusted Rand index of two labellings, from counts of label pairs; null labels are left out."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    table = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(first, second).agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda key: table.groupBy(key).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("pairs"), F.sum("n").alias("n"))
    cells = table.agg(F.sum(two("n")).alias("both"))
    # Three tables of one row each, stacked and folded: no join without a condition.
    rows3 = cells.select(F.col("both").alias("v"), F.lit("both").alias("k")).unionByName(side(first).select(F.col("pairs").alias("v"), F.lit("a").alias("k"))).unionByName(side(second).select(F.col("pairs").alias("v"), F.lit("b").alias("k"))).unionByName(side(first).select(F.col("n").alias("v"), F.lit("n").alias("k")))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
    s = rows3.agg(pick("both"), pick("a"), pick("b"), pick("n"))
    expected = F.col("a") * F.col("b") / two("n")
    most = (F.col("a") + F.col("b")) / 2
    return s.select(F.col("n").cast("long").alias("n"), F.coalesce(F.try_divide(F.col("both") - expected, most - expected), F.lit(1.0)).alias("ari"))


def signed_rank(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n (pairs that differ), the sum of positive ranks, and z of Wilcoxon's signed-rank test with ties corrected."""
    d = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.round(F.col(x) - F.col(y), 9).alias("_d")).where("_d <> 0").withColumn("_m", F.abs("_d"))
    counts = d.groupBy(*by, "_m").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.count_if(F.col("_d") > 0).alias("_p"))
    rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2
    s = running_sums(counts, by, "_m", {"_upto": "_n"}).withColumn("_r", rank).groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.col("_r") * F.col("_p")).alias("w_plus"), F.sum(F.pow("_n", F.lit(3)) - F.col("_n")).alias("_t"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)
    return s.select(*by, n.cast("long").alias("n"), "w_plus", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, spread).alias("z"))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution by a published rational approximation (relative error 1.2e-9)."""
    # Coefficients of the approximation, highest power first.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for v in coefficients[1:]:
            out = out * x + v
        return out

    q = p - 0.5
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    low = poly(c, tail) / poly(d, tail)
    return ladder([((p <= 0) | (p >= 1), F.lit(None).cast("double")), (p < 0.02425, low), (p > 1 - 0.02425, -low)], q * poly(a, q * q) / poly(b, q * q))


def signed_z(p: Column, effect: Column, floor: float = 1e-300) -> Column:
    """Two-sided p as a z of the effect's sign; p is held within [floor, 1]."""
    return F.when(effect.isNotNull(), F.signum(effect) * -normal_quantile(F.least(F.greatest(p, F.lit(floor)), F.lit(1.0)) / 2))


def scenario_flips(tests: DataFrame, p: str, scenarios: dict[str, Column], alpha: float = 0.05) -> DataFrame:
    """scenario, tests, significant ones, and those gained and lost against all tests adjusted together; tests without p take no part."""
    own = tests.where(F.col(p).isNotNull()).withColumn("_family", F.lit("all"))
    base = benjamini_hochberg(own, ["_family"], p, "_all")
    flags = F.array(*[F.when(keep, F.lit(name)) for name, keep in scenarios.items()])
    each = base.withColumn("scenario", F.explode(F.filter(flags, lambda s: s.isNotNull())))
    again = benjamini_hochberg(each, ["scenario"], p, "_new")
    was, now = F.col("_all") < alpha, F.col("_new") < alpha
    return again.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(now).alias("n_sig"), F.count_if(now & ~was).alias("gained"), F.count_if(~now & was).alias("lost"))


def covariate_verdict(fits: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """by, significant genes of both fits, the retained share, the rank correlation of t, and ROBUST or CHECK.

    fits(by, t_base, t_cov, p_base, p_cov). ROBUST from a correlation of 0.9 and, where genes were significant at all, a
    retained share of 0.8.
    """
    base, cov = F.col("p_base") < alpha, F.col("p_cov") < alpha
    counts = fits.groupBy(*by).agg(F.count_if(base).alias("n_base"), F.count_if(cov).alias("n_cov"), F.count_if(base & cov).alias("n_both"))
    out = spearman(fits, by, "t_base", "t_cov").join(counts, by).withColumn("retain", F.try_divide("n_both", "n_base"))
    robust = F.coalesce(F.round("rho", 9) >= 0.9, F.lit(False)) & F.coalesce(F.col("retain") >= 0.8, F.lit(True))
    return out.select(*by, "n_base", "n_cov", "n_both", "retain", "rho", F.when(robust, "ROBUST").otherwise("CHECK").alias("verdict"))


def enrichment_score(stats: DataFrame, sets: DataFrame, by: list[str], least: int = 1, most: int = 500) -> DataFrame:
    """by, name, size and the running-sum score of gene sets over genes ranked by a statistic (weight 1).

    stats(by, gene, stat), sets(name, gene). The sum is extreme just before or at a hit, so only hits are followed, each
    with its place among all genes; equal statistics go by gene. Places need one task for each ranking (by), and its
    genes.
    """
    # The number of parts is fixed: parts that look small as they are shuffled are else merged, and rows in order take several times as much.
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = stats.where(F.col("stat").isNotNull()).repartition(parts, *by)
    order = Window.partitionBy(*by).orderBy(F.desc("stat"), "gene")
    ranked = told.withColumn("_place", F.row_number().over(order)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    hits = ranked.join(sets.select("name", "gene").distinct(), "gene").select(*by, "name", "_place", "_all", F.abs("stat").alias("_a")).repartition(parts, *by, "name")
    own = Window.partitionBy(*by, "name")
    run, w = own.orderBy("_place"), F.col("_a")
    # Running sums come first: their order serves the sums of a set as well, so hits are sorted once.
    h = hits.withColumn("_k", F.row_number().over(run)).withColumn("_h", F.sum(w).over(run)).withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_w", F.sum(w).over(own))
    h = h.where(F.col("_n").between(least, most))
    missed = F.coalesce(F.try_divide(F.col("_place") - F.col("_k"), F.col("_all") - F.col("_n")), F.lit(0.0))
    h = h.withColumn("_at", F.try_divide("_h", "_w") - missed).withColumn("_before", F.try_divide(F.col("_h") - w, F.col("_w")) - missed)
    ends = h.groupBy(*by, "name").agg(F.max("_n").alias("size"), F.round(F.max("_at"), 9).alias("up"), F.round(F.min("_before"), 9).alias("down"))
    return ends.select(*by, "name", "size", F.when(F.col("up") >= -F.col("down"), F.col("up")).otherwise(F.col("down")).alias("es"))


def paired_auc(vectors: DataFrame, real: DataFrame, null: DataFrame) -> DataFrame:
    """One row: pairs of both kinds, their mean cosines, and the AUC of the cosines of real pairs against null ones.

    vectors(key, vector), real(a, b), null(a, b); pairs without two vectors take no part. Vectors are brought to unit length
    before they meet. Ranks need the cosines several times, so they are folded and kept while the row is made, here and not later.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.withColumn("_l", length).where("_l > 0").select("key", F.transform("vector", lambda x: x.cast("double") / F.col("_l")).alias("_u"))
    side = lambda name: unit.select(F.col("key").alias(name), F.col("_u").alias(f"_{name}"))
    both = real.select("a", "b", F.lit(1).alias("real")).unionByName(null.select("a", "b", F.lit(0).alias("real")))
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    scored = both.join(side("a"), "a").join(side("b"), "b").select("real", F.round(dot, 9).alias("cos")).where("cos is not null")
    counts = scored.groupBy(F.lit(1).alias("_g"), "cos").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("real") == 1).alias("_p")).persist()
    mean = lambda n: F.try_divide(F.sum(F.col("cos") * n), F.sum(n).cast("double"))
    means = counts.groupBy("_g").agg(mean(F.col("_p")).alias("mean_real"), mean(F.col("_n") - F.col("_p")).alias("mean_null"))
    out = folded_auc(dealt_by_range(counts, ["_g"], "cos", few=True), ["_g"], "cos").join(means, "_g").select("n_pos", "n_neg", "mean_real", "mean_null", "auc")
    try:
        rows = out.collect()  # one row, none without pairs
    finally:
        counts.unpersist()
    return vectors.sparkSession.createDataFrame(rows, out.schema)
