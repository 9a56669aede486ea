"""Ranked and variable genes, marker scores against a background, enrichment against permuted genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import normal_two_sided
from .scoring import draw_order


def rank_genes(values: DataFrame, clusters: DataFrame, correct_ties: bool = False) -> DataFrame:
    """cluster, gene, u, z and p of the rank sum of each cluster's cells against all others, for genes that a cluster has.

    values(cell, gene, value) holds what is above zero, clusters(cell, cluster) all cells. The zeros of a gene are one tie below
    all else, so they are counted, not stored; equal values fold before the window, which sees the distinct values of a gene.
    """
    cells = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("na"))
    everyone = cells.agg(F.sum("na").alias("n")).withColumn("_", F.lit(0))
    folded = values.where("value > 0").join(clusters, "cell").groupBy("gene", "value", "cluster").agg(F.count(F.lit(1)).alias("k"))
    steps = folded.groupBy("gene", "value").agg(F.sum("k").alias("t"))
    gene = Window.partitionBy("gene")
    steps = steps.withColumn("before", F.sum("t").over(gene.orderBy("value")) - F.col("t")).withColumn("nonzero", F.sum("t").over(gene)).withColumn("cube", F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).over(gene))
    ranked = folded.join(steps, ["gene", "value"]).groupBy("cluster", "gene").agg(
        F.sum("k").alias("ka"), F.sum(F.col("k") * (F.col("before") + (F.col("t") + 1) / 2)).alias("r"), F.first("nonzero").alias("nonzero"), F.first("cube").alias("cube")
    )
    rows = ranked.join(cells, "cluster").withColumn("_", F.lit(0)).join(everyone, "_")
    zeros = F.col("n") - F.col("nonzero")
    total = F.col("r") + F.col("ka") * zeros + (F.col("na") - F.col("ka")) * (zeros + 1) / 2
    rows = rows.withColumn("u", total - F.col("na") * (F.col("na") + 1) / 2)
    n, na, z0 = (c.cast("double") for c in (F.col("n"), F.col("na"), zeros))
    ties = (F.col("cube") + z0 * z0 * z0 - z0) / (n * (n - 1)) if correct_ties else F.lit(0.0)
    sd = F.sqrt(na * (n - na) / 12 * (n + 1 - ties))
    z = F.try_divide(F.col("u") - na * (n - na) / 2, sd)
    return rows.select("cluster", "gene", "u", z.alias("z")).withColumn("p", normal_two_sided(F.col("z")))


def top_genes(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The n genes of largest z of each cluster with their rank; equal ones go by gene."""
    order = Window.partitionBy("cluster").orderBy(F.round("z", 9).desc(), "gene")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def variable_genes(values: DataFrame, cells: DataFrame, n: int = 2000, bins: int = 20) -> DataFrame:
    """gene, mean, dispersion, normalised dispersion and selected, by dispersion within equal bins of mean expression.

    values(cell, gene, value) without zeros, cells: all of them. Mean is ln(1 + mean), dispersion ln(variance / mean); within a
    bin it is centred and divided by its deviation, and a bin of one gene gives 1. Genes without variance are not selected.
    """
    total = cells.agg(F.count(F.lit(1)).alias("n")).withColumn("_", F.lit(0))
    sums = values.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).withColumn("_", F.lit(0)).join(total, "_")
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    told = sums.select("gene", F.round(F.log1p(mean), 9).alias("mean"), F.when((var > 1e-12) & (mean > 0), F.round(F.log(var / mean), 9)).alias("dispersion")).withColumn("_", F.lit(0))
    ends = told.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi")).withColumn("_", F.lit(0))
    place = F.greatest(F.ceil(F.round((F.col("mean") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins, 9)), F.lit(1))
    told = told.join(ends, "_").withColumn("bin", place)
    within = told.groupBy("bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("sd"))
    normal = F.when(F.col("dispersion").isNotNull(), F.when(F.col("sd").isNull(), F.lit(1.0)).otherwise(F.try_divide(F.col("dispersion") - F.col("m"), F.col("sd"))))
    out = told.join(within, "bin").select("gene", "mean", "dispersion", F.round(normal, 9).alias("normalised"))
    best = out.where("normalised is not null").orderBy(F.desc("normalised"), "gene").limit(n).select("gene", F.lit(True).alias("selected"))
    return out.join(best, "gene", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def background_scores(values: DataFrame, markers: DataFrame, clusters: DataFrame, least: int = 3, bins: int = 25, controls: int = 50, seed: str = "0") -> DataFrame:
    """cluster, label, markers present and score: mean marker value less the mean of control genes of like expression.

    Genes are ranked by their mean over all cells and cut into bins of equal rank; each bin that holds a marker of the label
    gives so many genes, drawn by a hash, and those that are no marker of it are its controls. Labels with fewer than
    `least` markers among the genes are left out. The mean over a cluster's cells of a score is a difference of sums by
    cluster and gene, so cells never carry scores. One task ranks the genes, a row for each.
    """
    cells = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"))
    by_gene = values.join(clusters, "cell").groupBy("cluster", "gene").agg(F.sum("value").alias("s"))
    total = by_gene.groupBy("gene").agg(F.round(F.sum("s"), 6).alias("s"))
    all_genes = total.agg(F.count(F.lit(1)).alias("n")).withColumn("_", F.lit(0))
    ranks = total.withColumn("r", F.rank().over(Window.orderBy("s"))).withColumn("_", F.lit(0)).join(all_genes, "_")
    cut = ranks.select("gene", F.floor(F.col("r") / F.greatest(F.round(F.col("n") / (bins - 1)), F.lit(1))).alias("cut"))
    present = markers.select("label", "gene").distinct().join(cut, "gene")
    present = present.join(present.groupBy("label").agg(F.count(F.lit(1)).alias("n_markers")).where(F.col("n_markers") >= least), "label")
    order = Window.partitionBy("cut").orderBy(draw_order(seed, F.col("gene")), "gene")
    drawn = cut.withColumn("k", F.row_number().over(order)).where(F.col("k") <= controls).select("cut", "gene")
    own = present.select("label", "cut").distinct().join(drawn, "cut").select("label", "gene").join(present, ["label", "gene"], "left_anti")
    sets = present.select("label", "gene", F.lit(1).alias("side")).unionByName(own.withColumn("side", F.lit(0)))
    sizes = sets.groupBy("label").agg(F.sum("side").alias("n_markers"), F.sum(1 - F.col("side")).alias("n_controls"))
    side = lambda v: F.sum(F.when(F.col("side") == v, F.col("s")).otherwise(0.0))
    sums = by_gene.join(sets, "gene").groupBy("cluster", "label").agg(side(1).alias("m"), side(0).alias("c"))
    out = sums.join(sizes, "label").join(cells, "cluster")
    score = F.col("m") / F.col("n_markers") - F.coalesce(F.try_divide("c", "n_controls"), F.lit(0.0))
    return out.select("cluster", "label", "n_markers", (score / F.col("cells")).alias("score"))


def _extremes(hits: DataFrame, own: Sequence[str]) -> DataFrame:
    """own, size and es of hits(own, _place, _w, _all): the running sum is extreme just before or at a hit."""
    whole, run = Window.partitionBy(*own), Window.partitionBy(*own).orderBy("_place")
    h = hits.withColumn("_k", F.row_number().over(run)).withColumn("_h", F.sum("_w").over(run)).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_s", F.sum("_w").over(whole))
    missed = F.coalesce(F.try_divide(F.col("_place") - F.col("_k"), F.col("_all") - F.col("_n")), F.lit(0.0))
    h = h.withColumn("_at", F.try_divide("_h", "_s") - missed).withColumn("_before", F.try_divide(F.col("_h") - F.col("_w"), F.col("_s")) - missed)
    ends = h.groupBy(*own).agg(F.max("_n").alias("size"), F.round(F.max("_at"), 9).alias("up"), F.round(F.min("_before"), 9).alias("down"))
    return ends.select(*own, "size", F.when(F.col("up") >= -F.col("down"), F.col("up")).otherwise(F.col("down")).alias("es"))


def permuted_enrichment(stats: DataFrame, sets: DataFrame, by: Sequence[str], draws: int = 1000, least: int = 15, most: int = 500, seed: str = "0") -> DataFrame:
    """by, name, size, es, nes and p of gene sets over genes ranked by a statistic, against sets of as many genes drawn at random.

    stats(by, gene, stat), sets(name, gene). A drawn set is only its places in the ranking: the first distinct ones of a row of
    hashes, whose weights are joined by place, so the ranking is not copied for each draw. p counts draws of the score's sign
    that are as extreme; nes is the score over the mean of those draws. More than a quarter of the genes in one set are not
    drawn evenly enough by so few hashes, and such sets are left out.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("stat"), "gene")
    told = stats.where(F.col("stat").isNotNull())
    counts = told.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    ranked = told.withColumn("_place", F.row_number().over(order)).join(counts, list(by)).select(*by, "gene", "_place", "_all", F.abs("stat").alias("_w"))
    hits = ranked.join(sets.select("name", "gene").distinct(), "gene")
    observed = _extremes(hits, [*by, "name"]).where(F.col("size").between(least, most) & F.col("es").isNotNull()).join(counts, list(by)).where(F.col("size") * 4 <= F.col("_all"))
    tries = observed.select(*by, "name", "size", "_all", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    tries = tries.withColumn("i", F.explode(F.sequence(F.lit(1), 2 * F.col("size") + 8)))
    place = F.pmod(F.conv(F.substring(draw_order(seed, F.col("name"), F.col("draw"), F.col("i"), *[F.col(b) for b in by]), 1, 12), 16, 10).cast("long"), F.col("_all")) + 1
    one = [*by, "name", "draw"]
    places = tries.withColumn("_place", place).groupBy(*one, "_place", "size", "_all").agg(F.min("i").alias("i"))
    places = places.withColumn("_r", F.row_number().over(Window.partitionBy(*one).orderBy("i"))).where(F.col("_r") <= F.col("size"))
    null = _extremes(places.withColumn("_place", F.col("_place").cast("int")).join(ranked.select(*by, "_place", "_w"), [*by, "_place"]), one)
    both = observed.join(null.select(*one, F.col("es").alias("null")), [*by, "name"], "left")
    same = F.signum("null") == F.signum("es")
    sums = both.groupBy(*by, "name", "size", "es").agg(F.count_if(same).alias("_m"), F.count_if(same & (F.abs("null") >= F.abs("es"))).alias("_k"), F.avg(F.when(same, F.abs("null"))).alias("_a"))
    return sums.select(*by, "name", "size", "es", F.try_divide("es", "_a").alias("nes"), ((F.col("_k") + 1) / (F.col("_m") + 1)).alias("p"))


def leading_edge(stats: DataFrame, sets: DataFrame, by: Sequence[str], scores: DataFrame, most: int = 20) -> DataFrame:
    """by, name and edge: the first `most` genes of a set from the end of the ranking that its score points to."""
    hits = stats.join(sets.select("name", "gene").distinct(), "gene").join(scores.select(*by, "name", "es"), [*by, "name"])
    way: Column = F.when(F.col("es") >= 0, -F.col("stat")).otherwise(F.col("stat"))
    own = Window.partitionBy(*by, "name").orderBy(way, "gene")
    kept = hits.where(F.signum("stat") == F.signum("es")).withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= most)
    return kept.groupBy(*by, "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col("gene").cast("string").alias("gene")))), lambda s: s["gene"]), ",").alias("edge"))
