"""Operators on counts(cell, gene, count): merging, quality control, gene statistics, ranked token sequences, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import guarded_corr

QUARTILES = (0.25, 0.5, 0.75, 0.95)


def merge_duplicates(counts: DataFrame) -> DataFrame:
    """One row for each (cell, gene): counts of genes that were mapped to one id are summed."""
    return counts.groupBy("cell", "gene").agg(F.sum("count").alias("count"))


def cell_stats(counts: DataFrame, is_mito: Column) -> DataFrame:
    """cell, library_size, n_genes and mito_fraction (0 for an empty library)."""
    total = F.sum("count")
    mito = F.sum(F.when(is_mito, F.col("count")).otherwise(0.0))
    return counts.groupBy("cell").agg(total.alias("library_size"), F.count_if(F.col("count") > 0).alias("n_genes"), F.coalesce(F.try_divide(mito, total), F.lit(0.0)).alias("mito_fraction"))


def zscore_filter(stats: DataFrame, sample: str, limit: float = 3.0, least_cells: int = 3) -> DataFrame:
    """Cells whose library size and mito fraction lie within limit population deviations of their sample's mean.

    Samples of fewer than least_cells cells pass whole, and so does a measure that does not vary. Moments are grouped
    by sample with partial sums and joined back, so a sample that holds most cells is no hot window.
    """
    moments = stats.groupBy(sample).agg(F.count("*").alias("_n"), *[f(c).alias(f"_{p}_{c}") for c in ("library_size", "mito_fraction") for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0))
    near = (F.abs(z("library_size")) < limit) & (F.abs(z("mito_fraction")) < limit)
    return stats.join(moments, sample).where((F.col("_n") < least_cells) | near).select(*stats.columns)


def core_gene_filter(counts: DataFrame, core: DataFrame, more_than: int = 6, least_genes: int = 200) -> DataFrame:
    """Cells that express more than more_than genes of core(gene) and at least least_genes genes."""
    marked = counts.where("count > 0").join(core.select("gene", F.lit(1).alias("_core")), "gene", "left")
    per_cell = marked.groupBy("cell").agg(F.count("_core").alias("n_core"), F.count("*").alias("n_genes"))
    return per_cell.where((F.col("n_core") > more_than) & (F.col("n_genes") >= least_genes))


def gene_stats(counts: DataFrame) -> DataFrame:
    """gene, n_nonzero, total and mean_nonzero (four places)."""
    on = F.when(F.col("count") > 0, F.col("count"))
    return counts.groupBy("gene").agg(F.count(on).alias("n_nonzero"), F.sum("count").alias("total"), F.round(F.try_divide(F.sum(on), F.count(on)), 4).alias("mean_nonzero"))


def derived_stats(counts: DataFrame, n_cells: int | Column) -> DataFrame:
    """Mean, variance and deviation of nonzero counts (population), mean over all cells and share of zeros."""
    sums = counts.where("count > 0").groupBy("gene").agg(F.count("*").alias("n"), F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
    cells = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    mean = F.col("s") / F.col("n")
    var = F.when(F.col("n") <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return sums.select("gene", F.col("n").alias("n_nonzero"), mean.alias("mean_nonzero"), var.alias("var_nonzero"), F.sqrt(var).alias("std_nonzero"), (F.col("s") / cells).alias("mean_all"), (1 - F.col("n") / cells).alias("zero_fraction"))


def gene_quantiles(counts: DataFrame, least_cells: int = 10) -> DataFrame:
    """Exact interpolated quantiles of the nonzero counts of genes with at least least_cells of them.

    Equal counts are folded first, so a gene's state is its distinct values, not its cells.
    """
    folded = counts.where("count > 0").groupBy("gene", "count").agg(F.count("*").alias("times"))
    out = folded.groupBy("gene").agg(F.sum("times").alias("n_nonzero"), F.percentile("count", F.array(*map(F.lit, QUARTILES)), F.col("times")).alias("q"))
    return out.where(F.col("n_nonzero") >= least_cells).select("gene", "n_nonzero", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p95"))])


def rank_tokens(counts: DataFrame, medians: DataFrame, longest: int = 2048) -> DataFrame:
    """cell, rank, gene and value: log2(1 + count / median) from the largest, ties by gene, at most longest a cell.

    medians(gene, median) is a gene dimension; genes without a positive median have no token.
    """
    valued = _valued(counts, medians)
    # Ties are decided on rounded values, so that the order does not hang on the last bits of the logarithm.
    order = Window.partitionBy("cell").orderBy(F.desc(F.round("value", 6)), "gene")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= longest).select("cell", "rank", "gene", "value")


def _valued(counts: DataFrame, medians: DataFrame) -> DataFrame:
    on = counts.where("count > 0").join(medians.where("median > 0").select("gene", "median"), "gene")
    return on.select("cell", "gene", F.log2(1 + F.col("count") / F.col("median")).alias("value"))


def ranked_lists(counts: DataFrame, medians: DataFrame, longest: int = 2048) -> DataFrame:
    """token_lists of rank_tokens, without a rank for each row: a cell's tokens are gathered once and put in order as an array."""
    last = F.struct(~F.isnan("value"), (-F.round("value", 6)).alias("o"), "gene", "value")  # as in rank_tokens, the largest first
    rows = _valued(counts, medians).groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(last)), 1, longest).alias("t"))
    return rows.select("cell", F.col("t.gene").alias("input_ids"), F.col("t.value").alias("values"), F.size("t").alias("n_tokens"))


def pad_tokens(ranked: DataFrame, length: int = 2048) -> DataFrame:
    """cell, input_ids and values of fixed length (0 beyond the tokens), and n_tokens."""
    return padded(token_lists(ranked), length)


def token_lists(ranked: DataFrame) -> DataFrame:
    """cell, input_ids and values in the order of their ranks, and n_tokens."""
    rows = ranked.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("rank", "gene", "value"))).alias("t"))
    return rows.select("cell", F.col("t.gene").alias("input_ids"), F.col("t.value").alias("values"), F.size("t").alias("n_tokens"))


def padded(rows: DataFrame, length: int = 2048) -> DataFrame:
    """rows with input_ids and values filled up to length with zeros."""
    pad = lambda a, zero: F.concat(a, F.array_repeat(zero, F.greatest(length - F.size(a), F.lit(0))))
    return rows.withColumns({"input_ids": pad("input_ids", F.lit(0).cast("long")), "values": pad("values", F.lit(0.0))})


def promote_priority(ranked: DataFrame, priority: DataFrame, base: int, window: int) -> DataFrame:
    """The base tokens of each cell, with priority genes ranked up to window in place of the lowest other ones.

    As many are promoted as are both missing from the base and matched by other genes in it; the best ranked first.
    """
    marked = ranked.where(F.col("rank") <= window).join(priority.select("gene", F.lit(True).alias("_p")), "gene", "left")
    marked = marked.withColumn("_p", F.coalesce("_p", F.lit(False))).withColumn("_in", F.col("rank") <= base)
    # One order serves both counts and both places: the place from the end is the count less what lies before.
    upto = Window.partitionBy("cell").orderBy("rank")
    cell = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted, spare = F.col("_p") & ~F.col("_in"), ~F.col("_p") & F.col("_in")
    told = marked.withColumns({"_w": F.count_if(wanted).over(cell), "_s": F.count_if(spare).over(cell), "_nw": F.count_if(wanted).over(upto), "_ns": F.count_if(spare).over(upto)})
    k = F.least("_w", "_s")
    judged = told.withColumn("_keep", F.when(wanted, F.col("_nw") <= k).when(spare, F.col("_s") - F.col("_ns") + 1 > k).otherwise(F.col("_in")))
    return judged.where("_keep").select("cell", "rank", "gene", "value", F.col("_p").alias("is_priority"))


def coexpression_pairs(counts: DataFrame, n_cells: int, least_share: float = 0.05, least_cells: int = 10, above: float = 0.8) -> DataFrame:
    """Gene pairs whose counts correlate above a limit over the cells that express both.

    Genes in at most least_share of the cells are left out first, by a join that keeps the count table in place.
    """
    on = counts.where("count > 0").select("cell", "gene", "count")
    common = on.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") > least_share * n_cells)
    own = on.join(common.select("gene"), "gene", "left_semi").select("cell", "gene", "count")
    left, right = own.toDF("cell", "gene_1", "x"), own.toDF("cell", "gene_2", "y")
    pairs = left.join(right, "cell").where("gene_1 < gene_2")
    out = pairs.groupBy("gene_1", "gene_2").agg(F.count("*").alias("n_cells"), guarded_corr("x", "y").alias("r"))
    return out.where((F.col("n_cells") >= least_cells) & (F.col("r") > above))


def normalize_total(counts: DataFrame, target: float = 10_000.0) -> DataFrame:
    """cell, gene, count and value: counts scaled so that each cell sums to target; an empty library stays 0."""
    library = counts.groupBy("cell").agg(F.sum("count").alias("_lib"))
    return counts.join(library, "cell").select("cell", "gene", "count", F.coalesce(F.try_divide(F.col("count") * target, F.col("_lib")), F.lit(0.0)).alias("value"))


def project(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts on the ids of mapping(gene, target): many to one is summed, the library is the whole cell's."""
    library = counts.groupBy("cell").agg(F.sum("count").alias("library_size"))
    sums = counts.join(mapping, "gene").groupBy("cell", "target").agg(F.sum("count").alias("count"))
    return sums.join(library, "cell").select("cell", "target", "count", "library_size", F.try_divide("count", "library_size").alias("fraction"))


def reverse_normalize(values: DataFrame, matrix: str, value: str) -> DataFrame:
    """Approximate counts from normalized values(matrix, cell, gene, value): logs undone, then each cell's least value is one.

    A matrix of values below 20 is taken for logs. A quotient that rounding left just below a whole number counts as it.
    """
    tops = values.groupBy(matrix).agg(F.max(value).alias("_top"))
    plain = values.join(tops, matrix).withColumn("_x", F.when(F.col("_top") < 20, F.expm1(value)).otherwise(F.col(value)))
    least = plain.where("_x > 0").groupBy(matrix, "cell").agg(F.min("_x").alias("_least"))
    count = F.coalesce(F.floor(F.col("_x") / F.col("_least") + 1e-7), F.lit(0)).cast("long")
    return plain.join(least, [matrix, "cell"], "left").select(matrix, "cell", "gene", count.alias("count"))
