"""Operators on cluster labels: marker scores, consensus of annotators, precedence of sources, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marker_means(values: DataFrame, markers: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, label and mean over the cluster's cells of each label's mean marker value (absent as 0).

    values(cell, gene, value), markers(label, gene), clusters(cell, cluster). Sums are made by cluster, not by cell: the
    mean of a mean over a fixed set of genes is a sum over both.
    """
    cells = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"))
    sizes = markers.groupBy("label").agg(F.count(F.lit(1)).alias("genes"))
    by_gene = values.join(clusters, "cell").groupBy("cluster", "gene").agg(F.sum("value").alias("s"))
    sums = by_gene.join(markers, "gene").groupBy("cluster", "label").agg(F.sum("s").alias("s"))
    return sums.join(cells, "cluster").join(sizes, "label").select("cluster", "label", (F.col("s") / (F.col("cells") * F.col("genes"))).alias("score"))


def sctype(values: DataFrame, markers: DataFrame, clusters: DataFrame, least_positive: int = 2) -> DataFrame:
    """cluster, label and score: sums over cells of (2 x positive - negative) scaled values / sqrt(markers).

    markers(label, gene, sign) with sign 1 or -1; only markers among the genes of values count, and a label needs
    least_positive positive ones.
    """
    known = markers.join(values.select("gene").distinct(), "gene", "left_semi")
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sign") > 0).alias("positive")).where(F.col("positive") >= least_positive)
    by_gene = values.join(clusters, "cell").groupBy("cluster", "gene").agg(F.sum("value").alias("s"))
    weight = F.when(F.col("sign") > 0, 2.0).otherwise(-1.0)
    sums = by_gene.join(known, "gene").groupBy("cluster", "label").agg(F.sum(weight * F.col("s")).alias("s"))
    return sums.join(sizes, "label").select("cluster", "label", (F.col("s") / F.sqrt("n")).alias("score"))


def two_annotators(first: DataFrame, second: DataFrame, key: list[str], consensus: DataFrame) -> DataFrame:
    """first(key, label, tissue) with the second's label and the consensus(label, second, tissue, consensus) of the three.

    Without a second label it is unknown; without a consensus the first label stands.
    """
    both = first.join(second.select(*key, F.col("label").alias("second")), key, "left").withColumn("second", F.coalesce("second", F.lit("unknown")))
    out = both.join(consensus, ["label", "second", "tissue"], "left")
    source = F.when(F.col("consensus").isNotNull(), "consensus").otherwise("fallback")
    return out.select(*first.columns, "second", F.coalesce("consensus", "label").alias("consensus"), source.alias("source"))


def label_triples(assigned: DataFrame, by: list[str]) -> DataFrame:
    """n_clusters, cells, mean confidence and mean margin for each combination of labels; null labels are unknown."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by]
    return assigned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n_cells").alias("n_cells"), F.avg("confidence").alias("confidence"), F.avg("margin").alias("margin"))


def first_told(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def adopt_labels(ours: DataFrame, authors: DataFrame, least_share: float = 0.3) -> DataFrame:
    """sample, author_sample, overlap and share: the author's sample that shares most barcodes, if it shares enough.

    ours(sample, barcode) and authors(author_sample, barcode) meet on the barcode only; ties go to the smaller name.
    """
    a = ours.where("sample is not null").select("sample", "barcode").distinct()
    lists = authors.select("author_sample", "barcode").distinct().groupBy("barcode").agg(F.array_sort(F.collect_list(F.struct("author_sample"))).alias("_s"))
    # A barcode's samples go to each of ours as one list, which is shorter to send than pairs; pairs are made and counted there.
    met = a.join(lists, "barcode").select("sample", "_s").repartition("sample")
    pairs = met.select("sample", F.inline("_s")).groupBy("sample", "author_sample").agg(F.count(F.lit(1)).alias("overlap"))
    first = F.struct((-F.col("overlap")).alias("o"), F.col("author_sample").isNull().alias("none"), "author_sample")
    best = pairs.groupBy("sample").agg(F.min(first).alias("_b")).select("sample", F.col("_b.author_sample").alias("author_sample"), (-F.col("_b.o")).alias("overlap"))
    sizes = a.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return best.join(sizes, "sample").select("sample", "author_sample", "overlap", (F.col("overlap") / F.col("n")).alias("share")).where(F.col("share") >= least_share)


def coverage(samples: DataFrame, tissues: DataFrame, told: Column, kind: str) -> DataFrame:
    """Each listed tissue, with samples or not: how many, the share told, and its kinds as `kind:n` by number, then name."""
    own = samples.select("tissue", told.alias("_told"), F.coalesce(F.col(kind), F.lit("unknown")).alias("_kind"))
    kinds = own.groupBy("tissue", "_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("_told").alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "_kind"))), lambda s: F.concat(s["_kind"], F.lit(":"), (-s["n"]).cast("string")))
    per = kinds.groupBy("tissue").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.array_join(parts, "; ").alias("kinds"))
    return tissues.join(per, "tissue", "left").select("tissue", F.coalesce("n", F.lit(0)).alias("n_samples"), F.coalesce(F.round(100 * F.col("t") / F.col("n"), 1), F.lit(0.0)).alias("pct_told"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def majority(votes: DataFrame, by: list[str], kind: str, least: float = 0.6, strict: bool = False, other: str = "mixed") -> DataFrame:
    """The kind that holds at least (strict: more than) a share of a group's votes, else other; and that share."""
    counts = votes.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*by).agg(F.sum("n").alias("all"), F.max_by(F.struct("n", kind), F.struct("n", kind)).alias("b"))
    share = F.col("b.n") / F.col("all")
    return top.select(*by, F.when(share > least if strict else share >= least, F.col(f"b.{kind}")).otherwise(other).alias(kind), share.alias("share"))


def drop_small(cells: DataFrame, label: str, state: str, least: int = 20) -> DataFrame:
    """Cells with a known label whose state has at least so many cells; counts are joined back, no hot window."""
    known = cells.where(F.col(label).isNotNull() & ~F.lower(label).isin("unknown", ""))
    big = known.groupBy(state).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(state)
    return known.join(big, state, "left_semi")


def select_samples(inventory: DataFrame, study: str, organism: str, condition: str | None = None, sex: str | None = None, exclude: str | None = None) -> DataFrame:
    """Samples of a study by a ladder of tests: in the corpus, organism, condition, sex, title, and one for each accession.

    A test whose field is not told passes, but for the organism. Of equal accessions the first sample id stays.
    """
    told = lambda c: F.coalesce(F.nullif(F.lower(c), F.lit("")), F.lit(None))
    out = inventory.where((F.col("accession") == study) & F.coalesce(F.col("in_corpus"), F.lit(False)))
    out = out.where(F.coalesce(F.lower("organism").contains(organism.lower()), F.lit(False)))
    for field, want in (("condition", condition), ("sex", sex)):
        if want is not None:
            out = out.where(told(field).isNull() | (told(field) == want.lower()))
    if exclude:
        out = out.where(~F.coalesce(F.col("title").rlike(f"(?i){exclude}"), F.lit(False)))
    first = Window.partitionBy(F.coalesce(F.col("gsm").cast("string"), F.concat(F.lit("sample "), F.col("sample_id").cast("string")))).orderBy("sample_id")
    return out.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
