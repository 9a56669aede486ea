"""Operators on marker tables and on the labels that annotators give to clusters and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import label_words
from .catalog import first_wins

# Parts of a label that mark an immune cell.
IMMUNE = ("t cell", "b cell", "nk cell", "nkt", "natural killer", "monocyte", "macrophage", "dendritic", "lymphocyte", "plasma cell", "plasmablast", "mast cell", "neutrophil", "granulocyte", "leukocyte", "myeloid", "cytotoxic", "treg", "regulatory t", "t helper", "th17")


def marker_sets(markers: DataFrame, genes: DataFrame, by: list[str], species: tuple[str, ...] = ("Mm Hs", "Mm", "Hs")) -> DataFrame:
    """by, n_markers and the sorted gene ids of each marker set: markers(species, symbol, by), genes(symbol, gene_id, pos).

    Symbols meet without case and blanks; of genes of one symbol the last wins. Symbols of no gene give nothing.
    """
    named = genes.where("symbol is not null and trim(symbol) <> '' and gene_id is not null")
    last = first_wins(named, F.upper(F.trim("symbol")), "pos", last=True).select(F.upper(F.trim("symbol")).alias("_s"), "gene_id")
    found = markers.where(F.col("species").isin(*species)).withColumn("_s", F.upper(F.trim("symbol"))).join(last, "_s")
    return found.groupBy(*by).agg(F.array_sort(F.collect_set("gene_id")).alias("genes")).select(*by, F.size("genes").alias("n_markers"), "genes")


def unmapped_symbols(markers: DataFrame, genes: DataFrame) -> DataFrame:
    """Upper-case marker symbols that no gene has."""
    return markers.select(F.upper(F.trim("symbol")).alias("symbol")).distinct().join(genes.select(F.upper(F.trim("symbol")).alias("symbol")), "symbol", "left_anti")


def organ_sets(everywhere: DataFrame, in_organ: DataFrame, by: str, genes: str) -> DataFrame:
    """Marker sets of all types, an organ's own set in place of the general one where there is one."""
    own = in_organ.select(by, F.col(genes).alias("_own"))
    return everywhere.join(own, by, "full").select(by, F.coalesce("_own", genes).alias(genes), F.col("_own").isNotNull().alias("from_organ"))


def annotator_agreement(first: DataFrame, second: DataFrame, by: list[str], cluster: str, label: str) -> DataFrame:
    """by, clusters that both labelled, and how many labels agree without case; null labels agree with nothing."""
    both = first.select(*by, cluster, F.lower(label).alias("_a")).join(second.select(*by, cluster, F.lower(label).alias("_b")), [*by, cluster])
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("_a") == F.col("_b")).alias("n_match")).withColumn("share", F.col("n_match") / F.col("n_clusters"))


def best_label(scores: DataFrame, cells: DataFrame, cluster: str, above: float = 0.0) -> DataFrame:
    """cluster, n_cells, label and score: the label of highest mean score, Unknown unless above the limit.

    scores(cell, label, score, place), cells(cell, cluster); equal means go to the smaller place.
    """
    means = scores.join(cells, "cell").groupBy(cluster, "label").agg(F.round(F.avg("score"), 9).alias("m"), F.min("place").alias("p"))
    best = means.groupBy(cluster).agg(F.max_by(F.struct("label", "m"), F.struct("m", -F.col("p"))).alias("b"))
    sizes = cells.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_cells"))
    return best.join(sizes, cluster).select(cluster, "n_cells", F.when(F.col("b.m") > above, F.col("b.label")).otherwise("Unknown").alias("label"), F.col("b.m").alias("score"))


def gated_label(scores: DataFrame, gates: DataFrame, fallback: Column) -> DataFrame:
    """cell, label, score and gated: the best label; if its gate is shut for the cell, the best of the fallback labels.

    scores(cell, label, score, place), gates(cell, label) the gated labels that the cell does not express. Without a
    fallback score the first label stays. Equal scores go to the smaller place.
    """
    order = F.struct("score", -F.col("place"))
    row = F.struct("label", "score")
    best = scores.groupBy("cell").agg(F.max_by(row, order).alias("b"), F.max_by(row, F.when(fallback, order)).alias("f"))
    shut = best.withColumn("label", F.col("b.label")).join(gates.select("cell", "label", F.lit(True).alias("_shut")).distinct(), ["cell", "label"], "left")
    gated = F.coalesce(F.col("_shut"), F.lit(False)) & F.col("f").isNotNull()
    use = F.when(gated, F.col("f")).otherwise(F.col("b"))
    return shut.select("cell", use["label"].alias("label"), use["score"].alias("score"), gated.alias("gated"))


def class_panel(genes: DataFrame, canonical: DataFrame, label: str, top: int) -> DataFrame:
    """label and its panel: the canonical genes in their order, then the top genes of positive fold change, each once.

    genes(label, gene, change), canonical(label, gene, pos); equal changes go by gene.
    """
    own = genes.where("change > 0").groupBy(label).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("change")).alias("o"), "gene"))), 1, top).alias("t"))
    listed = canonical.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "gene"))).alias("c"))
    empty = F.array().cast("array<string>")
    name = lambda c: F.coalesce(F.transform(c, lambda x: x["gene"].cast("string")), empty)
    return listed.join(own, label, "full").select(label, F.array_distinct(F.concat(name(F.col("c")), name(F.col("t")))).alias("panel"))


def state_labels(cells: DataFrame, clusters: DataFrame, consensus: DataFrame) -> DataFrame:
    """cells(sample, barcode) with cluster, consensus label and the state sample_c<cluster>; null without a cluster.

    clusters(sample, barcode, cluster), consensus(sample, cluster, label).
    """
    out = cells.join(clusters, ["sample", "barcode"], "left").join(consensus, ["sample", "cluster"], "left")
    return out.withColumn("state", F.concat("sample", F.lit("_c"), F.col("cluster").cast("string")))


def merge_labels(assigned: DataFrame, merges: DataFrame, label: str, source: str, tag: str) -> DataFrame:
    """assigned with the labels of merges(old, new) replaced, and the source of replaced rows set to tag."""
    out = assigned.join(merges.select(F.col("old").alias(label), F.col("new").alias("_new")), label, "left")
    return out.withColumn(label, F.coalesce("_new", label)).withColumn(source, F.when(F.col("_new").isNotNull(), tag).otherwise(F.col(source))).drop("_new")


def harmonise(labels: DataFrame, types: DataFrame) -> DataFrame:
    """label and the reference type it stands for: types(type, place).

    The type itself, else the one that shares most words (the smaller place on ties), else the immune type where the
    label is of an immune cell, else null. Labels and types meet by words, so only pairs that share one are made.
    """
    names = labels.select("label").distinct()
    immune = types.where(F.lower("type").contains("immune")).agg(F.min_by("type", "place").alias("_immune"))
    keyed = types.join(immune.withColumnRenamed("_immune", "type"), "type", "left_anti").select("type", "place", F.explode(label_words(F.col("type"))).alias("w"))
    shared = names.select("label", F.explode(label_words(F.col("label"))).alias("w")).join(keyed, "w").groupBy("label", "type").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("p"))
    best = shared.groupBy("label").agg(F.max_by("type", F.struct("n", -F.col("p"))).alias("_best"))
    is_immune = F.lower("label").rlike("immune|" + "|".join(IMMUNE))
    exact = types.select(F.col("type").alias("label"), F.col("type").alias("_exact")).distinct()
    target = immune.first()["_immune"]  # one name
    return names.join(exact, "label", "left").join(best, "label", "left").select("label", F.coalesce("_exact", "_best", F.when(is_immune, F.lit(target))).alias("type"))
