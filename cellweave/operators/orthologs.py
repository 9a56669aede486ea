"""Ortholog tiers, token mapping reports and pruning of the gene universe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import ladder
from ..functions.stats import numbered
from .catalog import confidence

# Ortholog types, and biotypes (lower case) that get a token of their own.
ONE, MANY, NEW_BIOTYPES = "ortholog_one2one", ("ortholog_one2many", "ortholog_many2many"), ("protein_coding", "lncrna", "mirna")
NEW_TIERS = ("T3a_human_multi", "T3b_mouse_multi", "T4_new_token")


def _best(candidates: DataFrame, out: str) -> DataFrame:
    """gene with its candidate of largest identity (null as 0), the earlier on ties."""
    pick = F.max_by(F.struct("target", "token", "perc_id"), F.struct(F.coalesce("perc_id", F.lit(0.0)), -F.col("pos")))
    return candidates.groupBy("gene").agg(pick.alias(out))


def tiers(genes: DataFrame, human: DataFrame, mouse: DataFrame, human_tokens: DataFrame, mouse_tokens: DataFrame, links: DataFrame) -> DataFrame:
    """gene, biotype, tier, human_ortholog, mouse_ortholog and identity: the first tier whose condition holds.

    genes(gene, biotype); human and mouse (gene, target, orth_type, perc_id, pos) are candidates; the token tables have
    (target, token); links(mouse, human) are pairs known as homologs. Every step is one aggregate per gene over rows
    that meet the vocabulary, so no gene's candidates are collected.
    """
    h, m = human.join(human_tokens, "target"), mouse.join(mouse_tokens, "target")
    h1, m1 = h.where(F.col("orth_type") == ONE), m.where(F.col("orth_type") == ONE)
    pairs = h1.select("gene", F.col("target").alias("human"), F.col("token").alias("h_token"), F.col("perc_id").alias("h_id"), F.col("pos").alias("h_pos")).join(
        m1.select("gene", F.col("target").alias("mouse"), F.col("pos").alias("m_pos")), "gene"
    )
    three = pairs.join(links.distinct(), ["mouse", "human"], "left_semi").groupBy("gene").agg(F.min_by(F.struct("human", "mouse", "h_token", "h_id"), F.struct("h_pos", "m_pos")).alias("t1"))
    out = genes.join(three, "gene", "left")
    for rows, name in ((h1, "h1"), (m1, "m1"), (h.where(F.col("orth_type") != ONE), "hn"), (m.where(F.col("orth_type") != ONE), "mn")):
        out = out.join(_best(rows, name), "gene", "left")
    has = lambda c: F.col(c).isNotNull()
    own = F.lower(F.coalesce("biotype", F.lit(""))).isin(*NEW_BIOTYPES)
    tier = ladder([(has("t1"), F.lit("T1_tri_species")), (has("h1"), F.lit("T2a_human_one2one")), (has("m1"), F.lit("T2b_mouse_one2one")), (has("hn"), F.lit(NEW_TIERS[0])), (has("mn"), F.lit(NEW_TIERS[1])), (own, F.lit(NEW_TIERS[2]))], F.lit("excluded"))
    out = out.withColumn("tier", tier)
    by = lambda **c: ladder(((F.col("tier").startswith(t), F.col(v)) for t, v in c.items()))
    return out.select(
        "gene", "biotype", "tier",
        by(T1="t1.human", T2a="h1.target", T3a="hn.target").alias("human_ortholog"),
        by(T1="t1.mouse", T2a="m1.target", T2b="m1.target", T3b="mn.target").alias("mouse_ortholog"),
        by(T1="t1.h_token", T2a="h1.token", T2b="m1.token").alias("token_id"),
        by(T1="t1.h_id", T2a="h1.perc_id", T2b="m1.perc_id", T3a="hn.perc_id", T3b="mn.perc_id").alias("identity"),
    )


def with_new_tokens(tiered: DataFrame, after: int, prefix: int) -> DataFrame:
    """Tiers with dense token ids from after + 1, in gene order, for the tiers that have no token yet."""
    new = numbered(tiered.where(F.col("tier").isin(*NEW_TIERS)).drop("token_id"), "gene", prefix, after + 1, "token_id")
    return tiered.where(~F.col("tier").isin(*NEW_TIERS)).unionByName(new)


def with_confidence(mapped: DataFrame) -> DataFrame:
    """Mapped genes with the number of genes that share their token (old tokens only, else 1) and their confidence."""
    old = mapped.where(F.col("token_id").isNotNull() & ~F.col("tier").isin(*NEW_TIERS)).groupBy("token_id").agg(F.count(F.lit(1)).alias("collisions"))
    out = mapped.join(old, "token_id", "left").withColumn("collisions", F.coalesce("collisions", F.when(F.col("token_id").isNotNull(), 1).otherwise(0)))
    return out.withColumn("confidence", F.when(F.col("tier") != "excluded", confidence(F.col("tier"), F.lower("biotype"), F.col("collisions"), F.col("identity"))))


def collision_report(mapped: DataFrame) -> DataFrame:
    """token_id, n_genes and the genes of each old token that several genes share."""
    own = mapped.where(F.col("token_id").isNotNull() & ~F.col("tier").isin(*NEW_TIERS))
    out = own.groupBy("token_id").agg(F.count(F.lit(1)).alias("n_genes"), F.array_join(F.array_sort(F.collect_list("gene")), ";").alias("genes"))
    return out.where("n_genes > 1")


def prune(universe: DataFrame, stats: DataFrame, least_cells: int, least_counts: float) -> DataFrame:
    """Every gene of the universe with its statistics and why it goes (null: it stays)."""
    joined = universe.join(stats.select("gene", "n_nonzero", "total"), "gene", "left")
    cells, total = F.col("n_nonzero"), F.col("total")
    few = F.format_string(f"below_min_cells_%d<{least_cells}", cells)
    low = F.concat(F.lit("below_min_counts_"), F.round(total).cast("long").cast("string"), F.lit(f"<{least_counts:.0f}"))
    return joined.withColumn("reason", ladder([(cells.isNull(), F.lit("not_in_expression_stats")), (cells < least_cells, few), (total < least_counts, low)]))


def orphans(universe: DataFrame, stats: DataFrame) -> DataFrame:
    """Genes with statistics that the universe lacks."""
    return stats.join(universe.select("gene"), "gene", "left_anti")


def eligible_tokens(tokens: DataFrame, medians: DataFrame) -> DataFrame:
    """Genes that have both a token and a positive median."""
    return tokens.join(medians.where("median > 0").select("gene", "median"), "gene")


def id_spaces(names: DataFrame, spaces: dict[str, DataFrame]) -> DataFrame:
    """names(id) with a flag for each space(id) that holds the id."""
    out = names
    for name, space in spaces.items():
        out = out.join(space.select("id").distinct().withColumn(f"in_{name}", F.lit(True)), "id", "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return out
