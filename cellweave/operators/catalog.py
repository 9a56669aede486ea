"""Operators on identifiers, orthologs, study catalogs, labels and test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import ladder, normalize_ensembl, rejected


def first_wins(df: DataFrame, key: Column, position: str, last: bool = False) -> DataFrame:
    """One row for each key: the one of smallest (or largest) position. Kept rows are found by a combining aggregate."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(key.alias("_key")).agg(pick(F.struct(*df.columns), F.col(position)).alias("_row")).select("_row.*")


def resolve(raw: DataFrame, genes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """raw_id with gene_id and method: no gene, id itself, foreign id, symbol, synonym or unresolved, in this order.

    genes(gene_id, symbol, pos) and synonyms(alias, gene_id, pos) are dimensions; of equal names the first wins, and
    the optimizer picks a broadcast by their size.
    """
    own = raw.select("raw_id", normalize_ensembl(F.col("raw_id")).alias("_id"), F.lower(F.trim("raw_id")).alias("_name"), rejected(F.trim("raw_id")).alias("_junk"))
    ids = genes.select(F.col("gene_id").alias("_id"), F.col("gene_id").alias("_direct")).distinct()
    symbols = first_wins(genes.where("symbol is not null"), F.lower("symbol"), "pos").select(F.lower("symbol").alias("_name"), F.col("gene_id").alias("_symbol"))
    alias = first_wins(synonyms, F.lower("alias"), "pos").select(F.lower("alias").alias("_name"), F.col("gene_id").alias("_synonym"))
    joined = own.join(ids, "_id", "left").join(symbols, "_name", "left").join(alias, "_name", "left")
    foreign = F.col("_id").rlike(r"^ENS[A-Z]*G\d{11}$")
    method = ladder([(F.col("_junk"), F.lit("non_gene")), (F.col("_direct").isNotNull(), F.lit("direct")), (foreign, F.lit("foreign")), (F.col("_symbol").isNotNull(), F.lit("symbol")), (F.col("_synonym").isNotNull(), F.lit("synonym"))], F.lit("unresolved"))
    found = F.when(method == "direct", F.col("_direct")).when(method == "symbol", F.col("_symbol")).when(method == "synonym", F.col("_synonym"))
    return joined.select("raw_id", found.alias("gene_id"), method.alias("method"))


def universe(seen: DataFrame) -> DataFrame:
    """gene, n_studies (distinct), n_rows and the sorted list of studies, from seen(gene, study)."""
    # Studies are few for any gene next to its rows; distinct pairs come first, so a hot gene is combined early.
    pairs = seen.groupBy("gene", "study").agg(F.count("*").alias("n"))
    return pairs.groupBy("gene").agg(F.count("*").alias("n_studies"), F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.collect_list("study")), ";").alias("study_list"))


def best_candidate(orthologs: DataFrame) -> DataFrame:
    """gene, target and identity: the largest identity (null as 0), the earlier row on ties."""
    best = F.max_by(F.struct("target", "identity"), F.struct(F.coalesce("identity", F.lit(0.0)), -F.col("pos"))).alias("b")
    return orthologs.groupBy("gene").agg(best).select("gene", "b.target", "b.identity")


def confidence(tier: Column, biotype: Column, collisions: Column, identity: Column) -> Column:
    """high, medium or low for a gene's token, by tier, biotype, genes sharing the token and identity."""
    one = tier.isin("T1_tri_species", "T2a_human_one2one", "T2b_mouse_one2one")
    multi = tier.isin("T3a_human_multi", "T3b_mouse_multi")
    high = one & (biotype == "protein_coding") & (collisions <= 1) & F.coalesce(identity >= 70, F.lit(False))
    kept = multi & (collisions <= 2) & F.coalesce(identity >= 40, F.lit(False)) & ~biotype.isin("lncrna", "mirna")
    return ladder([(high, F.lit("high")), (one | kept, F.lit("medium"))], F.lit("low"))


def hybrid_median(rat: DataFrame, human: DataFrame) -> DataFrame:
    """gene, median and source: the ortholog's median if positive, else the gene's own, else 1. Left side: rat."""
    joined = rat.select("gene", F.col("median").alias("_r")).join(human.select("gene", F.col("median").alias("_h")), "gene", "left")
    source = ladder([(F.col("_h") > 0, F.lit("human")), (F.col("_r") > 0, F.lit("rat"))], F.lit("default"))
    return joined.select("gene", F.when(source == "human", F.col("_h")).when(source == "rat", F.col("_r")).otherwise(1.0).alias("median"), source.alias("source"))


def usability(score: Column) -> Column:
    return ladder([(score >= 70, F.lit("high")), (score >= 40, F.lit("medium"))], F.lit("low"))


def sample_band(n: Column) -> Column:
    bands = [(n == 0, "0"), (n <= 10, "1-10"), (n <= 50, "11-50"), (n <= 100, "51-100"), (n <= 500, "101-500")]
    return ladder(((c, F.lit(v)) for c, v in bands), F.lit("500+"))


def best_and_second(scores: DataFrame, group: list[str]) -> DataFrame:
    """group with best label, second label and margin, from scores(group, label, label_rank, score); ties by label_rank.

    One exchange: the two best of a group are cut before it as well as after it, so a task sends two rows a group.
    """
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "label_rank")
    top = scores.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    first, second = (lambda c, k=k: F.max(F.when(F.col("_r") == k, F.col(c))) for k in (1, 2))
    return top.groupBy(*group).agg(first("label").alias("best"), second("label").alias("second"), (first("score") - F.coalesce(second("score"), F.lit(0.0))).alias("margin"))


def conflict_free(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """key and value of the keys that have one distinct value only."""
    return pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_top")).where(F.col(value) == F.col("_top")).select(key, value)


def sex_state(fdr_m: Column, fdr_f: Column, z_m: Column, z_f: Column, alpha: float = 0.05) -> Column:
    """up_both, down_both, opposite, M_only, F_only or null (as text)."""
    m, f = F.coalesce(fdr_m < alpha, F.lit(False)), F.coalesce(fdr_f < alpha, F.lit(False))
    states = [(m & f & (z_m > 0) & (z_f > 0), "up_both"), (m & f & (z_m < 0) & (z_f < 0), "down_both"), (m & f, "opposite"), (f, "F_only"), (m, "M_only")]
    return ladder(((c, F.lit(v)) for c, v in states), F.lit("null"))


def transfer_state(auc: Column, p: Column, least_auc: float, below_p: float) -> Column:
    held = auc >= least_auc
    return ladder([(auc.isNull(), F.lit("no_human_block")), (held & F.coalesce(p < below_p, F.lit(False)), F.lit("PRESERVED")), (held, F.lit("WEAKENED"))], F.lit("LOST"))


def missing_tasks(manifest: DataFrame, n_tasks: int) -> DataFrame:
    """Task numbers below n_tasks that manifest(task) lacks."""
    return manifest.sparkSession.range(n_tasks).toDF("task").join(manifest.select(F.col("task").cast("long")), "task", "left_anti")


def owner_fill(lines: DataFrame, group: str, order: str, is_owner: Column, name: str) -> DataFrame:
    """Lines with the name of the last owner line at or before them in their file."""
    running = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("owner", F.last(F.when(is_owner, F.col(name)), ignorenulls=True).over(running))


def three_catalogs(studies: DataFrame, matrices: DataFrame, reviews: DataFrame) -> DataFrame:
    """Full outer join on accession of studies(title, summary, data_type), matrices(n_genes, n_cells) and reviews(topic).

    Absent sides get defaults; of equal accessions in a catalog the largest row counts, so that none is multiplied.
    """
    one = lambda df, *cols: df.groupBy("accession").agg(F.max(F.struct(*cols)).alias("r")).select("accession", "r.*", F.lit(True).alias("_has"))
    a = one(studies, "title", "summary", "data_type").withColumnRenamed("_has", "has_catalog")
    b = one(matrices, "n_genes", "n_cells").withColumnRenamed("_has", "has_matrix")
    c = one(reviews, "topic").withColumnRenamed("_has", "has_review")
    out = a.join(b, "accession", "full_outer").join(c, "accession", "full_outer")
    held = {h: F.coalesce(h, F.lit(False)) for h in ("has_catalog", "has_matrix", "has_review")}
    out = out.withColumns({**held, "data_type": F.coalesce("data_type", F.lit("unknown"))})
    return out.withColumns({"n_cells": F.coalesce("n_cells", F.lit(0)), "gene_count_valid": F.coalesce(F.col("n_genes").between(10_000, 100_000), F.lit(False))})


def usable_studies(catalog: DataFrame, excluded: DataFrame) -> DataFrame:
    """accession and reason (null: usable) of catalog(accession, data_type, is_rat, species, organisms, is_single_cell).

    is_rat and is_single_cell may be null: then species and after it the list of organisms decide, and null passes.
    """
    rat_like = lambda c: F.lower(c).contains("rattus") | F.lower(c).contains("rat")
    listed = F.exists(F.coalesce("organisms", F.array().cast("array<string>")), lambda o: F.lower(o).contains("rattus") | (F.lower(F.trim(o)) == "rat"))
    rat = ladder([(F.col("is_rat").isNotNull(), F.col("is_rat"))], F.coalesce(rat_like(F.col("species")), F.lit(False)) | F.coalesce(listed, F.lit(False)))
    marked = catalog.join(excluded.select("accession", F.lit(True).alias("_out")).distinct(), "accession", "left")
    single = F.coalesce(F.col("data_type") == "single_cell", F.lit(False))
    reasons = [(F.col("_out"), "excluded"), (~single, "not_sc_catalog"), (~rat, "not_rat"), (~F.coalesce("is_single_cell", F.lit(True)), "not_sc_llm")]
    return marked.select("accession", ladder((c, F.lit(v)) for c, v in reasons).alias("reason"))


def one_per_study(studies: DataFrame) -> DataFrame:
    """accession, data_type kept and why, of studies(accession, data_type, size_bytes) that may be bulk, single cell or both."""
    size = lambda kind: F.max(F.when(F.col("data_type") == kind, F.col("size_bytes")))
    per = studies.groupBy("accession").agg(size("single_cell").alias("s"), size("bulk").alias("b"))
    both = F.col("s").isNotNull() & F.col("b").isNotNull()
    single = ladder([(both, F.col("s") > 0.5 * F.col("b"))], F.col("s").isNotNull())
    why = F.when(both & single, "kept_single_cell").when(both, "kept_bulk")
    return per.select("accession", F.when(single, "single_cell").otherwise("bulk").alias("data_type"), why.alias("duplicate_resolved"))


def layered_lookup(*layers: DataFrame) -> DataFrame:
    """name and gene_id over layers(name, gene_id, pos): earlier layers win; the last row of the first, the first of the others."""
    every = None
    for k, layer in enumerate(layers):
        one = layer.select(F.lower("name").alias("name"), "gene_id", F.lit(k).alias("layer"), (-F.col("pos") if k == 0 else F.col("pos")).alias("pos"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("name").agg(F.min_by("gene_id", F.struct("layer", "pos")).alias("gene_id"), F.min("layer").alias("layer"))


def exact_or_lower(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """raw(raw_id) with the gene_id of lookup(name, gene_id): by the exact name, else by the lower-case one (the least id on ties)."""
    exact = lookup.groupBy(F.col("name").alias("raw_id")).agg(F.min("gene_id").alias("_a"))
    lower = lookup.groupBy(F.lower("name").alias("_low")).agg(F.min("gene_id").alias("_b"))
    return raw.withColumn("_low", F.lower("raw_id")).join(exact, "raw_id", "left").join(lower, "_low", "left").select("raw_id", F.coalesce("_a", "_b").alias("gene_id"))


def single_gated(synonyms: DataFrame, gate: DataFrame) -> DataFrame:
    """alias and gene_id of synonyms(aliases, ids, pos), both `;` lists: rows with exactly one id in gate(gene_id); first alias wins."""
    cut = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    ids = synonyms.select("pos", cut(F.col("aliases")).alias("aliases"), F.explode(F.array_distinct(cut(F.col("ids")))).alias("gene_id"))
    known = ids.join(gate.select("gene_id").distinct(), "gene_id", "left_semi")
    one = known.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.min("gene_id").alias("gene_id"), F.first("aliases").alias("aliases")).where("n = 1")
    named = one.select("pos", "gene_id", F.explode("aliases").alias("alias"))
    return named.groupBy(F.lower("alias").alias("alias")).agg(F.min_by("gene_id", "pos").alias("gene_id"))


def set_difference(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key and side (missing, unexpected) of the ids that only one of the two has."""
    a, b = found.select(key).distinct(), expected.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("unexpected")))
