"""Operators on study catalogs, matrix statistics and result blocks: best matrices, validators, totals and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import ladder, normalize_ensembl
from ..functions.stats import benjamini_hochberg
from ..sources.readers import file_format

# Bands of a study's gene count by their lower limits.
GENE_BANDS = ((0, "Suspicious low"), (5_000, "Low (subset?)"), (15_000, "Normal (protein-coding)"), (25_000, "Normal (with ncRNA)"), (40_000, "High (check orientation)"), (100_000, "Suspicious high"))


def best_matrices(matrices: DataFrame, key: str) -> DataFrame:
    """key, n_genes, n_cells, n_samples, confidence, data_type and whether only unfiltered matrices were there.

    matrices(key, n_genes, n_cells, n_samples, confidence, unfiltered). Of a study's cell matrices a filtered one goes
    first, then the surer, then the larger; of its sample matrices the surer, then the larger. Cells are taken unless the
    samples are surer or the cells unfiltered; unfiltered cells stand alone with low confidence. Equal matrices: more genes.
    """
    rank = ladder([(F.col("confidence") == c, F.lit(r)) for c, r in (("high", 3), ("medium", 2), ("low", 1))], F.lit(0))
    has_cells = F.col("n_cells") > 0
    row = F.struct("n_genes", "n_cells", "n_samples", "confidence", "unfiltered", rank.alias("rank"))
    sc = F.max_by(F.when(has_cells, row), F.when(has_cells, F.struct((~F.col("unfiltered")).alias("f"), rank.alias("r"), "n_cells", "n_genes")))
    samples = ~F.coalesce(has_cells, F.lit(False)) & (F.col("n_samples") > 0)
    bulk = F.max_by(F.when(samples, row), F.when(samples, F.struct(rank.alias("r"), "n_samples", "n_genes")))
    best = matrices.groupBy(key).agg(sc.alias("s"), bulk.alias("b"))
    level = lambda c: F.coalesce(F.col(c + ".rank"), F.lit(0))
    cells = F.col("s").isNotNull() & ~F.coalesce(F.col("s.unfiltered"), F.lit(False)) & (level("s") >= level("b"))
    kind = ladder([(cells, F.lit("single_cell")), (F.col("b").isNotNull(), F.lit("bulk")), (F.col("s").isNotNull(), F.lit("unfiltered"))])
    use = F.when(kind == "bulk", F.col("b")).otherwise(F.col("s"))
    return best.select(
        key, use["n_genes"].alias("n_genes"), F.when(kind != "bulk", use["n_cells"]).alias("n_cells"), F.when(kind == "bulk", use["n_samples"]).alias("n_samples"),
        F.when(kind == "unfiltered", "low").otherwise(use["confidence"]).alias("confidence"), F.when(kind == "unfiltered", "single_cell").otherwise(kind).alias("data_type"), F.coalesce(kind == "unfiltered", F.lit(False)).alias("only_unfiltered"),
    )


def repeated_keys(catalog: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return catalog.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_values(catalog: DataFrame, columns: list[str], more_than: int = 3) -> DataFrame:
    """field, value, studies and whether so many share a value: values above 0 of each column."""
    each = catalog.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("value")) for c in columns])).alias("v")).select("v.*").where("value > 0")
    return each.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("suspicious", F.col("n") > more_than)


def gene_band(n: Column) -> Column:
    """Band of a gene count above 0; null for none."""
    return F.when(n > 0, ladder([(n >= low, F.lit(name)) for low, name in reversed(GENE_BANDS)]))


def missing_values(catalog: DataFrame, columns: list[str]) -> DataFrame:
    """field, rows, and how many hold null: all columns are counted in one pass."""
    counts = catalog.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_null")) for c in columns])).alias("v")).select("v.field", F.col("_n").alias("n"), "v.n_null")


def totals_by(matrices: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, matrices, cells, samples and most genes for each single column and over all, in one aggregate."""
    names = F.array(F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    # Rows are folded over all columns first, so the copies for each dimension are of few rows.
    folded = matrices.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.sum("n_cells").alias("cells"), F.sum("n_samples").alias("samples"), F.max("n_genes").alias("genes"))
    return folded.select(F.explode(names).alias("v"), "n", "cells", "samples", "genes").groupBy("v.dimension", "v.value").agg(F.sum("n").alias("n_matrices"), F.sum("cells").alias("n_cells"), F.sum("samples").alias("n_samples"), F.max("genes").alias("most_genes"))


def by_species(studies: DataFrame, organisms: str, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Studies with an organism whose name holds one of names (without case), and the others; null and empty lists are among the others."""
    own = F.coalesce(F.exists(F.col(organisms), lambda o: F.coalesce(F.lower(o).rlike("|".join(n.lower() for n in names)), F.lit(False))), F.lit(False))
    return studies.where(own), studies.where(~own)


def match_rates(raw: DataFrame, known: DataFrame, by: list[str], least: float = 0.3) -> DataFrame:
    """by, distinct raw ids, the share of them that is known, and whether it reaches the least share. All ids count."""
    ids = raw.select(*by, "raw_id").distinct().join(known.select("raw_id", F.lit(1).alias("_k")).distinct(), "raw_id", "left")
    out = ids.groupBy(*by).agg(F.count(F.lit(1)).alias("n_raw"), F.count("_k").alias("n_known"))
    rate = F.col("n_known") / F.col("n_raw")
    return out.select(*by, "n_raw", "n_known", F.round(rate, 4).alias("match_rate"), (rate >= least).alias("usable"))


def composition(clusters: DataFrame, by: list[str], label: str, least_types: int = 3, least_cells: int = 50) -> DataFrame:
    """by, cells, label kinds, share of the commonest label (smaller name on ties), and readiness.

    Ready: least_types kinds with least_cells cells each, Unknown left out.
    """
    kinds = clusters.groupBy(*by, label).agg(F.sum("n_cells").alias("_n"))
    known = F.col(label) != "Unknown"
    top = F.max("_n").alias("_m")
    out = kinds.groupBy(*by).agg(F.sum("_n").alias("n_cells"), F.count_if(known).alias("n_types"), top, F.count_if(known & (F.col("_n") >= least_cells)).alias("_big"))
    first = kinds.join(out.select(*by, F.col("_m").alias("_n")), [*by, "_n"], "left_semi").groupBy(*by).agg(F.min(label).alias("top_label"))
    return out.join(first, by).select(*by, "n_cells", "n_types", "top_label", (F.col("_m") / F.col("n_cells")).alias("top_share"), (F.col("_big") >= least_types).alias("ready"))


def probe_summary(probes: DataFrame, by: list[str], score: str, p: str, alpha: float = 0.05) -> DataFrame:
    """by, blocks, median and largest score, and blocks of p below alpha."""
    return probes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(score).alias("median"), F.max(score).alias("most"), F.count_if(F.col(p) < alpha).alias("n_sig"))


def block_rates(tests: DataFrame, by: list[str], fdr: str, state: str, alpha: float = 0.05) -> DataFrame:
    """by, tests, the share of told FDR below alpha, and counts of up_both, down_both, one-sex and opposite states."""
    count = lambda *names: F.count_if(F.col(state).isin(*names))
    return tests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_tests"), F.avg((F.col(fdr) < alpha).cast("int")).alias("rate"), count("up_both").alias("n_up_both"), count("down_both").alias("n_down_both"), count("M_only", "F_only").alias("n_sexspecific"), count("opposite").alias("n_opposite")
    )


def hotspots(blocks: DataFrame, least_fraction: float, subset: tuple[str, ...] = ()) -> DataFrame:
    """Blocks(tissue, cell_type, is_hotspot, mean_fraction) flagged TRUE whose fraction is a number from the least one on.

    With a subset, only its tissues, or its tissue:type pairs, without case.
    """
    fraction = F.expr("try_cast(mean_fraction AS DOUBLE)")
    out = blocks.where((F.upper(F.trim("is_hotspot")) == "TRUE") & (fraction >= least_fraction))
    if subset:
        tissue = F.upper(F.trim("tissue"))
        wanted = [s.strip().upper() for s in subset]
        out = out.where(tissue.isin(wanted) | F.concat(tissue, F.lit(":"), F.upper(F.trim("cell_type"))).isin(wanted))
    return out


def merged_probes(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """All tables side by side by a full join on key, each one's other columns named <table>_<column>."""
    out = None
    for name, table in tables.items():
        own = table.select(*key, *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c not in key])
        out = own if out is None else out.join(own, key, "full")
    return out


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join that raises if a key occurs twice on either side."""
    for name, side in (("left", left), ("right", right)):
        twice = side.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()  # one row at most
        if twice:
            raise ValueError(f"the key {twice[0][:-1]} is not unique on the {name} side")
    return left.join(right, key, "left")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by column values, 0 where there are none."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def matrix_files(files: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """path and format of the matrix files among files(path): of MTX files one for each folder, or for each prefix of an accession.

    Names that hold a skip word are left out, as are unknown endings. Of files that stand for one matrix the smallest path
    stays.
    """
    folder, name = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.substring_index("path", "/", -1)
    own = files.select("path", file_format(F.col("path")).alias("format"), folder.alias("_dir"), name.alias("_name")).where("format is not null")
    if skip:
        own = own.where(~F.lower("_name").rlike("|".join(skip)))
    accession = F.col("_name").rlike(r"(?i)^(GSM\d+[_.].*|E-\w+-\d+[_.].*)[._](matrix[._])?mtx")
    prefix = F.when(accession, F.regexp_replace("_name", r"(?i)(\.matrix)?\.mtx(\.gz)?$", "")).otherwise("")
    key = F.when(F.col("format") == "mtx", F.struct("_dir", F.concat_ws(":", accession.cast("string"), prefix).alias("k"))).otherwise(F.struct(F.lit("").alias("_dir"), F.col("path").alias("k")))
    return own.groupBy(key.alias("_key"), "format").agg(F.min("path").alias("path")).select("path", "format")


def dimensions(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, genes, cells and entries above 0 of matrices held as counts(by, cell, gene, count)."""
    return counts.groupBy(*by).agg(F.count_distinct("gene").alias("n_genes"), F.count_distinct("cell").alias("n_cells"), F.count_if(F.col("count") > 0).alias("n_entries"))


def corpus_stats(files: DataFrame) -> DataFrame:
    """study_id, files, cells written, empty cells and files with errors, from files(study_id, n_cells_written, n_cells_empty, status).

    Null studies are unknown; null counts are 0; a null status is an error.
    """
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return files.groupBy(F.coalesce("study_id", F.lit("unknown")).alias("study_id")).agg(F.count(F.lit(1)).alias("n_files"), zero("n_cells_written").alias("n_cells_tokenized"), zero("n_cells_empty").alias("n_cells_empty"), F.count_if(~F.coalesce(F.col("status") == "ok", F.lit(False))).alias("n_errors"))


def catalog_totals(catalog: DataFrame) -> DataFrame:
    """One row: studies, how many each source covers and all do, how many are single-cell with a matrix, most genes, all cells."""
    both = F.col("has_catalog") & F.col("has_matrix") & F.col("has_review")
    return catalog.agg(F.count(F.lit(1)).alias("n_studies"), F.count_if("has_catalog").alias("n_catalog"), F.count_if("has_matrix").alias("n_matrix"), F.count_if("has_review").alias("n_review"), F.count_if(both).alias("n_all"), F.count_if(F.col("has_matrix") & (F.col("data_type") == "single_cell")).alias("n_sc_matrix"), F.max("n_genes").alias("most_genes"), F.sum("n_cells").alias("n_cells"))


def universe_columns(names: DataFrame, genes: DataFrame) -> DataFrame:
    """names with the index of their gene, versions and case aside: genes(gene_id, gene_index). Names of no gene are left out."""
    return names.withColumn("_id", normalize_ensembl(F.col("name"))).join(genes.select(F.col("gene_id").alias("_id"), "gene_index"), "_id").drop("_id")


def symbol_coverage(names: DataFrame, symbols: DataFrame, by: list[str]) -> DataFrame:
    """by, names, and the share of them that is a symbol, case and blanks aside; blank names count as not found."""
    known = symbols.select(F.lower(F.trim("symbol")).alias("_s")).where("_s <> ''").distinct().withColumn("_k", F.lit(1))
    return names.withColumn("_s", F.lower(F.trim("name"))).join(known, "_s", "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_names"), F.avg(F.col("_k").isNotNull().cast("int")).alias("share"))


def concordant(tests: DataFrame, by: list[str], p_m: str, p_f: str, effect_m: str, effect_f: str, alpha: float = 0.05) -> DataFrame:
    """tests with both sexes' values adjusted within by, and whether both are significant in one direction."""
    out = benjamini_hochberg(benjamini_hochberg(tests, by, p_m, "fdr_m"), by, p_f, "fdr_f")
    same = (F.col("fdr_m") < alpha) & (F.col("fdr_f") < alpha) & (F.signum(effect_m) == F.signum(effect_f))
    return out.withColumn("replicated", F.coalesce(same, F.lit(False)))


def target_tokens(genes: DataFrame, tokens: DataFrame, most_shared: int, seed: str = "0") -> DataFrame:
    """gene, tier and its token beside those of its orthologs: a drawn sample of T1, all of T3a and T3b.

    genes(gene, tier, token_id, human, mouse), tokens(gene, token). T1 needs a human ortholog and shows both orthologs'
    tokens, T3a the human one, T3b the mouse one.
    """
    from .scoring import draw_order

    t1 = genes.where("tier = 'T1_tri_species' and human is not null").orderBy(draw_order(seed, F.col("gene")), "gene").limit(most_shared).withColumn("short", F.lit("T1"))
    t3a = genes.where("tier = 'T3a_human_multi' and human is not null").withColumn("short", F.lit("T3a")).withColumn("mouse", F.lit(None).cast("string"))
    t3b = genes.where("tier = 'T3b_mouse_multi' and mouse is not null").withColumn("short", F.lit("T3b")).withColumn("human", F.lit(None).cast("string"))
    side = lambda key, out: tokens.select(F.col("gene").alias(key), F.col("token").alias(out))
    both = t1.unionByName(t3a).unionByName(t3b).where("token_id is not null").join(side("human", "human_token"), "human", "left").join(side("mouse", "mouse_token"), "mouse", "left")
    return both.select("gene", F.col("short").alias("tier"), F.col("token_id").alias("rat_token"), "human_token", "mouse_token")


def name_clashes(labels: DataFrame, label: str, safe: Column) -> DataFrame:
    """File names that more than one label would get, with the sorted labels; empty if names tell labels apart."""
    own = labels.select(F.col(label).alias("_l"), safe.alias("name")).where("_l is not null").distinct()
    return own.groupBy("name").agg(F.count(F.lit(1)).alias("n_labels"), F.array_sort(F.collect_list("_l")).alias("labels")).where("n_labels > 1")


def uneven_axes(profiles: DataFrame, block: str, axis: str) -> DataFrame:
    """Entries of the axis that not every block has, with the number of blocks that do; empty if all axes are equal."""
    seen = profiles.select(block, axis).distinct()
    n = seen.select(block).distinct().count()  # one number
    return seen.groupBy(axis).agg(F.count(F.lit(1)).alias("n_blocks")).where(F.col("n_blocks") < n)


def assignment_summary(assigned: DataFrame, by: list[str], least_confidence: float) -> DataFrame:
    """by, clusters, cells, mean confidence, clusters of low confidence, and the share of cells that are Unknown."""
    unknown = F.sum(F.when(F.col("label") == "Unknown", F.col("n_cells")).otherwise(0))
    return assigned.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n_cells").alias("n_cells"), F.avg("confidence").alias("confidence"), F.count_if(F.col("confidence") < least_confidence).alias("n_low"), F.try_divide(unknown, F.sum("n_cells")).alias("unknown_share"))
