"""Registered queries on names, file decisions, marker sets and labels of annotators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..operators import markers as M
from .registry import _t, query
from .studies import _pick, _picked

_CLASS_CASES = (
    ("ENSRNOG00000012345", "gene:ensembl_rat"), ("ENSMUST00000012345", "gene:ensembl_mouse"), ("ENSG00000012345", "gene:ensembl"), ("NM_001", "gene:refseq"), ("LOC100", "gene:ncbi_loc"), ("Gapdh", "gene:gene_symbol_mouse"), (" ACTB ", "gene:gene_symbol_human"),
    ("rno-miR-21", "gene:mirna_rat"), ("mmu-let-7a", "gene:mirna_mouse"), ("hsa-mir-1", "gene:mirna_human"), ("let-7", "gene:mirna_generic"), ("circ_001", "gene:circrna"), ("chr7:139461703|139469960", "gene:circrna_coords"), ("lncRNA12", "gene:lncrna"),
    ("NONRAT0123456789", "gene:lncrna_rat"), ("1367452_at", "gene:probe_affy"), ("ILMN_123", "gene:probe_illumina"), ("A_44_P123", "gene:probe_agilent"), ("ACGTACGTACGTACGT-1", "cell:barcode_10x"), ("ACGTACGTACGTACGT", "cell:barcode_nucleotide"),
    ("ACGTACGT-12", "cell:barcode_with_suffix"), ("GSM123456789", "sample:geo_sample"), ("SRR123456789", "sample:sra_run"), ("SRX123456789", "sample:sra_experiment"), ("SAMN123456789", "sample:biosample"), ("", "unknown"), ("  ", "unknown"), ("a b", "unknown"),
)
_TYPE_CASES = (
    ("Gapdh|ENSRNOG00000012345", "ensembl_rat"), ("ENSMUSG00000012345", "ensembl_mouse"), ("x|ENSG00000012345", "ensembl_human"), ("NM_1|123", "refseq_mrna"), ("NR_1", "refseq_ncrna"), ("Actb|12", "entrez"), ("rno-let-7", "mirna_rat"), ("mmu-miR-1", "mirna_mouse"),
    ("hsa-let-7", "mirna_human"), ("circRNA_9", "circrna"), ("chr1:5-9", "circrna_coords"), ("LINC01", "lncrna"), ("NONRAT5", "lncrna_rat"), ("9_s_at", "probe_affy"), ("ILMN_7", "probe_illumina"), ("Gapdh|Actb||Tp53", "gene_symbol"), ("Gapdh|a b", "unknown"),
    ("A|B|C|D|E|a b", "gene_symbol"), ("A|B|C|D|E|F|G|H|I|J|ENSG00000012345", "gene_symbol"),
)
_MODALITY_CASES = (("gene:mirna_rat", "mirna"), ("mirna_generic", "mirna"), ("circrna_coords", "circrna"), ("gene:lncrna", "lncrna"), ("probe_agilent", "microarray"), ("gene:ensembl", "mrna"), ("gene_symbol", "mrna"), ("cell:barcode_10x", "unknown"), ("unknown", "unknown"), ("entrez", "mrna"))
_FILE_CASES = (
    ("raw/GSM4331829_Kidney-M-O_matrix.mtx.gz", "kidney/male/-/count_matrix"), ("GSM5121163_Control_1_counts.tsv", "-/-/control/count_matrix"), ("GSM4710730_M10_data.h5", "-/-/-/unknown"), ("GSM1_aorta_F_CR_tpm.csv", "aorta/female/caloric_restriction/normalized"),
    ("liver/GSM2_wat_sham_metadata.csv", "WAT-SC/-/sham/metadata"), ("GSM3_hippocampus-Y-filtered_matrix.mtx", "hippocampus/-/young/count_matrix,processed"), ("GSM4_heart_lung_umi_norm_qc.txt", "heart/-/-/count_matrix,normalized,processed"), ("x_bm_f_annotation.tsv", "bone marrow/female/-/metadata"),
)
_DECISIONS = (("GSM1_matrix.mtx.gz", "download", "matrix"), ("GSM1.fastq.gz", "skip_pattern", "fastq"), ("README.txt", "skip_no_match", None), ("GSM2_barcodes.tsv", "download", "barcodes"), ("matrix.BAM", "skip_pattern", r"\.bam$"))
_BRAIN = (("Glutamatergic neurons", "Excitatory neurons"), (" Neurons ", "Excitatory neurons"), ("microglial cells", "Microglia"), ("Oligodendrocyte progenitor cells", "Oligodendrocyte precursor cells"), ("Astrocytes", "Astrocytes"), ("Interneurons", "Interneurons"))
_MUSCLE = (("Skeletal muscle fibers", "Skeletal muscle"), ("Myofibers", "Skeletal muscle"), ("Smooth muscle cells", "Smooth muscle cells"), ("Muscle fibroblasts", "Muscle fibroblasts"), ("muscle fibers", "Skeletal muscle"), ("T cells", "T cells"))
_LUNG = (("Clara cells", "Club cells"), ("Airway ciliated cells", "Ciliated cells"), ("NK cells", "NK cells"), ("natural killer cells", "NK cells"), ("NKT cells", "NKT cells"), ("Airway club cells", "Club cells"))
_REFERENCE = ("Endothelial cells", "Skeletal muscle cells", "Immune cells", "Smooth muscle cells", "T cells", "Hepatocytes")
_HARMONISED = (("Hepatic endothelial cells", "Endothelial cells"), ("Skeletal myocytes", "Skeletal muscle cells"), ("Smooth muscle", "Smooth muscle cells"), ("Macrophages", "Immune cells"), ("Hepatocyte", "Hepatocytes"), ("Hepatocytes", "Hepatocytes"), ("Adipocytes", ""), ("Naive T cells", "T cells"), ("immune mix", "Immune cells"), ("Muscle cells", "Skeletal muscle cells"))


@query(f"SELECT l_orderkey, l_linenumber, {_pick(_CLASS_CASES, 1, '(l_orderkey + l_linenumber)')} AS class FROM lineitem")
def identifier_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") + F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", N.id_class(_picked(_CLASS_CASES, "k")).alias("class"))


@query(f"SELECT o_orderkey, {_pick(_TYPE_CASES, 1, 'o_orderkey')} AS id_type, {_pick(_MODALITY_CASES, 1, 'o_orderkey')} AS modality FROM orders")
def matrix_id_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", N.id_type(F.split(_picked(_TYPE_CASES, "o_orderkey"), r"\|")).alias("id_type"), N.modality(_picked(_MODALITY_CASES, "o_orderkey")).alias("modality"))


@query(
    """WITH m AS (SELECT o_orderkey k, (['genes', 'cells', 'unknown', 'samples'])[o_orderkey % 4 + 1] rt, (o_orderkey % 11) / 10 rs, (['unknown', 'genes', 'cells'])[o_orderkey % 3 + 1] ct, (o_custkey % 11) / 10 cs, o_orderkey % 50000 r, (o_custkey * 37) % 50000 c FROM orders),
    v AS (SELECT *, CASE WHEN rt <> 'unknown' AND rs >= 0.6 THEN rt END vr, CASE WHEN ct <> 'unknown' AND cs >= 0.6 THEN ct END vc, r BETWEEN 15000 AND 40000 lr, c BETWEEN 15000 AND 40000 lc FROM m),
    f AS (SELECT *, CASE WHEN vr IS NOT NULL OR vc IS NOT NULL THEN coalesce(vr, 'unknown') WHEN lr AND NOT lc THEN 'genes' WHEN lc AND NOT lr THEN CASE WHEN r > 500 THEN 'cells' ELSE 'samples' END ELSE 'unknown' END a,
      CASE WHEN vr IS NOT NULL OR vc IS NOT NULL THEN coalesce(vc, 'unknown') WHEN lc AND NOT lr THEN 'genes' WHEN lr AND NOT lc THEN CASE WHEN c > 500 THEN 'cells' ELSE 'samples' END ELSE 'unknown' END b FROM v)
    SELECT k AS matrix, a AS row_type, b AS col_type, CASE 'genes' WHEN a THEN r WHEN b THEN c END AS n_genes, CASE 'cells' WHEN a THEN r WHEN b THEN c END AS n_cells, CASE 'samples' WHEN a THEN r WHEN b THEN c END AS n_samples,
    CASE WHEN vr IS NOT NULL THEN CASE WHEN rs >= 0.8 THEN 'high' ELSE 'medium' END WHEN vc IS NOT NULL THEN CASE WHEN cs >= 0.8 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence FROM f"""
)
def matrix_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = lambda names, key: F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))
    o = N.orientation(kind(("genes", "cells", "unknown", "samples"), k), (k % 11) / 10, kind(("unknown", "genes", "cells"), k), (c % 11) / 10, k % 50_000, (c * 37) % 50_000)
    return _t(spark, sf_dir, "orders").select(k.alias("matrix"), o.alias("o")).select("matrix", "o.*")


@query(f"SELECT l_orderkey, l_linenumber, {_pick(_FILE_CASES, 1, 'l_orderkey')} AS told FROM lineitem")
def file_name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _picked(_FILE_CASES, "l_orderkey")
    f = N.file_fields(name)
    told = F.concat_ws("/", *[F.coalesce(f[c], F.lit("-")) for c in ("tissue", "sex", "condition")], F.array_join(N.file_contents(name), ","))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", told.alias("told"))


@query(
    f"""WITH f AS (SELECT o_orderkey k, {_pick(tuple((d[0], d[1]) for d in _DECISIONS), 1, 'o_orderkey')} a, ([{', '.join('NULL' if d[2] is None else "'" + d[2] + "'" for d in _DECISIONS)}])[o_orderkey % 5 + 1] p, o_custkey % 3 = 0 arch FROM orders)
    SELECT k AS file, CASE WHEN a = 'skip_no_match' AND arch THEN 'download' ELSE a END AS action, CASE WHEN a = 'download' AND arch THEN NULL ELSE p END AS pattern, CASE WHEN a = 'skip_pattern' THEN a ELSE 'download' END AS found_all FROM f"""
)
def file_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, skip, target = _picked(_DECISIONS, "o_orderkey"), ("fastq", r"\.bam$"), ("matrix", "barcodes")
    d = N.file_decision(name, F.col("o_custkey") % 3 == 0, skip, target)
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), d["action"].alias("action"), d["pattern"].alias("pattern"), N.file_decision(name, F.lit(None).cast("boolean"), skip, target, discovery=True)["action"].alias("found_all"))


@query(f"SELECT c_custkey, {_pick(_BRAIN, 1, 'c_custkey')} AS brain, {_pick(_MUSCLE, 1, 'c_custkey')} AS muscle, {_pick(_LUNG, 1, 'c_custkey')} AS lung, {_pick(_LUNG, 0, 'c_custkey')} AS none FROM customer")
def coarse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda cases, scheme: N.coarse_label(_picked(cases, "c_custkey"), scheme).alias(scheme)
    return _t(spark, sf_dir, "customer").select("c_custkey", own(_BRAIN, "brain"), own(_MUSCLE, "muscle"), own(_LUNG, "lung"), own(_LUNG, "none"))


@query(f"SELECT DISTINCT {_pick(_HARMONISED, 0, 'p_partkey')} AS label, nullif({_pick(_HARMONISED, 1, 'p_partkey')}, '') AS type FROM part")
def harmonised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _t(spark, sf_dir, "nation").where(f"n_nationkey < {len(_REFERENCE)}").select(_picked(tuple((r,) for r in _REFERENCE), "n_nationkey").alias("type"), F.col("n_nationkey").alias("place"))
    return M.harmonise(_t(spark, sf_dir, "part").select(_picked(_HARMONISED, "p_partkey").alias("label")), types)


# Symbols are brands with a number; half the parts name a gene, all name a marker of their type.
_GENE_OF = "SELECT upper(p_brand) || '-' || (p_partkey % 40) s, arg_max(p_partkey, p_partkey) g FROM part WHERE p_partkey % 2 = 0 GROUP BY 1"


@query(f"WITH g AS ({_GENE_OF}), m AS (SELECT DISTINCT p_type AS label, g FROM part JOIN g ON s = upper(p_brand) || '-' || (p_partkey % 53) WHERE p_size % 5 <> 0) SELECT label, CAST(count(*) AS INTEGER) AS n_markers, string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) AS genes FROM m GROUP BY 1")
def marker_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers, genes = _markers(spark, sf_dir)
    return M.marker_sets(markers, genes, ["label"]).select("label", "n_markers", F.array_join(F.transform("genes", lambda g: g.cast("string")), ",").alias("genes"))


def _markers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _t(spark, sf_dir, "part")
    symbol = lambda m: F.concat(F.lit(" "), F.lower("p_brand"), F.lit("-"), (F.col("p_partkey") % m).cast("string"))
    species = F.when(F.col("p_size") % 5 == 0, "Other").when(F.col("p_size") % 2 == 0, "Mm Hs").otherwise("Hs")
    markers = part.select(species.alias("species"), symbol(53).alias("symbol"), F.col("p_type").alias("label"), F.col("p_partkey"))
    return markers, part.where("p_partkey % 2 = 0").select(symbol(40).alias("symbol"), F.col("p_partkey").alias("gene_id"), F.col("p_partkey").alias("pos"))


@query(f"SELECT DISTINCT upper(p_brand) || '-' || (p_partkey % 53) AS symbol FROM part WHERE upper(p_brand) || '-' || (p_partkey % 53) NOT IN (SELECT s FROM ({_GENE_OF}))")
def markers_without_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unmapped_symbols(*_markers(spark, sf_dir))


@query(
    """WITH a AS (SELECT p_type label, list_sort(list(p_partkey)) genes FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), o AS (SELECT p_type label, list_sort(list(p_partkey)) own FROM part WHERE p_partkey % 3 = 1 AND p_size > 40 AND p_type < 'M' GROUP BY 1)
    SELECT label, array_to_string(coalesce(own, genes), ',') AS genes, own IS NOT NULL AS from_organ FROM a FULL JOIN o USING (label)"""
)
def organ_marker_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    sets = lambda rows: rows.groupBy(F.col("p_type").alias("label")).agg(F.array_sort(F.collect_list("p_partkey")).alias("genes"))
    out = M.organ_sets(sets(part.where("p_partkey % 3 = 0")), sets(part.where("p_partkey % 3 = 1 AND p_size > 40 AND p_type < 'M'")), "label", "genes")
    return out.select("label", F.array_join(F.transform("genes", lambda g: g.cast("string")), ",").alias("genes"), "from_organ")


@query(
    """WITH a AS (SELECT DISTINCT o_custkey % 7 sample, o_custkey cluster, upper(c_mktsegment) l FROM orders JOIN customer ON c_custkey = o_custkey), b AS (SELECT c_custkey % 7 sample, c_custkey cluster, CASE WHEN c_custkey % 4 = 0 THEN 'BUILDING' ELSE c_mktsegment END l FROM customer WHERE c_custkey % 3 > 0)
    SELECT sample, count(*) AS n_clusters, count(*) FILTER (lower(a.l) = lower(b.l)) AS n_match, round(count(*) FILTER (lower(a.l) = lower(b.l)) / count(*), 6) AS share FROM a JOIN b USING (sample, cluster) GROUP BY 1"""
)
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("sample"), F.col("c_custkey").alias("cluster"), F.col("c_mktsegment").alias("label"))
    ordered = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster")).distinct()
    second = customer.where("cluster % 3 > 0").withColumn("label", F.when(F.col("cluster") % 4 == 0, "BUILDING").otherwise(F.col("label")))
    return M.annotator_agreement(customer.withColumn("label", F.upper("label")).join(ordered, "cluster", "left_semi"), second, ["sample"], "cluster", "label").withColumn("share", F.round("share", 6))


# Scores: a line's price less its brand's level, for the brand of its part; cells are orders.
_SCORES = "scores AS (SELECT l_orderkey cell, p_brand label, round(max(l_extendedprice - 60000), 2) score, CAST(substr(p_brand, 7) AS INTEGER) place FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 4)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy(F.col("l_orderkey").alias("cell"), F.col("p_brand").alias("label")).agg(F.round(F.max(F.col("l_extendedprice") - 60_000), 2).alias("score"), F.max(F.substring("p_brand", 7, 9).cast("int")).alias("place"))


@query(
    f"""WITH {_SCORES}, c AS (SELECT o_orderkey cell, o_custkey cluster FROM orders), m AS (SELECT cluster, label, round(avg(score), 9) m, min(place) p FROM scores JOIN c USING (cell) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY m DESC, p) r FROM m), n AS (SELECT cluster, count(*) n FROM c GROUP BY 1)
    SELECT cluster, n AS n_cells, CASE WHEN m > 0 THEN label ELSE 'Unknown' END AS label, round(m, 4) AS score FROM r JOIN n USING (cluster) WHERE r = 1"""
)
def panel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_custkey").alias("cluster"))
    return M.best_label(_scores(spark, sf_dir), cells, "cluster").withColumn("score", F.round("score", 4))


@query(
    f"""WITH {_SCORES}, b AS (SELECT cell, arg_max(label, [score, -place]) l, max(score) s, arg_max(label, [score, -place]) FILTER (place % 2 = 0) fl, max(score) FILTER (place % 2 = 0) fs FROM scores GROUP BY 1),
    g AS (SELECT *, cell % 3 = 0 AND l IN ('Brand#1', 'Brand#3') AND fl IS NOT NULL shut FROM b) SELECT cell, CASE WHEN shut THEN fl ELSE l END AS label, CASE WHEN shut THEN fs ELSE s END AS score, shut AS gated FROM g"""
)
def gated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    return M.gated_label(scores, scores.where("cell % 3 = 0 and label in ('Brand#1', 'Brand#3')"), F.col("place") % 2 == 0)


@query(
    """WITH c AS (SELECT p_brand label, CAST(p_partkey AS VARCHAR) g, [0.0, p_partkey] o FROM part WHERE p_size = 7), t AS (SELECT p_brand label, CAST(p_partkey AS VARCHAR) g, [1.0, -(p_retailprice - 1000), p_partkey] o, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice - 1000 DESC, p_partkey) r FROM part WHERE p_retailprice > 1000),
    u AS (SELECT label, g, o FROM c UNION ALL SELECT label, g, o FROM t WHERE r <= 12), d AS (SELECT label, g, min(o) o FROM u GROUP BY 1, 2) SELECT label, string_agg(g, ',' ORDER BY o) AS panel FROM d GROUP BY 1"""
)
def marker_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    genes = part.select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("gene"), (F.col("p_retailprice") - 1000).alias("change"))
    listed = part.where("p_size = 7").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("pos"))
    return M.class_panel(genes, listed, "label", 12).select("label", F.array_join("panel", ",").alias("panel"))


@query(
    """SELECT o_custkey % 5 AS sample, o_orderkey AS barcode, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 60 END AS cluster, CASE WHEN o_orderkey % 4 > 0 AND o_custkey % 60 < 50 THEN CASE o_custkey % 60 % 6 WHEN 0 THEN 'Neurons' WHEN 1 THEN 'kind 1' ELSE 'kind ' || (o_custkey % 60 % 6) END END AS label,
    CASE WHEN o_orderkey % 4 > 0 AND o_custkey % 60 < 50 THEN CASE WHEN o_custkey % 60 % 6 = 0 THEN 'merged' ELSE 'consensus' END END AS source, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 5) || '_c' || (o_custkey % 60) END AS state FROM orders"""
)
def cell_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("sample"), F.col("o_orderkey").alias("barcode"), (F.col("o_custkey") % 60).alias("cluster"))
    consensus = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).alias("sample"), (F.col("c_custkey") % 60).alias("cluster")).distinct().where("cluster < 50")
    consensus = consensus.select("sample", "cluster", F.concat(F.lit("kind "), (F.col("cluster") % 6).cast("string")).alias("label"), F.lit("consensus").alias("source"))
    merges = _t(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("kind 0").alias("old"), F.lit("Neurons").alias("new"))
    merged = M.merge_labels(consensus, merges, "label", "source", "merged")
    return M.state_labels(cells.drop("cluster"), cells.where("barcode % 4 > 0"), merged).select("sample", "barcode", "cluster", "label", "source", "state")
