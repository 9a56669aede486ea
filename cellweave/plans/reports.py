"""Registered queries on study catalogs, validators and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import safe_label
from ..operators import reports as R
from .registry import _t, query

# Matrices are orders of a study (customer): one in three holds samples, one in five is unfiltered.
_MATRICES = """m AS (SELECT o_custkey k, (o_orderkey * 13) % 40000 g, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 9000 + 1 END c, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 90 + 1 END s, (['high', 'medium', 'low', 'none'])[o_orderkey % 4 + 1] f, o_orderkey % 5 = 0 OR o_custkey % 6 = 0 u, 3 - o_orderkey % 4 r, o_orderstatus st, o_orderpriority p FROM orders)"""


def _matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    level = F.element_at(F.array(*[F.lit(c) for c in ("high", "medium", "low", "none")]), (k % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("accession"), ((k * 13) % 40_000).alias("n_genes"), F.when(k % 3 > 0, k % 9_000 + 1).alias("n_cells"), F.when(k % 3 == 0, k % 90 + 1).alias("n_samples"),
        level.alias("confidence"), ((k % 5 == 0) | (F.col("o_custkey") % 6 == 0)).alias("unfiltered"), F.col("o_orderstatus").alias("organism"), F.col("o_orderpriority").alias("modality"),
    )


@query(
    f"""WITH {_MATRICES}, a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY u, r DESC, c DESC, g DESC) n FROM m WHERE c IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC, s DESC, g DESC) n FROM m WHERE s IS NOT NULL),
    j AS (SELECT d.k, a.g ag, a.c, a.f af, a.u, a.r ar, b.g bg, b.s, b.f bf, b.r br, CASE WHEN a.k IS NOT NULL AND NOT a.u AND a.r >= coalesce(b.r, 0) THEN 1 WHEN b.k IS NOT NULL THEN 2 ELSE 3 END t FROM (SELECT DISTINCT k FROM m) d LEFT JOIN a ON a.k = d.k AND a.n = 1 LEFT JOIN b ON b.k = d.k AND b.n = 1)
    SELECT k AS accession, CASE t WHEN 2 THEN bg ELSE ag END AS n_genes, CASE WHEN t <> 2 THEN c END AS n_cells, CASE WHEN t = 2 THEN s END AS n_samples, CASE t WHEN 1 THEN af WHEN 2 THEN bf ELSE 'low' END AS confidence, CASE t WHEN 2 THEN 'bulk' ELSE 'single_cell' END AS data_type, t = 3 AS only_unfiltered FROM j"""
)
def best_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_matrices(_matrices(spark, sf_dir), "accession")


@query("SELECT o_custkey AS accession, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1")
def repeated_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeated_keys(_t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("accession")), "accession")


@query(f"WITH {_MATRICES}, v AS (SELECT 'n_cells' field, c AS value FROM m UNION ALL SELECT 'n_genes', g FROM m UNION ALL SELECT 'n_samples', s FROM m) SELECT field, value, count(*) AS n, count(*) > 3 AS suspicious FROM v WHERE value > 0 GROUP BY 1, 2")
def repeated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeated_values(_matrices(spark, sf_dir), ["n_cells", "n_genes", "n_samples"])


@query(f"WITH {_MATRICES} SELECT CASE WHEN g < 5000 THEN 'Suspicious low' WHEN g < 15000 THEN 'Low (subset?)' WHEN g < 25000 THEN 'Normal (protein-coding)' WHEN g < 40000 THEN 'Normal (with ncRNA)' WHEN g < 100000 THEN 'High (check orientation)' ELSE 'Suspicious high' END AS band, count(*) AS n FROM (SELECT CASE WHEN k % 50 = 0 THEN g * 5 ELSE g END g FROM m) WHERE g > 0 GROUP BY 1")
def gene_count_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = _matrices(spark, sf_dir).select(F.when(F.col("accession") % 50 == 0, F.col("n_genes") * 5).otherwise(F.col("n_genes")).alias("g"))
    return genes.select(R.gene_band(F.col("g")).alias("band")).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MATRICES} SELECT 'n_cells' AS field, count(*) AS n, count(*) FILTER (c IS NULL) AS n_null FROM m UNION ALL SELECT 'n_samples', count(*), count(*) FILTER (s IS NULL) FROM m UNION ALL SELECT 'n_genes', count(*), 0 FROM m")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing_values(_matrices(spark, sf_dir), ["n_cells", "n_samples", "n_genes"])


@query(
    f"""WITH {_MATRICES}, v AS (SELECT 'all' d, NULL v, * FROM m UNION ALL SELECT 'organism', coalesce(st, 'unknown'), * FROM m UNION ALL SELECT 'modality', coalesce(p, 'unknown'), * FROM m)
    SELECT d AS dimension, v AS value, count(*) AS n_matrices, CAST(sum(c) AS BIGINT) AS n_cells, CAST(sum(s) AS BIGINT) AS n_samples, max(g) AS most_genes FROM v GROUP BY 1, 2"""
)
def matrix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals_by(_matrices(spark, sf_dir), ["organism", "modality"])


@query("SELECT o_orderkey AS study, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'own' ELSE 'other' END AS side FROM orders")
def species_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.when(k % 4 == 0, F.array(F.lit("Homo sapiens"), F.lit("RATTUS norvegicus"))).when(k % 4 == 1, F.array(F.lit(None).cast("string"), F.lit("rattus"))).when(k % 4 == 2, F.array(F.lit("Mus musculus")))
    own, other = R.by_species(_t(spark, sf_dir, "orders").select(k.alias("study"), names.alias("organisms")), "organisms", ("rattus",))
    return own.select("study", F.lit("own").alias("side")).unionByName(other.select("study", F.lit("other").alias("side")))


@query("WITH r AS (SELECT DISTINCT l_suppkey k, l_partkey g FROM lineitem) SELECT k AS study, count(*) AS n_raw, count(*) FILTER (g % 10 < 1 + k % 5) AS n_known, round(count(*) FILTER (g % 10 < 1 + k % 5) / count(*), 4) AS match_rate, count(*) FILTER (g % 10 < 1 + k % 5) / count(*) >= 0.3 AS usable FROM r GROUP BY 1")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda g, k: F.concat(g.cast("string"), F.lit("/"), (k % 5).cast("string"))
    raw = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("study"), name(F.col("l_partkey"), F.col("l_suppkey")).alias("raw_id"))
    five = _t(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).where("p_partkey % 10 < 1 + k")
    return R.match_rates(raw, five.select(name(F.col("p_partkey"), F.col("k")).alias("raw_id")), ["study"])


@query(
    """WITH k AS (SELECT c_nationkey n, CASE WHEN o_orderpriority = '5-LOW' THEN 'Unknown' ELSE o_orderpriority END l, CAST(sum(o_orderkey % 9) AS BIGINT) c FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 50 <= c_nationkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, l) r FROM k)
    SELECT n AS tissue, CAST(sum(c) AS BIGINT) AS n_cells, count(*) FILTER (l <> 'Unknown') AS n_types, max(l) FILTER (r = 1) AS top_label, round(max(c) / sum(c), 6) AS top_share, count(*) FILTER (l <> 'Unknown' AND c >= 150) >= 3 AS ready FROM r GROUP BY 1"""
)
def tissue_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).where("o_orderkey % 50 <= c_nationkey")
    label = F.when(F.col("o_orderpriority") == "5-LOW", "Unknown").otherwise(F.col("o_orderpriority"))
    clusters = both.select(F.col("c_nationkey").alias("tissue"), label.alias("label"), (F.col("o_orderkey") % 9).alias("n_cells"))
    return R.composition(clusters, ["tissue"], "label", least_cells=150).withColumn("top_share", F.round("top_share", 6))


@query("SELECT l_returnflag AS tissue, count(*) AS n, median(l_discount) AS median, max(l_discount) AS most, count(*) FILTER (l_tax < 0.05) AS n_sig FROM lineitem GROUP BY 1")
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.probe_summary(_t(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "tissue"), ["tissue"], "l_discount", "l_tax")


_BLOCKS = "b AS (SELECT l_suppkey k, l_linenumber c, CASE WHEN l_quantity > 5 THEN l_tax END q, (['up_both', 'down_both', 'opposite', 'M_only', 'F_only', 'null'])[l_orderkey % 6 + 1] s FROM lineitem)"


@query(f"WITH {_BLOCKS} SELECT k AS tissue, c AS cell_type, count(*) AS n_tests, round(avg(CAST(q < 0.05 AS INTEGER)), 6) AS rate, count(*) FILTER (s = 'up_both') AS n_up_both, count(*) FILTER (s = 'down_both') AS n_down_both, count(*) FILTER (s IN ('M_only', 'F_only')) AS n_sexspecific, count(*) FILTER (s = 'opposite') AS n_opposite FROM b GROUP BY 1, 2")
def block_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in ("up_both", "down_both", "opposite", "M_only", "F_only", "null")]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    tests = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tissue"), F.col("l_linenumber").alias("cell_type"), F.when(F.col("l_quantity") > 5, F.col("l_tax")).alias("fdr"), state.alias("state"))
    return R.block_rates(tests, ["tissue", "cell_type"], "fdr", "state").withColumn("rate", F.round("rate", 6))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_partkey % 7 > 0 AND l_discount >= 0.05 AND (l_returnflag = 'R' OR (l_returnflag = 'A' AND l_suppkey % 3 = 1))")
def hotspot_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_linestatus") == "O", " true ").otherwise("FALSE")
    fraction = F.when(F.col("l_partkey") % 7 == 0, "NA").otherwise(F.col("l_discount").cast("string"))
    blocks = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("is_hotspot"), fraction.alias("mean_fraction"), F.lower("l_returnflag").alias("tissue"), F.concat(F.lit("type "), (F.col("l_suppkey") % 3).cast("string")).alias("cell_type"))
    return R.hotspots(blocks, 0.05, ("R", "a:Type 1")).select("l_orderkey", "l_linenumber")


@query(
    """WITH a AS (SELECT l_suppkey k, l_linenumber c, round(avg(l_discount), 6) x FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1, 2), b AS (SELECT l_suppkey k, l_linenumber c, round(avg(l_tax), 6) x, count(*) n FROM lineitem WHERE l_suppkey % 2 > 0 GROUP BY 1, 2), d AS (SELECT l_suppkey k, l_linenumber c, max(l_quantity) x FROM lineitem WHERE l_suppkey % 5 > 2 GROUP BY 1, 2)
    SELECT k AS tissue, c AS cell_type, a.x AS probe_auc, b.x AS control_auc, b.n AS control_n, d.x AS forest_auc FROM a FULL JOIN b USING (k, c) FULL JOIN d USING (k, c)"""
)
def merged_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "tissue", "l_linenumber": "cell_type"})
    per = lambda test, *what: rows.where(test).groupBy("tissue", "cell_type").agg(*what)
    tables = {"probe": per("tissue % 3 > 0", F.round(F.avg("l_discount"), 6).alias("auc")), "control": per("tissue % 2 > 0", F.round(F.avg("l_tax"), 6).alias("auc"), F.count(F.lit(1)).alias("n")), "forest": per("tissue % 5 > 2", F.max("l_quantity").alias("auc"))}
    return R.merged_probes(tables, ["tissue", "cell_type"])


@query("SELECT s_suppkey AS tissue, n_name AS name, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE l_orderkey % 97 = s_suppkey % 5 GROUP BY 1, 2")
def verdict_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = R.crosstab(_t(spark, sf_dir, "lineitem").where("l_orderkey % 97 = l_suppkey % 5"), "l_suppkey", "l_returnflag", ["A", "N", "R"])
    names = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("name"))
    return R.one_to_one(table, names, ["l_suppkey"]).withColumnRenamed("l_suppkey", "tissue")


_PATHS = "f AS (SELECT (o_custkey % 40) || '/' || (['GSM', 'gsm', 'x', 'barcodes_'])[o_orderkey % 4 + 1] || (o_custkey % 9) || '_s' || (o_orderkey % 5) || (['.mtx.gz', '.matrix.mtx', '.h5ad', '.pdf', '.mtx'])[o_orderkey % 5 + 1] p FROM orders)"


@query(
    f"""WITH {_PATHS}, m AS (SELECT DISTINCT p, split_part(p, '/', 1) d, split_part(p, '/', 2) n, CASE WHEN p LIKE '%.h5ad' THEN 'h5ad' WHEN p LIKE '%.mtx%' THEN 'mtx' END t FROM f),
    k AS (SELECT *, CASE WHEN t = 'mtx' THEN d || '/' || CASE WHEN lower(n) LIKE 'gsm%' THEN 'a' || regexp_replace(n, '(\\.matrix)?\\.mtx(\\.gz)?$', '') ELSE '' END ELSE p END key FROM m WHERE t IS NOT NULL AND NOT contains(n, 'barcodes')) SELECT min(p) AS path, t AS format FROM k GROUP BY key, t"""
)
def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    path = F.concat((c % 40).cast("string"), F.lit("/"), at(("GSM", "gsm", "x", "barcodes_")), (c % 9).cast("string"), F.lit("_s"), (k % 5).cast("string"), at((".mtx.gz", ".matrix.mtx", ".h5ad", ".pdf", ".mtx")))
    return R.matrix_files(_t(spark, sf_dir, "orders").select(path.alias("path")), ("barcodes", "metadata"))


@query("SELECT l_returnflag AS matrix, count(DISTINCT l_partkey) AS n_genes, count(DISTINCT l_orderkey) AS n_cells, count(*) FILTER (l_discount > 0) AS n_entries FROM lineitem GROUP BY 1")
def matrix_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("matrix"), F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"), F.col("l_discount").alias("count"))
    return R.dimensions(rows, ["matrix"])


@query(
    "SELECT CASE WHEN o_custkey % 100 = 0 THEN 'unknown' ELSE CAST(o_custkey AS VARCHAR) END AS study_id, count(*) AS n_files, CAST(sum(CASE WHEN o_orderkey % 8 > 0 THEN o_orderkey % 500 ELSE 0 END) AS BIGINT) AS n_cells_tokenized, CAST(sum(o_orderkey % 7) AS BIGINT) AS n_cells_empty, count(*) FILTER (o_orderstatus <> 'O' OR o_orderkey % 8 = 0) AS n_errors FROM orders GROUP BY 1"
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    files = _t(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 100 > 0, F.col("o_custkey").cast("string")).alias("study_id"), F.when(k % 8 > 0, k % 500).alias("n_cells_written"), (k % 7).alias("n_cells_empty"), F.when(k % 8 > 0, F.when(F.col("o_orderstatus") == "O", "ok").otherwise("failed")).alias("status"))
    return R.corpus_stats(files)


@query(
    f"""WITH {_MATRICES}, c AS (SELECT k % 3 > 0 hc, c IS NOT NULL hm, k % 4 > 1 hr, CASE WHEN st = 'O' THEN 'single_cell' ELSE 'bulk' END dt, g, c FROM m)
    SELECT count(*) AS n_studies, count(*) FILTER (hc) AS n_catalog, count(*) FILTER (hm) AS n_matrix, count(*) FILTER (hr) AS n_review, count(*) FILTER (hc AND hm AND hr) AS n_all, count(*) FILTER (hm AND dt = 'single_cell') AS n_sc_matrix, max(g) AS most_genes, CAST(sum(c) AS BIGINT) AS n_cells FROM c"""
)
def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("accession")
    return R.catalog_totals(_matrices(spark, sf_dir).select((k % 3 > 0).alias("has_catalog"), F.col("n_cells").isNotNull().alias("has_matrix"), (k % 4 > 1).alias("has_review"), F.when(F.col("organism") == "O", "single_cell").otherwise("bulk").alias("data_type"), "n_genes", "n_cells"))


@query("SELECT l_orderkey, l_linenumber, 'ensrnog' || lpad(CAST(l_partkey AS VARCHAR), 11, '0') || '.' || l_linenumber AS name, l_partkey // 2 AS gene_index FROM lineitem WHERE l_partkey % 2 = 0")
def universe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = lambda k: F.lpad(k.cast("string"), 11, "0")
    names = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("ensrnog"), stem(F.col("l_partkey")), F.lit("."), F.col("l_linenumber").cast("string")).alias("name"))
    return R.universe_columns(names, _t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("ENSRNOG"), stem(F.col("p_partkey"))).alias("gene_id"), F.floor(F.col("p_partkey") / 2).alias("gene_index")))


@query("SELECT l_suppkey AS study, count(*) AS n_names, round(avg(CAST(l_partkey % 3 = 0 AND l_linenumber > 1 AS INTEGER)), 6) AS share FROM lineitem GROUP BY 1")
def symbol_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("study"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit(" Gene"), F.col("l_partkey").cast("string"))).otherwise(" ").alias("name"))
    return R.symbol_coverage(names, _t(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("GENE"), F.col("p_partkey").cast("string")).alias("symbol")), ["study"]).withColumn("share", F.round("share", 6))


@query(
    """WITH t AS (SELECT p_partkey g, p_brand b, pow(((p_partkey * 7919) % 1999 + 1) / 2000, 4) m, CASE WHEN p_size > 3 THEN pow(((p_partkey * 104729) % 997 + 1) / 1000, 5) END f, p_partkey % 7 < 4 s FROM part),
    r AS (SELECT *, m * count(m) OVER (PARTITION BY b) / count(m) OVER (PARTITION BY b ORDER BY m) qm, f * count(f) OVER (PARTITION BY b) / count(f) OVER (PARTITION BY b ORDER BY f) qf FROM t),
    a AS (SELECT *, least(1, min(qm) OVER (PARTITION BY b ORDER BY m DESC)) am, CASE WHEN f IS NOT NULL THEN least(1, min(qf) OVER (PARTITION BY b ORDER BY f DESC NULLS LAST)) END af FROM r) SELECT g AS gene, b AS block, round(am, 8) AS fdr_m, round(af, 8) AS fdr_f, coalesce(am < 0.05 AND af < 0.05 AND s, false) AS replicated FROM a"""
)
def sex_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tests = _t(spark, sf_dir, "part").select(k.alias("gene"), F.col("p_brand").alias("block"), F.pow(((k * 7919) % 1999 + 1) / 2000, F.lit(4)).alias("m"), F.when(F.col("p_size") > 3, F.pow(((k * 104_729) % 997 + 1) / 1000, F.lit(5))).alias("f"), F.when(k % 7 < 4, 1.5).otherwise(-0.5).alias("em"), F.lit(2.0).alias("ef"))
    return R.concordant(tests, ["block"], "m", "f", "em", "ef").select("gene", "block", F.round("fdr_m", 8).alias("fdr_m"), F.round("fdr_f", 8).alias("fdr_f"), "replicated")


@query(
    """WITH g AS (SELECT CAST(p_partkey AS VARCHAR) gene, (['T1_tri_species', 'T3a_human_multi', 'T3b_mouse_multi', 'T4'])[p_partkey % 4 + 1] tier, CASE WHEN p_partkey % 9 > 0 THEN p_partkey + 7 END token_id, CASE WHEN p_partkey % 5 > 0 THEN 'h' || (p_partkey % 100) END human, CASE WHEN p_partkey % 6 > 0 THEN 'm' || (p_partkey % 100) END mouse FROM part),
    t AS (SELECT 'h' || s_suppkey n, s_suppkey t FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT 'm' || s_suppkey, s_suppkey + 1000 FROM supplier WHERE s_suppkey % 4 > 0), o AS (SELECT * FROM g WHERE tier LIKE 'T1%' AND human IS NOT NULL ORDER BY md5('0|' || gene), gene LIMIT 120),
    u AS (SELECT gene, 'T1' tier, token_id, human, mouse FROM o UNION ALL SELECT gene, 'T3a', token_id, human, NULL FROM g WHERE tier LIKE 'T3a%' AND human IS NOT NULL UNION ALL SELECT gene, 'T3b', token_id, NULL, mouse FROM g WHERE tier LIKE 'T3b%' AND mouse IS NOT NULL)
    SELECT gene, tier, token_id AS rat_token, h.t AS human_token, m.t AS mouse_token FROM u LEFT JOIN t h ON h.n = human LEFT JOIN t m ON m.n = mouse WHERE token_id IS NOT NULL"""
)
def target_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    hundred = (k % 100).cast("string")
    genes = _t(spark, sf_dir, "part").select(k.cast("string").alias("gene"), F.element_at(F.array(*[F.lit(t) for t in ("T1_tri_species", "T3a_human_multi", "T3b_mouse_multi", "T4")]), (k % 4 + 1).cast("int")).alias("tier"), F.when(k % 9 > 0, k + 7).alias("token_id"), F.when(k % 5 > 0, F.concat(F.lit("h"), hundred)).alias("human"), F.when(k % 6 > 0, F.concat(F.lit("m"), hundred)).alias("mouse"))
    supplier = _t(spark, sf_dir, "supplier")
    tokens = supplier.where("s_suppkey % 3 > 0").select(F.concat(F.lit("h"), s.cast("string")).alias("gene"), s.alias("token")).unionByName(supplier.where("s_suppkey % 4 > 0").select(F.concat(F.lit("m"), s.cast("string")).alias("gene"), (s + 1000).alias("token")))
    return R.target_tokens(genes, tokens, 120)


@query("WITH l AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN '+ ' ELSE ' / ' END || p_type l FROM part WHERE p_size < 30), s AS (SELECT regexp_replace(l, '[^A-Za-z0-9]+', '_', 'g') n, l FROM l) SELECT n AS name, count(*) AS n_labels, string_agg(l, '|' ORDER BY l) AS labels FROM s GROUP BY 1 HAVING count(*) > 1")
def label_name_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "+ ").otherwise(" / "), "p_type")
    out = R.name_clashes(_t(spark, sf_dir, "part").where("p_size < 30").select(label.alias("label")), "label", safe_label(F.col("label")))
    return out.withColumn("labels", F.array_join("labels", "|"))


@query("SELECT l_partkey AS gene, count(DISTINCT l_linenumber) AS n_blocks FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) < (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def uneven_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.uneven_axes(_t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("block"), F.col("l_partkey").alias("gene")), "block", "gene")


@query(
    """SELECT o_custkey % 200 AS sample, count(*) AS n_clusters, CAST(sum(o_orderkey % 90) AS BIGINT) AS n_cells, round(avg((o_orderkey % 50) / 50), 6) AS confidence, count(*) FILTER ((o_orderkey % 50) / 50 < 0.3) AS n_low,
    round(sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey % 90 ELSE 0 END) / sum(o_orderkey % 90), 6) AS unknown_share FROM orders GROUP BY 1"""
)
def assignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("sample"), F.when(F.col("o_orderpriority") == "5-LOW", "Unknown").otherwise("known").alias("label"), (k % 90).alias("n_cells"), ((k % 50) / 50).alias("confidence"))
    return R.assignment_summary(rows, ["sample"], 0.3).withColumn("confidence", F.round("confidence", 6)).withColumn("unknown_share", F.round("unknown_share", 6))
