"""Registered queries of the expression engine and the SQL that they are held against.

The driver's tables stand in for the engine's own: lineitem for counts(cell, gene, count), part for genes, orders for
cells, customer and supplier for samples and studies, embeddings and labels for representations and outcomes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import stats as S
from ..operators import catalog as C
from ..operators import corpus as K
from ..operators import expression as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_COUNTS = "counts AS (SELECT l_orderkey cell, l_partkey gene, sum(l_quantity) count FROM lineitem GROUP BY 1, 2)"
_MEDIANS = "medians AS (SELECT gene, count(*) n, quantile_cont(count, 0.5) median FROM counts WHERE count > 0 GROUP BY gene HAVING count(*) >= 10)"
_RANKED = "ranked AS (SELECT cell, gene, log2(1 + count / median) v, row_number() OVER (PARTITION BY cell ORDER BY round(log2(1 + count / median), 6) DESC, gene) r FROM counts JOIN medians USING (gene) WHERE count > 0)"
_STATS = "stats AS (SELECT cell, sum(count) library_size, count(*) FILTER (count > 0) n_genes, sum(CASE WHEN gene % 20 = 0 THEN count ELSE 0 END) / sum(count) mito FROM counts GROUP BY cell)"
_IDS = "ids AS (SELECT p_partkey, p_brand, CASE p_partkey % 8 WHEN 0 THEN 'ensrnog' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') || '.2' WHEN 1 THEN 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') WHEN 2 THEN 'JACYVU01' || CAST(p_partkey AS VARCHAR) WHEN 3 THEN upper(p_name) || CAST(p_partkey // 8 AS VARCHAR) WHEN 4 THEN 'old' || CAST(p_partkey // 8 AS VARCHAR) WHEN 5 THEN 'LOC' || CAST(p_partkey AS VARCHAR) WHEN 6 THEN 'AC' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END raw_id FROM part)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counts(spark: SparkSession, sf_dir: str, gene: str = "l_partkey") -> DataFrame:
    raw = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col(gene).alias("gene"), F.col("l_quantity").alias("count"))
    return E.merge_duplicates(raw)


def _ranked(spark: SparkSession, sf_dir: str, longest: int) -> DataFrame:
    counts = _counts(spark, sf_dir)
    return E.rank_tokens(counts, E.gene_quantiles(counts), longest)


def _lists(spark: SparkSession, sf_dir: str, longest: int) -> DataFrame:
    counts = _counts(spark, sf_dir)
    return E.ranked_lists(counts, E.gene_quantiles(counts), longest)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cell_stats(_counts(spark, sf_dir), F.col("gene") % 20 == 0)


def _raw_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of several kinds made from the part table."""
    key, turn = F.col("p_partkey"), F.floor(F.col("p_partkey") / 8).cast("string")
    text = key.cast("string")
    kinds = [
        F.concat(F.lit("ensrnog"), F.lpad(text, 11, "0"), F.lit(".2")),
        F.concat(F.lit("ENSG"), F.lpad(text, 11, "0")),
        F.concat(F.lit("JACYVU01"), text),
        F.concat(F.upper("p_name"), turn),
        F.concat(F.lit("old"), turn),
        F.concat(F.lit("LOC"), text),
        F.concat(F.lit("AC"), F.lpad(text, 6, "0")),
        text,
    ]
    return _t(spark, sf_dir, "part").select("p_partkey", "p_brand", I.ladder((key % 8 == i, k) for i, k in enumerate(kinds)).alias("raw_id"))


@query(f"WITH {_COUNTS} SELECT cell, gene, count FROM counts")
def merge_duplicate_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"WITH {_COUNTS}, {_MEDIANS}, {_RANKED} SELECT cell, CAST(r AS INTEGER) AS rank, gene, round(v, 6) AS value FROM ranked WHERE r <= 2048")
def tokenize_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, 2048).withColumn("value", F.round("value", 6))


@query(f"WITH {_COUNTS}, {_MEDIANS}, {_RANKED} SELECT cell, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(CAST(gene AS VARCHAR), ',' ORDER BY r) AS ids, 2048 AS width, CAST(2048 - count(*) AS INTEGER) AS n_padded FROM ranked WHERE r <= 2048 GROUP BY cell")
def tokenize_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.padded(_lists(spark, sf_dir, 2048), 2048)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    rest = F.slice("input_ids", F.col("n_tokens") + 1, F.lit(2048))
    zeros = F.size(rest) - F.size(F.array_remove(rest, 0))
    return rows.select("cell", "n_tokens", text(F.slice("input_ids", F.lit(1), F.col("n_tokens"))).alias("ids"), F.size("input_ids").alias("width"), zeros.alias("n_padded"))


@query(
    f"""WITH {_COUNTS}, {_MEDIANS}, {_RANKED}, m AS (SELECT *, gene % 10 = 0 p FROM ranked WHERE r <= 4096),
    k AS (SELECT *, least(count(*) FILTER (p AND r > 2048) OVER c, count(*) FILTER (NOT p AND r <= 2048) OVER c) k,
      count(*) FILTER (p AND r > 2048) OVER (PARTITION BY cell ORDER BY r) up, count(*) FILTER (NOT p AND r <= 2048) OVER (PARTITION BY cell ORDER BY r DESC) down
      FROM m WINDOW c AS (PARTITION BY cell))
    SELECT cell, CAST(r AS INTEGER) AS rank, gene, p AS is_priority FROM k WHERE CASE WHEN p AND r > 2048 THEN up <= k WHEN NOT p AND r <= 2048 THEN down > k ELSE r <= 2048 END"""
)
def tokenize_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = _t(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("gene"))
    return E.promote_priority(_ranked(spark, sf_dir, 4096), genes, base=2048, window=4096).drop("value")


@query(f"WITH {_COUNTS} SELECT gene, count(*) FILTER (count > 0) AS n_nonzero, sum(count) AS total, round(avg(count) FILTER (count > 0), 4) AS mean_nonzero FROM counts GROUP BY gene")
def gene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gene_stats(_counts(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT gene, count(*) AS n_nonzero, round(quantile_cont(count, 0.25), 6) AS p25, round(quantile_cont(count, 0.5), 6) AS median, round(quantile_cont(count, 0.75), 6) AS p75, round(quantile_cont(count, 0.95), 6) AS p95 FROM counts WHERE count > 0 GROUP BY gene HAVING count(*) >= 10")
def gene_median_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.gene_quantiles(_counts(spark, sf_dir))
    return out.select("gene", "n_nonzero", *[F.round(c, 6).alias(c) for c in ("p25", "median", "p75", "p95")])


@query(
    f"""WITH {_COUNTS} SELECT gene, count(*) AS n_nonzero, round(round(avg(count), 8), 5) AS mean_nonzero, round(round(var_pop(count), 8), 5) AS var_nonzero, round(round(stddev_pop(count), 8), 5) AS std_nonzero,
    round(round(sum(count) / (SELECT count(DISTINCT cell) FROM counts), 8), 5) AS mean_all, round(round(1 - count(*) / (SELECT count(DISTINCT cell) FROM counts), 8), 5) AS zero_fraction FROM counts WHERE count > 0 GROUP BY gene"""
)
def derived_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    out = E.derived_stats(counts, counts.select("cell").distinct().count())
    return out.select("gene", "n_nonzero", *[F.round(F.round(c, 8), 5).alias(c) for c in ("mean_nonzero", "var_nonzero", "std_nonzero", "mean_all", "zero_fraction")])


@query(f"WITH {_COUNTS}, {_MEDIANS} SELECT p_type AS biotype, count(*) AS n_genes, round(quantile_cont(median, 0.5), 6) AS median_of_medians, min(median) AS least, max(median) AS most FROM medians JOIN part ON gene = p_partkey GROUP BY 1")
def biotype_median_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("biotype"))
    out = E.gene_quantiles(_counts(spark, sf_dir)).join(genes, "gene").groupBy("biotype")
    return out.agg(F.count("*").alias("n_genes"), F.round(F.percentile("median", F.lit(0.5)), 6).alias("median_of_medians"), F.min("median").alias("least"), F.max("median").alias("most"))


@query(f"WITH {_COUNTS}, {_STATS} SELECT cell, library_size, n_genes, round(mito, 6) AS mito_fraction FROM stats")
def cell_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).withColumn("mito_fraction", F.round("mito_fraction", 6))


@query(
    f"""WITH {_COUNTS}, {_STATS}, s AS (SELECT stats.*, o_custkey % 50 sample FROM stats JOIN orders ON cell = o_orderkey),
    m AS (SELECT sample, count(*) n, avg(library_size) ml, stddev_pop(library_size) sl, avg(mito) mm, stddev_pop(mito) sm FROM s GROUP BY 1)
    SELECT cell, sample FROM s JOIN m USING (sample) WHERE n < 3 OR (coalesce(abs((library_size - ml) / nullif(sl, 0)), 0) < 3 AND coalesce(abs((mito - mm) / nullif(sm, 0)), 0) < 3)"""
)
def cell_zscore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), (F.col("o_custkey") % 50).alias("sample"))
    return E.zscore_filter(_stats(spark, sf_dir).join(cells, "cell"), "sample").select("cell", "sample")


@query("WITH c AS (SELECT l_suppkey cell, l_partkey gene FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) > 0) SELECT cell, count(*) FILTER (gene % 4 = 0) AS n_core, count(*) AS n_genes FROM c GROUP BY cell HAVING count(*) FILTER (gene % 4 = 0) > 6 AND count(*) >= 200")
def core_gene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the usual values; suppliers are the cells, as orders have too few genes to reach them."""
    core = _t(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("gene"))
    counts = E.merge_duplicates(_t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("count")))
    return E.core_gene_filter(counts, core)


@query(
    """WITH c AS (SELECT l_orderkey cell, l_suppkey gene, sum(l_quantity) x FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) > 0),
    g AS (SELECT gene FROM c GROUP BY 1 HAVING count(*) > 0.01 * (SELECT count(DISTINCT cell) FROM c)), o AS (SELECT * FROM c WHERE gene IN (SELECT gene FROM g)),
    p AS (SELECT a.gene gene_1, b.gene gene_2, count(*) n_cells, CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0 THEN covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) END r FROM o a JOIN o b ON a.cell = b.cell AND a.gene < b.gene GROUP BY 1, 2)
    SELECT gene_1, gene_2, n_cells, round(r, 6) AS r FROM p WHERE n_cells >= 10 AND r > 0.3"""
)
def coexpression_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir, "l_suppkey")
    out = E.coexpression_pairs(counts, counts.select("cell").distinct().count(), least_share=0.01, above=0.3)
    return out.withColumn("r", F.round("r", 6))


@query(f"WITH {_COUNTS} SELECT cell, gene, round(count * 10000 / sum(count) OVER (PARTITION BY cell), 6) AS value FROM counts")
def normalize_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.normalize_total(_counts(spark, sf_dir)).select("cell", "gene", F.round("value", 6).alias("value"))


@query(f"WITH {_COUNTS}, l AS (SELECT cell, sum(count) library_size FROM counts GROUP BY 1) SELECT cell, gene // 3 AS target, sum(count) AS count, library_size, round(sum(count) / library_size, 6) AS fraction FROM counts JOIN l USING (cell) WHERE gene % 5 <> 0 GROUP BY cell, gene // 3, library_size")
def project_many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = _t(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("gene"), F.floor(F.col("p_partkey") / 3).alias("target"))
    return E.project(_counts(spark, sf_dir), genes).withColumn("fraction", F.round("fraction", 6))


@query("SELECT l_partkey AS gene, count(DISTINCT l_suppkey) AS n_studies, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ';') AS study_list FROM lineitem GROUP BY 1")
def gene_universe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.universe(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").cast("string").alias("study")))


@query(
    f"""WITH {_IDS}, n AS (SELECT p_partkey, raw_id, split_part(trim(raw_id), '.', 1) s FROM ids)
    SELECT p_partkey, raw_id, upper(s) AS normalized,
    CASE WHEN regexp_matches(s, '(?i)^ENSRNOG\\d{{11}}$') THEN 'ensembl_rat' WHEN regexp_matches(s, '(?i)^ENSG\\d{{11}}$') THEN 'ensembl_human' WHEN regexp_matches(s, '(?i)^LOC\\d+$') THEN 'loc'
      WHEN regexp_matches(s, '(?i)^JACYVU\\d+') OR regexp_matches(s, '(?i)^AC\\d{{6}}') THEN 'contig' WHEN regexp_matches(s, '^[A-Za-z]') AND length(s) BETWEEN 2 AND 30 THEN 'symbol' ELSE 'unknown' END AS namespace,
    CASE WHEN regexp_matches(s, '(?i)^JACYVU\\d+') THEN 'jacyvu_scaffold' WHEN regexp_matches(s, '(?i)^AC\\d{{6}}') THEN 'ac_contig' END AS non_gene FROM n"""
)
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw_id")
    return _raw_ids(spark, sf_dir).select("p_partkey", "raw_id", I.normalize_ensembl(raw).alias("normalized"), I.namespace(raw).alias("namespace"), I.non_gene(raw).alias("non_gene"))


@query(
    f"""WITH {_IDS}, g AS (SELECT 'ENSRNOG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') gene_id, p_name || CAST(p_partkey // 16 AS VARCHAR) symbol, p_partkey pos FROM part WHERE p_partkey % 16 < 12),
    sy AS (SELECT lower(symbol) k, min_by(gene_id, pos) gene_id FROM g GROUP BY 1), al AS (SELECT 'old' || CAST(p_partkey // 4 AS VARCHAR) k, min('ENSRNOG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0')) gene_id FROM part WHERE p_partkey % 16 < 12 GROUP BY 1),
    j AS (SELECT raw_id, g.gene_id d, sy.gene_id s, al.gene_id a, regexp_matches(raw_id, '^(\\d+|[A-Z]{{2}}\\d{{6,8}}|JACYVU\\d+)$') OR regexp_matches(raw_id, '(?i)^(ENSG\\d|ENSMUSG|chr)') junk, regexp_matches(upper(split_part(raw_id, '.', 1)), '^ENS[A-Z]*G\\d{{11}}$') f
      FROM ids LEFT JOIN g ON g.gene_id = upper(split_part(raw_id, '.', 1)) LEFT JOIN sy ON sy.k = lower(raw_id) LEFT JOIN al ON al.k = lower(raw_id)),
    m AS (SELECT *, CASE WHEN junk THEN 'non_gene' WHEN d IS NOT NULL THEN 'direct' WHEN f THEN 'foreign' WHEN s IS NOT NULL THEN 'symbol' WHEN a IS NOT NULL THEN 'synonym' ELSE 'unresolved' END AS method FROM j)
    SELECT raw_id, CASE method WHEN 'direct' THEN d WHEN 'symbol' THEN s WHEN 'synonym' THEN a END AS gene_id, method FROM m"""
)
def resolve_gene_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    gene_id = F.concat(F.lit("ENSRNOG"), F.lpad(key.cast("string"), 11, "0")).alias("gene_id")
    part = _t(spark, sf_dir, "part").where("p_partkey % 16 < 12")
    genes = part.select(gene_id, F.concat("p_name", F.floor(key / 16).cast("string")).alias("symbol"), key.alias("pos"))
    synonyms = part.select(F.concat(F.lit("old"), F.floor(key / 4).cast("string")).alias("alias"), gene_id, key.alias("pos"))
    return C.resolve(_raw_ids(spark, sf_dir).select("raw_id"), genes, synonyms)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'protein_coding' WHEN p_partkey % 3 = 1 THEN 'lncrna' ELSE lower(p_type) END AS biotype FROM part")
def biotype_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    raw = I.ladder([(key % 3 == 0, F.lit("protein-coding gene")), (key % 3 == 1, F.lit(" lincRNA"))], F.col("p_type"))
    return _t(spark, sf_dir, "part").select("p_partkey", I.biotype(raw).alias("biotype"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') AS safe, upper(regexp_extract(split_part(url, '/', 3), '^([A-Za-z]{3,})', 1)) AS root FROM pages")
def label_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", I.safe_label(F.col("url")).alias("safe"), I.symbol_root(F.split_part("url", F.lit("/"), F.lit(3))).alias("root"))


@query("SELECT k AS kmer, count(*) AS n, count(DISTINCT p_partkey) AS n_parts FROM (SELECT p_partkey, unnest(list_transform(range(1, length(p_name) - 4), lambda i: substring(p_name, i, 6))) k FROM part) GROUP BY 1")
def kmer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kmer_counts(_t(spark, sf_dir, "part"), "p_partkey", "p_name").withColumnRenamed("n_keys", "n_parts")


_ORTHOLOGS = "o AS (SELECT l_suppkey gene, l_partkey target, l_linenumber pos, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity * 2 END identity FROM lineitem)"
_BEST = f"{_ORTHOLOGS}, b AS (SELECT gene, target, identity FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY coalesce(identity, 0) DESC, pos, target DESC, identity DESC NULLS LAST) r FROM (SELECT gene, target, min(pos) pos, identity FROM o GROUP BY ALL)) WHERE r = 1)"


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = F.when(F.col("l_discount") != 0, F.col("l_quantity") * 2)
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("line"), identity.alias("identity"))
    # Positions must be unique for a defined choice; the line number alone is not, so the target follows it.
    return C.best_candidate(rows.withColumn("pos", F.col("line").cast("long") * 1_000_000_000_000 - F.col("target")))


@query(f"WITH {_BEST} SELECT gene, target, identity FROM b")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


@query(
    f"""WITH {_BEST}, t AS (SELECT gene, target, identity, CASE gene % 5 WHEN 0 THEN 'T1_tri_species' WHEN 1 THEN 'T2a_human_one2one' WHEN 2 THEN 'T2b_mouse_one2one' WHEN 3 THEN 'T3a_human_multi' ELSE 'T4_rat_specific' END tier, CASE gene % 3 WHEN 0 THEN 'lncrna' ELSE 'protein_coding' END biotype, count(*) OVER (PARTITION BY target) c FROM b)
    SELECT gene, tier, biotype, c AS collisions, CASE WHEN gene % 5 < 3 AND biotype = 'protein_coding' AND c <= 1 AND identity >= 70 THEN 'high' WHEN gene % 5 < 3 THEN 'medium' WHEN gene % 5 = 3 AND c <= 2 AND identity >= 40 AND biotype <> 'lncrna' THEN 'medium' ELSE 'low' END AS confidence FROM t"""
)
def ortholog_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, gene = _best(spark, sf_dir), F.col("gene")
    names = ("T1_tri_species", "T2a_human_one2one", "T2b_mouse_one2one", "T3a_human_multi")
    tier = I.ladder(((gene % 5 == i, F.lit(n)) for i, n in enumerate(names)), F.lit("T4_rat_specific"))
    biotype = F.when(gene % 3 == 0, "lncrna").otherwise("protein_coding")
    shared = best.groupBy("target").agg(F.count("*").alias("collisions"))
    tiers = best.join(shared, "target").withColumns({"tier": tier, "biotype": biotype})
    return tiers.select("gene", "tier", "biotype", "collisions", C.confidence(F.col("tier"), F.col("biotype"), F.col("collisions"), F.col("identity")).alias("confidence"))


@query("SELECT 'ENSRNOG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS gene, row_number() OVER (ORDER BY lpad(CAST(p_partkey AS VARCHAR), 11, '0')) + 50000 AS token_id FROM part WHERE p_size % 3 = 0")
def new_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = _t(spark, sf_dir, "part").where("p_size % 3 = 0").select(F.concat(F.lit("ENSRNOG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias("gene"))
    return S.numbered(genes, "gene", prefix=15, start=50_001, out="token_id")


@query(f"WITH {_COUNTS}, {_MEDIANS}, h AS (SELECT gene, CASE WHEN gene % 4 = 0 THEN 0 ELSE median + 1 END median FROM medians WHERE gene % 3 = 0), r AS (SELECT gene, CASE WHEN gene % 7 = 0 THEN 0 ELSE median END median FROM medians) SELECT gene, CASE WHEN h.median > 0 THEN h.median WHEN r.median > 0 THEN r.median ELSE 1 END AS median, CASE WHEN h.median > 0 THEN 'human' WHEN r.median > 0 THEN 'rat' ELSE 'default' END AS source FROM r LEFT JOIN h USING (gene)")
def hybrid_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = E.gene_quantiles(_counts(spark, sf_dir)).select("gene", "median")
    human = own.where("gene % 3 = 0").select("gene", F.when(F.col("gene") % 4 == 0, 0.0).otherwise(F.col("median") + 1).alias("median"))
    return C.hybrid_median(own.select("gene", F.when(F.col("gene") % 7 == 0, 0.0).otherwise(F.col("median")).alias("median")), human)


@query("WITH a AS (SELECT o_custkey k, count(*) n, sum(o_totalprice) v FROM orders GROUP BY 1), c AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0) SELECT coalesce(c_custkey, k) AS accession, coalesce(c_mktsegment, 'unknown') AS data_type, coalesce(n, 0) AS n_samples, c_custkey IS NOT NULL AS has_catalog, k IS NOT NULL AS has_matrix FROM c FULL JOIN a ON c_custkey = k")
def catalog_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = _t(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("accession"), "c_mktsegment", F.lit(True).alias("_c"))
    matrix = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("accession")).agg(F.count("*").alias("n"))
    both = studies.join(matrix, "accession", "full_outer")
    return both.select("accession", F.coalesce("c_mktsegment", F.lit("unknown")).alias("data_type"), F.coalesce("n", F.lit(0)).alias("n_samples"), F.col("_c").isNotNull().alias("has_catalog"), F.col("n").isNotNull().alias("has_matrix"))


@query("SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN '(all)' ELSE coalesce(c_mktsegment, '(none)') END AS segment, CASE WHEN grouping(n_regionkey) = 1 THEN '(all)' ELSE coalesce(CAST(n_regionkey AS VARCHAR), '(none)') END AS region, count(*) AS n, round(sum(c_acctbal), 2) AS total, max(c_acctbal) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment), (n_regionkey), (c_mktsegment, n_regionkey), ())")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    total = lambda c: F.when(F.grouping(c) == 1, "(all)").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("(none)")))
    out = joined.cube("c_mktsegment", "n_regionkey").agg(total("c_mktsegment").alias("segment"), total("n_regionkey").alias("region"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max("c_acctbal").alias("most"))
    return out.select("segment", "region", "n", "total", "most")


@query("WITH a AS (SELECT o_custkey, count(*) n, max(o_totalprice) / 5000 s FROM orders GROUP BY 1) SELECT CASE WHEN s >= 70 THEN 'high' WHEN s >= 40 THEN 'medium' ELSE 'low' END AS usability, CASE WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' ELSE '51-100' END AS samples, count(*) AS n_studies FROM a GROUP BY 1, 2")
def usability_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.max("o_totalprice") / 5000).alias("s"))
    return studies.groupBy(C.usability(F.col("s")).alias("usability"), C.sample_band(F.col("n")).alias("samples")).agg(F.count("*").alias("n_studies"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS band, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_props_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.floor(F.get_json_object("props", "$.k").cast("long") / 10)
    return _t(spark, sf_dir, "events").groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS t0, count(*) FILTER (user_id % 3 = 1) AS t1, count(*) FILTER (user_id % 3 = 2) AS t2 FROM events GROUP BY 1")
def celltype_tissue_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tissues = _t(spark, sf_dir, "events").select("event_type", F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tissue"))
    return tissues.groupBy("event_type").pivot("tissue", ["t0", "t1", "t2"]).count().na.fill(0)


@query("WITH s AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY v DESC, l_suppkey) r FROM s) SELECT l_orderkey, max(l_suppkey) FILTER (r = 1) AS best, max(l_suppkey) FILTER (r = 2) AS second, max(v) FILTER (r = 1) - coalesce(max(v) FILTER (r = 2), 0) AS margin FROM r GROUP BY 1")
def best_second_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").alias("label")).agg(F.sum("l_quantity").alias("score"))
    return C.best_and_second(scores.withColumn("label_rank", F.col("label")), ["l_orderkey"])


@query("SELECT l_orderkey AS cell, min(l_returnflag) AS label FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def conflicting_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflict_free(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_returnflag").alias("label")), "cell", "label")


@query("SELECT n AS task FROM range((SELECT max(l_orderkey) + 1 FROM lineitem)) t(n) WHERE n NOT IN (SELECT l_orderkey FROM lineitem)")
def manifest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"))
    return C.missing_tasks(done, (done.agg(F.max("task")).first()[0] or -1) + 1)


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS owner FROM events")
def archive_listing_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.owner_fill(_t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error", "event_id").select("event_id", "user_id", "owner")


@query("WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings), g AS (SELECT dim, label, count(*) n, avg(x) m FROM x GROUP BY 1, 2), a AS (SELECT dim, avg(x) m, var_pop(x) * count(*) t FROM x GROUP BY 1) SELECT CAST(dim AS INTEGER) AS dim, round(sum(n * (g.m - a.m) ** 2) / max(t), 6) AS eta2 FROM g JOIN a USING (dim) GROUP BY dim")
def eta2_per_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.eta_squared(_t(spark, sf_dir, "embeddings"), "embedding", "label").select("dim", F.round("eta2", 6).alias("eta2"))


@query("WITH j AS (SELECT lang, n_chars v, quality q FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY v) + (count(*) OVER (PARTITION BY lang, v) - 1) / 2 r FROM j) SELECT lang, sum(q) AS n_pos, count(*) - sum(q) AS n_neg, CASE WHEN sum(q) > 0 AND sum(q) < count(*) THEN round((sum(r) FILTER (q = 1) - sum(q) * (sum(q) + 1) / 2) / (sum(q) * (count(*) - sum(q))), 6) END AS auc FROM r GROUP BY lang")
def auc_ranksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return S.auc(joined, ["lang"], "n_chars", "quality").withColumn("auc", F.round("auc", 6))


@query("WITH r AS (SELECT l_suppkey g, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2 b FROM lineitem) SELECT g AS l_suppkey, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS rho FROM r GROUP BY 1")
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spearman(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


_P = "p AS (SELECT o_orderkey k, o_orderstatus s, ((o_orderkey * 7919) % 10007 + 1) / 10008 p, ((o_orderkey * 104729) % 10007 + 1) / 10008 q FROM orders)"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = lambda c: (F.col("o_orderkey") * c % 10007 + 1) / F.lit(10008)
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), draw(7919).alias("p"), draw(104729).alias("q"))


@query(f"WITH {_P}, w AS (SELECT *, p * count(*) OVER (PARTITION BY s) / count(*) OVER (PARTITION BY s ORDER BY p) raw FROM p) SELECT k, round(least(1, min(raw) OVER (PARTITION BY s ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr FROM w WHERE true")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.benjamini_hochberg(_tests(spark, sf_dir), ["s"], "p").select("k", F.round("fdr", 6).alias("fdr"))


@query(f"WITH {_P}, w AS (SELECT k, p * count(*) OVER (PARTITION BY s) / (rank() OVER (PARTITION BY s ORDER BY p) + (count(*) OVER (PARTITION BY s, p) - 1) / 2) raw FROM p) SELECT k, round(least(1, raw), 6) AS fdr FROM w")
def bh_nonmonotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.benjamini_hochberg(_tests(spark, sf_dir), ["s"], "p", monotone=False).select("k", F.round("fdr", 6).alias("fdr"))


@query(f"WITH {_P} SELECT k, round(p * q * (1 - ln(p) - ln(q)), 6) AS p_fisher FROM p")
def fisher_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tests(spark, sf_dir).select("k", F.round(S.fisher_two(F.col("p"), F.col("q")), 6).alias("p_fisher"))


@query(f"WITH {_P} SELECT k, CASE WHEN p < 0.3 AND q < 0.3 THEN CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'up_both' WHEN k % 2 = 1 AND k % 3 <> 0 THEN 'down_both' ELSE 'opposite' END WHEN q < 0.3 THEN 'F_only' WHEN p < 0.3 THEN 'M_only' ELSE 'null' END AS state FROM p")
def sexcons_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = lambda n: F.when(F.col("k") % n == 0, 1.0).otherwise(-1.0)
    return _tests(spark, sf_dir).select("k", C.sex_state(F.col("p"), F.col("q"), z(2), z(3), alpha=0.3).alias("state"))


@query(f"WITH {_P} SELECT k, CASE WHEN k % 11 = 0 THEN 'no_human_block' WHEN p >= 0.6 AND q < 0.3 THEN 'PRESERVED' WHEN p >= 0.6 THEN 'WEAKENED' ELSE 'LOST' END AS state FROM p")
def transfer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.col("k") % 11 != 0, F.col("p"))
    return _tests(spark, sf_dir).select("k", C.transfer_state(found, F.col("q"), 0.6, 0.3).alias("state"))
