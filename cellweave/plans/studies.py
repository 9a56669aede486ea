"""Registered queries on study catalogs, cluster labels, scores and resampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.identifiers import ladder
from ..functions.stats import half_up
from ..operators import annotation as A
from ..operators import catalog as C
from ..operators import scoring as S
from .registry import _COUNTS, _counts, _t, query

_STRAIN_CASES = (("Sprague Dawley", "Sprague-Dawley"), (" SD ", "Sprague-Dawley"), ("Wistar Han", "Wistar"), ("F344/N", "Fischer 344"), ("lewis", "Lewis"), ("BN/NHsd", "Sprague-Dawley"), ("Unknown", "not_specified"), ("n/a", "not_applicable"), ("C57BL/6J", "C57BL/6J"), ("Dark Agouti", "Dark Agouti"), ("", "not_specified"), ("BALB/c x Long-Evans", "Long-Evans"))
_SEX_CASES = (("Male", "male"), (" f ", "female"), ("both", "both"), ("male and female pool", "mixed"), ("adult male rat", "male"), ("unknown", "not_specified"), ("N/A", "not_applicable"), ("castrated", "not_specified"), ("", "not_specified"), ("virgin female", "mixed"))
_TISSUE_CASES = (("Liver, small_intestine", "Liver|Small Intestine"), ("wat_sc", "WAT-SC"), ("brown adipose,  blood RNA,", "BAT|blood RNA"), ("skm", "skm"), ("", ""), ("left ventricle", "Left Ventricle"))
_TITLE_CASES = (("Visium section of liver", "fail:spatial"), ("iPSC co-culture", "fail:engineered"), ("Bulk RNA of heart", "fail:bulk"), ("liver E18.5", "warn:developmental"), ("adult rat hippocampus", "ok"), ("", "warn:unknown"), ("CD45+ cells, spatial", "fail:spatial"), ("neonatal heart", "warn:developmental"))


def _pick(cases: tuple, at: int, key: str) -> str:
    values = ", ".join("'" + c[at].replace("'", "''") + "'" for c in cases)
    return f"([{values}])[{key} % {len(cases)} + 1]"


def _picked(cases: tuple, key: str):  # noqa: ANN202
    return F.element_at(F.array(*[F.lit(c[0]) for c in cases]), (F.col(key) % len(cases) + 1).cast("int"))


@query(f"SELECT c_custkey, {_pick(_STRAIN_CASES, 1, 'c_custkey')} AS strain, {_pick(_SEX_CASES, 1, 'c_custkey')} AS sex, {_pick(_TISSUE_CASES, 1, 'c_custkey')} AS tissues, c_custkey % {len(_STRAIN_CASES)} IN (8, 11) AS mouse_strain FROM customer")
def metadata_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    strain = _picked(_STRAIN_CASES, "c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", L.strain_name(strain).alias("strain"), L.sex_name(_picked(_SEX_CASES, "c_custkey")).alias("sex"), F.array_join(L.tissue_names(_picked(_TISSUE_CASES, "c_custkey")), "|").alias("tissues"), L.mouse_strain(strain).alias("mouse_strain"))


@query(f"SELECT o_orderkey, {_pick(_TITLE_CASES, 1, 'o_orderkey')} AS status FROM orders")
def title_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", L.title_check(_picked(_TITLE_CASES, "o_orderkey")).alias("status"))


@query(
    """WITH s AS (SELECT o_custkey k, count(*) n, sum(o_totalprice) * 1000 bytes, bool_or(o_orderstatus = 'F') p, bool_or(o_orderpriority = '1-URGENT') c, bool_or(o_orderstatus = 'P') m FROM orders GROUP BY 1)
    SELECT k AS accession, 30 * CAST(p AS INTEGER) + 30 * CAST(c AS INTEGER) + 10 * CAST(m AS INTEGER) + 10 + 10 * CAST(k % 3 <> 0 AS INTEGER) + 10 AS usability, round((CAST(p AS INTEGER) + CAST(c AS INTEGER) + CAST(m AS INTEGER)) / 3, 2) AS completeness,
    CASE WHEN bytes < 1048576 THEN '<1MB' WHEN bytes < 10485760 THEN '1-10MB' WHEN bytes < 104857600 THEN '10-100MB' WHEN bytes < 1073741824 THEN '100MB-1GB' WHEN bytes < 10737418240 THEN '1-10GB' ELSE '>10GB' END AS size_band, k % 5 = 0 OR n > 500000 AS unfiltered FROM s"""
)
def study_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c, v: F.bool_or(F.col(c) == v)
    s = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("accession")).agg(F.count(F.lit(1)).alias("n"), (F.sum("o_totalprice") * 1000).alias("bytes"), has("o_orderstatus", "F").alias("p"), has("o_orderpriority", "1-URGENT").alias("c"), has("o_orderstatus", "P").alias("m"))
    summary = F.when(F.col("accession") % 3 != 0, "told").otherwise("")
    barcodes = F.when(F.col("accession") % 5 == 0, 737_280).otherwise(F.col("n"))
    score = L.usability_score(F.col("p"), F.col("c"), F.col("m"), F.lit("title"), summary, F.col("n"))
    return s.select("accession", score.alias("usability"), L.completeness(F.col("p"), F.col("c"), F.col("m")).alias("completeness"), L.size_band(F.col("bytes")).alias("size_band"), L.unfiltered_10x(barcodes).alias("unfiltered"))


@query(
    """SELECT a.s_suppkey AS a, b.n_nationkey AS b, CASE WHEN x = y THEN 100 WHEN contains(x, y) OR contains(y, x) THEN 50 + length(y) ELSE 10 * len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' ')))) END AS score
    FROM (SELECT s_suppkey, s_nationkey, lower(CASE s_suppkey % 3 WHEN 0 THEN 'Nation ' || s_nationkey WHEN 1 THEN 'left part of nation ' || s_nationkey ELSE 'part nation' END) x FROM supplier) a JOIN (SELECT *, lower('Nation ' || n_nationkey) y FROM nation) b ON n_nationkey = s_nationkey"""
)
def fuzzy_tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("s_nationkey").cast("string")
    x = ladder([(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Nation "), text)), (F.col("s_suppkey") % 3 == 1, F.concat(F.lit("left part of nation "), text))], F.lit("part nation"))
    both = _t(spark, sf_dir, "supplier").withColumn("x", x).join(_t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return both.select(F.col("s_suppkey").alias("a"), F.col("n_nationkey").alias("b"), L.fuzzy_match(F.col("x"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string"))).alias("score"))


@query(
    """WITH a AS (SELECT c_custkey k, c_name t, c_mktsegment d FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT o_custkey k, max(n) g, max(c) c FROM (SELECT o_custkey, o_orderkey * 20 n, 5 c FROM orders) GROUP BY 1), r AS (SELECT DISTINCT l_suppkey k FROM lineitem)
    SELECT coalesce(a.k, b.k, r.k) AS accession, t AS title, coalesce(d, 'unknown') AS data_type, g AS n_genes, coalesce(c, 0) AS n_cells, a.k IS NOT NULL AS has_catalog, b.k IS NOT NULL AS has_matrix, r.k IS NOT NULL AS has_review, coalesce(g BETWEEN 10000 AND 100000, false) AS gene_count_valid
    FROM a FULL JOIN b ON a.k = b.k FULL JOIN r ON r.k = coalesce(a.k, b.k)"""
)
def catalog_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = _t(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("accession"), F.col("c_name").alias("title"), F.lit("told").alias("summary"), F.col("c_mktsegment").alias("data_type"))
    matrices = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("accession"), (F.col("o_orderkey") * 20).alias("n_genes"), F.lit(5).alias("n_cells"))
    reviews = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("accession"), F.lit("topic").alias("topic"))
    return C.three_catalogs(studies, matrices, reviews).select("accession", "title", "data_type", "n_genes", "n_cells", "has_catalog", "has_matrix", "has_review", "gene_count_valid")


@query(
    """SELECT c_custkey AS accession, CASE WHEN c_custkey % 17 = 0 THEN 'excluded' WHEN c_custkey % 7 = 1 THEN 'not_sc_catalog' WHEN NOT CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN c_custkey % 2 = 0 ELSE false END THEN 'not_rat' WHEN c_custkey % 11 = 3 THEN 'not_sc_llm' END AS reason FROM customer"""
)
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    species = ladder([(k % 5 == 2, F.lit("Rattus norvegicus")), (k % 5 == 4, F.lit("Mus musculus"))])
    organisms = F.when(k % 5 == 3, F.array(F.lit("Homo sapiens"), F.when(k % 2 == 0, " Rat ").otherwise("Mus musculus")))
    catalog = _t(spark, sf_dir, "customer").select(
        k.alias("accession"), F.when(k % 7 == 1, "bulk").otherwise("single_cell").alias("data_type"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("is_rat"), species.alias("species"), organisms.alias("organisms"), F.when(k % 11 == 3, False).alias("is_single_cell")
    )
    return C.usable_studies(catalog, catalog.where("accession % 17 = 0").select("accession"))


@query(
    """WITH s AS (SELECT o_custkey k, max(o_totalprice) FILTER (o_orderkey % 2 = 0) s, max(o_totalprice) FILTER (o_orderkey % 2 = 1) b FROM orders GROUP BY 1)
    SELECT k AS accession, CASE WHEN s IS NOT NULL AND (b IS NULL OR s > 0.5 * b) THEN 'single_cell' ELSE 'bulk' END AS data_type, CASE WHEN s IS NOT NULL AND b IS NOT NULL THEN CASE WHEN s > 0.5 * b THEN 'kept_single_cell' ELSE 'kept_bulk' END END AS duplicate_resolved FROM s"""
)
def study_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 2 == 0, "single_cell").otherwise("bulk")
    return C.one_per_study(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("accession"), kind.alias("data_type"), F.col("o_totalprice").alias("size_bytes")))


@query(
    """WITH p AS (SELECT p_partkey id, p_name || CAST(p_partkey % 500 AS VARCHAR) s FROM part), e AS (SELECT lower(s) n, id, 0 l, -id pos FROM p WHERE id % 3 = 0 UNION ALL SELECT lower(s), id, 1, id FROM p WHERE id % 3 = 1 UNION ALL SELECT lower(s), id, 2, id FROM p WHERE id % 3 = 2)
    SELECT n AS name, arg_min(id, [l, pos]) AS gene_id, CAST(min(l) AS INTEGER) AS layer FROM e GROUP BY 1"""
)
def layered_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.concat("p_name", (F.col("p_partkey") % 500).cast("string")).alias("name"), F.col("p_partkey").alias("gene_id"), F.col("p_partkey").alias("pos"))
    return C.layered_lookup(*[p.where(f"gene_id % 3 = {k}") for k in range(3)])


@query(
    """WITH l AS (SELECT p_brand || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'a' END || CAST(p_partkey % 40 AS VARCHAR) n, p_partkey id FROM part WHERE p_partkey % 3 <> 0), r AS (SELECT DISTINCT p_brand || CASE WHEN p_partkey % 5 < 2 THEN 'A' ELSE 'a' END || CAST(p_partkey % 45 AS VARCHAR) raw_id FROM part),
    e AS (SELECT n, min(id) id FROM l GROUP BY 1), w AS (SELECT lower(n) n, min(id) id FROM l GROUP BY 1) SELECT raw_id, coalesce(e.id, w.id) AS gene_id FROM r LEFT JOIN e ON e.n = raw_id LEFT JOIN w ON w.n = lower(raw_id)"""
)
def exact_or_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    name = lambda upper, m: F.concat("p_brand", F.when(upper, "A").otherwise("a"), (F.col("p_partkey") % m).cast("string"))
    lookup = part.where("p_partkey % 3 <> 0").select(name(F.col("p_partkey") % 2 == 0, 40).alias("name"), F.col("p_partkey").alias("gene_id"))
    return C.exact_or_lower(part.select(name(F.col("p_partkey") % 5 < 2, 45).alias("raw_id")).distinct(), lookup)


@query(
    """WITH s AS (SELECT p_partkey pos, 'G' || p_partkey || '; G' || (p_partkey + 7) || CASE WHEN p_partkey % 3 = 0 THEN ';' ELSE '' END ids, 'old' || (p_partkey % 60) || ';' || p_brand || (p_partkey % 90) aliases FROM part),
    g AS (SELECT 'G' || p_partkey id FROM part WHERE p_partkey % 4 = 0), i AS (SELECT DISTINCT pos, trim(unnest(string_split(ids, ';'))) id FROM s), o AS (SELECT pos, min(id) id FROM i WHERE id IN (SELECT id FROM g) GROUP BY 1 HAVING count(*) = 1),
    n AS (SELECT pos, id, lower(trim(unnest(string_split(aliases, ';')))) a FROM o JOIN s USING (pos)) SELECT a AS alias, arg_min(id, pos) AS gene_id FROM n WHERE a <> '' GROUP BY 1"""
)
def gated_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    g = lambda c: F.concat(F.lit("G"), c.cast("string"))
    rows = _t(spark, sf_dir, "part").select(k.alias("pos"), F.concat(g(k), F.lit("; "), g(k + 7), F.when(k % 3 == 0, ";").otherwise("")).alias("ids"), F.concat(F.lit("old"), (k % 60).cast("string"), F.lit(";"), "p_brand", (k % 90).cast("string")).alias("aliases"))
    return C.single_gated(rows, _t(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(g(k).alias("gene_id")))


@query("SELECT c_custkey AS id, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def selection_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.set_difference(_t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), "id")


@query("SELECT o_custkey AS accession, count(*) AS n_samples, round(sum(o_totalprice), 2) AS size FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("accession")).agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.sum("o_totalprice"), 2).alias("size")).orderBy(F.desc("n_samples"), "accession").limit(10)


# Cells are orders, clusters their customers modulo 60, genes parts; markers tie a part's brand to it.
_CELLS = "cells AS (SELECT o_orderkey cell, o_custkey % 60 cluster FROM orders)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), (F.col("o_custkey") % 60).alias("cluster"))


@query(
    f"""WITH {_COUNTS}, {_CELLS}, mk AS (SELECT p_brand lb, p_partkey gene FROM part WHERE p_partkey % 10 = 0), n AS (SELECT cluster, count(*) n FROM cells GROUP BY 1), g AS (SELECT lb, count(*) g FROM mk GROUP BY 1)
    SELECT cluster, lb AS label, round(sum(count) / max(n) / max(g), 6) AS score FROM counts JOIN cells USING (cell) JOIN mk USING (gene) JOIN n USING (cluster) JOIN g USING (lb) GROUP BY 1, 2"""
)
def marker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = _t(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("gene"))
    out = A.marker_means(_counts(spark, sf_dir).withColumnRenamed("count", "value"), markers, _cells(spark, sf_dir))
    return out.withColumn("score", F.round("score", 6))


_SIGNED = "mk AS (SELECT p_brand lb, p_partkey gene, CASE WHEN p_partkey % 30 = 0 THEN -1 ELSE 1 END sign FROM part WHERE p_partkey % 10 = 0)"


@query(
    f"""WITH {_COUNTS}, {_CELLS}, {_SIGNED}, k AS (SELECT * FROM mk WHERE gene IN (SELECT gene FROM counts)), n AS (SELECT lb, count(*) n FROM k GROUP BY 1 HAVING count(*) FILTER (sign > 0) >= 2)
    SELECT cluster, lb AS label, round(sum(count * CASE WHEN sign > 0 THEN 2 ELSE -1 END) / sqrt(max(n)), 6) AS score FROM counts JOIN cells USING (cell) JOIN k USING (gene) JOIN n USING (lb) GROUP BY 1, 2"""
)
def sctype_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    markers = _t(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_brand").alias("label"), key.alias("gene"), F.when(key % 30 == 0, -1).otherwise(1).alias("sign"))
    out = A.sctype(_counts(spark, sf_dir).withColumnRenamed("count", "value"), markers, _cells(spark, sf_dir))
    return out.withColumn("score", F.round("score", 6))


# Two annotators of (sample, cluster) pairs: orders by customer and status.
_ANNOTATED = """a AS (SELECT o_orderkey sample, o_custkey cluster, o_orderpriority label, o_orderstatus tissue, o_totalprice FROM orders), b AS (SELECT sample, cluster, CASE WHEN sample % 3 = 0 THEN label ELSE 'other' END AS second FROM a WHERE sample % 4 <> 0),
    m AS (SELECT DISTINCT label, 'other' AS second, tissue, 'merged ' || label AS consensus FROM a WHERE tissue <> 'O'),
    j AS (SELECT a.sample, a.cluster, a.label, a.tissue, o_totalprice, coalesce(b.second, 'unknown') AS second FROM a LEFT JOIN b USING (sample, cluster)),
    c AS (SELECT j.*, coalesce(consensus, j.label) AS consensus, CASE WHEN consensus IS NULL THEN 'fallback' ELSE 'consensus' END AS source FROM j LEFT JOIN m ON m.label = j.label AND m.second = j.second AND m.tissue = j.tissue)"""


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("tissue"), "o_totalprice")
    b = a.where("sample % 4 <> 0").select("sample", "cluster", F.when(F.col("sample") % 3 == 0, F.col("label")).otherwise("other").alias("label"))
    m = a.where("tissue <> 'O'").select("label", F.lit("other").alias("second"), "tissue", F.concat(F.lit("merged "), "label").alias("consensus")).distinct()
    return A.two_annotators(a, b, ["sample", "cluster"], m)


@query(f"WITH {_ANNOTATED} SELECT sample, cluster, label, tissue, second, consensus, source FROM c")
def annotator_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).drop("o_totalprice")


@query(f"WITH {_ANNOTATED} SELECT label, second, coalesce(CASE WHEN tissue <> 'P' THEN tissue END, 'unknown') AS tissue, count(*) AS n_clusters, sum(sample % 7) AS n_cells, round(avg(o_totalprice), 4) AS confidence, round(avg(sample % 5), 4) AS margin FROM c GROUP BY 1, 2, 3")
def label_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotated(spark, sf_dir).select("label", "second", F.when(F.col("tissue") != "P", F.col("tissue")).alias("tissue"), (F.col("sample") % 7).alias("n_cells"), F.col("o_totalprice").alias("confidence"), (F.col("sample") % 5).alias("margin"))
    return A.label_triples(rows, ["label", "second", "tissue"]).withColumns({"confidence": F.round("confidence", 4), "margin": F.round("margin", 4)})


@query("SELECT o_orderkey AS sample, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE c_mktsegment END AS condition FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def annotation_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    geo, name = F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise(""), F.when(k % 5 == 0, F.col("o_orderpriority"))
    return rows.select(k.alias("sample"), A.first_told(geo, name, F.col("c_mktsegment")).alias("condition"))


@query(
    """WITH o AS (SELECT DISTINCT l_suppkey sample, l_partkey bc FROM lineitem WHERE l_linenumber < 4), a AS (SELECT DISTINCT l_suppkey + l_partkey % 2 asample, l_partkey bc FROM lineitem WHERE l_linenumber < 6),
    p AS (SELECT sample, asample, count(*) n FROM o JOIN a USING (bc) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, asample) r FROM p), s AS (SELECT sample, count(*) t FROM o GROUP BY 1)
    SELECT sample, asample AS author_sample, n AS overlap, round(n / t, 6) AS share FROM b JOIN s USING (sample) WHERE r = 1 AND n / t >= 0.3"""
)
def author_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    ours = lines.where("l_linenumber < 4").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("barcode"))
    authors = lines.where("l_linenumber < 6").select((F.col("l_suppkey") + F.col("l_partkey") % 2).alias("author_sample"), F.col("l_partkey").alias("barcode"))
    return A.adopt_labels(ours, authors).withColumn("share", F.round("share", 6))


@query(
    """WITH k AS (SELECT c_nationkey t, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END, 'unknown') k, count(*) n, count(*) FILTER (c_custkey % 3 = 0) d FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1, 2)
    SELECT n_nationkey AS tissue, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_samples, coalesce(round(100 * sum(d) / sum(n), 1), 0) AS pct_told, coalesce(string_agg(k || ':' || n, '; ' ORDER BY n DESC, k), '') AS kinds FROM nation LEFT JOIN k ON t = n_nationkey GROUP BY 1"""
)
def tissue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _t(spark, sf_dir, "customer").where("c_nationkey % 5 <> 0").select(F.col("c_nationkey").alias("tissue"), "c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("kind"))
    return A.coverage(samples, _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tissue")), F.col("c_custkey") % 3 == 0, "kind")


@query("WITH c AS (SELECT l_orderkey k, l_returnflag f, count(*) n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY k) t, row_number() OVER (PARTITION BY k ORDER BY n DESC, f DESC) r FROM c) SELECT k AS study, CASE WHEN n / t >= 0.6 THEN f ELSE 'mixed' END AS kind, round(n / t, 6) AS share FROM r WHERE r = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("study"), F.col("l_returnflag").alias("kind"))
    return A.majority(votes, ["study"], "kind").withColumn("share", F.round("share", 6))


@query("WITH k AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW') SELECT * FROM k WHERE o_custkey IN (SELECT o_custkey FROM k GROUP BY 1 HAVING count(*) >= 8)")
def small_states_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderpriority") == "5-LOW", "Unknown").otherwise(F.col("o_orderpriority"))
    return A.drop_small(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", label.alias("o_orderpriority")), "o_orderpriority", "o_custkey", 8)


@query(
    """WITH i AS (SELECT o_orderkey s, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 400 END g FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 1 AND (o_orderkey % 7 IN (0, 1, 2)) AND o_orderkey % 11 <> 4)
    SELECT s AS sample_id, g AS gsm FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s) r FROM i) WHERE g IS NULL OR r = 1"""
)
def sample_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    inventory = _t(spark, sf_dir, "orders").select(
        k.alias("sample_id"), F.when(F.col("o_custkey") % 3 == 1, "S1").otherwise("S2").alias("accession"), F.when(k % 13 != 0, F.col("o_custkey") % 400).alias("gsm"), (k % 2 == 0).alias("in_corpus"),
        F.when(k % 5 == 1, "Mus musculus").otherwise("Rattus norvegicus").alias("organism"), ladder([(k % 7 == 0, F.lit("Control")), (k % 7 == 1, F.lit("")), (k % 7 == 2, F.lit(None))], F.lit("treated")).alias("condition"), F.lit("male").alias("sex"), F.when(k % 11 == 4, "a Visium slide").otherwise("cells").alias("title"),
    )
    return A.select_samples(inventory, "S1", "rattus", condition="control", sex="Male", exclude="visium").select("sample_id", "gsm")


_PAIRS = "p AS (SELECT l_suppkey g, l_quantity truth, l_quantity + 40 * l_discount + l_linenumber est FROM lineitem)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("truth"), (F.col("l_quantity") + 40 * F.col("l_discount") + F.col("l_linenumber")).alias("estimate"))


@query(
    f"""WITH {_PAIRS}, q AS (SELECT g, truth, est, round(est, 6) e6 FROM p), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY truth) + (count(*) OVER (PARTITION BY g, truth) - 1) / 2 a, rank() OVER (PARTITION BY g ORDER BY e6) + (count(*) OVER (PARTITION BY g, e6) - 1) / 2 b FROM q)
    SELECT g, count(*) AS n, round(corr(truth, est), 6) AS pearson, round(corr(a, b), 6) AS spearman, round(sqrt(avg((est - truth) ** 2)), 6) AS rmse, round(round(avg(est - truth), 9), 6) AS bias, round(round(avg(truth), 9), 6) AS true_mean, round(round(avg(est), 9), 6) AS est_mean FROM r GROUP BY 1"""
)
def deconvolution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.estimate_scores(_pairs(spark, sf_dir).withColumn("estimate", F.round("estimate", 6)), ["g"])
    return out.select("g", "n", *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "rmse")], *[F.round(F.round(c, 9), 6).alias(c) for c in ("bias", "true_mean", "est_mean")])


@query(
    f"""WITH {_PAIRS}, t AS (SELECT g, avg(truth) m, corr(truth, est) r FROM p GROUP BY 1), d AS (SELECT g FROM t ORDER BY round(m, 9) DESC, g LIMIT 2), s AS (SELECT * FROM p WHERE g NOT IN (SELECT g FROM d))
    SELECT 'overall_pearson' AS metric, round(corr(truth, est), 6) AS value FROM p UNION ALL SELECT 'overall_rmse', round(sqrt(avg((est - truth) ** 2)), 6) FROM p UNION ALL SELECT 'macro_pearson', round(avg(r), 6) FROM t UNION ALL SELECT 'median_pearson', round(median(r), 6) FROM t
    UNION ALL SELECT 'separable_pearson', round(corr(truth, est), 6) FROM s UNION ALL SELECT 'separable_rmse', round(sqrt(avg((est - truth) ** 2)), 6) FROM s"""
)
def deconvolution_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overall_scores(_pairs(spark, sf_dir), "g", 2).withColumn("value", F.round("value", 6))


@query("SELECT l_linenumber AS purity, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1")
def purity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.five_numbers(_t(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "purity"), ["purity"], "l_extendedprice")
    return out.select("purity", "n", *[F.round(c, 4).alias(c) for c in ("mean", "q1", "median", "q3")])


@query("WITH m AS (SELECT l_suppkey s, median(l_quantity * (1 + l_suppkey % 3)) m FROM lineitem GROUP BY 1) SELECT s AS sample, m AS median, max(m) OVER () > 2.5 * min(m) OVER () AND min(m) OVER () > 0 AS mixed, m > 2 * min(m) OVER () AS is_high FROM m")
def modality_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_quantity") * (1 + F.col("l_suppkey") % 3)).alias("v"))
    return S.modality_mix(cells, "sample", "v")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7|' || o_orderkey), o_orderkey) r FROM orders) WHERE r <= 5")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capped_sample(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 5, seed="7")


@query("WITH o AS (SELECT o_custkey c, o_orderkey k, o_orderstatus s, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('3|' || o_orderkey), o_orderkey) r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) t FROM orders) SELECT a.c AS o_custkey, a.k AS o_orderkey, a.s AS o_orderstatus, b.s AS permuted FROM o a JOIN o b ON a.c = b.c AND a.r = b.t")
def permuted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.permuted_labels(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", "o_orderstatus", "3")


@query(
    """WITH o AS (SELECT o_custkey c, o_orderkey k, o_totalprice v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 p, count(*) OVER (PARTITION BY o_custkey) n FROM orders),
    d AS (SELECT c, k, n, b, CAST('0x' || substring(md5('0|' || b || '|' || k), 1, 12) AS BIGINT) % n p FROM o, range(1, 11) t(b)), m AS (SELECT d.c, d.b, avg(o.v) m FROM d JOIN o ON o.c = d.c AND o.p = d.p GROUP BY 1, 2), s AS (SELECT c, stddev_pop(m) sd FROM m GROUP BY 1)
    SELECT o.c AS o_custkey, count(*) AS n, round(avg(v), 6) AS point, round(round(max(sd), 7), 4) AS sd, round(round(CASE WHEN max(sd) > 1e-12 THEN avg(v) / max(sd) ELSE 0 END, 8), 4) AS z FROM o JOIN s ON s.c = o.c GROUP BY 1"""
)
def bootstrap_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.bootstrap_z(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 10)
    return out.select("o_custkey", "n", F.round("point", 6).alias("point"), *[half_up(half_up(F.col(c), n), 4).alias(c) for c, n in (("sd", 7), ("z", 8))])


@query(
    """WITH e AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY b ORDER BY md5('eta|' || b || '|' || vec_id), vec_id) r, row_number() OVER (PARTITION BY b ORDER BY label, vec_id) t, b FROM embeddings, range(0, 10) r(b)),
    z AS (SELECT a.b, a.vec_id, CASE WHEN a.b = 0 THEN a.label ELSE c.label END l, a.embedding FROM e a JOIN e c ON a.b = c.b AND a.r = c.t), y AS (SELECT b, l, generate_subscripts(embedding, 1) d, CAST(unnest(embedding) AS DOUBLE) x FROM z),
    w AS (SELECT b, d, avg(x) a, var_pop(x) * count(*) v FROM y GROUP BY 1, 2), g AS (SELECT b, l, d, count(*) n, avg(x) m FROM y GROUP BY 1, 2, 3), s AS (SELECT b, sum(n * (m - a) ** 2) s FROM g JOIN w USING (b, d) GROUP BY 1), t AS (SELECT b, sum(v) v FROM w GROUP BY 1), r AS (SELECT b, s / v eta FROM s JOIN t USING (b))
    SELECT round(max(eta) FILTER (b = 0), 6) AS eta2, count(*) - 1 AS draws, round((count(*) FILTER (b > 0 AND eta >= (SELECT eta FROM r WHERE b = 0)) + 1) / count(*), 6) AS p FROM r"""
)
def permutation_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    drawn = e.select("vec_id", "label", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("b")).withColumn("k", F.concat_ws("|", F.col("b").cast("string"), F.col("vec_id").cast("string")))
    dealt = S.permuted_labels(drawn.withColumnRenamed("label", "own"), ["b"], "k", "own", "eta").select("b", "vec_id", F.col("permuted").alias("label"))
    every = e.select(F.lit(0).alias("b"), "vec_id", "label").unionByName(dealt).join(e.drop("label"), "vec_id")
    eta = S.multivariate_eta(every, "embedding", "label", ("b",))
    observed = eta.where("b = 0").agg(F.max("eta2").alias("x")).first()["x"]  # one number
    return eta.where("b > 0").withColumn("observed", F.lit(observed).cast("double")).groupBy("observed").agg(F.count(F.lit(1)).alias("draws"), S.permutation_p(F.col("observed"), F.col("eta2")).alias("p")).select(F.round("observed", 6).alias("eta2"), "draws", F.round("p", 6).alias("p"))


@query(
    """WITH w AS (SELECT l_suppkey g, avg(l_extendedprice) FILTER (l_returnflag = 'R') ma, avg(l_extendedprice) FILTER (l_returnflag <> 'R') mb, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') va, var_samp(l_extendedprice) FILTER (l_returnflag <> 'R') vb, count(*) FILTER (l_returnflag = 'R') na, count(*) FILTER (l_returnflag <> 'R') nb FROM lineitem GROUP BY 1)
    SELECT g, na AS n_a, nb AS n_b, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 4) AS df FROM w"""
)
def welch_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.welch(_t(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "g"), ["g"], "l_extendedprice", F.col("l_returnflag") == "R")
    return out.select("g", "n_a", "n_b", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("SELECT o_orderkey AS block, CASE WHEN coalesce(CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 60 END, 0) < 25 THEN 'QUIET' WHEN o_orderkey % 4 = 1 THEN 'FLAG_COMPOSITION' ELSE 'PASS_EXPRESSION' END AS verdict FROM orders")
def composition_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(k.alias("block"), S.composition_verdict(F.when(k % 9 > 0, k % 60), ladder([(k % 4 == 1, F.lit(0.01)), (k % 4 == 2, F.lit(0.5))])).alias("verdict"))


@query(
    """WITH e AS (SELECT o_custkey g, CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END x, o_orderkey % 3 > 0 p, o_orderkey % 4 > 1 w, o_orderkey % 5 > 2 s, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END d, o_orderkey % 7 < 3 c, o_totalprice f FROM orders),
    a AS (SELECT g, bool_or(p) p, bool_or(p AND w) w, bool_or(p AND w AND s) s, bool_or(p AND w AND s AND (x IS NULL OR d = x)) r, arg_max(c, f) FILTER (p AND w AND s AND (x IS NULL OR d = x)) c FROM e GROUP BY 1)
    SELECT g, CASE WHEN NOT p THEN 'not_testable' WHEN NOT w THEN 'underpowered' WHEN NOT s THEN 'not_significant' WHEN NOT r THEN 'wrong_direction' WHEN c THEN 'recovered_confounded' ELSE 'recovered' END AS outcome FROM a"""
)
def miss_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, g = F.col("o_orderkey"), F.col("o_custkey")
    rows = _t(spark, sf_dir, "orders").select(
        g.alias("g"), F.when(g % 3 == 0, 1).when(g % 3 == 1, -1).alias("expected"), (k % 3 > 0).alias("present"), (k % 4 > 1).alias("powered"), (k % 5 > 2).alias("significant"),
        F.when(k % 2 == 0, 1).otherwise(-1).alias("direction"), (k % 7 < 3).alias("confounded"), F.col("o_totalprice").alias("mean_fraction"),
    )
    return S.miss_ladder(rows, ["g"])
