"""Registered queries that compare estimates, representations and test results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as V
from .registry import _t, query


def _spearman(table: str, by: str, x: str, y: str) -> str:
    """SQL of by, n and rho over the rows of a table."""
    mean = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"
    return f"SELECT {by}, count(*) n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END rho FROM (SELECT *, {mean(x)} rx, {mean(y)} ry FROM {table}) GROUP BY {by}"


_ERRORS = "SELECT l_suppkey k, l_linenumber t, avg(l_discount) FILTER (l_returnflag = 'R') b, avg(l_discount) FILTER (l_returnflag = 'N') p FROM lineitem GROUP BY 1, 2"


@query(
    f"""WITH d AS (SELECT k, t, round(b - p, 9) d FROM ({_ERRORS}) WHERE b IS NOT NULL AND p IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC, t) r FROM d)
    SELECT k AS tissue, max(t) FILTER (r = 1) AS driver, round(max(d) FILTER (r = 1), 8) AS driver_delta, round(median(d) FILTER (r > 1), 8) AS rest_median FROM r GROUP BY 1"""
)
def bias_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "tissue", "l_linenumber": "kind"})
    errors = lambda flag: rows.where(F.col("l_returnflag") == flag).groupBy("tissue", "kind").agg(F.avg("l_discount").alias("rmse"))
    return V.bias_drivers(errors("R"), errors("N"), ["tissue"], "kind", "rmse").select("tissue", "driver", F.round("driver_delta", 8).alias("driver_delta"), F.round("rest_median", 8).alias("rest_median"))


@query("WITH d AS (SELECT l_suppkey k, l_linenumber x, avg(l_quantity) y FROM lineitem WHERE l_linenumber <= 1 + l_suppkey % 7 GROUP BY 1, 2) SELECT k AS method, CASE WHEN max(x) > min(x) THEN round((arg_max(y, x) - arg_min(y, x)) / (max(x) - min(x)), 6) END AS slope FROM d GROUP BY 1")
def dose_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").where("l_linenumber <= 1 + l_suppkey % 7").groupBy(F.col("l_suppkey").alias("method"), F.col("l_linenumber").alias("dose")).agg(F.avg("l_quantity").alias("y"))
    return V.dose_slope(rows, ["method"], "dose", "y").withColumn("slope", F.round("slope", 6))


@query("WITH s AS (SELECT l_partkey g, l_returnflag s, count(*) n, covar_pop(l_linenumber, l_quantity) c, var_pop(l_linenumber) v FROM lineitem GROUP BY 1, 2) SELECT g AS gene, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n * v) > 1e-9 THEN round(sum(n * c) / sum(n * v), 5) ELSE 0 END AS slope FROM s GROUP BY 1")
def adjusted_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "gene")
    return V.adjusted_slope(rows, ["gene"], "l_returnflag", "l_linenumber", "l_quantity").withColumn("slope", F.round("slope", 5))


@query(
    f"""WITH p AS (SELECT l_suppkey % 5 kind, l_linenumber sample, l_partkey gene, sum(l_quantity) truth, coalesce(sum(l_extendedprice) FILTER (l_returnflag <> 'A'), 0) estimate FROM lineitem WHERE l_suppkey % 5 > 0 OR l_partkey % 40 = 0 GROUP BY 1, 2, 3),
    w AS (SELECT kind, gene, sum(truth) truth, round(sum(estimate), 2) estimate FROM p GROUP BY 1, 2), t AS (SELECT kind, sample FROM (SELECT kind, sample, sum(truth) s, sum(sum(truth)) OVER (PARTITION BY sample) a FROM p GROUP BY 1, 2) WHERE s >= 0.02 * a),
    o AS (SELECT p.*, p.kind * 100 + p.sample ks FROM p JOIN t USING (kind, sample)), os AS ({_spearman('o', 'ks', 'truth', 'estimate')}), ol AS (SELECT ks, corr(ln(1 + truth), ln(1 + estimate)) l FROM o GROUP BY 1),
    ps AS (SELECT ks // 100 kind, median(rho) a, median(l) b, count(*) c FROM os JOIN ol USING (ks) GROUP BY 1), ws AS ({_spearman('w', 'kind', 'truth', 'estimate')}), wl AS (SELECT kind, corr(ln(1 + truth), ln(1 + estimate)) l FROM w GROUP BY 1)
    SELECT ws.kind, ws.n AS n_genes, round(rho, 6) AS agg_spearman, round(l, 6) AS agg_logpearson, round(a, 6) AS ps_spearman, round(b, 6) AS ps_logpearson, coalesce(c, 0) AS n_samples FROM ws JOIN wl USING (kind) LEFT JOIN ps USING (kind)"""
)
def expression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").withColumn("kind", F.col("l_suppkey") % 5).where("kind > 0 or l_partkey % 40 = 0")
    profiles = rows.groupBy("kind", F.col("l_linenumber").alias("sample"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("truth"), F.round(F.sum(F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice"))), 2).alias("estimate"))
    out = V.expression_scores(profiles, "kind", "sample")
    return out.select("kind", "n_genes", *[F.round(c, 6).alias(c) for c in ("agg_spearman", "agg_logpearson", "ps_spearman", "ps_logpearson")], "n_samples")


_EDGES = f"""o AS (SELECT l_suppkey tf, l_partkey g, l_partkey // 3 t, avg(l_discount) - 0.05 d, avg(l_tax) * 100 - 4 z FROM lineitem GROUP BY 1, 2), c AS (SELECT tf, count(*) FILTER (abs(z) >= 2) >= 8 o FROM o GROUP BY 1), u AS (SELECT o.* FROM o JOIN c USING (tf) WHERE NOT c.o OR abs(z) >= 2),
    a AS (SELECT tf, t, round(avg(d), 9) x FROM u GROUP BY 1, 2), b AS (SELECT l_suppkey tf, l_partkey // 3 t, round(avg(l_quantity), 9) y FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2), j AS (SELECT a.tf, x, y FROM a JOIN b USING (tf, t)), s AS ({_spearman('j', 'tf', 'x', 'y')})"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem")
    ours = rows.groupBy(F.col("l_suppkey").alias("tf"), F.col("l_partkey").alias("target")).agg((F.avg("l_discount") - 0.05).alias("delta"), (F.avg("l_tax") * 100 - 4).alias("z"))
    third = F.floor(F.col("l_partkey") / 3)
    theirs = rows.where("l_returnflag <> 'A'").groupBy(F.col("l_suppkey").alias("tf"), third.alias("target")).agg(F.avg("l_quantity").alias("delta"))
    orthologs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.floor(F.col("p_partkey") / 3).alias("target"))
    return V.conserved_edges(ours, theirs, orthologs)


@query(f"WITH {_EDGES} SELECT tf, n AS n_shared, round(rho, 6) AS rho FROM s WHERE n >= 8")
def conserved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).withColumn("rho", F.round("rho", 6))


@query(f"WITH {_EDGES} SELECT tf % 7 AS cell_type, count(*) AS n_tf, round(median(rho), 6) AS median_rho, avg(CAST(rho > 0 AS INTEGER)) AS share_positive, avg(CAST(rho >= 0.3 AS INTEGER)) AS share_conserved FROM s WHERE n >= 8 AND rho IS NOT NULL GROUP BY 1")
def network_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.conservation(_edges(spark, sf_dir).withColumn("cell_type", F.col("tf") % 7), ["cell_type"]).withColumn("median_rho", F.round("median_rho", 6))


@query(
    """WITH v AS (SELECT vec_id k, label l, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), d AS (SELECT a.k, a.l, b.l c, sum(1 - list_cosine_similarity(a.e, b.e)) s, count(*) n FROM v a JOIN v b ON a.k <> b.k GROUP BY 1, 2, 3),
    m AS (SELECT k, l, max(s / n) FILTER (c = l) a, min(s / n) FILTER (c <> l) b FROM d GROUP BY 1, 2) SELECT k AS vec_id, l AS label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM m"""
)
def cosine_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cosine_silhouette(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").withColumn("silhouette", F.round("silhouette", 6))


@query(
    """WITH t AS (SELECT o_custkey % 5 a, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 ELSE o_orderkey % 4 END b, count(*) n FROM orders GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) v FROM t), a AS (SELECT sum(s * (s - 1) / 2) v, sum(s) n FROM (SELECT sum(n) s FROM t GROUP BY a)), b AS (SELECT sum(s * (s - 1) / 2) v FROM (SELECT sum(n) s FROM t GROUP BY b))
    SELECT CAST(a.n AS BIGINT) AS n, round((x.v - a.v * b.v / (a.n * (a.n - 1) / 2)) / ((a.v + b.v) / 2 - a.v * b.v / (a.n * (a.n - 1) / 2)), 8) AS ari FROM x, a, b"""
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 5).otherwise(F.col("o_orderkey") % 4)
    return V.adjusted_rand(_t(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("a"), b.alias("b")), "a", "b").withColumn("ari", F.round("ari", 8))


@query(
    """WITH d AS (SELECT l_suppkey k, round(l_discount - l_tax, 9) d FROM lineitem), r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2.0 r, count(*) OVER (PARTITION BY k, abs(d)) t FROM d WHERE d <> 0)
    SELECT k AS tissue, count(*) AS n, sum(r) FILTER (d > 0) AS w_plus, round((sum(r) FILTER (d > 0) - count(*) * (count(*) + 1) / 4) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24 - sum(t * t - 1) / 48), 6) AS z FROM r GROUP BY 1"""
)
def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.signed_rank(_t(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "tissue"), ["tissue"], "l_discount", "l_tax").withColumn("z", F.round("z", 6))


_P = "pow(((p_partkey * 7919) % 1999 + 1) / 2000, 4)"


@query(
    f"""WITH t AS (SELECT p_partkey g, p_size s, p_brand b, {_P} p FROM part), f AS (SELECT 'all tests' n, * FROM t UNION ALL SELECT 'large', * FROM t WHERE s >= 10 UNION ALL SELECT 'no brand 3', * FROM t WHERE b <> 'Brand#3'),
    r AS (SELECT *, p * count(*) OVER (PARTITION BY n) / count(*) OVER (PARTITION BY n ORDER BY p) q FROM f), a AS (SELECT n, g, least(1, min(q) OVER (PARTITION BY n ORDER BY p DESC)) q FROM r)
    SELECT a.n AS scenario, count(*) AS n_tests, count(*) FILTER (a.q < 0.05) AS n_sig, count(*) FILTER (a.q < 0.05 AND o.q >= 0.05) AS gained, count(*) FILTER (a.q >= 0.05 AND o.q < 0.05) AS lost FROM a JOIN a o ON o.n = 'all tests' AND o.g = a.g GROUP BY 1"""
)
def fdr_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _t(spark, sf_dir, "part").withColumn("p", F.pow(((F.col("p_partkey") * 7919) % 1999 + 1) / 2000, F.lit(4)))
    return V.scenario_flips(tests, "p", {"all tests": F.lit(True), "large": F.col("p_size") >= 10, "no brand 3": F.col("p_brand") != "Brand#3"})


@query(
    f"""WITH f AS (SELECT l_suppkey k, l_discount a, round(l_discount + l_tax * (l_suppkey % 5) / 8, 6) b, l_quantity / 400 p, (l_quantity + (l_suppkey % 3) * (l_linenumber % 2)) / 400 q FROM lineitem), s AS ({_spearman('f', 'k', 'a', 'b')}), c AS (SELECT k, count(*) FILTER (p < 0.05) nb, count(*) FILTER (q < 0.05) nc, count(*) FILTER (p < 0.05 AND q < 0.05) nn FROM f GROUP BY 1)
    SELECT k AS block, nb AS n_base, nc AS n_cov, nn AS n_both, round(nn / nb, 6) AS retain, round(rho, 6) AS rho, CASE WHEN round(rho, 9) >= 0.9 AND coalesce(nn / nullif(nb, 0) >= 0.8, true) THEN 'ROBUST' ELSE 'CHECK' END AS verdict FROM s JOIN c USING (k)"""
)
def covariate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("l_suppkey"), F.col("l_quantity")
    fits = _t(spark, sf_dir, "lineitem").select(k.alias("block"), F.col("l_discount").alias("t_base"), F.round(F.col("l_discount") + F.col("l_tax") * (k % 5) / 8, 6).alias("t_cov"), (q / 400).alias("p_base"), ((q + (k % 3) * (F.col("l_linenumber") % 2)) / 400).alias("p_cov"))
    return V.covariate_verdict(fits, ["block"]).withColumn("retain", F.round("retain", 6)).withColumn("rho", F.round("rho", 6))


@query(
    """WITH s AS (SELECT l_suppkey k, l_partkey g, round(avg(l_discount) - 0.05, 6) v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, g) r FROM s), b AS (SELECT DISTINCT p_brand n FROM part),
    x AS (SELECT r.k, r.r, b.n, abs(v) w, p.p_partkey IS NOT NULL h FROM r, b LEFT JOIN part p ON p.p_partkey = r.g AND p.p_brand = b.n), t AS (SELECT k, n, count(*) FILTER (h) m, count(*) a, sum(w) FILTER (h) w FROM x GROUP BY 1, 2),
    c AS (SELECT x.k, x.n, t.m, sum(CASE WHEN h THEN x.w / t.w ELSE -1.0 / (t.a - t.m) END) OVER (PARTITION BY x.k, x.n ORDER BY r) e FROM x JOIN t ON t.k = x.k AND t.n = x.n WHERE t.m > 0 AND t.w > 0)
    SELECT k AS block, n AS name, m AS size, round(CASE WHEN round(max(e), 9) >= -round(min(e), 9) THEN round(max(e), 9) ELSE round(min(e), 9) END, 6) AS es FROM c GROUP BY 1, 2, 3"""
)
def gene_set_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("block"), F.col("l_partkey").alias("gene")).agg(F.round(F.avg("l_discount") - 0.05, 6).alias("stat"))
    sets = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("gene"))
    return V.enrichment_score(stats, sets, ["block"]).where("es is not null").withColumn("es", F.round("es", 6))


@query(
    """WITH v AS (SELECT vec_id k, CAST(embedding AS DOUBLE[]) e, label l FROM embeddings), n AS (SELECT k, lead(k) OVER (PARTITION BY l ORDER BY k) b FROM v), p AS (SELECT k a, b, 1 r FROM n WHERE b IS NOT NULL UNION ALL SELECT k, k + 100, 0 FROM v),
    c AS (SELECT r, round(list_cosine_similarity(x.e, y.e), 9) c FROM p JOIN v x ON x.k = p.a JOIN v y ON y.k = p.b), q AS (SELECT *, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 rk FROM c)
    SELECT count(*) FILTER (r = 1) AS n_pos, count(*) FILTER (r = 0) AS n_neg, round(avg(c) FILTER (r = 1), 6) AS mean_real, round(avg(c) FILTER (r = 0), 6) AS mean_null, round((sum(rk) FILTER (r = 1) - count(*) FILTER (r = 1) * (count(*) FILTER (r = 1) + 1) / 2) / (count(*) FILTER (r = 1) * count(*) FILTER (r = 0)), 6) AS auc FROM q"""
)
def homolog_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings")
    real = rows.select(F.col("vec_id").alias("a"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("b")).where("b is not null")
    null = rows.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 100).alias("b"))
    out = V.paired_auc(rows.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), real, null)
    return out.select("n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in ("mean_real", "mean_null", "auc")])


@query("WITH v(p, z) AS (VALUES (0.001, 3.290526731), (0.01, 2.575829304), (0.05, 1.959963985), (0.2, 1.281551566), (0.5, 0.674489750), (1.0, 0.0)) SELECT l_orderkey, l_linenumber, round(sign(l_discount - 0.05) * z, 6) + 0.0 AS z FROM lineitem JOIN v ON p = ([0.001, 0.01, 0.05, 0.2, 0.5, 1.0])[l_orderkey % 6 + 1]")
def signed_z_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.element_at(F.array(*[F.lit(v) for v in (0.001, 0.01, 0.05, 0.2, 0.5, 1.0)]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.round(V.signed_z(p, F.col("l_discount") - 0.05), 6) + 0.0).alias("z"))
