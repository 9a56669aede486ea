"""Registered queries of ranked genes, background scores and permuted enrichment, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranked as K
from .registry import _counts, _t, query


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("cluster"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("cell", "gene", F.col("count").alias("value"))


_C = "c AS (SELECT l_orderkey cell, l_partkey gene, sum(l_quantity) v FROM lineitem GROUP BY 1, 2), k AS (SELECT o_orderkey cell, o_orderpriority cl FROM orders)"
#: U counts the pairs that a cluster's cells win and half of those that tie; pairs with zeros are counted by their numbers.
_U = f"""{_C}, s AS (SELECT cl, count(*) n FROM k GROUP BY 1), t AS (SELECT count(*) n FROM k), x AS (SELECT gene, cl, v, count(*) m FROM c JOIN k USING (cell) GROUP BY 1, 2, 3), z AS (SELECT gene, cl, sum(m) m FROM x GROUP BY 1, 2), g AS (SELECT gene, sum(m) m FROM x GROUP BY 1),
  p AS (SELECT a.gene, a.cl, sum(a.m * b.m * CASE WHEN a.v > b.v THEN 1 WHEN a.v = b.v THEN 0.5 ELSE 0 END) w FROM x a JOIN x b ON a.gene = b.gene AND a.cl <> b.cl GROUP BY 1, 2),
  u AS (SELECT z.cl, z.gene, s.n na, t.n - s.n nb, coalesce(p.w, 0) + z.m * (t.n - s.n - (g.m - z.m)) + 0.5 * (s.n - z.m) * (t.n - s.n - (g.m - z.m)) u FROM z JOIN s ON s.cl = z.cl JOIN g ON g.gene = z.gene LEFT JOIN p ON p.gene = z.gene AND p.cl = z.cl, t),
  r AS (SELECT cl, gene, u, (u - na * nb / 2.0) / sqrt(CAST(na AS DOUBLE) * nb * (na + nb + 1) / 12) z FROM u)"""


@query(f"WITH {_U} SELECT cl AS cluster, gene, CAST(u AS DOUBLE) AS u, round(z, 6) AS z FROM r")
def rank_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rank_genes(_values(spark, sf_dir), _cells(spark, sf_dir)).select("cluster", "gene", F.col("u").cast("double").alias("u"), F.round("z", 6).alias("z"))


@query(f"WITH {_U}, o AS (SELECT *, row_number() OVER (PARTITION BY cl ORDER BY round(z, 9) DESC, gene) n FROM r) SELECT cl AS cluster, CAST(n AS INTEGER) AS rank, gene FROM o WHERE n <= 10")
def top_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_genes(K.rank_genes(_values(spark, sf_dir), _cells(spark, sf_dir))).select("cluster", "rank", "gene")


@query(
    f"""WITH {_C}, n AS (SELECT count(*) n FROM k), s AS (SELECT gene, sum(v) s, sum(v * v) q FROM c GROUP BY 1), m AS (SELECT gene, round(ln(1 + s / n), 9) m, CASE WHEN (q - s * s / n) / (n - 1) > 1e-12 THEN round(ln((q - s * s / n) / (n - 1) / (s / n)), 9) END d FROM s, n),
    b AS (SELECT *, greatest(ceil(round((m - (SELECT min(m) FROM m)) / (SELECT max(m) - min(m) FROM m) * 20, 9)), 1) b FROM m), w AS (SELECT b, avg(d) a, stddev_samp(d) sd FROM b GROUP BY 1), o AS (SELECT gene, m, d, round(CASE WHEN d IS NULL THEN NULL WHEN sd IS NULL THEN 1 ELSE (d - a) / nullif(sd, 0) END, 9) x FROM b JOIN w USING (b))
    SELECT gene, round(m, 6) AS mean, round(d, 6) AS dispersion, round(x, 6) AS normalised, row_number() OVER (ORDER BY x DESC NULLS LAST, gene) <= 200 AND x IS NOT NULL AS selected FROM o"""
)
def variable_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.variable_genes(_values(spark, sf_dir), _cells(spark, sf_dir), n=200)
    return out.select("gene", *[F.round(c, 6).alias(c) for c in ("mean", "dispersion", "normalised")], "selected")


@query(
    f"""WITH {_C}, m AS (SELECT DISTINCT p_brand label, p_partkey gene FROM part WHERE p_size <= 10), n AS (SELECT cl, count(*) n FROM k GROUP BY 1), y AS (SELECT cl, gene, sum(v) s FROM c JOIN k USING (cell) GROUP BY 1, 2), t AS (SELECT gene, round(sum(s), 6) s FROM y GROUP BY 1),
    q AS (SELECT gene, floor(rank() OVER (ORDER BY s) / greatest(round((SELECT count(*) FROM t) / 24), 1)) cut FROM t), p AS (SELECT label, gene, cut, count(*) OVER (PARTITION BY label) k FROM m JOIN q USING (gene)), d AS (SELECT cut, gene FROM (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY md5('0|' || gene), gene) r FROM q) WHERE r <= 50),
    o AS (SELECT DISTINCT p.label, d.gene FROM p JOIN d USING (cut) WHERE p.k >= 3 AND NOT EXISTS (SELECT 1 FROM p x WHERE x.label = p.label AND x.gene = d.gene)), a AS (SELECT cl, label, sum(s) s FROM y JOIN p USING (gene) WHERE k >= 3 GROUP BY 1, 2), b AS (SELECT cl, label, sum(s) s FROM y JOIN o USING (gene) GROUP BY 1, 2),
    z AS (SELECT label, count(*) c FROM o GROUP BY 1), h AS (SELECT label, max(k) k FROM p GROUP BY 1)
    SELECT a.cl AS cluster, a.label, CAST(k AS BIGINT) AS n_markers, round((a.s / k - coalesce(b.s / c, 0)) / n.n, 6) AS score FROM a JOIN n ON n.cl = a.cl JOIN h ON h.label = a.label LEFT JOIN b ON b.cl = a.cl AND b.label = a.label LEFT JOIN z ON z.label = a.label"""
)
def background_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = _t(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("gene"))
    out = K.background_scores(_values(spark, sf_dir), markers, _cells(spark, sf_dir))
    return out.select("cluster", "label", F.col("n_markers").cast("long").alias("n_markers"), F.round("score", 6).alias("score"))


_ES = """x AS (SELECT *, count(*) OVER (PARTITION BY {o}) m, sum(w) OVER (PARTITION BY {o}) tw, row_number() OVER (PARTITION BY {o} ORDER BY r) i, sum(w) OVER (PARTITION BY {o} ORDER BY r) h FROM {t}),
  {n} AS (SELECT {o}, any_value(m) m, CASE WHEN round(max(h / nullif(tw, 0) - (r - i) / (n - m)), 9) >= -round(min((h - w) / nullif(tw, 0) - (r - i) / (n - m)), 9) THEN round(max(h / nullif(tw, 0) - (r - i) / (n - m)), 9) ELSE round(min((h - w) / nullif(tw, 0) - (r - i) / (n - m)), 9) END es FROM x GROUP BY {o})"""


@query(
    f"""WITH s AS (SELECT l_returnflag k, l_partkey g, round(avg(l_discount) - 0.05, 6) v FROM lineitem GROUP BY 1, 2), r AS (SELECT k, g, abs(v) w, row_number() OVER (PARTITION BY k ORDER BY v DESC, g) r, count(*) OVER (PARTITION BY k) n FROM s), j AS (SELECT k, p_brand b, r, w, n FROM r JOIN part ON p_partkey = g),
    {_ES.format(o='k, b', t='j', n='e')}, q AS (SELECT e.k, e.b, e.m, n, unnest(range(1, 21)) d FROM e JOIN (SELECT k, any_value(n) n FROM r GROUP BY 1) USING (k) WHERE m BETWEEN 15 AND 500), i AS (SELECT *, unnest(range(1, 2 * m + 9)) i FROM q),
    f AS (SELECT k, b, d, m, n, CAST('0x' || md5('0|' || b || '|' || d || '|' || i || '|' || k)[1:12] AS BIGINT) % n + 1 r, min(i) i FROM i GROUP BY ALL), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, b, d ORDER BY i) y FROM f) WHERE y <= m), y AS (SELECT l.k, l.b, l.d, l.r, l.n, w FROM l JOIN r ON r.k = l.k AND r.r = l.r),
    {_ES.format(o='k, b, d', t='y', n='u').replace('x AS', 'xx AS').replace('FROM x', 'FROM xx')} SELECT e.k AS block, e.b AS name, e.m AS size, round(e.es, 6) AS es, round(e.es / avg(abs(u.es)) FILTER (sign(u.es) = sign(e.es)), 5) AS nes, round((count(*) FILTER (sign(u.es) = sign(e.es) AND abs(u.es) >= abs(e.es)) + 1) / (count(*) FILTER (sign(u.es) = sign(e.es)) + 1), 9) AS p FROM e JOIN u ON u.k = e.k AND u.b = e.b GROUP BY e.k, e.b, e.m, e.es"""
)
def permuted_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("block"), F.col("l_partkey").alias("gene")).agg(F.round(F.avg("l_discount") - 0.05, 6).alias("stat"))
    sets = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("gene"))
    out = K.permuted_enrichment(stats, sets, ["block"], draws=20)
    return out.select("block", "name", "size", F.round("es", 6).alias("es"), F.round("nes", 5).alias("nes"), F.round("p", 9).alias("p"))


@query(
    """WITH s AS (SELECT l_returnflag k, l_partkey g, round(avg(l_discount) - 0.05, 6) v FROM lineitem GROUP BY 1, 2), e AS (SELECT k, p_brand b, CASE WHEN round(sum(v), 6) >= 0 THEN 1 ELSE -1 END es FROM s JOIN part ON p_partkey = g GROUP BY 1, 2),
    r AS (SELECT s.k, p_brand b, g, row_number() OVER (PARTITION BY s.k, p_brand ORDER BY -es * v, g) r FROM s JOIN part ON p_partkey = g JOIN e ON e.k = s.k AND e.b = p_brand WHERE sign(v) = es) SELECT k AS block, b AS name, string_agg(g, ',' ORDER BY r) AS edge FROM r WHERE r <= 20 GROUP BY 1, 2"""
)
def leading_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("block"), F.col("l_partkey").alias("gene")).agg(F.round(F.avg("l_discount") - 0.05, 6).alias("stat"))
    sets = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("gene"))
    scores = stats.join(sets, "gene").groupBy("block", "name").agg(F.when(F.round(F.sum("stat"), 6) >= 0, 1).otherwise(-1).alias("es"))
    return K.leading_edge(stats, sets, ["block"], scores)
