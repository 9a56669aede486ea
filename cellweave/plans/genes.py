"""Registered queries on identifiers, ortholog tiers, value checks, tokens and edges, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import labels as L
from ..operators import expression as E
from ..operators import orthologs as O
from ..operators import regulation as R
from ..operators import scoring as S
from ..sources.folders import new_folder
from .registry import _COUNTS, _MEDIANS, _RANKED, _counts, _ranked, _t, query

# Names that meet every identifier rule: what stands before and after the part's key, and the key's least width.
_FORMS = (
    ("ENSRNOG", 11, ""), ("ensrnog", 11, ".2"), ("ENSG", 11, ""), ("ENSMUSG", 11, ""), ("RGD", 1, ""), ("NM_", 6, ".1"), ("XR_", 5, ""), ("LOC", 1, ""), ("RF", 5, ""),
    ("AABR", 8, ""), ("JACYVU", 8, ""), ("MU", 6, ""), ("AC", 6, ".3"), ("CM", 6, ""), ("chr1_", 1, ""), ("CHR2:", 1, "-9"), ("", 7, "_at"), ("U", 1, ""), ("Mt_", 1, ""),
    ("mt-Co", 1, ""), ("Apo", 1, ""), ("", 1, ""), ("ILMN_", 1, ""), (" Gm", 1, " "), ("X:", 1, "-77"), ("ENSRNOG", 11, "mt"),
)
_WIDE = "lpad(CAST(p_partkey AS VARCHAR), CAST(greatest({w}, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0')"
_NAMES = f"names AS (SELECT p_partkey, CASE p_partkey % {len(_FORMS)} " + " ".join(f"WHEN {i} THEN '{a}' || {_WIDE.format(w=w)} || '{b}'" for i, (a, w, b) in enumerate(_FORMS)) + " END name FROM part)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("p_partkey").cast("string")
    key = lambda w: F.lpad(text, F.greatest(F.lit(w), F.char_length(text)), F.lit("0"))
    made = ((F.col("p_partkey") % len(_FORMS) == i, F.concat(F.lit(a), key(w), F.lit(b))) for i, (a, w, b) in enumerate(_FORMS))
    return _t(spark, sf_dir, "part").select("p_partkey", I.ladder(made).alias("name"))


def _case(rules: tuple, column: str, fold: str = "(?i)") -> str:
    return " ".join(f"WHEN regexp_matches({column}, '{fold}{p}') THEN '{v}'" for p, v in rules)


@query(
    f"""WITH {_NAMES}, s AS (SELECT *, split_part(trim(name), '.', 1) s FROM names)
    SELECT p_partkey, name, upper(s) AS normalized, CASE {_case(I.NAMESPACES, "s")} WHEN regexp_matches(s, '^[A-Za-z]') AND length(s) BETWEEN 2 AND 30 THEN 'symbol' ELSE 'unknown' END AS namespace,
    CASE {_case(I.NON_GENES, "s")} END AS non_gene, regexp_matches(upper(s), '^ENSRNOG\\d{{11}}$') AS is_rat, regexp_matches(upper(s), '^ENSG\\d{{11}}$') AS is_human, regexp_matches(upper(s), '^ENSMUSG\\d{{11}}$') AS is_mouse,
    {" OR ".join(f"regexp_matches(name, '{'(?i)' if f else ''}{p}')" for p, f in I.REJECTED)} AS rejected, {" OR ".join(f"regexp_matches(name, '(?i){p}')" for p in I.MITO)} AS is_mito FROM s"""
)
def identifier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    species = [I.is_species(n, s).alias(f"is_{s}") for s in ("rat", "human", "mouse")]
    return _names(spark, sf_dir).select("p_partkey", "name", I.normalize_ensembl(n).alias("normalized"), I.namespace(n).alias("namespace"), I.non_gene(n).alias("non_gene"), *species, I.rejected(n).alias("rejected"), I.mitochondrial(n).alias("is_mito"))


_SPELLED = [(raw, canonical) for canonical, names in I.BIOTYPES.items() for raw in names]
_SPELLED += [("Protein family, coding", "protein_coding"), ("pre-miRNA host", "mirna"), ("micro noncoding RNA", "mirna"), ("long intergenic noncoding", "lncrna"), ("C/D snoRNA", "snorna"), ("U6 snRNA", "snrna"), ("5S rRNA", "rrna"), ("IG V Pseudogene", "pseudogene"), ("Some Thing-Else", "some_thing_else")]
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    f"""WITH b AS (SELECT p_partkey, {_LIST([r for r, _ in _SPELLED])}[p_partkey % {len(_SPELLED)} + 1] raw, {_LIST([c for _, c in _SPELLED])}[p_partkey % {len(_SPELLED)} + 1] biotype FROM part)
    SELECT p_partkey, raw, biotype, biotype IN ('protein_coding', 'lncrna', 'mirna') AS kept, CASE biotype WHEN 'lncrna' THEN 'lncRNA' WHEN 'mirna' THEN 'miRNA' ELSE biotype END AS output FROM b"""
)
def biotype_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(r) for r, _ in _SPELLED]), (F.col("p_partkey") % len(_SPELLED) + 1).cast("int"))
    out = _t(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return out.select("p_partkey", "raw", I.biotype(F.col("raw")).alias("biotype"), I.kept_biotype(F.col("raw"), ("protein_coding", "lncrna", "mirna")).alias("kept"), I.output_biotype(I.biotype(F.col("raw"))).alias("output"))


# Part is the rat genes; lineitem of few quantities gives candidates and links, supplier the vocabularies.
_TIERS = """c AS (SELECT l_partkey gene, l_suppkey target, l_linenumber % 2 side, CASE l_returnflag WHEN 'N' THEN 'ortholog_one2one' WHEN 'A' THEN 'ortholog_one2many' ELSE 'ortholog_many2many' END t,
      CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount * 1000) END perc, l_orderkey * 10 + l_linenumber pos FROM lineitem WHERE l_quantity > 44),
    h AS (SELECT *, target token FROM c WHERE side = 1 AND target % 4 <> 0), m AS (SELECT *, 1000000 + target token FROM c WHERE side = 0 AND target % 3 <> 0),
    links AS (SELECT DISTINCT l_suppkey mouse, l_partkey % (SELECT max(s_suppkey) + 1 FROM supplier) human FROM lineitem WHERE l_quantity = 1),
    t1 AS (SELECT h.gene, arg_min({'human': h.target, 'mouse': m.target, 'token': h.token, 'id': h.perc}, [h.pos, m.pos]) r FROM h JOIN m USING (gene) JOIN links ON links.mouse = m.target AND links.human = h.target WHERE h.t = 'ortholog_one2one' AND m.t = 'ortholog_one2one' GROUP BY 1),
    hb AS (SELECT gene, t = 'ortholog_one2one' one, arg_max({'target': target, 'token': token, 'id': perc}, [coalesce(perc, 0), -pos]) r FROM h GROUP BY 1, 2),
    mb AS (SELECT gene, t = 'ortholog_one2one' one, arg_max({'target': target, 'token': token, 'id': perc}, [coalesce(perc, 0), -pos]) r FROM m GROUP BY 1, 2),
    j AS (SELECT p_partkey gene, CASE p_partkey % 4 WHEN 0 THEN 'protein_coding' WHEN 1 THEN 'lncRNA' WHEN 2 THEN 'miRNA' ELSE 'pseudogene' END biotype, t1.r a, h1.r h1, m1.r m1, hn.r hn, mn.r mn FROM part LEFT JOIN t1 ON t1.gene = p_partkey
      LEFT JOIN hb h1 ON h1.gene = p_partkey AND h1.one LEFT JOIN mb m1 ON m1.gene = p_partkey AND m1.one LEFT JOIN hb hn ON hn.gene = p_partkey AND NOT hn.one LEFT JOIN mb mn ON mn.gene = p_partkey AND NOT mn.one),
    k AS (SELECT *, CASE WHEN a IS NOT NULL THEN 'T1_tri_species' WHEN h1 IS NOT NULL THEN 'T2a_human_one2one' WHEN m1 IS NOT NULL THEN 'T2b_mouse_one2one' WHEN hn IS NOT NULL THEN 'T3a_human_multi' WHEN mn IS NOT NULL THEN 'T3b_mouse_multi' WHEN gene % 4 < 3 THEN 'T4_new_token' ELSE 'excluded' END tier FROM j),
    tiers AS (SELECT 'R' || lpad(CAST(gene AS VARCHAR), 11, '0') gene, biotype, tier,
      CASE left(tier, 3) WHEN 'T1_' THEN a.human WHEN 'T2a' THEN h1.target WHEN 'T3a' THEN hn.target END human_ortholog, CASE left(tier, 3) WHEN 'T1_' THEN a.mouse WHEN 'T2a' THEN m1.target WHEN 'T2b' THEN m1.target WHEN 'T3b' THEN mn.target END mouse_ortholog,
      CASE left(tier, 3) WHEN 'T1_' THEN a.token WHEN 'T2a' THEN h1.token WHEN 'T2b' THEN m1.token END token, CASE left(tier, 3) WHEN 'T1_' THEN a.id WHEN 'T2a' THEN h1.id WHEN 'T2b' THEN m1.id WHEN 'T3a' THEN hn.id WHEN 'T3b' THEN mn.id END identity FROM k),
    mapped AS (SELECT * EXCLUDE (token), CASE WHEN left(tier, 2) IN ('T3', 'T4') THEN 2000000 + row_number() OVER (PARTITION BY left(tier, 2) IN ('T3', 'T4') ORDER BY gene) ELSE token END token_id FROM tiers)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    genes = _t(spark, sf_dir, "part").select(key.alias("gene"), I.ladder([(key % 4 == 0, F.lit("protein_coding")), (key % 4 == 1, F.lit("lncRNA")), (key % 4 == 2, F.lit("miRNA"))], F.lit("pseudogene")).alias("biotype"))
    lines = _t(spark, sf_dir, "lineitem")
    kind = I.ladder([(F.col("l_returnflag") == "N", F.lit(O.ONE)), (F.col("l_returnflag") == "A", F.lit(O.MANY[0]))], F.lit(O.MANY[1]))
    perc = F.when(F.col("l_tax") != 0, F.round(F.col("l_discount") * 1000))
    found = lines.where("l_quantity > 44").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("target"), (F.col("l_linenumber") % 2).alias("side"), kind.alias("orth_type"), perc.alias("perc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    vocabulary = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"))
    human = vocabulary.where("target % 4 <> 0").withColumn("token", F.col("target"))
    mouse = vocabulary.where("target % 3 <> 0").withColumn("token", F.col("target") + 1_000_000)
    suppliers = vocabulary.agg(F.max("target")).first()[0] or 0
    links = lines.where("l_quantity = 1").select(F.col("l_suppkey").alias("mouse"), (F.col("l_partkey") % (suppliers + 1)).alias("human"))
    out = O.tiers(genes, found.where("side = 1").drop("side"), found.where("side = 0").drop("side"), human, mouse, links)
    return O.with_new_tokens(out.withColumn("gene", F.concat(F.lit("R"), F.lpad(F.col("gene").cast("string"), 11, "0"))), after=2_000_000, prefix=9)


@query(
    f"""WITH {_TIERS}, s AS (SELECT *, CASE WHEN token_id IS NULL THEN 0 WHEN left(tier, 2) IN ('T3', 'T4') THEN 1 ELSE count(*) OVER (PARTITION BY token_id) END c FROM mapped)
    SELECT gene, biotype, tier, token_id, human_ortholog, mouse_ortholog, identity, c AS collisions, CASE WHEN tier = 'excluded' THEN NULL WHEN left(tier, 2) IN ('T1', 'T2') AND biotype = 'protein_coding' AND c <= 1 AND identity >= 70 THEN 'high' WHEN left(tier, 2) IN ('T1', 'T2') THEN 'medium'
      WHEN left(tier, 2) = 'T3' AND c <= 2 AND identity >= 40 AND lower(biotype) NOT IN ('lncrna', 'mirna') THEN 'medium' ELSE 'low' END AS confidence FROM s"""
)
def ortholog_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_confidence(_mapped(spark, sf_dir)).select("gene", "biotype", "tier", "token_id", "human_ortholog", "mouse_ortholog", "identity", "collisions", "confidence")


@query(f"WITH {_TIERS} SELECT tier, biotype, count(*) AS n_genes, count(token_id) AS n_tokens, round(avg(identity), 6) AS mean_identity FROM mapped GROUP BY 1, 2")
def tier_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).groupBy("tier", "biotype").agg(F.count(F.lit(1)).alias("n_genes"), F.count("token_id").alias("n_tokens"), F.round(F.avg("identity"), 6).alias("mean_identity"))


@query(f"WITH {_TIERS}, s AS (SELECT token_id, count(*) c FROM mapped WHERE token_id IS NOT NULL AND left(tier, 2) IN ('T1', 'T2') GROUP BY 1) SELECT tier, lower(biotype) AS biotype, count(*) AS n_genes, count(DISTINCT token_id) AS n_distinct FROM mapped GROUP BY 1, 2")
def tier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).groupBy("tier", F.lower("biotype").alias("biotype")).agg(F.count(F.lit(1)).alias("n_genes"), F.count_distinct("token_id").alias("n_distinct"))


@query(f"WITH {_TIERS} SELECT token_id, count(*) AS n_genes, string_agg(gene, ';' ORDER BY gene) AS genes FROM mapped WHERE left(tier, 2) IN ('T1', 'T2') GROUP BY 1 HAVING count(*) > 1")
def token_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.collision_report(_mapped(spark, sf_dir))


@query(
    f"""WITH {_COUNTS}, s AS (SELECT gene, count(*) FILTER (count > 0) n, sum(count) t FROM counts WHERE gene % 9 <> 0 GROUP BY 1)
    SELECT p_partkey AS gene, n AS n_nonzero, t AS total, CASE WHEN n IS NULL THEN 'not_in_expression_stats' WHEN n < 25 THEN 'below_min_cells_' || n || '<25' WHEN t < 700 THEN 'below_min_counts_' || CAST(round(t) AS BIGINT) || '<700' END AS reason FROM part LEFT JOIN s ON gene = p_partkey WHERE p_partkey % 7 <> 0"""
)
def universe_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = _t(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("gene"))
    return O.prune(universe, E.gene_stats(_counts(spark, sf_dir).where("gene % 9 <> 0")), 25, 700.0)


@query("SELECT l_partkey AS gene, sum(l_quantity) AS total FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) GROUP BY 1")
def universe_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = _t(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("gene"))
    return O.orphans(universe, E.gene_stats(_counts(spark, sf_dir))).select("gene", "total")


@query(f"WITH {_COUNTS}, {_MEDIANS} SELECT p_partkey AS gene, p_size AS token_id, median FROM part JOIN medians ON gene = p_partkey WHERE p_partkey % 3 <> 1 AND median > 0")
def token_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _t(spark, sf_dir, "part").where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("token_id"))
    return O.eligible_tokens(tokens, E.gene_quantiles(_counts(spark, sf_dir)))


@query("SELECT DISTINCT l_partkey AS id, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS in_universe, l_partkey IN (SELECT c_custkey FROM customer) AS in_vocabulary, l_partkey IN (SELECT l_suppkey FROM lineitem) AS in_bulk FROM lineitem")
def id_space_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    spaces = {"universe": _t(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id")), "vocabulary": _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "bulk": lines.select(F.col("l_suppkey").alias("id"))}
    return O.id_spaces(lines.select(F.col("l_partkey").alias("id")).distinct(), spaces)


# Values by kind of matrix: whole counts, logs, large and other, by order.
_VALUES = "v AS (SELECT l_orderkey % 40 m, l_orderkey cell, l_partkey gene, CASE l_orderkey % 40 % 5 WHEN 0 THEN l_quantity WHEN 1 THEN ln(1 + l_quantity / 5) WHEN 2 THEN l_extendedprice * 20.5 WHEN 3 THEN 0 ELSE l_quantity * 1.25 + 1 END x FROM lineitem)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("l_orderkey") % 40
    x = I.ladder([(m % 5 == 0, F.col("l_quantity")), (m % 5 == 1, F.log(1 + F.col("l_quantity") / 5)), (m % 5 == 2, F.col("l_extendedprice") * 20.5), (m % 5 == 3, F.lit(0.0))], F.col("l_quantity") * 1.25 + 1)
    return _t(spark, sf_dir, "lineitem").select(m.alias("m"), F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"), x.alias("x"))


@query(f"WITH {_VALUES}, a AS (SELECT m, bool_and(abs(x - round(x)) <= 0.000001) FILTER (x <> 0) w, min(x) FILTER (x > 0) lo, max(x) FILTER (x <> 0) hi FROM v GROUP BY 1) SELECT m AS matrix, CASE WHEN hi IS NULL THEN 'all_zeros' WHEN w THEN 'counts' WHEN hi < 20 AND lo < 1 THEN 'log' WHEN hi > 1000000 THEN 'tpm' ELSE 'other' END AS kind, w IS NULL OR w AS is_raw FROM a")
def raw_count_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    out = _values(spark, sf_dir).groupBy(F.col("m").alias("matrix")).agg(F.bool_and(F.when(x != 0, F.abs(x - F.round(x)) <= 1e-6)).alias("w"), F.min(F.when(x > 0, x)).alias("lo"), F.max(F.when(x != 0, x)).alias("hi"))
    return out.select("matrix", L.value_kind(F.col("w"), F.col("lo"), F.col("hi")).alias("kind"), F.coalesce("w", F.lit(True)).alias("is_raw"))


@query(
    f"""WITH {_VALUES}, t AS (SELECT m, max(x) hi FROM v GROUP BY 1), e AS (SELECT m, cell, gene, x, CASE WHEN hi < 20 THEN exp(x) - 1 ELSE x END y FROM v JOIN t USING (m)), l AS (SELECT m, cell, min(y) FILTER (y > 0) lo FROM e GROUP BY 1, 2)
    SELECT m AS matrix, cell, count(*) AS n_genes, CAST(sum(coalesce(floor(y / lo + 0.0000001), 0)) AS BIGINT) AS total FROM e JOIN l USING (m, cell) GROUP BY 1, 2"""
)
def reverse_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.reverse_normalize(_values(spark, sf_dir).withColumnRenamed("m", "matrix"), "matrix", "x")
    return out.groupBy("matrix", "cell").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("count").alias("total"))


@query(f"WITH {_COUNTS}, l AS (SELECT cell, sum(count) s FROM counts GROUP BY 1) SELECT cell, gene, round(log2(1 + 1000000 * count / s), 6) AS log2_cpm, round(ln(1 + count), 6) AS log1p FROM counts JOIN l USING (cell)")
def log_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.normalize_total(_counts(spark, sf_dir), 1_000_000.0)
    return out.select("cell", "gene", F.round(F.log2(1 + F.col("value")), 6).alias("log2_cpm"), F.round(F.log1p("count"), 6).alias("log1p"))


@query("WITH m AS (SELECT l_suppkey, avg(l_extendedprice) m, stddev_pop(l_extendedprice) s FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_suppkey, round(greatest(-2, least(2, CASE WHEN s > 1e-12 THEN (l_extendedprice - m) / s ELSE 0 END)), 6) AS z FROM lineitem JOIN m USING (l_suppkey)")
def block_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return S.scaled(rows, ["l_suppkey"], "l_extendedprice", 2.0).select("l_orderkey", "l_linenumber", "l_suppkey", F.round("z", 6).alias("z"))


@query("SELECT l_suppkey, count(*) AS n, list_sort(list(l_extendedprice))[count(*) // 4 + 1] AS q1, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS q2, list_sort(list(l_extendedprice))[3 * count(*) // 4 + 1] AS q3 FROM lineitem GROUP BY 1")
def index_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_quartiles(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS shift FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    out = both.withColumn("c", L.cosine(F.col("embedding"), F.col("other")))
    return out.select("vec_id", F.round("c", 6).alias("cosine"), F.round(1 - F.col("c"), 6).alias("shift"))


_TOKENS = f"{_COUNTS}, {_MEDIANS}, {_RANKED}, tokens AS (SELECT ranked.*, o_custkey % 20 grp FROM ranked JOIN orders ON o_orderkey = cell)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), (F.col("o_custkey") % 20).alias("grp"))
    return _ranked(spark, sf_dir, 2048).join(cells, "cell").select("grp", "cell", F.col("gene").alias("token"), "value", "rank")


@query(f"WITH {_TOKENS}, n AS (SELECT grp, count(DISTINCT cell) n FROM tokens GROUP BY 1), s AS (SELECT grp, gene token, sum(v) / n bulk, avg(v) mp FROM tokens JOIN n USING (grp) WHERE gene <> 0 GROUP BY grp, gene, n), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(bulk, 9) DESC, token) r FROM s) SELECT grp, token, round(bulk, 6) AS bulk, round(mp, 6) AS mean_present, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 2048")
def pseudobulk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pseudobulk(_tokens(spark, sf_dir), ["grp"]).select("grp", "token", F.round("bulk", 6).alias("bulk"), F.round("mean_present", 6).alias("mean_present"), "rank")


@query(f"WITH {_TOKENS} SELECT grp, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90 FROM tokens WHERE v > 0 GROUP BY 1")
def token_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).where("value > 0").groupBy("grp").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@query(
    f"""WITH {_COUNTS}, {_MEDIANS}, {_RANKED}, f AS (SELECT cell, min(gene) token, count(*) n FROM ranked GROUP BY 1)
    SELECT cell, token, coalesce(string_agg(CAST(gene AS VARCHAR), ',' ORDER BY r) FILTER (gene <> token) || ',', '') || '0' AS deleted, string_agg(CASE WHEN gene = token THEN '9.0' ELSE CAST(round(v, 2) AS VARCHAR) END, ',' ORDER BY r) AS overexpressed FROM ranked JOIN f USING (cell) GROUP BY cell, token"""
)
def perturbed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir, 2048).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("rank", "gene", F.round("value", 2).alias("value")))).alias("t"), F.min("gene").alias("token"))
    rows = rows.select("cell", "token", F.col("t.gene").alias("ids"), F.col("t.value").alias("values"))
    ids, _ = R.delete_token(F.col("ids"), F.col("values"), F.col("token"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("cell", "token", text(ids).alias("deleted"), text(R.overexpress_token(F.col("ids"), F.col("values"), F.col("token"), F.lit(9.0))).alias("overexpressed"))


_EDGES = "s AS (SELECT l_suppkey tf, l_orderkey % 50 cell, l_partkey % 300 target, l_discount - 0.05 + l_quantity / 10000 shift FROM lineitem), n AS (SELECT tf, count(DISTINCT cell) n FROM s GROUP BY 1), e AS (SELECT tf, target, avg(shift) delta, count(*) support FROM s JOIN n USING (tf) GROUP BY tf, target, n HAVING count(*) >= greatest(3, 0.1 * n))"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    return R.aggregate_edges(lines.select(F.col("l_suppkey").alias("tf"), (F.col("l_orderkey") % 50).alias("cell"), (F.col("l_partkey") % 300).alias("target"), (F.col("l_discount") - 0.05 + F.col("l_quantity") / 10000).alias("shift")), 3, 0.1)


@query(f"WITH {_EDGES} SELECT tf, target, round(round(delta, 9), 6) AS delta, support FROM e")
def edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("tf", "target", F.round(F.round("delta", 9), 6).alias("delta"), "support")


@query(f"WITH {_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY abs(round(delta, 9)) DESC, target) r FROM e) SELECT tf, target, round(delta, 6) AS delta, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 10")
def edge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_edges(_edges(spark, sf_dir), 10).select("tf", "target", F.round("delta", 6).alias("delta"), "rank")


@query("SELECT l_partkey AS gene, arg_max(l_discount - 0.05, [abs(l_discount - 0.05), -(l_orderkey * 10 + l_linenumber)]) AS stat FROM lineitem GROUP BY 1")
def strongest_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), (F.col("l_discount") - 0.05).alias("stat"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return R.strongest(rows, "gene", "stat", "pos")


@query("WITH a AS (SELECT l_suppkey k, sum(l_quantity) v FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 3 <> 0 GROUP BY 1), b AS (SELECT l_suppkey k, sum(l_quantity) v FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 4 <> 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, 0) - coalesce(b.v, 0) AS delta, a.k IS NOT NULL AND b.k IS NOT NULL AS in_both FROM a FULL JOIN b ON a.k = b.k")
def differential_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = lambda n, m: _t(spark, sf_dir, "lineitem").where(f"l_linenumber = {n} AND l_suppkey % {m} <> 0").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return R.difference(sums(1, 3), sums(2, 4), ["k"], "v")


@query(
    """WITH g AS (SELECT l_partkey gene, avg(l_quantity) v, avg(l_discount) s FROM lineitem GROUP BY 1), f AS (SELECT * FROM g WHERE gene % 50 = 7)
    SELECT f.gene AS focal, count(*) AS n_matched, round(100 * avg(CASE WHEN g.s < f.s THEN 1.0 ELSE 0.0 END), 6) AS percentile FROM f JOIN g ON abs(g.v - f.v) < 0.15 * f.v AND g.gene <> f.gene GROUP BY 1"""
)
def matched_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts are summed in the order of the table's rows, so that genes tie as in the SQL read in order, however the table is split among tasks."""
    rows = _t(spark, sf_dir, "lineitem")
    file = F.array_position(F.lit(sorted(rows.select("_metadata.file_path").distinct().toPandas()["file_path"])), F.col("_metadata.file_path"))
    placed = rows.select(F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("q"), F.when(F.col("l_discount").isNotNull(), F.struct(file.cast("int").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("l_discount").alias("d"))).alias("s"))
    lists = placed.groupBy("gene").agg(F.avg("q").alias("value"), F.array_sort(F.collect_list("s")).alias("s"))
    path = new_folder(spark, "genes")  # read several times, made once
    lists.select("gene", "value", F.try_divide(F.aggregate("s", F.lit(0.0), lambda t, x: t + x["d"]), F.size("s")).alias("shift")).write.parquet(path)
    genes = spark.read.parquet(path)
    return R.matched_null(genes, genes.where("gene % 50 = 7")).withColumn("percentile", F.round("percentile", 6))


def _int(c: Column) -> Column:
    return c.cast("int")


@query(
    """WITH t AS (SELECT o_orderkey k, CAST(o_orderkey % 6 AS INTEGER) m, CAST(o_orderkey % 9 AS INTEGER) n, (o_orderkey % 97 + 1) / 100 p FROM orders), c AS (SELECT n, unnest(range(0, n + 1)) i FROM range(0, 9) r(n)), w AS (SELECT n, i, factorial(CAST(n AS INTEGER)) / factorial(CAST(i AS INTEGER)) / factorial(CAST(n - i AS INTEGER)) w FROM c)
    SELECT k, CASE WHEN t.n > 0 THEN round(round(coalesce(sum(CAST(w AS DOUBLE) * p ** i * (1 - p) ** (t.n - i)) FILTER (i >= m), 0), 9), 6) END AS p_upper FROM t JOIN w USING (n) GROUP BY k, t.n"""
)
def binomial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tail = S.binomial_tail(_int(k % 6), _int(k % 9), (k % 97 + 1) / F.lit(100))
    return _t(spark, sf_dir, "orders").select(k.alias("k"), F.round(F.round(tail, 9), 6).alias("p_upper"))


@query(
    """WITH t AS (SELECT o_orderkey k, o_orderkey % 5 h, 20 + o_orderkey % 30 n, o_orderkey % 11 m, o_orderkey % 13 d FROM orders), f AS (SELECT i, coalesce(sum(ln(j)), 0) l FROM range(0, 60) a(i) LEFT JOIN range(1, 60) b(j) ON j <= i GROUP BY 1),
    x AS (SELECT t.*, unnest(range(greatest(h, d + m - n, 0), least(m, d) + 1)) i FROM t WHERE m > 0 AND d > 0),
    p AS (SELECT k, sum(exp((a.l - b.l - c.l) + (e.l - g.l - q.l) - (r.l - s.l - u.l))) v FROM x JOIN f a ON a.i = m JOIN f b ON b.i = x.i JOIN f c ON c.i = m - x.i JOIN f e ON e.i = n - m JOIN f g ON g.i = d - x.i JOIN f q ON q.i = n - m - d + x.i JOIN f r ON r.i = n JOIN f s ON s.i = d JOIN f u ON u.i = n - d GROUP BY 1)
    SELECT t.k, round(CASE WHEN m > 0 AND d > 0 THEN least(1, coalesce(v, 0)) ELSE 1 END, 6) AS p_upper FROM t LEFT JOIN p ON p.k = t.k"""
)
def hypergeometric_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tail = S.hypergeometric_tail(_int(k % 5), _int(20 + k % 30), _int(k % 11), _int(k % 13))
    return _t(spark, sf_dir, "orders").select(k.alias("k"), F.round(tail, 6).alias("p_upper"))
