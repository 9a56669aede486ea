"""Registered queries of metadata: terms and their routes, JSON out of text, MAGE-TAB files, ids lifted to a release, with their SQL.

Terms are the first words of documents and the tables of names their most frequent words, so both vary with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import terms as T
from ..sources import magetab
from ..sources.folders import new_folder
from .registry import _t, query

_PATTERNS = [(r"^ch\w+\s", "marrow"), (r"ment$", "gland")]


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    words = _t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term")).groupBy("term").count()
    top = words.orderBy(F.desc("count"), "term").limit(200).withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), "term")))
    name = F.concat(F.lit("n"), (F.col("place") % 23).cast("string"))
    part = lambda a, b: top.where(F.col("place").between(a, b)).select("term", name.alias("name"), "place")
    return part(21, 80), part(81, 160), part(161, 200), part(1, 20).select("term")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1).alias("text"))


_NAMES = r"""c AS (SELECT term, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) term FROM documents) GROUP BY 1), k AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) place FROM c), m AS (SELECT term, place, 'n' || (place % 23) nm FROM k WHERE place <= 200),
  og AS (SELECT * FROM m WHERE place BETWEEN 21 AND 80), ti AS (SELECT * FROM m WHERE place BETWEEN 81 AND 160), ce AS (SELECT * FROM m WHERE place > 160), ex AS (SELECT * FROM m WHERE place <= 20),
  d AS (SELECT doc_id, source, regexp_extract(text, '^\s*(\S+\s+\S+)', 1) x FROM documents), t AS (SELECT DISTINCT x, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) q FROM d),
  f AS (SELECT t.*, q <> '' AND q NOT IN (SELECT term FROM ex) ok, regexp_matches(x, '^\p{Lu}[^\p{Lu}\s]*\p{Ll}[^\p{Lu}\s]*\s+\p{Ll}\p{L}*$') la, (SELECT nm FROM og WHERE term = q) o, (SELECT nm FROM ti WHERE term = q) ti, CASE WHEN regexp_matches(q, '^ch\w+\s') THEN 'marrow' WHEN regexp_matches(q, 'ment$') THEN 'gland' END p FROM t),
  oc AS (SELECT t.x, arg_min(nm, place) v FROM t JOIN og ON len(og.term) >= 6 AND contains(q, og.term) GROUP BY 1), tc AS (SELECT t.x, arg_min(nm, [-len(ti.term), place]) v FROM t JOIN ti ON contains(q, ti.term) GROUP BY 1), cc AS (SELECT t.x, arg_min(nm, place) v FROM t JOIN ce ON contains(q, ce.term) GROUP BY 1),
  z AS (SELECT f.x, CASE WHEN ok THEN coalesce(o, CASE WHEN f.ti IS NULL AND p IS NULL THEN coalesce(oc.v, CASE WHEN la THEN trim(f.x) END) END) END organism, CASE WHEN ok AND o IS NULL AND NOT la THEN coalesce(f.ti, p, tc.v, cc.v) END tissue FROM f LEFT JOIN oc ON oc.x = f.x LEFT JOIN tc ON tc.x = f.x LEFT JOIN cc ON cc.x = f.x)"""


@query(f"WITH {_NAMES} SELECT x AS text, organism, tissue FROM z")
def term_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.classify(_raw(spark, sf_dir), *_names(spark, sf_dir), _PATTERNS)


@query(
    f"""WITH {_NAMES}, e AS (SELECT source, doc_id % 3 > 0 f, organism o, tissue t FROM d JOIN z USING (x)) SELECT s.source AS key, coalesce((SELECT string_agg(DISTINCT CASE WHEN f OR t IS NULL THEN o END, ';' ORDER BY CASE WHEN f OR t IS NULL THEN o END) FROM e WHERE e.source = s.source), '') AS organisms,
    coalesce((SELECT string_agg(DISTINCT CASE WHEN NOT f OR o IS NULL THEN t END, ';' ORDER BY CASE WHEN NOT f OR o IS NULL THEN t END) FROM e WHERE e.source = s.source), '') AS tissues FROM (SELECT DISTINCT source FROM documents) s"""
)
def rerouted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    own = lambda keep: F.collect_set(F.when(keep, F.col("text")))
    rows = raw.groupBy(F.col("source").alias("key")).agg(own(F.col("doc_id") % 3 > 0).alias("organisms"), own(F.col("doc_id") % 3 == 0).alias("tissues"))
    out = T.rerouted(rows, T.classify(raw, *_names(spark, sf_dir), _PATTERNS))
    return out.select("key", F.array_join("organisms", ";").alias("organisms"), F.array_join("tissues", ";").alias("tissues"))


# A nested object that holds a brace and a quote in a string, between other text, cut at every length from its second character on.
@query(
    """WITH r AS (SELECT event_id k, '{"a": "x } ' || chr(92) || '" {", "e": "' || event_type || '", "v": [' || user_id || ', {"p": ' || props || '}], "t": "' || user_id || '"}' j FROM events), c AS (SELECT k, j, 2 + k % len(j) n FROM r), h AS (SELECT k, j[1:n] x FROM c)
    SELECT k, regexp_extract(x, '"e": "([a-z]*)', 1, 's') AS e, TRY_CAST(regexp_extract(x, '"v": .([0-9]+)', 1) AS BIGINT) AS v, regexp_extract(x, '"t": "([0-9]*)', 1) AS t FROM h WHERE regexp_matches(x, '"v": .[0-9]+$') OR regexp_matches(x, '"e": "[a-z]*.?,?$') OR regexp_matches(x, '"t": "[0-9]*.?$') OR regexp_matches(x, '"}$')"""
)
def repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events")
    part = [F.lit('{"a": "x } \\" {", "e": "'), F.col("event_type"), F.lit('", "v": ['), F.col("user_id").cast("string"), F.lit(', {"p": '), F.col("props"), F.lit('}], "t": "'), F.col("user_id").cast("string"), F.lit('"}')]
    rows = rows.select(F.col("event_id").alias("k"), F.concat(*part).alias("j")).withColumn("x", F.substring(F.col("j"), F.lit(1), (2 + F.col("k") % F.char_length("j")).cast("int")))
    whole = F.col("x") == F.col("j")
    fence = F.concat(F.lit("Here it is:\n```json\n"), "x", F.lit("\n```\nand } more"))
    told = F.when(F.col("k") % 3 == 0, fence).when(whole & (F.col("k") % 3 == 1), F.concat(F.lit("So: "), "x", F.lit(" {done}"))).otherwise(F.concat(F.lit("So: "), "x"))
    json = X.closed(X.first_object(told))
    out = rows.withColumn("_s", F.from_json(json, "e string, v array<string>, t string"))
    ends = lambda p: F.rlike("x", F.lit(p))
    told = ends(r'"v": \[[0-9]+$') | ends(r'"e": "[a-z]*"?,?$') | ends(r'"t": "[0-9]*"?$') | ends('"}$')
    return out.where(told).select("k", F.coalesce("_s.e", F.lit("")).alias("e"), F.get("_s.v", F.lit(0)).cast("long").alias("v"), F.coalesce("_s.t", F.lit("")).alias("t"))


_SEGMENTS = "c AS (SELECT c_nationkey k, c_custkey c, c_mktsegment m FROM customer)"


@query(f"WITH {_SEGMENTS} SELECT 'nation ' || k AS title, 'last ' || max(c) AS summary, string_agg(c, ',' ORDER BY c) FILTER (c % 5 = 0) AS pubmed, CASE WHEN k % 2 = 0 THEN '2020-01-' || k END AS submission_date FROM c GROUP BY k")
def investigation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions written one file a nation, with comments, fields without values and repeated fields."""
    path = new_folder(spark, "idf")
    c, k = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    field = lambda name, *v: F.concat_ws("\t", F.lit(name), *v)
    rows = _t(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").cast("long").alias("c"), F.posexplode(F.array(
        field("# comment", c), field("Investigation Title", F.concat(F.lit("nation "), k)), field("Study Description", F.concat(F.lit("last "), c)), field("Experiment Description", F.lit("")),
        F.when(F.col("c_custkey") % 5 == 0, field("PubMed ID", c, F.lit("x"))).otherwise(field("PubMed ID", F.lit("none"))), F.when(F.col("c_nationkey") % 2 == 0, field("Public Release Date", F.concat(F.lit("2020-01-"), k))).otherwise(F.lit("Public Release Date")),
    )).alias("at", "value"))
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c", "at").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    out = magetab.idf(spark, f"{path}/c_nationkey=*")
    return out.select("title", "summary", F.nullif(F.array_join("pubmed_ids", ","), F.lit("")).alias("pubmed"), "submission_date")


@query(f"WITH {_SEGMENTS} SELECT k, count(*) AS n_samples, min(c) AS first_sample, 'Rattus norvegicus' || CASE WHEN k % 2 = 1 THEN ';last' ELSE '' END AS organisms, string_agg(DISTINCT m, ';' ORDER BY m) AS tissues FROM c GROUP BY k")
def sample_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample tables of two widths, one with a repeated column, quoted cells and short rows, read in one scan."""
    path = new_folder(spark, "sdrf")
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").cast("long").alias("c"), F.col("c_mktsegment").alias("m"))
    odd, name = F.col("k") % 2 == 1, F.concat(F.lit("k"), F.col("k").cast("string"), F.lit(" c"), F.col("c").cast("string"))
    narrow = F.concat_ws("\t", name, F.lit("Rattus norvegicus"), F.concat(F.lit('"'), "m", F.lit('"')))
    wide = F.concat_ws("\t", F.lit(""), F.col("m"), F.lit("lost"), name, F.lit("Rattus norvegicus"), F.lit("last"))
    heads = rows.select("k").distinct().select("k", F.lit(-1).cast("long").alias("c"), F.when(odd, "Sample Name\tFactorValue[Organ Part]\tCharacteristics[organism]\tSource Name\tTerm[Organism]\tCharacteristics[organism]").otherwise("Source Name\tCharacteristics [Organism]\tMaterial Type").alias("value"))
    body = rows.select("k", "c", F.when(odd, wide).otherwise(narrow).alias("value"))
    heads.unionByName(body).repartition("k").sortWithinPartitions("k", "c").select("k", "value").write.partitionBy("k").text(path)
    samples, studies = magetab.sdrf(spark, f"{path}/k=*")
    key = F.regexp_extract("sample", r"k(\d+) c(\d+)", 1).cast("long")
    per = samples.groupBy("file", key.alias("k")).agg(F.count(F.lit(1)).alias("n_samples"), F.min(F.regexp_extract("sample", r"c(\d+)$", 1).cast("long")).alias("first_sample"))
    return per.join(studies, "file").select("k", "n_samples", "first_sample", F.array_join("organisms", ";").alias("organisms"), F.array_join("tissues", ";").alias("tissues"))


@query("SELECT 'GSM' || c_custkey AS sample, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment WHEN lower(c_mktsegment) LIKE '%mach%' THEN 'motor' WHEN lower(c_mktsegment) LIKE '%house%' THEN 'home' END AS tissue, CASE WHEN c_custkey % 3 > 0 THEN 's' || c_custkey % 7 END AS strain FROM customer WHERE c_custkey % 11 > 0")
def sample_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample tables with dotted headers; every second study names its tissue only in the title."""
    path = new_folder(spark, "samples")
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").cast("long").alias("c"), F.col("c_mktsegment").alias("m"))
    even, c = F.col("k") % 2 == 0, F.col("c").cast("string")
    sample = F.concat(F.when(F.col("c") % 11 == 0, "SRX").otherwise("GSM"), c)
    strain = F.when(F.col("c") % 3 > 0, F.concat(F.lit("s"), (F.col("c") % 7).cast("string"))).otherwise("")
    value = F.when(even, F.concat_ws("\t", sample, F.lit("t"), F.col("m"), strain)).otherwise(F.concat_ws("\t", strain, sample, F.concat(F.lit("of "), F.col("m"))))
    heads = rows.select("k").distinct().select("k", F.lit(-1).cast("long").alias("c"), F.when(even, "geo_accession\ttitle\tcharacteristics_ch1.0.Tissue\tcharacteristics_ch1.1.strain/background").otherwise("characteristics_ch1.3.Strain\tgeo_accession\ttitle").alias("value"))
    heads.unionByName(rows.select("k", "c", value.alias("value"))).repartition("k").sortWithinPartitions("k", "c").select("k", "value").write.partitionBy("k").text(path)
    told = magetab.characteristics(spark, f"{path}/k=*")
    return magetab.structured(told, {"tissue": "tissue|organ", "strain": "strain"}, [("mach", "motor"), ("house", "home")]).select("sample", "tissue", "strain")


_LIFT = """i AS (SELECT 'ENSRNOG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') g, p_partkey k, upper(replace(p_name, ' ', '')) n FROM part), cu AS (SELECT g FROM i WHERE k % 3 = 0), f AS (SELECT g, CASE WHEN k % 5 > 1 THEN n || (k % 40) END s, CASE WHEN k % 4 > 0 THEN CAST(k % 120 AS VARCHAR) END e FROM i),
  v AS (SELECT s, coalesce(min(g) FILTER (o = 0), min(g)) g FROM (SELECT n || (k % 50) s, g, 0 o FROM i WHERE k % 6 = 0 UNION ALL SELECT n || (k % 60), g, 1 FROM i WHERE k % 7 = 0) GROUP BY 1),
  h AS (SELECT k, CASE WHEN k % 3 > 0 THEN CAST(k % 120 AS VARCHAR) END e, n || (k % 45) s, [n || (k % 70), n || (k % 80)] old FROM i WHERE k % 4 = 1), be AS (SELECT e, arg_min(s, k) s FROM h WHERE e IS NOT NULL GROUP BY 1), bo AS (SELECT o, arg_min(s, [k, j]) s FROM (SELECT k, s, unnest(old) o, unnest([0, 1]) j FROM h) GROUP BY 1),
  l AS (SELECT f.g, f.s, CASE WHEN f.g IN (SELECT g FROM cu) THEN f.g END d, a.g sg, b.g pg FROM f LEFT JOIN v a ON a.s = f.s LEFT JOIN be ON be.e = f.e LEFT JOIN bo ON bo.o = f.s LEFT JOIN v b ON b.s = coalesce(be.s, bo.s))"""


def _lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("k"), lambda c: c.cast("string")
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("ENSRNOG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias("gene"), F.replace("p_name", F.lit(" "), F.lit("")).alias("n"))
    named = lambda m: F.concat("n", text(k % m))
    features = part.select("gene", F.when(k % 5 > 1, named(40)).otherwise("").alias("symbol"), F.when(k % 4 > 0, text(k % 120)).alias("entrez"), k.alias("place"))
    history = part.where("k % 4 = 1").select(F.when(k % 3 > 0, text(k % 120)).otherwise("").alias("entrez"), named(45).alias("symbol"), F.array(named(70), named(80)).alias("old"), k.alias("place"))
    symbols = lambda m, n: part.where(k % m == 0).select(named(n).alias("symbol"), "gene")
    return T.lifted(part.select(F.col("gene").alias("old_id")), part.where("k % 3 = 0"), features, symbols(6, 50), symbols(7, 60), history)


@query(f"WITH {_LIFT} SELECT g AS old_id, coalesce(d, sg, pg) AS lifted_id, CASE WHEN d IS NOT NULL THEN 'direct' WHEN sg IS NOT NULL THEN 'symbol' WHEN pg IS NOT NULL THEN 'id_history' ELSE 'unmapped' END AS method, s AS symbol FROM l")
def lifted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lift(spark, sf_dir)


@query(f"WITH {_LIFT} SELECT coalesce(d, sg, pg) AS gene, l_suppkey AS sample, sum(l_quantity) AS count FROM lineitem JOIN i ON i.k = l_partkey JOIN l ON l.g = i.g WHERE coalesce(d, sg, pg) IS NOT NULL GROUP BY 1, 2")
def lifted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("ENSRNOG"), F.lpad(F.col("l_partkey").cast("string"), 11, "0")).alias("old_id"), F.col("l_suppkey").alias("sample"), F.col("l_quantity").alias("count"))
    return T.collapsed(counts, _lift(spark, sf_dir))


@query(f"WITH {_LIFT}, m AS (SELECT CASE WHEN d IS NOT NULL THEN 'direct' WHEN sg IS NOT NULL THEN 'symbol' WHEN pg IS NOT NULL THEN 'id_history' ELSE 'unmapped' END m FROM l) SELECT m AS method, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM m), 1) AS percent FROM m GROUP BY 1")
def lift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lift_report(_lift(spark, sf_dir))


@query("SELECT count(*) AS n_cells, count(DISTINCT o_custkey) AS n_samples, count(*) FILTER (c_custkey IS NULL) AS unmatched FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey % 3 > 0")
def metadata_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "sample")
    samples = _t(spark, sf_dir, "customer").where("c_nationkey % 3 > 0").withColumnRenamed("c_custkey", "sample")
    return T.with_metadata(cells, samples, "sample")[1]


@query(
    """WITH p AS (SELECT 'orders' s, o_orderkey k, row_number() OVER (ORDER BY md5('0|orders|' || o_orderkey), o_orderkey) r, count(*) OVER () n, 0.75::DOUBLE w FROM orders UNION ALL SELECT 'customer', c_custkey, row_number() OVER (ORDER BY md5('0|customer|' || c_custkey), c_custkey), count(*) OVER (), 0.25::DOUBLE FROM customer),
    e AS (SELECT max(n / w) e FROM p), t AS (SELECT s, k, (r - 0.5 + a * n) / w t FROM (SELECT *, unnest(range(0, CAST(floor(e * w / n) AS BIGINT) + 1)) a FROM p, e)) SELECT s AS source, k AS key, round(t, 6) AS time FROM t, e WHERE t < e"""
)
def interleaved_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"orders": _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), "customer": _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))}
    return T.interleaved(sets, {"orders": 0.75, "customer": 0.25}, "key").select("source", "key", F.round("time", 6).alias("time"))
