"""The queries of this package and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import shared_path
    from .token_files import read, write

    return read(spark, write(_table(spark, sf_dir, "documents"), shared_path(spark, "token-files")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    out = judge(_table(spark, sf_dir, "documents"), carry=("doc_id", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_lm import score

    return score(_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards")
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", shards)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeated_text import remove_repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["bytes"])
    out = remove_repeats(_table(spark, sf_dir, "documents")).withColumn("n_removed", removed)
    return out.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_files, op2_quality_rules, op3_lattice_lm, op4_neighbours, op5_jaccard_join, op6_toxicity, op7_packing, op8_topk, op9_html_text, op10_mixing, op11_prefix_trie, op12_repeats, op13_collocations)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Host verdicts as in quality_rules: moments of the hosts' failure rates give the beta prior.
_OP2 = rf"""WITH d AS (SELECT row_number() OVER () k, doc_id, source, coalesce(text, '') text, {_WORDS} w FROM documents),
  g AS (SELECT k, i, array_to_string(w[i:i + 4], ' ') g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) i FROM d WHERE len(w) >= 5)), c AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) n FROM g),
  r AS (SELECT k, count(DISTINCT p) n FROM (SELECT k, unnest(range(i, i + 5)) p FROM c WHERE n > 1) GROUP BY 1),
  l AS (SELECT k, count(*) - count(DISTINCT l) n FROM (SELECT k, unnest(string_split(text, chr(10))) l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
  m AS (SELECT d.doc_id, source, len(w) n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(l.n, 0) n_dup_lines, coalesce(r.n, 0) n_repeat_words FROM d LEFT JOIN l USING (k) LEFT JOIN r USING (k)),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m), h AS (SELECT source, count(*) n, count(*) FILTER (base_failed) f FROM b WHERE source IS NOT NULL GROUP BY 1),
  s AS (SELECT count(*) h, sum(n) n, sum(f) f, sum(n * n) nn, sum(f * f / n) ffn FROM h), e AS (SELECT *, least(greatest(f / n, 1e-6), 1 - 1e-6) mean FROM s),
  v AS (SELECT *, CASE WHEN n - nn / n > 0 THEN (ffn - f * f / n - (h - 1) * mean * (1 - mean)) / (n - nn / n) ELSE 0 END between_ FROM e),
  p AS (SELECT mean, CASE WHEN between_ > 0 THEN greatest(mean * (1 - mean) / between_ - 1, 2) WHEN h > 1 THEN 1e6 ELSE 2 END prior FROM v),
  o AS (SELECT source, (f + mean * prior) / (n + prior) rate, n + prior + 1 weight FROM h, p)
  SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate - 2 * sqrt(rate * (1 - rate) / weight) <= 0.8, true) AS kept FROM b LEFT JOIN o ON o.source = b.source"""

#: All links of shingle sets by their shared shingles, and components by the least reachable id.
_OP5 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) s FROM d),
  u AS (SELECT doc_id, len(s) n, unnest(s) g FROM s), p AS (SELECT a.doc_id a, b.doc_id b, count(*) c, any_value(a.n) x, any_value(b.n) y FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (x + y - c)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a v, a t FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t), m AS (SELECT v, min(t) c FROM r GROUP BY 1)
  SELECT s.doc_id, len(s) AS n_shingles, coalesce(least(c, s.doc_id), s.doc_id) AS component_id FROM s LEFT JOIN m ON m.v = s.doc_id"""

_OP8 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

#: The reduction of a byte string to its crc32, bit by bit; 0xEDB88320 is the fixed polynomial.
_CRC = "(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)))"

#: Every prefix of every rebuilt conversation as a list, grouped whole; leaves and savings by all ancestors of a node.
_OP11 = rf"""WITH t AS (SELECT conv_id c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) i FROM conversations WHERE conv_id IS NOT NULL),
  o AS (SELECT c, list(x ORDER BY i) w, {_CRC} % 6 h FROM t GROUP BY c),
  s AS (SELECT o.c, list_concat(coalesce(p.w[1:o.h], []), o.w[o.h + 1:]) w FROM o LEFT JOIN o p ON p.c = o.c - o.c % 100),
  p AS (SELECT c, w[1:d] k, d, len(w) = d e FROM (SELECT *, unnest(range(len(w) + 1)) d FROM s)),
  n AS (SELECT k, d, count(*) n_convs, min(c) conv_id, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (e), '')) ends_sha256 FROM p GROUP BY k, d),
  f AS (SELECT a.k, a.d, a.n_convs, a.conv_id, a.ends_sha256, b.conv_id parent_conv_id, (SELECT count(*) FROM n x WHERE x.d = a.d + 1 AND x.k[1:a.d] = a.k) n_children, CASE WHEN a.d > 0 THEN (a.n_convs - 1) * length(a.k[a.d].text) ELSE 0 END own FROM n a LEFT JOIN n b ON a.d > 0 AND b.d = a.d - 1 AND b.k = a.k[1:a.d - 1]),
  u AS (SELECT k[1:g] k, g d, count(*) FILTER (n_children = 0) n_leaves, sum(own) saved FROM (SELECT *, unnest(range(d + 1)) g FROM f) GROUP BY 1, 2)
  SELECT conv_id, f.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM f JOIN u ON u.d = f.d AND u.k = f.k"""

#: Every string of 100 bytes, in hexadecimal, that is found twice, with the first of its places; runs of covered bytes by gaps between starts.
_OP12 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x FROM documents), p AS (SELECT doc_id, x, unnest(range(len(x) // 2 - 99)) i FROM d), w AS MATERIALIZED (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 200)) s FROM p), n AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
  q AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) s FROM w JOIN n USING (s) JOIN d USING (doc_id)), m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) r FROM q) WHERE r > 1),
  g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END new_ FROM m), h AS (SELECT *, sum(new_) OVER (PARTITION BY doc_id ORDER BY i) k FROM g),
  r AS (SELECT doc_id, min(i) a, max(i) + 100 b FROM h GROUP BY doc_id, k), o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) before_ FROM r),
  c AS (SELECT doc_id, sum(b - a) n, count(*) s, max(b) last_, list({'a': before_, 'b': a} ORDER BY a) keep FROM o GROUP BY doc_id)
  SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(s, 0) AS n_spans,
    sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(keep, lambda p: x[2 * p.a + 1:2 * p.b]), '') || x[2 * last_ + 1:] END)) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""

#: Counts of all phrases of up to four words, as lists; the lowest cut, and what longer candidates stand for.
_OP13 = r"""WITH d AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p FROM documents),
  w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') w FROM d), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) n FROM w GROUP BY 1), o AS (SELECT lang, w, unnest([1, 2, 3, 4]) m FROM w),
  f AS (SELECT lang, g, count(*) a FROM (SELECT lang, w[i:i + m - 1] g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) i FROM o)) GROUP BY 1, 2 HAVING count(*) >= 30),
  c AS (SELECT *, unnest(range(1, len(g))) k FROM f WHERE len(g) > 1), s AS (SELECT c.lang, c.g, c.a, k, l.a l, r.a r, CAST(2000000::HUGEINT * c.a // (l.a + r.a) AS BIGINT) score FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) y FROM s) WHERE y = 1),
  x AS (SELECT lang, g[i:i + m - 1] g, max(a) longer FROM (SELECT *, unnest(range(1, len(g) - m + 2)) i FROM (SELECT *, unnest(range(2, len(g))) m FROM f WHERE len(g) > 2)) GROUP BY 1, 2),
  k AS (SELECT b.lang, array_to_string(b.g, ' ') phrase, a, l, r, score FROM b LEFT JOIN x ON x.lang = b.lang AND x.g = b.g WHERE longer IS NULL OR 100 * longer < 80 * a),
  z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
  SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express: the others rest on a tokenizer, hashes or fitted models."""
    return {"op2_quality_rules": _OP2, "op5_jaccard_join": _OP5, "op8_topk": _OP8, "op11_prefix_trie": _OP11, "op12_repeats": _OP12, "op13_collocations": _OP13}
