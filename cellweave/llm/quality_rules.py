"""Quality rules with host verdicts. Only DataFrame operations.

Each text is measured by a few rules. A host's (domain's) failures are counted, its failure rate is shrunk towards
the mean of all hosts by a beta prior whose two parameters come from the hosts themselves (moments of the
beta-binomial), and a host whose shrunken rate stays above the limit even less two posterior deviations is bad. The
verdict is joined back to the host's documents.

Defined results: null text has no words and fails; a null host gets no verdict, so only a document's own rules
count; repeated rows count as often as they occur; an empty table gives an empty table; a single host, or hosts
that all have one rate, give a weak prior of that mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, let, materialize, words

#: Rules of a document, fixed by the contract.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: A host is bad where its shrunken failure rate, less two posterior deviations, is over this.
HOST_LIMIT = 0.8
#: Weight of the prior, in documents, where hosts do not differ enough to tell it.
WEAK_PRIOR = 2.0


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of 5 words which the text has twice or more, by 64-bit hashes of the windows.

    Hashes are sorted as plain longs first; only a text in which two are equal has its positions sorted with them.
    """
    hashes = F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - WINDOW)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    )

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        again = let(pairs, lambda s: F.filter(s, lambda x, j: same(s, j, j + 1) | same(s, j, j - 1)))
        at = F.sort_array(F.transform(again, lambda x: x.i))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(WINDOW), p - a.last)).alias("n")))["n"]

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    per_words = let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    w, n_lines = fresh(docs.columns, "w"), fresh(docs.columns, "lines")
    out = docs.withColumn(w, per_words).withColumn(n_lines, let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))))
    out = out.withColumns(
        {
            "n_words": F.col(f"{w}.n_words"),
            "word_chars": F.char_length(_without(text, SPACE)).cast("long"),
            "n_symbols": (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long"),
            "n_dup_lines": F.col(n_lines).cast("long"),
            "n_repeat_words": F.col(f"{w}.n_repeat_words"),
        }
    ).drop(w, n_lines)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """A row per host: documents, failures, shrunken rate and host_ok."""
    hosts = measured.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("_host")).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(F.col("base_failed")).alias("host_failed"))
    hosts = materialize(hosts, "rules-hosts")
    n, f = F.col("host_docs"), F.col("host_failed")
    s = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn")).first()
    mean, prior = 0.5, WEAK_PRIOR
    if s.n:
        mean = min(max(s.f / s.n, 1e-6), 1 - 1e-6)
        spread = s.n - s.nn / s.n  # of the weighted variance between hosts
        between = (s.ffn - s.f * s.f / s.n - (s.hosts - 1) * mean * (1 - mean)) / spread if spread > 0 else 0.0
        within = mean * (1 - mean)
        if between > 0:
            prior = max(within / between - 1, WEAK_PRIOR)
        elif s.hosts > 1:
            prior = 1e6  # no more spread than chance gives: one rate for all
    a, b = mean * prior, (1 - mean) * prior
    rate = (f + a) / (n + a + b)
    deviation = F.sqrt(rate * (1 - rate) / (n + a + b + 1))
    return hosts.select("_host", "host_docs", "host_failed", rate.alias("host_rate"), (rate - 2 * deviation <= limit).alias("host_ok"))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", carry: tuple[str, ...] | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """docs (or its columns in carry) with the rule measures, host_rate and kept.

    The measures are written once; the hosts are summed from them and the verdicts joined back to them.
    """
    measured = measure(docs, text_col)
    if carry is not None:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        measured = measured.select(*[c for c in carry if c not in names], *([host_col] if host_col not in carry else []), *names)
    measured = materialize(measured, "rules-measured")
    verdict = host_verdicts(measured, host_col, limit)
    measured = measured.drop("host_rate", "host_ok")  # a column that bears a result's name gives way to it
    host = fresh(measured.columns, "host")
    out = measured.join(verdict.select(F.col("_host").alias(host), "host_rate", "host_ok"), F.col(host_col) == F.col(host), "left").drop(host)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True)))
