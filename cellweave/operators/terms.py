"""Terms of metadata: organisms and tissues told apart by tables of names, misplaced terms re-routed, ids lifted to a release."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import ladder
from .scoring import draw_order

#: Shortest names that count where a term only contains them.
LEAST_ORGANISM, LEAST_TISSUE = 6, 4


def normal(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def latin(text: Column) -> Column:
    """Genus and species: two words, the first with a capital and else small letters, the second all letters from a small one on."""
    return F.rlike(F.trim(text), F.lit(r"^\p{Lu}[^\p{Lu}\s]*\p{Ll}[^\p{Lu}\s]*\s+\p{Ll}\p{L}*$"))


def contained(terms: DataFrame, names: DataFrame, term: str, name: str, least: int) -> DataFrame:
    """terms joined with each of names that they contain, of `least` characters or more.

    All substrings of a term of the lengths that names have are looked up, so the join is one of equal keys; terms are distinct
    strings of metadata and names a table of hundreds.
    """
    long_ = names.where(F.char_length(name) >= least)
    lengths = long_.select(F.char_length(name).alias("_l")).distinct()
    sizes = terms.withColumn("_", F.lit(0)).join(lengths.agg(F.collect_set("_l").alias("_ls")).withColumn("_", F.lit(0)), "_").drop("_")
    each = sizes.select(*terms.columns, F.explode("_ls").alias("_l")).where(F.col("_l") <= F.char_length(term))
    cut = each.withColumn("_p", F.explode(F.sequence(F.lit(1), F.char_length(term) - F.col("_l") + 1))).withColumn(name, F.substring(F.col(term), F.col("_p"), F.col("_l")))
    return cut.drop("_l", "_p").distinct().join(long_, name)


def classify(texts: DataFrame, organisms: DataFrame, tissues: DataFrame, cell_types: DataFrame, excluded: DataFrame, patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """text, organism and tissue (null where it is none) of each distinct text.

    organisms, tissues and cell_types(term, name, place), excluded(term). An organism is a known name, or no tissue (by name or
    pattern) and contains a known name, the first in place, or is a Latin binomial. A tissue is no known or Latin organism and is a known name,
    or matches a pattern, or contains a known name, the longest and then the first, or contains a cell type, the first.
    """
    own = texts.select("text").where("text is not null").distinct().withColumn("term", normal(F.col("text")))
    bare = own.select("term").distinct()
    bare = bare.join(excluded.select("term", F.lit(True).alias("_out")).distinct(), "term", "left").where("_out is null and term <> ''").drop("_out")
    exact = lambda df, out: df.groupBy("term").agg(F.max_by("name", "place").alias(out))
    both = bare.join(exact(organisms, "_o"), "term", "left").join(exact(tissues, "_t"), "term", "left")
    matched = ladder((F.rlike("term", F.lit(f"(?i){p}")), F.lit(t)) for p, t in patterns) if patterns else F.lit(None).cast("string")
    both = both.withColumn("_p", matched)
    some = bare.select("term")
    names = lambda df: df.select(F.col("term").alias("_n"), "name", "place")
    near = contained(some, names(organisms), "term", "_n", LEAST_ORGANISM).groupBy("term").agg(F.min_by("name", "place").alias("_oc"))
    best = F.struct(-F.char_length("_n"), F.col("place"))
    part = contained(some, names(tissues), "term", "_n", LEAST_TISSUE).groupBy("term").agg(F.min_by("name", best).alias("_tc"))
    cell = contained(some, names(cell_types), "term", "_n", 1).groupBy("term").agg(F.min_by("name", "place").alias("_cc"))
    rows = own.join(both.join(near, "term", "left").join(part, "term", "left").join(cell, "term", "left").withColumn("_in", F.lit(True)), "term", "left")
    binomial = latin(F.col("text"))
    organism = F.coalesce("_o", F.when(F.col("_t").isNull() & F.col("_p").isNull(), F.coalesce("_oc", F.when(binomial, F.trim("text")))))
    tissue = F.when(F.col("_o").isNull() & ~binomial, F.coalesce("_t", "_p", "_tc", "_cc"))
    told = F.col("_in").isNotNull()
    return rows.select("text", F.when(told, organism).alias("organism"), F.when(told, tissue).alias("tissue"))


def rerouted(rows: DataFrame, classes: DataFrame, key: str = "key") -> DataFrame:
    """key with clean organisms and tissues: each string of either list goes where it belongs, its own list first; the rest is dropped.

    rows(key, organisms, tissues: arrays of strings), classes as classify() gives them.
    """
    each = rows.select(key, F.lit(1).alias("_o"), F.explode("organisms").alias("text")).unionByName(rows.select(key, F.lit(0).alias("_o"), F.explode("tissues").alias("text")))
    told = each.join(classes, "text")
    organism = F.when((F.col("_o") == 1) | F.col("tissue").isNull(), F.col("organism"))
    tissue = F.when((F.col("_o") == 0) | F.col("organism").isNull(), F.col("tissue"))
    clean = told.groupBy(key).agg(F.array_sort(F.collect_set(organism)).alias("organisms"), F.array_sort(F.collect_set(tissue)).alias("tissues"))
    none = F.array().cast("array<string>")
    return rows.select(key).join(clean, key, "left").withColumn("organisms", F.coalesce("organisms", none)).withColumn("tissues", F.coalesce("tissues", none))


def tissue_types(tissue: Column, types: Sequence[tuple[str, Sequence[str]]], default: Sequence[str]) -> Column:
    """The marker tissues of a tissue name: those of the name itself, else of the first entry that holds it or that it holds, else the default."""
    array = lambda v: F.array(*[F.lit(x) for x in v])
    low = F.lower(tissue)
    exact = [(tissue == k, array(v)) for k, v in types]
    near = [(low.contains(k) | F.lit(k).contains(low), array(v)) for k, v in types]
    return ladder([(tissue.isNull() | (tissue == ""), array(default)), *exact, *near], array(default))


def lifted(ids: DataFrame, current: DataFrame, features: DataFrame, vocabulary: DataFrame, reference: DataFrame, history: DataFrame) -> DataFrame:
    """old_id, lifted_id, method and symbol of ids(old_id): already current, by symbol, or by a history of entrez ids and old symbols.

    current(gene), features(gene, symbol, entrez, place), vocabulary and reference(symbol, gene): a symbol's least gene, the
    vocabulary's before the reference's; history(entrez, symbol, old: array, place). Of repeated keys the first in place counts. All
    ways end in a current symbol's gene, so sums over lifted ids only merge annotations of one gene.
    """
    told = lambda c: F.when(F.col(c) != "", F.col(c))
    upper = lambda c: F.upper(told(c))
    first = lambda df, key, value: df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, "place").alias(value))
    f = features.select("gene", upper("symbol").alias("symbol"), told("entrez").alias("entrez"), "place")
    symbols = first(f, "gene", "symbol").join(first(f, "gene", "entrez"), "gene", "full")
    genes = vocabulary.select(upper("symbol").alias("_s"), told("gene").alias("_g"), F.lit(0).alias("_o")).unionByName(reference.select(upper("symbol").alias("_s"), told("gene").alias("_g"), F.lit(1).alias("_o")))
    genes = genes.where("_s is not null and _g is not null").groupBy("_s").agg(F.min(F.struct("_o", "_g"))["_g"].alias("_g"))
    h = history.select(told("entrez").alias("entrez"), upper("symbol").alias("now"), "old", "place").where("now is not null")
    by_entrez = first(h, "entrez", "now").select("entrez", F.col("now").alias("_by_entrez"))
    olds = h.select("now", "place", F.posexplode("old").alias("_i", "_old")).select("now", F.struct("place", "_i").alias("place"), F.upper(F.when(F.col("_old") != "", F.col("_old"))).alias("symbol"))
    by_old = first(olds, "symbol", "now").select("symbol", F.col("now").alias("_by_old"))
    rows = ids.select("old_id").join(symbols.withColumnRenamed("gene", "old_id"), "old_id", "left").join(current.select(F.col("gene").alias("old_id"), F.lit(True).alias("_is")).distinct(), "old_id", "left")
    rows = rows.join(by_entrez, "entrez", "left").join(by_old, "symbol", "left").withColumn("_past", F.coalesce("_by_entrez", "_by_old"))
    side = lambda s, g: genes.select(F.col("_s").alias(s), F.col("_g").alias(g))
    rows = rows.join(side("symbol", "_sg"), "symbol", "left").join(side("_past", "_pg"), "_past", "left")
    gene = F.when(F.col("_is"), F.col("old_id")).otherwise(F.coalesce("_sg", "_pg"))
    method = F.when(F.col("_is"), "direct").when(F.col("_sg").isNotNull(), "symbol").when(F.col("_pg").isNotNull(), "id_history").otherwise("unmapped")
    return rows.select("old_id", gene.alias("lifted_id"), method.alias("method"), "symbol")


def lift_report(lift: DataFrame) -> DataFrame:
    """method, ids and their percentage (one place)."""
    counts = lift.groupBy("method").agg(F.count(F.lit(1)).alias("n")).withColumn("_", F.lit(0))
    total = lift.agg(F.count(F.lit(1)).alias("_all")).withColumn("_", F.lit(0))
    return counts.join(total, "_").select("method", "n", F.round(100 * F.col("n") / F.col("_all"), 1).alias("percent"))


def collapsed(counts: DataFrame, lift: DataFrame) -> DataFrame:
    """gene, sample and summed count of counts(old_id, sample, count) whose id was lifted."""
    return counts.join(lift.where("lifted_id is not null").select("old_id", F.col("lifted_id").alias("gene")), "old_id").groupBy("gene", "sample").agg(F.sum("count").alias("count"))


def with_metadata(cells: DataFrame, samples: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """cells with their sample's columns (null without one), and one row: cells, samples and cells without a sample."""
    known = samples.withColumn("_known", F.lit(True)).dropDuplicates([key])
    joined = cells.join(known, key, "left")
    counts = joined.agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct(key).alias("n_samples"), F.count_if(F.col("_known").isNull()).alias("unmatched"))
    return joined.drop("_known"), counts


def interleaved(sets: dict[str, DataFrame], shares: dict[str, float], key: str, seed: str = "0") -> DataFrame:
    """Rows of several sets with source and time: drawn by share until every set has been used up once.

    A row's time is its place in the set's own random order over the set's share, so up to any time sets have given in
    proportion to their shares. A set that is used up starts again, until the set that lasts longest is through.
    """
    sizes = {name: df.count() for name, df in sets.items()}
    sizes = {name: n for name, n in sizes.items() if n}
    if any(shares[name] <= 0 for name in sizes):
        raise ValueError("every set needs a share")
    end = max((n / shares[name] for name, n in sizes.items()), default=0.0)
    out = None
    for name, n in sizes.items():
        own = sets[name].withColumn("source", F.lit(name)).withColumn("_h", draw_order(seed, F.lit(name), F.col(key)))
        own = own.withColumn("_b", F.substring("_h", 1, 2))  # places are counted by the first digits of the order, so no task sees a whole set
        counts = own.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
        before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
        place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) + F.col("_before")
        again = F.explode(F.sequence(F.lit(0), F.lit(int(end * shares[name] / n))))
        timed = own.join(before, "_b").withColumn("_place", place).withColumn("_again", again).withColumn("time", (F.col("_place") - 0.5 + F.col("_again") * n) / shares[name])
        timed = timed.where(F.col("time") < end).drop("_b", "_before", "_h", "_place", "_again")
        out = timed if out is None else out.unionByName(timed)
    return out if out is not None else next(iter(sets.values())).withColumn("source", F.lit("")).withColumn("time", F.lit(0.0)).limit(0)
