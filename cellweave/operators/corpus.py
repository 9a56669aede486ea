"""Operators that make gene lists, cell sets, tables of tokens and vectors, and planned tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import kmers, normalize_ensembl
from .scoring import capped_sample


def genes_of(info: DataFrame, biotypes: tuple[str, ...] = (), chromosomes: tuple[str, ...] = ()) -> DataFrame:
    """Distinct gene ids of info(gene_id, biotype, chromosome) of the given biotypes and chromosomes; blank ids are left out."""
    out = info.where("trim(gene_id) <> ''")
    if biotypes:
        out = out.where(F.col("biotype").isin(*biotypes))
    if chromosomes:
        out = out.where(F.upper("chromosome").isin(*chromosomes))
    return out.select("gene_id").distinct()


def clean_genes(counts: DataFrame, excluded: DataFrame, sex_linked: DataFrame, coding: DataFrame, least_cells: int = 3) -> DataFrame:
    """counts(cell, gene, count) of genes that are not excluded, not sex-linked, protein-coding, and in least_cells cells.

    Excluded ids meet as they are, the other lists without version and case. Genes are decided on first; counts are read
    against the list of kept ones.
    """
    genes = counts.where("count > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_cells).select("gene", normalize_ensembl(F.col("gene")).alias("_id"))
    plain = lambda df: df.select(normalize_ensembl(F.col("gene_id")).alias("_id"))
    kept = genes.join(excluded.select(F.col("gene_id").alias("gene")), "gene", "left_anti").join(plain(sex_linked), "_id", "left_anti").join(plain(coding), "_id", "left_semi")
    return counts.join(kept.select("gene"), "gene", "left_semi")


def regulators(genes: DataFrame, symbols: DataFrame, vocabulary: DataFrame, expressed: DataFrame | None = None) -> DataFrame:
    """genes(gene, symbol, ...) whose symbol is listed (without case), in the vocabulary(gene) and, if given, expressed(gene)."""
    listed = symbols.select(F.upper(F.trim("symbol")).alias("_s")).where("_s <> ''").distinct()
    out = genes.withColumn("_s", F.upper("symbol")).join(listed, "_s", "left_semi").join(vocabulary, "gene", "left_semi").drop("_s")
    return out if expressed is None else out.join(expressed, "gene", "left_semi")


def shared_genes(counts: DataFrame, sample: str, outer: bool = False, least_cells: int = 0) -> DataFrame:
    """counts of genes present in all samples, or with outer of all genes; and, if asked, in so many cells."""
    out = counts
    if not outer:
        seen = counts.select("gene", sample).distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("_n"))
        n = counts.select(sample).distinct().count()  # one number
        out = counts.join(seen.where(F.col("_n") == n).select("gene"), "gene", "left_semi")
    if least_cells:
        enough = out.where("count > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_cells).select("gene")
        out = out.join(enough, "gene", "left_semi")
    return out


def balanced_subset(cells: DataFrame, study: str, label: str, key: str, per_study: int, least: int, seed: str = "0") -> DataFrame:
    """At most per_study cells of each study, drawn by hash, then of known labels that keep at least so many cells."""
    drawn = capped_sample(cells, [study], key, per_study, seed)
    known = drawn.where(F.col(label).isNotNull() & ~F.lower(label).isin("", "nan", "unknown"))
    enough = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(label)
    return known.join(enough, label, "left_semi")


def masked(ids: Column, values: Column, chosen: Column, mask_id: int = 1, pad_id: int = 0) -> Column:
    """input_ids, values, labels and their values after masking: chosen is an array of booleans, one for each position.

    Chosen positions that are no padding get the mask id and value 0, and their id as label; all others get label -100.
    """
    hit = F.zip_with(ids, chosen, lambda i, c: F.coalesce(c, F.lit(False)) & (i != pad_id))
    return F.struct(
        F.zip_with(ids, hit, lambda i, h: F.when(h, F.lit(mask_id).cast("long")).otherwise(i.cast("long"))).alias("input_ids"),
        F.zip_with(values, hit, lambda v, h: F.when(h, 0.0).otherwise(v)).alias("values"),
        F.zip_with(ids, hit, lambda i, h: F.when(h, i.cast("long")).otherwise(F.lit(-100).cast("long"))).alias("labels"),
        values.alias("labels_values"),
    )


def drawn_positions(ids: Column, key: Column, share: float, seed: str = "0") -> Column:
    """One boolean for each position of ids: drawn by a hash of seed, key and position at the given share."""
    return F.transform(ids, lambda _, i: F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1_000_000)) < int(share * 1_000_000))


def merge_dictionaries(known: DataFrame, own: DataFrame, start: int) -> DataFrame:
    """known(token, id) and the new entries of own from id start on; raises on a clash of tokens or a gap in the new ids."""
    new = own.where(F.col("id") >= start)
    clash = new.join(known, "token", "left_semi").limit(1).collect()  # one row at most
    if clash:
        raise ValueError(f"token {clash[0]['token']} is in both dictionaries")
    ends = new.agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count_distinct("id").alias("n")).first()  # three numbers
    if ends["n"] and (ends["a"] != start or ends["z"] - ends["a"] + 1 != ends["n"]):
        raise ValueError(f"new ids run from {ends['a']} to {ends['z']} for {ends['n']} ids, not on from {start}")
    return known.select("token", "id").unionByName(new.select("token", "id"))


def embedding_rows(tokens: DataFrame, pretrained: DataFrame, stage: DataFrame, start: int, width: int, factor: float = 1.0) -> DataFrame:
    """tokens(token, id) with their vector and its source: pretrained rows stay; from id start on the stage's vector, scaled, or zeros."""
    out = tokens.join(pretrained.select("id", F.col("vector").alias("_p")), "id", "left").join(stage.select("token", F.col("vector").alias("_s")), "token", "left")
    new = F.col("id") >= start
    scaled = F.transform("_s", lambda x: x.cast("double") * factor)
    own = F.when(new, scaled).otherwise(F.col("_p").cast("array<double>"))
    source = F.when(own.isNull(), "zero").when(new, "stage").otherwise("pretrained")
    return out.select("token", "id", F.coalesce(own, F.array_repeat(F.lit(0.0), width)).alias("vector"), source.alias("source"))


def transferred(genes: DataFrame, by_human: DataFrame, by_mouse: DataFrame, width: int) -> DataFrame:
    """id, vector and source of genes(gene, human, human_symbol, mouse_symbol): the human symbol's vector, the mouse symbol's, zeros.

    The id is the human one where there is one. by_human and by_mouse(symbol, vector) are dimensions.
    """
    side = lambda df, key, out: df.select(F.col("symbol").alias(key), F.col("vector").cast("array<double>").alias(out))
    out = genes.join(side(by_human, "human_symbol", "_h"), "human_symbol", "left").join(side(by_mouse, "mouse_symbol", "_m"), "mouse_symbol", "left")
    h = F.when(F.coalesce("human", F.lit("")) != "", F.col("_h"))
    source = F.when(h.isNotNull(), "human").when(F.col("_m").isNotNull(), "mouse").otherwise("zero")
    return out.select(F.coalesce(F.nullif("human", F.lit("")), "gene").alias("id"), "gene", F.coalesce(h, "_m", F.array_repeat(F.lit(0.0), width)).alias("vector"), source.alias("source"))


def unified_pairs(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct pairs of the ids that both genes map to, the smaller first; a pair of one id with itself stays."""
    side = lambda key, out: ids.select(F.col("gene").alias(key), F.col("id").alias(out))
    both = pairs.join(side("a", "_a"), "a").join(side("b", "_b"), "b")
    return both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()


def pseudo_cells(profiles: DataFrame, sample: str, kind: str) -> DataFrame:
    """profiles(sample, kind, gene, value) of the pseudo-cells whose values sum above 0."""
    keys = profiles.groupBy(sample, kind).agg(F.sum("value").alias("_s")).where("_s > 0").select(sample, kind)
    return profiles.join(keys, [sample, kind], "left_semi")


def planned_tests(plan: DataFrame, genes: DataFrame) -> DataFrame:
    """One row for each symbol of plan(symbols, expected, ...), with gene_id (NA if unknown) and whether it can be tested.

    genes(symbol, gene_id, pos); symbols meet without case, of equal ones the first wins.
    """
    known = genes.groupBy(F.lower("symbol").alias("_s")).agg(F.min_by("gene_id", "pos").alias("_g"))
    rows = plan.withColumn("symbol", F.explode("symbols")).drop("symbols").withColumn("_s", F.lower("symbol")).join(known, "_s", "left")
    return rows.withColumn("gene_id", F.coalesce(F.col("_g").cast("string"), F.lit("NA"))).withColumn("testable", F.col("_g").isNotNull()).withColumn("anchored", F.col("expected").isin("up", "down")).drop("_s", "_g")


def target_blocks(plan: DataFrame, blocks: DataFrame) -> DataFrame:
    """plan(tissue, target, ...) with each cell_type of its tissue's blocks(tissue, cell_type) that it aims at: ANY, or those listed between bars."""
    any_type = F.upper(F.trim("target")) == "ANY"
    whole = plan.where(any_type).join(blocks.select("tissue", "cell_type").distinct(), "tissue")
    listed = plan.where(~any_type).withColumn("cell_type", F.explode(F.array_distinct(F.transform(F.split("target", r"\|"), lambda t: F.trim(t)))))
    return whole.unionByName(listed.join(blocks.select("tissue", "cell_type").distinct(), ["tissue", "cell_type"], "left_semi"))


def numbered_samples(mixes: DataFrame, samples: DataFrame, column: str = "mix") -> DataFrame:
    """mixes with the sample whose place is the number in the mix's name: samples(sample, place); others are left out."""
    return mixes.withColumn("place", F.regexp_extract(column, r"(\d+)", 1).try_cast("int")).join(samples, "place").drop("place")


def promoters(genes: DataFrame, genome: DataFrame, size: int, upstream: int = 2_000, downstream: int = 500, most_unknown: float = 0.1) -> DataFrame:
    """gene, sequence and reason: the window about the start of genes(gene, chrom, tss, strand), read along its strand.

    genome(chrom, chunk, seq) holds each chromosome in pieces of size letters, counted from 0, so no row holds a whole one;
    a window meets just the pieces that it touches. Both ends count, so a whole window has upstream + downstream + 1 letters;
    those with fewer than upstream + downstream, cut by an end, are filled up to that with N. A gene without place, of an
    unknown chromosome, or with too large a share of N has no sequence and a reason.
    """
    width = upstream + downstream
    plus = F.col("strand") == 1
    first = F.greatest(F.lit(1), F.col("tss") - F.when(plus, upstream).otherwise(downstream))
    placed = genes.select("gene", "chrom", "strand", first.alias("_a"), (F.col("tss") + F.when(plus, downstream).otherwise(upstream)).alias("_z"))
    piece = lambda at: F.floor((at - 1) / size)
    touched = placed.where("_z >= _a").withColumn("chunk", F.explode(F.sequence(piece(F.col("_a")), piece(F.col("_z")))))
    found = touched.join(genome.select("chrom", F.col("chunk").cast("long").alias("chunk"), "seq"), ["chrom", "chunk"])
    # The pieces of one window are few: a window's length over the size of a piece.
    strings = found.groupBy("gene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda p: p["seq"]), "").alias("_s"), F.min("chunk").alias("_c"))
    out = placed.join(strings, "gene", "left").join(genome.select("chrom").distinct().withColumn("_known", F.lit(True)), "chrom", "left")
    own = F.upper(F.substring("_s", (F.col("_a") - F.col("_c") * size).cast("int"), (F.col("_z") - F.col("_a") + 1).cast("int")))
    strand = F.when(plus, own).otherwise(F.reverse(F.translate(own, "ACGT", "TGCA")))
    read = F.coalesce(strand, F.lit(""))
    out = out.withColumn("sequence", F.when(F.length(read) < width, F.rpad(read, width, "N")).otherwise(read))
    share = (F.length("sequence") - F.length(F.replace("sequence", F.lit("N"), F.lit("")))) / F.length("sequence")
    reason = F.when(F.col("_a").isNull() | F.col("chrom").isNull(), "no_tss_coordinate").when(F.col("_known").isNull(), "chrom_not_found").when(share > most_unknown, "high_n_fraction")
    return out.select("gene", F.when(reason.isNull(), F.col("sequence")).alias("sequence"), reason.alias("reason"))


def family_members(genes: DataFrame, ids: str, names: str) -> DataFrame:
    """family, name and gene of genes(gene, ids, names) whose families and their names are listed between bars, by place.

    A family without a name at its place has null; blank families are left out.
    """
    each = genes.select("gene", F.split(names, r"\|").alias("_n"), F.posexplode(F.split(ids, r"\|")).alias("_i", "family"))
    return each.select(F.trim("family").alias("family"), F.trim(F.get("_n", F.col("_i"))).alias("name"), "gene").where("family <> ''").distinct()


def derived_families(members: DataFrame, orthologs: DataFrame, least: int = 2) -> DataFrame:
    """family and gene of another species: all orthologs(gene, target) of a family's members, for families of at least so many."""
    own = members.select("family", "gene").join(orthologs, "gene").select("family", F.col("target").alias("gene")).distinct()
    enough = own.groupBy("family").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("family")
    return own.join(enough, "family", "left_semi")


def kmer_counts(rows: DataFrame, key: str, sequence: str, k: int = 6) -> DataFrame:
    """kmer, n (all occurrences in rows(key, sequence)) and n_keys, the distinct keys that it occurs in; a null key is none.

    A key's sequences are brought together and its k-mers told apart there, so that no task holds the distinct pairs of k-mers and keys.
    """
    apart = F.when(F.col(key).isNull(), F.xxhash64(sequence))
    own = rows.where(F.col(sequence).isNotNull()).groupBy(key, apart.alias("_a")).agg(F.collect_list(sequence).alias("_s"))
    every = own.select(key, F.flatten(F.transform("_s", lambda s: kmers(s, k))).alias("_k"))
    told = lambda a, n, m: F.transform(a, lambda x: F.struct(x.alias("kmer"), n.alias("n"), m.alias("m")))
    both = F.concat(told("_k", F.lit(1), F.lit(0)), told(F.array_distinct("_k"), F.lit(0), F.col(key).isNotNull().cast("int")))
    return every.select(F.inline(both)).groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("m").alias("n_keys"))
