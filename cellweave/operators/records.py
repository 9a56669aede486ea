"""Records of a corpus: accumulators that are merged, logs of resolution, votes by priority, selections held to a contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import ladder, normalize_ensembl


def scatter(counts: DataFrame, part: str, target: float = 10_000.0) -> DataFrame:
    """part, gene and its accumulators: nonzero cells, sums and sums of squares of counts and of counts scaled to target, and the part's cells.

    counts(part, cell, gene, count); a cell belongs to one part. Accumulators of several parts add up.
    """
    library = counts.groupBy(part, "cell").agg(F.sum("count").alias("_lib"))
    cells = library.groupBy(part).agg(F.count(F.lit(1)).alias("n_cells"))
    x = F.try_divide(F.col("count") * target, F.col("_lib"))
    own = counts.where("count > 0").join(library, [part, "cell"]).withColumn("_x", x)
    sums = own.groupBy(part, "gene").agg(F.count(F.lit(1)).alias("n_nonzero"), F.sum("count").alias("sum_raw"), F.sum(F.col("count") * F.col("count")).alias("sq_raw"), F.sum("_x").alias("sum_norm"), F.sum(F.col("_x") * F.col("_x")).alias("sq_norm"))
    return sums.join(cells, part)


def gather(parts: DataFrame, part: str) -> DataFrame:
    """One row for each gene from the accumulators of all parts: cells, means, and the deviation of nonzero scaled counts; a part counts its cells for every gene."""
    cells = parts.select(part, "n_cells").distinct().agg(F.sum("n_cells").alias("n_cells")).withColumn("_", F.lit(0))
    sums = parts.groupBy("gene").agg(*[F.sum(c).alias(c) for c in ("n_nonzero", "sum_raw", "sq_raw", "sum_norm", "sq_norm")]).withColumn("_", F.lit(0)).join(cells, "_")
    mean = F.col("sum_norm") / F.col("n_nonzero")
    var = F.when(F.col("n_nonzero") <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("sq_norm") / F.col("n_nonzero") - mean * mean))
    return sums.select("gene", "n_cells", "n_nonzero", (F.col("sum_raw") / F.col("n_cells")).alias("mean_raw"), mean.alias("mean_nonzero"), F.sqrt(var).alias("std_nonzero"))


def incomplete_parts(parts: DataFrame, part: str, expected: int, genes: int) -> DataFrame:
    """part and problem: parts below `expected` that are missing, and parts whose accumulators name more genes than there are."""
    have = parts.groupBy(F.col(part).cast("long").alias("part")).agg(F.count_distinct("gene").alias("n"))
    every = parts.sparkSession.range(expected).toDF("part")
    missing = every.join(have, "part", "left_anti").withColumn("problem", F.lit("missing"))
    wide = have.where(F.col("n") > genes).select("part", F.lit("too many genes").alias("problem"))
    beyond = have.where((F.col("part") >= expected) | (F.col("part") < 0)).select("part", F.lit("not expected").alias("problem"))
    return missing.unionByName(wide).unionByName(beyond)


def merge_gene_stats(partials: DataFrame) -> DataFrame:
    """gene, n_nonzero, total and mean_nonzero of partial(gene, n_nonzero, total): the mean comes from the merged totals, never from partial means."""
    sums = partials.groupBy("gene").agg(F.sum("n_nonzero").alias("n_nonzero"), F.sum("total").alias("total"))
    return sums.withColumn("mean_nonzero", F.round(F.coalesce(F.try_divide("total", "n_nonzero"), F.lit(0.0)), 4))


def resolution_log(seen: DataFrame, resolved: DataFrame, universe: DataFrame) -> DataFrame:
    """raw_id, method, gene_id, files, studies and their sorted list, whether the gene is kept, and why not.

    seen(raw_id, study, file), resolved(raw_id, gene_id, method) with one row for each raw id, universe(gene_id).
    """
    files = seen.select("raw_id", "study", "file").distinct()
    counts = files.groupBy("raw_id").agg(F.count(F.lit(1)).alias("n_files"))
    studies = files.select("raw_id", "study").distinct().groupBy("raw_id").agg(F.count(F.lit(1)).alias("n_studies"), F.array_join(F.array_sort(F.collect_list("study")), ";").alias("studies"))
    out = counts.join(studies, "raw_id").join(resolved, "raw_id", "left").join(universe.select("gene_id", F.lit(True).alias("_in")).distinct(), "gene_id", "left")
    kept = F.coalesce("_in", F.lit(False))
    reason = ladder([(kept, F.lit("")), (F.col("method").isNull() | (F.col("method") == "unresolved"), F.lit("unresolved")), (F.col("gene_id").isNull(), F.col("method"))], F.lit("not_in_universe"))
    return out.select("raw_id", "method", "gene_id", "n_files", "n_studies", "studies", kept.alias("kept"), reason.alias("reason"))


def histogram(rows: DataFrame, **axes: Column) -> DataFrame:
    """axis, value and n for each named column of rows, all in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("axis"), F.coalesce(c.cast("string"), F.lit("none")).alias("value")) for name, c in axes.items()]))
    return rows.select(each.alias("s")).groupBy("s.axis", "s.value").agg(F.count(F.lit(1)).alias("n"))


def voted(votes: DataFrame, by: Sequence[str], kind: str, priority: Sequence[str], least: float = 0.6, other: str = "unknown") -> DataFrame:
    """by, the first kind in priority that holds the least share of a group's votes, else other; and the number of votes."""
    share = lambda k: F.count_if(F.col(kind) == k) / F.count(F.lit(1))
    shares = votes.groupBy(*by).agg(F.count(F.lit(1)).alias("votes"), *[share(k).alias(f"_{i}") for i, k in enumerate(priority)])
    return shares.select(*by, ladder([(F.col(f"_{i}") >= least, F.lit(k)) for i, k in enumerate(priority)], F.lit(other)).alias(kind), "votes")


def large_samples(cells: DataFrame, sample: str, least: int = 4) -> DataFrame:
    """Cells of samples of which at least so many cells are left."""
    big = cells.groupBy(sample).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(sample)
    return cells.join(big, sample, "left_semi")


def droplets(cells: DataFrame, matrix: str, unfiltered: Sequence[int], least_counts: float = 1.0) -> DataFrame:
    """cells(matrix, cell, library_size) without empty droplets: only matrices whose number of barcodes is that of an unfiltered chip lose any."""
    sizes = cells.groupBy(matrix).agg(F.count(F.lit(1)).alias("_n"))
    raw = sizes.where(F.col("_n").isin(*unfiltered)).select(matrix, F.lit(True).alias("_raw"))
    return cells.join(raw, matrix, "left").where(F.col("_raw").isNull() | (F.col("library_size") >= least_counts)).drop("_raw")


def carried_labels(ours: DataFrame, authors: DataFrame, matches: DataFrame) -> DataFrame:
    """sample, barcode and the author's label of barcodes of matched samples; barcodes that an author sample labels in two ways get none.

    ours(sample, barcode), authors(author_sample, barcode, label), matches(sample, author_sample).
    """
    told = authors.where("label is not null").groupBy("author_sample", "barcode").agg(F.min("label").alias("label"), F.max("label").alias("_z")).where("label = _z").drop("_z")
    return ours.select("sample", "barcode").distinct().join(matches.select("sample", "author_sample"), "sample").join(told, ["author_sample", "barcode"]).select("sample", "author_sample", "barcode", "label")


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """problem and task of manifests(task, n_tasks): manifests that disagree on the number of tasks (task null), repeated tasks, tasks out of range and missing ones."""
    counts = manifests.groupBy("n_tasks").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.agg(F.count(F.lit(1)).alias("k"), F.max_by("n_tasks", F.struct("n", "n_tasks")).alias("n_tasks"))
    torn = sizes.where("k > 1").select(F.lit("n_tasks differ").alias("problem"), F.lit(None).cast("long").alias("task"))
    per = manifests.groupBy(F.col("task").cast("long").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    twice = per.where("n > 1").select(F.lit("repeated").alias("problem"), "task")
    every = sizes.where("n_tasks > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tasks").cast("long") - 1)).alias("task"))
    missing = every.join(per, "task", "left_anti").select(F.lit("missing").alias("problem"), "task")
    beyond = per.join(every, "task", "left_anti").select(F.lit("out of range").alias("problem"), "task")
    return torn.unionByName(twice).unionByName(missing).unionByName(beyond)


def overlaps(spaces: dict[str, DataFrame]) -> DataFrame:
    """a, b, n (ids in both) and their percentage of a, for each ordered pair of spaces(id), and each space with itself."""
    out = None
    for name, df in spaces.items():
        own = df.select("id", F.lit(name).alias("a")).distinct()
        out = own if out is None else out.unionByName(own)
    sizes = out.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    # An id is in a few spaces at most, so its list of spaces is short.
    lists = out.groupBy("id").agg(F.collect_list("a").alias("s"))
    pairs = lists.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(sizes, "a").select("a", "b", "n", F.round(100 * F.col("n") / F.col("_n"), 1).alias("percent"))


def pooled_reference(studies: dict[str, DataFrame]) -> DataFrame:
    """study, cell (with its study's name before it), gene and count of several studies: all genes of any, and where each row is from."""
    out = None
    for name, df in studies.items():
        own = df.select(F.lit(name).alias("study"), F.concat(F.lit(f"{name}:"), F.col("cell").cast("string")).alias("cell"), "gene", "count")
        out = own if out is None else out.unionByName(own)
    return out


def loaded_orthologs(table: DataFrame, prefix: str = "ENSRNOG") -> DataFrame:
    """gene, target, kind, identity and target_identity of an ortholog table of strings: ids normalized, rows without either id or of another species left out, an identity that is no number null."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    gene, target = normalize_ensembl(text("gene")), normalize_ensembl(text("target"))
    out = table.select(gene.alias("gene"), target.alias("target"), text("kind").alias("kind"), F.col("identity").try_cast("double").alias("identity"), F.col("target_identity").try_cast("double").alias("target_identity"))
    return out.where(F.col("gene").startswith(prefix) & (F.col("target") != ""))


def unified_ids(ids: DataFrame, to_ours: DataFrame, prefix: str = "ENSRNOG") -> DataFrame:
    """gene and unified: the id that stands for our species' gene in all species' pairs; ids of other species are dropped, genes without an entry stand for themselves."""
    own = ids.where(F.col("gene").startswith(prefix))
    return own.join(to_ours.select("gene", "unified"), "gene", "left").withColumn("unified", F.coalesce("unified", "gene"))


def arms(cells: DataFrame, samples: DataFrame, arm: str, control: str, trained: str) -> DataFrame:
    """Cells of both arms with their sample's sex and a flag for the trained one; cells whose sample is in neither are left out."""
    own = samples.where(F.col(arm).isin(control, trained)).select("sample", "sex", (F.col(arm) == trained).alias("trained"))
    return cells.join(own, "sample")


def human_edges(edges: DataFrame, orthologs: DataFrame, tokens: DataFrame) -> DataFrame:
    """edges(tf, target, ...) in another species' ids: the factor by its ortholog, kept if that has a token; targets likewise."""
    side = lambda c: orthologs.select(F.col("gene").alias(c), F.col("target").alias(f"_{c}"))
    known = tokens.select(F.col("gene").alias("_tf"), F.col("token").alias("token"))
    out = edges.join(side("tf"), "tf").join(orthologs.select(F.col("gene").alias("target"), F.col("target").alias("_target")), "target").join(known, "_tf")
    rest = [c for c in edges.columns if c not in ("tf", "target")]
    return out.select(F.col("_tf").alias("tf"), F.col("_target").alias("target"), "token", *rest)


def selection_contract(selected: DataFrame, raw: DataFrame, expected: DataFrame, dropped: DataFrame, organism: str = "rattus norvegicus", built: DataFrame | None = None, treated: str = r"(?i)treat|aged|\bko\b|knock") -> DataFrame:
    """tissue, verdict and problems of each tissue of expected(tissue, status, sample_id).

    SKIP if its status is blocked; NOT-BUILT if its data are missing; FAIL if the selection is not what is expected, if quality control dropped other
    samples than dropped(tissue, sample_id), if a sample is of another organism or lacks inputs, or if what was built differs; WARN if a
    selected sample looks treated; else PASS. selected(tissue, sample_id, organism, title, has_inputs), raw(tissue, sample_id).
    """
    sets = lambda df, name: df.where("sample_id is not null").groupBy("tissue").agg(F.array_sort(F.collect_set("sample_id")).alias(name))
    tissues = expected.groupBy("tissue").agg(F.max("status").alias("status"))
    bad = selected.groupBy("tissue").agg(
        F.count_if(F.coalesce(F.lower(F.trim("organism")), F.lit("")) != organism).alias("foreign"), F.count_if(~F.coalesce("has_inputs", F.lit(False))).alias("bare"), F.count_if(F.rlike(F.coalesce("title", F.lit("")), F.lit(treated))).alias("treated")
    )
    out = tissues
    for df, name in ((expected, "want"), (selected, "got"), (raw, "raw"), (dropped, "drop"), (built if built is not None else selected.limit(0), "built")):
        out = out.join(sets(df, name), "tissue", "left")
    none = F.array().cast(selected.schema["sample_id"].dataType.simpleString().join(["array<", ">"]))
    c = lambda name: F.coalesce(name, none)
    out = out.join(bad, "tissue", "left").na.fill(0, ["foreign", "bare", "treated"])
    lost = F.array_sort(F.array_except(c("raw"), c("got")))
    fails = [(c("want") != c("got"), "selection"), (lost != F.array_sort(c("drop")), "dropped"), (F.col("foreign") > 0, "organism"), (F.col("bare") > 0, "inputs"), (F.col("built").isNotNull() & (F.col("built") != c("want")), "built")]
    problems = F.array_join(F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in fails]), lambda x: x.isNotNull()), ",")
    verdict = ladder([(F.col("status") == "blocked", F.lit("SKIP")), (F.col("status") == "needs-online-data", F.lit("NOT-BUILT")), (problems != "", F.lit("FAIL")), (F.col("treated") > 0, F.lit("WARN"))], F.lit("PASS"))
    return out.select("tissue", verdict.alias("verdict"), F.when(verdict == "FAIL", problems).otherwise("").alias("problems"))


def ordered_pivot(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row by column with 0 where there are none, the place of each row by its total (largest first, then by name), and the total."""
    wide = rows.groupBy(row).pivot(column, list(values)).count().na.fill(0)
    total = wide.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))
    return total.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), row)))


def collision_bands(mapped: DataFrame) -> DataFrame:
    """band and tokens: how many tokens are shared by so many genes, one, two, three to five, or more."""
    per = mapped.where("token_id is not null").groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
    band = ladder([(F.col("n") == 1, F.lit("1")), (F.col("n") == 2, F.lit("2")), (F.col("n") <= 5, F.lit("3-5"))], F.lit(">5"))
    return per.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_tokens"))


def human_size(size: Column, units: Sequence[str] = ("B", "KB", "MB", "GB", "TB", "PB")) -> Column:
    """A number of bytes in the largest of units that leaves it at one or more, with one decimal."""
    told = lambda k, u: F.concat(F.format_string("%.1f", F.bround(size.cast("double") / float(1024**k), 1)), F.lit(f" {u}"))
    return ladder([(size < 1024 ** (k + 1), told(k, u)) for k, u in enumerate(units[:-1])], told(len(units) - 1, units[-1]))


def nested(json: Column, *keys: str) -> Column:
    """A nested value of a JSON text as a string; lists of values become their told items, joined by ', '; null where a step is missing."""
    found = F.get_json_object(json, "$" + "".join(f"['{k}']" for k in keys))
    items = F.from_json(found, "array<string>")
    return F.when(found.startswith("["), F.array_join(F.filter(items, lambda v: v.isNotNull() & (v != "")), ", ")).otherwise(found)


def accession_of(name: Column, patterns: Sequence[str] = (r"^GSE\d+$", r"^E-\w+-\d+$")) -> Column:
    """The study accession of a file name: its first underscored token that a pattern finds, else its first two or three joined by hyphens; null without one."""
    base = F.element_at(F.split(name, "/"), -1)
    stem = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    parts = F.split(stem, "_")
    fits = lambda t: ladder([(F.rlike(t, F.lit("|".join(f"(?:{p})" for p in patterns))), F.lit(True))], F.lit(False))
    token = F.get(F.filter(parts, fits), F.lit(0))
    joined = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, 1, n), "-")) for n in (2, 3)]
    return F.coalesce(token, *[F.when(j.isNotNull() & fits(j), j) for j in joined])


def accession_on_path(path: Column, patterns: Sequence[str] = (r"^GSE\d+$", r"^E-\w+-\d+$")) -> Column:
    """The accession of a file's own name, else of the nearest folder above it that is one."""
    folders = F.reverse(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1))))
    fits = F.get(F.filter(folders, lambda t: F.rlike(t, F.lit("|".join(f"(?:{p})" for p in patterns)))), F.lit(0))
    return F.coalesce(accession_of(path, patterns), fits)


def signed_markers(sheet: DataFrame, genes: DataFrame) -> DataFrame:
    """tissue, cell_type, the sorted genes of its positive and negative symbols, and how many of each were mapped, of how many.

    sheet(tissue, cell_type, positive, negative, place) with comma lists, of which the last row of a type counts; genes(symbol,
    gene, place), of which the last one of a symbol counts. A symbol that a list repeats is mapped as often.
    """
    last = sheet.groupBy(F.trim("tissue").alias("tissue"), F.trim("cell_type").alias("cell_type")).agg(F.max_by(F.struct("positive", "negative"), "place").alias("r"))
    symbols = genes.where("trim(symbol) <> ''").groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(F.max_by("gene", "place").alias("gene"))
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    sides = last.select("tissue", "cell_type", F.explode(F.array(F.struct(F.lit("positive").alias("side"), listed(F.col("r.positive")).alias("l")), F.struct(F.lit("negative").alias("side"), listed(F.col("r.negative")).alias("l")))).alias("s"))
    each = sides.select("tissue", "cell_type", "s.side", F.explode_outer("s.l").alias("symbol")).join(symbols, "symbol", "left")
    side = lambda n: F.when(F.col("side") == n, F.col("gene"))
    total = lambda n: F.count(F.when(F.col("side") == n, F.col("symbol")))
    return each.groupBy("tissue", "cell_type").agg(
        *[F.array_sort(F.collect_set(side(n))).alias(n) for n in ("positive", "negative")], *[F.count(side(n)).alias(f"n_{n}_mapped") for n in ("positive", "negative")], *[total(n).alias(f"n_{n}_total") for n in ("positive", "negative")]
    )


def species_blocks(ours: DataFrame, human: DataFrame, key: Sequence[str], hotspot_q: float = 0.05, auc: float = 0.6, p: float = 0.05) -> DataFrame:
    """key with both species' scores, whether ours is a hotspot, the difference of AUC, and what became of it; hotspots first, then by AUC.

    ours(key, auc, p, q), human(key, auc, p).
    """
    side = lambda df, tag: df.select(*key, *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c not in key])
    both = side(ours, "ours").join(side(human, "human"), list(key), "left")
    status = ladder([(F.col("auc_human").isNull(), F.lit("no_human_block")), ((F.col("auc_human") >= auc) & (F.col("p_human") < p), F.lit("PRESERVED")), (F.col("auc_human") >= auc, F.lit("WEAKENED"))], F.lit("LOST"))
    return both.withColumn("is_hotspot", F.col("q_ours") < hotspot_q).withColumn("delta_auc", F.col("auc_human") - F.col("auc_ours")).withColumn("status", status)


def family_starts(tokens: DataFrame, vectors: DataFrame, families: DataFrame) -> DataFrame:
    """token, vector and start of every token: its own vector, else the mean of those of its families' members, else none."""
    dims = families.join(vectors, "token").select("family", F.posexplode("vector").alias("d", "x")).groupBy("family", "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    bare = tokens.join(vectors.select("token"), "token", "left_anti")
    sums = bare.join(families, "token").join(dims, "family").groupBy("token", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = sums.groupBy("token").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", (F.col("s") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("_mean"))
    out = tokens.join(vectors.select("token", F.col("vector").cast("array<double>").alias("_own")), "token", "left").join(means, "token", "left")
    return out.select("token", F.coalesce("_own", "_mean").alias("vector"), ladder([(F.col("_own").isNotNull(), F.lit("own")), (F.col("_mean").isNotNull(), F.lit("family"))], F.lit("none")).alias("start"))


def sample_table(cells: DataFrame, labels: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """cells(tissue, sample, ...) with the label at the sample's number in labels(tissue, place, label), and its sex, group and weeks from phenotypes(label, sex, group); NA where unknown."""
    place = F.regexp_replace("sample", r"\D", "").try_cast("long")
    first = phenotypes.groupBy("label").agg(F.min(F.struct("sex", "group")).alias("p"))
    out = cells.withColumn("place", place).join(labels, ["tissue", "place"], "left").join(first, "label", "left")
    group = F.coalesce(F.col("p.group"), F.lit("NA"))
    weeks = F.when(F.lower(group).contains("control"), 0).otherwise(F.regexp_extract(group, r"(\d+)", 1).try_cast("int"))
    return out.select(*cells.columns, "label", F.coalesce(F.col("p.sex"), F.lit("NA")).alias("sex"), group.alias("group"), weeks.alias("weeks"))


def inventory(samples: DataFrame, sources: Sequence[tuple[str, DataFrame]], fields: Sequence[str], key: str = "sample") -> DataFrame:
    """samples with each field from the first source that tells it, and the name of that source (none where no source does).

    sources: pairs of a name and a table(key, fields...), in order of precedence; of a source's rows for one key the least counts.
    """
    out = samples
    for name, df in sources:
        have = [f for f in fields if f in df.columns]
        out = out.join(df.groupBy(key).agg(*[F.min(F.nullif(F.trim(f), F.lit(""))).alias(f"_{name}_{f}") for f in have]), key, "left")
    picked = []
    for f in fields:
        told = [(name, F.col(f"_{name}_{f}")) for name, df in sources if f in df.columns]
        picked += [F.coalesce(*[c for _, c in told]).alias(f), ladder([(c.isNotNull(), F.lit(n)) for n, c in told], F.lit("none")).alias(f"{f}_source")]
    return out.select(*samples.columns, *picked)


def review_statistics(reviews: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: reviews, successful and failed ones, and how many of the successful ones each flag holds for."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return reviews.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), *[F.count_if(ok & F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


def quoted_cells(line: Column, separator: str = ",") -> Column:
    """The cells of one delimited line: a separator inside quotes separates nothing, quotes around a cell go and doubled ones are one."""
    s = "\\t" if separator == "\t" else "\\" + separator
    cells = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(rf'{s}((?:"(?:[^"]|"")*+")|[^{s}]*+)'), F.lit(1))
    return F.transform(cells, lambda c: F.when(F.rlike(c, F.lit('^".*"$')), F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def matrix_candidate(name: Column, skip: Sequence[str], patterns: Sequence[str], extensions: Sequence[str]) -> Column:
    """Whether a file is likely a matrix of counts: never with a word of skip in its name, else by a word of patterns or its ending."""
    low = F.lower(F.element_at(F.split(name, "/"), -1))
    has = lambda words, test: ladder([(test(w), F.lit(True)) for w in words], F.lit(False))
    return ~has(skip, low.contains) & (has(patterns, low.contains) | has(extensions, low.endswith))


def refined_selection(selected: DataFrame, tissue: str, include: str | None = None, pinned: Sequence[str] = (), failed: DataFrame | None = None) -> DataFrame:
    """Samples of a selection whose tissue is told so, whose title the pattern finds, without those that failed quality control, and of pinned ids only.

    A pinned id that is not among them is an error, as a build would silently do without it.
    """
    out = selected.where(F.lower(F.trim("tissue")) == tissue.lower())
    if include is not None:
        out = out.where(F.rlike(F.coalesce("title", F.lit("")), F.lit(f"(?i){include}")))
    if failed is not None:
        out = out.join(failed.select("sample_id"), "sample_id", "left_anti")
    if pinned:
        out = out.where(F.col("sample_id").isin(*pinned))
        found = {r[0] for r in out.select("sample_id").distinct().collect()}  # pinned ids at most
        if missing := sorted(set(pinned) - found):
            raise ValueError(f"pinned samples are not selectable: {missing}")
    return out


def split_summary(rows: DataFrame, by: Sequence[str], purity: str, value: str, at: float = 0.5) -> DataFrame:
    """n, median and mean of a value below and from a purity on."""
    side = F.when(F.col(purity) >= at, "high").otherwise("low").alias("purity_side")
    return rows.where(F.col(value).isNotNull()).groupBy(*by, side).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"), F.avg(value).alias("mean"))
