"""Readers of public formats into tidy tables. All parsing is Spark SQL over text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import ladder

# File name endings and the formats that they mark, in order of precedence.
FORMATS = ((".h5ad", "h5ad"), (".mtx", "mtx"), (".mtx.gz", "mtx"), (".h5", "h5"), (".loom", "loom"), (".tsv", "tsv"), (".tsv.gz", "tsv"), (".txt", "tsv"), (".txt.gz", "tsv"), (".csv", "csv"), (".csv.gz", "csv"))


def file_format(name: Column) -> Column:
    """Format of a matrix file by its ending, else null."""
    low = F.lower(name)
    return ladder((low.endswith(end), F.lit(kind)) for end, kind in FORMATS)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (rising, not dense, in file order) and text of text files.

    A file's splits are ordered by where they start; inside a split the row ids rise.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    # The low 33 bits number the rows of a task; starts are unique in a file.
    return lines.select("file", F.struct("start", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("row")).alias("line"), F.col("value").alias("text"))


def mtx(spark: SparkSession, matrix: str, features: str, barcodes: str) -> DataFrame:
    """counts(cell, gene, count) of a MatrixMarket file or folder of parts, with its features and barcodes (first column counts).

    The first line that is no comment in a file with the format's banner holds the dimensions. Names meet entries by
    their line numbers; the parts of a list go on in the order of their names.
    """
    lines = numbered_lines(spark, matrix).where(F.trim("text") != "").withColumn("comment", F.col("text").startswith("%"))
    banner = F.bool_or(F.col("text").startswith("%%MatrixMarket"))
    heads = lines.groupBy("file").agg(banner.alias("banner"), F.min(F.when(~F.col("comment"), F.col("line"))).alias("head")).where("banner").select("file", "head")  # a row for each file
    entries = lines.where("not comment").join(heads, "file", "left").where("head is null or line <> head").select(F.split(F.trim("text"), r"\s+").alias("v"))
    entries = entries.select(F.col("v")[0].cast("long").alias("i"), F.col("v")[1].cast("long").alias("j"), F.col("v")[2].cast("double").alias("count"))

    def names(path: str, out: str, at: str) -> DataFrame:
        own = numbered_lines(spark, path)
        files = own.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row for each file
        local = F.row_number().over(Window.partitionBy("file").orderBy("line"))
        return own.join(before, "file").select(F.split("text", "\t")[0].alias(out), (local + F.col("before")).alias(at))

    return entries.join(names(features, "gene", "i"), "i").join(names(barcodes, "cell", "j"), "j").select("cell", "gene", "count")


def delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """counts(cell, gene, count) of a delimited matrix, genes in rows or in columns; zeros and blanks are left out.

    Genes are rows where the first data row starts with a gene: an Ensembl id, or a name with a capital that is no number.
    """
    wide = spark.read.csv(path, header=True, sep=sep)
    first, *others = wide.columns
    row = wide.select(F.col(f"`{first}`").alias("x")).first()
    name = (row["x"] or "").strip() if row else ""
    by_row = name.startswith(("ENSRNOG", "ENSMUSG", "ENSG")) or (name[:1].isupper() and not name.replace(".", "").replace("-", "").isdigit())
    a, b = ("gene", "cell") if by_row else ("cell", "gene")
    long = wide.select(F.trim(F.col(f"`{first}`")).alias(a), *[F.col(f"`{c}`") for c in others]).unpivot(a, others, b, "count")
    return long.select("cell", "gene", F.col("count").try_cast("double").alias("count")).where("count <> 0")


def soft(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Series (file, title, summary, organisms, platforms, tissues) and samples (file, sample, title) of family records.

    A sample's lines are those after its ^SAMPLE line; the owner is filled within a file.
    """
    lines = numbered_lines(spark, path).withColumn("text", F.trim("text"))
    value = F.trim(F.regexp_extract("text", "=(.*)$", 1))
    running = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("value", value).withColumn("sample", F.last(F.when(F.col("text").startswith("^SAMPLE"), F.trim(F.element_at(F.split("text", "="), -1))), ignorenulls=True).over(running))
    tag = lambda *t: F.rlike("text", F.lit("^(" + "|".join(t) + ")"))
    key, told = F.lower(F.trim(F.split_part("value", F.lit(":"), F.lit(1)))), F.trim(F.regexp_extract("value", ":(.*)$", 1))
    tissue = F.when(tag("!Sample_source_name"), F.nullif("value", F.lit(""))).when(tag("!Sample_characteristics_ch1") & key.isin("tissue", "cell type", "organ", "tissue type"), told)
    every = lambda c: F.array_sort(F.collect_set(c))
    series = lines.groupBy("file").agg(
        F.max_by(F.when(tag("!Series_title"), F.col("value")), F.when(tag("!Series_title"), F.col("line"))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(tag("!Series_summary"), F.struct("line", "value")))), lambda s: s["value"]), " ").alias("summary"),
        every(F.when(tag("!Series_organism", "!Sample_organism"), F.nullif("value", F.lit("")))).alias("organisms"),
        every(F.when(tag("!Series_platform_id"), F.col("value"))).alias("platforms"),
        every(tissue).alias("tissues"),
    )
    samples = lines.where("sample is not null").groupBy("file", "sample").agg(F.max(F.when(tag("!Sample_title"), F.col("value"))).alias("title"))
    return series, samples


def archive_listing(spark: SparkSession, path: str) -> DataFrame:
    """file, line, kind, name, time, size, type and archive (the last Archive line before a File line) of lists of archives' files.

    Header lines and lines of fewer than five cells are passed over; a size that is no number is 0.
    """
    lines = numbered_lines(spark, path).where("not startswith(text, '#') and not startswith(text, 'Archive/File')").withColumn("c", F.transform(F.split("text", "\t"), lambda x: F.trim(x))).where("size(c) >= 5")
    cells = lines.select("file", "line", *[F.col("c")[i].alias(n) for i, n in enumerate(("kind", "name", "time", "size", "type"))]).withColumn("size", F.coalesce(F.col("size").try_cast("long"), F.lit(0)))
    running = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == "Archive", F.col("name")), ignorenulls=True).over(running)
    return cells.withColumn("archive", F.when(F.col("kind") == "File", owner))


def catalog(spark: SparkSession, path: str, rows: str, key: str = "accession") -> DataFrame:
    """The rows under one field of JSON files, one for each key: the last of its file, and of the last file."""
    found = spark.read.json(path, multiLine=True).select(F.col("_metadata.file_path").alias("_file"), F.posexplode(rows).alias("_pos", "_row"))
    return found.groupBy(F.col(f"_row.{key}").alias("_key")).agg(F.max_by("_row", F.struct("_file", "_pos")).alias("r")).select("r.*")
