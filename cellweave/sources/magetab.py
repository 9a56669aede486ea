"""MAGE-TAB files: investigation descriptions, and sample tables whose columns differ from file to file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import numbered_lines

#: Field names, fixed values of the format.
TITLES = ("investigation title", "experiment name", "study title")
SUMMARIES = ("experiment description", "investigation description", "study description")
DATES = ("public release date", "date of experiment", "submission date")
TISSUES = ("tissue", "organ part", "organ site", "cell type", "body part", "anatomical", "sample source", "material type")


def idf(spark: SparkSession, path: str) -> DataFrame:
    """file, title, summary, pubmed_ids and submission_date of investigation files; of repeated fields the last with a value counts."""
    lines = numbered_lines(spark, path).withColumn("text", F.trim("text")).where("text <> '' and not startswith(text, '#')")
    cells = F.split("text", "\t")
    told = lines.select("file", "line", F.trim(F.lower(F.get(cells, F.lit(0)))).alias("field"), F.trim(F.get(cells, F.lit(1))).alias("value")).where("value <> ''")
    last = lambda names: F.max_by(F.when(F.col("field").isin(*names), F.col("value")), F.when(F.col("field").isin(*names), F.col("line")))
    pubmed = F.when(F.contains("field", F.lit("pubmed")) & F.rlike("value", F.lit(r"^\d+$")), F.struct("line", "value"))
    files = lines.select("file").distinct()
    out = told.groupBy("file").agg(last(TITLES).alias("title"), last(SUMMARIES).alias("summary"), F.transform(F.array_sort(F.collect_list(pubmed)), lambda s: s["value"]).alias("pubmed_ids"), last(DATES).alias("submission_date"))
    return files.join(out, "file", "left").withColumn("pubmed_ids", F.coalesce("pubmed_ids", F.array().cast("array<string>")))


def tidy(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """file, line, place, column and value of delimited files, each with a header of its own; missing cells are null.

    Quotes around a cell are taken off and doubled ones inside halved. A column name that a file repeats stands for the last of
    its columns. Only header rows meet all rows of their file, so files of any width are read in one scan.
    """
    cell = lambda c: F.when(F.rlike(c, F.lit('^".*"$')), F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    lines = numbered_lines(spark, path).where("trim(text) <> ''").withColumn("cells", F.transform(F.split(F.regexp_replace("text", "\r$", ""), separator), cell))
    first = lines.groupBy("file").agg(F.min_by("cells", "line").alias("header"), F.min("line").alias("first"))
    rows = lines.join(first, "file").where("line > first").select("file", "line", "cells", F.posexplode("header").alias("place", "column"))
    rows = rows.withColumn("value", F.get("cells", F.col("place"))).drop("cells")
    return rows.withColumn("_last", F.max("place").over(Window.partitionBy("file", "line", "column"))).where("place = _last").drop("_last")


def sdrf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples (file, line, sample: the first name column with a value) and studies (file, organisms, tissues) of sample tables."""
    cells = tidy(spark, path).withColumn("_c", F.lower("column")).where("value <> ''")
    has = lambda *words: F.greatest(*[F.contains("_c", F.lit(w)) for w in (*words, words[0])])
    organism = has("organism")
    names = cells.where(has("source name", "sample name")).groupBy("file", "line").agg(F.min_by("value", "place").alias("sample"))
    every = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.trim("value"))))
    studies = cells.groupBy("file").agg(every(organism).alias("organisms"), every(~organism & has(*TISSUES)).alias("tissues"))
    return names, studies


def characteristics(spark: SparkSession, path: str) -> DataFrame:
    """sample, title, source_name, organism and one row for each attribute of sample tables: columns characteristics_ch1.N.{attribute}."""
    cells = tidy(spark, path)
    fixed = {"geo_accession": "sample", "title": "title", "source_name_ch1": "source_name", "organism_ch1": "organism"}
    heads = cells.groupBy("file", "line").agg(*[F.max(F.when(F.col("column") == c, F.trim("value"))).alias(n) for c, n in fixed.items()]).where("startswith(sample, 'GSM')")
    parts = F.split("column", r"\.")
    name = F.when(F.size(parts) > 2, F.element_at(parts, -1)).otherwise(F.col("column"))
    own = cells.where(F.contains(F.lower("column"), F.lit("characteristics_ch1")) & (F.trim("value") != "")).select("file", "line", "place", F.lower(name).alias("attribute"), F.trim("value").alias("value"))
    return heads.join(own, ["file", "line"], "left").select("sample", "title", "source_name", "organism", "place", "attribute", "value")


def structured(attributes: DataFrame, patterns: dict[str, str], tissues: list[tuple[str, str]]) -> DataFrame:
    """sample and one column for each target: the value of the first attribute that its pattern finds; tissue otherwise from title and source by the first word found.

    attributes as characteristics() gives them; a repeated attribute stands at its first place with its last value.
    """
    own = attributes.groupBy("sample", "title", "source_name", "attribute").agg(F.min("place").alias("place"), F.max_by("value", "place").alias("value"))
    first = [F.min_by(F.when(F.rlike("attribute", F.lit(p)), F.col("value")), F.when(F.rlike("attribute", F.lit(p)), F.col("place"))).alias(t) for t, p in patterns.items()]
    out = own.groupBy("sample", "title", "source_name").agg(*first)
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("source_name", F.lit(""))))
    found: Column = F.lit(None).cast("string")
    for word, tissue in reversed(tissues):
        found = F.when(text.contains(word), F.lit(tissue)).otherwise(found)
    return out.withColumn("tissue", F.coalesce("tissue", found)) if "tissue" in patterns else out.withColumn("tissue", found)
