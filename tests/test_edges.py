"""Small cases of the engine's operators: nulls, ties, empty tables, known values."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cellweave.functions import naming as N
from cellweave.operators import corpus as K
from cellweave.operators import evaluation as V
from cellweave.operators import markers as M
from cellweave.operators import reports as R


def test_names_of_nothing(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(N.id_class(none).alias("c"), N.id_type(F.array().cast("array<string>")).alias("t"), N.id_type(F.lit(None).cast("array<string>")).alias("u"), N.modality(none).alias("m"), N.coarse_label(none, "brain").alias("l"), N.file_decision(none, F.lit(None).cast("boolean"), ("x",), ("y",)).alias("d")).first()
    assert (row.c, row.t, row.u, row.m, row.l) == ("unknown", "unknown", "unknown", "unknown", None)
    assert row.d.action == "skip_no_match"
    with pytest.raises(ValueError):
        N.coarse_label(none, "liver")


def test_normal_quantile_against_the_standard_library(spark):
    values = [1e-300, 1e-12, 0.001, 0.02, 0.03, 0.31, 0.5, 0.77, 0.98, 0.999]
    got = spark.createDataFrame([(v,) for v in values], "p double").select("p", V.normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-8, abs=1e-8)
    assert spark.range(1).select(V.normal_quantile(F.lit(0.0)).alias("z")).first().z is None


def test_silhouette_of_small_classes(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 0.0], "b"), (5, None, "a"), (6, [1.0, 1.0], None)], "k int, v array<double>, l string")
    got = {r.k: r.silhouette for r in V.cosine_silhouette(rows, "k", "v", "l").collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(1.0), 3: 0.0}  # the zero, null and unlabelled rows take no part
    one_class = V.cosine_silhouette(rows.where("l = 'a'"), "k", "v", "l").collect()
    assert all(r.silhouette is None for r in one_class)


def test_rand_index_of_equal_labels_and_of_nothing(spark):
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "x string, y int")
    assert V.adjusted_rand(same, "x", "y").first().asDict() == {"n": 3, "ari": 1.0}
    assert V.adjusted_rand(same.where("false"), "x", "y").first().n is None


def test_enrichment_by_a_plain_running_sum(spark):
    stats = [("b", g, s) for g, s in zip("abcdefg", (3.0, 2.5, 2.5, 0.4, -0.2, -1.0, None), strict=True)]
    got = V.enrichment_score(spark.createDataFrame(stats, "block string, gene string, stat double"), spark.createDataFrame([("s", "b"), ("s", "e"), ("s", "b"), ("t", "f"), ("u", "zz")], "name string, gene string"), ["block"]).collect()
    # s: a misses (-1/4), b hits (+2.5/2.7), c and d miss, e hits; t: five misses before its only gene.
    assert {r.name: (r.size, r.es) for r in got} == {"s": (2, pytest.approx(2.5 / 2.7 - 0.25)), "t": (1, pytest.approx(-1.0))}


def test_drivers_and_slopes_with_ties_and_one_dose(spark):
    rows = spark.createDataFrame([("t", "b", 2.0), ("t", "a", 2.0), ("t", "c", 1.0), ("u", "a", 1.0)], "tissue string, kind string, rmse double")
    plain = rows.withColumn("rmse", F.lit(0.0))
    got = {r.tissue: (r.driver, r.rest_median) for r in V.bias_drivers(rows, plain, ["tissue"], "kind", "rmse").collect()}
    assert got == {"t": ("a", 1.5), "u": ("a", None)}
    assert V.dose_slope(rows.withColumn("dose", F.lit(1)), ["tissue"], "dose", "rmse").where("slope is null").count() == 2


def test_labels_without_scores_gates_or_merges(spark):
    scores = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 1.0, 0), (2, "a", 2.0, 1)], "cell int, label string, score double, place int")
    gates = spark.createDataFrame([(1, "b"), (1, "b"), (2, "a")], "cell int, label string")
    got = {r.cell: (r.label, r.gated) for r in M.gated_label(scores, gates, F.col("label") == "a").collect()}
    assert got == {1: ("a", True), 2: ("a", True)}
    only_b = {r.cell: (r.label, r.gated) for r in M.gated_label(scores, gates, F.col("label") == "b").collect()}
    assert only_b[2] == ("a", False)  # no fallback score: the first label stays
    assert M.gated_label(scores.where("false"), gates, F.lit(True)).count() == 0
    types = spark.createDataFrame([("T cells", 0), ("B cells", 1)], "type string, place int")
    got = {r.label: r.type for r in M.harmonise(spark.createDataFrame([("Naive T cells",), ("Skeletal",), (None,), ("macrophage",)], "label string"), types).collect()}
    assert got == {"Naive T cells": "T cells", "Skeletal": None, None: None, "macrophage": None}


def test_catalog_operators_on_empty_and_null(spark):
    empty = spark.createDataFrame([], "k string, n_genes long, n_cells long, n_samples long, confidence string, unfiltered boolean")
    assert R.best_matrices(empty, "k").count() == 0
    none = spark.createDataFrame([("s", 10, None, None, None, None)], empty.schema)
    assert R.best_matrices(none, "k").first().asDict() == {"k": "s", "n_genes": None, "n_cells": None, "n_samples": None, "confidence": None, "data_type": None, "only_unfiltered": False}
    assert {r.field: r.n_null for r in R.missing_values(none, ["n_cells", "n_genes"]).collect()} == {"n_cells": 1, "n_genes": 0}
    twice = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="left side"):
        R.one_to_one(twice, twice.distinct(), ["k"])


def test_token_tables_refuse_clashes_and_gaps(spark):
    known = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    make = lambda *rows: spark.createDataFrame(list(rows), "token string, id int")
    assert K.merge_dictionaries(known, make(("a", 0), ("c", 2), ("d", 3)), 2).count() == 4
    with pytest.raises(ValueError, match="both"):
        K.merge_dictionaries(known, make(("a", 2)), 2)
    with pytest.raises(ValueError, match="not on from"):
        K.merge_dictionaries(known, make(("c", 2), ("d", 4)), 2)
    assert K.merge_dictionaries(known, make(("a", 0)), 2).count() == 2


def test_masking_leaves_padding_and_draws_its_share(spark):
    rows = spark.createDataFrame([(1, [5, 6, 0], [0.5, 0.25, 0.0])], "k long, ids array<long>, v array<double>")
    m = rows.select(K.masked(F.col("ids"), F.col("v"), F.array(F.lit(True), F.lit(None).cast("boolean"), F.lit(True))).alias("m")).first().m
    assert (m["input_ids"], m["values"], m["labels"]) == ([1, 6, 0], [0.0, 0.25, 0.0], [5, -100, -100])
    drawn = spark.range(200).select(K.drawn_positions(F.array_repeat(F.lit(7), 100), F.col("id"), 0.15).alias("d")).select(F.explode("d").alias("d"))
    assert 0.13 < drawn.where("d").count() / 20_000 < 0.17


def test_promoters_at_the_ends(spark):
    genome = spark.createDataFrame([("1", 0, "ACGT"), ("1", 1, "ttNN"), ("1", 2, "GG")], "chrom string, chunk int, seq string")
    genes = spark.createDataFrame([("a", "1", 2, 1), ("b", "1", 9, -1), ("c", "2", 5, 1), ("d", None, None, 1), ("e", "1", 60, 1), ("f", "1", 3, -1)], "gene string, chrom string, tss int, strand int")
    got = {r.gene: (r.sequence, r.reason) for r in K.promoters(genes, genome, 4, 3, 2, 0.5).collect()}
    assert got["a"] == ("ACGTN", None)  # from the chromosome's first letter, filled up
    assert got["f"] == ("AAACGT", None)  # a whole window counts both ends
    assert got["b"] == (None, "high_n_fraction")  # CCNN, filled up to CCNNN
    assert [got[g][1] for g in "cde"] == ["chrom_not_found", "no_tss_coordinate", "high_n_fraction"]
