"""Whole jobs: what a query reads, and results that must not hang on how a table is cut."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F


def test_gene_vectors_are_of_all_pairs_of_all_families(spark, monkeypatch):
    from cellweave.operators import families as Y
    from cellweave.operators import representation as R
    from cellweave.plans import registry

    rows = [(f"f{g // 8}", f"g{g:03d}") for g in range(64)] + [("f0", "g009"), ("f0", "g010"), ("f1", "g001"), ("f1", "g001"), (None, "g000"), ("alone", "x")]
    families = spark.createDataFrame(rows, "family string, gene string")
    monkeypatch.setattr(Y, "TILE", 3)  # families are cut to tiles, and parts to a few families
    monkeypatch.setattr(Y, "MEMBERS", 30)
    vectors = Y.family_vectors(families, size=16, epochs=8, step=0.1).localCheckpoint()
    assert vectors.count() == 64
    got, want = Y.family_auc(vectors, families).first(), R.family_check(vectors, families).first()
    assert (got.n_pos, got.n_neg) == (want.n_pos, want.n_neg) == (246, want.n_neg) and got.auc > 0.7
    assert all(abs(got[c] - want[c]) < 1e-9 for c in ("mean_real", "mean_null", "auc"))
    sf = "/root/testdata/sf0.001"
    told = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("g")).collect()
    pairs = {p for r in told for p in combinations(sorted(r.g), 2)}
    assert registry.QUERIES["gene_vector_check"](spark, sf).first().n_pos == len(pairs)  # a tenth of the parts of a supplier before


def test_family_pairs_send_no_side_to_the_driver(spark, tmp_path):
    from cellweave.plans import registry

    spark.range(3_000).selectExpr("id AS p_partkey", "'b' AS p_brand", "cast(id % 300 AS int) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    out = registry.QUERIES["family_pairs"](spark, str(tmp_path))
    assert out.count() == 300 * 45 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_matched_null_counts_without_making_pairs(spark):
    import numpy as np

    from cellweave.operators import regulation as R

    draw = np.random.default_rng(2)
    rows = [(k, float(v), float(s)) for k, (v, s) in enumerate(zip(np.round(draw.gamma(4, 5, 900), 1), np.round(draw.normal(size=900), 1), strict=True))] + [(900, 0.0, 1.0), (901, 20.0, None), (902, 1e6, 0.0)]
    genes = spark.createDataFrame(rows, "gene long, value double, shift double")
    out = R.matched_null(genes, genes.where("gene % 7 = 1 or gene >= 900"))
    want = {}
    for f, fv, fs in rows:
        met = [s for g, v, s in rows if (f % 7 == 1 or f >= 900) and fv > 0 and v > 0 and g != f and abs(v - fv) < 0.15 * fv]
        if met:
            want[f] = (len(met), sum(s is not None and fs is not None and s < fs for s in met) / len(met) * 100)
    got = {r.focal: (r.n_matched, r.percentile) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert "bin" in out._jdf.queryExecution().optimizedPlan().toString() and "FlatMapCoGroups" in out._jdf.queryExecution().optimizedPlan().toString()  # a join of pairs before


def test_shifts_are_summed_in_the_order_of_rows(spark, tmp_path):
    import duckdb

    from cellweave.plans import registry

    con = duckdb.connect()
    con.sql("SET threads = 1")  # with more, DuckDB itself adds up in another order in each run
    for k in range(4):
        con.sql(f"COPY (SELECT CAST(i % 150 AS BIGINT) l_partkey, 20.0 + i % 5 l_quantity, (i // 150 + i % 150 * 3) % 80 % 11 / 100 l_discount FROM range({k * 3000}, {k * 3000 + 3000}) t(i)) TO '{tmp_path}/p{k}.parquet' (FORMAT parquet)")
    con.sql(f"COPY (FROM '{tmp_path}/p*.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    con.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")  # several tasks read the table
    try:
        got = sorted(map(tuple, registry.QUERIES["matched_null"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == sorted(con.sql(registry.SQL["matched_null"]).fetchall())
