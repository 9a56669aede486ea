"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from cellweave.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(f.removesuffix(".parquet") for f in os.listdir(SF) if f.endswith(".parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    ours = tidy(registry.QUERIES[name](spark, SF).toPandas())
    theirs = tidy(duck.execute(registry.SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs) > 0
    for c in ours.columns:  # rounded values must agree to the last place, and nulls stand in the same rows
        a, b = ours[c], theirs[c]
        assert (a.isna() == b.isna()).all(), c
        same = (a == b) | a.isna() if a.dtype != object else pd.Series([str(x) == str(y) or x == y for x, y in zip(a, b, strict=True)]) | a.isna()
        assert same.all(), (c, a[~same].head(3).tolist(), b[~same].head(3).tolist())


def test_priority_promotion_at_small_sizes(spark):
    from cellweave.operators.expression import promote_priority

    ranked = spark.createDataFrame([(1, r, g, 1.0) for r, g in enumerate((11, 12, 20, 13, 30, 40), 1)] + [(2, 1, 20, 1.0), (2, 2, 30, 1.0), (2, 3, 40, 1.0)], "cell long, rank int, gene long, value double")
    priority = spark.createDataFrame([(20,), (30,), (40,)], "gene long")
    got = promote_priority(ranked, priority, base=2, window=5).collect()
    assert {(r.cell, r.gene) for r in got} == {(1, 20), (1, 30), (2, 20), (2, 30)}  # 40 is beyond cell 1's window


def test_new_operators_on_edges(spark):
    from pyspark.sql import functions as F

    from cellweave.functions import labels as L
    from cellweave.operators import annotation as A
    from cellweave.operators import scoring as S

    one = spark.createDataFrame([("a", None, 1.0), ("a", 5.0, 1.0), ("b", None, None)], "g string, x double, y double")
    assert [(r.g, r.n, r.q1) for r in S.index_quartiles(one, ["g"], "x").collect()] == [("a", 1, 5.0)]
    flat = S.scaled(one.where("x is not null or y is not null").na.fill(1.0), ["g"], "y").collect()
    assert all(r.z == 0 for r in flat)
    got = one.limit(1).select(S.binomial_tail(F.lit(3), F.lit(2), F.lit(0.5)).alias("none_left"), S.binomial_tail(F.lit(0), F.lit(0), F.lit(0.5)).alias("no_trial"), S.hypergeometric_tail(F.lit(1), F.lit(10), F.lit(0), F.lit(4)).alias("unmarked"), L.title_check(F.lit(None).cast("string")).alias("title"), L.fuzzy_match(F.lit("Liver"), F.lit("")).alias("fuzzy")).first()
    assert (got.none_left, got.no_trial, got.unmarked, got.title, got.fuzzy) == (0.0, None, 1.0, "warn:unknown", 0)
    votes = spark.createDataFrame([], "s string, kind string")
    assert A.majority(votes, ["s"], "kind").count() == 0
    assert A.drop_small(spark.createDataFrame([(1, None, "x"), (2, "Unknown", "x"), (3, "T cell", "x")], "cell int, label string, state string"), "label", "state", 1).count() == 1
