"""What must stay cheap or exact as tables grow, on small cases that show it."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cellweave.functions import tails
from cellweave.operators import linear as L


def test_continued_fraction_ends_for_many_degrees_of_freedom():
    df = 59_990.0
    f = np.random.default_rng(0).f(2, df, 4_000)
    start = time.perf_counter()
    got = tails._regularised(*(tails.pd.Series(v) for v in (np.full(4_000, df / 2), np.ones(4_000), df / (df + 2 * f))))
    assert time.perf_counter() - start < 2  # values that trembled around their limit took all 100,000 steps
    assert np.allclose(got, (1 + 2 * f / df) ** (-df / 2), rtol=1e-8, atol=1e-300)


def test_fits_of_a_batch_of_genes_are_products_of_matrices():
    n, rng = 20_000, np.random.default_rng(1)
    cells = [{"cell": k, "vars": {"sex": k % 2, "week": k % 3}, "n": 5} for k in range(6)]
    s, q = rng.normal(size=(n, 6)), 10 + rng.random((n, 6))
    sums = [[{"cell": k, "s": s[g, k], "q": q[g, k]} for k in range(6)] for g in range(n)]
    struct = pa.struct([("cell", pa.int64()), ("s", pa.float64()), ("q", pa.float64())])
    held = pa.struct([("cell", pa.int64()), ("vars", pa.struct([("sex", pa.int64()), ("week", pa.int64())])), ("n", pa.int64())])
    columns = {"gene": pa.array([None, *range(n)]), "n_nonzero": pa.array([None] + [6] * n), "_s": pa.array([None, *s.sum(1)]), "_base": pa.array([None] + [1.0] * n), "sums": pa.array([None, *sums], pa.list_(struct)), "cells": pa.array([cells] + [None] * n, pa.list_(held))}
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    model = L.Model("slope", factors=("sex",), numbers=("week",), tested=("week",))
    start = time.perf_counter()
    out = pa.Table.from_batches(list(L._fit([model], 2)(iter([batch])))).to_pydict()
    assert time.perf_counter() - start < 0.5 and len(out["gene"]) == n  # row by row it took a task 20 times as long
    x = np.array([[1, k % 2, k % 3] for k in range(6)], float)
    want = np.linalg.solve(x.T @ (5 * x), x.T @ s[7])[2]
    assert out["n"][7] == 30 and out["df"][7] == 27 and abs(out["estimate"][7] - want) < 1e-9 and abs(out["mean"][7] - 1 - s[7].sum() / 30) < 1e-12


def test_nearest_sends_blocks_to_groups_not_to_blocks(spark, monkeypatch):
    from cellweave.operators import representation as R

    x = np.random.default_rng(3).normal(size=(300, 4))
    table = spark.createDataFrame([(int(k), [float(v) for v in x[k // 2 * 2]]) for k in range(300)], "key long, vector array<double>")
    sent, run = [], type(table).mapInArrow
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, f, schema: sent.append(self.count()) or run(self, f, schema))
    got = {(r.key, r["rank"]): r.near for r in R.nearest(table, 5, block=3).collect()}
    d = np.round(((x[None, ::2] - x[::2, None]) ** 2).sum(-1), 9).repeat(2, 0).repeat(2, 1)
    np.fill_diagonal(d, np.inf)
    want = {(k, r + 1): int(j) for k in range(300) for r, j in enumerate(np.argsort(d[k], kind="stable")[:5])}
    assert got == want and sent[0] <= 100 * 33  # 10,000 pairs of blocks before


def test_pairs_of_families_are_told_once_without_a_shuffle_of_pairs(spark):
    from cellweave.operators import representation as R

    rows = [(f, g) for f in range(6) for g in range(40) if (g * 7 + f) % 5 < 2 or g == 3] + [(0, 3), (None, 1), (2, None)]
    out = R.family_pairs(spark.createDataFrame(rows, "family int, gene int"))
    known = {(f, g) for f, g in rows if f is not None and g is not None}
    want = sorted({(a, b) for f, a in known for h, b in known if f == h and a < b})
    assert sorted(map(tuple, out.collect())) == want
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_sizes_end_with_the_largest_unit_given(spark):
    from cellweave.operators import records as K

    row = spark.range(1).select(K.human_size(F.lit(5 * 1024.0**4), ("B", "KB", "MB", "GB")).alias("a"), K.human_size(F.lit(5 * 1024.0**4)).alias("b"), K.human_size(F.lit(3 * 1024.0**6)).alias("c")).first()
    assert tuple(row) == ("5120.0 GB", "5.0 TB", "3072.0 PB")


def test_suppliers_beyond_the_pretrained_ids_are_of_the_stage(spark, tmp_path):
    from cellweave.plans import registry

    one = lambda name, sql: spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    one("supplier", "SELECT id AS s_suppkey FROM range(150)")
    one("part", "SELECT id AS p_partkey FROM range(200)")
    one("embeddings", "SELECT id AS vec_id, array(cast(id AS float)) AS embedding FROM range(200)")
    got = {r.id: (r.token, r.source, r["first"]) for r in registry.QUERIES["embedding_table"](spark, str(tmp_path)).collect()}
    assert (got[99], got[100], got[101], got[102], got[151]) == (("h99", "pretrained", 99.0), ("h100", "stage", 390.0), ("h101", "stage", 393.9), ("h102", "zero", 0.0), ("r151", "stage", 588.9))


def test_ties_of_rounding_are_those_of_sql(spark):
    import duckdb

    from cellweave.functions.stats import half_up

    values = [k + 0.00005 + j / 10_000 for k in range(20_000, 20_400) for j in range(20)] + [-2.00005, 0.0]
    told = duckdb.sql(f"SELECT round(round(v, 7), 4) r FROM (SELECT unnest({values}::DOUBLE[]) v)").fetchall()
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(half_up(half_up(F.col("v"), 7), 4).alias("r")).collect()
    assert [r.r for r in got] == [r for (r,) in told]


def test_shards_are_padded_as_they_are_written(spark, tmp_path, monkeypatch):
    from cellweave.operators import expression as E
    from cellweave.sources import sinks

    ranked = spark.createDataFrame([(c, r, 10 * c + r, 0.5 * r) for c in range(20) for r in range(1, 1 + c % 4 + 1)], "cell long, rank int, gene long, value double")
    monkeypatch.setattr(sinks, "new_folder", lambda spark, name: str(tmp_path / name))
    sinks.token_shards(E.token_lists(ranked), str(tmp_path / "shards"), 7, "cell", lambda rows: E.padded(rows, 64))
    parts, shards = (spark.read.parquet(str(tmp_path / n)) for n in ("parts", "shards"))
    assert parts.agg(F.max(F.size("input_ids"))).first()[0] == 4  # sorted and stored at full length before
    assert [tuple(r) for r in shards.orderBy("cell").select("cell", "cell_index", F.size("input_ids"), F.size("values"), "n_tokens").collect()] == [(c, c, 64, 64, c % 4 + 1) for c in range(20)]
    assert shards.orderBy("cell").select("input_ids", "values", "n_tokens").exceptAll(E.pad_tokens(ranked, 64).select("input_ids", "values", "n_tokens")).count() == 0


def test_gene_vectors_share_pairs_among_tasks_and_cosines_are_made_once(spark, monkeypatch):
    from cellweave.operators import evaluation as V
    from cellweave.operators import representation as R

    told, made = [], R.Word2Vec
    monkeypatch.setattr(R, "Word2Vec", lambda **k: told.append(k["numPartitions"]) or made(**k))
    monkeypatch.setattr(R, "TRAINED", 100, raising=False)
    families = spark.createDataFrame([(f"f{g // 8}", f"g{g:03d}") for g in range(64)], "family string, gene string")
    vectors = R.gene_vectors(R.family_pairs(families), size=8, epochs=2)
    assert told == [3] and vectors.count() == 64  # 224 pairs; one task had them all
    seen = spark.sparkContext.accumulator(0)
    passed = F.udf(lambda a: seen.add(1) or a, "long").asNondeterministic()
    x = np.random.default_rng(5).normal(size=(40, 6))
    x[7] = 0
    table = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in enumerate(x)], "key long, vector array<double>")
    keys = table.select(F.col("key").alias("a"), (F.col("key") * 3 % 40).alias("b")).localCheckpoint()
    out = V.paired_auc(table, keys.where("a < 20").withColumn("a", passed("a")), keys.where("a >= 20")).first()
    assert seen.value == 20  # each cosine was made for means, ranges, their sums and ranks
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    pairs = [(a, a * 3 % 40) for a in range(40) if 7 not in (a, a * 3 % 40)]
    c = {k: np.array([round(float(u[a] @ u[b]), 9) for a, b in pairs if (a < 20) == k]) for k in (True, False)}
    wins = (c[True][:, None] > c[False]).sum() + (c[True][:, None] == c[False]).sum() / 2
    assert (out.n_pos, out.n_neg) == (len(c[True]), len(c[False])) and abs(out.auc - wins / len(c[True]) / len(c[False])) < 1e-12
    assert abs(out.mean_real - c[True].mean()) < 1e-9 and abs(out.mean_null - c[False].mean()) < 1e-9
    assert V.paired_auc(table, keys.where("a < 0"), keys.where("a < 0")).count() == 0


def test_token_lists_are_gathered_without_a_window(spark):
    from cellweave.operators import expression as E
    from cellweave.plans import registry

    rows = [(c, g, float((c * 7 + g * 5) % 4)) for c in range(30) for g in range(1, 12)] + [(31, 3, float("nan")), (31, 4, 2.0), (31, 5, 2.0)]
    counts = spark.createDataFrame(rows, "cell long, gene long, count double")
    medians = spark.createDataFrame([(g, 1.0 + g % 3) for g in range(11)], "gene long, median double")
    for longest in (3, 2048):
        want, got = E.token_lists(E.rank_tokens(counts, medians, longest)), E.ranked_lists(counts, medians, longest)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for name in ("tokenize_padded", "masked_tokens"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "filter(" not in plan  # each was sorted, ranked and gathered; zeros went one by one through a lambda


def test_promotion_counts_in_one_order(spark):
    from cellweave.operators import expression as E

    rows = [(c, r, (c * 13 + r * 7) % 50) for c in range(25) for r in range(1, 2 + c)]
    ranked = spark.createDataFrame(rows, "cell long, rank int, gene long").withColumn("value", F.lit(1.0))
    out = E.promote_priority(ranked, spark.createDataFrame([(g,) for g in range(0, 50, 3)], "gene long"), base=6, window=15)
    want = set()
    for c in range(25):
        own = [(r, g) for k, r, g in rows if k == c and r <= 15]
        new, old = [r for r, g in own if r > 6 and g % 3 == 0], [r for r, g in own if r <= 6 and g % 3]
        k = min(len(new), len(old))
        want |= {(c, r) for r, g in own if r in new[:k] or (r <= 6 and r not in old[len(old) - k :])}
    assert {(r.cell, r.rank) for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # three windows and two sorts before


def test_edges_of_both_species_are_folded_together(spark):
    from cellweave.operators import evaluation as V

    ours = [(f, t, float((f * 5 + t * 3) % 11), float((t * 7 + f) % 5 - 2) * (f % 2 + 0.5)) for f in range(4) for t in range(30)] + [(9, 1, 1.0, None), (None, 2, 1.0, 3.0)]
    theirs = [(f, t, float((f + t * t) % 13)) for f in range(4) for t in range(2, 14)] + [(None, 3, 1.0)]
    out = V.conserved_edges(spark.createDataFrame(ours, "tf int, target int, delta double, z double"), spark.createDataFrame(theirs, "tf int, target int, delta double"), spark.createDataFrame([(g, g // 2) for g in range(28)], "gene int, target int"))
    want = {}
    for f in range(4):
        own = [(t // 2, d, abs(z) >= 2) for k, t, d, z in ours if k == f and t < 28]
        used = [(t, d) for t, d, s in own if s or sum(s for *_, s in own) < 8]
        pairs = [(np.mean([d for u, d in used if u == t]), y) for k, t, y in theirs if k == f and any(u == t for u, _ in used)]
        x, y = (np.array([(np.array(v) < a).sum() + ((np.array(v) == a).sum() + 1) / 2 for a in v]) for v in zip(*pairs, strict=True))
        want[f] = (len(pairs), round(float(np.corrcoef(x, y)[0, 1]), 9))
    assert {r.tf: (r.n_shared, round(r.rho, 9)) for r in out.collect()} == {f: v for f, v in want.items() if v[0] >= 8}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # edges met their own counts and the other side's means before


def test_kmers_are_told_apart_by_key_before_they_are_counted(spark):
    from cellweave.operators import corpus as K
    from cellweave.plans import registry

    rows = [(1, "ACGTACGT"), (1, "ACGT"), (2, "ACG"), (2, "AC"), (3, None), (None, "ACGT"), (None, "ACGT")]
    got = {r.kmer: (r.n, r.n_keys) for r in K.kmer_counts(spark.createDataFrame(rows, "key long, s string"), "key", "s", 3).collect()}
    assert got == {"ACG": (6, 2), "CGT": (5, 1), "GTA": (1, 1), "TAC": (1, 1)}
    plan = registry.QUERIES["kmer_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan.replace("array_distinct", "") and plan.count("p_partkey") > 0  # all pairs of k-mers and parts were in one hash table before
    assert not any("kmer" in line and "p_partkey" in line.split("functions")[0] for line in plan.splitlines() if "HashAggregate(keys" in line)


def test_barcodes_send_lists_of_samples_not_pairs(spark):
    from cellweave.operators import annotation as A

    ours = spark.createDataFrame([(s, b) for s in range(4) for b in range(s, 10)] * 2 + [(None, 1), (8, 99)], "sample int, barcode int")
    authors = spark.createDataFrame([(s, b) for s in range(6) for b in range(10) if (b + s) % 3] + [(None, b) for b in range(10) if (b + 1) % 3], "author_sample int, barcode int")
    out = A.adopt_labels(ours, authors)
    want = {}
    for s in range(4):
        over = {t: sum((b + t) % 3 > 0 for b in range(s, 10)) for t in range(6)}
        t = min(over, key=lambda t: (-over[t], t))
        want[s] = (t, over[t], over[t] / (10 - s))
    assert {r["sample"]: (r.author_sample, r.overlap, r.share) for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # pairs were shuffled for their counts, twice


def test_large_groups_are_ranked_in_ranges(spark):
    from cellweave.functions import stats as S
    from cellweave.operators import evaluation as V

    draw = np.random.default_rng(7)
    x = np.where(draw.random(6_000) < 0.4, 0.0, draw.normal(size=6_000))  # one value holds many rows with different partners
    y = np.where(draw.random(6_000) < 0.3, 5.0, np.round(x + draw.normal(size=6_000), 3))
    rows = [("g" if k < 5_000 else "h", float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    table = spark.createDataFrame(rows * 2 + [("flat", 1.0, float(k)) for k in range(9)] + [(None, float(k), float(k * k % 7)) for k in range(9)] + [("g", None, 1.0), ("h", 1.0, None)], "kind string, truth double, estimate double")
    got = {r.kind: (r.n, r.rho) for r in S.spearman(table, ["kind"], "truth", "estimate", large=True).collect()}
    assert {k: (n, rho and round(rho, 12)) for k, (n, rho) in got.items()} == {r.kind: (r.n, r.rho and round(r.rho, 12)) for r in S.spearman(table, ["kind"], "truth", "estimate").collect()}
    rank = lambda v: (np.sort(v).searchsorted(v, "left") + np.sort(v).searchsorted(v, "right") + 1) / 2
    assert got["g"][0] == 10_000 and abs(got["g"][1] - np.corrcoef(rank(x[:5_000]), rank(y[:5_000]))[0, 1]) < 1e-12 and got["flat"] == (9, None)
    dealt = S.dealt_pairs(table.where("kind = 'g' and truth is not null").distinct().withColumn("_c", F.lit(1)), ["kind"], "truth", "estimate").cache()
    assert max(dealt.groupBy(f"_b{v}", f"_s{v}").count().agg(F.max("count")).first()[0] for v in "xy") < 0.06 * dealt.count()  # a whole group was one task's
    dealt.unpersist()
    profiles = table.selectExpr("kind", "cast(rand(1) * 3 as int) AS sample", "cast(rand(2) * 900 as int) AS gene", "abs(truth) AS truth", "estimate")
    plan = V.expression_scores(profiles, "kind", "sample")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("RepartitionByExpression") == 4  # all rows met their own sums by kind and sample


def test_hits_of_sets_are_sorted_once_in_a_fixed_number_of_parts(spark):
    from cellweave.operators import evaluation as V

    stats = [(b, g, float((g * 7 + b * 3) % 11 - 5) / 4) for b in range(9) for g in range(60)] + [(3, 99, None), (None, 1, 1.0)]
    sets = [(f"s{g % 5}", g) for g in range(60)] * 2 + [("rare", 7), ("none", 999)]
    out = V.enrichment_score(spark.createDataFrame(stats, "block int, gene int, stat double"), spark.createDataFrame(sets, "name string, gene int"), ["block"], least=1, most=12)
    want = {}
    for b in range(9):
        order = sorted(((v, g) for k, g, v in stats if k == b and v is not None), key=lambda r: (-r[0], r[1]))
        for name in {n for n, _ in sets}:
            own = {g for n, g in sets if n == name}
            w, n = sum(abs(v) for v, g in order if g in own), sum(g in own for _, g in order)
            if n and w:
                run = np.cumsum([abs(v) / w if g in own else -1 / (len(order) - n) for v, g in order])
                up, down = round(max(run), 9), round(min(run), 9)
                want[b, name] = (n, up if up >= -down else down)
    got = {(r.block, r.name): (r["size"], r.es) for r in out.where("block is not null and es is not null").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    plan = out._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("RepartitionByExpression") == 2  # small parts were merged into a few large tasks
    assert sum("Sort [" in line and "name" in line for line in plan.executedPlan().toString().splitlines()) == 1  # hits were sorted by set, and again by place
