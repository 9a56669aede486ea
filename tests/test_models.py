"""Linear models, representations and text rules against NumPy and by hand, for what SQL cannot say."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def study(spark):
    draw = np.random.default_rng(4)
    samples = [(f"b{b}", s, sex, week, f"{week}w", float(draw.normal())) for b in (1, 2) for s, (sex, week) in enumerate(itertools.product(("male", "female"), (0, 1, 8) * 3))]
    counts = [(b, s, f"g{g}", float(draw.poisson(3 + 2 * (g % 5) + week * (g % 3)))) for b, s, sex, week, _, _ in samples for g in range(40)]
    counts = [c for c in counts if c[3] > 0]
    return samples, counts, spark.createDataFrame(samples, "block string, sample int, sex string, week int, group string, rin double"), spark.createDataFrame(counts, "block string, sample int, gene string, count double")


def dense(samples, counts, block):
    own = [s for s in samples if s[0] == block]
    m = {(s, g): c for b, s, g, c in counts if b == block}
    genes = sorted({g for _, g in m})
    x = np.array([[m.get((s[1], g), 0.0) for s in own] for g in genes])
    lib = x.sum(0)
    prior = lib / lib.mean()
    return own, genes, np.log2((x + prior) / (lib + 2 * prior) * 1e6)


def design(own, model):
    sex = np.array([s[2] == "male" for s in own], float)
    w1, w8 = (np.array([s[3] == k for s in own], float) for k in (1, 8))
    week, one = np.array([s[3] for s in own], float), np.ones(len(own))
    return {
        "dose": ([one, sex, w1, w8], 2), "slope": ([one, sex, week], 1), "sex": ([one, w1, w8, sex], 1), "interaction": ([one, sex, w1, w8, sex * w1, sex * w8], 2), "male": ([one, w1, w8], 2), "female": ([one, w1, w8], 2),
    }[model]


def test_fits_match_least_squares_and_moderation_its_formulas(spark, study):
    from cellweave.operators import linear as L

    samples, counts, table, cells = study
    fits = L.linear_fits(cells, table, ["block"], ["sex", "week", "group"], L.training_models())
    got = {(r.block, r.gene, r.model): r for r in L.moderated(fits, ["block", "model"]).collect()}
    digamma = lambda x: math.log(x + 20) - 0.5 / (x + 20) - 1 / (12 * (x + 20) ** 2) + 1 / (120 * (x + 20) ** 4) - sum(1 / (x + k) for k in range(20))
    trigamma = lambda x: 1 / (x + 20) + 0.5 / (x + 20) ** 2 + 1 / (6 * (x + 20) ** 3) - 1 / (30 * (x + 20) ** 5) + sum(1 / (x + k) ** 2 for k in range(20))
    for block, model in itertools.product(("b1", "b2"), ("dose", "slope", "sex", "interaction", "male", "female")):
        own, genes, y = dense(samples, counts, block)
        keep = [k for k, s in enumerate(own) if model not in ("male", "female") or s[2] == model]
        cols, tested = design([own[k] for k in keep], model)
        x, means = np.column_stack(cols), y.mean(1)
        y = y[:, keep]
        beta = np.linalg.lstsq(x, y.T, rcond=None)[0]
        rss = ((y.T - x @ beta) ** 2).sum(0)
        less = x[:, :-tested]
        before = ((y.T - less @ np.linalg.lstsq(less, y.T, rcond=None)[0]) ** 2).sum(0)
        df = len(keep) - x.shape[1]
        z = np.log(rss / df) - digamma(df / 2) + math.log(df / 2)
        slope, a = np.polyfit(means, z, 1)
        over = ((z - a - slope * means) ** 2).sum() / (len(z) - 2) - trigamma(df / 2)
        if over > 1e-9:
            lo, hi = -20.0, 20.0
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if trigamma(math.exp(mid)) > over else (lo, mid)
            d0 = 2 * math.exp((lo + hi) / 2)
            s0 = np.exp(a + slope * means + digamma(d0 / 2) - math.log(d0 / 2))
            post, total = (rss + d0 * s0) / (df + d0), min(df + d0, df * len(genes))
        else:
            post, total = np.exp(a + slope * means), df * len(genes)
        for k, g in enumerate(genes):
            r = got[block, g, model]
            assert (r.df, r.rank, r.n) == (df, tested, len(keep))
            assert np.allclose([r.mean, r.estimate, r.rss, r.q], [means[k], beta[-1, k], rss[k], before[k] - rss[k]], atol=1e-8)
            assert np.allclose([r.s2, r.df_total, r.f], [post[k], total, (before[k] - rss[k]) / tested / post[k]], rtol=1e-6), (block, model, g)
            if tested == 2:  # a closed form
                assert abs(r.p - (1 + 2 * r.f / r.df_total) ** (-r.df_total / 2)) < 1e-9


def test_covariates_and_gaps(spark, study):
    from cellweave.operators import evaluation as V
    from cellweave.operators import linear as L

    samples, counts, table, cells = study
    base, cov = L.Model("base", ("sex",), ("week",), (), ("week",)), L.Model("cov", ("sex",), ("rin", "week"), (), ("week",))
    fits = L.moderated(L.linear_fits(cells, table, ["block"], ["sex", "week", "rin"], [base, cov]), ["block", "model"])
    own, genes, y = dense(samples, counts, "b1")
    x = np.column_stack([np.ones(len(own)), [s[2] == "male" for s in own], [s[5] for s in own], [s[3] for s in own]]).astype(float)
    got = {r.gene: r.estimate for r in fits.where("block = 'b1' and model = 'cov'").collect()}
    assert np.allclose([got[g] for g in genes], np.linalg.lstsq(x, y.T, rcond=None)[0][-1])
    verdicts = V.covariate_verdict(L.fits_for_covariates(fits.where("model = 'base'"), fits.where("model = 'cov'"), ["block"]), ["block"]).collect()
    assert {r.block for r in verdicts} == {"b1", "b2"} and all(r.rho > 0.8 for r in verdicts)
    # A sample without counts or with a null variable takes no part; a block of one level has nothing to test.
    odd = table.unionByName(spark.createDataFrame([("b1", 99, "male", 8, "8w", 0.0), ("b1", 98, None, 0, "0w", 0.0)], table.schema))
    assert L.linear_fits(cells, odd, ["block"], ["sex", "week"], [base]).where("block = 'b1'").first().n == 18
    flat = L.plain(L.linear_fits(cells, table.withColumn("sex", F.lit("x")).withColumn("week", F.lit(1)), ["block"], ["sex", "week"], [base])).first()
    assert flat.rank == 0 and flat.f is None and flat.t is None
    assert L.linear_fits(cells.limit(0), table, ["block"], ["sex", "week"], [base]).count() == 0


def test_tails_match_closed_forms(spark):
    from cellweave.functions import tails as T

    rows = spark.createDataFrame([(x, d) for x in (0.0, 1e-3, 0.7, 2.0, 9.0, 60.0) for d in (1.0, 2.0, 4.0, 31.0, 900.0, 250_000.0)], "x double, d double")
    out = rows.select("x", "d", T.f_upper(F.col("x"), F.lit(2), F.col("d")).alias("f"), T.t_two_sided(F.col("x"), F.col("d")).alias("t"), T.f_upper(F.col("x") * F.col("x"), F.lit(1), F.col("d")).alias("tt"), T.normal_two_sided(F.col("x")).alias("z"), T.trigamma_inverse(T.trigamma(F.col("d"))).alias("d2"))
    for r in out.collect():
        assert abs(r.f - math.exp(-r.d / 2 * math.log1p(2 * r.x / r.d))) < 1e-10
        assert abs(r.t - r.tt) < 1e-12 and abs(r.d2 / r.d - 1) < 1e-9
        if r.d == 1:
            assert abs(r.t - (1 - 2 * math.atan(r.x) / math.pi)) < 1e-12
        if r.d == 250_000:
            assert abs(r.t - r.z) < 1e-4
    none = rows.limit(1).select(T.f_upper(F.lit(None).cast("double"), F.lit(2), F.lit(3)).alias("a"), T.t_two_sided(F.lit(1.0), F.lit(0)).alias("b"), T.normal_two_sided(F.lit(None).cast("double")).alias("c")).first()
    assert tuple(none) == (None, None, None)


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(60, 6)) * [3, 2, 1, 1, 1, 1]
    rows = [(int(k), [float(v) for v in x[k]], int(k % 3), int(k % 2), "m" if k % 4 < 2 else "f", float(k % 5)) for k in range(60)]
    return x, spark.createDataFrame(rows, "key long, vector array<double>, label int, study int, sex string, week double")


def test_nearest_in_blocks_match_brute_force(vectors):
    from cellweave.operators import representation as R

    x, table = vectors
    for metric in ("euclidean", "cosine"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = ((x[:, None] - x[None]) ** 2).sum(-1) if metric == "euclidean" else 1 - u @ u.T
        want = {(i, int(j), r + 1) for i in range(60) for r, j in enumerate([j for j in np.lexsort((np.arange(60), np.round(d[i], 9))) if j != i][:4])}
        got = {(r.key, r.near, r["rank"]) for r in R.nearest(table.select("key", "vector"), 4, metric, block=7).collect()}
        assert got == want


def test_principal_and_pooled_axes_match_numpy(vectors):
    from cellweave.operators import representation as R

    x, table = vectors
    c = x - x.mean(0)
    got = np.array([r.pcs for r in R.principal_axes(table, 2).orderBy("key").collect()])
    basis = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs(c @ basis.T), atol=1e-8)
    e = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    r = np.zeros_like(e)
    for g in range(3):
        k = np.arange(60) % 3 == g
        own = e[k] - e[k].mean(0)
        r[k] = own / math.sqrt((own**2).sum() / k.sum())
    z = r / r.std(0)
    p = z @ np.linalg.svd(z - z.mean(0), full_matrices=False)[2][:2].T
    got = np.array([[v.px, v.py] for v in R.pooled_axes(table, ["label"]).orderBy("key").collect()])
    assert np.allclose(np.abs(got), np.abs(p / p[:, 0].std()), atol=1e-7)


def test_supervised_probe_finds_what_is_there(spark):
    from cellweave.operators import representation as R

    draw = np.random.default_rng(1)
    rows = [(int(k), [float(v) for v in draw.normal(size=5) + [2.0 * (k % 2), 0, 0, 0, 0]], float(k % 2)) for k in range(50)]
    table = R.folds(spark.createDataFrame(rows, "key long, vector array<double>, y double"), "key", ["y"], 5)
    assert {r["count"] for r in table.groupBy("fold", "y").count().collect()} == {5}
    out = R.supervised_probe(table, 19).first()
    assert out.observed > 0.8 and out.p == 0.05 and 0.2 < out.eta2 < 1
    null = R.supervised_probe(table.withColumn("vector", F.array(F.pmod(F.xxhash64("key"), F.lit(97)).cast("double"))), 19).first()
    assert null.p > 0.05


def test_gene_vectors_tell_families_and_rerun_alike(spark):
    from cellweave.operators import representation as R

    families = spark.createDataFrame([(f"f{g // 8}", f"g{g:03d}") for g in range(64)], "family string, gene string")
    pairs = R.family_pairs(families)
    assert pairs.count() == 8 * 28
    first, again = (R.gene_vectors(pairs, size=16, epochs=20, step=0.1) for _ in range(2))
    assert R.family_check(first, families).first().auc > 0.7
    assert sorted((r.gene, tuple(r.vector)) for r in first.collect()) == sorted((r.gene, tuple(r.vector)) for r in again.collect())


def test_ties_corrected_rank_sums(spark):
    from cellweave.operators import ranked as K

    values = spark.createDataFrame([(c, "g", float(v)) for c, v in enumerate([1, 1, 2, 3, 3, 3]) if v], "cell int, gene string, value double")
    cells = spark.createDataFrame([(c, "a" if c in (2, 3, 4) else "b") for c in range(10)], "cell int, cluster string")
    got = {r.cluster: r for r in K.rank_genes(values, cells, correct_ties=True).collect()}
    x, label = np.array([1, 1, 2, 3, 3, 3, 0, 0, 0, 0.0]), np.array([c in (2, 3, 4) for c in range(10)])
    u = sum((a > b) + 0.5 * (a == b) for a in x[label] for b in x[~label])
    ties = sum(t**3 - t for t in (2, 1, 3, 4))
    z = (u - 3 * 7 / 2) / math.sqrt(3 * 7 / 12 * (11 - ties / 90))
    assert got["a"].u == u and abs(got["a"].z - z) < 1e-12 and abs(got["b"].z + z) < 1e-12 and abs(got["a"].p - math.erfc(abs(z) / math.sqrt(2))) < 1e-12


def test_json_out_of_text(spark):
    from cellweave.functions import text as X

    cases = {
        'x {"a": "}{"} y': '{"a": "}{"}', "no brace": None, "": None, '```json\n{"a": [1, {"b": "c': '{"a": [1, {"b": "c"}]}', "```\nx\n```\n```{\"a\": 1}```": '{"a": 1}', '{"a": "x\\\\", "b": "y\\': '{"a": "x\\\\", "b": "y"}', '{"a": [1, 2, ': '{"a": [1, 2]}', '{"a": "' + "q" * 50_000: '{"a": "' + "q" * 50_000 + '"}',
    }
    rows = spark.createDataFrame(list(cases.items()), "text string, want string").select("text", "want", X.closed(X.first_object(F.col("text"))).alias("got"))
    for r in rows.collect():
        assert r.got == r.want, r.text[:40]


def test_manifest_tells_changes(spark, tmp_path):
    from cellweave.sources import sinks

    path, written = f"{tmp_path}/data", f"{tmp_path}/manifest"
    spark.range(100).repartition(3).write.parquet(path)
    sinks.write_manifest(sinks.manifest(spark, path), written)
    assert sinks.changed_files(spark, path, written).count() == 0
    next(tmp_path.joinpath("data").glob("*.parquet")).unlink()
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.problem for r in sinks.changed_files(spark, path, written).collect()) == ["missing", "not in the manifest"]


def test_contracts_and_pins(spark):
    from cellweave.operators import records as K
    from cellweave.operators import terms as T

    rows = spark.createDataFrame([("s1", "Liver", "control"), ("s2", "liver ", None), ("s3", "lung", "control")], "sample_id string, tissue string, title string")
    assert [r.sample_id for r in K.refined_selection(rows, "liver", pinned=["s1"]).collect()] == ["s1"]
    with pytest.raises(ValueError, match="s3"):
        K.refined_selection(rows, "liver", pinned=["s1", "s3"])
    sets = {"a": spark.range(6).withColumnRenamed("id", "key"), "b": spark.range(2).withColumnRenamed("id", "key"), "none": spark.range(0).withColumnRenamed("id", "key")}
    got = T.interleaved(sets, {"a": 0.5, "b": 0.5, "none": 1.0}, "key").groupBy("source", "key").count().collect()
    assert {(r.source, r["count"]) for r in got} == {("a", 1), ("b", 3)}


def test_ranges_give_the_ranks_of_a_window(spark):
    from cellweave.functions import stats as S

    draw = np.random.default_rng(3)
    rows = [("g" if k % 3 else "h", float(np.round(draw.exponential() ** 4, 2)), float(draw.integers(0, 2))) for k in range(3_000)]
    df = spark.createDataFrame(rows + [("one", 1.0, 1.0), ("h", None, 0.0)], "g string, x double, y double")
    for r in S.average_rank(df.where("x is not null"), ["g"], "x", "rank").collect():
        own = np.array([v for g, v, _ in rows if g == r.g] or [1.0])
        assert r["rank"] == (own < r.x).sum() + ((own == r.x).sum() + 1) / 2
    p = df.where("x is not null").select("g", F.least(F.lit(1.0), F.col("x") / 50).alias("p"))
    for r in S.benjamini_hochberg(p, ["g"], "p").where("g = 'h'").distinct().collect():
        own = np.sort([min(1.0, v / 50) for g, v, _ in rows if g == "h"])
        q = np.minimum.accumulate((own * len(own) / np.arange(1, len(own) + 1))[::-1])[::-1]
        assert abs(r.fdr - min(1.0, q[np.searchsorted(own, r.p)])) < 1e-12
