"""Tests of representations: nearest neighbours, supervised projections, pooled axes, clusters, gene vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import auc, eta_squared, spearman
from .evaluation import adjusted_rand, paired_auc
from .scoring import draw_order, permutation_p

#: Vectors of one packed block.
BLOCK = 512
#: Groups of queries at least, if blocks allow: each is one task's work and meets every block once.
GROUPS = 32
#: Blocks of queries in a group at most, so that a task holds few vectors at any size.
MOST = 32
#: Parts that the genes of a family are dealt to before they are paired.
PARTS = 8
#: Pairs that one task trains gene vectors on before a further one is taken, and such tasks at most: each holds a whole model, which are averaged.
TRAINED, TRAINERS = 500_000, 16
_NEAR = "key long, near long, distance double, rank int"


def _blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    """block, ids and their vectors one after another, about BLOCK rows to a block."""
    row = F.struct(F.col("key").alias("key"), F.col("vector").alias("vector"))
    packed = vectors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return packed.select("block", F.transform("rows", lambda r: r["key"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["vector"])).alias("data"))


class _Best:
    """The k nearest so far of the vectors of one group, as blocks pass by."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, metric: str):
        self.ids, self.k, self.cosine = ids, k, metric == "cosine"
        self.x = self.unit(data)
        self.own = (self.x * self.x).sum(1)
        self.d, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if self.cosine else x

    def meet(self, others: np.ndarray, data: np.ndarray) -> None:
        y = self.unit(data)
        norm = (y * y).sum(1)
        for a in range(0, len(self.ids), BLOCK):
            part = slice(a, a + BLOCK)
            rough = self.x[part] @ y.T
            d = 1 - rough if self.cosine else np.maximum(self.own[part, None] + norm - 2 * rough, 0.0)
            d = np.round(d, 9) if len(others) <= self.k else self._rounded_where_near(d, self.d[part, -1])
            d[self.ids[part, None] == others] = np.inf
            rows, cols = np.nonzero((d < np.inf) & (d <= self.d[part, -1:]))
            if len(rows):
                self._merge(a, rows, others[cols], d[rows, cols])

    def _rounded_where_near(self, d: np.ndarray, last: np.ndarray) -> np.ndarray:
        """d rounded, and without what cannot be among the nearest: beyond the k nearest of before or of this block."""
        least = np.minimum(np.partition(d, self.k, axis=1)[:, self.k] if np.isinf(last).any() else np.inf, last)
        near = d <= least[:, None] + 2e-9
        out = np.full(d.shape, np.inf)
        out[near] = np.round(d[near], 9)
        return out

    def _merge(self, a: int, rows: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
        touched = np.unique(rows)
        at = a + touched
        r = np.concatenate([np.repeat(np.arange(len(at)), self.k), np.searchsorted(touched, rows)])
        n, d = np.concatenate([self.near[at].ravel(), near]), np.concatenate([self.d[at].ravel(), d])
        order = np.lexsort((n, d, r))
        r, n, d = r[order], n[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        self.near[at], self.d[at] = n[keep].reshape(-1, self.k), d[keep].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        ok = np.isfinite(self.d)
        rank = np.broadcast_to(np.arange(1, self.k + 1, dtype=np.int32), ok.shape)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, ok.sum(1))), pa.array(self.near[ok]), pa.array(self.d[ok]), pa.array(rank[ok])], names=["key", "near", "distance", "rank"])


def _nearest(k: int, metric: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, group = [], None, None
        for batch in batches:
            at = {c: batch.column(c) for c in ("group", "query", "ids", "data")}
            for i in range(batch.num_rows):
                if at["group"][i].as_py() != group:
                    if best is not None:
                        yield best.rows()
                    held, best, group = [], None, at["group"][i].as_py()
                ids = at["ids"][i].values.to_numpy()
                data = at["data"][i].values.to_numpy().astype(float).reshape(len(ids), -1)
                if at["query"][i].as_py():
                    held.append((ids, data))
                else:
                    if best is None:
                        best = _Best(*(np.concatenate(v) for v in zip(*held, strict=True)), k, metric)
                    best.meet(ids, data)
        if best is not None:
            yield best.rows()

    return run


def nearest(vectors: DataFrame, k: int, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """key, near, distance and rank: the k nearest other rows of each of vectors(key, vector), exactly.

    Vectors are packed to blocks and blocks to groups of queries. Every block is sent once to each group, whose task holds the
    group's vectors and the nearest so far and lets the blocks pass by, so what is sent grows with groups, not with pairs of
    blocks, and only the k nearest leave a task. Distances (squared ones, or 1 - cosine) are rounded to 9 places and ties go to
    the smaller key. Keys are distinct longs.
    """
    n = vectors.count()
    count = max(1, -(-n // block))
    groups = max(min(count, GROUPS), -(-count // MOST))
    packed = _blocks(vectors, count)
    queries = packed.select(F.pmod(F.col("block"), F.lit(groups)).cast("int").alias("group"), F.lit(True).alias("query"), "ids", "data")
    passing = packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(False).alias("query"), "ids", "data")
    both = queries.unionByName(passing).repartitionById(groups, "group").sortWithinPartitions("group", F.desc("query"))
    return both.mapInArrow(_nearest(k, metric), _NEAR)


def neighbour_purity(vectors: DataFrame, k: int = 15, metric: str = "euclidean") -> DataFrame:
    """One row for vectors(key, vector, label, study): how often neighbours share label and study, against chance, and how well studies mix.

    mix: over rows whose label is in two studies or more and that have neighbours of their label, the mean share of those that
    are of another study. PASS above three times chance with a mix above 0.3, PARTIAL above 1.5 times chance, else WEAK.
    """
    own = vectors.select("key", "label", "study")
    near = nearest(vectors.select("key", "vector"), k, metric).select("key", "near")
    pairs = near.join(own, "key").join(own.select(F.col("key").alias("near"), F.col("label").alias("l2"), F.col("study").alias("s2")), "near")
    several = own.groupBy("label").agg(F.count_distinct("study").alias("studies")).where("studies >= 2").select("label", F.lit(1).alias("several"))
    same, far = F.col("label") == F.col("l2"), F.col("study") != F.col("s2")
    each = pairs.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.count_if(same).alias("a"), F.count_if(~far).alias("b"), F.count_if(same & far).alias("c")).join(several, "label", "left")
    mixed = F.when(F.col("several").isNotNull() & (F.col("a") > 0), F.col("c") / F.col("a"))
    sums = each.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.avg(mixed).alias("mix")).withColumn("_", F.lit(0))
    total = F.sum("n").cast("double")
    chance = lambda c: own.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg((F.sum(F.col("n") * F.col("n")) / (total * total)).alias(f"chance_{c}")).withColumn("_", F.lit(0))
    out = sums.join(chance("label"), "_").join(chance("study"), "_")
    p = F.col("a") / F.col("m")
    verdict = F.when((p > 3 * F.col("chance_label")) & (F.col("mix") > 0.3), "PASS").when(p > 1.5 * F.col("chance_label"), "PARTIAL").otherwise("WEAK")
    return out.select("n", p.alias("purity_label"), "chance_label", (F.col("b") / F.col("m")).alias("purity_study"), "chance_study", "mix", verdict.alias("verdict"))


def cluster_agreement(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """One row: the adjusted Rand index of k-means clusters of vectors(key, vector, label) against the labels."""
    data = vectors.select("label", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    found = KMeans(k=k, seed=seed, maxIter=50, initSteps=5).fit(data).transform(data)
    return adjusted_rand(found.select("label", "prediction"), "label", "prediction")


def principal_axes(vectors: DataFrame, k: int) -> DataFrame:
    """vectors(key, vector) with pcs, their centred coordinates on the first k principal axes."""
    mean = vectors.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
    middle = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m")).first()["m"]
    centred = F.transform("vector", lambda x, i: x.cast("double") - F.element_at(F.array(*[F.lit(float(v)) for v in middle]), (i + 1).cast("int")))
    data = vectors.withColumn("_v", array_to_vector(centred))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(data).transform(data).withColumn("pcs", vector_to_array("_p")).drop("_v", "_p")


def folds(rows: DataFrame, key: str, strata: Sequence[str], k: int, seed: str = "0") -> DataFrame:
    """rows with fold: the places of a stratum's rows in a random order, dealt round, so that folds hold each stratum alike.

    A stratum that fills no fold twice would leave one without it: there are as many folds as the smallest stratum has
    rows, k at most and 2 at least.
    """
    least = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")).agg(F.greatest(F.lit(2), F.least(F.lit(k), F.min("_n"))).cast("int").alias("_k")).withColumn("_", F.lit(0))
    order = Window.partitionBy(*strata).orderBy(draw_order(seed, F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(order) - 1).withColumn("_", F.lit(0)).join(F.broadcast(least), "_").withColumn("fold", F.col("_r") % F.col("_k")).drop("_", "_r", "_k")


def projections(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores out of fold of rows(by, key, vector, y, fold): along the direction of greatest covariance with y in the other folds.

    The direction needs only sums: of vectors, of y and of their products, by fold; a fold's training sums are all less its own.
    """
    dims = rows.select(*by, "fold", "y", F.posexplode("vector").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    per = dims.groupBy(*by, "fold", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    whole = Window.partitionBy(*by, "d")
    rest = {c: F.sum(c).over(whole) - F.col(c) for c in ("n", "x", "y", "xy")}
    per = per.select(*by, "fold", "d", *[v.alias(c) for c, v in rest.items()]).where("n > 0")
    weights = per.select(*by, "fold", "d", (F.col("xy") - F.col("x") * F.col("y") / F.col("n")).alias("w"), (F.col("x") / F.col("n")).alias("m"))
    axes = weights.groupBy(*by, "fold").agg(F.sort_array(F.collect_list(F.struct("d", "w", "m"))).alias("axis"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = F.aggregate(F.zip_with("vector", "axis", lambda x, a: (x.cast("double") - a["m"]) * a["w"]), F.lit(0.0), lambda s, v: s + v)
    score = F.when(F.col("norm") > 0, dot / F.col("norm")).otherwise(0.0)
    return rows.join(axes, [*by, "fold"]).select(*by, "key", "y", F.round(score, 9).alias("score"))


def supervised_probe(rows: DataFrame, draws: int, binary: bool = True, seed: str = "0") -> DataFrame:
    """One row for rows(key, vector, y, fold): AUC or rank correlation out of fold, its eta squared by y, and p by permutation of y.

    Draw 0 has the true y; in the others y is dealt anew by a random order. Folds stay.
    """
    told = rows.select("key", "vector", "y", "fold").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    shuffled = Window.partitionBy("draw").orderBy(draw_order(seed, F.col("draw"), F.col("key")), "key")
    sorted_ = Window.partitionBy("draw").orderBy("key")
    given = told.select("draw", F.col("y").alias("_y"), F.row_number().over(sorted_).alias("_p"))
    placed = told.withColumn("_p", F.when(F.col("draw") == 0, F.row_number().over(sorted_)).otherwise(F.row_number().over(shuffled)))
    scored = projections(placed.join(given, ["draw", "_p"]).select("draw", "key", "vector", "fold", F.col("_y").cast("double").alias("y")), ["draw"])
    metric = auc(scored, ["draw"], "score", "y").select("draw", "auc") if binary else spearman(scored, ["draw"], "score", "y").select("draw", F.col("rho").alias("auc"))
    one = metric.withColumn("_", F.lit(0))
    observed = one.where("draw = 0").select("_", F.round("auc", 9).alias("observed"))
    p = one.join(observed, "_").groupBy("observed").agg(permutation_p(F.col("observed"), F.when(F.col("draw") > 0, F.round("auc", 9))).alias("p"))
    eta = eta_one_way(scored.where("draw = 0"), "score", "y")
    return p.withColumn("_", F.lit(0)).join(eta.withColumn("_", F.lit(0)), "_").select("observed", "eta2", "p")


def eta_one_way(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row with eta2: the share of a score's variance that lies between labels; null where it does not vary."""
    return eta_squared(rows.where(F.col(score).isNotNull()).withColumn("_v", F.array(score)), "_v", label).select("eta2")


def eta_summary(dims: DataFrame, top: int = 10) -> DataFrame:
    """The largest eta squared of dims(dim, eta2), its dimension, and the mean of the largest ten."""
    best = dims.where(F.col("eta2").isNotNull()).orderBy(F.desc("eta2"), "dim").limit(top)
    return best.agg(F.max("eta2").alias("max_eta2"), F.max_by("dim", F.struct(F.col("eta2"), -F.col("dim"))).alias("max_dim"), F.avg("eta2").alias("mean_top"))


def pooled_residuals(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows(by, key, vector) with residual: unit vectors less their group's mean, by the root mean square of the group, and then by each dimension's deviation over all rows."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + 1e-9
    unit = rows.withColumn("_u", F.transform("vector", lambda x: x.cast("double") / norm))
    dims = unit.select(*by, F.posexplode("_u").alias("d", "x"))
    per = dims.groupBy(*by, "d").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"))
    spread = F.greatest(F.sum(F.col("q") - F.col("n") * F.col("m") * F.col("m")), F.lit(0.0)) / F.max("n")
    groups = per.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("_m"), F.sqrt(spread).alias("_s"))
    # Residuals have mean zero in every group, so a dimension's variance over all rows is a sum over groups.
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    var = per.join(groups.select(*by, scale.alias("_s")), list(by)).groupBy("d").agg((F.sum((F.col("q") - F.col("n") * F.col("m") * F.col("m")) / (F.col("_s") * F.col("_s"))) / F.sum("n")).alias("v"))
    sd = var.agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "v"))), lambda s: F.when(s["v"] > 1e-18, F.sqrt(s["v"])).otherwise(1.0)).alias("_sd")).withColumn("_", F.lit(0))
    both = unit.join(groups.withColumn("_s", scale), list(by)).withColumn("_", F.lit(0)).join(sd, "_")
    value = lambda x, i: (x - F.element_at("_m", i + 1)) / F.col("_s") / F.element_at("_sd", i + 1)
    return both.withColumn("residual", F.transform("_u", lambda x, i: value(x, i.cast("int")))).drop("_", "_u", "_m", "_s", "_sd")


def pooled_axes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with px and py, the first two principal coordinates of the pooled residuals, both over the deviation of px."""
    own = pooled_residuals(rows, by).withColumn("_v", array_to_vector("residual"))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(own).transform(own).withColumn("_p", vector_to_array("_p"))
    sd = out.agg(F.stddev_pop(F.col("_p")[0]).alias("_sd")).withColumn("_", F.lit(0))
    out = out.withColumn("_", F.lit(0)).join(sd, "_").withColumn("_sd", F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0))
    return out.select(*rows.columns, *[(F.col("_p")[i] / F.col("_sd")).alias(c) for i, c in enumerate(("px", "py"))])


def design_axes(rows: DataFrame, by: Sequence[str], dose: str, sex: str, one: object, other: object) -> DataFrame:
    """by, key, dx and dy: each row along the dose direction and the sex direction of the other rows of its group.

    A group's sums less the row's own give both directions in closed form, so no row is fitted on itself and no group is
    gone through once for each row. Coordinates are centred by group and divided by their deviation over all rows.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + 1e-9
    t, a, b = F.col(dose).cast("double"), (F.col(sex) == F.lit(one)).cast("int"), (F.col(sex) == F.lit(other)).cast("int")
    unit = rows.select(*by, "key", F.transform("vector", lambda x: x.cast("double") / norm).alias("u"), t.alias("t"), F.coalesce(a, F.lit(0)).alias("a"), F.coalesce(b, F.lit(0)).alias("b"))
    dims = unit.select(*by, "t", "a", "b", F.posexplode("u").alias("d", "x"))
    sums = dims.groupBy(*by, "d").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("t")).alias("xt"), F.sum(F.col("x") * F.col("a")).alias("xa"), F.sum(F.col("x") * F.col("b")).alias("xb"))
    lists = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("d", "x", "xt", "xa", "xb"))).alias("s"))
    sizes = unit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("st"), F.sum(F.col("t") * F.col("t")).alias("stt"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    both = unit.join(lists, list(by)).join(sizes, list(by))
    m = F.col("n") - 1
    toward = F.zip_with("u", "s", lambda x, s: (s["xt"] - x * F.col("t")) - (s["x"] - x) * (F.col("st") - F.col("t")) / m)
    ka, kb = F.col("na") - F.col("a"), F.col("nb") - F.col("b")
    apart = F.zip_with("u", "s", lambda x, s: (s["xa"] - x * F.col("a")) / ka - (s["xb"] - x * F.col("b")) / kb)
    along = lambda w: F.try_divide(F.aggregate(F.zip_with("u", w, lambda x, y: x * y), F.lit(0.0), lambda p, v: p + v), F.sqrt(F.aggregate(w, F.lit(0.0), lambda p, v: p + v * v)))
    varies = F.col("stt") - F.col("t") * F.col("t") - (F.col("st") - F.col("t")) * (F.col("st") - F.col("t")) / m > 1e-9
    both = both.withColumn("_d", F.when((m > 0) & varies, toward)).withColumn("_x", F.when((ka > 0) & (kb > 0), apart))
    raw = both.select(*by, "key", F.coalesce(along("_d"), F.lit(0.0)).alias("dx"), F.coalesce(along("_x"), F.lit(0.0)).alias("dy"))
    means = raw.groupBy(*by).agg(F.avg("dx").alias("_mx"), F.avg("dy").alias("_my"))
    centred = raw.join(means, list(by)).select(*by, "key", (F.col("dx") - F.col("_mx")).alias("dx"), (F.col("dy") - F.col("_my")).alias("dy"))
    sd = centred.agg(F.stddev_pop("dx").alias("_sx"), F.stddev_pop("dy").alias("_sy")).withColumn("_", F.lit(0))
    scale = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    return centred.withColumn("_", F.lit(0)).join(sd, "_").select(*by, "key", (F.col("dx") / scale("_sx")).alias("dx"), (F.col("dy") / scale("_sy")).alias("dy"))


def gene_vectors(pairs: DataFrame, size: int = 768, epochs: int = 10, window: int = 1, seed: int = 42, step: float = 0.025, partitions: int | None = None) -> DataFrame:
    """gene and vector by skip-gram over pairs(a, b), each a sentence of two words.

    The model holds a row for each gene in the driver, as pyspark.ml fits it; the vocabulary of genes is its bound. Every pair is
    trained on in every epoch; by default as many tasks share them as their number asks. With one partition and a fixed order,
    reruns agree; with more, models are averaged after each epoch and agree but for the order in which pairs arrive.
    """
    text = pairs.select(F.array(F.col("a").cast("string"), F.col("b").cast("string")).alias("words"))
    if partitions is None:
        partitions = min(TRAINERS, text.count() // TRAINED + 1)
    text = (text.coalesce(1) if partitions == 1 else text.repartition(partitions, "words")).sortWithinPartitions("words")
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, maxIter=epochs, seed=seed, stepSize=step, numPartitions=partitions, inputCol="words", outputCol="v").fit(text)
    return model.getVectors().select(F.col("word").alias("gene"), vector_to_array("vector").alias("vector"))


def family_check(vectors: DataFrame, families: DataFrame, seed: str = "0") -> DataFrame:
    """One row: cosines of pairs of a family (a.gene < b.gene) against as many random pairs, for vectors(gene, vector) and families(family, gene).

    A gene's random partner is the gene that follows it in a random order.
    """
    known = families.join(vectors.select("gene"), "gene").distinct()
    real = family_pairs(known)
    order = Window.partitionBy(F.substring(draw_order(seed, F.col("gene")), 1, 1)).orderBy(draw_order(seed, F.col("gene")))
    null = vectors.select(F.col("gene").alias("a"), F.lead("gene").over(order).alias("b")).where("b is not null")
    return paired_auc(vectors.select(F.col("gene").alias("key"), "vector"), real, null)


def family_pairs(families: DataFrame) -> DataFrame:
    """a and b, distinct: every pair of genes that share a family, the smaller first.

    A pair is told by the least family that both genes are in, which each gene's own list decides, so the pairs themselves are
    neither shuffled nor held. Families are dealt out in parts, so a large one is not one task's work.
    """
    lists = families.where("family is not null and gene is not null").groupBy("gene").agg(F.array_sort(F.collect_set("family")).alias("all"))
    own = lists.select(F.explode("all").alias("family"), "gene", F.when(F.size("all") > 1, F.col("all")).alias("all"))
    part = F.pmod(F.xxhash64("gene"), F.lit(PARTS)).cast("int")
    left = own.select("family", part.alias("part"), F.col("gene").alias("a"), F.col("all").alias("l"))
    right = own.select("family", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.col("gene").alias("b"), F.col("all").alias("r"))
    first = F.col("l").isNull() | F.col("r").isNull() | (F.array_intersect("l", "r")[0] == F.col("family"))
    # Both sides have every gene, however small the file that they come from looks: neither is sent to the driver to be broadcast.
    return left.join(right.hint("merge"), ["family", "part"]).where((F.col("a") < F.col("b")) & first).select("a", "b")
