"""Statistics as DataFrame compositions: ranks, guarded correlation, multiple testing, separation of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation of pairs without nulls; null where a side does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def half_up(value: Column, places: int) -> Column:
    """value rounded by its multiple of a power of ten, as SQL engines on doubles do it: a tie of the multiple goes up.

    round(value, places) looks at the shortest decimal text instead, which tells a tie from below where the multiple is just under it.
    """
    return F.round(value * 10.0**places) / 10.0**places


#: Ranges that the values of a group are dealt to.
RANGES = 64


def dealt_by_range(folded: DataFrame, by: list[str], value: str, ranges: int = RANGES, few: bool = False) -> DataFrame:
    """folded with _range: the place of value among approximate quantiles of its group, so that no task needs a whole group in order.

    folded has a row for each (by, value). Quantiles come from partial aggregates of a fixed size, and equal values are in one range.
    With few groups their quantiles go to the rows, as a join by group would put a whole group into one task.
    """
    cuts = folded.groupBy(*by).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 1_000).alias("_cuts"))
    return folded.join(F.broadcast(cuts) if few else cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def running_sums(folded: DataFrame, by: list[str], value: str, sums: dict[str, str], keep_range: bool = False) -> DataFrame:
    """folded(by, value, ...) with, for each item out: column of sums, the sum of the column up to and with this value.

    Ranges of values are summed apart; a range's start is the sum of the ranges before it, RANGES rows for each group. A column
    _range that folded has already, rising with value, is taken as it is.
    """
    dealt = folded if "_range" in folded.columns else dealt_by_range(folded, by, value)
    whole = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_range")
    starts = whole.select(*by, "_range", *[(F.sum(f"_t_{o}").over(earlier) - F.col(f"_t_{o}")).alias(f"_s_{o}") for o in sums])
    within = Window.partitionBy(*by, "_range").orderBy(value)
    inner = dealt.withColumns({o: F.sum(c).over(within) for o, c in sums.items()})
    out = inner.join(starts, [*by, "_range"])
    out = out.withColumns({o: F.col(o) + F.col(f"_s_{o}") for o in sums}).drop(*[f"_s_{o}" for o in sums])
    return out if keep_range else out.drop("_range")


def average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Rank of value within by, ties sharing their mean rank.

    Only one row for each distinct value of a group is ranked; rows get the rank by a join on (by, value).
    """
    counts = running_sums(df.groupBy(*by, value).agg(F.count("*").alias("_n")), by, value, {"_upto": "_n"})
    ranks = counts.select(*by, value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def _rank(weight: str, by: list[str], value: str) -> Column:
    """Average rank of value within by, of rows that stand for weight rows each."""
    order = Window.partitionBy(*by).orderBy(value)
    own = F.sum(weight).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.sum(weight).over(order) - (own - 1) / 2.0


def range_of(value: Column, cuts: Column) -> Column:
    """The range of value among RANGES - 1 sorted cuts, rising with value: odd where it equals a cut, even between cuts, 0 without cuts.

    Eight cuts apart are compared first, then those between, so that no lambda goes through all of them.
    """
    below = lambda k: F.coalesce((F.get(cuts, k) < value).cast("int"), F.lit(0))
    eights = sum((below(F.lit(8 * k - 1)) for k in range(1, RANGES // 8)), F.lit(0))
    place = 8 * eights + sum((below(8 * eights + j) for j in range(7)), F.lit(0))
    return 2 * place + F.coalesce((F.get(cuts, place) == value).cast("int"), F.lit(0))


def dealt_pairs(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """pairs(by, x, y) with the ranges _bx and _by of both values in their group, and _sx and _sy, which deal out the rows of a range of one value.

    A range and its share hold a few hundredths of a group at most. Cuts are one row for each group and go to the rows.
    """
    at = [k / RANGES for k in range(1, RANGES)]
    cuts = pairs.groupBy(*by).agg(*[F.array_sort(F.percentile_approx(v, at, 1_000)).alias(c) for v, c in ((x, "_cx"), (y, "_cy"))])
    told = pairs.join(F.broadcast(cuts), by, "left").withColumn("_bx", range_of(F.col(x), F.col("_cx"))).withColumn("_by", range_of(F.col(y), F.col("_cy"))).drop("_cx", "_cy")
    share = lambda b, other: F.when(F.col(b) % 2 == 1, F.pmod(F.hash(other), F.lit(RANGES))).otherwise(0)
    return told.withColumn("_sx", share("_bx", y)).withColumn("_sy", share("_by", x))


def spearman(df: DataFrame, by: list[str], x: str, y: str, large: bool = False) -> DataFrame:
    """by, n and rho: Pearson correlation of average ranks.

    Equal pairs are folded first. Groups of few rows are ranked in one exchange by group, each by a sort that can spill. With large,
    a group is no task's work: its values are ranked within ranges, and products of ranks are put together from sums by pair of ranges,
    whose counts tell where each range starts.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_c"))
    n, c, rx, ry = F.sum("_c"), F.col("_c"), F.col("_rx"), F.col("_ry")
    # Ranks have the mean (n + 1) / 2, and halves are exact, so sums of products lose nothing before the last step.
    products = {"_xx": rx * rx, "_yy": ry * ry, "_xy": rx * ry}
    if large:
        parts, told = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt_pairs(pairs, by, x, y)
        for value, name in ((x, "x"), (y, "y")):
            own = [*by, f"_b{name}", f"_s{name}"]
            # Equal values of an odd range share one rank, which is known from counts. The number of parts is fixed, else small ones are merged into large tasks.
            told = told.repartition(parts, *own).withColumn(f"_r{name}", F.when(F.col(f"_b{name}") % 2 == 0, _rank("_c", own, value)).otherwise(0.0))
        cells = told.groupBy(*by, "_bx", "_by").agg(n.alias("_c"), F.sum(c * rx).alias("_x"), F.sum(c * ry).alias("_y"), *[F.sum(c * v).alias(k) for k, v in products.items()])
        for name in "xy":
            order = Window.partitionBy(*by).orderBy(f"_b{name}")
            own = F.sum("_c").over(order.rangeBetween(Window.currentRow, Window.currentRow))
            cells = cells.withColumn(f"_r{name}", F.sum("_c").over(order) - F.when(F.col(f"_b{name}") % 2 == 0, own).otherwise((own - 1) / 2.0))
        inner = {"_xx": 2 * rx * F.col("_x"), "_yy": 2 * ry * F.col("_y"), "_xy": rx * F.col("_y") + ry * F.col("_x")}
        sums = cells.groupBy(*by).agg(n.alias("n"), *[F.sum(c * v + inner[k] + F.col(k)).alias(k) for k, v in products.items()])
    else:
        ranked = pairs.withColumn("_rx", _rank("_c", by, x)).withColumn("_ry", _rank("_c", by, y))
        sums = ranked.groupBy(*by).agg(n.alias("n"), *[F.sum(c * v).alias(k) for k, v in products.items()])
    mean = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4.0
    return sums.select(*by, "n", F.try_divide(F.col("_xy") - mean, F.sqrt((F.col("_xx") - mean) * (F.col("_yy") - mean))).alias("rho"))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, out: str = "fdr", monotone: bool = True) -> DataFrame:
    """Adjusted p values within each family of tests.

    With monotone, equal p values rank by their last place and a running minimum from the largest follows; without it,
    ties share their mean rank. Distinct p values are ranked and gone through in ranges.
    """
    small = F.greatest(F.coalesce(15 + F.floor(F.log2(F.col(p) / 0.02)), F.lit(0)), F.lit(0))  # halvings below 0.02, even steps above
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n")).withColumn("_range", F.when(F.col(p) >= 0.02, 16 + F.floor(F.col(p) * 48)).otherwise(small))
    placed = running_sums(counts, by, p, {"_last": "_n"}, keep_range=True)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_m"))
    place = F.col("_last") if monotone else F.col("_last") - F.col("_n") + (F.col("_n") + 1) / 2
    raw = placed.join(sizes, by).select(*by, p, "_range", (F.col(p) * F.col("_m") / place).alias("_raw"))
    if monotone:
        least = raw.groupBy(*by, "_range").agg(F.min("_raw").alias("_least"))
        above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        later = least.select(*by, "_range", F.min("_least").over(above).alias("_later"))
        down = Window.partitionBy(*by, "_range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
        raw = raw.withColumn("_own", F.min("_raw").over(down)).join(later, [*by, "_range"]).select(*by, p, F.least("_own", "_later").alias("_raw"))
    adjusted = raw.select(*by, p, F.least(F.col("_raw"), F.lit(1.0)).alias(out))
    return df.join(adjusted, [*by, p], "left")


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """by, n_pos, n_neg and auc by the rank sum; null without both classes."""
    own = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return folded_auc(own.groupBy(*by, score).agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_p")), by, score)


def folded_auc(counts: DataFrame, by: list[str], score: str) -> DataFrame:
    """As auc, of rows that are folded already: counts(by, score, _n, _p) of all rows and of positive ones. counts is read several times."""
    ranked = running_sums(counts, by, score, {"_upto": "_n"}).withColumn("_rank", F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("_p").alias("n_pos"), (F.sum("_n") - F.sum("_p")).alias("n_neg"), F.sum(F.col("_rank") * F.col("_p")).alias("_r"))
    wins = F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return sums.select(*by, "n_pos", "n_neg", F.try_divide(wins, (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def eta_squared(df: DataFrame, vector: str, label: str) -> DataFrame:
    """dim, between, total and eta2 for every dimension: share of the variance that lies between labels.

    Sums are kept for (label, dimension), so a row count never meets one task.
    """
    long = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(label, F.posexplode(vector).alias("dim", "x"))
    long = long.select(label, "dim", F.col("x").cast("double").alias("x"))
    sums = long.groupBy(label, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = sums.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g"))
    centre = F.col("s") * F.col("s") / F.col("n")
    parts = whole.select("dim", (F.col("g") - centre).alias("between"), (F.col("q") - centre).alias("total"))
    return parts.select("dim", "between", "total", F.try_divide("between", "total").alias("eta2"))


def fisher_two(p1: Column, p2: Column, floor: float = 1e-300) -> Column:
    """Fisher's combination of two p values (chi squared with four degrees of freedom has a closed form)."""
    s = -F.log(F.greatest(p1, F.lit(floor))) - F.log(F.greatest(p2, F.lit(floor)))
    return F.exp(-s) * (1 + s)


def numbered(df: DataFrame, key: str, prefix: int, start: int, out: str) -> DataFrame:
    """Dense numbers from start in the order of a string key, without one task that sees all rows.

    Keys are unique; equal ones would be numbered in any order. Rows are counted by the first prefix characters; a running sum over those counts gives each bucket's first number.
    """
    bucketed = df.withColumn("_bucket", F.substring(key, 1, prefix))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return bucketed.join(before, "_bucket").withColumn(out, local + F.col("_before") + F.lit(start - 1)).drop("_bucket", "_before")
