"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame operations. Every source is cut by a hash of its rows into blocks; their number (and so that of the
rows in one) grows as the square root of the table, so neither the list of a source's blocks nor one block is large. A
source permutes its blocks by an odd factor and an offset of its own. Its target number of words becomes block quotas:
whole passes over its blocks, the first blocks of one further pass, and a part of one block. The quotas of all sources
are split among the output shards by a binary tree: at each node the left half's share of every source is a
multivariate hypergeometric draw, so quotas add up exactly. Each shard then owns a disjoint range of every source's
permuted blocks; a row is taken once for each slot of its block that a shard owns, and shards order their rows by hash.

Texts are not shuffled: sizes and hashes decide, and what they decide fits in a row of plan for each source. The joins
with that plan leave the broadcast to the optimizer, which checks its size. One task sees a row for each source, to put
them in order, and one the blocks of a source.

Defined results: null text has size 0 and is taken 0 times; null source is a source of its own, last in order; null or
repeated doc_ids are ordinary rows, and of rows that are alike in everything carried any may be the ones taken once
more; an empty table gives an empty table; of the input only the id, the columns in `keep` and the results are
returned, and a column of `keep` that bears a result's name is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, words

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has this share of all words, and takes a source this often at most.
TOTAL_SHARE, MOST = 1.5, 2


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """One row per source of sized(source, size): its words, weight and target.

    The water level: sources in the order of cap / weight are capped for as long as their cap is below their share
    of what the earlier ones leave; all others get weight times the same level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    one = Window.partitionBy(F.lit(0))
    n = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    per = per.withColumn("weight", weight).withColumn("cap", cap).withColumn("level_of_cap", cap / F.col("weight"))
    order = one.orderBy("level_of_cap", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(one) * float(total_share) - before) / left)
    per = per.withColumn("capped", F.col("level_of_cap") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(one)  # of the first that is not capped
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return per.withColumn("target", target).select("source", "source_size", "source_rows", "weight", "target")


def hypergeometric(total: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """A draw of how many of `drawn` items out of `total` are among the `good` ones, by inversion.

    Terms run over mode +- (12 standard deviations + 12), cut to the support; what lies outside weighs under 1e-30.
    """
    n, k, d = (x.cast("double") for x in (total, good, drawn))
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    share = k / F.greatest(n, F.lit(1.0))
    reach = F.ceil(F.sqrt(F.greatest(F.lit(0.0), d * share * (1 - share))) * 12 + 12)
    lo = F.greatest(F.lit(0.0), d + k - n, mode - reach).cast("long")
    hi = F.least(d, k, mode + reach).cast("long")
    case = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), lo.alias("lo"), hi.alias("hi"), uniform.alias("u"))

    def log_weights(c: Column) -> Column:
        """Running logs of P(x) / P(lo), as structs of x and the log."""
        step = lambda x: F.log((c.k - x + 1) * (c.d - x + 1) / (x * (c.n - c.k - c.d + x)))
        first = F.array(F.struct(c.lo.alias("x"), F.lit(0.0).cast("double").alias("lw")))
        add = lambda a, x: F.concat(a, F.array(F.struct(x.alias("x"), (F.element_at(a, -1)["lw"] + step(x)).alias("lw"))))
        return F.when(c.hi > c.lo, F.aggregate(F.sequence(c.lo + 1, F.greatest(c.hi, c.lo + 1)), first, add)).otherwise(first)

    def pick(w: Column, c: Column) -> Column:
        top = F.array_max(F.transform(w, lambda t: t.lw))
        sums = let(top, lambda m: F.transform(w, lambda t: F.struct(t.x.alias("x"), F.exp(t.lw - m).alias("p"))))

        def invert(p: Column) -> Column:
            whole = F.aggregate(p, F.lit(0.0).cast("double"), lambda a, t: a + t.p)
            start = F.struct(F.lit(0.0).cast("double").alias("cum"), F.lit(None).cast("long").alias("x"))
            return let(whole, lambda z: F.aggregate(p, start, lambda a, t: F.struct((a.cum + t.p).alias("cum"), F.coalesce(a.x, F.when(a.cum + t.p >= c.u * z, t.x)).alias("x")))["x"])

        return F.coalesce(let(sums, invert), c.hi)

    return let(case, lambda c: let(log_weights(c), lambda w: pick(w, c)))


def uniform(*keys: Column) -> Column:
    """A double in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / float(1 << 52)


def split_quotas(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """quotas(source, slots) split among 2**levels shards: (source, shard, first_slot, slots), exact in every source.

    Each level doubles the nodes. A node's draw is dealt in two steps, so that no row holds more than about the square
    root of all sources: first among hash groups of sources by the groups' totals, then inside each group. In either,
    the parts are taken in order, each draw conditional on those before.
    """
    one = quotas.agg(F.count(F.lit(1)).alias("n")).first()
    groups = max(1, round((one.n or 0) ** 0.5))
    nodes = quotas.select("source", F.col("slots").cast("long"), F.lit(0).cast("long").alias("node"), F.pmod(F.xxhash64("source"), F.lit(groups)).alias("family"))

    def deal(rows: DataFrame, by: list[str], part: str, level: int) -> DataFrame:
        """rows(by, part, slots, draw): by, part and got, where draw slots of each `by` are drawn among its parts."""
        kind = rows.schema[part].dataType.simpleString()
        per = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(part).alias("part"), F.col("slots")))).alias("parts"), F.sum("slots").alias("total"), F.max("draw").alias("draw"))
        start = F.struct(F.col("total").alias("rest"), F.col("draw").cast("long").alias("draw"), F.array().cast(f"array<struct<part:{kind},got:bigint>>").alias("out"))

        def fold(a: Column, p: Column) -> Column:
            got = hypergeometric(a.rest, p.slots, a.draw, uniform(F.lit(seed), F.lit(level), F.lit(part), *[F.col(b) for b in by], p.part))
            got = F.when(a.rest == p.slots, a.draw).otherwise(got)
            return let(got, lambda g: F.struct((a.rest - p.slots).alias("rest"), (a.draw - g).alias("draw"), F.concat(a.out, F.array(F.struct(p.part.alias("part"), g.alias("got")))).alias("out")))

        return per.select(*by, F.explode(F.aggregate("parts", start, fold)["out"]).alias("p")).select(*by, F.col("p.part").alias(part), F.col("p.got").alias("got"))

    for level in range(levels):
        totals = nodes.groupBy("node", "family").agg(F.sum("slots").alias("slots"))
        totals = totals.join(totals.groupBy("node").agg(F.floor(F.sum("slots") / 2).alias("draw")), "node")
        drawn_ = deal(totals, ["node"], "family", level).withColumnRenamed("got", "draw")
        got = deal(nodes.join(drawn_, ["node", "family"]), ["node", "family"], "source", level)
        halves = nodes.join(got, ["node", "family", "source"])
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("got").alias("slots")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("slots") - F.col("got")).alias("slots")))
        nodes = halves.select("source", "family", F.explode(sides).alias("h")).select("source", "h.slots", "h.node", "family")
        nodes = materialize(nodes, "mix-tree")  # a row for each source and node; keeps the lineage short
    order = Window.partitionBy("source").orderBy("node")
    return nodes.select("source", F.col("node").alias("shard"), (F.sum("slots").over(order) - F.col("slots")).alias("first_slot"), "slots").where("slots > 0")


#: Rows of the mix that a shard holds, about; sets the depth of the tree.
SHARD_ROWS = 1_000_000


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most: float = MOST,
    shard_levels: int | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every row of docs with size, source_size, target, taken (words), draws and local_order.

    draws holds one (shard, pass) for each slot of the tree that takes the row; `keep` names further columns to carry
    along. docs is read twice: once for sizes, of which only hashes and numbers are kept, and once for the rows
    themselves, which meet one row of plan for each source. So texts are not shuffled here.
    """
    carried = [c for c in keep if c not in ("size", "source_size", "target", "taken", "draws", "local_order")]
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    # Rows that agree in everything carried share a hash; the hash alone would pass over nulls.
    same = list(dict.fromkeys([id_col, text_col, *carried]))
    hashed = F.xxhash64(F.lit(seed), key, *same, *[F.col(c).isNull() for c in same])
    size = F.size(words(F.col(text_col))).cast("long")
    own = docs.select(F.col(source_col).cast("string").alias("source"), key.alias("_key"), hashed.alias("_hash"), size.alias("size"))
    own = materialize(own, "mix-sized")
    rows = own.count()
    # A power of two near the square root: the list of a source's blocks and a block's rows grow alike.
    n_blocks = 1 << max(0, round(math.log2(max(rows, 1)) / 2))
    levels = shard_levels if shard_levels is not None else max(4, math.ceil(math.log2(max(rows, 1) * total_share / SHARD_ROWS)))
    # Each source's blocks in an order of its own: an odd factor and an offset permute the numbers below a power of two.
    factor, offset = (F.pmod(F.xxhash64(F.lit(seed + i), "_key"), F.lit(1 << 20)) for i in (1, 2))
    place = F.pmod(F.pmod(F.col("_hash"), F.lit(n_blocks)) * (2 * factor + 1) + offset, F.lit(n_blocks))
    own = own.withColumn("place", place)

    blocks = materialize(own.groupBy("source", "_key", "place").agg(F.sum("size").alias("block_size")), "mix-blocks")
    targets = source_targets(blocks.select("source", F.col("block_size").alias("size")), weights, total_share, most)
    targets = targets.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source", "source_rows", "weight")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialize(targets, "mix-targets")

    # The further pass: blocks before the cut fit whole; the block at the cut is the first that does not.
    running = Window.partitionBy("_key").orderBy("place")
    until = blocks.drop("source").withColumn("until", F.sum("block_size").over(running)).join(targets.where("rest > 0").select("_key", "rest"), "_key")
    cut = until.where(F.col("until") > F.col("rest")).groupBy("_key").agg(F.min_by(F.struct(F.col("place").alias("cut_place"), (F.col("rest") - (F.col("until") - F.col("block_size"))).alias("left")), "place").alias("c"))
    cut = materialize(cut.select("_key", "c.cut_place", "c.left"), "mix-cuts")
    # In that block rows go in by hash. Rows that are alike are one group; the first group that does not fit gives what does.
    inside = own.where("size > 0").join(cut, "_key").where("place = cut_place").groupBy("_key", "left", "_hash").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    inside = inside.withColumn("until", F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("_key").orderBy("_hash")))
    over = inside.where(F.col("until") > F.col("left")).withColumn("room", F.col("left") - (F.col("until") - F.col("n") * F.col("size")))
    edge = over.groupBy("_key").agg(F.min_by(F.struct(F.col("_hash").alias("cut_hash"), F.floor(F.col("room") / F.col("size")).cast("long").alias("cut_rows"), F.pmod("room", F.col("size").cast("double")).alias("lack")), "_hash").alias("e"))
    plan = targets.join(cut.drop("left"), "_key", "left").join(edge.select("_key", "e.*"), "_key", "left")
    plan = materialize(plan, "mix-edges")

    # What a source then lacks goes to the one of its other rows whose size comes nearest.
    in_part = (F.col("place") < F.col("cut_place")) | ((F.col("place") == F.col("cut_place")) & (F.col("_hash") < F.col("cut_hash")))
    others = own.where("size > 0").join(plan.where("lack > 0").select("_key", "cut_place", "cut_hash", "lack"), "_key").where(~in_part)
    best = others.groupBy("_key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("lack")).alias("miss"), F.col("_hash").alias("extra_hash"))).alias("b"), F.max("lack").alias("lack"))
    extra = best.where("b.miss < lack").select("_key", "b.extra_hash")
    marks = materialize(plan.join(extra, "_key", "left").select("_key", "cut_hash", "cut_rows", "extra_hash"), "mix-marks")  # written, so that its size is known
    alike = own.join(marks, "_key").where((F.col("_hash") == F.col("extra_hash")) | (F.col("_hash") == F.col("cut_hash")))
    # Of n rows that are alike, so many get one more draw.
    one_more = F.coalesce(F.when(F.col("_hash") == F.col("cut_hash"), F.col("cut_rows")), F.lit(0)) + F.coalesce((F.col("_hash") == F.col("extra_hash")).cast("long"), F.lit(0))
    some = alike.withColumn("more", one_more).where("more > 0").groupBy("_key", "_hash").agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more"))
    some = materialize(some, "mix-some")

    slots = F.col("whole") * n_blocks + F.coalesce(F.col("cut_place") + 1, F.lit(0))
    shards = split_quotas(plan.select(F.col("_key").alias("source"), slots.alias("slots")), levels, seed)
    shards = shards.groupBy(F.col("source").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("first_slot", "slots", "shard"))).alias("ranges"))
    few = some.groupBy("_key").agg(F.collect_list(F.struct("_hash", "n", "more")).alias("some"))  # two rows a source at most
    plan = materialize(plan.join(shards, "_key", "left").join(few, "_key", "left").select("_key", "source_size", "target", "whole", "cut_place", "cut_hash", "ranges", "some"), "mix-plan")

    # The rows themselves. A row's slots are those of its block, one a pass; the tree's ranges say which shard draws each.
    named = {c: f"_keep_{c}" for c in carried}
    out = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(n) for c, n in named.items()], key.alias("_key"), hashed.alias("_hash"), size.alias("size")).withColumn("place", place)
    out = out.join(plan, "_key")
    owner = lambda slot: F.get(F.filter("ranges", lambda r: (r.first_slot <= slot) & (slot < r.first_slot + r.slots)), F.lit(0))["shard"]
    passes = F.filter(F.sequence(F.lit(0).cast("long"), F.col("whole")), lambda p: (p < F.col("whole")) | F.coalesce(in_part, F.lit(False)))
    draws = F.when(F.col("size") > 0, F.transform(passes, lambda p: F.struct(owner(p * n_blocks + F.col("place")).alias("shard"), p.alias("pass")))).otherwise(F.array().cast("array<struct<shard:bigint,pass:bigint>>"))
    mine = F.get(F.filter("some", lambda s: s["_hash"] == F.col("_hash")), F.lit(0))
    out = out.withColumn("_mine", mine).withColumn("draws", draws)
    out = out.withColumn("_again", F.array(F.struct(F.element_at("ranges", -1)["shard"].alias("shard"), F.col("whole").alias("pass"))))
    columns = ["_id", *named.values(), "_hash", "size", "source_size", "target", "draws", "_again"]
    out_rows = out.withColumn("draws", F.when(F.col("_mine").isNotNull() & (F.col("_mine.n") == F.col("_mine.more")), F.concat("draws", "_again")).otherwise(F.col("draws")))
    if some.where("more < n").limit(1).count():
        # Rows that are alike, of which a part gets one more draw: they are counted, and dealt out by number.
        folded = out.where("_mine.more < _mine.n").withColumn("_more", F.col("_mine.more")).groupBy(*columns, "_more").agg(F.count(F.lit(1)).alias("_n"))
        thousands = folded.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / 1000))))
        each = thousands.withColumn("_i", F.explode(F.sequence(F.col("_k") * 1000, F.least(F.col("_n"), (F.col("_k") + 1) * 1000) - 1)))
        each = each.withColumn("draws", F.when(F.col("_i") < F.col("_more"), F.concat("draws", "_again")).otherwise(F.col("draws"))).select(*columns[:-1])
        whole_groups = out_rows.where("_mine is null or _mine.more = _mine.n").select(*columns[:-1])
        out_rows = whole_groups.unionByName(each)
    out_rows = out_rows.withColumn("taken", F.size("draws") * F.col("size"))
    return out_rows.select(F.col("_id").alias(id_col), *[F.col(n).alias(c) for c, n in named.items()], "size", "source_size", "target", "taken", "draws", F.col("_hash").alias("local_order"))


def drawn(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """A row for each time that a row of mix() is taken, with its shard and a hash to order the shard by."""
    one = mixed.withColumn("_d", F.explode("draws"))
    return one.withColumn("shard", F.col("_d.shard")).withColumn("pass", F.col("_d.pass")).withColumn("local_order", F.xxhash64(F.lit(seed), "local_order", "pass")).drop("_d", "draws")
