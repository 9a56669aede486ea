"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

value sums the queries that every round has timed; later ones are reported beside them under more.
"""

from __future__ import annotations

import json
import os
import time

from cellweave.plans import registry
from cellweave.session import local_session

HEADLINE = (
    "tokenize_cells", "gene_median_exact", "derived_stats", "cell_zscore_filter", "coexpression_pairs", "normalize_total", "project_many_to_one", "resolve_gene_ids", "gene_universe_counts", "best_second_label", "catalog_stats", "eta2_per_dim",
    "spearman_by_group", "bh_adjust",
)
MORE = ("ortholog_tiers", "bootstrap_z", "cosine_silhouette", "gene_set_enrichment", "conserved_edges", "matrix_market_round_trip", "dose_levels", "rank_sums", "neighbour_purity", "lifted_counts")


def timed(spark, sf_dir: str, names: tuple[str, ...]) -> dict[str, float]:
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times = timed(spark, sf_dir, HEADLINE)
    more = timed(spark, sf_dir, MORE)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "more": more, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
