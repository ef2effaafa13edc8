"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pair_canonical_edges", "induced_subgraph", "catalog_a_parse", "catalog_fold", "physical_edges", "candidate_pairs",
    "shared_neighbors", "adamic_adar", "l3_walks", "degree_product_cutoff", "location_overlap", "atlas", "atlas_stats",
    "rank_absent", "spearman", "auroc_ap", "hit_list", "components", "split_edge_group", "neighbor_mean",
]


def main() -> None:
    from edgeloom.driver.queries import QUERIES
    from edgeloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()     # start the executors
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
