"""Time headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from waymesh.catalog import all_queries  # noqa: E402

HEADLINE = (
    "patch_join", "unmatched_reason", "in_out_degree", "group_semantic_nodes", "relation_cardinality", "relation_lookup",
    "lane_road_join", "arrow_concat", "restriction_pair_join", "trajectory_aggregate", "gap_sessionize", "quantile_stats",
    "node_alias_join", "nearest_join", "distance_join", "point_surface_join", "rcsd_context_50m", "coverage_ratio",
    "sampled_buffer_mismatch", "connected_components", "leaf_pruning", "plan_conflict_gate", "fusion_units",
    "anchor_states", "movements_build", "rule_decision", "length_share_by_class", "surface_fusion", "multiset_f1",
    "rank_owner_candidates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    seconds = {}
    queries["patch_join"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


main()
