"""Headline queries at one scale; prints one JSON line.

Every query is computed in full (its rows are produced and dropped), in one session, after
a warm-up at the smallest cost. Staged inputs are rebuilt per query, so times are complete.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "team_record",
    "team_grouping_sets",
    "pair_map_mode",
    "player_overall",
    "player_map_mode",
    "top_players_per_mode",
    "current_roster",
    "trailing_ten",
    "recent_player_form",
    "running_meeting_no",
    "upsert_merge",
    "document_player_maps",
    "match_page_totals",
    "weighted_record",
    "mode_stats",
    "map_performance",
    "win_probability",
    "pick_pool",
    "weighted_record_asof",
    "recent_context",
    "h2h_before",
    "rating_history",
    "training_features",
    "asof_predictions",
    "accuracy_stats",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("matchlake-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from registry import REGISTRY

    REGISTRY["team_record"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
