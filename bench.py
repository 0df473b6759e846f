"""Headline queries, timed. Prints one JSON line: first calls under ``queries``, second calls under ``warm``.

Shared replays are dropped before every call, so each query pays for its own work.

BENCH_SF_DIR (default /root/testdata/sf0.1) selects the data, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import registry, study_queries  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINES = [
    "decayed_sentiment", "news_flow", "top_contributors", "index_scores", "availability_audit", "eligibility_by_cutoff", "exact_dedup", "near_dup_leaders",
    "detected_entities", "lexicon_score", "rake_keywords", "forecast_horizons", "rolling_statistics", "baselines_pit", "factor_predictions", "core_metrics",
    "feature_analysis", "walk_forward", "param_sweep", "stream_session_flow",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    queries = registry.queries()
    times, warm = {}, {}
    for seconds in (times, warm):
        for name in HEADLINES:
            study_queries.forget()
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "warm": warm,
                      "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")}))


if __name__ == "__main__":
    main()
