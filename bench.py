"""Wall time of headline queries: one warm-up each, then the median of three runs into a no-op sink. Prints one line of JSON."""

import json
import os
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = ["a1_ledger_scan", "a5_append_ledger", "c2_backoff_join", "c11_asof_join", "e1_entity_profile", "e10_days_of_edge", "f1_claim_log_odds", "f2_claim_waterfall", "f3_claim_leave_one_out", "g3_index_percentile_rank", "h3_stage_durations", "h5_opportunity_timing", "h6_ols_trend", "h7_multi_asof_rescore", "j2_resolve_entities", "j7_text_signal_score"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "5g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from palimpsest.plans import QUERIES

    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
