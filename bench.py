"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) names the tables, ``BENCH_CPUS`` (default
8) the threads. Each query runs once to warm up and once for its time; all of its rows are
computed and thrown away. Arguments name other queries to run.
"""

import importlib
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINES = [
    "slot_commit_summary", "account_commit_summary", "prefilter_combined", "prefilter_merge_union", "prefilter_token_accounts", "shared_scan_routing",
    "account_memcmp", "owner_routing", "flatten_instructions", "path_from_stack_heights", "split_outer_logs", "fallback_routing", "record_keys_headers",
    "duplicate_last_wins", "gated_flush", "fork_discard", "late_event_counts", "resume_dedup", "passthrough_watermark", "token_transfer_decode",
    "token_instructions", "op1_quality", "op2_attention", "op3_langid", "op4_rans", "op5_warc", "op6_mixing", "op7_decontaminate", "op8_extract", "op9_bagminhash", "op10_token_counts", "pipeline",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.TemporaryDirectory(prefix="bench-")  # one machine: its folder is shared
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared.name}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = importlib.import_module("__spark_entry__").queries()
    took = {}
    for name in [n for n in (sys.argv[1:] or HEADLINES) if n in known]:
        for _ in range(2):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
