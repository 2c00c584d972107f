"""Headline queries, timed in full: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Every query runs once to warm up and is then timed
BENCH_RUNS times (default 3); the median counts. Results go to a sink that
reads every row and column.
"""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from coverlens.session import local_session  # noqa: E402

HEADLINE = ["C2_due_reminders", "R1_reminder_backfill", "A1_A2_vault_summary", "W1_vault_catalog", "W2_next_expiring",
            "P13_claim_dossier", "C3_brand_support", "C10_component_coverage", "C9_cascade_delete", "B1_bill_record",
            "B1_on_documents", "G2_first_acceptable", "E1_intake", "T1_redact_pii", "V2_diagnose", "V3_claim_answer",
            "P12_route_messages", "P14_leads", "W3_request_rate", "R2_limiter", "R3_sessions"]


def timed(spark, name, sf):
    start = time.time()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, sf)
        seconds[name] = round(statistics.median(timed(spark, name, sf) for _ in range(runs)), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
