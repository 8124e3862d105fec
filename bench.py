"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textward.plans import catalog  # noqa: E402
from textward.session import build_session  # noqa: E402

HEADLINE = ("threats_by_vector_pages", "sanitize_pages_rendered", "sanitize_documents", "detect_documents", "report_rollup",
            "strip_comments_pages", "strip_tags_pages", "scan_secrets_documents", "secret_gate_documents", "scan_commands_events",
            "sanitize_json_events", "sanitize_record_orders", "sanitize_lines_conversations", "audit_chain_events",
            "audit_verify_events", "missing_claims_orders", "date_agreement_orders")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
