"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores) and
BENCH_RUNS (default 2; the best run counts) can be set.
"""

from __future__ import annotations

import json
import os
import time

from netloom.plans.queries import QUERIES
from netloom.session import build_session

HEADLINE = (
    "f1_conn_outside_subnet_by_proto", "f2_dns_answers_kept", "f3_all_logs_filtered", "j2_subnet_table_anti_join",
    "f9_conn_sample", "a1_dhcp_fingerprints", "j1_dhcp_filled", "p1_client_hello_rows", "p3_ja4s_log", "p4_ja3_ja4_log",
    "w2_running_state", "p6_flows", "t1_capture_windows", "w3_greedy_chunks", "k3_payload_round_trip",
    "s1_log_files_one_layout", "s6_captures_decoded", "a7_run_summary", "t4_whole_run",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, errors = {}, {}
    for name in HEADLINE:
        taken = []
        try:
            for _ in range(runs):
                begin = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - begin)
        except Exception as problem:
            errors[name] = str(problem)[:300]
        else:
            seconds[name] = round(min(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                **({"errors": errors} if errors else {}),
            }
        )
    )


if __name__ == "__main__":
    main()
