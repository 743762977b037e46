"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from passagemill import build_session
from passagemill.registry import all_queries

HEADLINE = (
    "v4_recall_bm25",
    "v4_recall_methods",
    "r1_term_statistics",
    "r2_bm25_scores",
    "r4_dense_top10",
    "r5_rank_fusion",
    "r9_retrieve",
    "e1_encode",
    "t3_repair_layout_spacing",
    "t4_strip_html",
    "t9_document_id",
    "t14_tokenize",
    "c3_heading_paths",
    "c6_chunk_markdown",
    "c7_chunk_plain",
    "c8_chunk_layout",
    "c9_overlapped_windows",
    "c11_length_profile",
    "d1_assign_ids",
    "d3_append_documents",
    "d6_refresh_catalogue",
    "s16_first_seen_articles",
    "a6_similarities",
    "a9_bootstrap_ci",
    "a12_significance",
    "a16_stage_profile",
    "p5_distinct_questions",
    "p10_gates",
    "h1_conversation_summaries",
    "h4_history_within_budget",
    "w1_assembled_answers",
    "w2_index_upkeep",
    "s11_chunk_sink",
)


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times: dict[str, float] = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        # The noop sink computes every column of every row and moves nothing to the driver.
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        cold = run(name)
        times[name] = run(name)  # the second run is warm, so the order of the queries does not matter
        print(f"{name}: {times[name]}s (first {cold}s)", file=sys.stderr)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
