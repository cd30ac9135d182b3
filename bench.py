"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores; arguments, if
any, name the queries to run instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from textloom.session import local_session
from workloads.queries import QUERIES

HEADLINE = (
    "clean_html_p3",
    "catalogue_job_s7",
    "keep_first_k1_f2",
    "chunk_documents_p9_w5",
    "document_frequency_m2_m3",
    "tfidf_weights_m4_m5",
    "stratified_split_w4",
    "metrics_a6_a7",
    "embed_chunks_v1_v3",
    "top_matches_v5_w2",
    "retrieve_chunks_v5",
    "answer_requests_q1_j3",
    "fit_and_predict_m7_m8",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=int(cores))
    # One untimed pass over a table, so that starting the JVM is not part of the first query.
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("max(length(text))").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
