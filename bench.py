"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from trendloom.plans import QUERIES
from trendloom.session import local_session

HEADLINE = [
    "category_stats",
    "topic_stats",
    "rising",
    "rising_categories",
    "representative_papers_by_topic",
    "sample_by_archive",
    "sample_by_topic",
    "parent_topic",
    "import_assignments",
    "import_report",
    "clean_text",
    "c_tf_idf",
    "top_words",
    "topic_similarity",
    "representative_documents",
    "approximate_distribution",
    "knn_cosine",
    "knn_hamming",
    "density_clusters",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8, "16g")
    spark.read.parquet(f"{sf_dir}/part.parquet").count()  # the session is up before the clock runs
    seconds = {}
    for name in names or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main(sys.argv[1:])
