"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "token_stats relevance_density source_ranking sentence_split claim_merge conflict_pairs best_overlap entailment dense_topk keyword_topk "
    "retrieve_abstain kg_expand kg_shortest_path copy_components citation_integrity publication_status growth_by_nation share_of_region "
    "coverage_missing alignment_clusters conversation_recent budget_fold user_sessions html_main_text"
).split()


def main() -> None:
    from quarrylight.plans import catalogue
    from quarrylight.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # the session is up before the first clock starts
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    name = os.path.basename(os.path.normpath(sf_dir))
    sf = float(name[2:]) if name[2:].replace(".", "", 1).isdigit() else name
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
