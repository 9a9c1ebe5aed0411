"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from admitlake import plans
from admitlake.session import local_session

HEADLINE = (
    "training_join", "features_fit", "features_interactions", "target_encoding_oof", "sample_weights", "auc_rank", "clean_text", "keywords_topk", "token_chunks", "content_hash_dedupe",
    "url_normalize", "html_main", "dense_topk", "bm25_topk", "rrf_fusion", "delta_changes", "breaker_islands", "ttl_cache",
)


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        times = []
        for k in range(runs + 1):
            began = time.time()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.time() - began)
        found[name] = round(median(times), 3)
        print(name, found[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
