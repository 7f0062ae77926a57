"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from maskframe.catalog import QUERIES
from maskframe.session import local_session

HEADLINE = (
    "mask_phone", "mask_email", "mask_table_orders", "label_entities_table", "pii_spans", "tokenize",
    "rewrite_file_refs", "detect_in_documents", "detokenize_documents", "might_contain_sensitive",
    "mask_json_events", "desensitize_documents", "guard", "mask_sheets", "mask_files",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
