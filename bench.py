"""Runs the headline queries and prints one JSON line: BENCH_SF_DIR (default sf0.1), BENCH_CPUS cores.

Beside the tables' queries it measures the published vector scan's shape (10,000
random unit vectors of 384 dimensions, int8) end to end: reading, quantizing,
scoring 2,000 queries in one batch and the exact ten best of each.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402

from lodestone.operators import search  # noqa: E402
from lodestone.plans import queries as own  # noqa: E402
from lodestone.session import build_session  # noqa: E402

HEADLINE = (
    "h1_quantized_cosine_topk", "l1_batch_topk_arrow", "j4_quantize", "j20_bm25_topk", "l3_rrf_fusion", "g1_fixed_chunks", "c9_checksum_dedup",
    "a2_html_headings", "n4_policy_first_deny", "n7_router", "f5_ledger_verify", "j28_injection_sanitize", "p5_daily_quota",
)
VECTORS, DIMENSIONS, QUERIES = 10_000, 384, 2_000


def finish(df) -> None:  # noqa: ANN001
    df.write.format("noop").mode("overwrite").save()


def published_scan(spark, cpus: int) -> float:  # noqa: ANN001
    """Seconds for QUERIES searches over VECTORS, of the second of two runs."""
    rng = np.random.default_rng(42)
    with tempfile.TemporaryDirectory() as folder:
        for name, n, parts in (("vectors", VECTORS, cpus), ("queries", QUERIES, 1)):
            v = rng.uniform(-1, 1, (n, DIMENSIONS))
            v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
            os.mkdir(f"{folder}/{name}")
            for i, rows in enumerate(np.array_split(np.arange(n), parts)):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * DIMENSIONS + 1, DIMENSIONS), pa.int32()), pa.array(v[rows].ravel()))
                pq.write_table(pa.table({"id": pa.array(rows), "vector": lists}), f"{folder}/{name}/{i}.parquet")
        vectors = spark.read.parquet(f"{folder}/vectors").withColumnRenamed("id", "chunk_id")
        queries = spark.read.parquet(f"{folder}/queries").withColumnRenamed("id", "query_id")
        for _ in range(2):
            began = time.perf_counter()
            finish(search.vector_search(vectors, queries, 10))
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = build_session("bench", cpus)
    finish(own.QUERIES[HEADLINE[0]](spark, sf_dir))  # starts the session's code paths
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        finish(own.QUERIES[name](spark, sf_dir))
        took[name] = round(time.perf_counter() - began, 3)
    total = round(sum(took.values()), 3)
    scan = published_scan(spark, cpus)
    took["scan_10k_384_2000_queries"] = round(scan, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": took, "scan_ms_per_query": round(1000 * scan / QUERIES, 3), "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
