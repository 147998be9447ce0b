"""Headline queries, each run to completion once; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """training_slice tile_features tile_label augment_rotations edge_class style_latent style_score rle_decode
extract_palette quantize_weighted tile_slice_dedup adjacency_degree compat_totals map_features map_violations elite_archive
fb_stats fb_examples fb_preferred_style bm25_search kb_probe fb_stream_windows split_exact v_symbols""".split()


def main() -> None:
    import gridweave.plans.catalog  # noqa: F401
    from gridweave.plans.registry import QUERIES
    from gridweave.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("gridweave-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    names = sys.argv[1:] or HEADLINE
    took = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
