"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "specimen_size", "missing_glyphs", "kern_pairs", "spacing", "merge_libraries", "mirror_plan", "library_state",
    "otsu", "dominant_color", "components", "distance_within", "template_scores", "chamfer_scores",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from inkspan.plans import catalog
    from inkspan.session import build_session

    spark = build_session("bench", master=f"local[{cpus}]", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    queries, took = catalog.queries(), {}
    for name in names:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
