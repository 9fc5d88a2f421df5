"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from lodestone import queries as Q  # noqa: E402
from lodestone.operators import fold, marks, pyramid  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ("a13_fold_marks", "flagship_dominant", "g01_classify", "g02_marks", "g09_probe", "b04_quadtree", "b05_aggregate", "g13_cube", "q01_fold_equals", "q01_fold_range", "q03_mki", "c03_layout", "e06_quantile")


def run(df) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    q, out = Q.queries(), {}
    run(q["g02_marks"](spark, SF))  # warm up
    for n in NAMES:
        out[n] = round(min(run(q[n](spark, SF)) for _ in range(2)), 3)
    # the fold over a pre-built cube: every equality, sliding windows of quarters, and both together
    cube = pyramid.cube(Q.facts(spark, SF), Q.ROOT, Q.GRAIN, marks.cube_partials(Q.SUPPLY)).persist()
    cube.count()
    days = [f"{y}-{m:02d}-01" for y in range(1995, 2002) for m in (1, 4, 7, 10)]
    equals = [{"flag": f} for f in "ANR"] + [{"status": s} for s in "OF"]
    windows = [{"quarter": (a, b)} for a, b in zip(days, days[3:])]
    contexts = [fold.Context(e) for e in equals] + [fold.Context({}, w) for w in windows] + [fold.Context(e, w) for e in equals for w in windows[::4]]
    took = sorted(run(fold.fold_cube(cube, Q.trees("weighted", "top_flag"), c, Q.TILES, Q.GRAIN)) for c in contexts)
    out["fold_cube_p50"], out["fold_cube_p95"] = round(took[len(took) // 2], 3), round(took[int(len(took) * 0.95)], 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": SF, "contexts": len(contexts)}))
    spark.stop()


if __name__ == "__main__":
    main()
