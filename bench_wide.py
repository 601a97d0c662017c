"""Cleaning, norms and a Gram matrix on a wide synthetic table: 100,000 x 1,000 with gaps.

    python bench_wide.py [rows] [features]

Writes the table once to the shared folder, then times each operator twice;
the second time is the one to read.
"""

import json
import os
import sys
import time

from quarrystat.operators import gram, missing, stats
from quarrystat.session import build_session, scratch_path
from quarrystat.sources import synthetic

ROWS, FEATURES = 100_000, 1_000


def measure(spark, n: int = ROWS, d: int = FEATURES) -> dict:
    """Seconds of each job on a table of ``n`` rows and ``d`` features."""
    path = scratch_path(spark, "wide")
    synthetic.inject_nan(synthetic.gaussian_rows(spark, n, d, partitions=32), 0.05).write.parquet(path)
    df = spark.read.parquet(path)
    full = missing.impute_mean(df)
    jobs = {"column_check": lambda: missing.column_check(df),
            "column_row_check": lambda: missing.column_row_check(df),
            "clean_table": lambda: missing.clean_table(df)[0],
            "col_l2": lambda: stats.col_l2(df),
            "gram": lambda: gram.gram(full)}
    took = {}
    for _ in range(2):
        for name, job in jobs.items():
            t = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - t, 3)
    return {"rows": n, "features": d, "seconds": took}


def main() -> None:
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", 8, "16g")
    print(json.dumps(measure(spark, *(int(a) for a in sys.argv[1:3]))))
    spark.stop()


if __name__ == "__main__":
    main()
