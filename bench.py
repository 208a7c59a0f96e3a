"""Headline fits and queries on one machine; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1). BENCH_CPUS: threads (default 8).
Each query runs once to warm up code and caches on another model of its kind, then counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # passes are spread over threads themselves
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from splinewright.catalog import _lines, flagship  # noqa: E402
from splinewright.gam import GAM  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: The reference's own benchmark has one continuous smooth, two, a tensor and a smooth by factor, per family.
MODELS = {
    "cr": "s(z, k=10, bs='cr')",
    "two": "s(z, k=8, bs='cr') + s(v, k=8, bs='cr')",
    "te": "te(z, v, k=5)",
    "cr_by": "s(z, by=fac, k=10, bs='cr') + fac",
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    v = F.pmod(F.col("l_orderkey") * 2654435761 + F.col("l_linenumber") * 40503, F.lit(1_000_003)) / 1_000_003
    df = _lines(spark, SF_DIR).withColumn("v", v).persist()
    n = df.count()

    def fit(family, key, **kw):
        GAM(f"y_{family} ~ {MODELS[key]}", family=family, **kw).fit(df)

    runs = {f"fit_{f}_{k}": (lambda f=f, k=k: fit(f, k)) for f in ("gaussian", "poisson", "binomial", "gamma") for k in MODELS}
    runs["fit_gaussian_cr_jobs"] = lambda: fit("gaussian", "cr", local=False)
    runs["fit_poisson_cr_jobs"] = lambda: fit("poisson", "cr", local=False)
    runs["fit_gaussian_compressed_te"] = lambda: GAM("y_gaussian ~ te(x1, x2, k=5)").fit(df)
    runs["fit_predict_flagship"] = lambda: flagship(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    fit("gaussian", "cr")
    fit("poisson", "cr", local=False)
    took = {}
    for name, run in runs.items():
        t = time.time()
        run()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR), "rows": n}))


if __name__ == "__main__":
    main()
