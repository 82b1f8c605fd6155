"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from veritab import Check, registry, run_suite
from veritab.registry.base import AS_OF, catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))

# One registered query per kind of work: scan, group, join, statistic, history.
HEADLINE = [
    "CMP-null", "VAL-regex", "VAL-lookup", "PRED-filter", "SUITE-flagship", "UNQ-composite", "UNQ-temporal",
    "UNQ-fuzzy-lev", "CNS-interrecord", "CNS-crosstable", "CNS-aggregation", "ACC-reference", "ACC-zscore",
    "ACC-iqr", "REC-onetoone", "REC-field", "REC-tolerance", "EVD-rows.duplicates", "PRF-basic",
    "PRF-numeric", "PRF-top", "HIS-scorecard", "HIS-effect", "HIS-mttr", "ANO-passrate", "INC-restime",
]
_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]


def suite_of(size: int) -> list[Check]:
    return [Check(f"c{i}", "validity", "range", "li", (_COLUMNS[i % len(_COLUMNS)],),
                  {"min_value": i, "max_value": 1000 * i + 1}) for i in range(size)]


def seconds(build) -> float:
    start = time.perf_counter()
    frame: DataFrame = build()
    frame.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("veritab-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    seconds(lambda: known["CMP-null"](spark, SF_DIR))  # start-up and first compilation
    times = {name: seconds(lambda n=name: known[n](spark, SF_DIR)) for name in HEADLINE}
    for size in (1, 10, 50):
        times[f"suite_{size}_checks"] = seconds(
            lambda n=size: run_suite(catalog(spark, SF_DIR), suite_of(n), AS_OF))
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    sys.exit(main())
