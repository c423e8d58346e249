"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of cores. Each
query runs once to warm up and once for the clock; results are written to nowhere.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rankdraft.corpus import Corpus
from rankdraft.plans.stage import page_features
from rankdraft.profiles import DEFAULT
from rankdraft.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "get_lead",
    "rank_from_lead",
    "rank_from_taxobox",
    "info_from_autobox",
    "check_page",
    "rank_vote_relational",
    "scan_targets",
    "scan_category_recursive",
    "stage_pipeline",
    "stage_pipeline_distinct",
    "stage_pipeline_limits",
    "stage_summary",
    "edit_pipeline",
]
# Copies of the pages for the throughput of the one pass over the texts.
COPIES = 20


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("rankdraft-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def text_throughput(spark: SparkSession) -> dict[str, float]:
    """Pages and megabytes per second of the pass that reads the page texts."""
    pages = Corpus(spark, SF_DIR).pages
    numbers = F.explode(F.sequence(F.lit(1), F.lit(COPIES)))
    copies = pages.withColumn("copy", numbers).select("title", "text").persist()
    sizes = copies.selectExpr("count(*) AS n", "sum(octet_length(text)) AS b").first()
    features = page_features(copies, DEFAULT)
    timed(lambda: features)
    seconds = timed(lambda: features)
    copies.unpersist()
    return {
        "pages_per_sec": round(sizes["n"] / seconds),
        "mb_per_sec": round(sizes["b"] / seconds / 1e6, 1),
    }


def main() -> None:
    spark = session()
    seconds = {}
    for name in HEADLINE:
        timed(lambda: QUERIES[name](spark, SF_DIR))
        seconds[name] = round(timed(lambda: QUERIES[name](spark, SF_DIR)), 3)
    targets = Corpus(spark, SF_DIR).targets.count()
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "targets": targets,
        "targets_per_sec": {
            name: round(targets / seconds[name]) for name in ("stage_pipeline", "edit_pipeline")
        },
        "text_pass": text_throughput(spark),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
