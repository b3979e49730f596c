"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from playlog.model import PlayLog
from playlog.plans.registry import QUERIES

HEADLINES = ("co_links", "artist_stats", "gateway", "timeline", "rediscover", "lift_month", "love_timing", "velocity_weekly", "comeback", "album_age_median", "year_totals", "eras")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start-up is not a query's time
    took = {}
    began = time.time()
    for profile in ("part", "supp"):  # both libraries' stored tables, which the queries below read; each table is timed apart
        log = PlayLog(spark, sf_dir, profile)
        log.rebuild().collect()
        took |= {f"rebuild_{profile}_{name}": round(seconds, 3) for name, seconds in log.store.seconds.items()}
    took["rebuild_counts"] = round(time.time() - began - sum(took.values()), 3)
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
