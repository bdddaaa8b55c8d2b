"""When each request may go out: rate limits over all requests and for each host, and so many at once to a host.

Requests are rows with a time at which they are ready (at, in seconds) and an order among equals (ord). A limiter grants them in that order, each no
sooner than an interval after the one before: the n-th starts at n x interval + the running maximum of (at - n x interval), which windows compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import new_folder, written


def interval_of(rate: float) -> float:
    return 1 / rate if rate > 0 else 0.0


def host_paced(requests: DataFrame, interval: float, host: str = "host") -> DataFrame:
    """Adds start: requests of one host at least an interval apart."""
    if interval <= 0:
        return requests.withColumn("start", F.col("at"))
    by_host = Window.partitionBy(host).orderBy("at", "ord")
    shift = (F.row_number().over(by_host) * F.lit(interval)).alias("shift")
    return requests.select("*", shift).withColumn("start", F.max(F.col("at") - F.col("shift")).over(by_host.rowsBetween(Window.unboundedPreceding, 0)) + F.col("shift")).drop("shift")


def paced(requests: DataFrame, interval: float) -> DataFrame:
    """Adds start: all requests at least an interval apart. Requests are dealt out by ranges of their order; of each range only its size and greatest lead, one row,
    reach the driver, so that no task gets all."""
    if interval <= 0:
        return requests.withColumn("start", F.col("at"))
    spark = requests.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(requests.repartitionByRange(n, "at", "ord").withColumn("part", F.spark_partition_id()), new_folder(spark, "requests"))
    by_part = Window.partitionBy("part").orderBy("at", "ord")
    own = ranged.withColumn("shift", F.row_number().over(by_part) * F.lit(interval))
    own = own.withColumn("lead", F.max(F.col("at") - F.col("shift")).over(by_part.rowsBetween(Window.unboundedPreceding, 0)))
    before, count, lead = [], 0, float("-inf")
    for r in own.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("lead").alias("lead")).orderBy("part").collect():
        before.append((r["part"], count * interval, lead))
        lead, count = max(lead, r["lead"] - count * interval), count + r["n"]
    if not before:
        return requests.withColumn("start", F.col("at"))
    earlier = F.broadcast(spark.createDataFrame(before, "part int, earlier double, most double"))
    start = F.greatest(F.col("lead") - F.col("earlier"), F.col("most")) + F.col("shift") + F.col("earlier")
    return own.join(earlier, "part").withColumn("start", start).drop("part", "shift", "lead", "earlier", "most")


def at_once(requests: DataFrame, most: int, host: str = "host") -> DataFrame:
    """Adds start: at most so many requests of a host at once, each taking its duration (column seconds). They take turns on so many lanes of the host, and each waits
    for the one before it on its lane."""
    if most <= 0:
        return requests.withColumn("start", F.col("at"))
    lane = F.pmod(F.row_number().over(Window.partitionBy(host).orderBy("at", "ord")) - 1, F.lit(most))
    on_lane = Window.partitionBy(host, "lane").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0)
    with_lane = requests.withColumn("lane", lane).withColumn("before", F.sum("seconds").over(on_lane) - F.col("seconds"))
    return with_lane.withColumn("start", F.max(F.col("at") - F.col("before")).over(on_lane) + F.col("before")).drop("lane", "before")
