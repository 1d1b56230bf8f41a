"""Fetched pages kept as a table that later scans read in part.

The table is laid out by day and by a part of the hosts, sorted by host within a file, and keeps a page's head apart from
its body. So a scan of one host or of some days opens only their folders (partition filters), skips row groups of other
hosts (pushed filters), and a scan of heads never reads a body (read schema).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.head import head_of
from .settled import scratch
from .tables import read

#: Parts that hosts are dealt to.
PARTS = 32


def keep(pages: DataFrame, path: str, parts: int = PARTS) -> None:
    """Adds pages (page_id, url, html, day) to the table at path. A page without an address goes to the part of the empty host."""
    host = F.coalesce(U.host(U.normalise(F.col("url"))), F.lit(""))
    rows = pages.withColumn("host", host).withColumn("part", _part(F.col("host"), parts)).withColumn("head", head_of(F.col("html")))
    rows.repartition("day", "part").sortWithinPartitions("day", "part", "host").write.mode("append").partitionBy("day", "part").parquet(path)


def _part(host, parts: int):
    return F.pmod(F.xxhash64(host), F.lit(parts)).cast("int")


def scan(spark: SparkSession, path: str, surface: str = "page", host: str | None = None, since: str | None = None, before: str | None = None, parts: int = PARTS) -> DataFrame:
    """Kept pages, or their heads alone (surface="head"), of one host and of the days from since to before, where these are given.

    A host or days that the table doesn't hold give no row.
    """
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.filter(F.col("day") >= F.lit(since).cast("date"))
    if before is not None:
        rows = rows.filter(F.col("day") < F.lit(before).cast("date"))
    if host is not None:
        rows = rows.filter((F.col("part") == _part(F.lit(host), parts)) & (F.col("host") == host))
    return rows.select("page_id", "url", "host", "day", "html" if surface == "page" else "head")


def head_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and head size of each page, read from the heads of a kept table."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 7).cast("int"))
    path = scratch(spark, "fetched")
    keep(read(spark, sf_dir, "pages").select("page_id", "url", "html", day.alias("day")), path)
    title = F.regexp_extract("head", "(?is)<title[^>]*>(.*?)</title>", 1)
    return scan(spark, path, "head").select("page_id", "day", "host", F.length("head").alias("head_chars"), title.alias("title"))


QUERIES = {"head_scan": head_scan}
