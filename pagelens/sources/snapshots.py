"""Page snapshots: what stands for fetching. Tables, files of any format Spark reads, and folders of binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.urls import is_document_expr, normalize_udf


def from_pages(pages: DataFrame, status: int = 200, fetch_ms: int = 0) -> DataFrame:
    """Snapshots of a table page_id, url, html: every page answered at once with the same status."""
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    return pages.select("url", F.col("url").alias("final_url"), F.lit(status).alias("status"), F.lit(fetch_ms).alias("fetch_ms"), "html", size.alias("content_length"), F.array().cast("array<string>").alias("redirects"), F.lit(None).cast("string").alias("error"))


def from_files(spark: SparkSession, folder: str, base_url: str) -> DataFrame:
    """Snapshots of binary documents in a folder, addressed below a base URL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), name)
    return files.select(url.alias("url"), url.alias("final_url"), F.lit(200).alias("status"), F.lit(0).alias("fetch_ms"), F.lit(None).cast("string").alias("html"), F.col("length").alias("content_length"), F.array().cast("array<string>").alias("redirects"), F.lit(None).cast("string").alias("error"), F.col("content").alias("raw_bytes"))


def look_up(requests: DataFrame, snapshots: DataFrame, url: str = "url") -> DataFrame:
    """Each requested URL with its snapshot, by normal form (null columns where there is none).

    Of snapshots of one address that with the least url stands, of those with one url that with the least hash.
    """
    rest = [c for c in snapshots.columns if c != "url"]
    order = F.struct("url", F.xxhash64(*(F.col(f"`{c}`") for c in rest)))
    known = snapshots.withColumn("norm_url", normalize_udf(F.col("url"))).groupBy("norm_url").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), order).alias("_s")).select("norm_url", "_s.*")
    return requests.withColumn("norm_url", normalize_udf(F.col(url))).join(known, "norm_url", "left").withColumn("is_document", is_document_expr(F.col(url)))
