"""Uploads, page jobs and their status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uploaded_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, filename, content_type, content, thumbnail): one row for each file below a folder. The id is drawn anew by each read; write the table once."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    return files.select(F.uuid().alias("file_id"), name.alias("filename"), F.concat(F.lit("image/"), kind).alias("content_type"), "content", F.base64("content").alias("thumbnail"))


def submitted_jobs(orders: DataFrame) -> DataFrame:
    """(doc_id, file_id, page_no, is_first_page): a job for each file of an order (an array), its place the page's number."""
    return orders.select("doc_id", F.posexplode("file_ids").alias("page_no", "file_id")).withColumn("is_first_page", F.col("page_no") == 0)


def order_status(jobs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_jobs, n_finished, status): finished if all jobs are, else failed if any failed, stopped or was canceled, else running."""
    counts = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("status") == "finished").alias("n_finished"), F.bool_or(F.col("status").isin("failed", "stopped", "canceled")).alias("_bad"))
    status = F.when(F.col("n_finished") == F.col("n_jobs"), "finished").when(F.col("_bad"), "failed").otherwise("running")
    return counts.select(key, "n_jobs", "n_finished", status.alias("status"))


def semantic_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, tokens, keyed): lines of text files; files with Corpus in their path tell how notes sound, so accidentals are worked out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("tokens"))
    return lines.drop("_block").withColumn("keyed", F.col("file").contains("Corpus"))


def safe_members(names: DataFrame, column: str = "name") -> DataFrame:
    """Members of an archive that stay inside the folder they are unpacked to."""
    parts = F.split(column, r"[/\\]")
    return names.filter(~F.col(column).startswith("/") & ~F.array_contains(parts, ".."))
