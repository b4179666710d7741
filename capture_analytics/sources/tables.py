"""Readers: resource dumps, captured pages, screenshots. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("type string, id string, attributes map<string,string>, "
          "relationships map<string,string>, links string")
RESOURCE_PAGE = (f"data array<struct<type:string,id:string,attributes:map<string,string>,"
                 f"relationships:map<string,string>,links:string>>, included string")
JOB_POST = ("id bigint, title string, description string, company_id bigint, company_name string, "
            "location string, salary_min int, salary_max int, employment_type string, "
            "remote_ok boolean, link string, posted_date date, source string, "
            "posting_status string, created_at timestamp, duplicate_of_id bigint")
SCRAPE = ("scrape_id bigint, url string, status string, job_content string, html string, "
          "note string, scraped_at timestamp, source_scrape bigint, job_post_id bigint")
TRACE = ("scrape_id bigint, node string, t_start timestamp, t_end timestamp, routed_to string, "
         "inputs_digest string, outputs_digest string, payload map<string,string>")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON dump of resource pages, `{"data": [...]}` per line.

    Relationship values stay JSON text; `operators.records.relationship_counts` reads them.
    """
    pages = spark.read.schema(RESOURCE_PAGE).json(path)
    return pages.select(F.explode("data").alias("r"), "included").select("r.*", "included")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines dump with a declared schema."""
    return spark.read.schema(schema).json(path)


def screenshot_listing(spark: SparkSession, path: str) -> DataFrame:
    """File name and size of captured images; the bytes are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
