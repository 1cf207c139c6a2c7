"""Results as rows and files for others."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 2000


def export_rows(results: DataFrame) -> DataFrame:
    return results.select("score", F.col("document_path").alias("document"), "heading", F.substring("content", 1, MOST_CHARS).alias("content"))


def write_json(results: DataFrame, path: str) -> None:
    export_rows(results).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(results: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, line breaks of the content written as \\n."""
    rows = export_rows(results).withColumn("content", F.regexp_replace("content", "\n", r"\\n")).withColumn("heading", F.coalesce("heading", F.lit("")))
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
