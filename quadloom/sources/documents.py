"""Markdown and text documents below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content): ``.md`` and ``.txt`` files; not those below a dot folder, nor templates (``__*``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").load(root)
    at = F.position(F.lit(root.rstrip("/").split("://")[-1]), F.col("path")) + len(root.rstrip("/").split("://")[-1]) + 1
    rows = files.select(F.substring("path", at, F.length("path")).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return rows.where(~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").rlike(r"(^|/)__[^/]*$"))
