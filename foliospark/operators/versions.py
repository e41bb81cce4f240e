"""Versioned tables on plain Parquet: a version is a folder, and the newest one with a success marker is the table.

Writers make a new folder and never touch old ones, so a failed write leaves the table as it was; a version that is named after a batch is written
once, which makes retries harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.work import file_system


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, folder, make = file_system(spark, path)
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
    return [n for n in names if fs.exists(make(f"{path}/{n}/_SUCCESS"))]


def current(spark: SparkSession, path: str) -> DataFrame | None:
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/{found[-1]}") if found else None


def commit(df: DataFrame, path: str, version: int) -> bool:
    """False if that version (a batch's number, say) was written before."""
    name = f"v{version:020d}"
    if name in _versions(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    return True
