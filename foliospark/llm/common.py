"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import discard, shared_dir, small_batches, stored

__all__ = ["ascii_lower", "boxed", "discard", "fold", "shared_dir", "sized", "stored", "table", "text_of", "unboxed", "without"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(table: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A stored table of narrow rows (ids and hashes), to be broadcast if it has at most most_rows; beyond that a join shuffles."""
    return F.broadcast(table) if table.count() <= most_rows else table


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def fold(col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds


def without(df: DataFrame, *names: str) -> list[Column]:
    """df's columns but those that an operator adds under the same name (any case)."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def boxed(df: DataFrame, *names: str) -> Column:
    """df's columns but those that an operator adds, in one struct, so that none clashes with an operator's inner columns."""
    return F.struct(F.lit(0).alias("c"), *[c.alias(f"c{k}") for k, c in enumerate(without(df, *names))])


def unboxed(df: DataFrame, box: str, *names: str) -> list[Column]:
    """The columns that boxed() put into the struct of that name."""
    taken = {n.lower() for n in names}
    return [F.col(f"{box}.c{k}").alias(c) for k, c in enumerate(c for c in df.columns if c.lower() not in taken)]
