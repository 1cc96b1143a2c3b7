"""Profiles of source and truth tables, and exact-size seeded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long")).withColumn("columns", F.lit(",".join(df.columns)))


def missing_percent(df: DataFrame) -> DataFrame:
    """(column, missing_pct) in one pass."""
    row = df.agg(*(F.coalesce(F.avg(F.col(f"`{c}`").isNull().cast("int")) * 100, F.lit(0.0)).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_pct")) for c in df.columns))
    return row.select(F.explode(pairs).alias("p")).select("p.column", "p.missing_pct")


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column, n_distinct) without nulls."""
    one = [df.agg(F.count_distinct(f"`{c}`").alias("n_distinct")).select(F.lit(c).alias("column"), "n_distinct") for c in df.columns]
    return reduce(DataFrame.unionByName, one)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows and their difference."""
    groups = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def match_counts(truth: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """The truth rows with n_matches: pieces between commas, blank ones counted; null and '' have none."""
    c = F.col(column)
    return truth.withColumn("n_matches", F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.size(F.split(c, ","))).cast("long"))


def match_count_histogram(truth: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    return match_counts(truth, column).groupBy("n_matches").agg(F.count("*").alias("n")).orderBy("n_matches")


def singleton_percent(truth: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    return match_counts(truth, column).agg(F.coalesce(F.avg((F.col("n_matches") == 0).cast("int")) * 100, F.lit(0.0)).alias("singleton_pct"))


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "entity_id") -> DataFrame:
    """Exactly min(n, rows) rows, the same for the same seed whatever the partitions."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def sample_values(df: DataFrame, column: str, n: int = 10, seed: int = 42) -> DataFrame:
    return seeded_sample(df.filter(F.col(column).isNotNull()).select(column), n, seed, column)


def profile(df: DataFrame) -> DataFrame:
    """(column, missing_pct, n_distinct)."""
    return missing_percent(df).join(distinct_counts(df), "column")
