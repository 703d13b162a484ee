"""Keyed upserts and rewrites of immutable tables, and the gate for processed files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_only(existing: DataFrame, new: DataFrame, key: str = "uid") -> DataFrame:
    """ON CONFLICT DO NOTHING. A null key conflicts with nothing."""
    one = new.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(new.filter(F.col(key).isNull()))
    return existing.unionByName(one.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def replace(existing: DataFrame, new: DataFrame, key: str = "uid") -> DataFrame:
    """ON CONFLICT DO UPDATE: new rows win; of several with one key one stays. A null key conflicts with nothing."""
    one = new.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return one.unionByName(new.filter(F.col(key).isNull())).unionByName(existing.join(one.select(key), key, "left_anti"), allowMissingColumns=True)


def add(existing: DataFrame, new: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """ON CONFLICT adds the sums; other columns come from the new row where there is one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c != key and c not in sums]
    out = both.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], F.max_by(F.struct(*rest), "_new").alias("_x") if rest else F.max("_new").alias("_x"))
    return out.select(*[F.col(f"_x.{c}").alias(c) if c in rest else F.col(c) for c in existing.columns])


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return df.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def unprocessed(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose name has no row in processed_files."""
    return files.join(processed.select(F.col("file_name").alias("file")), "file", "left_anti")


def save_new_version(spark: SparkSession, df: DataFrame, root: str) -> str:
    """Writes a table as a new version beside the old; readers take the path it returns."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
