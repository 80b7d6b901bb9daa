"""Reading parquet tables, and loading rows by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; times without a zone are taken as session time, so that watermarks accept them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by ``order``: what an upsert of all rows leaves."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of both, of which a new one replaces the old one with its key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc("_new"), *order]).drop("_new")


def unseen(rows: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the old table does not have."""
    return rows.join(old.select(*keys).distinct(), keys, "left_anti")


def changed(rows: DataFrame, old: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that are new or whose value differs from the old one."""
    before = old.select(*keys, F.col(value).alias("_old"))
    return rows.join(before, keys, "left").where(~F.col(value).eqNullSafe(F.col("_old"))).drop("_old")


def unexpired(rows: DataFrame, until: str, as_of: str) -> DataFrame:
    """Rows whose time ``until`` lies after the given moment."""
    return rows.where(F.col(until) > F.lit(as_of).cast("timestamp"))


def since(rows: DataFrame, day: str, floor: Column) -> DataFrame:
    """Rows whose day is not before the floor; where that is null, all."""
    return rows.where(floor.isNull() | (F.col(day) >= floor))


def without_children_of(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows that do not belong to a deleted parent."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def only_row(rows: DataFrame) -> DataFrame:
    """The rows, if there is exactly one; otherwise an error."""
    n = len(rows.limit(2).collect())
    if n != 1:
        raise LookupError("no row" if n == 0 else "more than one row")
    return rows


def counted(rows: DataFrame) -> DataFrame:
    """n, the number of rows, without any of their columns."""
    return rows.agg(F.count(F.lit(1)).alias("n"))


def updated(rows: DataFrame, match: Column, values: dict[str, Column], guard: Column | None = None) -> DataFrame:
    """Rows with new values where they match and the guard, if any, holds; other rows stay."""
    at = match if guard is None else match & guard
    return rows.withColumns({c: F.when(at, v).otherwise(F.col(c)) for c, v in values.items()})


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows to a parquet table."""
    rows.write.mode("append").parquet(path)


def seeded(spark: SparkSession, kinds: list[str], each: int) -> DataFrame:
    """kind, n and score: rows to begin a benchmark with, ``each`` of every kind, scores spread from 1 to 10."""
    rows = spark.range(len(kinds) * each).select(F.element_at(F.array(*map(F.lit, kinds)), (F.expr(f"id div {int(each)}") + 1).cast("int")).alias("kind"), (F.col("id") % each).cast("int").alias("n"))
    return rows.withColumn("score", (F.col("n") % 10 + 1).cast("double"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session may leave it unset, as in tests, and gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again, so that each reader reads the columns that it needs."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which ends the lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
