"""Stored runs: partitioned writes, grid discovery, resuming, run metadata."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CELL = ("training_size", "seed")


#: Folder of the commit log below a table of cells; readers of the table pass over it.
LOG = "_log"


def write_cells(df: DataFrame, path: str, keys: Sequence[str] = CELL) -> str:
    """Write one folder per cell and log what was written. Cells already on disk and not in `df`
    are left alone.

    Rows are brought together by cell, and adaptive execution splits a cell into as many tasks
    as its bytes ask for and lets one task write many small cells. The log gets one row a cell with
    its rows, files and bytes. Which cells there are is observed while writing; their figures come
    from the footers of the new files.
    """
    spark, seen = df.sparkSession, Observation()
    watched = df.hint("rebalance", *keys).observe(seen, F.collect_set(F.struct(*keys)).alias("cells"))
    watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    cells = [tuple(c) for c in seen.get["cells"] or []]  # one small tuple a cell
    if not cells:
        return path
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    written = spark.createDataFrame(cells, kinds)
    files = spark.read.parquet(path).select(*keys, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    same = [files[k].cast(df.schema[k].dataType).eqNullSafe(written[k]) for k in keys]
    # The cells of this write alone: the join prunes the folders that are opened.
    found = files.join(F.broadcast(written), same).groupBy(*[written[k] for k in keys], "file").agg(
        F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"))
    log = found.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).withColumn(
        "at", F.current_timestamp())
    log.coalesce(1).write.mode("append").parquet(f"{path}/{LOG}")
    return path


def cell_log(spark: SparkSession, path: str, keys: Sequence[str] = CELL) -> DataFrame:
    """`keys, rows, files, bytes, at` of every cell as it was last written. No data file is read."""
    log = spark.read.parquet(f"{path}/{LOG}")
    return keep_last(log, keys, ["at"]).select(*keys, "rows", "files", "bytes", "at")


def discover_grid(spark: SparkSession, path: str) -> DataFrame:
    """`training_size, seeds` present on storage, from the log of what was written."""
    return cell_log(spark, path).groupBy("training_size").agg(F.sort_array(F.collect_set("seed")).alias("seeds"))


def stack_cells(tables: Sequence[DataFrame]) -> DataFrame:
    """Several per-cell tables as one, matched by column name."""
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked


def remaining(grid: DataFrame, done: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Cells of the grid that have no result yet."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key. An aggregate, so a key with many records combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing records with the new ones laid over them, newest per key."""
    return keep_last(existing.unionByName(new, allowMissingColumns=True), keys, order)


def response_status(expected: DataFrame, received: DataFrame, key: str, size: str) -> DataFrame:
    """`key, status, <size>` for every expected batch: `ready`, or `missing` with size 0."""
    got = received.select(key, size)
    return expected.select(key).distinct().join(got, key, "left").select(
        key,
        F.when(F.col(size).isNull(), F.lit("missing")).otherwise(F.lit("ready")).alias("status"),
        F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size),
    )


def run_manifest(spark: SparkSession, **fields) -> DataFrame:
    """One row describing a run. Lists and mappings are kept as JSON text."""
    flat = {
        k: json.dumps(v, sort_keys=True) if isinstance(v, (list, dict, tuple)) else v
        for k, v in sorted(fields.items())
    }
    types = {bool: "boolean", int: "bigint", float: "double"}
    schema = ", ".join(f"`{k}` {types.get(type(v), 'string')}" for k, v in flat.items())
    return spark.createDataFrame([tuple(flat.values())], schema)


def write_run(path: str, predictions: DataFrame, manifest: DataFrame, summary: DataFrame) -> str:
    """Predictions as Parquet, manifest and summary as JSON, below one run folder."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return path
