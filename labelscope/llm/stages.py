"""Tables kept between steps, in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.session import scratch_dir, ship_package


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write `df` and read it back: lineage ends here, and a lost executor costs nothing."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by `kept` that no result reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """`mapInArrow` with this package at hand in the Python workers."""
    ship_package(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return df.mapInArrow(task, schema)


def numbered(docs: DataFrame, text: str) -> DataFrame:
    """Columns by number (`c0`, `c1`, ...), so that no name can clash, and the text as the last."""
    place = docs.columns.index(text)
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return renamed.withColumn("text", F.col(f"c{place}").cast("string"))


def release_memory() -> None:
    """Give what a task has freed back to the machine. Workers outlive their tasks and would keep
    it, each as much as its largest task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)
