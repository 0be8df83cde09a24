"""Small helpers shared by the training-data operators.

Spark hands texts to Python in Arrow batches of about 64 MB at most, its own
default, and of ``BATCH_ROWS`` rows, where the session does not say otherwise; only
a single text can make a batch longer.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine, where none need be set, a temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="helpbooks-"))
        found = sc.getCheckpointDir()
    return found


BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """``BATCH_ROWS`` for a session that has no setting of its own; one that has one keeps it, so no query changes another's batches."""
    if spark.conf.get(_ROWS, None) is None:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def sweep(spark: SparkSession) -> None:
    """Have the driver's JVM find what is no longer referred to, so that Spark deletes the shuffle files and checkpoints of earlier steps."""
    gc.collect()
    spark._jvm.System.gc()


def few_parts(df: DataFrame, rows: int, rows_a_part: int = 100_000) -> DataFrame:
    """A table of ``rows`` rows in no more partitions than it needs, without a shuffle."""
    return df.coalesce(1 + rows // rows_a_part)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path (see ``remove``): smaller than ``cut``, and pruned by column."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


#: A key is hot if more than HOT rows have it and more than one in HOT_SHARE of all; fewer than HOT_SHARE keys can be.
HOT, HOT_SHARE = 1000, 10_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, n_rows: int, count: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` (``n_rows`` of them) with the other columns of ``table``, which has one row a key and says in ``count`` how many rows have it.

    An inner (or left) equi-join that no hot key can hold up: rows of hot keys find theirs in a broadcast table, which has fewer
    than HOT_SHARE rows; all others are dealt by key. Null keys find nothing, and a left join should have none.
    """
    hot = table.filter(F.col(count) > max(HOT, n_rows // HOT_SHARE))
    names = [c for c in table.columns if c != key]
    tried = rows.join(F.broadcast(hot.select(key, F.struct(*names).alias("_found"))), key, "left")
    dealt = tried.filter("_found is null").drop("_found").join(table, key, how)
    at_once = tried.filter("_found is not null").select(*rows.columns, *(F.col("_found")[c].alias(c) for c in names))
    return dealt.select(at_once.columns).unionByName(at_once)


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def strings(column) -> list[str]:
    """Python strings of an Arrow binary column; broken UTF-8 becomes U+FFFD."""
    return [x.decode("utf-8", "replace") for x in column.to_pylist()]


def judged(docs: DataFrame, judge: Callable[[pa.Array], list[pa.Array]], schema: str, text: str = "text") -> DataFrame:
    """(row, ...): every row as a struct beside what ``judge`` says of the batch of texts (bytes). Names can't clash."""
    small_batches(docs.sparkSession)
    base = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text_bytes(text).alias("bytes"))
    out = T.StructType([base.schema["row"], *T.StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *judge(b.column(1))], names=out.fieldNames())

    return base.mapInArrow(run, out)
