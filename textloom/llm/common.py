"""Helpers shared by the training-data operators: shared folders, Arrow passes, components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where all is one machine, an unset
    one is a temporary folder; on a cluster that raises an error, as nobody else could read it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "textloom-checkpoints")
        spark.sparkContext.setCheckpointDir(path)
    return path


def hold(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them again.

    With `scratch`, the table's path is added to it, for `drop`; without, the table stays, as a result may be read later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, scratch: list[str], keep: int = 0) -> None:
    """Delete held tables that nothing reads any more, but for the first `keep`, and let the driver's garbage collector
    run: Spark deletes the shuffle files of plans that are gone."""
    for path in scratch[keep:]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del scratch[keep:]
    spark._jvm.System.gc()


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """A scan-side Python pass in Arrow batches, without a shuffle. A worker whose task has ended stays, and waits for
    another one: until then it gives back what it has freed, which otherwise counts for its executor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(it)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and that of the C library if it is one that can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def portions(it: Iterator[pa.RecordBatch], column: int, rows: int = 2000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows and, but for single rows, bytes of a text column; an empty one as it is."""
    for b in it:
        at = 0
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        while True:
            some = np.cumsum(lengths[at : at + rows])
            k = max(1, int(np.searchsorted(some, size, "right")))
            yield b.slice(at, k)
            at += k
            if at >= b.num_rows:
                break


def batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def lower_ascii(text) -> F.Column:
    """A-Z to a-z and no other letter. lower() is the same, and faster, on texts of ASCII only."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def fold_of(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5. Fold 0 is held out; rows without an id count as held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, longest: int) -> list[tuple[str, int]]:
    """At most `bound` labelled (text, label) rows outside fold 0, for the driver; texts of more than `longest` bytes don't
    take part, so that their bytes are bounded as well.

    Which rows is decided by a hash of the id, so that the same tables give the same sample. Rows with a null id, text or
    label don't take part; a document with several label rows takes the largest label, one with several texts the least.
    """
    lab = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    lab = lab.where(fold_of(F.col("_id")) != 0).groupBy("_id").agg(F.max("_y").alias("_y"))
    order = F.xxhash64(F.col("_id"), F.lit(17))
    lab = lab.orderBy(order, "_id").limit(bound)
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where("_id is not null and _t is not null").where(F.octet_length("_t") <= longest)
    rows = d.join(F.broadcast(lab), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t")).select("_id", "_t", "_y").collect()
    return [(r["_t"], r["_y"]) for r in sorted(rows, key=lambda r: r["_id"])]


def components(edges: DataFrame, scratch: list[str]) -> DataFrame:
    """Connected components of edges (a, b): rows (node, comp), comp being the smallest node of the component.

    Alternates large-star and small-star steps until the edges stand still; every step is a grouped minimum
    and a join, so no component is ever gathered in one task. Nulls and loops are ignored. The result reads a table of
    `scratch`; those of earlier steps are deleted.
    """
    spark = edges.sparkSession
    first = len(scratch)
    e = hold(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scratch)
    mark = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    last = mark(e)
    while last["n"]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e1 = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        e2 = e1.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        e = hold(e2.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scratch)
        now = mark(e)
        old = scratch[first:-1]
        del scratch[first:-1]
        drop(spark, old)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
