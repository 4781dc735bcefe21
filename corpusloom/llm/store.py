"""Intermediate tables in the shared folder, sizes of inputs, and packed rows.

A table written here survives lost executors and cuts lineage. The folder is `spark.checkpoint.dir`; where
that is unset, a folder below /tmp/checkpoints if all of Spark runs on this machine, and an error otherwise.
"""

from __future__ import annotations

import atexit
import gc
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import remove, shared_folder, ship

#: Rows of an Arrow batch at most: texts are long, and a batch is held whole on both sides.
BATCH_ROWS = 1_024


class Scratch:
    """Tables of one run. drop() removes one that nothing reads any more; the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        small_batches(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        # Without the mark of success: its file makes the driver's JVM start a program, which counts that JVM's memory twice for a moment.
        frame.write.mode("overwrite").options(**{"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
        schema = frame.schema
        del frame
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of finished stages: it waits for the driver's garbage collector, which nothing else wakes."""
        for pause in (0.2, 0):  # the listener lets go of a finished query a moment later
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(pause)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.path}/{name}" if name else self.path)

    def close(self) -> None:
        self.drop("")


def input_bytes(frame: DataFrame) -> int:
    """Spark's own estimate of a frame's size, from its files."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


#: Ids that may go to all executors at once (4 MB of numbers); more of them are joined by a shuffle.
BROADCAST_IDS = 500_000


def with_ids(frame: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows with (or, left_anti, without) one of the ids, a small or a large set. Few ids spare the rows a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return frame.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", how)


def parts(frame: DataFrame, each: int, least: int = 8) -> int:
    """How many parts of about `each` input bytes a frame makes; grows with the input, never with one key."""
    shuffle = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(max(least, shuffle, input_bytes(frame) // each), 1 << 20))


def documents(frame: DataFrame) -> DataFrame:
    """doc_id and text of rows that have an id, whatever else the table holds."""
    ship(frame.sparkSession)
    small_batches(frame.sparkSession)
    return frame.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def with_bases(frame: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """The frame, which has doc_id and text, with a column `base`: where the row's text begins among the different texts of its id; and whether ids repeat.

    That is 0 but for ids with several texts: these stand one after the other, ordered by their SHA-256, and a place in
    one of them is its place in the text and the base. So (doc_id, place) names one place of one text; equal rows share it.
    """
    again = scratch.save(frame.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return frame.withColumn("base", F.lit(0).cast("long")), False
    text = F.coalesce("text", F.lit(""))
    some = with_ids(frame, again).withColumn("sha", F.sha2(text.cast("binary"), 256))
    sizes = some.select("doc_id", "sha", (F.octet_length(text) + 1).cast("long").alias("size")).distinct()
    before = Window.partitionBy("doc_id").orderBy("sha").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.save(sizes.select("doc_id", "sha", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("base")), "bases")
    return with_ids(frame, again, "left_anti").withColumn("base", F.lit(0).cast("long")).unionByName(some.join(bases, ["doc_id", "sha"]).drop("sha")), True


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def table_rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch from tuples."""
    schema = arrow_schema(ddl)
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(level: int = 1, /, **arrays: np.ndarray) -> bytes:
    """Arrays in one blob, byte planes first, compressed."""
    head, body = [], []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        head.append(f"{name}:{x.dtype.str}:{len(x)}")
        body.append(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b"")
    raw = ",".join(head).encode() + b"\n" + b"".join(body)
    return zstandard.ZstdCompressor(level=level).compress(raw)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    head, _, body = raw.partition(b"\n")
    out, at = {}, 0
    for item in head.decode().split(","):
        name, kind, n = item.split(":")
        dtype, n = np.dtype(kind), int(n)
        size = n * dtype.itemsize
        planes = np.frombuffer(body, np.uint8, size, at).reshape(dtype.itemsize, n) if n else np.zeros((dtype.itemsize, 0), np.uint8)
        out[name] = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
        at += size
    return out


def join_packed(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts_ = [unpack(b) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts_]) for k in parts_[0]}
