"""The change log: put, add and del records, replayed in batch or as a stream.

Records: t (store), id, op, line_no, rec, and for add parent and index. Replay is idempotent: the last put or del of
an id wins, an add of a live id is skipped, a del of a missing one does nothing.

As a stream, each id has a state that outlives its micro-batch: whether it is live and what its last records with effect
said. So any cut of a log into micro-batches ends as the batch replay does, also over a restart from the checkpoint. A
record at or before the last line that an id has seen is a repeated delivery and changes nothing. The state lies in
RocksDB on the executors and in the checkpoint. Ids are grouped by their hash into buckets, whose states are one value: Python is
called, and the store asked, once for each bucket that a micro-batch touches and not for each id. A bucket's states and a micro-batch's
records of it are in memory together, so a source's maxFilesPerTrigger bounds a task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

SCHEMA = "op string, t string, id string, parent string, index int, rec string, line_no long"
#: A log is compacted beyond this many bytes, or this share of its base.
LEAST_BYTES, SHARE = 2 * 1024 * 1024, 0.25


def parse(lines: DataFrame) -> DataFrame:
    """Journal records of JSON lines (line, line_no); a torn last line and other malformed ones have no op."""
    v = F.try_parse_json("line")
    get = lambda p, t: F.try_variant_get(v, f"$.{p}", t)
    return lines.select(get("op", "string").alias("op"), get("t", "string").alias("t"), get("id", "string").alias("id"), get("parent", "string").alias("parent"), get("index", "int").alias("index"), F.to_json(F.try_variant_get(v, "$.rec", "variant")).alias("rec"), "line_no")


def last_writes(records: DataFrame) -> DataFrame:
    """The state each id ends in: its last record that has effect.

    A put or del always has effect; an add only if the id isn't live then, that is if it comes first or after a del. The
    record before tells: after a put or an add, with effect or not, an id is live. So the history of an id is never held,
    only sorted, and the window and the aggregate share one shuffle.
    """
    before = F.lag("op").over(Window.partitionBy("t", "id").orderBy("line_no", "op"))
    own = records.where(F.col("op").isin("put", "add", "del")).withColumn("before", before)
    own = own.where((F.col("op") != "add") | F.col("before").isNull() | (F.col("before") == "del"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    last = F.max_by(F.struct((F.col("op") != "del").alias("live"), "rec"), "line_no").alias("last")
    out = own.groupBy("t", "id").agg(last, latest("parent"), latest("index"), F.max("line_no").alias("line_no"))
    return out.select("t", "id", "last.live", "last.rec", "parent", "index", "line_no")


def replay(base: DataFrame, records: DataFrame) -> DataFrame:
    """The base (t, id, rec) after the log. A base row is live before the first record."""
    old = base.select(F.lit("put").alias("op"), "t", "id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("index"), "rec", F.lit(-1).cast("long").alias("line_no"))
    return last_writes(old.unionByName(records.select("op", "t", "id", "parent", "index", "rec", "line_no"))).where("live").select("t", "id", "rec")


def last_put(records: DataFrame) -> DataFrame:
    """Logs of put and del alone: the last record wins. Combines before the shuffle, whatever a key's share of rows."""
    out = records.groupBy("t", "id").agg(F.max_by(F.struct("op", "rec"), "line_no").alias("last"), F.max("line_no").alias("line_no"))
    return out.where("last.op <> 'del'").select("t", "id", F.col("last.rec").alias("rec"), "line_no")


def unresolved(base: DataFrame, records: DataFrame) -> DataFrame:
    """Puts and dels of ids that neither the base nor an earlier add has, counted."""
    first = records.groupBy("t", "id").agg(F.min_by("op", "line_no").alias("first"))
    lost = first.where("first <> 'add'").join(base.select("t", "id"), ["t", "id"], "left_anti")
    return lost.agg(F.count("*").alias("unresolved"))


def reorder(children: DataFrame, orders: DataFrame) -> DataFrame:
    """Children (parent, id, pos) in the order of a shallow put (parent, ids); those it doesn't name follow in their old order."""
    named = orders.select("parent", F.posexplode("ids").alias("new_pos", "id"))
    out = children.join(named, ["parent", "id"], "left")
    order = Window.partitionBy("parent").orderBy(F.col("new_pos").asc_nulls_last(), "pos")
    return out.withColumn("pos", F.row_number().over(order) - 1).drop("new_pos")


def session_changes(changes: DataFrame, live: DataFrame) -> DataFrame:
    """Net effect for each record: added beats edited, added and removed is nothing; records that are gone are removed."""
    own = changes.groupBy("id").agg(F.bool_or(F.col("op") == "add").alias("added"), F.bool_or(F.col("op") == "del").alias("deleted"))
    out = own.join(live.select("id", F.lit(True).alias("live")), "id", "left")
    gone = F.col("deleted") | F.col("live").isNull()
    return out.select("id", F.when(F.col("added") & gone, "nothing").when(gone, "removed").when(F.col("added"), "added").otherwise("edited").alias("change"))


def base_fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def check_base(head: dict | None, base: str, lexicon: str) -> None:
    """Refuse a log whose head names another base; one without a head is taken."""
    if head and (head.get("corpus"), head.get("dict")) != (base, lexicon):
        raise ValueError("the journal belongs to another base")


def refuse_if_journal(journal_bytes: int) -> None:
    """A batch must not run beside changes that aren't in the base yet."""
    if journal_bytes:
        raise ValueError("the journal isn't empty; compact it first")


def compaction_due(journal_bytes: int, base_bytes: int, idle_seconds: float = 0, last_seconds: float = 0, complete: bool = True) -> bool:
    """Whether to write the base anew: a large or incomplete log, or an idle time that is longer after a slow compaction."""
    if not complete:
        return True
    if not journal_bytes:
        return False
    return journal_bytes > max(LEAST_BYTES, SHARE * base_bytes) or idle_seconds >= (600 if last_seconds > 2 else 120)


MANIFEST, TABLE = "manifest.json", "t string, id string, rec string"


@dataclass(frozen=True)
class Base:
    """A base on disk: its table, the fingerprint of its rows, and the last line of the log that it holds."""

    folder: str
    table: str
    fingerprint: str
    line_no: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(TABLE).parquet(f"{self.folder}/{self.table}")

    def after(self, records: DataFrame) -> DataFrame:
        """Records that the base doesn't hold yet."""
        return records.where(F.col("line_no") > self.line_no)


def _files(spark: SparkSession, folder: str) -> tuple[Any, Any]:
    """Hadoop's file context for a folder, and the function that names a path in it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration()), lambda name: path(f"{folder}/{name}")


def rows_fingerprint(rows: DataFrame) -> str:
    """The same for the same rows in any order: their number and the sum of their hashes."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("t", "id", "rec").cast("decimal(38,0)")).alias("sum")).first()
    return f"{total.n}:{total.sum or 0}"


def open_base(spark: SparkSession, folder: str) -> Base | None:
    """The base that the manifest names; None before the first."""
    context, at = _files(spark, folder)
    if not context.util().exists(at(MANIFEST)):
        return None
    (line,) = (r.value for r in spark.read.text(f"{folder}/{MANIFEST}").collect())
    return Base(folder, **json.loads(line))


def commit_base(spark: SparkSession, folder: str, rows: DataFrame, line_no: int, before_swap: Callable[[], None] = lambda: None) -> Base:
    """Write a table beside the current one, then swap the manifest by one rename: readers see the old base or the new one whole, with its place in the log."""
    table = f"base-{uuid.uuid4().hex[:12]}"
    rows.select("t", "id", "rec").write.parquet(f"{folder}/{table}")
    new = Base(folder, table, rows_fingerprint(spark.read.schema(TABLE).parquet(f"{folder}/{table}")), line_no)
    context, at = _files(spark, folder)
    draft = f"_{table}.json"
    spark.createDataFrame([(json.dumps({"table": table, "fingerprint": new.fingerprint, "line_no": line_no}),)], "value string").coalesce(1).write.text(f"{folder}/{draft}")
    (part,) = (s.getPath() for s in context.util().listStatus(at(draft)) if s.getPath().getName().startswith("part-"))
    before_swap()
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, at(MANIFEST), options)
    context.delete(at(draft), True)
    return new


def replayed(base: Base, records: DataFrame) -> DataFrame:
    """The base after those records of the log that it doesn't hold; a log that was cut, or not yet cut, gives the same."""
    return replay(base.rows(records.sparkSession), base.after(records))


def compact(base: Base, records: DataFrame, truncate: Callable[[int], None] = lambda line_no: None, before_swap: Callable[[], None] = lambda: None) -> Base:
    """A new base with the log in it. truncate may drop the log up to a line; a failure before or after the swap replays right."""
    spark = records.sparkSession
    if rows_fingerprint(base.rows(spark)) != base.fingerprint:
        raise ValueError("the base isn't the one that its manifest names")
    last = base.after(records).agg(F.max("line_no").alias("n")).first().n
    if last is None:
        return base
    new = commit_base(spark, base.folder, replayed(base, records.where(F.col("line_no") <= last)), last, before_swap)
    truncate(last)
    if base.table != new.table:
        context, at = _files(spark, base.folder)
        context.delete(at(base.table), True)
    return new


#: Buckets of ids; a checkpoint holds for one number of them.
BUCKETS = 1024
STATES = "t string, id string, live boolean, rec string, parent string, index int, line_no long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class State:
    """An id after its records so far; line_no is of the last one with effect, seen of the last one at all."""

    live: bool = False
    rec: str | None = None
    parent: str | None = None
    index: int | None = None
    line_no: int = -2
    seen: int = -2


def advance(state: State, records: Iterable[tuple[int, str, str | None, str | None, int | None]]) -> State:
    """The state after (line_no, op, rec, parent, index) records in the order of their lines."""
    for line_no, op, rec, parent, index in records:
        if line_no <= state.seen:
            continue
        state = replace(state, seen=line_no)
        if op == "add" and state.live:
            continue
        state = replace(state, live=op != "del", rec=rec, parent=state.parent if parent is None else parent, index=state.index if index is None else index, line_no=line_no)
    return state


class _LastWrites(StatefulProcessor):
    """States of a bucket's ids, as JSON lines of t, id and the fields of State."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "states string")

    def _get(self) -> dict[tuple[str, str], list]:
        held = json.loads(self.bucket.get()[0]) if self.bucket.exists() else []
        return {(t, i): own for t, i, *own in held}

    def _put(self, states: dict[tuple[str, str], list]) -> None:
        self.bucket.update((json.dumps([[*key, *own] for key, own in states.items()], ensure_ascii=False),))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        states = self._get()  # a bucket may come in parts
        for t, i, rec in zip(*_columns(initialState, ["t", "id", "rec"]), strict=True):
            states[t, i] = [True, rec, None, None, -1, -1]
        self._put(states)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every: dict[tuple[str, str], list] = {}
        for part in rows:
            for t, i, *record in zip(*_columns(part, ["t", "id", "line_no", "op", "rec", "parent", "index"]), strict=True):
                every.setdefault((t, i), []).append(record)
        states, changed, out = self._get(), False, []
        for own, records in every.items():
            records.sort(key=lambda r: (r[0], r[1]))
            old = State(*states[own]) if own in states else State()
            new = advance(old, records)
            if new != old:
                states[own], changed = [new.live, new.rec, new.parent, new.index, new.line_no, new.seen], True
            if new.line_no != old.line_no:
                out.append((*own, new.live, new.rec, new.parent, new.index, new.line_no))
        if changed:
            self._put(states)
        if out:
            made = pd.DataFrame(out, columns=["t", "id", "live", "rec", "parent", "index", "line_no"])
            yield made.astype({"index": "Int32"})

    def close(self) -> None:
        return


def _columns(frame: pd.DataFrame, names: list[str]) -> list[list]:
    """Columns as lists, with None for nulls and whole numbers as such."""
    whole = {"line_no", "index"}
    return [[None if v is None or v != v else int(v) if c in whole else v for v in frame[c].tolist()] for c in names]


def stream_state(records: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(t, id, live, rec, parent, index, line_no) of each id that a micro-batch changes, as an update stream; rows of base (t, id, rec) are live before the first record.

    Sets the session's state store to RocksDB, which this kind of state needs.
    """
    spark = records.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    bucket = F.pmod(F.xxhash64("t", "id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    own = records.where(F.col("op").isin("put", "add", "del")).select(bucket, "t", "id", "op", "line_no", "rec", "parent", "index")
    start = None if base is None else base.select(bucket, "t", "id", "rec").groupBy("bucket")
    return own.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_LastWrites(), outputStructType=STATES, outputMode="Update", timeMode="None", initialState=start)


def stream_replay(records: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second", base: DataFrame | None = None):
    """A streaming query that upserts what each micro-batch changes. apply must be an upsert by (t, id); a batch may come twice after a failure."""
    states = stream_state(records, base)
    return states.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=interval)
