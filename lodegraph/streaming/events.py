"""Streams: versions of a model, bursts of changes, published deltas, events that arrive twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import keyed_diff
from ..operators.lineage import own_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one of ``spark.checkpoint.dir``; a local one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def watch(versions: DataFrame) -> DataFrame:
    """(workspace, sequence, event, digest) of a stream ``versions(workspace, seq, digest)``: the first
    version is ready, later ones are changed or unchanged.  Only the last digest is state."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, last = state.get if state.exists else (0, None)
        # the versions of one workspace in one trigger, in order
        own = pd.concat(list(batches)).sort_values("seq", kind="stable")
        rows = []
        for digest in own["digest"]:
            event = "ready" if number == 0 else "unchanged" if digest == last else "changed"
            number, last = number + 1, digest
            rows.append((key[0], number, event, digest))
        state.update((number, last))
        yield pd.DataFrame(rows, columns=["workspace", "sequence", "event", "digest"])

    out = "workspace string, sequence long, event string, digest string"
    return versions.select("workspace", "seq", "digest").groupBy("workspace").applyInPandasWithState(step, out, "sequence long, digest string", "append", GroupStateTimeout.NoTimeout)


def bursts(events: DataFrame, owner: str, ts: str, gap: str, late: str = "1 day") -> DataFrame:
    """(owner, start, end, events): changes that follow each other within ``gap``.  In append mode a
    burst appears once nothing that is at most ``late`` behind can lengthen it."""
    own = events.withWatermark(ts, late).groupBy(F.col(owner), F.session_window(ts, gap).alias("w"))
    return own.agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")).select(owner, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "first_event", "last_event")


def once(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is sent within ``late``; state is dropped after that."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def publisher(spark: SparkSession, folder: str, key: str, fields: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of whole versions ``(version, key, fields...)``, one a batch:
    writes revision n of the graph, and its delta with the hash of the revision that it starts from.
    A batch run again after a failure writes the same revision again."""

    def digest(graph: DataFrame) -> str:
        # the sum of row hashes: no order, no exchange of rows
        row = F.xxhash64(key, *fields).cast("decimal(38,0)")
        got = graph.agg(F.coalesce(F.sum(row), F.lit(0)).alias("s"), F.count("*").alias("n")).head()
        return f"{int(got.s) % 2**64:016x}-{got.n}"

    def publish(batch: DataFrame, number: int) -> None:
        at = f"{folder}/graph/revision={number}"
        batch.select(key, *fields).write.mode("overwrite").parquet(at)
        head = spark.read.parquet(at)
        if number == 0:
            base, start = head.where("false"), ""
        else:
            base = spark.read.schema(head.schema).parquet(f"{folder}/graph/revision={number - 1}")
            start = digest(base)
        delta = keyed_diff(base, head, key, fields)
        event = F.lit("snapshot" if number == 0 else "delta")
        delta.select(event.alias("event"), F.lit(start).alias("base_hash"), F.lit(digest(head)).alias("hash"), key, "change", "changed").write.mode("overwrite").parquet(f"{folder}/events/revision={number}")

    return publish


def drained(writer: DataStreamWriter, state: str) -> None:
    """Run a stream over all that is there, then stop."""
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
