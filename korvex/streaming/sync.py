"""Applying change feeds: one batch, or a stream that stops when nothing is left."""

from __future__ import annotations

import json
import os
import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvex.client import AllFailed
from korvex.operators.maintain import current_mutations
from korvex.plans.cursors import CursorStore
from korvex.plans.store import Conflict
from korvex.plans.util import written
from korvex.sources.files import LocalFiles, changes, next_state


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upserts and deletes of a batch of events (seq, op, document_id, ...), the last event of each document; a move deletes the old id."""
    own = events.where(F.col("op").isin("upsert", "delete", "move"))
    last = current_mutations(own.withColumn("op", F.when(F.col("op") == "move", "delete").otherwise(F.col("op"))))
    return last.where("op = 'upsert'"), last.where("op = 'delete'")


def checkpoint_of(events: DataFrame) -> str | None:
    row = events.where("op = 'checkpoint'").agg(F.max_by("cursor", "seq").alias("cursor")).first()
    return row.cursor


def apply_changes(client, events: DataFrame, cursor: str | None = None, stopped: Callable[[], bool] = lambda: False, retries: int = 3) -> dict:
    """Deletes and upserts in one commit, then moves the cursor: only if nothing failed and nobody stopped it.

    A commit that another writer overtook is made again on what that one left.
    """
    events = written(events)
    upserts, deletes = split(events)
    ahead = checkpoint_of(events)
    out = {"accepted": 0, "deleted": 0, "failed": 0, "cursor": cursor, "stopped": False}
    payloads = upserts.withColumn("id", F.col("document_id")).drop("op", "document_id", "cursor", "path", "reason")
    for attempt in range(retries + 1):
        if stopped():
            return out | {"stopped": True}
        if not events.where(F.col("op").isin("upsert", "delete", "move")).limit(1).count():
            return out | {"cursor": ahead or cursor}
        try:
            done = client.ingest(payloads, deletes=deletes.select("document_id"))
            out |= {"accepted": done["accepted"], "failed": done["failed"], "deleted": done["deleted"]}
            break
        except AllFailed as e:
            out["failed"] = e.failed
            break
        except Conflict:
            if attempt == retries:
                raise
            client.corpus.refresh()
    if not out["failed"] and not stopped():
        out["cursor"] = ahead or cursor
    return out


#: One sync of a source at a time in this process; those of other processes meet in the commit.
_locks: dict[tuple[str, str], threading.Lock] = defaultdict(threading.Lock)


class Control:
    """Pauses and stops a sync from another thread, and hears how far it is."""

    def __init__(self, progress: Callable[[str], None] = lambda step: None):
        self.progress = progress
        self._stop, self._go = threading.Event(), threading.Event()
        self._go.set()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def stop(self) -> None:
        self._stop.set()
        self._go.set()

    def stopped(self) -> bool:
        self._go.wait()
        return self._stop.is_set()


def sync_source(client, source: LocalFiles, control: Control | None = None) -> dict:
    """One pass over a source: validate, scan, changes since the kept state, one commit, then state and cursor.

    The state (a fingerprint a file) is a table of the index. It only moves if
    nothing failed and nobody stopped the pass, so that a pass that broke off
    anywhere is made up for by the next one.
    """
    control = control or Control()
    with _locks[client.corpus.root, source.connector_id]:
        source.validate()
        client.corpus.refresh()
        spark, own = client.spark, F.col("source_id") == source.connector_id
        cursors = CursorStore(client.corpus, "sync")
        kept = cursors.get(source.connector_id)
        known = None if kept is None else json.loads(kept)
        previous = None if known is None else client.corpus.read("file_state").where(own)
        control.progress("scan")
        try:
            scan, unreadable = source.scan(spark, control.stopped)
        except InterruptedError:
            return {"accepted": 0, "deleted": 0, "failed": 0, "cursor": kept, "stopped": True, "unreadable": []}
        scan = written(scan)
        root = os.path.abspath(source.root)
        mark = scan.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("document_id", "fingerprint"))).first()
        cursor = json.dumps({"root": root, "files": mark[0], "fingerprint": mark[1], "unreadable": len(unreadable)}, sort_keys=True)
        events = written(changes(previous, scan, unreadable, source.connector_id, known is not None and known["root"] != root, cursor))
        control.progress("read")
        current = scan.join(events.where("op = 'upsert'").select("document_id"), "document_id", "left_semi")
        payloads = source.payloads(current).drop("document_id", "source_id").withColumn("source_id", F.lit(source.connector_id))
        full = events.join(payloads.withColumnRenamed("id", "_id"), F.col("document_id") == F.col("_id"), "left").drop("_id")
        control.progress("commit")
        out = apply_changes(client, full, kept, control.stopped)
        if out["cursor"] == cursor and (cursor != kept or previous is None):
            state = next_state(previous, scan, events).select(F.lit(source.connector_id).alias("source_id"), "document_id", "fingerprint")
            others = client.corpus.read("file_state").where(~own)
            client.corpus.commit({"file_state": others.unionByName(state), "cursors": cursors.with_value(source.connector_id, cursor)})
        control.progress("done")
        return out | {"unreadable": sorted(p for p, _ in unreadable)}


def stream_changes(client, events: DataFrame, checkpoint: str, outcomes: list | None = None):
    """A streaming table of events, applied batch by batch until its end; replayed batches change nothing, as ids come from content."""

    def batch(rows: DataFrame, number: int) -> None:
        done = apply_changes(client, rows)
        if outcomes is not None:
            outcomes.append(done)
        if done["failed"]:
            raise RuntimeError(f"batch {number}: {done['failed']} payloads failed")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
