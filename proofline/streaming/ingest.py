"""Transcripts that arrive in a folder go to the store as they come.

A batch replaces its sessions in the store, so a batch that runs again after a failure changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofline.operators.adapter import adapt
from proofline.plans.audit import audit
from proofline.scratch import cut
from proofline.sources.store import Store
from proofline.sources.transcripts import lines, parse


def follow(store: Store, folder: str, checkpoint: str, audited: bool = True, files_per_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Start ingesting files of folder; audited: also store claims and verdicts. once: end after what is there."""
    spark = store.spark
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file"), F.col("value").alias("content"))

    def put(batch: DataFrame, _: int) -> None:
        sessions, events = adapt(cut(parse(lines(batch)), "parsed"), store.settings)
        sessions, events = cut(sessions, "sessions"), cut(events, "events")
        store.upsert(sessions, events, force=True)
        if audited:
            claims, verdicts, _ = audit(events, settings=store.settings)
            store.save_audit(cut(claims, "claims"), cut(verdicts, "verdicts"), sessions.selectExpr("id as session_id"))

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
