"""The store: the tables sessions, events, claims and verdicts as Parquet, partitioned by a hash of the session.

New sessions are appended. Replacing a session rewrites only the partitions that hold incoming sessions: old rows are left out by an
anti join, new ones are added, the result is written aside and then moved over these partitions alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from proofline.functions.dictionaries import Redaction
from proofline.functions.redact import residual_secrets
from proofline.schemas import CLAIM_KINDS, COMMAND_CLASSES, EVENT_TYPES, STATUSES, STORE_VERSION, VERDICTS, tables


class StoreError(ValueError):
    pass


def violations(df: DataFrame, columns: list[str], settings: Redaction, keep: list[str] = ()) -> DataFrame:
    """(keep, column, label, value) of every text that redaction should have masked."""
    found = [df.select(*keep, F.lit(c).alias("column"), F.explode(residual_secrets(F.col(c).cast("string"), settings)).alias("label"), F.col(c).cast("string").alias("value")) for c in columns]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def without_sessions(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of sessions that are not incoming (session_id)."""
    return old.join(incoming.select("session_id").distinct(), "session_id", "left_anti")


def replaced(old: DataFrame, new: DataFrame, incoming: DataFrame) -> DataFrame:
    return without_sessions(old, incoming).unionByName(new)


def collisions(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, stored, incoming) of sessions that are stored from another path, or come in from several."""
    new = incoming.select("id", F.col("source_path").alias("incoming"))
    both = new.join(existing.select("id", F.col("source_path").alias("stored")), "id").where("stored <> incoming")
    twice = new.groupBy("id").agg(F.min("incoming").alias("stored"), F.max("incoming").alias("incoming")).where("stored <> incoming")
    return both.select("id", "stored", "incoming").unionByName(twice)


def orphan_verdicts(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """Verdicts without their claim."""
    return verdicts.join(claims.select("session_id", "claim_id"), ["session_id", "claim_id"], "left_anti")


def summary(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Each session with its counts of events, ordered by ingested_at and id."""
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    per = events.groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("event_count"), count(F.col("type") == "command", "command_count"), count(F.col("type") == "file_edit", "file_edit_count"), count(F.col("type") == "instruction", "instruction_count"),
        count(F.col("type") == "report", "report_count"), count(F.col("outcome_status") == "error", "error_count"),
    )
    names = [c for c in per.columns if c != "id"]
    return sessions.join(per, "id", "left").select(*sessions.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names]).orderBy("ingested_at", "id")


def _first(df: DataFrame, message: str) -> None:
    rows = df.limit(5).collect()
    if rows:
        raise StoreError(f"{message}: " + "; ".join(str(r.asDict()) for r in rows))


class Store:
    """folder: any path that Spark writes. buckets: partitions of each table; more for more sessions."""

    def __init__(self, spark: SparkSession, folder: str, settings: Redaction = Redaction(), buckets: int = 64):
        self.spark, self.folder, self.settings, self.buckets, self.schemas = spark, folder.rstrip("/"), settings, buckets, tables()
        self._version()

    def _path(self, *parts: str) -> str:
        return "/".join((self.folder, *parts))

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _version(self) -> None:
        path = self._path("_meta")
        if not self._exists(path):
            meta = json.dumps({"version": STORE_VERSION, "buckets": self.buckets})
            self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(path)
            return
        meta = json.loads(self.spark.read.text(path).first()[0])
        if meta["version"] != STORE_VERSION:
            raise StoreError(f"{self.folder} has version {meta['version']}; this engine reads {STORE_VERSION} only and migrates nothing")
        self.buckets = meta["buckets"]

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _key(self, name: str) -> str:
        return "id" if name == "sessions" else "session_id"

    def read(self, name: str, session_id: str | None = None) -> DataFrame:
        """A table, or one session's rows, which prunes to one partition."""
        schema = self.schemas[name]
        path = self._path(name)
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(StructType([*schema, StructField("bucket", IntegerType())])).parquet(path)
        if session_id is not None:
            df = df.where((F.col("bucket") == self._bucket(F.lit(session_id))) & (F.col(self._key(name)) == session_id))
        return df.drop("bucket")

    def _replace(self, name: str, new: DataFrame, incoming: DataFrame) -> None:
        """Put new rows in the place of all rows of the incoming sessions (session_id)."""
        key = self._key(name)
        touched = [r[0] for r in incoming.select(self._bucket(F.col("session_id"))).distinct().collect()]  # at most one for each partition
        if not touched:
            return
        old = self.read(name).withColumn("bucket", self._bucket(F.col(key))).where(F.col("bucket").isin(touched)).drop("bucket")
        old = old if key == "session_id" else old.withColumn("session_id", F.col("id"))
        if not old.join(incoming, "session_id", "left_semi").limit(1).count():  # nothing to replace: what is there stays as it is
            rows = new.select(*self.schemas[name].names).withColumn("bucket", self._bucket(F.col(key)))
            rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self._path(name))
            return
        kept = without_sessions(old, incoming)
        kept = kept if key == "session_id" else kept.drop("session_id")
        rows = kept.unionByName(new.select(*kept.columns)).withColumn("bucket", self._bucket(F.col(key)))
        staged = self._path("_staging", uuid.uuid4().hex)
        rows.repartition("bucket").write.partitionBy("bucket").parquet(staged)
        schema = rows.schema
        ready = self.spark.read.schema(schema).parquet(staged)
        left = {r[0] for r in ready.select("bucket").distinct().collect()}
        gone = [b for b in touched if b not in left]
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._path(name))
        for path in [staged, *[self._path(name, f"bucket={b}") for b in gone]]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def refused(self, sessions: DataFrame, events: DataFrame, force: bool = False) -> DataFrame:
        """(file, reason) of sessions, with events, both with the file that they come from, that upsert() would not store."""
        ids = sessions.select(F.col("id").alias("session_id"), "file")
        found = violations(sessions.select("file", "source_path", "project"), ["source_path", "project"], self.settings, ["file"]).unionByName(violations(events, ["redacted_input", "cwd"], self.settings, ["file"]))
        out = found.select("file", F.concat(F.lit("redaction audit failed: "), "column", F.lit(" has "), "label").alias("reason"))
        if not force:
            wrong = collisions(sessions, self.read("sessions")).select(F.col("id").alias("session_id")).distinct()
            out = out.unionByName(ids.join(wrong, "session_id", "left_semi").select("file", F.lit("the session is stored from another path, or comes from several files").alias("reason")))
        return out.groupBy("file").agg(F.min("reason").alias("reason"))

    def upsert(self, sessions: DataFrame, events: DataFrame, force: bool = False) -> None:
        """Store sessions with their events in the place of earlier ones, whose claims and verdicts go too. Checks come first; a
        failure stores nothing."""
        sessions = sessions.select(*[f.name for f in self.schemas["sessions"]])
        events = events.select(*[f.name for f in self.schemas["events"]])
        ids = sessions.select(F.col("id").alias("session_id")).distinct()
        _first(events.join(ids, "session_id", "left_anti").select("session_id").distinct(), "events of a session that is not stored with them")
        allowed = lambda c, values: F.col(c).isNotNull() & ~F.col(c).isin(*values)
        _first(events.where(F.col("type").isNull() | allowed("type", EVENT_TYPES) | allowed("command_class", COMMAND_CLASSES) | allowed("outcome_status", STATUSES) | (F.col("seq") < 0)).select("session_id", "seq", "type", "command_class", "outcome_status"), "invalid event")
        _first(events.groupBy("session_id", "seq").count().where("count > 1"), "repeated seq")
        if not force:
            _first(collisions(sessions, self.read("sessions")), "the session is stored from another path")
        _first(violations(sessions, ["source_path", "project"], self.settings), "redaction audit failed")
        _first(violations(events, ["redacted_input", "cwd"], self.settings), "redaction audit failed")
        for name, new in (("verdicts", None), ("claims", None), ("events", events), ("sessions", sessions)):
            self._replace(name, self.read(name).limit(0) if new is None else new, ids)

    def save_audit(self, claims: DataFrame, verdicts: DataFrame, sessions: DataFrame) -> None:
        """Store claims and verdicts in the place of those that the sessions (session_id) had."""
        ids = sessions.select("session_id").distinct()
        allowed = lambda c, values: F.col(c).isNull() | ~F.col(c).isin(*values)
        _first(claims.where(allowed("kind", CLAIM_KINDS)).select("claim_id", "kind"), "invalid claim")
        _first(verdicts.where(allowed("verdict", VERDICTS)).select("claim_id", "verdict"), "invalid verdict")
        _first(claims.join(ids, "session_id", "left_anti").select("session_id", "claim_id"), "claim of another session")
        _first(orphan_verdicts(verdicts, claims).select("session_id", "claim_id"), "verdict without a claim")
        _first(claims.groupBy("session_id", "claim_id").count().where("count > 1"), "repeated claim")
        _first(violations(claims.withColumn("paths", F.array_join("paths", "\n")), ["text", "cwd", "paths"], self.settings), "redaction audit failed")
        self._replace("claims", claims, ids)
        self._replace("verdicts", verdicts, ids)

    def summary(self) -> DataFrame:
        return summary(self.read("sessions"), self.read("events"))
