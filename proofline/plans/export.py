"""Corpus export: transcripts with every line redacted, written only if nothing is left to redact and no line broke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from proofline.functions.dictionaries import Redaction
from proofline.functions.redact import redact, redact_with_count, residual_secrets, unmask
from proofline.packages import ship
from proofline.scratch import cut
from proofline.sources.files import digests, joined, write_files, write_list
from proofline.sources.transcripts import is_json


@pandas_udf(BooleanType())
def valid_json(text):  # noqa: ANN001, ANN201
    """Strict JSON, which no function of Spark tests."""
    return text.map(is_json)


def resolved(sessions: DataFrame, files: DataFrame, user: str) -> DataFrame:
    """(session_id, path, reason) of sessions (id, source_path) against a listing of files (path); path is null where none is there."""
    wanted = sessions.select(F.col("id").alias("session_id"), "source_path", unmask(F.col("source_path"), user).alias("path"))
    found = wanted.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    missing = F.when(F.coalesce("source_path", F.lit("")) == "", F.lit("source_path not found in store")).when(F.col("there").isNull(), F.concat(F.lit("resolved path does not exist: "), F.col("path")))
    return found.select("session_id", F.when(missing.isNull(), F.col("path")).alias("path"), missing.alias("reason"))


def mutation_sources(sessions: DataFrame, files: DataFrame, anonymized: str, user: str) -> DataFrame:
    """resolved() with origin: a session's anonymised file where there is one, else its raw file."""
    here = files.select("path").distinct()
    masked = sessions.select(F.col("id").alias("session_id"), F.concat(F.lit(f"{anonymized.rstrip('/')}/"), F.col("id"), F.lit(".jsonl")).alias("path"))
    safe = masked.join(here, "path", "left_semi").select("session_id", F.col("path").alias("safe"))
    both = resolved(sessions, files, user).join(safe, "session_id", "left")
    origin = F.when(F.col("safe").isNotNull(), "anonymized").when(F.col("path").isNotNull(), "raw")
    return both.select("session_id", F.coalesce("safe", "path").alias("path"), origin.alias("origin"), F.when(origin.isNull(), F.col("reason")).alias("reason"))


def redacted_lines(rows: DataFrame, settings: Redaction = Redaction(), column: str = "raw") -> DataFrame:
    """rows with text, count and broken: a line that was JSON and no longer is. Empty lines stay as they are."""
    ship(rows.sparkSession)
    out = redact_with_count(rows, column, "text", "count", settings)
    return out.withColumn("broken", (F.col(column) != "") & valid_json(column) & ~valid_json("text"))


#: Fixed value: what is said of a line that redaction broke.
BROKEN = "redaction produced invalid JSON (was valid before redaction)"
ENTRY = ("session_id", "exported", "source_path", "reason", "line_count", "redaction_count", "sha256", "broken_lines", "exported_at")


def export(rows: DataFrame, settings: Redaction = Redaction(), at: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, manifest, problems) for rows (session_id, line, raw) split at line feeds only.

    sha256 is that of the bytes that are written: all lines, joined by line feeds. problems lists broken lines and texts with
    residual secrets; only without any may lines be written.
    """
    done = cut(redacted_lines(rows, settings).select("session_id", "line", "text", "count", "broken"), "masked")
    manifest = done.groupBy("session_id").agg(
        F.count("*").alias("line_count"), F.sum("count").alias("redaction_count"),
        F.array_sort(F.collect_list(F.when(F.col("broken"), F.struct("line", F.lit(BROKEN).alias("reason"))))).alias("broken_lines"),
    ).join(digests(done, "session_id"), "session_id")
    manifest = manifest.withColumns({"exported": F.lit(True), "exported_at": F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")})
    broken = done.where("broken").select("session_id", "line", F.lit("redaction produced invalid JSON").alias("problem"))
    secret = done.select("session_id", "line", F.explode(residual_secrets(F.col("text"), settings)).alias("problem"))
    return done.select("session_id", "line", "text"), manifest, broken.unionByName(secret)


def write(lines: DataFrame, manifest: DataFrame, problems: DataFrame, folder: str, sources: DataFrame | None = None, settings: Redaction = Redaction(), shown: int = 20) -> list[str]:
    """Write <session_id>.jsonl for each session and manifest.json, or nothing: then the first problems and the number of the rest.

    sources: resolved(), for the masked source paths and the sessions that could not be exported.
    """
    count = problems.count()
    if count:
        first = [f"{r.session_id}:{r.line}: {r.problem}" for r in problems.orderBy("session_id", "line", "problem").limit(shown).collect()]
        return first + ([f"and {count - shown} more"] if count > shown else [])
    written = write_files(lines.select(F.concat("session_id", F.lit(".jsonl")).alias("path"), "line", "text"), folder)
    written = cut(written.select(F.regexp_replace("path", r"\.jsonl$", "").alias("session_id"), F.col("sha256").alias("written")), "written")
    manifest = cut(manifest.join(written, "session_id", "left"), "manifest")
    wrong = manifest.where("written is null or written <> sha256").limit(shown).collect()
    if wrong:
        return [f"{r.session_id}: the file is not what was to be written" for r in wrong]
    if sources is not None:
        manifest = manifest.join(sources.where("path is not null").select("session_id", redact(F.col("path"), settings).alias("source_path")), "session_id", "left")
        manifest = manifest.unionByName(sources.where("path is null").select("session_id", "reason", F.lit(False).alias("exported")), allowMissingColumns=True)
    write_list(manifest.select(*[c for c in ENTRY if c in manifest.columns]), joined(folder, "manifest.json"), ["session_id"])
    return []
