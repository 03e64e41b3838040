"""python -m proofline ingest | sessions | audit | mutate | export-corpus | eval"""

from __future__ import annotations

import argparse
import getpass
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.dictionaries import COMMAND_CLASSES, REDACTIONS, Redaction, load_command_classes, load_redactions, merged
from proofline.functions.redact import unmask
from proofline.operators.claims import ClaimExtractor, RuleClaims
from proofline.operators.extractors import MODELS, backend_claims
from proofline.plans import audit, evaluate, export, mutate, reports
from proofline.scratch import cut
from proofline.sources.files import existing, joined, physical_lines
from proofline.sources.store import Store, StoreError
from proofline.sources.transcripts import expand


def _system_user() -> str | None:
    try:
        return getpass.getuser()
    except (KeyError, OSError):  # no name for this user
        return None


def _arguments(given: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="proofline")
    top.add_argument("--user", default=_system_user(), help="the user's name that is masked; the system's user if not given, none if empty")
    top.add_argument("--redactions", help="a redaction dictionary")
    top.add_argument("--classes", help="a dictionary of command classes")
    commands = top.add_subparsers(dest="command", required=True)
    claims = [("--extractor", {"choices": ["rules", "llm"], "default": "rules"}), ("--llm-backend", {"choices": list(MODELS), "default": "codex-exec"}), ("--llm-model", {"help": "the backend's default if not given"})]

    def add(name: str, *options: tuple) -> None:
        sub = commands.add_parser(name)
        sub.add_argument("--db", default="proofline-store")
        for option, settings in options:
            sub.add_argument(option, **settings)

    home = str(Path.home() / ".proofline/corpus")
    add("ingest", ("patterns", {"nargs": "+"}), ("--force", {"action": "store_true"}))
    add("sessions", ("--limit", {"type": int, "default": 1000, "help": "how many are shown"}))
    add("audit", ("session", {"nargs": "?"}), ("--all", {"action": "store_true"}), ("--out", {"default": "audit-reports"}), ("--html", {"action": "store_true"}), *claims)
    add("mutate", ("--out", {"default": "mutations"}), ("--anonymized-dir", {"default": home}))
    add("export-corpus", ("--out", {"default": home}))
    add("eval", ("--mutations", {"required": True}), ("--out", {}), *claims)
    return top.parse_args(given)


def _extractor(args: argparse.Namespace, settings: Redaction) -> ClaimExtractor:
    if args.extractor == "rules":
        return RuleClaims(settings)
    try:
        return backend_claims(args.llm_backend, args.llm_model, os.environ.get("ANTHROPIC_API_KEY"))
    except ValueError as why:
        raise SystemExit(str(why)) from why


def _sources(store: Store, user: str, anonymized: str | None = None) -> DataFrame:
    """resolved() or mutation_sources() of all sessions; the tasks look for the files."""
    sessions = store.read("sessions")
    paths = sessions.select(unmask(F.col("source_path"), user).alias("path"))
    if anonymized is None:
        return cut(export.resolved(sessions, existing(paths), user), "sources")
    masked = sessions.select(F.concat(F.lit(anonymized.rstrip("/") + "/"), "id", F.lit(".jsonl")).alias("path"))
    return cut(export.mutation_sources(sessions, existing(paths.union(masked)), anonymized, user), "sources")


def _lines_of(sources: DataFrame) -> DataFrame:
    """(session_id, file, line, raw) of the sources that have a path."""
    there = sources.where("path is not null").select("session_id", "path")
    return physical_lines(there.select("path").distinct().repartition("path")).join(there, "path").select("session_id", F.col("path").alias("file"), "line", "raw")


def main(given: list[str] | None = None) -> int:
    args = _arguments(given)
    spark = SparkSession.builder.appName("proofline").getOrCreate()
    settings = Redaction(args.user or None, tuple(merged(load_redactions(args.redactions)) if args.redactions else REDACTIONS))
    classes = load_command_classes(args.classes) if args.classes else COMMAND_CLASSES
    store = Store(spark, str(Path(args.db).absolute()) if "://" not in args.db else args.db, settings)
    user = args.user or "USER"
    if args.command == "ingest":
        stored, refused = audit.ingest_all(store, expand(args.patterns), args.force, classes)
        for row in stored.orderBy("source_path").toLocalIterator():
            print(f"{row.source_path}: session {row.id}, {row.total_lines} lines, {row.redaction_count} redactions")
        failed = 0
        for row in refused.orderBy("file").toLocalIterator():
            failed += 1
            print(f"{row.file}: {row.reason}", file=sys.stderr)
        print(f"stored {stored.count()}, failed {failed}")
        return int(failed > 0)
    if args.command == "sessions":
        found = store.summary()
        found.show(args.limit, False)
        print(f"{found.count()} sessions")
    elif args.command == "audit":
        if not args.all and not args.session:
            raise SystemExit("give a session or --all")
        only = None if args.all else args.session
        found, verdicts, contracts = audit.audit_store(store, only, _extractor(args, settings))
        sessions = store.read("sessions", only).selectExpr("id as session_id")
        bundles = reports.bundle(sessions, found, verdicts, store.read("events", only), contracts, 200 if args.html else 160)
        texts = [("json", reports.as_json(bundles)), ("md", reports.as_markdown(bundles))] + ([("html", reports.as_html(bundles))] if args.html else [])
        for kind, df in texts:
            df.withColumnRenamed(df.columns[1], "value").write.mode("overwrite").partitionBy("session_id").text(f"{args.out}/{kind}")
        if args.html and args.all:
            reports.index_page(reports.totals(found, verdicts, sessions)).withColumnRenamed("html", "value").coalesce(1).write.mode("overwrite").text(f"{args.out}/index")
        reports.histogram(verdicts).show()
        reports.histogram(verdicts, "reason_code").show(50, False)
        reports.run_totals(found, sessions).show()
    elif args.command == "mutate":
        sources = _sources(store, user, args.anonymized_dir)
        if not sources.where("path is not null").limit(1).count():
            raise SystemExit("no transcript was found")
        sources.groupBy("origin").count().orderBy("origin").show()
        made, manifest, skipped = mutate.generate(_lines_of(sources), settings, classes)
        manifest, skipped = cut(manifest, "manifest"), cut(skipped, "skipped")
        mutate.write(made, manifest, args.out)
        mutate.per_operator(manifest).orderBy("operator").show()
        skipped.orderBy("operator", "mutant_id").show(50, False)
        print(f"{manifest.count()} mutants, {skipped.count()} skipped")
    elif args.command == "export-corpus":
        sources = _sources(store, user)
        problems = export.write(*export.export(_lines_of(sources).select("session_id", "line", "raw"), settings), args.out, sources, settings)
        print("\n".join(problems) if problems else f"written to {args.out}")
        return int(bool(problems))
    elif args.command == "eval":
        mutants, manifest = evaluate.read_mutants(spark, args.mutations)
        results = cut(evaluate.evaluate(mutants, manifest, settings, _extractor(args, settings), classes), "results")
        row = evaluate.report(results).first()
        out = args.out or joined(args.mutations, "eval-reports")
        for kind, text in (("json", row.json), ("md", row.markdown)):
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{kind}")
        print(row.markdown)
        return int(not evaluate.passed(results))
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except StoreError as why:
        sys.exit(str(why))
