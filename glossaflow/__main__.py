"""Command line: translate archives, or mine a termbase from them."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glossaflow.operators import memory, qa, translate
from glossaflow.plans import run as runs
from glossaflow.plans.config import read_document, read_settings
from glossaflow.sources import archive_files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="glossaflow")
    commands = parser.add_subparsers(dest="command", required=True)
    t = commands.add_parser("translate", help="translate all archives of a path or pattern")
    t.add_argument("input")
    t.add_argument("output", help="folder for archives and report, or the one .epub file")
    t.add_argument("--termbase")
    t.add_argument("--memory", help="folder of the translation memory and the records of runs")
    t.add_argument("--resume", action="store_true")
    t.add_argument("--provider", default="mock", choices=[*translate.PROVIDERS, translate.MIXED])
    t.add_argument("--model", default="")
    for step in ("draft", "revise"):
        t.add_argument(f"--{step}-provider", choices=[*translate.PROVIDERS, *["none"] * (step == "revise")])
        t.add_argument(f"--{step}-model")
    m = commands.add_parser("termbase", help="mine terms")
    m.add_argument("input")
    m.add_argument("output", help="YAML or JSON file; its terms are kept")
    m.add_argument("--min-freq", type=int, default=2)
    m.add_argument("--max-terms", type=int, default=300)
    m.add_argument("--single", action="store_true")
    m.add_argument("--replace", action="store_true", help="leave out the terms that the file has")
    m.add_argument("--fill", action="store_true")
    m.add_argument("--fill-provider", default="mock", choices=list(translate.PROVIDERS))
    m.add_argument("--fill-model", default="")
    m.add_argument("--fill-batch-size", type=int, default=40)
    for command in (t, m):
        command.add_argument("--config")
        command.add_argument("--max-concurrency", type=int, help="calls that may be open at a time; else the cores of the cluster are the bound")
        command.add_argument("--verbose", action="store_true")
    return parser


def known_terms(spark: SparkSession, path: str) -> list[dict]:
    """Terms of a file that may not be there or may be no termbase; then there are none."""
    try:
        found = read_document(spark, path)
        return [t for t in found["terms"] if isinstance(t, dict) and t.get("source")]
    except Exception:
        return []


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("glossaflow").getOrCreate()
    books, settings = archive_files.read_entries(spark, args.input), read_settings(spark, args.config)
    run = runs.Run(spark, print if args.verbose else None)
    signal.signal(signal.SIGINT, lambda *_: run.cancel())
    if args.command == "termbase":
        options = runs.MiningOptions(
            args.min_freq, args.max_terms, args.single, not args.replace, args.fill, args.fill_provider, args.fill_model, args.fill_batch_size
        )
        old = known_terms(spark, args.output) if options.merge_existing else []
        try:
            payload, counts = runs.generate_termbase(spark, books, options, old, os.path.basename(args.input), settings, args.max_concurrency, run)
        except runs.Cancelled:
            print("cancelled", file=sys.stderr)
            return translate.exit_code(None, cancelled=True)
        write_mapping(payload, args.output)
        print(json.dumps(counts))
        return 0
    plan = translate.plan(args.provider, args.model, args.draft_provider, args.revise_provider, args.draft_model, args.revise_model)
    store = memory.Workspace(spark, args.memory) if args.memory else None
    outcome = runs.translate_books(spark, books, settings, args.termbase, plan, store, args.resume, run, args.max_concurrency, (args.input, args.output))
    if outcome.trace:
        print(outcome.trace, file=sys.stderr)
    one = args.output.lower().endswith(".epub")
    folder, _, file = args.output.rpartition("/") if one else (args.output, "", "")
    if outcome.files is not None:
        archive_files.write_books(outcome.files, (folder or ".") if one else f"{folder}/books", name=file)
    if outcome.issues is not None:
        qa.with_details(outcome.issues).write.mode("overwrite").parquet(f"{args.output}-issues" if one else f"{args.output}/issues")
        qa.report(outcome.issues, outcome.counts.get("total_segments", 0)).orderBy("part").select(F.col("line").alias("value")).write.mode("overwrite").text(f"{args.output}-report" if one else f"{args.output}/report")
    outcome.release()
    print(outcome.summary)
    return outcome.code


def write_mapping(payload: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        if path.lower().endswith(".json"):
            json.dump(payload, f, ensure_ascii=False, indent=2)
        else:
            import yaml

            yaml.safe_dump(payload, f, allow_unicode=True, sort_keys=False)


if __name__ == "__main__":
    sys.exit(main())
