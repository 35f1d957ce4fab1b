"""Command line: analyze, detectors, schema. Exit codes: 0 fine, 1 a finding at or above --fail-on, 2 input refused, 3 wrong usage."""

from __future__ import annotations

import argparse
import json
import os
import sys

from runlens.operators.detect import DETECTORS, WASTEFUL, Config
from runlens.schema import SEVERITIES, schema_document
from runlens.sources.limits import InputError, Limits


class UsageError(Exception):
    pass


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


def one_line(text: str) -> str:
    return "".join(c if c.isprintable() else " " for c in text)


def parser() -> Parser:
    p = Parser(prog="runlens")
    sub = p.add_subparsers(dest="command", required=True, parser_class=Parser)
    a = sub.add_parser("analyze")
    a.add_argument("paths", nargs="+")
    a.add_argument("--json", dest="json_out")
    a.add_argument("--out", dest="html_out")
    a.add_argument("--tables", help="folder for Parquet tables")
    a.add_argument("--rates", help="a rate snapshot")
    a.add_argument("--fail-on", choices=SEVERITIES)
    a.add_argument("--no-previews", action="store_true")
    a.add_argument("--detectors", help="comma-separated")
    a.add_argument("--blocked-gap-seconds", type=int, default=60)
    for name, value in vars(Limits()).items():
        a.add_argument(f"--max-{name.replace('_', '-')}", type=int, default=value, dest=f"max_{name}")
    sub.add_parser("detectors")
    sub.add_parser("schema")
    return p


def check_output(path: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    if "\0" in path or not os.path.isdir(folder) or os.path.isdir(path) or (os.path.exists(path) and not os.path.isfile(path)):
        raise UsageError(f"can't write {path}")


def detectors_document() -> str:
    return json.dumps([{"slug": k, "attributes_waste": k in WASTEFUL, "does": (f.__doc__ or "").split("\n")[0]} for k, f in DETECTORS.items()], indent=2) + "\n"


def run(argv: list[str], stdout, stderr, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "detectors":
        stdout.write(detectors_document())
        return 0
    if args.command == "schema":
        stdout.write(schema_document())
        return 0
    if not (args.json_out or args.html_out or args.tables):
        raise UsageError("one of --json, --out and --tables is needed")
    outs = [x for x in (args.json_out, args.html_out) if x]
    for path in outs:
        check_output(path)
    if len({os.path.realpath(x) for x in outs}) < len(outs):
        raise UsageError("outputs must differ")
    try:
        limits = Limits(**{k: getattr(args, f"max_{k}") for k in vars(Limits())})
        config = Config(args.blocked_gap_seconds, tuple(args.detectors.split(",")) if args.detectors else None)
    except ValueError as e:
        raise UsageError(str(e)) from e

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from runlens.plans import analyze, publish, report
    from runlens.sources import rates
    from runlens.sources.scan import check_paths

    paths = check_paths(args.paths, limits)
    spark = spark or SparkSession.builder.appName("runlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tables = analyze.analyze(spark, paths, limits, config, rates.load(spark, args.rates) if args.rates else None, not args.no_previews, one_trace=True)
    if bad := tables["fatal"].first():
        raise InputError(bad.code, f"file {bad.file_index}, line {bad.line}")
    trace = tables["source_files"].first().trace_id
    texts = ({args.json_out: report.json_parts(report.streamed(tables, trace, not args.no_previews))} if args.json_out else {}) | ({args.html_out: report.html_parts(tables, trace, not args.no_previews)} if args.html_out else {})
    report.write_all(texts)
    if args.tables:
        publish.write_tables(tables, args.tables)
    n = tables["findings"].count()
    stdout.write(f"{n} findings in trace {trace}; wrote {', '.join([*texts, *([args.tables] if args.tables else [])])}\n")
    floor = SEVERITIES.index(args.fail_on) if args.fail_on else len(SEVERITIES)
    return int(not tables["findings"].where(F.col("severity_rank") >= floor).isEmpty())


def main(argv: list[str] | None = None, stdout=sys.stdout, stderr=sys.stderr, spark=None) -> int:
    try:
        return run(sys.argv[1:] if argv is None else argv, stdout, stderr, spark)
    except UsageError as e:
        stderr.write(f"usage: {one_line(str(e))}\n")
        return 3
    except (InputError, OSError) as e:
        stderr.write(f"input: {one_line(str(e))}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
