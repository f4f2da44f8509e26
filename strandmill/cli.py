"""``python -m strandmill``: describe, filter, lint and subsample FASTQ files."""

from __future__ import annotations

import argparse
import logging
import sys

from . import __version__
from .functions.names import parse_separator
from .operators import filters, sampling
from .operators.validators import LEVELS

log = logging.getLogger("strandmill")


def _separator(value: str) -> str:
    try:
        return parse_separator(value)
    except ValueError as wrong:
        raise argparse.ArgumentTypeError(str(wrong)) from wrong


def _pattern(value: str) -> str:
    try:
        filters.java_pattern(value)
    except ValueError as wrong:
        raise argparse.ArgumentTypeError(str(wrong)) from wrong
    return value


def _probability(value: str) -> float:
    try:
        return sampling.check_probability(float(value))
    except ValueError as wrong:
        raise argparse.ArgumentTypeError(str(wrong)) from wrong


def _count(value: str) -> int:
    if not value.isascii() or not value.isdigit():
        raise argparse.ArgumentTypeError(f"invalid record count: {value}")
    return int(value)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandmill", description="Utilities for FASTQ files on Spark")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)

    one = commands.add_parser("describe", help="print metrics of a file")
    one.add_argument("src")

    one = commands.add_parser("filter", help="keep records by name or sequence")
    either = one.add_mutually_exclusive_group()
    either.add_argument("--names", help="allowlist of record names")
    either.add_argument("--sequence-pattern", type=_pattern, help="keep records whose sequence matches")
    one.add_argument("--dsts", action="append", required=True, help="destinations, one a source")
    one.add_argument("srcs", nargs="*")

    one = commands.add_parser("lint", help="validate a file or a pair")
    one.add_argument("--lint-mode", choices=["panic", "log"], default="panic")
    one.add_argument("--single-read-validation-level", choices=LEVELS, default="high")
    one.add_argument("--paired-read-validation-level", choices=LEVELS, default="high")
    one.add_argument("--disable-validator", action="append", default=[])
    one.add_argument("--record-definition-separator", type=_separator)
    one.add_argument("r1_src")
    one.add_argument("r2_src", nargs="?")

    one = commands.add_parser("subsample", help="write a sample of a file or a pair")
    either = one.add_mutually_exclusive_group(required=True)
    either.add_argument("-p", "--probability", type=_probability)
    either.add_argument("-n", "--record-count", type=_count)
    one.add_argument("-s", "--seed", type=_count)
    one.add_argument("--r1-dst", required=True)
    one.add_argument("--r2-dst")
    one.add_argument("r1_src")
    one.add_argument("r2_src", nargs="?")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    """Runs a command; 0 if all went well, 1 for violations or failures."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, stream=sys.stderr)
    from .plans import commands
    from .plans.runtime import local_session

    spark = spark or local_session()
    try:
        if args.command == "describe":
            print("\n".join(commands.describe_lines(commands.describe(spark, args.src))))
        elif args.command == "filter":
            commands.filter_files(spark, args.srcs, args.dsts, args.names, args.sequence_pattern)
        elif args.command == "subsample":
            commands.subsample_files(spark, args.r1_src, args.r1_dst, args.r2_src, args.r2_dst, args.probability, args.record_count, args.seed)
        else:
            return _lint(spark, args)
    except Exception as wrong:
        print(f"error: {_reason(wrong)}", file=sys.stderr)
        return 1
    return 0


def _lint(spark, args: argparse.Namespace) -> int:
    from .plans import commands

    found, ended = commands.lint_files(
        spark, args.r1_src, args.r2_src, args.single_read_validation_level, args.paired_read_validation_level, args.disable_validator, args.record_definition_separator
    )
    panic, failures = args.lint_mode == "panic", 0
    for v in commands.lint_report(found, panic):
        failures += 1
        place = f"{v.src}:{v.line_no}" + (f":{v.col_no}" if v.col_no is not None else "")
        print(f"{place}: [{v.validator_code}] {v.validator_name}: {v.message}", file=sys.stderr)
    if ended and not (panic and failures):
        raise commands.CommandError(ended)
    return 1 if failures else 0


def _reason(wrong: Exception) -> str:
    """The line that says why, without the engine's trace."""
    lines = [x for x in str(wrong).splitlines() if x.strip()]
    told = [x for x in lines if x.startswith(("EOFError:", "FileNotFoundError:")) or "USER_RAISED_EXCEPTION" in x]
    return (told or lines or [type(wrong).__name__])[-1 if told else 0].strip()
