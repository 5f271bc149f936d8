"""Command line: python -m cytolake.cli VERB OPTIONS."""

from __future__ import annotations

import argparse
import sys
from functools import cache

from pyspark.sql import SparkSession

from .plans import verbs
from .schema import POPULATION_DEPTH


class _Parser(argparse.ArgumentParser):
    """An unknown verb or a missing option prints the help and ends normally."""

    def error(self, message: str):
        self.print_help()
        self.exit(0, f"{self.prog}: {message}\n")


@cache
def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="cytolake", description="Methylation calls from bisulfite sequencing.")
    sub = top.add_subparsers(dest="verb")

    def verb(name: str, about: str, many: bool, several: str = "--input") -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about, description=about)
        p.add_argument("--input", "--inputs", "-i", dest="input", required=True, action="append" if many else "store", help="input file" + "; may be repeated" * many)
        p.add_argument("--output", "-o", required=True, help="output file" if name != "extract" else "output folder")
        if name != "extract":
            p.add_argument("--unsorted", action="store_true", help="inputs may be in any order; all calls are shuffled")
        p.add_argument("--threads", "-t", type=int, default=1, help="cores, where no cluster is configured")
        return p

    verb("extract", "Counts by context from Bismark alignments.", False).add_argument("--contigs", "-c", default="", help="control contigs, separated by blanks")
    verb("merge", "Add up the counts of call files.", True)
    verb("call", "Correct ratios by the control contigs.", False).add_argument("--error", "-e", type=float, default=0.0, help="error rate without controls")
    verb("popCall", "Mean and standard error over samples.", True).add_argument("--cutoff", "-c", type=int, default=POPULATION_DEPTH, help="least depth")
    p = verb("diff", "Test two conditions by site or region.", True)
    p.add_argument("--conditions", "-c", required=True, help="a number for each input, separated by commas")
    p.add_argument("--regions", "-r", help="region file")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb is None:
        parser().print_help()
        return 0
    builder = SparkSession.builder.appName("cytolake")
    spark = spark or (SparkSession.getActiveSession() or builder.config("spark.master", f"local[{max(args.threads, 1)}]").getOrCreate())
    if args.verb == "extract":
        verbs.extract(spark, args.input, args.output, tuple(args.contigs.split()))
    elif args.verb == "merge":
        verbs.merge(spark, args.input, args.output, args.unsorted)
    elif args.verb == "call":
        verbs.call(spark, args.input, args.output, args.error, args.unsorted)
    elif args.verb == "popCall":
        verbs.population_call(spark, args.input, args.output, args.cutoff, args.unsorted)
    else:
        verbs.diff(spark, args.input, args.output, [int(x) for x in args.conditions.split(",")], args.regions, args.unsorted)
    return 0


if __name__ == "__main__":
    sys.exit(main())
