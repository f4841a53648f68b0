"""Command line: `python -m readmend.plans.cli -readlist f -kmerlength 31 -prefix p`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from readmend.config import PHRED_LIMITS, ConfigError, InputError, RunConfig
from readmend.plans.correction import correct_read_list
from readmend.sources.readlist import read_list


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readmend", description="Correct short reads on Spark.")
    p.add_argument("-prefix", required=True, help="prefix of all outputs (a shared folder)")
    p.add_argument("-readlist", help="file naming the reads, mates on adjacent lines")
    p.add_argument("-read", action="append", help="a single-end file")
    p.add_argument("-read1", help="first mates")
    p.add_argument("-read2", help="second mates")
    p.add_argument("-kmerlength", type=int, required=True)
    p.add_argument("-count", type=int, help="k-mer threshold; default: from the histogram")
    p.add_argument("-fpr", type=float, default=0.001)
    p.add_argument("-seed", type=int, default=0)
    p.add_argument("-extend", type=int, default=5)
    p.add_argument("-load", help="prefix of a saved filter")
    p.add_argument("-membership", choices=["filter", "exact"], default="filter",
                   help="exact: test the solid k-mers themselves, no false positives")
    p.add_argument("-phred_rule", choices=sorted(PHRED_LIMITS), help="default: by pairing")
    p.add_argument("-compat", choices=["intended", "scalar"], default="intended")
    p.add_argument("-notrim", action="store_true")
    p.add_argument("-gzip", action="store_true", help="compress the corrected reads")
    p.add_argument("-single-end", dest="single", action="store_true")
    p.add_argument("-paired-end", "-paried-end", dest="single", action="store_false")
    p.add_argument("-max_mem", type=int, default=4, help="accepted; Spark's memory settings rule")
    p.add_argument("-smpthread", type=int, default=0, help="accepted; Spark's cores rule")
    p.add_argument("-debug", action="store_true", help="accepted, no effect")
    return p


def file_groups(args: argparse.Namespace) -> list[list[str]]:
    given = [bool(args.readlist), bool(args.read), bool(args.read1 or args.read2)]
    if sum(given) != 1:
        raise ConfigError("give one of -readlist, -read, or -read1 with -read2")
    if args.readlist:
        return read_list(args.readlist, not args.single)
    if args.read:
        return [[f] for f in args.read]
    if not (args.read1 and args.read2):
        raise ConfigError("-read1 and -read2 go together")
    return [[args.read1, args.read2]]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if not 4 <= args.max_mem <= 1024:
            raise ConfigError("-max_mem must be in 4..1024")
        groups = file_groups(args)
        config = RunConfig(
            k=args.kmerlength, prefix=args.prefix, threshold=args.count, fpr=args.fpr,
            seed=args.seed, max_extension=args.extend, trim=not args.notrim,
            paired=len(groups[0]) == 2, gzip=args.gzip, membership=args.membership,
            phred_rule=args.phred_rule, compat=args.compat)
        spark = spark or SparkSession.builder.appName("readmend").getOrCreate()
        for report in correct_read_list(spark, groups, config, args.load):
            print("\n".join(report.lines() + [f"written: {o}" for o in report.outputs]))
    except (ConfigError, InputError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
