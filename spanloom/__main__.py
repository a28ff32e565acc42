"""``python -m spanloom process-sample|merge-call|make-vcf``: each option is a field of the stage."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession

from spanloom.plans.pipeline import MakeVcf, MergeCall, ProcessSample

STAGES = {"process-sample": (ProcessSample, "input_files"), "ps": (ProcessSample, "input_files"), "merge-call": (MergeCall, "stores"), "mc": (MergeCall, "stores"), "make-vcf": (MakeVcf, "store"), "vcf": (MakeVcf, "store")}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom")
    subs = top.add_subparsers(dest="stage", required=True)
    for name, (kind, rest) in STAGES.items():
        sub = subs.add_parser(name)
        for f in dataclasses.fields(kind):
            flag = "--" + f.name.replace("_", "-")
            if f.name == rest:
                sub.add_argument(rest, nargs=1 if rest == "store" else "*")
            elif f.type == "bool":
                sub.add_argument(flag, *(["--silent"] if f.name == "quiet" else []), dest=f.name, action="store_true")
            elif f.name in ("blacklist_chr",):
                sub.add_argument(flag, action="append")
            elif f.name in ("gff_hard_attributes", "gff_soft_attributes"):
                sub.add_argument(flag.rstrip("s"), dest=f.name, action="append", metavar="KEY=REGEX")
            else:
                cast = float if "float" in f.type else int if "int" in f.type else str
                sub.add_argument(flag, type=cast, required=f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING)
    return top


def stage_of(argv: list[str]):
    given = vars(parser().parse_args(argv))
    kind, rest = STAGES[given.pop("stage")]
    values = {k: v for k, v in given.items() if v not in (None, [])}
    if rest == "store":
        values["store"] = values["store"][0]
    for name in ("gff_hard_attributes", "gff_soft_attributes"):
        if name in values:
            pairs = [tuple(x.split("=", 1)) for x in values[name]]
            values[name] = dict(pairs) if name == "gff_hard_attributes" else pairs
    return kind(**values)


def main(argv: list[str]) -> None:
    stage = stage_of(argv)
    stage.validate()
    stage.run(SparkSession.builder.appName("spanloom").getOrCreate())


if __name__ == "__main__":
    main(sys.argv[1:])
