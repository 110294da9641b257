"""Command line: score, attribution, density (one value, or directional) or impute the rows of a delimited file.

    spark-submit arborstream/cli.py score --input in.csv --output out [options]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arborstream.operators.detector import StreamForest
from arborstream.operators.scan import scan
from arborstream.sources import delimited

COMMANDS = ("score", "attribution", "density", "directional-density", "impute")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arborstream", description=__doc__.splitlines()[0])
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--number-of-trees", type=int, default=100)
    p.add_argument("--sample-size", type=int, default=256)
    p.add_argument("--window-size", type=int, default=0, help="rows after which a point has decayed; 0: none decays")
    p.add_argument("--shingle-size", type=int, default=1)
    p.add_argument("--shingle-cyclic", action="store_true")
    p.add_argument("--delimiter", default=",")
    p.add_argument("--header-row", action="store_true")
    p.add_argument("--key-column", type=int, help="number of the cell, from 0, that names a line's stream; without it all lines are one stream, which one task steps through")
    p.add_argument("--random-seed", type=int, default=42)
    return p


def stepper(command: str, args: argparse.Namespace):
    """A step for one ordered stream: vectors in, result cells out (nulls while warming up)."""

    def start(_):
        forest = StreamForest(args.number_of_trees, args.sample_size, 1 / args.window_size if args.window_size else 0.0, args.random_seed)
        ring: list[list[float]] = []
        count = [0]

        def step(row):
            line, cells, v = row
            base = len(v)
            missing = [i for i, x in enumerate(v) if x is None]
            if len(ring) < args.shingle_size:
                ring.append([0.0 if x is None else x for x in v])
            elif args.shingle_cyclic:
                ring[count[0] % args.shingle_size] = [0.0 if x is None else x for x in v]
            else:
                ring.append([0.0 if x is None else x for x in v])
                del ring[0]
            slot = count[0] % args.shingle_size if args.shingle_cyclic else len(ring) - 1
            count[0] += 1
            if len(ring) < args.shingle_size:
                return [(line, cells, None)]
            point = tuple(x for r in ring for x in r)
            result = None
            if command == "impute":
                if missing and forest.ready:
                    at = [slot * base + i for i in missing]
                    point = forest.impute(point, at)[0]
                    ring[slot] = list(point[slot * base : (slot + 1) * base])
                result = list(point[slot * base : (slot + 1) * base]) if forest.ready or not missing else None
                if missing and not forest.ready:
                    return [(line, cells, None)]
            elif forest.ready:
                if command == "score":
                    result = [forest.score(point)]
                elif command == "attribution":
                    result = forest.attribution(point)
                elif command == "density":
                    result = [forest.density(point)]
                else:
                    result = forest.directional_density(point)
            forest.update(point)
            return [(line, cells, result)]

        return step

    return start


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("arborstream").getOrCreate()
    rows = delimited.read(spark, args.input, args.delimiter, args.header_row, args.key_column)
    got = scan(rows, "stream", ["line"], ["line", "cells", "v"], stepper(args.command, args), "line long, cells array<string>, result array<double>")
    shown = F.when(F.col("result").isNull(), delimited.MISSING).otherwise(F.concat_ws(args.delimiter, F.col("result").cast("array<string>")))
    delimited.write(delimited.lines(got, [shown], args.delimiter), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
