"""python -m blockscope build|query: index a stored dump, or list the windows that an index leaves."""

from __future__ import annotations

import argparse
import math

from pyspark.sql import SparkSession

from blockscope.sources.index_store import KINDS, MinMaxQuery, RTreeQuery, write_index
from blockscope.sources.particles import read_dump


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="blockscope")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="index a dump")
    build.add_argument("dump")
    build.add_argument("index")
    build.add_argument("--kind", choices=KINDS, default="minmax")
    build.add_argument("--layout", choices=("group", "file", "variable"), default="group")
    build.add_argument("--iteration", type=int)
    build.add_argument("--species")
    build.add_argument("--records", nargs="+", choices=("position", "momentum"))
    build.add_argument("--block-rows", type=int, default=100_000)
    build.add_argument("--slice-rows", type=int)
    build.add_argument("--bits-per-key", type=float, help="build Bloom filters over ids with so many bits for each")
    ask = commands.add_parser("query", help="list candidate windows")
    ask.add_argument("index")
    ask.add_argument("--kind", choices=KINDS, default="minmax")
    ask.add_argument("--iteration", type=int, required=True)
    ask.add_argument("--species", required=True)
    ask.add_argument("--record", default="position")
    ask.add_argument("--secondary", action="store_true")
    ask.add_argument("--output", help="write all windows to this folder as Parquet")
    for axis in "xyz":
        ask.add_argument(f"--{axis}", nargs=2, type=float, metavar=("LOW", "HIGH"))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("blockscope").getOrCreate()
    if a.command == "build":
        rows = read_dump(spark, a.dump, a.layout)
        rows = rows if a.iteration is None else rows.where(rows["iteration"] == a.iteration)
        rows = rows if a.species is None else rows.where(rows["species"] == a.species)
        write_index(rows, a.index, a.kind, a.block_rows, a.slice_rows, a.bits_per_key, records=a.records)
        return
    bounds = {axis: tuple(getattr(a, axis)) for axis in "xyz" if getattr(a, axis)}
    if a.kind == "minmax":
        if len(bounds) != 1:
            raise SystemExit("a min-max query takes one axis")
        ((axis, (low, high)),) = bounds.items()
        found = MinMaxQuery(spark, a.index, a.secondary).query_minmax(a.iteration, a.species, a.record, axis, low, high)
    else:
        box = {f"{end}{axis}": bounds.get(axis, (-math.inf, math.inf))[k] for axis in "xyz" for k, end in enumerate(("min", "max"))}
        found = RTreeQuery(spark, a.index, a.secondary).query_xyz(a.iteration, a.species, a.record, **box)
    if a.output:
        found.write.mode("errorifexists").parquet(a.output)
        return
    for row in found.orderBy("start").selectExpr("concat_ws(' ', iteration, species, start, end, cast(q AS string))").toLocalIterator():
        print(row[0])


if __name__ == "__main__":
    main()
