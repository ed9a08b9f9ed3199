"""Build commands: python -m evq.sources.cli publish|embed|index FROM TO TABLE ..."""

from __future__ import annotations

import argparse
import shutil
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from evq.operators import search_index
from evq.plans.service import HashEmbedder
from evq.sources import build, vector_store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evq")
    commands = p.add_subparsers(dest="command", required=True)
    one = commands.add_parser("publish", help="copy tables to a folder that readers see whole")
    one.add_argument("source"), one.add_argument("target"), one.add_argument("tables", nargs="+")
    two = commands.add_parser("embed", help="vectors of the distinct texts of a column")
    two.add_argument("source"), two.add_argument("target"), two.add_argument("table"), two.add_argument("column")
    two.add_argument("--workers", type=int, default=vector_store.WORKERS), two.add_argument("--size", type=int, default=64)
    two.add_argument("--restart", action="store_true", help="make all vectors anew"), two.add_argument("--dry-run", action="store_true", help="count the texts only")
    three = commands.add_parser("index", help="search index of text columns")
    three.add_argument("source"), three.add_argument("target"), three.add_argument("table"), three.add_argument("key"), three.add_argument("columns", nargs="+")
    return p


def main(argv: Sequence[str], spark: SparkSession | None = None) -> int:
    said = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("evq").getOrCreate()
    if said.command == "publish":
        print(build.publish({t: build.table(spark, said.source, t) for t in said.tables}, said.target))
    elif said.command == "index":
        search_index.write(build.table(spark, said.source, said.table), said.key, said.columns, said.target)
        print(search_index.read(spark, said.target).n)
    else:
        texts = build.table(spark, said.source, said.table).select(said.column)
        if said.dry_run:
            print({"texts": texts.where(f"`{said.column}` is not null").distinct().count()})
            return 0
        if said.restart:
            shutil.rmtree(said.target, ignore_errors=True)
        print(vector_store.build(texts, HashEmbedder(said.size).embed, said.target, {"model": "hash", "size": said.size}, workers=said.workers))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
