"""spark-submit entry: revise a table of documents by a table of revisions.

    python -m palimpsest SOURCE [BASE] --out FOLDER [-i SOURCE] [-b BASE] [--id COLUMN] [--env FILE]

SOURCE and BASE are Parquet tables of (id, text). FOLDER must not exist; it receives the tables
diff, actions, skipped, warnings and log, and a Markdown file per document under texts."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from palimpsest.plans.revise import revise
from palimpsest.sources import sinks


def resolve(positional: Sequence[str], source: str | None, base: str | None) -> tuple[str, str | None]:
    """(source, base) from positional arguments and switches. Switches win; a positional argument
    beside a source switch is the base. ValueError for a third one, or for no source."""
    if len(positional) > 2:
        raise ValueError("at most two positional arguments: SOURCE [BASE]")
    rest = list(positional)
    if source is None:
        if not rest:
            raise ValueError("no SOURCE given")
        source = rest.pop(0)
    if base is None and rest:
        base = rest.pop(0)
    return source, base


def settings(lines: Sequence[str]) -> dict[str, str]:
    """KEY=VALUE lines, with or without `export` and quotes; blank lines and # lines are skipped."""
    found = {}
    for line in lines:
        key, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not key.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            found[key.strip()] = value[1:-1] if quoted else value
    return found


def load_settings(path: str) -> None:
    """Put a file's settings into the environment; what is set there already stays."""
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for key, value in settings(f.readlines()).items():
                os.environ.setdefault(key, value)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="palimpsest")
    parser.add_argument("positional", nargs="*")
    parser.add_argument("-i", "--input")
    parser.add_argument("-b", "--base")
    parser.add_argument("--out", required=True)
    parser.add_argument("--id", default="pair_id")
    parser.add_argument("--env", default=".env")
    args = parser.parse_args(argv)
    try:
        source, base = resolve(args.positional, args.input, args.base)
    except ValueError as e:
        parser.error(str(e))
    if base is None:
        parser.error("creating documents without a base is left to other tools: give BASE or -b")
    load_settings(args.env)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    old, new = spark.read.parquet(base), spark.read.parquet(source)
    result = revise(old, new, args.id)
    for name in ("diff", "actions", "skipped", "warnings"):
        getattr(result, name).write.parquet(f"{args.out}/{name}")
    sinks.log(result).write.parquet(f"{args.out}/log")
    sinks.write_texts(sinks.output_texts(old, result, args.id), f"{args.out}/texts", "pair_id")
    result.release()


if __name__ == "__main__":
    main()
