"""Command line: ``python -m tamarind.cli -d FOLDER [-e SQL | -f FILE]``; without either, a prompt."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Engine, Result
from .errors import EngineError
from .transactions import LEVELS, REPEATABLE_READ


def cell(value: object) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def shown(result: Result) -> str:
    """A table, or what a statement says, and how long it took."""
    if result.explanation:
        return result.explanation
    footer = f"({len(result.rows)} rows, {result.elapsed * 1000:.1f} ms)"
    if not result.columns:
        return f"{result.message} ({result.elapsed * 1000:.1f} ms)"
    rows = [result.columns, *([cell(v) for v in r] for r in result.rows)]
    widths = [max(map(len, c)) for c in zip(*rows, strict=True)]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:], footer])


def main(args: list[str] | None = None, out=sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="tamarind")
    p.add_argument("-d", "--database", required=True, help="folder of the tables")
    p.add_argument("-e", "--execute", help="a script to run")
    p.add_argument("-f", "--file", help="a file with a script to run")
    p.add_argument("-b", "--budget", type=float, help="rows that a sort or hash table holds before a spill is counted")
    p.add_argument("-l", "--level", choices=LEVELS, default=REPEATABLE_READ, help="isolation of the session")
    p.add_argument("-q", "--quiet", action="store_true", help="rows only")
    a = p.parse_args(args)
    engine = Engine(SparkSession.builder.getOrCreate(), a.database, budget=a.budget, level=a.level)

    def run(text: str) -> bool:
        try:
            result = engine.run_script(text)
        except EngineError as e:
            print(f"error: {e}", file=out)
            return False
        print("\n".join("\t".join(map(cell, r)) for r in result.rows) if a.quiet else shown(result), file=out)
        return True

    if a.execute is not None:
        return 0 if run(a.execute) else 1
    if a.file is not None:
        with open(a.file, encoding="utf-8") as f:
            return 0 if run(f.read()) else 1
    held = ""
    for line in iter(lambda: input("... " if held else "sql> "), None):
        held += line + "\n"
        if line.strip() in ("quit", "exit"):
            break
        if line.rstrip().endswith(";"):
            run(held)
            held = ""
    return 0


if __name__ == "__main__":
    sys.exit(main())
