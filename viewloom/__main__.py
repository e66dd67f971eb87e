"""python -m viewloom [FILE...]: run script files, or read statements up to ``;`` from standard input."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from viewloom.engine import Engine, split_statements
from viewloom.errors import EngineError


def main(paths: list[str]) -> int:
    engine = Engine(SparkSession.builder.appName("viewloom").getOrCreate())
    if paths:
        for path in paths:
            with open(path) as f:
                for statement in split_statements(f.read()):
                    try:
                        print(engine.execute(statement))
                    except EngineError as e:
                        print(e, file=sys.stderr)
                        return 1
        return 0
    held = ""
    for line in sys.stdin:
        held += line
        if held.rstrip().endswith(";"):
            for statement in split_statements(held):
                try:
                    print(engine.execute(statement))
                except EngineError as e:
                    print(e, file=sys.stderr)
            held = ""
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
