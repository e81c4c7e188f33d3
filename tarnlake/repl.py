"""A command line over an engine: statements end with a semicolon, commands begin with a dot."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from tarnlake.engine import Engine
from tarnlake.errors import EngineError
from tarnlake.service import Service
from tarnlake.text import format_result

HELP = """.tables               names of all tables
.indexes              all indexes
.schema TABLE         columns of a table
.stats                figures of the database
.commit               publish what is staged
.compact              join small parts
.gc [N]               keep the newest N versions (5)
.bench [N] [TABLE]    insert N rows (1000) and read some back
.manifest             the current snapshot
.help                 this text
.quit, .exit, .q      leave"""
ROWS = 1000


class Quit(Exception):
    pass


def command(engine: Engine, line: str) -> str:
    name, *args = line.split()
    match name, *args:
        case (".quit" | ".exit" | ".q"), *_:
            engine.close()
            raise Quit
        case ".tables", *_:
            return "\n".join(engine.tables()) or "No tables"
        case ".indexes", *_:
            return "\n".join(f"{i['name']} on {i['table']}({', '.join(i['columns'])}){' UNIQUE' if i['unique'] else ''}" for i in engine.indexes()) or "No indexes"
        case ".schema", table:
            return "\n".join(f"{c['name']} {c['type'].upper()}{' PRIMARY KEY' if c['primary_key'] else ''}{'' if c['nullable'] else ' NOT NULL'}" for c in engine.schema(table)["columns"])
        case ".stats", *_:
            return json.dumps(engine.stats(), indent=2)
        case ".commit", *_:
            engine.commit()
            return "Committed"
        case ".compact", *_:
            return engine.compact()
        case ".gc", *rest:
            return engine.gc(int(rest[0]) if rest and rest[0].isdigit() else 5)
        case ".bench", *rest:
            return json.dumps(engine.benchmark(int(rest[0]) if rest and rest[0].isdigit() else 1000, *rest[1:2]))
        case ".manifest", *_:
            return engine.manifest()
        case ".help", *_:
            return HELP
    return f"Unknown command: {line} (.help lists all)"


def session(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    """The answer to each command and statement."""
    held = ""
    for line in lines:
        text = line.strip()
        try:
            if not held and text.startswith("."):
                yield command(engine, text)
                continue
            held = f"{held}\n{line}" if held else text
            if text.endswith(";"):
                sql, held, began = held, "", time.time()
                yield format_result(engine.sql(sql), ROWS) + f"\n({time.time() - began:.3f} s)"
        except Quit:
            return
        except EngineError as e:
            yield f"Error: {e}"


def main() -> None:
    p = argparse.ArgumentParser(description="SQL over versioned Parquet tables")
    p.add_argument("root", help="folder of the database, in any store that Spark reaches")
    p.add_argument("-e", metavar="SQL", help="run one statement")
    p.add_argument("--mode", choices=("ansi", "compat"), default="ansi")
    p.add_argument("--port", type=int, help="serve HTTP")
    p.add_argument("--api-key", default="")
    a = p.parse_args()
    engine = Engine(SparkSession.builder.getOrCreate(), a.root, a.mode)
    if a.e:
        print(format_result(engine.sql(a.e), ROWS))
    elif a.port:
        server = Service(engine, a.api_key).serve(a.port)
        print(f"Serving at {server.server_address}")
        while True:
            time.sleep(3600)
    else:
        for answer in session(engine, sys.stdin):
            print(answer, flush=True)


if __name__ == "__main__":
    main()
