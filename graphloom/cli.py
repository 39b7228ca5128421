"""A small shell: python -m graphloom.cli [--store PATH | --tables DIR] [-c QUERY]."""

from __future__ import annotations

import argparse
import os
import shlex
import subprocess
import sys
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .cypher import parse
from .session import GraphSession
from .sources.trade import trade_graph
from .types import plain

HELP = "Queries end with a semicolon.  STREAM before a query follows it.  :explain QUERY  :edit (the last query, in $EDITOR)  :help  :quit"


def table(df: DataFrame, most: int = 1000) -> str:
    found = df.limit(most + 1).collect()
    rows = [df.columns, *[["null" if v is None else str(v) for v in map(plain, r)] for r in found[:most]]]
    if not df.columns:
        return "done"
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in rows) + (f"\n(the first {most} rows)" if len(found) > most else f"\n({len(found)} rows)")


def run(session: GraphSession, text: str, out=print) -> None:
    """One query or command; errors are shown, not raised."""
    try:
        if text.startswith(":explain"):
            out(session.explain(text[len(":explain") :].strip()))
            return
        if parse(text).stream:
            live = session.subscribe(text)
            batch = live.poll()
            for sign, df in (("+", batch.added), ("-", batch.removed)):
                for r in sorted(str(tuple(plain(v) for v in r)) for r in df.collect()):
                    out(f"{sign} {r}")
            return
        out(table(session.query(text)))
    except Exception as e:  # noqa: BLE001
        out(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")


def edited(text: str) -> str:
    """text as it comes back from the editor of the environment."""
    with tempfile.NamedTemporaryFile("w+", suffix=".cypher") as f:
        f.write(text)
        f.flush()
        subprocess.run([*shlex.split(os.environ.get("EDITOR", "vi")), f.name], check=True)
        f.seek(0)
        return open(f.name).read()


def loop(session: GraphSession, lines: Iterable[str], out=print) -> None:
    held = last = ""
    for line in lines:
        word = line.strip()
        if not held and word == ":quit":
            return
        if not held and word == ":help":
            out(HELP)
        elif not held and word == ":edit":
            try:
                last = edited(last)
            except (OSError, subprocess.CalledProcessError) as e:
                out(f"{type(e).__name__}: {e}")
                continue
            run(session, last, out)
        elif not held and word.startswith(":"):
            run(session, word, out)
        else:
            held += line
            if word.endswith(";"):
                run(session, held, out)
                held, last = "", held
    if held.strip():
        run(session, held, out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--store")
    p.add_argument("--tables")
    p.add_argument("-c", dest="query")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    session = GraphSession(spark, trade_graph(spark, a.tables) if a.tables else a.store)
    if a.query:
        run(session, a.query)
    else:
        loop(session, sys.stdin)


if __name__ == "__main__":
    main()
