"""``python -m runlake.cli ingest | tabulate | consolidate``."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from runlake import config as settings
from runlake.plans import pipeline
from runlake.runlog import logged
from runlake.session import session
from runlake.sources.ingest import ingest_run
from runlake.sources.manifest import MANIFEST_NAME


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="runlake")
    top.add_argument("--log_dir", default="logs")
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="fetch a range into a new run")
    ingest.add_argument("--location", required=True)
    ingest.add_argument("--start", help="UTC; absent or None: open")
    ingest.add_argument("--end", help="UTC; absent or None: open")
    ingest.add_argument("--raw_base_dir", help="else from the settings")
    tabulate = commands.add_parser("tabulate", help="raw runs to T1")
    tabulate.add_argument("--rebuild", action="store_true", help="all successful runs again, not just the next")
    tabulate.add_argument("--catch_up", action="store_true", help="all runs that are due, not just the next")
    tabulate.add_argument("--fetched_k_index_relative_dir")
    tabulate.add_argument("--T1_relative_dir")
    tabulate.add_argument("--manifest_file_name")
    consolidate = commands.add_parser("consolidate", help="T1 to T2")
    consolidate.add_argument("--T1_relative_dir")
    consolidate.add_argument("--T2_relative_dir")
    consolidate.add_argument("--states_relative_dir", help="keep states of keys here and merge only new runs into them")
    for p in (ingest, tabulate, consolidate):
        p.add_argument("--config_path", required=True)
    return top


def open_bound(text: str | None) -> str | None:
    return None if text == "None" else text


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)

    def body(log) -> None:
        own = settings.load(args.config_path)["space_weather"]
        fetched, made, moved = (own.get(k, {}).get("k_index", {}) for k in ("ingestion", "preprocessing", "transform"))
        spark = session(f"runlake {args.command}")
        raw = getattr(args, "fetched_k_index_relative_dir", None) or fetched.get("raw_base_dir")
        t1 = getattr(args, "T1_relative_dir", None) or made.get("T1_output_dir")
        if args.command == "ingest":
            out = ingest_run(spark, own, args.location, open_bound(args.start), open_bound(args.end), args.raw_base_dir)
        elif args.command == "tabulate":
            step: Callable = pipeline.rebuild if args.rebuild else pipeline.catch_up if args.catch_up else pipeline.increment
            out = step(spark, raw, t1, args.manifest_file_name or fetched.get("manifest_file_name", MANIFEST_NAME))
        else:
            t2, states = args.T2_relative_dir or moved.get("T2_output_dir"), args.states_relative_dir or moved.get("states_dir")
            out = pipeline.transform_new(spark, t1, states, t2) if states else pipeline.transform(spark, t1, t2)
        log.info("%s: %s", args.command, out)

    logged(args.command, body, args.log_dir)


if __name__ == "__main__":
    main()
