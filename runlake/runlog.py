"""A log file for each command, whose name tells how it ended.

Fixed values: the names are ``<command>_<UTC time>.<status>.log`` with status running, success or error.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from pathlib import Path

from runlake.functions.timefmt import new_run_id


class RunLog:
    """``with RunLog(name, folder) as log:`` writes to ``...running.log`` and the console. Leaving renames the file: success, or error
    with the exception's trace (which goes on up). What isn't an ``Exception``, an interrupt say, leaves it as running."""

    def __init__(self, name: str, folder: str | Path = "logs") -> None:
        self.name, self.path = name, Path(folder) / f"{name}_{new_run_id()}.running.log"
        self.root, self.before = logging.getLogger(), logging.getLogger().level
        self.sinks: list[logging.Handler] = []

    def __enter__(self) -> logging.Logger:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.sinks = [logging.StreamHandler(), logging.FileHandler(self.path, encoding="utf-8")]
        for sink in self.sinks:
            sink.setFormatter(logging.Formatter("{asctime} {levelname:<7} {name}: {message}", style="{"))
            self.root.addHandler(sink)
        self.root.setLevel(logging.INFO)
        return logging.getLogger(self.name)

    def __exit__(self, kind, error, trace) -> None:
        ended = "success" if error is None else "error" if isinstance(error, Exception) else "running"
        logging.getLogger(self.name).log(logging.INFO if error is None else logging.ERROR, "ended: %s", ended, exc_info=error)
        for sink in self.sinks:
            self.root.removeHandler(sink)
            sink.close()
        self.root.setLevel(self.before)
        self.path = renamed(self.path, ended)


def renamed(path: str | Path, status: str) -> Path:
    """The log's name for a status; the file, if it is still there, gets it."""
    path = Path(path)
    final = path.with_name(path.name.replace(".running.log", f".{status}.log"))
    if path.exists():
        path.rename(final)
    return final


def logged(name: str, body: Callable[[logging.Logger], None], folder: str | Path = "logs") -> Path:
    """``body`` under a log of its own; the log's path at the end."""
    held = RunLog(name, folder)
    with held as log:
        body(log)
    return held.path
