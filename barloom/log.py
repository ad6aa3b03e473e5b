"""Log set-up of the command line and of runs."""

from __future__ import annotations

import logging
import os
import sys

FORMAT = "%(asctime)s %(levelname)s %(name)s %(run)s%(message)s"


def set_up(level: str = "INFO", file: str | None = None, run: str = "") -> logging.Logger:
    """The library's logger, writing to standard output and, if given, to a file on the driver; lines carry the run's name. Setting
    up again replaces what was set up before."""
    log = logging.getLogger("barloom")
    log.setLevel(level.upper())
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if file:
        os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter(FORMAT, defaults={"run": f"[{run}] " if run else ""}))
        log.addHandler(h)
    return log
