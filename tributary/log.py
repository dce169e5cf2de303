"""Logging: the library logs to ``tributary`` and attaches no handler by itself."""

from __future__ import annotations

import logging
import os
import sys

#: Fixed levels by the first letters of the environment's name.
LEVELS = {"dev": logging.DEBUG, "test": logging.ERROR, "pr": logging.WARNING}


def level_of(environment: str | None) -> int:
    """``dev`` logs all, ``test`` errors, ``pr...`` (production) warnings; anything else information."""
    name = (environment or "").lower()
    return next((level for prefix, level in LEVELS.items() if name.startswith(prefix)), logging.INFO)


def configure(environment: str | None = None) -> logging.Logger:
    """Log to standard output, at the level of ``environment`` or of the variable TRIBUTARY_ENV."""
    logger = logging.getLogger("tributary")
    logger.setLevel(level_of(environment if environment is not None else os.environ.get("TRIBUTARY_ENV")))
    if not any(getattr(h, "tributary", False) for h in logger.handlers):
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        handler.tributary = True
        logger.addHandler(handler)
    return logger
