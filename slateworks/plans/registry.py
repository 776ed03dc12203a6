"""All queries of the core library by name, with their SQL where there is some."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


for _module in ("data", "held_out", "measures", "scoring", "recommending", "answers", "reports"):
    importlib.import_module(f"slateworks.plans.{_module}")
