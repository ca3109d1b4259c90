"""Registered queries and, where SQL can say the same, their check query."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

_MODULES = (
    "grid", "report", "frames", "stats", "probability", "symmetry", "mixture",
    "lattice", "topology", "files", "streams",
)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"honeyframe.catalog.{m}")
