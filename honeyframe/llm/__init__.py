"""Operators for training-data pipelines over large document tables.

``load`` registers one query for each operator, with check SQL where SQL can
say the same.
"""

from __future__ import annotations

import functools
import importlib

from honeyframe.llm.ship import ship

QUERIES: dict = {}
ORACLES: dict = {}

_MODULES = ("queries",)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"honeyframe.llm.{m}")
