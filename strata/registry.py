"""Registry of runnable queries: one per operator of the inventory, each reading the given tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> DuckDB SQL`` (absent for the
rows-only checks). Query results pass through ``portable`` so both engines render values alike.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.portable import portable
from .plans.cdl import cdl_plans
from .sources.testdata import raw_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None, raw_output: bool = False):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Ctx(spark, sf_dir))
            return df if raw_output else portable(df)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


class Ctx:
    """Lazy RAW and CDL plans for one (session, data folder); nothing runs until an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._raw = None
        self._cdl = None
        self._kept = set()

    @property
    def raw(self) -> dict[str, DataFrame]:
        if self._raw is None:
            self._raw = raw_tables(self.spark, self.sf_dir)
        return self._raw

    @property
    def cdl(self) -> dict[str, DataFrame]:
        if self._cdl is None:
            self._cdl = cdl_plans(self.spark, self.raw)
        return self._cdl

    def keep(self, layer: dict[str, DataFrame], *names: str) -> None:
        """Write tables of ``raw`` or ``cdl`` that a query reads several times to the shared folder, so that they are
        computed once; what is built from them later reads the files."""
        from .session import frozen
        for name in names:
            if name not in self._kept:
                layer[name] = frozen(layer[name], name)
                self._kept.add(name)

    def forget(self, name: str) -> None:
        """Delete what ``keep`` wrote of a table that nothing of the query reads any more."""
        from .session import discard
        for layer in (self.raw, self.cdl):
            if name in self._kept and name in layer:
                for folder in {os.path.dirname(f) for f in layer.pop(name).inputFiles()}:
                    discard(self.spark, folder)
        self._kept.discard(name)

    def table(self, name: str) -> DataFrame:
        from .sources.testdata import read_table
        return read_table(self.spark, self.sf_dir, name)


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries  # noqa: F401
