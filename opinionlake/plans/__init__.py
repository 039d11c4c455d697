"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import functools
import os
from pathlib import Path

QUERIES: dict = {}
ORACLE: dict = {}
#: Bytes of an Arrow batch. A Python worker holds a batch and all it makes of it; tokens or parsed pages are many times their text.
BATCH_BYTES = 8 << 20


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under an inventory id."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(function)
        def run(spark, sf_dir):
            # Local days, buckets and text forms of times all assume the UTC session zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
            _let_workers_import(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _let_workers_import(spark) -> None:
    """Put the package's folder on the Python workers' path, whatever the working directory is.

    Enough for one machine or a shared installation; elsewhere the package travels with --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)


def load_all() -> None:
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
