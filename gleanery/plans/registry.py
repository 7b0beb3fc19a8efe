"""A user's own steps in specifications: functions of a DataFrame, and Python table functions that take a table dealt by key.

``@step("name", needs=[...])`` registers ``f(df, settings, order) -> DataFrame``. ``table_step("name", cls, needs=[...])`` registers a class with ``eval`` (a row at a time),
``terminate`` (the end of a key's rows) and, where its columns follow from its input, ``analyze``; the step's ``key`` and ``sort`` say how the
table is dealt and ordered, its ``args`` are passed on. Names of the library's steps can't be taken, and what is missing in a specification is told
before anything runs.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.plans import spec


def _add(name: str, run: Callable, needs: list[str], replace: bool) -> None:
    if name in spec.STEPS and (name not in OWN or not replace):
        raise ValueError(f"there is a step {name!r} already")
    OWN.add(name)
    spec.STEPS[name], spec.NEEDS[name] = run, list(needs)


#: Names of registered steps.
OWN: set[str] = set()


def step(name: str, needs: list[str] | None = None, replace: bool = False):
    """Register a function of (DataFrame, settings, order)."""

    def keep(fn: Callable[[DataFrame, dict, list], DataFrame]):
        if len(inspect.signature(fn).parameters) != 3:
            raise TypeError("a step takes a DataFrame, its settings and the order")
        _add(name, fn, needs or [], replace)
        return fn

    return keep


def table_step(name: str, cls: type, needs: list[str] | None = None, schema: str | None = None, replace: bool = False) -> None:
    """Register a table function; ``schema`` is its output unless the class has ``analyze``."""
    if not hasattr(cls, "eval") or (schema is None) != hasattr(cls, "analyze"):
        raise TypeError("a table function has eval, and either a schema or analyze")
    made = F.udtf(cls) if schema is None else F.udtf(cls, returnType=schema)

    def run(df: DataFrame, settings: dict, order: list) -> DataFrame:
        keys = settings["key"] if isinstance(settings["key"], list) else [settings["key"]]
        sort = settings.get("sort") or []
        table = df.asTable().partitionBy(*keys)
        if sort:
            table = table.orderBy(*([sort] if isinstance(sort, str) else sort))
        return made(table, *[F.lit(a) for a in settings.get("args") or []])

    _add(name, run, ["key", *(needs or [])], replace)


def remove(name: str) -> None:
    """Forget a registered step."""
    OWN.remove(name)
    del spec.STEPS[name], spec.NEEDS[name]
