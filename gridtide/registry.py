"""Extension points: transforms, processes and named recipes, each a Python function over DataFrames."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from typing import Any, Protocol

from pyspark.sql import DataFrame

from gridtide.errors import GridError, NotFoundError

Transform = Callable[..., DataFrame]
Process = Callable[..., DataFrame]

_transforms: dict[str, Transform] = {}
_processes: dict[str, Process] = {}
_builtin_processes: set[str] = set()


class SourceAdapter(Protocol):
    """What a data source offers to an append: its grid, its periods, and the rows of some periods."""

    def grid(self, bbox: tuple[float, float, float, float]) -> Any:
        """Grid description, without moving data."""

    def periods(self, start: str, end: str) -> DataFrame:
        """Available periods as ``period_id`` rows."""

    def fetch(self, periods: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
        """Cube rows of the given periods."""


def register_transform(name: str, fn: Transform) -> Transform:
    """Make ``fn(cube, template, **params)`` available to templates."""
    _transforms[name] = fn
    return fn


def transform_by_name(name: str) -> Transform:
    """A registered transform, or a function given by its dotted path."""
    if name in _transforms:
        return _transforms[name]
    module_name, _, attribute = name.rpartition(".")
    if not module_name:
        raise NotFoundError(f"Transform '{name}' does not exist")
    try:
        module = importlib.import_module(module_name)
    except ImportError as exc:
        raise GridError(f"Transform module '{module_name}' of '{name}' cannot be imported") from exc
    if not hasattr(module, attribute):
        raise NotFoundError(f"Transform '{name}' does not exist")
    fn = getattr(module, attribute)
    if not callable(fn):
        raise GridError(f"Transform '{name}' is not callable")
    return fn


def register_process(name: str, fn: Process, builtin: bool = False) -> Process:
    """Make a keyword function that produces a dataset callable by name; a later one overrides."""
    _processes[name] = fn
    if builtin:
        _builtin_processes.add(name)
    return fn


def process_by_name(name: str) -> Process:
    if name not in _processes:
        raise NotFoundError(f"Process '{name}' not found")
    return _processes[name]


def process_names() -> list[str]:
    return sorted(_processes)


class Recipes:
    """Named, parameterised chains of operators that can call each other, but never themselves."""

    def __init__(self) -> None:
        self._stored: dict[str, Callable[..., DataFrame]] = {}
        self._running: list[str] = []

    def store(self, name: str, fn: Callable[..., DataFrame]) -> None:
        """Keep ``fn(recipes, **parameters)`` under a name that no built-in process uses."""
        if name in _builtin_processes:
            raise GridError(f"'{name}' is the name of a built-in process")
        self._stored[name] = fn

    def remove(self, name: str) -> None:
        if self._stored.pop(name, None) is None:
            raise NotFoundError(f"Recipe '{name}' not found")

    def names(self) -> list[str]:
        return sorted(self._stored)

    def run(self, name: str, parameters: Mapping[str, Any] | None = None, **more: Any) -> DataFrame:
        """Build the plan of a stored recipe, or of a process if no recipe has the name."""
        arguments = {**(parameters or {}), **more}
        if name not in self._stored:
            return process_by_name(name)(**arguments)
        if name in self._running:
            raise GridError(f"Recipe '{name}' calls itself")
        self._running.append(name)
        try:
            return self._stored[name](self, **arguments)
        finally:
            self._running.pop()
